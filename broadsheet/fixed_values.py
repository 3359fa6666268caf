"""Values that results depend on, stated as they are."""

# --- fixed values: sentiment lexicons -------------------------------------------------------
POSITIVE_WORDS = (
    "good", "great", "positive", "success", "win", "growth", "improve", "benefit",
    "breakthrough", "achievement", "hope", "optimistic", "gain", "rise", "boost",
    "progress", "celebrate", "innovation", "recovery",
)
NEGATIVE_WORDS = (
    "bad", "crisis", "fail", "loss", "threat", "danger", "decline", "conflict", "war",
    "death", "disaster", "attack", "crash", "fear", "scandal", "corruption", "collapse",
    "violence", "recession", "fraud",
)
SENTIMENT_LABELS = ("positive", "negative", "neutral")

# --- fixed values: words left out of the word frequency -------------------------------------
STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "are", "was", "has", "have", "had",
    "not", "but", "they", "their", "will", "been", "your", "more", "also", "into", "its",
    "than", "then", "can", "which", "who", "what", "when", "where", "how", "all", "one",
    "said", "after", "about", "over", "would", "could", "should", "very",
)
MIN_WORD_LENGTH = 4

# --- fixed values: patterns of the text normalisation ---------------------------------------
HTML_TAG = r"<[^>]+>"
URL = r"https?://\S+|www\.\S+"
WHITESPACE_TO_COLLAPSE = r"\s{2,}|[^\S ]"  # same result as \s+, single spaces stay
NON_LETTERS = "[^a-z]+"

# --- fixed values: chunking -----------------------------------------------------------------
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
SHORT_TEXT = 100
BREAK_AFTER = 0.3  # a sentence end counts only beyond this share of the window
STRIPPED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: defaults of chunk metadata and of enriched hits --------------------------
DEFAULT_SOURCE = "unknown"
DEFAULT_CATEGORY = "general"
DEFAULT_COUNTRY = "us"
DEFAULT_LANGUAGE = "en"
FETCHED_CATEGORIES = (
    "top", "technology", "science", "business", "health", "politics", "sports",
)
TIMER_CATEGORIES = ("top", "technology", "science", "business", "health")

# --- fixed values: limits -------------------------------------------------------------------
MAX_PAGE = 100
DEFAULT_PAGE = 20
MAX_TOP_K = 50
SEARCH_TOP_K = 10
CONTEXT_TOP_K = 5
CITATION_CHARS = 200
SEARCH_SNIPPET_CHARS = 300
PREVIEW_CHARS = 300
MISMATCH_SAMPLE = 10
EMBEDDING_BATCH = 20
FETCH_INTERVAL_MINUTES = 15

# --- fixed values: context and prompt texts -------------------------------------------------
CONTEXT_BLOCK = (
    "[Source %s] %s\nSource: %s\nCategory: %s\nPublished: %s\nContent: %s\n"
)
UNKNOWN = "Unknown"
CONTEXT_SEPARATOR = "\n---\n"
NO_CONTEXT = "No relevant news articles found in the database."
PROMPT = (
    "Based on the following news articles, please answer the user's question.\n\n"
    "NEWS ARTICLES:\n%s\n\nUSER QUESTION: %s\n\n"
    "Please provide a comprehensive, well-cited answer."
)
