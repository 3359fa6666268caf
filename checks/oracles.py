"""The SQL that every query is checked against, for DuckDB.

Written from the meaning of the operators, with other means than the Spark code: chunks by a
recursive query, searches by scoring all pairs, reports by one SELECT per section.
"""

from __future__ import annotations

from broadsheet import fixed_values as fixed
from checks.fixtures import CATEGORY_SLOTS, N_SLOTS

ORACLES: dict[str, str] = {}


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


# --- building blocks ------------------------------------------------------------------------

ARTICLES = f"""articles AS (
  SELECT d.doc_id,
         md5(concat(split_part(d.text, '.', 1), '_', d.source)) AS article_id,
         split_part(d.text, '.', 1) AS title,
         split_part(d.text, '.', 2) AS description,
         d.text AS content,
         d.source AS source_name,
         CAST(NULL AS VARCHAR) AS source_url,
         nullif(split_part('{CATEGORY_SLOTS}', ',', CAST(d.doc_id % {N_SLOTS} + 1 AS INTEGER)), 'none')
           AS category,
         'us' AS country,
         d.lang AS language,
         strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS published_at,
         p.url AS url,
         CAST(NULL AS VARCHAR) AS image_url,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
              WHEN l.quality IS NOT NULL THEN 'neutral' END AS sentiment,
         CASE WHEN l.quality IS NOT NULL THEN [d.lang, d.source] END AS keywords,
         e.ts AS created_at,
         l.doc_id IS NOT NULL AS is_reviewed
  FROM documents d
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN events e ON e.event_id = d.doc_id * 5
  LEFT JOIN pages p ON p.page_id = d.doc_id)"""


def _score(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{w}') AS INTEGER)" for w in words) + ")"


def _label(text: str) -> str:
    positive, negative = _score(text, fixed.POSITIVE_WORDS), _score(text, fixed.NEGATIVE_WORDS)
    return (
        f"CASE WHEN {positive} > {negative} THEN 'positive'"
        f" WHEN {negative} > {positive} THEN 'negative' ELSE 'neutral' END"
    )


SCORED = f"""scored AS (
  SELECT *, {_label("concat(title, ' ', description)")} AS recalculated_sentiment FROM articles)"""
_DISAGREES = "sentiment IS NOT NULL AND sentiment <> '' AND sentiment <> recalculated_sentiment"


def _normalise(text: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({text}, '{fixed.HTML_TAG}', ' ', 'g'),"
        f" '{fixed.URL}', '', 'g'), '\\s+', ' ', 'g'))"
    )


_FULL = "concat(title, ' ', description, ' ', content)"
NORMALISED = f"normalised AS (SELECT *, {_normalise(_FULL)} AS n FROM articles)"
ESTIMATED = """estimated AS (
  SELECT *, CASE WHEN length(n) <= 100 THEN 1
                 ELSE CAST(ceil((length(n) - 50) / 450.0::DOUBLE) AS BIGINT) END AS est
  FROM normalised)"""
_STOPS = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
WORDS = f"""words AS (
  SELECT word, count(*) AS freq
  FROM (SELECT unnest(regexp_split_to_array(lower(n), '{fixed.NON_LETTERS}')) AS word FROM normalised)
  WHERE length(word) >= {fixed.MIN_WORD_LENGTH} AND word NOT IN ({_STOPS})
  GROUP BY word)"""


def _chunks(source: str, name: str = "chunks") -> str:
    """Chunks of the rows (key, t) of `source`, as (key, chunk_index, document)."""

    def end(start: str) -> str:
        cut = f"length(regexp_extract(substr(t, {start} + 1, 500), '(?s)^.*[.\\n]'))"
        return (
            f"CASE WHEN {start} + 500 < length(t) AND {cut} > 151"
            f" THEN {start} + {cut} ELSE {start} + 500 END"
        )

    return f"""{name}_spans(key, s, e) AS (
  SELECT key, CAST(0 AS BIGINT), CAST({end('0')} AS BIGINT) FROM {source} WHERE length(t) >= 100
  UNION ALL
  SELECT x.key, x.e - 50, CAST({end('(x.e - 50)')} AS BIGINT)
  FROM {name}_spans x JOIN {source} y ON y.key = x.key WHERE x.e - 50 < length(t)),
{name}_cut AS (
  SELECT x.key, s, trim(substr(t, s + 1, e - s), '{fixed.STRIPPED}') AS document
  FROM {name}_spans x JOIN {source} y ON y.key = x.key),
{name} AS (
  SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY s) - 1 AS INTEGER) AS chunk_index, document
  FROM {name}_cut WHERE document <> ''
  UNION ALL
  SELECT key, 0, t FROM {source} WHERE length(t) BETWEEN 1 AND 99)"""


_INDEX = "concat(title, '. ', description, '. ', content)"
TEXTS = f"texts AS (SELECT CAST(doc_id AS VARCHAR) AS key, {_INDEX} AS t FROM articles)"
CHUNKED = _with(ARTICLES, TEXTS, _chunks("texts"), recursive=True)
_META = """coalesce(nullif({a}.source_name, ''), 'unknown') AS source,
  coalesce(nullif({a}.category, ''), 'general') AS category"""
_META_ALL = _META.format(a="a") + """,
  coalesce(a.published_at, '') AS published_at, coalesce(a.url, '') AS url"""

TOPICS = """components AS (
  SELECT label, i, avg(CAST(v AS DOUBLE)) AS m
  FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY label, i),
topics AS (
  SELECT CAST(label AS BIGINT) AS query_id, concat('What is new about topic ', label, '?') AS query,
         list(m ORDER BY i) AS embedding
  FROM components GROUP BY label)"""

GIVEN = """store AS (
  SELECT concat(a.doc_id, '_chunk_', v.vec_id % 5) AS chunk_id, CAST(a.doc_id AS VARCHAR) AS article_id,
         coalesce(d.text, '') AS document, a.title, a.source_name AS source, a.published_at,
         coalesce(a.url, '') AS url, CAST(v.label AS VARCHAR) AS category,
         CAST(v.embedding AS DOUBLE[]) AS embedding
  FROM embeddings v JOIN articles a ON a.doc_id = v.vec_id // 5
  LEFT JOIN documents d ON d.doc_id = v.vec_id)"""


# All chunks of all documents, with the given vectors, turned by a place in every round through them.
STORE = """numbered AS (
  SELECT *, CAST(key AS BIGINT) * 5 + chunk_index AS number, (SELECT count(*) FROM embeddings) AS n FROM chunks),
store AS (
  SELECT concat(c.key, '_chunk_', c.chunk_index) AS chunk_id, c.key AS article_id, c.document, a.title,
         coalesce(nullif(a.source_name, ''), 'unknown') AS source, coalesce(a.published_at, '') AS published_at,
         coalesce(a.url, '') AS url, CAST(v.label AS VARCHAR) AS category,
         list_concat(CAST(v.embedding AS DOUBLE[])[(number // n) % len(v.embedding) + 1:len(v.embedding)],
                     CAST(v.embedding AS DOUBLE[])[1:(number // n) % len(v.embedding)]) AS embedding
  FROM numbered c JOIN embeddings v ON v.vec_id = c.number % c.n
  JOIN articles a ON CAST(a.doc_id AS VARCHAR) = c.key)"""


def _hits(k: int, condition: str = "TRUE") -> str:
    return f"""hits AS (
  SELECT *, round(greatest(0, cosine), 4) AS relevance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank
    FROM (SELECT q.query_id, q.query, c.* EXCLUDE (embedding),
                 round(list_cosine_similarity(q.embedding, c.embedding), 12) AS cosine
          FROM topics q, store c WHERE {condition}))
  WHERE rank <= {k})"""


_STORED = (ARTICLES, TEXTS, _chunks("texts"), TOPICS, STORE)
SEARCH = _with(*_STORED, _hits(10), recursive=True) + """, found AS (
  SELECT h.*, count(*) OVER (PARTITION BY query_id) AS total FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY rank) AS nth FROM hits) h
  WHERE nth = 1)
"""
CONTEXT = _with(*_STORED, _hits(5), recursive=True) + f""", context AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS source_no FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY relevance DESC, rank) AS nth
    FROM hits) WHERE nth = 1),
blocks AS (
  SELECT query_id, string_agg(concat('[Source ', source_no, '] ', title, chr(10), 'Source: ', source, chr(10),
           'Category: ', category, chr(10), 'Published: ', published_at, chr(10), 'Content: ', document, chr(10)),
         concat(chr(10), '---', chr(10)) ORDER BY source_no) AS context
  FROM context GROUP BY query_id),
contexts AS (
  SELECT q.query_id, q.query, coalesce(b.context, '{fixed.NO_CONTEXT}') AS context
  FROM topics q LEFT JOIN blocks b ON b.query_id = q.query_id)
"""

# Landed answers: two articles per document, the failed fetches left out.
PARSED = f"""delivered AS (
  SELECT a.*, n.n - 1 AS position, split_part(a.content, '.', n.n) AS item_title,
         split_part(a.content, '.', n.n + 1) AS item_description,
         CASE WHEN language <> 'de' THEN source_name ELSE source_name END AS item_source
  FROM articles a LEFT JOIN labels l ON l.doc_id = a.doc_id, (VALUES (1), (2)) n(n)
  WHERE coalesce(l.toxic, 0) <> 1),
parsed AS (
  SELECT doc_id AS fetch_id, CAST(position AS BIGINT) AS position,
         md5(concat(item_title, '_', item_source)) AS article_id,
         item_title AS title, item_description AS description,
         coalesce(nullif(content, ''), item_description) AS content, item_source AS source_name,
         coalesce(category, 'top') AS category, 'us' AS country, 'en' AS language, published_at, url,
         {_label("concat(item_title, ' ', item_description)")} AS sentiment,
         CAST(to_json(coalesce(keywords, [])) AS VARCHAR) AS keywords, is_reviewed
  FROM delivered WHERE item_title <> '')"""


def _loads(source: str, order: str) -> str:
    """Rows of two loads into one table: the reviewed articles, then all; first ones win."""
    first = f"row_number() OVER (PARTITION BY article_id ORDER BY {order}) AS nth"
    return f"""load_1 AS (
  SELECT *, '1-reviewed' AS load_id FROM (SELECT *, {first} FROM {source} WHERE is_reviewed) WHERE nth = 1),
load_2 AS (
  SELECT *, '2-all' AS load_id FROM (SELECT *, {first} FROM {source}) x
  WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM load_1 y WHERE y.article_id = x.article_id)),
stored AS (SELECT * FROM load_1 UNION ALL SELECT * FROM load_2)"""


_SHORT = "article_id, title, content, source_name, category, sentiment"

# --- sources and sinks ----------------------------------------------------------------------

ORACLES["scan_articles"] = _with(ARTICLES) + """
SELECT doc_id, article_id, title, description, content, source_name, category, country, language,
       published_at, url, sentiment FROM articles"""
# CSV does not tell NULL from the empty string, as the reports' source does not.
ORACLES["scan_csv"] = _with(ARTICLES) + """
SELECT category, count(*) AS count FROM articles WHERE category <> '' GROUP BY category"""
ORACLES["csv_roundtrip"] = _with(ARTICLES) + """
SELECT article_id, nullif(title, '') AS title, nullif(content, '') AS content, source_name,
       nullif(category, '') AS category, sentiment, nullif(description, '') AS description, published_at, CAST(to_json(coalesce(keywords, [])) AS VARCHAR) AS keywords
FROM articles"""
ORACLES["ingest_payload"] = _with(ARTICLES, PARSED) + """
SELECT * EXCLUDE (is_reviewed) FROM parsed"""
_FETCHED = ", ".join(f"'{c}'" for c in fixed.FETCHED_CATEGORIES)
ORACLES["fetch_categories"] = _with(ARTICLES, PARSED) + f"""
SELECT article_id, title, category, content FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.article_id ORDER BY fetch_id, position) AS nth
  FROM parsed p JOIN articles a ON a.doc_id = p.fetch_id
  WHERE coalesce(nullif(a.category, ''), 'top') IN ({_FETCHED})) WHERE nth = 1"""
ORACLES["insert_new_articles"] = _with(ARTICLES, _loads("articles", "doc_id")) + f"""
SELECT {_SHORT}, load_id FROM stored"""
ORACLES["find_articles"] = _with(ARTICLES, _loads("articles", "doc_id")) + f"""
SELECT {_SHORT} FROM stored WHERE article_id IN (
  SELECT a.article_id FROM articles a JOIN labels l ON l.doc_id = a.doc_id WHERE l.toxic = 1)"""
ORACLES["insert_new_chunks"] = _with(
    ARTICLES,
    """firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY doc_id) AS nth FROM articles)
  WHERE nth = 1)""",
    """reviewed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY doc_id) AS nth
                 FROM articles WHERE is_reviewed) WHERE nth = 1)""",
    f"texts_1 AS (SELECT article_id AS key, {_INDEX} AS t FROM reviewed)",
    f"texts_2 AS (SELECT article_id AS key, {_INDEX} AS t FROM firsts)",
    _chunks("texts_1", "c1"),
    _chunks("texts_2", "c2"),
    recursive=True,
) + f"""
SELECT concat(key, '_chunk_', chunk_index) AS chunk_id, key AS article_id, chunk_index, document,
       {_META.format(a="a")}
FROM c1 JOIN reviewed a ON a.article_id = c1.key
UNION ALL
SELECT concat(key, '_chunk_', chunk_index), key, chunk_index, document, {_META.format(a="a")}
FROM c2 JOIN firsts a ON a.article_id = c2.key
WHERE NOT EXISTS (SELECT 1 FROM c1 WHERE c1.key = c2.key AND c1.chunk_index = c2.chunk_index)"""

# --- projections and filters ----------------------------------------------------------------

ORACLES["first_category"] = _with(ARTICLES) + """
SELECT doc_id, coalesce(category, language, 'top') AS category, coalesce(category, 'top') AS only_category
FROM articles"""
ORACLES["filter_nonempty"] = _with(ARTICLES) + """
SELECT doc_id, category FROM articles WHERE category IS NOT NULL AND category <> ''"""
ORACLES["filter_notnull"] = _with(ARTICLES) + """
SELECT doc_id, category FROM articles WHERE category IS NOT NULL"""
ORACLES["filter_category"] = _with(ARTICLES) + """
SELECT doc_id, title, category FROM articles WHERE category = 'science'"""
ORACLES["lookup_article"] = _with(ARTICLES) + """
SELECT doc_id, article_id, title, source_name FROM articles
WHERE article_id = (SELECT max(article_id) FROM articles)"""
ORACLES["sentiment_mismatch_rows"] = _with(ARTICLES, SCORED) + f"""
SELECT doc_id, sentiment, recalculated_sentiment FROM scored WHERE {_DISAGREES}"""
ORACLES["article_projection"] = _with(ARTICLES) + f"""
SELECT {_SHORT}, description, source_url, country, language, published_at, url, image_url,
       CAST(to_json(coalesce(keywords, [])) AS VARCHAR) AS keywords, CAST(created_at AS VARCHAR) AS created_at
FROM articles"""
ORACLES["filter_date_range"] = _with(ARTICLES) + """
SELECT doc_id, published_at FROM articles
WHERE CAST(published_at AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10 12:00:00'"""
ORACLES["normalised_preview"] = _with(ARTICLES, NORMALISED) + """
SELECT article_id, title, substr(n, 1, 300) AS normalised_preview, CAST(length(n) AS INTEGER) AS text_length
FROM normalised ORDER BY article_id, content LIMIT 5"""
ORACLES["sentiment_mismatch_sample"] = _with(ARTICLES, SCORED) + f"""
SELECT article_id, title, sentiment, recalculated_sentiment FROM scored WHERE {_DISAGREES}
ORDER BY article_id, title, sentiment LIMIT 10"""

# --- aggregations ---------------------------------------------------------------------------

ORACLES["total_articles"] = _with(ARTICLES) + "SELECT count(*) AS total_articles FROM articles"
ORACLES["category_counts"] = _with(ARTICLES) + """
SELECT category, count(*) AS count FROM articles WHERE category <> '' GROUP BY category"""
ORACLES["category_counts_notnull"] = _with(ARTICLES) + """
SELECT category, count(*) AS count FROM articles WHERE category IS NOT NULL GROUP BY category"""
ORACLES["sentiment_distribution"] = _with(ARTICLES) + """
SELECT s AS sentiment, count(a.doc_id) AS count
FROM (VALUES ('positive'), ('negative'), ('neutral')) v(s) LEFT JOIN articles a ON a.sentiment = s
GROUP BY s"""
for _name, _condition in (("top_sources", "source_name <> ''"), ("top_sources_notnull", "source_name IS NOT NULL")):
    ORACLES[_name] = _with(ARTICLES) + f"""
SELECT source_name AS source, count(*) AS count FROM articles WHERE {_condition}
GROUP BY source_name ORDER BY count DESC, source LIMIT 10"""
DAYS = """days AS (
  SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS count FROM articles
  WHERE created_at IS NOT NULL GROUP BY 1)"""
ORACLES["daily_trend_earliest"] = _with(ARTICLES, DAYS) + "SELECT * FROM days ORDER BY date LIMIT 30"
ORACLES["daily_trend_latest"] = _with(ARTICLES, DAYS) + "SELECT * FROM days ORDER BY date DESC LIMIT 7"
ORACLES["avg_content_length"] = _with(ARTICLES) + """
SELECT category, round(avg(length(content)), 1) AS avg_length FROM articles
WHERE content <> '' AND category <> '' GROUP BY category"""
ORACLES["chunk_estimates"] = _with(ARTICLES, NORMALISED, ESTIMATED) + """
SELECT doc_id, length(n) AS text_length, est AS estimated_chunks FROM estimated"""
ORACLES["chunk_estimate_stats"] = _with(ARTICLES, NORMALISED, ESTIMATED) + """
SELECT round(avg(est), 2) AS avg_chunks_per_article, max(est) AS max_chunks, min(est) AS min_chunks,
       CAST(sum(est) AS BIGINT) AS total_chunks FROM estimated"""
ORACLES["word_frequency"] = _with(ARTICLES, NORMALISED, WORDS) + """
SELECT word, freq FROM words ORDER BY freq DESC, word LIMIT 50"""
ORACLES["sentiment_recalc_distribution"] = _with(ARTICLES, SCORED) + """
SELECT recalculated_sentiment, count(*) AS count FROM scored GROUP BY 1"""
ORACLES["sentiment_mismatch_rate"] = _with(ARTICLES, SCORED) + f"""
SELECT count(*) AS total_processed, count(*) FILTER ({_DISAGREES}) AS mismatch_count,
       round(100 * (count(*) FILTER ({_DISAGREES}) / count(*)), 2) AS mismatch_rate_pct FROM scored"""
ORACLES["category_sentiment"] = _with(ARTICLES, SCORED) + """
SELECT category, recalculated_sentiment, count(*) AS count FROM scored WHERE category <> '' GROUP BY 1, 2"""
ORACLES["category_sentiment_pivot"] = _with(ARTICLES, SCORED) + """
SELECT category,
       concat('{', string_agg(concat('"', recalculated_sentiment, '":', n), ',' ORDER BY recalculated_sentiment), '}')
         AS sentiments,
       CAST(coalesce(sum(n) FILTER (recalculated_sentiment = 'positive'), 0) AS BIGINT) AS positive,
       CAST(coalesce(sum(n) FILTER (recalculated_sentiment = 'negative'), 0) AS BIGINT) AS negative,
       CAST(coalesce(sum(n) FILTER (recalculated_sentiment = 'neutral'), 0) AS BIGINT) AS neutral
FROM (SELECT category, recalculated_sentiment, count(*) AS n FROM scored WHERE category <> '' GROUP BY 1, 2)
GROUP BY category"""
ORACLES["ingest_counts"] = _with(
    ARTICLES, PARSED, _loads("parsed", "fetch_id, position"),
    f"texts AS (SELECT article_id AS key, {_INDEX} AS t FROM load_2)", _chunks("texts"),
    recursive=True,
) + """
SELECT 'answers' AS counter, count(*) AS n FROM documents
UNION ALL SELECT 'rejected', count(*) FROM labels WHERE toxic = 1
UNION ALL SELECT 'without_vector', count(*) FROM chunks WHERE NOT regexp_matches(document, '[\\p{L}\\p{N}]')
UNION ALL SELECT 'fetched', count(*) FROM parsed
UNION ALL SELECT 'new_inserted', count(*) FROM load_2
UNION ALL SELECT 'indexed', count(DISTINCT key) FROM chunks
UNION ALL SELECT 'new_chunks', count(*) FROM chunks"""
ORACLES["vector_count"] = "SELECT count(*) AS vector_count FROM embeddings"
ORACLES["dashboard_summary"] = _with(ARTICLES) + """
SELECT count(*) AS total_articles, count(DISTINCT category) AS categories,
       least(count(DISTINCT source_name), 10) AS sources,
       count(*) FILTER (sentiment IN ('positive', 'negative', 'neutral')) AS sentiment_analyzed FROM articles"""

# --- chart scales and pages -----------------------------------------------------------------

ORACLES["category_percent_of_max"] = _with(ARTICLES) + """
SELECT category, count, CAST(floor(100.0::DOUBLE * count / max(count) OVER () + 0.5) AS BIGINT) AS pct
FROM (SELECT category, count(*) AS count FROM articles WHERE category <> '' GROUP BY category)"""
ORACLES["trend_percent_of_max"] = _with(ARTICLES, DAYS) + """
SELECT date, count,
       greatest(8, CAST(floor(100.0::DOUBLE * count / max(count) OVER () + 0.5) AS BIGINT)) AS height_pct,
       concat(substr(date, 6, 2), '/', substr(date, 9, 2)) AS label
FROM (SELECT * FROM days ORDER BY date DESC LIMIT 14)"""
ORACLES["sentiment_share"] = _with(ARTICLES) + """
SELECT *, 100 - pos_pct - neg_pct AS neu_pct FROM (
  SELECT *, CAST(floor(100.0::DOUBLE * positive / (positive + negative + neutral) + 0.5) AS BIGINT) AS pos_pct,
         CAST(floor(100.0::DOUBLE * negative / (positive + negative + neutral) + 0.5) AS BIGINT) AS neg_pct
  FROM (SELECT count(*) FILTER (sentiment = 'positive') AS positive,
               count(*) FILTER (sentiment = 'negative') AS negative,
               count(*) FILTER (sentiment = 'neutral') AS neutral FROM articles))"""
ORACLES["list_articles"] = _with(ARTICLES) + """
SELECT article_id, title, category, published_at FROM articles
ORDER BY created_at DESC NULLS LAST, article_id LIMIT 20 OFFSET 40"""
ORACLES["list_articles_after"] = _with(ARTICLES) + """
SELECT article_id, title, category, published_at FROM articles
ORDER BY created_at DESC NULLS LAST, article_id LIMIT 20 OFFSET 40"""
ORACLES["list_articles_category"] = _with(ARTICLES) + """
SELECT article_id, title, published_at FROM articles WHERE category = 'health'
ORDER BY created_at DESC NULLS LAST, article_id LIMIT 20"""

# --- unions and duplicates ------------------------------------------------------------------

BATCHES = """batches AS (
  SELECT article_id, title, content, category, concat('1-', lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS landed
  FROM articles
  UNION ALL
  SELECT md5(concat(split_part(text, '.', 1), '_conversations')), split_part(text, '.', 1), text, NULL,
         concat('2-', lpad(CAST(conv_id AS VARCHAR), 12, '0'), lpad(CAST(turn AS VARCHAR), 12, '0'))
  FROM conversations
  UNION ALL
  SELECT md5(concat(split_part(text, '.', 1), '_benchmark')), split_part(text, '.', 1), text, NULL,
         concat('3-', lpad(CAST(item_id AS VARCHAR), 12, '0')) FROM benchmark)"""
ORACLES["union_batches"] = _with(ARTICLES, BATCHES) + "SELECT * FROM batches"
ORACLES["dedupe_articles"] = _with(ARTICLES, BATCHES) + """
SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY landed) AS nth FROM batches) WHERE nth = 1"""

# --- scalar functions -----------------------------------------------------------------------

ORACLES["article_ids"] = _with(ARTICLES) + "SELECT doc_id, article_id FROM articles"
ORACLES["lexicon_scores"] = f"""
SELECT doc_id, {_score('text', fixed.POSITIVE_WORDS)} AS positive_score,
       {_score('text', fixed.NEGATIVE_WORDS)} AS negative_score FROM documents"""
ORACLES["sentiment_recalculated"] = _with(ARTICLES, SCORED) + f"""
SELECT doc_id, recalculated_sentiment, {_label('content')} AS content_sentiment FROM scored"""
ORACLES["text_builders"] = _with(ARTICLES) + f"""
SELECT doc_id, {_INDEX} AS index_text, concat(title, ' ', description) AS sentiment_text,
       {_FULL} AS full_text,
       concat(title, ' ', coalesce(category, ''), ' ', description) AS with_missing FROM articles"""
ORACLES["strip_html"] = f"""
SELECT page_id, regexp_replace(html, '{fixed.HTML_TAG}', ' ', 'g') AS stripped FROM pages"""
ORACLES["strip_urls"] = f"""
SELECT page_id, regexp_replace(html, '{fixed.URL}', '', 'g') AS stripped,
       regexp_replace(url, '{fixed.URL}', '', 'g') AS url FROM pages"""
ORACLES["normalised_text"] = f"""
SELECT page_id, {_normalise('html')} AS normalised, {_normalise('html')} AS normalised_text FROM pages"""
ORACLES["keywords_roundtrip"] = _with(ARTICLES) + """
SELECT doc_id, CAST(to_json(coalesce(keywords, [])) AS VARCHAR) AS keywords_json,
       coalesce(array_to_string(keywords, '|'), '') AS keywords, len(coalesce(keywords, [])) AS n FROM articles"""
ORACLES["zero_vector_relevance"] = _with(TOPICS) + """
SELECT d.doc_id, CASE WHEN v.vec_id IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0,
         list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.embedding)), 4) END AS relevance
FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN topics q ON q.query_id = v.label"""

# --- chunks ---------------------------------------------------------------------------------

# A sum that tells vectors and the order of their components apart.
_DIGEST = "round(list_inner_product(CAST({0} AS DOUBLE[]), CAST(range(1, len({0}) + 1) AS DOUBLE[])), 4)"
_CHUNK_ID = "concat(key, '_chunk_', chunk_index) AS chunk_id"
ORACLES["chunk_articles"] = CHUNKED + f"""
SELECT {_CHUNK_ID}, key AS article_id, chunk_index, document FROM chunks"""
ORACLES["chunk_metadata"] = CHUNKED + f"""
SELECT {_CHUNK_ID}, key AS article_id, chunk_index, document, title, {_META_ALL}
FROM chunks c JOIN articles a ON CAST(a.doc_id AS VARCHAR) = c.key"""
ORACLES["attach_vectors"] = CHUNKED + f"""
SELECT {_CHUNK_ID}, document, {_DIGEST.format("embedding")} AS vector
FROM chunks JOIN embeddings v ON key = CAST(vec_id // 5 AS VARCHAR) AND chunk_index = vec_id % 5"""
# The weights are fitted, but every text with a word has a vector of length 1.
ORACLES["vectorise_chunks"] = CHUNKED + f"""
SELECT {_CHUNK_ID}, 256 AS dim,
       CASE WHEN regexp_matches(document, '[\\p{{L}}\\p{{N}}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM chunks"""
ORACLES["index_articles"] = CHUNKED + f"""
SELECT {_CHUNK_ID}, document, {_META_ALL}, coalesce({_DIGEST.format("v.embedding")}, 0.0::DOUBLE) AS vector
FROM chunks c JOIN articles a ON CAST(a.doc_id AS VARCHAR) = c.key
LEFT JOIN embeddings v ON key = CAST(vec_id // 5 AS VARCHAR) AND chunk_index = vec_id % 5"""

# --- search ---------------------------------------------------------------------------------

ORACLES["knn_topk"] = _with(ARTICLES, TOPICS, GIVEN, _hits(10)) + """
SELECT query_id, chunk_id, rank, relevance FROM hits"""
ORACLES["knn_topk_category"] = _with(
    ARTICLES, TOPICS, GIVEN, _hits(10, "c.category = CAST(q.query_id AS VARCHAR)")
) + "SELECT query_id, chunk_id, rank, relevance FROM hits"
ORACLES["knn_topk_dates"] = _with(*_STORED, _hits(10, """
  try_cast(c.published_at AS TIMESTAMP) >= TIMESTAMP '2024-01-01' + to_days(CAST(q.query_id AS INTEGER))
  AND (q.query_id = 3 OR try_cast(c.published_at AS TIMESTAMP)
    <= TIMESTAMP '2024-01-08' + to_days(CAST(q.query_id AS INTEGER)))"""), recursive=True) + """
SELECT query_id, chunk_id, rank, relevance FROM hits"""
ORACLES["knn_topk_batch"] = """WITH store AS (
  SELECT vec_id, concat(vec_id // 5, '_chunk_', vec_id % 5) AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT query_id, chunk_id, rank, round(greatest(0, cosine), 4) AS relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.chunk_id, round(list_cosine_similarity(q.e, c.e), 12) AS cosine
    FROM store q, store c)) WHERE rank <= 3"""
ORACLES["search_text"] = CHUNKED + f""", longer AS (
  SELECT c.*, row_number() OVER (PARTITION BY coalesce(nullif(a.source_name, ''), 'unknown')
    ORDER BY CAST(c.key AS BIGINT), c.chunk_index) AS nth
  FROM chunks c JOIN articles a ON CAST(a.doc_id AS VARCHAR) = c.key WHERE length(c.document) >= 400)
SELECT CAST(key AS BIGINT) AS query_id, 1.0::DOUBLE AS relevance_score,
  md5(trim(array_to_string(list_sort(regexp_split_to_array(lower(document), '[^\\p{{L}}\\p{{N}}]+')), ' '))) AS words
FROM longer WHERE nth = 1"""
ORACLES["search_articles"] = SEARCH + """
SELECT query_id, article_id, chunk_id, relevance AS relevance_score,
       substr(document, 1, 300) AS matched_snippet, total FROM found"""
ORACLES["search_enriched"] = SEARCH + """
SELECT f.query_id, f.article_id, coalesce(a.title, f.title) AS title,
       coalesce(a.source_name, f.source) AS source_name,
       CASE WHEN a.doc_id IS NULL THEN f.category ELSE a.category END AS category,
       coalesce(a.published_at, f.published_at) AS published_at,
       CASE WHEN a.doc_id IS NULL THEN f.url ELSE a.url END AS url,
       a.sentiment, a.doc_id IS NOT NULL AS is_stored, a.description, a.content, a.country, a.language,
       array_to_string(a.keywords, '|') AS keywords
FROM found f LEFT JOIN articles a ON a.is_reviewed AND CAST(a.doc_id AS VARCHAR) = f.article_id"""
ORACLES["search_percent"] = SEARCH + """
SELECT query_id, article_id, CAST(floor(relevance * 100 + 0.5) AS BIGINT) AS match_pct FROM found"""
ORACLES["retrieve_context"] = CONTEXT + """
SELECT query_id, article_id, chunk_id, relevance, source_no FROM context"""
ORACLES["format_context"] = CONTEXT + "SELECT query_id, context FROM contexts"
ORACLES["citations"] = CONTEXT + """
SELECT query_id, source_no, title, source, url, relevance,
       CASE WHEN length(document) > 200 THEN concat(substr(document, 1, 200), '...') ELSE document END AS snippet
FROM context"""
ORACLES["citation_lists"] = CONTEXT + """
SELECT query_id, count(*) AS n,
  string_agg(concat_ws('|', source_no, title, source, url, relevance, CASE WHEN length(document) > 200
    THEN concat(substr(document, 1, 200), '...') ELSE document END), ' || ' ORDER BY source_no) AS cited
FROM context GROUP BY query_id"""
_PROMPT = fixed.PROMPT.replace("'", "''").replace("%s", "{context}", 1).replace("%s", "{question}", 1)
_PROMPT_OF = f"replace(replace('{_PROMPT}', '{{question}}', c.query), '{{context}}', c.context) AS prompt"
ORACLES["prompts"] = CONTEXT + f"SELECT query_id, {_PROMPT_OF} FROM contexts c"
ORACLES["chat"] = CONTEXT + f""", sources AS (
  SELECT query_id, string_agg(concat_ws('|', source_no, title, url, relevance), ';' ORDER BY source_no) AS sources
  FROM context GROUP BY query_id)
SELECT c.query_id, c.query, {_PROMPT_OF}, s.sources FROM contexts c LEFT JOIN sources s ON s.query_id = c.query_id"""

# --- reports --------------------------------------------------------------------------------


def _overview(present: str, trend: str, order: str, days: int, lengths: bool) -> str:
    parts = [
        "SELECT 'total_articles' AS section, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM articles",
        f"SELECT 'categories', category, count(*) FROM articles WHERE {present.format('category')} GROUP BY category",
        """SELECT 'sentiment_distribution', s, count(a.doc_id)
FROM (VALUES ('positive'), ('negative'), ('neutral')) v(s) LEFT JOIN articles a ON a.sentiment = s GROUP BY s""",
        f"""SELECT * FROM (SELECT 'top_sources', source_name, count(*) AS n FROM articles
WHERE {present.format('source_name')} GROUP BY source_name ORDER BY n DESC, source_name LIMIT 10)""",
        f"SELECT * FROM (SELECT '{trend}', date, count FROM days ORDER BY date {order} LIMIT {days})",
    ]
    if lengths:
        parts.append("""SELECT 'avg_content_length', category, round(avg(length(content)), 1) FROM articles
WHERE content <> '' AND category <> '' GROUP BY category""")
    return _with(ARTICLES, DAYS) + "\nUNION ALL\n".join(parts)


ORACLES["analytics_report"] = _overview("{} <> ''", "daily_trend", "ASC", 30, True)
ORACLES["overview_report"] = _overview("{} IS NOT NULL", "recent_trend", "DESC", 14, False)
ORACLES["empty_corpus_report"] = _with(ARTICLES) + """
SELECT 'total_articles' AS section, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM articles
WHERE category = 'crime'
UNION ALL
SELECT 'sentiment_distribution', s, count(a.doc_id) FROM (VALUES ('positive'), ('negative'), ('neutral')) v(s)
LEFT JOIN articles a ON a.sentiment = s AND a.category = 'crime' GROUP BY s"""
ORACLES["sentiment_report"] = _with(ARTICLES, SCORED) + f"""
SELECT 'total_processed' AS section, '' AS key, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail
FROM scored
UNION ALL SELECT 'mismatch_count', '', count(*), NULL FROM scored WHERE {_DISAGREES}
UNION ALL SELECT 'mismatch_rate_pct', '', round(100 * (count(*) FILTER ({_DISAGREES}) / count(*)), 2), NULL FROM scored
UNION ALL SELECT 'sentiment_distribution', recalculated_sentiment, count(*), NULL FROM scored GROUP BY 2
UNION ALL SELECT 'category_sentiment', concat(category, '/', recalculated_sentiment), count(*), NULL
FROM scored WHERE category <> '' GROUP BY 2
UNION ALL SELECT 'mismatch_sample', article_id, NULL, concat(sentiment, ' -> ', recalculated_sentiment) FROM (
  SELECT * FROM scored WHERE {_DISAGREES} ORDER BY article_id, title, sentiment LIMIT 10)"""
ORACLES["report_json"] = ORACLES["sentiment_report"]
ORACLES["preprocessing_report"] = _with(ARTICLES, NORMALISED, ESTIMATED, WORDS) + """
SELECT 'total_processed' AS section, '' AS key, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail
FROM articles
UNION ALL SELECT 'avg_chunks_per_article', '', round(avg(est), 2), NULL FROM estimated
UNION ALL SELECT 'max_chunks', '', max(est), NULL FROM estimated
UNION ALL SELECT 'min_chunks', '', min(est), NULL FROM estimated
UNION ALL SELECT 'total_chunks', '', sum(est), NULL FROM estimated
UNION ALL SELECT * FROM (SELECT 'top_keywords', word, freq, NULL FROM words ORDER BY freq DESC, word LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'sample_output', article_id, length(n), substr(n, 1, 300)
  FROM normalised ORDER BY article_id, content LIMIT 5)"""

# --- streaming ------------------------------------------------------------------------------

ORACLES["stream_ingest"] = _with(ARTICLES, PARSED, _loads("parsed", "fetch_id, position")) + f"""
SELECT {_SHORT}, published_at, url FROM stored"""
ORACLES["stream_index"] = _with(
    ARTICLES, PARSED, _loads("parsed", "fetch_id, position"),
    f"texts AS (SELECT article_id AS key, {_INDEX} AS t FROM stored)", _chunks("texts"),
    recursive=True,
) + f"""
SELECT {_CHUNK_ID}, key AS article_id, document, title, {_META.format(a="a")},
  CASE WHEN regexp_matches(document, '[\\p{{L}}\\p{{N}}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM chunks c JOIN stored a ON a.article_id = c.key"""

ORACLES["ingest_rejects"] = """
SELECT d.doc_id AS fetch_id, 'error' AS reason
FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1
"""

# The reviewed documents land twice, their rejected answers once more with the rest.
ORACLES["stream_rejects"] = """
SELECT doc_id AS fetch_id, 'error' AS reason, CAST(2 AS BIGINT) AS landings FROM labels WHERE toxic = 1
"""
