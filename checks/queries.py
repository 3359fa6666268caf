"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet import schemas
from broadsheet.functions import text, vectors
from broadsheet.operators import (
    ann,
    chunks,
    counts,
    dedupe,
    filters,
    ivf,
    knn,
    scales,
    sentiment,
    text_model,
)
from broadsheet.operators.normalised import with_normalised
from broadsheet.plans import indexing, reports, search
from broadsheet.session import broadcast_if_few, fresh_path, settle
from broadsheet.sources import articles as article_files
from broadsheet.sources import payloads as landed
from broadsheet.sources import reports as report_files
from broadsheet.sources import store as stores
from broadsheet.sources import tables
from broadsheet.streaming import ingest
from checks import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

IVF_CELLS, IVF_PROBES = 16, 6

_SHORT = ("article_id", "title", "content", "source_name", "category", "sentiment")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _digest(vector: str):
    """A sum that tells vectors and the order of their components apart."""
    weighted = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda total, x: total + x), 4)


def _dated(daily: DataFrame) -> DataFrame:
    return daily.withColumn("date", F.col("date").cast("string"))


# --- sources and sinks ----------------------------------------------------------------------

@query
def scan_articles(spark, sf):
    rows = fx.full_articles(spark, sf)
    return article_files.register(rows).sparkSession.sql(
        "SELECT doc_id, article_id, title, description, content, source_name, category, country,"
        " language, published_at, url, sentiment FROM articles"
    )


def _csv(spark, sf):
    rows = fx.full_articles(spark, sf, heavy=True).select(*schemas.ARTICLE.fieldNames())
    path = fresh_path(spark, "articles-csv")
    article_files.write_articles_csv(rows, path)
    return article_files.read_articles_csv(spark, path)


@query
def scan_csv(spark, sf):
    return counts.by_category(_csv(spark, sf), keep_empty=True)


@query
def csv_roundtrip(spark, sf):
    return _csv(spark, sf).select(*_SHORT, "description", "published_at", "keywords")


@query
def ingest_rejects(spark, sf):
    folder = fx.land(fx.payloads(spark, sf))
    return landed.rejected_answers(landed.read_payloads(spark, folder)).select("fetch_id", "reason")


@query
def ingest_payload(spark, sf):
    folder = fx.land(fx.payloads(spark, sf))
    parsed = landed.parse_payloads(landed.read_payloads(spark, folder))
    return parsed.select(
        F.col("landed.fetch_id").alias("fetch_id"),
        F.col("landed.position").cast("long").alias("position"),
        "article_id", "title", "description", "content", "source_name", "category", "country",
        "language", "published_at", "url", "sentiment",
        text.keywords_json("keywords").alias("keywords"),
    )


@query
def fetch_categories(spark, sf):
    """Answers landed per requested category: those usually fetched, duplicates removed."""
    delivered = F.get(F.col("results")[0]["category"], 0)
    asked = F.coalesce(F.nullif(delivered, F.lit("")), F.lit("top"))
    answers = fx.payloads(spark, sf).withColumn("requested_category", asked)
    folder = fx.land(answers, None, "requested_category")
    fetched = landed.read_payloads(spark, folder, fixed.FETCHED_CATEGORIES)
    first = dedupe.dedupe_first(landed.parse_payloads(fetched), "article_id", "landed")
    return first.select("article_id", "title", "category", "content")


def _two_loads(spark, sf):
    path = fresh_path(spark, "articles")
    tables.create_articles(spark, path)
    tables.insert_new(fx.reviewed(spark, sf), path, "doc_id", "1-reviewed")
    tables.insert_new(fx.full_articles(spark, sf, heavy=True), path, "doc_id", "2-all")
    return path


@query
def insert_new_articles(spark, sf):
    path = _two_loads(spark, sf)
    return spark.read.schema(schemas.STORED_ARTICLE).parquet(path).select(*_SHORT, "load_id")


@query
def find_articles(spark, sf):
    """Articles of toxic documents by their ids, from a store whose loads were merged."""
    store = stores.create(spark, fresh_path(spark, "store"))
    for load, rows in (("1", fx.reviewed(spark, sf)), ("2", fx.full_articles(spark, sf, heavy=True))):
        tables.insert_new(rows, store.articles, "doc_id", load, stores.visible(spark, store))
        stores.commit(spark, store, load, load)
    stores.compact(spark, store)
    toxic = fx.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    ids = fx.articles(spark, sf).join(toxic, "doc_id", "left_semi")
    return stores.find_articles(spark, store, ids).select(*_SHORT)


def _zero_vectors(rows):
    return rows.withColumn("embedding", vectors.vector_or_zero(F.lit(None).cast("array<float>"), 8))


@query
def insert_new_chunks(spark, sf):
    path = fresh_path(spark, "chunks")
    tables.create_chunks(spark, path)
    for load in (fx.reviewed(spark, sf), fx.full_articles(spark, sf, heavy=True)):
        first = dedupe.dedupe_first(load, "article_id", "doc_id")
        new = indexing.chunks_of(first, _zero_vectors)
        tables.insert_new_chunks(new, path, first)
    stored = tables.read_chunks(spark, path)
    return stored.select("chunk_id", "article_id", "chunk_index", "document", "category", "source")


@query
def report_json(spark, sf):
    path = fresh_path(spark, "report")
    report = reports.sentiment_report(fx.articles(spark, sf, labels=True, heavy=True))
    report_files.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query
def empty_corpus_report(spark, sf):
    rows = filters.of_category(fx.articles(spark, sf, labels=True, times=True), "crime")
    return reports.analytics_report(rows).select("section", "key", "value")


# --- projections and filters ----------------------------------------------------------------

@query
def first_category(spark, sf):
    delivered = F.array_compact(F.array("category", "language"))
    return fx.articles(spark, sf).select(
        "doc_id", text.first_category(delivered, F.lit("top")).alias("category"),
        text.first_category(F.array_compact(F.array("category")), F.lit("top")).alias("only_category"),
    )


@query
def filter_nonempty(spark, sf):
    rows = fx.articles(spark, sf)
    return rows.filter(text.nonempty("category")).select("doc_id", "category")


@query
def filter_notnull(spark, sf):
    return fx.articles(spark, sf).filter(F.col("category").isNotNull()).select("doc_id", "category")


@query
def filter_category(spark, sf):
    return filters.of_category(fx.articles(spark, sf), "science").select("doc_id", "title", "category")


@query
def lookup_article(spark, sf):
    rows = fx.articles(spark, sf)
    last = rows.agg(F.max("article_id")).scalar()
    return filters.get_article(rows, last).select("doc_id", "article_id", "title", "source_name")


@query
def sentiment_mismatch_rows(spark, sf):
    return sentiment.mismatches(fx.articles(spark, sf, labels=True, heavy=True)).select(
        "doc_id", "sentiment", "recalculated_sentiment"
    )


@query
def article_projection(spark, sf):
    public = filters.to_public(fx.full_articles(spark, sf))
    return public.withColumn("keywords", F.to_json("keywords"))


@query
def filter_date_range(spark, sf):
    rows = fx.articles(spark, sf, times=True)
    return filters.published_between(rows, "2024-01-05", "2024-01-10 12:00:00").select(
        "doc_id", "published_at"
    )


@query
def normalised_preview(spark, sf):
    return filters.preview(fx.articles(spark, sf))


@query
def sentiment_mismatch_sample(spark, sf):
    return sentiment.mismatch_sample(fx.articles(spark, sf, labels=True, heavy=True))


# --- aggregations ---------------------------------------------------------------------------

@query
def total_articles(spark, sf):
    return counts.total(fx.articles(spark, sf))


@query
def category_counts(spark, sf):
    return counts.by_category(fx.articles(spark, sf))


@query
def category_counts_notnull(spark, sf):
    return counts.by_category(fx.articles(spark, sf), keep_empty=True)


@query
def sentiment_distribution(spark, sf):
    return counts.sentiment_distribution(fx.articles(spark, sf, labels=True))


@query
def top_sources(spark, sf):
    return counts.top_sources(fx.articles(spark, sf))


@query
def top_sources_notnull(spark, sf):
    return counts.top_sources(fx.articles(spark, sf), keep_empty=True)


@query
def daily_trend_earliest(spark, sf):
    return _dated(counts.daily_trend_earliest(fx.articles(spark, sf, times=True)))


@query
def daily_trend_latest(spark, sf):
    return _dated(counts.daily_trend_latest(fx.articles(spark, sf, times=True)))


@query
def avg_content_length(spark, sf):
    return counts.avg_content_length(fx.articles(spark, sf))


@query
def chunk_estimates(spark, sf):
    return counts.chunk_estimates(fx.articles(spark, sf, heavy=True)).select(
        "doc_id", F.col("text_length").cast("long").alias("text_length"), "estimated_chunks"
    )


@query
def chunk_estimate_stats(spark, sf):
    return counts.chunk_estimate_stats(fx.articles(spark, sf, heavy=True))


@query
def word_frequency(spark, sf):
    return counts.word_frequency(fx.articles(spark, sf, heavy=True))


@query
def sentiment_recalc_distribution(spark, sf):
    return sentiment.recalculated_distribution(fx.articles(spark, sf, heavy=True))


@query
def sentiment_mismatch_rate(spark, sf):
    return sentiment.mismatch_rate(fx.articles(spark, sf, labels=True, heavy=True))


@query
def category_sentiment(spark, sf):
    return sentiment.category_sentiment(fx.articles(spark, sf, heavy=True))


@query
def category_sentiment_pivot(spark, sf):
    """The nested map per category and the same numbers as columns, side by side."""
    rows = fx.articles(spark, sf, heavy=True)
    nested = sentiment.category_sentiment_map(rows).select(
        "category", F.to_json("sentiments").alias("sentiments")
    )
    return nested.join(sentiment.category_sentiment_pivot(rows), "category")


@query
def ingest_counts(spark, sf):
    """Counters of a load that meets an earlier one: articles fetched, inserted, indexed."""
    store = stores.create(spark, fresh_path(spark, "store"))
    for load, only_reviewed in (("1-reviewed", True), ("2-all", False)):
        folder = fx.land(fx.payloads(spark, sf, only_reviewed))
        ingest.load_batch(landed.read_payloads(spark, folder), store, load)
    return ingest.ingest_counts(spark, store, "2-all")


@query
def vector_count(spark, sf):
    return counts.vector_count(fx.vector_store(spark, sf))


@query
def dashboard_summary(spark, sf):
    return counts.dashboard_summary(fx.articles(spark, sf, labels=True))


# --- chart scales and pages -----------------------------------------------------------------

@query
def category_percent_of_max(spark, sf):
    return scales.percent_of_max(counts.by_category(fx.articles(spark, sf)))


@query
def trend_percent_of_max(spark, sf):
    daily = counts.daily_trend_latest(fx.articles(spark, sf, times=True), 14)
    return _dated(scales.trend_scale(daily))


@query
def sentiment_share(spark, sf):
    return scales.sentiment_share(fx.articles(spark, sf, labels=True))


@query
def list_articles(spark, sf):
    page = filters.list_articles(fx.articles(spark, sf, times=True), limit=20, offset=40)
    return page.select("article_id", "title", "category", "published_at")


@query
def list_articles_after(spark, sf):
    """The third page, by the last row of the second, which is named by that of the first."""
    rows, token = fx.articles(spark, sf, times=True), None
    for _ in range(2):
        token = filters.PageToken.of(filters.list_articles(rows, 20, after=token))
    page = filters.list_articles(rows, 20, after=token)
    return page.select("article_id", "title", "category", "published_at")


@query
def list_articles_category(spark, sf):
    rows = fx.articles(spark, sf, times=True)
    return filters.list_articles(rows, category="health").select("article_id", "title", "published_at")


# --- unions and duplicates ------------------------------------------------------------------

def _batches(spark, sf):
    documents = fx.articles(spark, sf).select(
        "article_id", "title", "content", "category", F.concat(F.lit("1-"), F.lpad("doc_id", 12, "0")).alias("landed")
    )
    feeds = []
    for feed, name, key in (("2-", "conversations", ("conv_id", "turn")), ("3-", "benchmark", ("item_id",))):
        rows = fx.table(spark, sf, name)
        feeds.append(rows.select(
            text.article_id(F.split_part("text", F.lit("."), F.lit(1)), F.lit(name)).alias("article_id"),
            F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
            F.col("text").alias("content"),
            F.concat(F.lit(feed), *[F.lpad(k, 12, "0") for k in key]).alias("landed"),
        ))
    return landed.union_batches(documents, *feeds)


@query
def union_batches(spark, sf):
    return _batches(spark, sf)


@query
def dedupe_articles(spark, sf):
    return dedupe.dedupe_first(_batches(spark, sf), "article_id", "landed")


# --- scalar functions -----------------------------------------------------------------------

@query
def article_ids(spark, sf):
    return fx.articles(spark, sf).select("doc_id", "article_id")


@query
def lexicon_scores(spark, sf):
    return sentiment.with_lexicon_scores(fx.articles(spark, sf, heavy=True), F.col("content")).select(
        "doc_id", "positive_score", "negative_score"
    )


@query
def sentiment_recalculated(spark, sf):
    """By title and description, and by the whole content, where all labels occur."""
    rows = sentiment.with_sentiment(fx.articles(spark, sf, heavy=True))
    return sentiment.with_sentiment(rows, F.col("content"), into="content_sentiment").select(
        "doc_id", "recalculated_sentiment", "content_sentiment"
    )


@query
def text_builders(spark, sf):
    return fx.articles(spark, sf).select(
        "doc_id", text.index_text().alias("index_text"),
        text.sentiment_text().alias("sentiment_text"), text.full_text().alias("full_text"),
        text.full_text("title", "category", "description").alias("with_missing"),
    )


def _pages(spark, sf):
    return fx.spread(fx.table(spark, sf, "pages"), "page_id")


@query
def strip_html(spark, sf):
    return _pages(spark, sf).select("page_id", text.strip_html("html").alias("stripped"))


@query
def strip_urls(spark, sf):
    return _pages(spark, sf).select("page_id", text.strip_urls("html").alias("stripped"), text.strip_urls("url").alias("url"))


@query
def normalised_text(spark, sf):
    """By the column function and by the one for whole tables."""
    rows = with_normalised(_pages(spark, sf), F.col("html"))
    return rows.select("page_id", text.normalise("html").alias("normalised"), "normalised_text")


@query
def keywords_roundtrip(spark, sf):
    rows = fx.articles(spark, sf, labels=True)
    stored = rows.withColumn("keywords_json", text.keywords_json("keywords"))
    back = text.keywords_list("keywords_json")
    return stored.select("doc_id", "keywords_json", F.array_join(back, "|").alias("keywords"),
                         F.size(back).cast("long").alias("n"))


@query
def zero_vector_relevance(spark, sf):
    """Relevance of every document's vector to the mean of its label; without a vector it is 0."""
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"))
    mean = fx.topics(spark, sf).select(F.col("query_id").cast("int").alias("label"),
                                       F.col("embedding").alias("mean"))
    rows = docs.join(fx.table(spark, sf, "embeddings"), "vec_id", "left").join(mean, "label", "left")
    v = vectors.vector_or_zero("embedding", 64)
    q = F.coalesce("mean", F.array_repeat(F.lit(0.0), 64))
    return rows.select(
        F.col("vec_id").alias("doc_id"), vectors.relevance(vectors.cosine(v, q)).alias("relevance")
    )


# --- chunks ---------------------------------------------------------------------------------

@query
def chunk_articles(spark, sf):
    rows = fx.by_document(fx.articles(spark, sf, heavy=True))
    return chunks.chunk_articles(rows).select("chunk_id", "article_id", "chunk_index", "document")


@query
def chunk_metadata(spark, sf):
    rows = fx.by_document(fx.articles(spark, sf, times=True, urls=True, heavy=True))
    return chunks.chunk_metadata(chunks.chunk_articles(rows))


@query
def attach_vectors(spark, sf):
    rows = chunks.chunk_articles(fx.by_document(fx.articles(spark, sf, heavy=True)))
    joined = chunks.attach_vectors(rows, fx.given_vectors(spark, sf))
    return joined.select("chunk_id", "document", _digest("embedding").alias("vector"))


@query
def vectorise_chunks(spark, sf):
    rows = chunks.chunk_articles(fx.by_document(fx.articles(spark, sf, heavy=True)))
    unit = chunks.vectorise(rows.select("chunk_id", "article_id", "document"))
    return unit.select("chunk_id", F.size("embedding").alias("dim"),
                       F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


@query
def index_articles(spark, sf):
    path = fresh_path(spark, "chunks")
    tables.create_chunks(spark, path)
    given = fx.given_vectors(spark, sf)
    added = indexing.index_articles(
        fx.by_document(fx.articles(spark, sf, times=True, urls=True, heavy=True)), path,
        lambda rows: chunks.attach_vectors_or_zero(rows, given, 64),
    )
    return added.select("chunk_id", "document", "category", "source", "published_at", "url",
                        _digest("embedding").alias("vector"))


# --- search ---------------------------------------------------------------------------------

def _hit_columns(found):
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "relevance")


@query
def knn_topk(spark, sf):
    return _hit_columns(knn.knn_topk(fx.topics(spark, sf), fx.vector_store(spark, sf), 10))


@query
def knn_topk_category(spark, sf):
    queries = fx.topics(spark, sf, own_category=True)
    return _hit_columns(knn.knn_topk(queries, fx.vector_store(spark, sf), 10))


@query
def knn_topk_dates(spark, sf):
    """Every query with dates of its own, over the chunks of all documents."""
    day = F.col("query_id").cast("int")
    queries = fx.topics(spark, sf).select(
        "*", F.date_add(F.lit("2024-01-01"), day).cast("string").alias("date_from"),
        F.when(day != 3, F.date_add(F.lit("2024-01-08"), day).cast("string")).alias("date_to"),
    )
    return _hit_columns(knn.knn_topk(queries, fx.chunk_store(spark, sf), 10))


@query
def knn_topk_batch(spark, sf):
    """Every given vector as a query, in one scan of the store."""
    store = fx.vector_store(spark, sf)
    return _hit_columns(knn.knn_topk(store.select(F.col("vec_id").alias("query_id"), "embedding"), store, 3))


@query
def ivf_topk(spark, sf):
    """The chunks of all documents by the cells of their texts' vectors; queries are the first
    chunks of the documents whose id is divisible by 50."""
    store, path = fx.text_store(spark, sf), fresh_path(spark, "cells")
    cells = ivf.fit(store, IVF_CELLS)
    ivf.write(store.select("chunk_id", "embedding"), cells, path)
    queries = settle(store.filter("chunk_index = 0 AND article_id % 50 = 0").select(
        F.col("article_id").cast("long").alias("query_id"), "embedding"
    ))
    return _hit_columns(ivf.ivf_topk(queries, ivf.read(spark, path), cells, 10, IVF_PROBES))


@query
def ann_topk(spark, sf):
    return _hit_columns(ann.ann_topk(fx.topics(spark, sf), fx.vector_store(spark, sf), 10))


def _searched(spark, sf):
    known = fx.by_document(fx.reviewed(spark, sf))
    return search.search(fx.topics(spark, sf), fx.chunk_store(spark, sf), known)


@query
def search_articles(spark, sf):
    return _searched(spark, sf).select(
        "query_id", "article_id", "chunk_id", "relevance_score", "matched_snippet", "total"
    )


def _bag(document: str):
    """The words of a text in order of the alphabet: what its vector is made of."""
    found = F.filter(F.split(F.lower(document), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.md5(F.array_join(F.array_sort(found), " "))


@query
def search_text(spark, sf):
    """Texts as queries, in the space of an index over all documents: of every source the first
    longer chunk, which has to find itself, or its like, first."""
    path = fresh_path(spark, "chunks")
    tables.create_chunks(spark, path)
    rows = fx.kept(fx.by_document(fx.articles(spark, sf, times=True, urls=True, heavy=True)), "articles")
    fitted = text_model.fit(chunks.chunk_articles(rows).select("document"))
    kept = fresh_path(spark, "model")
    text_model.save(fitted, kept)
    model = text_model.load(kept)
    indexing.index_articles(rows, path, model)
    store = tables.stored(spark, path, schemas.STORED_CHUNK)
    first = F.struct(F.col("article_id").cast("long").alias("doc_id"), "chunk_index", "document")
    queries = store.filter(F.length("document") >= 400).groupBy("source").agg(F.min(first).alias("q")).select(
        F.col("q.doc_id").alias("query_id"), F.col("q.document").alias("query")
    )
    found = search.search_text(settle(queries), model, store, rows).filter("rank = 1")
    texts = store.select("chunk_id", "document")
    return broadcast_if_few(settle(found)).join(texts, "chunk_id").select(
        "query_id", "relevance_score", _bag("document").alias("words")
    )


@query
def search_enriched(spark, sf):
    return _searched(spark, sf).select(
        "query_id", "article_id", "title", "source_name", "category", "published_at", "url",
        "sentiment", "is_stored", "description", "content", "country", "language",
        F.array_join("keywords", "|").alias("keywords"),
    )


@query
def search_percent(spark, sf):
    return _searched(spark, sf).select(
        "query_id", "article_id", text.percent("relevance_score").alias("match_pct")
    )


def _context(spark, sf):
    return search.retrieve_context(fx.topics(spark, sf), fx.chunk_store(spark, sf))


@query
def retrieve_context(spark, sf):
    return _context(spark, sf).select(
        "query_id", "article_id", "chunk_id", "relevance", F.col("source_no").cast("long").alias("source_no")
    )


@query
def format_context(spark, sf):
    queries = fx.topics(spark, sf)
    return search.format_context(queries, _context(spark, sf)).select("query_id", "context")


@query
def citations(spark, sf):
    return search.citations(_context(spark, sf)).withColumn("source_no", F.col("source_no").cast("long"))


@query
def citation_lists(spark, sf):
    lists = search.citation_lists(_context(spark, sf))
    cited = F.transform("sources", lambda s: F.concat_ws(
        "|", s.source_no, s.title, s.source, s.url, s.relevance, s.snippet))
    return lists.select("query_id", F.array_join(cited, " || ").alias("cited"),
                        F.size("sources").cast("long").alias("n"))


@query
def prompts(spark, sf):
    queries = fx.topics(spark, sf)
    contexts = search.format_context(queries, _context(spark, sf))
    return search.prompts(contexts).select("query_id", "prompt")


@query
def chat(spark, sf):
    answers = search.chat(fx.topics(spark, sf), fx.chunk_store(spark, sf))
    cited = F.transform("sources", lambda s: F.concat_ws("|", s.source_no, s.title, s.url, s.relevance))
    return answers.select("query_id", "query", "prompt", F.array_join(cited, ";").alias("sources"))


# --- reports --------------------------------------------------------------------------------

@query
def analytics_report(spark, sf):
    rows = fx.articles(spark, sf, labels=True, times=True)
    return reports.analytics_report(rows).select("section", "key", "value")


@query
def overview_report(spark, sf):
    rows = fx.articles(spark, sf, labels=True, times=True)
    return reports.overview_report(rows).select("section", "key", "value")


@query
def sentiment_report(spark, sf):
    return reports.sentiment_report(fx.articles(spark, sf, labels=True, heavy=True))


@query
def preprocessing_report(spark, sf):
    return reports.preprocessing_report(fx.articles(spark, sf, heavy=True))


# --- streaming ------------------------------------------------------------------------------

def _streamed(spark, sf, vectoriser=None):
    """Two landings that overlap, each picked up by a run of the same stream."""
    landing, checkpoint = fresh_path(spark, "landing"), fresh_path(spark, "stream")
    store = stores.create(spark, fresh_path(spark, "store"))
    for only_reviewed in (True, False):
        fx.land(fx.payloads(spark, sf, only_reviewed), landing)
        ingest.ingest_stream(
            spark, landing, store.root, checkpoint, vectoriser, once=True
        ).awaitTermination()
    return store


@query
def stream_ingest(spark, sf):
    rows = stores.read_articles(spark, _streamed(spark, sf))
    return rows.select(*_SHORT, "published_at", "url")


@query
def stream_index(spark, sf):
    rows = stores.read_chunks(spark, _streamed(spark, sf, chunks.hashed_vectors))
    return rows.select(
        "chunk_id", "article_id", "document", "category", "source", "title",
        F.round(vectors.norm(F.col("embedding")), 4).alias("norm"),
    )


@query
def stream_rejects(spark, sf):
    """What the stream's loads kept of answers that gave no articles, per answer."""
    rejected = stores.read_rejects(spark, _streamed(spark, sf))
    return rejected.groupBy("fetch_id", "reason").agg(F.count(F.lit(1)).alias("landings"))
