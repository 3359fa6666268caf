"""From top-k chunks to articles. A query has at most 50 hits, so its group is always small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import text
from broadsheet.operators.lookup import article_of, of_articles

# Columns of an article that its chunks do not have; missing in hits whose article is not stored.
ARTICLE_ONLY = (
    "description", "content", "source_url", "country", "language", "image_url", "sentiment", "keywords",
)


def with_chunk_columns(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the stored columns of their chunk.

    The search itself reads vectors only; the texts are fetched here, for the hits alone. From a
    table with buckets these are looked up by their articles; `hits` is then read twice, so settle
    it before.
    """
    texts = chunks.drop("embedding")
    if "bucket" in chunks.columns:
        ids = hits.select(article_of("chunk_id").alias("article_id"))
        texts = of_articles(texts, ids).drop("bucket", "load_id")
    return hits.join(texts, "chunk_id")


def first_hit(hits: DataFrame) -> DataFrame:
    """The first hit of every article, per query."""
    order = Window.partitionBy("query_id", "article_id").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def best_chunk(hits: DataFrame) -> DataFrame:
    """The most relevant chunk of every article, per query; among equals the first."""
    order = Window.partitionBy("query_id", "article_id").orderBy(F.desc("relevance"), "rank")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def numbered(hits: DataFrame, into: str = "source_no") -> DataFrame:
    """Number the hits of a query from 1, most relevant first."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")
    return hits.withColumn(into, F.row_number().over(order))


def enrich_hits(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Hits with the columns of their article; the chunk's own columns where it is not stored.

    The articles are first cut down to those of the hits: an outer join alone would shuffle the
    whole table. `hits` is read twice, so settle it before.
    """
    a = of_articles(articles, hits).alias("a")
    h = hits.alias("h")
    joined = h.join(a, F.col("h.article_id") == F.col("a.article_id"), "left")
    stored = F.col("a.article_id").isNotNull()

    def either(article_column: str, chunk_column: str):
        return F.when(stored, F.col(f"a.{article_column}")).otherwise(F.col(f"h.{chunk_column}"))

    return joined.select(
        "h.query_id",
        "h.rank",
        "h.chunk_id",
        "h.article_id",
        either("title", "title").alias("title"),
        either("source_name", "source").alias("source_name"),
        either("category", "category").alias("category"),
        either("published_at", "published_at").alias("published_at"),
        either("url", "url").alias("url"),
        *[F.col(f"a.{c}").alias(c) if c in articles.columns else F.lit(None).alias(c) for c in ARTICLE_ONLY],
        F.col("a.created_at").cast("string").alias("created_at"),
        stored.alias("is_stored"),
        F.col("h.relevance").alias("relevance_score"),
        text.search_snippet("h.document").alias("matched_snippet"),
    )
