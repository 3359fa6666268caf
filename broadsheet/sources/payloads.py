"""Landed answers of the news service turned into article rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import fixed_values as fixed
from broadsheet import schemas
from broadsheet.functions import text
from broadsheet.operators.sentiment import with_sentiment

# Orders landed articles: fetch by fetch, and inside a fetch as delivered.
LANDED = "landed"

# Holds a line that is no answer, as it landed.
DAMAGED = "_damaged"
LANDED_SCHEMA = T.StructType([*schemas.PAYLOAD.fields, T.StructField(DAMAGED, T.StringType())])
READ_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED}


def read_payloads(
    spark: SparkSession, path: str | list[str], categories: Sequence[str] | None = None
) -> DataFrame:
    """Landed answers, one JSON document per line.

    A line that is no JSON is kept in DAMAGED and found by `rejected_answers`. A file that cannot
    be read to its end fails the read, so a load is tried again instead of losing the rest.

    `categories` keeps the answers to requests for those, e.g. `fixed.FETCHED_CATEGORIES`. Where
    they land in folders `requested_category=...`, the other folders are not read.
    """
    landed = spark.read.schema(LANDED_SCHEMA).options(**READ_OPTIONS).json(path)
    if categories is None:
        return landed
    return landed.filter(F.col("requested_category").isin(*categories))


def is_rejected() -> Column:
    """Whether an answer gives no articles: a damaged line, or an error."""
    return F.col(DAMAGED).isNotNull() | F.coalesce(F.col("status") != "success", F.lit(True))


def delivered() -> Column:
    """How many articles an answer gives."""
    titled = F.filter("results", lambda item: text.nonempty(item.title))
    return F.when(is_rejected(), 0).otherwise(F.coalesce(F.size(titled), F.lit(0)))


def rejected_answers(payloads: DataFrame) -> DataFrame:
    """(fetch_id, reason, record) of what gives no articles: damaged lines and error answers."""
    damaged = F.col(DAMAGED).isNotNull()
    return payloads.filter(is_rejected()).select(
        "fetch_id",
        F.when(damaged, "damaged").otherwise(F.coalesce("status", F.lit("no status"))).alias("reason"),
        F.col(DAMAGED).alias("record"),
    )


def parse_payloads(
    payloads: DataFrame,
    country: str = fixed.DEFAULT_COUNTRY,
    language: str = fixed.DEFAULT_LANGUAGE,
    category: str | Column | None = None,
) -> DataFrame:
    """Articles of the successful answers, with their landing order in `landed`.

    `category` stands in where an article has none; by default it is the one that was asked for.
    Country and language are those of the request; `country` and `language` stand in where it
    names none.
    """
    requested = F.col("requested_category") if category is None else category
    if isinstance(requested, str):
        requested = F.lit(requested)
    item = F.col("item")
    delivered = payloads.filter(F.col("status") == "success").select(
        "fetch_id", requested.alias("requested"),
        F.coalesce("requested_country", F.lit(country)).alias("country"),
        F.coalesce("requested_language", F.lit(language)).alias("language"),
        F.posexplode("results").alias("position", "item"),
    )
    described = (
        delivered.filter(text.nonempty(item.title))
        .withColumn("source_name", F.coalesce(item.source_name, item.source_id, F.lit(fixed.DEFAULT_SOURCE)))
        .withColumn("description", text.or_default(item.description, ""))
    )
    scored = with_sentiment(
        described, text.sentiment_text(item.title, "description"), into="sentiment"
    )
    return scored.select(
        text.article_id(item.title, "source_name").alias("article_id"),
        item.title.alias("title"),
        "description",
        F.coalesce(F.nullif(item.content, F.lit("")), F.col("description")).alias("content"),
        "source_name",
        item.source_url.alias("source_url"),
        text.first_category(item.category, F.col("requested")).alias("category"),
        "country",
        "language",
        item.pubDate.alias("published_at"),
        item.link.alias("url"),
        item.image_url.alias("image_url"),
        "sentiment",
        F.coalesce(item.keywords, F.array().cast("array<string>")).alias("keywords"),
        F.struct("fetch_id", "position").alias(LANDED),
    )


def union_batches(*batches: DataFrame) -> DataFrame:
    """All rows of several fetches; columns that one of them lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
