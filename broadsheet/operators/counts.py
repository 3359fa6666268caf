"""Counts and averages over the articles table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import text
from broadsheet.operators.normalised import with_normalised


def total(rows: DataFrame, name: str = "total_articles") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias(name))


def _present(column: str, keep_empty: bool) -> Column:
    return F.col(column).isNotNull() if keep_empty else text.nonempty(column)


def by_category(articles: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Articles per category, most first; `keep_empty` counts '' as a category of its own."""
    return (
        articles.filter(_present("category", keep_empty))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "category")
    )


def sentiment_distribution(articles: DataFrame) -> DataFrame:
    """Articles per stored label: the three known labels, 0 where there are none."""
    labels = F.array(*[
        F.struct(F.lit(s).alias("sentiment"), F.count_if(F.col("sentiment") == s).alias("count"))
        for s in fixed.SENTIMENT_LABELS
    ])
    return articles.agg(labels.alias("labels")).select(F.inline("labels"))


def top_sources(articles: DataFrame, n: int = 10, keep_empty: bool = False) -> DataFrame:
    """The `n` sources with most articles."""
    return (
        articles.filter(_present("source_name", keep_empty))
        .groupBy(F.col("source_name").alias("source"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "source")
        .limit(n)
    )


def daily_counts(articles: DataFrame) -> DataFrame:
    return (
        articles.filter(F.col("created_at").isNotNull())
        .groupBy(text.day("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def daily_trend_earliest(articles: DataFrame, n: int = 30) -> DataFrame:
    """Articles per day, for the first `n` days that have any."""
    return daily_counts(articles).orderBy("date").limit(n)


def daily_trend_latest(articles: DataFrame, n: int = 7) -> DataFrame:
    """Articles per day, for the last `n` days that have any, latest first."""
    return daily_counts(articles).orderBy(F.desc("date")).limit(n)


def avg_content_length(articles: DataFrame) -> DataFrame:
    """Average length of the content per category, longest first."""
    return (
        articles.filter(text.nonempty("content") & text.nonempty("category"))
        .groupBy("category")
        .agg(F.round(F.avg(F.length("content")), 1).alias("avg_length"))
        .orderBy(F.desc("avg_length"), "category")
    )


def chunk_estimates(articles: DataFrame) -> DataFrame:
    """Per article the length of its normalised text and the estimated number of chunks."""
    return (
        with_normalised(articles, text.full_text())
        .withColumn("text_length", F.length("normalised_text"))
        .withColumn("estimated_chunks", text.chunk_estimate("text_length"))
        .drop("normalised_text")
    )


def chunk_estimate_stats(articles: DataFrame) -> DataFrame:
    n = F.col("estimated_chunks")
    return chunk_estimates(articles).agg(
        F.round(F.avg(n), 2).alias("avg_chunks_per_article"),
        F.max(n).alias("max_chunks"),
        F.min(n).alias("min_chunks"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_chunks"),
    )


def word_frequency(articles: DataFrame, n: int = 50) -> DataFrame:
    """The `n` most frequent words of the normalised texts."""
    words = with_normalised(articles, text.full_text()).select(
        # Outer: an inner explode would normalise a second time, to test for words.
        F.explode_outer(text.tokens("normalised_text")).alias("word")
    )
    return (
        words.filter(text.keep_token("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("freq"))
        .orderBy(F.desc("freq"), "word")
        .limit(n)
    )


def vector_count(chunks: DataFrame) -> DataFrame:
    return total(chunks, "vector_count")


def dashboard_summary(articles: DataFrame, sources: int = 10) -> DataFrame:
    """Articles, categories, sources (at most as many as are listed) and labelled articles."""
    known = F.col("sentiment").isin(*fixed.SENTIMENT_LABELS)
    # Distinct values are grouped first: each is one row, however many articles it has.
    facets = articles.select(F.explode(F.array(
        F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")),
        F.struct(F.lit("source").alias("facet"), F.col("source_name").alias("value")),
        F.struct(F.lit("article").alias("facet"), F.when(known, F.lit("labelled")).alias("value")),
    )).alias("f")).select("f.*").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))

    def distinct(facet: str) -> Column:
        return F.count_if((F.col("facet") == facet) & F.col("value").isNotNull())

    def articles_where(condition: Column) -> Column:
        rows = F.when((F.col("facet") == "article") & condition, F.col("n"))
        return F.coalesce(F.sum(rows), F.lit(0))

    return facets.agg(
        articles_where(F.lit(True)).alias("total_articles"),
        distinct("category").alias("categories"),
        F.least(distinct("source"), F.lit(sources)).alias("sources"),
        articles_where(F.col("value").isNotNull()).alias("sentiment_analyzed"),
    )
