"""Keyword sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import text


def with_lexicon_scores(rows: DataFrame, of: Column) -> DataFrame:
    """Add `positive_score` and `negative_score` of the text `of`, lowered once per row."""
    return (
        rows.withColumn("_lowered", F.lower(of))
        .withColumn("positive_score", text.lexicon_score("_lowered", fixed.POSITIVE_WORDS))
        .withColumn("negative_score", text.lexicon_score("_lowered", fixed.NEGATIVE_WORDS))
        .drop("_lowered")
    )


def with_sentiment(
    rows: DataFrame, of: Column | None = None, into: str = "recalculated_sentiment"
) -> DataFrame:
    """Add the keyword sentiment of a text, by default of title and description."""
    scored = with_lexicon_scores(rows, text.sentiment_text() if of is None else of)
    return (
        scored.withColumn(into, text.sentiment_of("positive_score", "negative_score"))
        .drop("positive_score", "negative_score")
    )


def mismatches(articles: DataFrame) -> DataFrame:
    """Articles whose stored label differs from the recalculated one."""
    return with_sentiment(articles).filter(is_mismatch())


def is_mismatch() -> Column:
    stored = F.col("sentiment")
    return text.nonempty(stored) & (stored != F.col("recalculated_sentiment"))


def mismatch_sample(articles: DataFrame, n: int = fixed.MISMATCH_SAMPLE) -> DataFrame:
    """The first `n` disagreeing articles by id."""
    return (
        mismatches(articles)
        .select("article_id", "title", "sentiment", "recalculated_sentiment")
        .orderBy("article_id", "title", "sentiment")
        .limit(n)
    )


def recalculated_distribution(articles: DataFrame) -> DataFrame:
    return (
        with_sentiment(articles).groupBy("recalculated_sentiment")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "recalculated_sentiment")
    )


def mismatch_rate(articles: DataFrame) -> DataFrame:
    """Number and percentage of disagreeing articles; one row also for an empty corpus."""
    wrong = F.count_if(is_mismatch())
    total = F.count(F.lit(1))
    share = F.coalesce(F.try_divide(wrong, total), F.lit(0.0))
    return with_sentiment(articles).agg(
        total.alias("total_processed"),
        wrong.alias("mismatch_count"),
        F.round(share * 100, 2).alias("mismatch_rate_pct"),
    )


def category_sentiment(articles: DataFrame) -> DataFrame:
    """Articles per category and recalculated label."""
    return (
        with_sentiment(articles.filter(text.nonempty("category")))
        .groupBy("category", "recalculated_sentiment")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("category", F.desc("count"), "recalculated_sentiment")
    )


def category_sentiment_map(articles: DataFrame) -> DataFrame:
    """Per category a map from label to number; a map has at most the three labels."""
    entry = F.struct("recalculated_sentiment", "count")
    return (
        category_sentiment(articles).groupBy("category")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sentiments"))
        .orderBy("category")
    )


def category_sentiment_pivot(articles: DataFrame) -> DataFrame:
    """Per category one column per label."""
    label = F.col("recalculated_sentiment")
    return (
        with_sentiment(articles.filter(text.nonempty("category")))
        .groupBy("category")
        .agg(*[F.count_if(label == s).alias(s) for s in fixed.SENTIMENT_LABELS])
        .orderBy("category")
    )
