"""Chart numbers derived from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import text
from broadsheet.session import settle


def _of_max(counts: DataFrame) -> Column:
    """Percent of the largest count; the maximum is one value, so no row has to move for it."""
    largest = counts.agg(F.max("count")).scalar()
    return text.percent(F.col("count") / F.greatest(largest, F.lit(1)))


def percent_of_max(counts: DataFrame) -> DataFrame:
    """Counts with their percentage of the largest one; they are computed once."""
    counts = settle(counts)
    return counts.withColumn("pct", _of_max(counts))


def trend_scale(daily: DataFrame) -> DataFrame:
    """Daily counts in time order with bar height (at least 8) and label; they are computed once."""
    daily = settle(daily)
    return (
        daily.withColumn("height_pct", F.greatest(_of_max(daily), F.lit(8).cast("long")))
        .withColumn("label", F.date_format("date", "MM/dd"))
        .orderBy("date")
    )


def sentiment_share(articles: DataFrame) -> DataFrame:
    """Stored labels as percentages; what rounding leaves goes to neutral."""
    counted = articles.agg(*[
        F.count_if(F.col("sentiment") == s).alias(s) for s in fixed.SENTIMENT_LABELS
    ])
    whole = F.greatest(F.col("positive") + F.col("negative") + F.col("neutral"), F.lit(1))
    return (
        counted.withColumn("pos_pct", text.percent(F.col("positive") / whole))
        .withColumn("neg_pct", text.percent(F.col("negative") / whole))
        .withColumn("neu_pct", 100 - F.col("pos_pct") - F.col("neg_pct"))
    )
