"""Normalised texts of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text


def with_normalised(rows: DataFrame, of: Column, into: str = "normalised_text") -> DataFrame:
    """Add `text.normalise(of)`.

    A plain search for what a pattern must contain is much cheaper than the pattern, and most texts
    have no tags or addresses. The steps are separate projections, as each uses the one before
    several times.
    """

    def has(column: str, part: str) -> Column:
        return F.contains(F.col(column), F.lit(part))

    addressed = has("_untagged", "http") | has("_untagged", "www.")
    return (
        rows.withColumn("_raw", of)
        .withColumn("_untagged", F.when(has("_raw", "<"), text.strip_html("_raw")).otherwise(F.col("_raw")))
        .withColumn("_bare", F.when(addressed, text.strip_urls("_untagged")).otherwise(F.col("_untagged")))
        .withColumn(into, text.collapse_whitespace("_bare"))
        .drop("_raw", "_untagged", "_bare")
    )
