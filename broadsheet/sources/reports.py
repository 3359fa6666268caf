"""Writing reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(report: DataFrame) -> DataFrame:
    """Every report row as one JSON document."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("document"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.json(path)
