"""Rows of stored tables by the ids of their articles, without reading the rest."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.session import broadcast_if_few, settle

BUCKET_DIGITS = 1  # hexadecimal digits of an id's hash that name its bucket
FEW_IDS = 1000  # up to so many ids are put into the filter of the scan


def bucket_of(article_id: str) -> Column:
    return F.substring(F.md5(article_id), 1, BUCKET_DIGITS)


def article_of(chunk_id: str) -> Column:
    """The id of a chunk's article."""
    return F.regexp_replace(chunk_id, r"_chunk_\d+$", "")


def of_articles(table: DataFrame, ids: DataFrame, settled: bool = False) -> DataFrame:
    """Rows of a stored table whose article_id is among `ids`, read from these ids' buckets.

    Few ids become part of the scan's filter, which skips row groups by their bounds and Bloom
    filters; more are broadcast, and very many are met in a shuffle. What the driver gets are the
    buckets, of which there is a fixed number, and few ids. A table without buckets is only joined.
    `settled` says that the ids are distinct and were computed before.
    """
    ids = ids.select("article_id").filter(F.col("article_id").isNotNull())
    ids = ids if settled else settle(ids.distinct())
    if "bucket" not in table.columns:
        return table.join(broadcast_if_few(ids), "article_id", "left_semi")
    few = [r[0] for r in ids.limit(FEW_IDS + 1).collect()]
    if len(few) <= FEW_IDS:
        buckets = sorted({hashlib.md5(i.encode()).hexdigest()[:BUCKET_DIGITS] for i in few})
        return table.filter(F.col("bucket").isin(*buckets) & F.col("article_id").isin(*few))
    buckets = [r[0] for r in ids.select(bucket_of("article_id")).distinct().collect()]
    rows = table.filter(F.col("bucket").isin(*sorted(buckets)))
    return rows.join(broadcast_if_few(ids), "article_id", "left_semi")
