"""Approximate top-k search with random-projection hashing.

Chunks and queries that share a bucket in any hash table are candidates; all candidates are scored
exactly. How many neighbours are found depends on bucket length and number of tables, and so does
the share of the table that is scored. `knn_topk` is the default; this is for large, clustered
tables.
"""

from __future__ import annotations

from pyspark.ml.feature import (
    BucketedRandomProjectionLSH,
    BucketedRandomProjectionLSHModel,
    Normalizer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import vectors
from broadsheet.operators.knn import broadcast_topk, rank_hits, small_batch


def _with_unit(rows: DataFrame) -> DataFrame:
    """Add the vector at length 1; rows without a finite vector have no bucket and drop out."""
    finite = F.forall("embedding", lambda x: F.abs(x) < F.lit(float("inf")))
    raw = rows.filter(F.col("embedding").isNotNull() & finite).withColumn(
        "_raw", array_to_vector(F.col("embedding").cast("array<double>"))
    )
    return Normalizer(inputCol="_raw", outputCol="unit").transform(raw).drop("_raw")


def fit_buckets(
    chunks: DataFrame, bucket_length: float = 0.5, tables: int = 8, seed: int = 42
) -> BucketedRandomProjectionLSHModel:
    """The random projections; they depend on the dimension of the vectors only."""
    lsh = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="hashes", bucketLength=bucket_length,
        numHashTables=tables, seed=seed,
    )
    return lsh.fit(_with_unit(chunks.select("embedding")))


def with_buckets(rows: DataFrame, model: BucketedRandomProjectionLSHModel) -> DataFrame:
    """Add the list of a row's buckets, one per hash table; can be stored with a chunk table."""
    hashed = model.transform(_with_unit(rows))
    return hashed.select(
        *rows.columns,
        F.transform("hashes", lambda h: F.get(vector_to_array(h), 0)).alias("buckets"),
    )


def candidates(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every (query_id, chunk_id) that shares a bucket, once; both sides have `buckets`.

    The join on (table, bucket) carries no vectors. A pair that meets in several tables is kept in
    the first of them only, which the two lists of buckets tell by themselves; so no shuffle is
    needed to remove the others.
    """

    def per_table(rows: DataFrame, key: str) -> DataFrame:
        named = rows.select(key, F.col("buckets").alias(f"{key}_buckets"))
        return named.select("*", F.posexplode_outer(f"{key}_buckets").alias("table", "bucket"))

    earlier = F.exists(
        F.zip_with(
            F.slice("query_id_buckets", F.lit(1), F.col("table")),
            F.slice("chunk_id_buckets", F.lit(1), F.col("table")),
            lambda a, b: a == b,
        ),
        lambda same: same,
    )
    met = per_table(chunks, "chunk_id").join(per_table(queries, "query_id"), ["table", "bucket"])
    return met.filter(~earlier).select("query_id", "chunk_id")


def _scored(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """All candidates with their exact cosine."""
    left = _with_unit(queries).select("query_id", vector_to_array("unit").alias("q"))
    right = _with_unit(chunks).select("chunk_id", vector_to_array("unit").alias("v"))
    pairs = candidates(queries, chunks).join(left, "query_id").join(right, "chunk_id")
    similarity = F.round(vectors.dot(F.col("q"), F.col("v")), 12)
    return pairs.select("query_id", "chunk_id", similarity.alias("cosine"))


def ann_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    bucket_length: float = 0.5,
    tables: int = 8,
    seed: int = 42,
) -> DataFrame:
    """(query_id, chunk_id, rank, cosine, relevance) of the k best candidates per query.

    A batch of queries small enough is sent to the tasks with its buckets, and no pair becomes a
    row; a larger one meets the chunks in a join.
    """
    model = fit_buckets(chunks, bucket_length, tables, seed)
    asked = with_buckets(queries.select("query_id", "embedding"), model)
    store = with_buckets(chunks.select("chunk_id", "embedding"), model)
    anything = F.lit(None).cast("string").alias("category")
    batch = small_batch(asked.select(
        F.col("query_id").cast("long").alias("query_id"),
        anything, F.col("embedding").cast("array<double>").alias("embedding"), "buckets",
    ))
    if batch is None:
        return rank_hits(_scored(asked, store), k)
    return rank_hits(broadcast_topk(batch, store.select("*", anything), k), k)
