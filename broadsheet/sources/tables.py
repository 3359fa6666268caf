"""Stored tables that only ever gain rows that are not there yet.

A load writes its new rows straight from the plan that found them, and whoever needs to know what
it added reads the load's folders. Rows lie in buckets by the hash of their article's id, sorted
and with Bloom filters on it: to find out what of a load is stored already, its buckets are read,
and in them only the parts of files that can hold its ids. One writer per table is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import schemas
from broadsheet.operators.dedupe import first_places, rows_at
from broadsheet.operators.lookup import bucket_of, of_articles
from broadsheet.session import broadcast_if_few, settle

ARTICLE_PARTITIONS = ("bucket", "load_id")
CHUNK_PARTITIONS = ("category", "bucket", "load_id")
WRITING = {  # a filter has 10 bits for each of about 50,000 ids, as a row group of texts holds
    "parquet.bloom.filter.enabled#article_id": "true", "parquet.bloom.filter.max.bytes": "65536",
    "compression": "zstd",
}


def create_table(spark: SparkSession, path: str, schema: T.StructType, *partitions: str) -> None:
    """An empty table at `path`, unless there is one."""
    empty = spark.createDataFrame([], schema)
    empty.write.mode("ignore").partitionBy(*partitions).parquet(path)


def create_articles(spark: SparkSession, path: str) -> None:
    create_table(spark, path, schemas.STORED_ARTICLE, *ARTICLE_PARTITIONS)


def create_chunks(spark: SparkSession, path: str) -> None:
    create_table(spark, path, schemas.STORED_CHUNK, *CHUNK_PARTITIONS)


def stored(
    spark: SparkSession, path: str, schema: T.StructType, loads: Sequence[str] | None = None
) -> DataFrame:
    """A table with its partition columns; of `loads` only if they are named.

    It is read by its schema, so partition values that look like numbers stay text. Searches that
    are given such a table look texts up by the buckets of their hits.
    """
    rows = spark.read.schema(schema).parquet(path)
    return rows if loads is None else rows.filter(F.col("load_id").isin(*loads))


def _of_load(rows: DataFrame, load_id: str | None) -> DataFrame:
    return (rows if load_id is None else rows.filter(F.col("load_id") == load_id)).drop("bucket", "load_id")


def read_articles(
    spark: SparkSession, path: str, load_id: str | None = None, loads: Sequence[str] | None = None
) -> DataFrame:
    """The stored articles, or those that one load, or some loads, have added."""
    return _of_load(stored(spark, path, schemas.STORED_ARTICLE, loads), load_id)


def read_chunks(
    spark: SparkSession, path: str, load_id: str | None = None, loads: Sequence[str] | None = None
) -> DataFrame:
    """The stored chunks, or those that one load, or some loads, have added."""
    return _of_load(stored(spark, path, schemas.STORED_CHUNK, loads), load_id)


def find_articles(
    spark: SparkSession, path: str, ids: DataFrame, loads: Sequence[str] | None = None
) -> DataFrame:
    """The stored articles with the ids in `ids`, by their buckets."""
    rows = of_articles(stored(spark, path, schemas.STORED_ARTICLE, loads), ids)
    return rows.drop("bucket", "load_id")


def append(
    rows: DataFrame, path: str, schema: T.StructType, partitions: Sequence[str], load_id: str,
    completed: Callable[[DataFrame], DataFrame] | None = None, gathered: bool = False,
) -> None:
    """Write rows as those of a load: every task writes its own into the folders they belong to,
    so whole rows are not shuffled once more, and a folder that holds most is written by many.

    `gathered` brings the rows of a folder together first, for fewer files; a large folder still
    gets several. `completed` adds columns row by row after that, so that they are not shuffled.
    """
    folders = [p for p in partitions if p != "load_id"]
    stamped = rows.withColumn("bucket", bucket_of("article_id")).withColumn("load_id", F.lit(load_id))
    given = [c for c in schema.fieldNames() if c in stamped.columns]
    own = stamped.select(*given)
    placed = (
        (own.hint("rebalance", *folders) if gathered else own)
        .sortWithinPartitions(*partitions, "article_id")  # lookups by id skip row groups
    )
    whole = placed if completed is None else completed(placed)
    whole.select(*schema.fieldNames()).write.mode("append").options(**WRITING).partitionBy(*partitions).parquet(path)


def insert_new(
    articles: DataFrame, path: str, order: str, load_id: str | None = None,
    loads: Sequence[str] | None = None,
) -> str:
    """Add the articles whose id is not stored, the first of each id; returns the load id.

    A load that is tried again under its `load_id` adds what an earlier try did not. Stored is what
    `loads` have written, if they are named. What is compared are ids; whole rows are fetched once
    it is known which of them are new.
    """
    load_id = load_id or uuid.uuid4().hex
    table = stored(articles.sparkSession, path, schemas.STORED_ARTICLE, loads)
    first = first_places(articles, "article_id", order)
    known = of_articles(table, first.withColumnRenamed("_key", "article_id"), settled=True)
    new = first.join(known.select(F.col("article_id").alias("_key")), "_key", "left_anti")
    fresh = rows_at(articles, settle(new), "article_id", order)
    stamped = fresh.withColumn("created_at", F.current_timestamp())
    append(stamped, path, schemas.STORED_ARTICLE, ARTICLE_PARTITIONS, load_id)
    return load_id


def new_chunks(
    chunks: DataFrame, path: str, articles: DataFrame, loads: Sequence[str] | None = None,
    cut_once: bool = False,
) -> DataFrame:
    """The chunks of `articles` whose id is not stored, each once.

    Few chunks of a load are stored already as a rule; their ids are broadcast. `cut_once` says
    that every row of `articles` was cut into chunks once, and that there are no other chunks. Only
    articles that come in several rows can then have a chunk twice, and only theirs are shuffled.
    """
    table = stored(chunks.sparkSession, path, schemas.STORED_CHUNK, loads)
    ids = settle(articles.groupBy("article_id").agg(F.count(F.lit(1)).alias("_n")))
    known = broadcast_if_few(settle(of_articles(table, ids, settled=True).select("chunk_id")))
    new = chunks.join(known, "chunk_id", "left_anti")
    if not cut_once:
        return new.dropDuplicates(["chunk_id"])
    several = ids.filter("_n > 1").select(F.col("article_id").alias("_several"))
    if several.isEmpty():
        return new
    several = broadcast_if_few(several)
    same = F.col("article_id").eqNullSafe(F.col("_several"))
    repeated = new.join(several, same, "left_semi").dropDuplicates(["chunk_id"])
    return new.join(several, same, "left_anti").unionByName(repeated)


def append_chunks(
    chunks: DataFrame, path: str, load_id: str,
    vectoriser: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write chunks as those of a load; without a vectoriser they have their vectors.

    A vectoriser that goes row by row and says so (`by_row`) is called on the chunks in the order
    in which they are written: they are gathered as texts, without the vectors. Chunks with
    vectors are written where they are; `store.compact` gathers them.
    """
    def with_model(rows: DataFrame) -> DataFrame:
        rows = vectoriser(rows) if vectoriser is not None else rows
        return rows if "model_id" in rows.columns else rows.withColumn("model_id", F.lit(None).cast("string"))

    if getattr(vectoriser, "by_row", False):
        append(chunks, path, schemas.STORED_CHUNK, CHUNK_PARTITIONS, load_id, with_model, gathered=True)
    else:
        append(with_model(chunks), path, schemas.STORED_CHUNK, CHUNK_PARTITIONS, load_id)


def insert_new_chunks(
    chunks: DataFrame, path: str, articles: DataFrame, load_id: str | None = None
) -> str:
    """Add the chunks of `articles`, with vectors, whose id is not stored; returns the load id.

    Where vectors are still to be made, `indexing.index_articles` makes those of new chunks only.
    """
    load_id = load_id or uuid.uuid4().hex
    append_chunks(new_chunks(chunks, path, articles), path, load_id)
    return load_id
