"""A store: articles, their chunks, rejected answers and a model, with a commit for every load.

A load writes into folders of its own, and one small row in the commits makes them part of the
store. Readers see the articles and the chunks of a load together, or neither: what a load that
failed has left behind has no commit and is never read. One writer per store is assumed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import schemas
from broadsheet.operators import text_model
from broadsheet.operators.chunks import chunk_articles
from broadsheet.sources import tables
from broadsheet.sources.tables import create_articles, create_chunks, create_table


@dataclass(frozen=True)
class Store:
    """The places of a store's parts under one folder."""

    root: str

    @property
    def articles(self) -> str:
        return f"{self.root}/articles"

    @property
    def chunks(self) -> str:
        return f"{self.root}/chunks"

    @property
    def commits(self) -> str:
        return f"{self.root}/commits"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def model(self) -> str:
        return f"{self.root}/model"


def create(spark: SparkSession, root: str) -> Store:
    """A store at `root`, empty unless there is one."""
    store = Store(root)
    create_articles(spark, store.articles)
    create_chunks(spark, store.chunks)
    create_table(spark, store.rejects, schemas.REJECT, "load_id")
    empty = spark.createDataFrame([], schemas.COMMIT)
    empty.write.mode("ignore").parquet(store.commits)
    return store


def commits(spark: SparkSession, store: Store) -> DataFrame:
    return spark.read.schema(schemas.COMMIT).parquet(store.commits)


def visible(spark: SparkSession, store: Store) -> list[str]:
    """The write ids that make up the store, one per load since the last `compact`."""
    rows = commits(spark, store).select("write_id", "replaced").collect()
    replaced = {w for r in rows for w in r.replaced or ()}
    return sorted({r.write_id for r in rows} - replaced)


def commit_of(spark: SparkSession, store: Store, load_id: str) -> DataFrame:
    return commits(spark, store).filter(F.col("load_id") == load_id)


def commit(spark: SparkSession, store: Store, load_id: str, write_id: str, **values) -> None:
    """End a load: from here on readers see what was written under `write_id`."""
    given = {"load_id": load_id, "write_id": write_id, **values}
    columns = [
        F.current_timestamp().alias(f.name) if f.name == "committed_at"
        else F.lit(given.get(f.name)).cast(f.dataType).alias(f.name)
        for f in schemas.COMMIT.fields
    ]
    spark.range(1).select(*columns).coalesce(1).write.mode("append").parquet(store.commits)


def read_articles(spark: SparkSession, store: Store) -> DataFrame:
    return tables.read_articles(spark, store.articles, loads=visible(spark, store))


def read_chunks(spark: SparkSession, store: Store) -> DataFrame:
    return tables.read_chunks(spark, store.chunks, loads=visible(spark, store))


def search_tables(spark: SparkSession, store: Store) -> tuple[DataFrame, DataFrame]:
    """Chunks and articles with their buckets, as searches take them."""
    loads = visible(spark, store)
    return (
        tables.stored(spark, store.chunks, schemas.STORED_CHUNK, loads),
        tables.stored(spark, store.articles, schemas.STORED_ARTICLE, loads),
    )


def find_articles(spark: SparkSession, store: Store, ids: DataFrame) -> DataFrame:
    """The articles with the ids in `ids`; only their buckets are read."""
    return tables.find_articles(spark, store.articles, ids, visible(spark, store))


def read_rejects(spark: SparkSession, store: Store) -> DataFrame:
    """(fetch_id, reason, record, load_id) of what gave no articles, of loads that have ended."""
    rows = spark.read.schema(schemas.REJECT).parquet(store.rejects)
    ended = commits(spark, store).select(F.col("write_id").alias("load_id"), F.col("load_id").alias("load"))
    return rows.join(F.broadcast(ended), "load_id").select(
        "fetch_id", "reason", "record", F.col("load").alias("load_id")
    )


def fit_model(spark: SparkSession, store: Store, dim: int = text_model.DIM) -> text_model.TextModel:
    """Fit a text model on all stored articles' chunks and keep it in the store, once."""
    model = text_model.fit(chunk_articles(read_articles(spark, store)).select("document"), dim)
    text_model.save(model, store.model)
    return model


def load_model(store: Store) -> text_model.TextModel:
    return text_model.load(store.model)


def compact(spark: SparkSession, store: Store) -> str:
    """Write what small loads have added as one load, in few sorted files per bucket.

    Readers change over with its commit. The folders it replaces are no longer read.
    """
    write_id, loads = f"compact-{uuid.uuid4().hex}", visible(spark, store)
    articles = tables.read_articles(spark, store.articles, loads=loads)
    chunks = tables.read_chunks(spark, store.chunks, loads=loads)
    tables.append(articles, store.articles, schemas.STORED_ARTICLE, tables.ARTICLE_PARTITIONS, write_id, gathered=True)
    tables.append(chunks, store.chunks, schemas.STORED_CHUNK, tables.CHUNK_PARTITIONS, write_id, gathered=True)
    commit(spark, store, write_id, write_id, replaced=loads)
    return write_id
