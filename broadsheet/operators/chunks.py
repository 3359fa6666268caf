"""Chunk rows of articles and their vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import fixed_values as fixed
from broadsheet.functions import text, vectors
from broadsheet.functions.chunking import chunk_id, with_chunks
from broadsheet.operators import text_model
from broadsheet.session import settle


def chunk_articles(
    articles: DataFrame, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk, numbered from 0 within its article, next to the article's columns.

    The outer form of explode, because for the inner one Spark adds a filter on the list's size
    below, which would cut every text a second time.
    """
    return (
        with_chunks(articles, text.index_text(), size=size, overlap=overlap)
        .select(*articles.columns, F.posexplode_outer("chunks").alias("chunk_index", "document"))
        .filter(F.col("document").isNotNull())
        .withColumn("chunk_id", chunk_id("article_id", "chunk_index"))
    )


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """The columns that are stored with a chunk, without its vector."""
    return chunks.select(
        "chunk_id",
        "article_id",
        "chunk_index",
        "document",
        "title",
        text.or_default("source_name", fixed.DEFAULT_SOURCE).alias("source"),
        text.or_default("category", fixed.DEFAULT_CATEGORY).alias("category"),
        text.or_default("published_at", "").alias("published_at"),
        text.or_default("url", "").alias("url"),
    )


def attach_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with the vector given for the same article and position."""
    return chunks.join(embeddings, ["article_id", "chunk_index"])


def attach_vectors_or_zero(chunks: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """As `attach_vectors`, with the zero vector where none is given."""
    return (
        chunks.join(embeddings, ["article_id", "chunk_index"], "left")
        .withColumn("embedding", vectors.vector_or_zero("embedding", dim))
    )


def vectorise(chunks: DataFrame, dim: int = 256) -> DataFrame:
    """Chunks with a unit vector of their words, weighted by how rare a word is in `chunks`.

    Stands in for a remote embedding model: fitted and applied by Spark over the whole table, which
    is computed once. The weights are those of this table alone; for an index that grows, and for
    queries in its space, see `text_model`.
    """
    rows = settle(chunks)
    return text_model.fit(rows, dim).vectors(rows)


def hashed_vectors(chunks: DataFrame, dim: int = 256) -> DataFrame:
    """As `vectorise` but without weights, so nothing is fitted: for loads that come one by one."""
    tokenizer, counter = text_model.terms(dim)
    counted = counter.transform(tokenizer.transform(chunks))
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return text_model.as_arrays(unit, chunks.columns)


hashed_vectors.by_row = True  # see `tables.append_chunks`


def model_vectors(
    embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = fixed.EMBEDDING_BATCH
) -> Callable[[DataFrame], DataFrame]:
    """A vectoriser that calls an embedding model of the user's in every task.

    `embed` gets the texts of up to `batch` chunks; where it fails, they get the zero vector.
    """

    def vectors_of(texts: list[str]) -> list[list[float]]:
        try:
            return embed(texts)
        except Exception:
            return [[0.0] * dim] * len(texts)

    def task(batches):
        import pyarrow as pa

        for rows in batches:
            texts = rows.column("document").to_pylist()
            found = [
                vector for start in range(0, len(texts), batch)
                for vector in vectors_of(texts[start:start + batch])
            ]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(found, pa.list_(pa.float32()))],
                names=[*rows.schema.names, "embedding"],
            )

    def vectoriser(chunks: DataFrame) -> DataFrame:
        schema = T.StructType([
            *chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))
        ])
        return chunks.mapInArrow(task, schema)

    return vectoriser
