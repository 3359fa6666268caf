"""From articles to stored chunks with vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.chunks import chunk_articles, chunk_metadata, hashed_vectors
from broadsheet.sources import tables

Vectoriser = Callable[[DataFrame], DataFrame]


def chunks_of(articles: DataFrame, vectoriser: Vectoriser = hashed_vectors) -> DataFrame:
    """Chunk rows of the articles with metadata and vectors."""
    return vectoriser(chunk_metadata(chunk_articles(articles)))


def index_articles(
    articles: DataFrame,
    chunk_table: str,
    vectoriser: Vectoriser = hashed_vectors,
    load_id: str | None = None,
) -> DataFrame:
    """Store the chunks of the articles that are not stored yet; returns what the load added.

    Stored chunks are left out before the vectoriser, so a model is called for new ones only. The
    default needs no fitting, and `text_model` has fitted ones that are kept: vectors of several
    loads can be compared with either.
    """
    load_id = load_id or uuid.uuid4().hex
    chunks = chunk_metadata(chunk_articles(articles))
    new = tables.new_chunks(chunks, chunk_table, articles, cut_once=True)
    tables.append_chunks(new, chunk_table, load_id, vectoriser)
    return tables.read_chunks(articles.sparkSession, chunk_table, load_id)


def indexed_articles(added: DataFrame) -> DataFrame:
    """How many articles got a new chunk, and how many chunks that were."""
    by_article = added.groupBy("article_id").agg(F.count(F.lit(1)).alias("chunks"))
    return by_article.agg(
        F.count(F.lit(1)).alias("indexed"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("new_chunks"),
    )
