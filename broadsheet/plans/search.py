"""Search, cited context and prompts for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import text
from broadsheet.operators import hits as H
from broadsheet.operators.filters import published_between
from broadsheet.operators.knn import knn_topk
from broadsheet.operators.text_model import TextModel
from broadsheet.session import broadcast_if_few, settle


def search(
    queries: DataFrame,
    chunks: DataFrame,
    articles: DataFrame,
    k: int = fixed.SEARCH_TOP_K,
    category: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Articles found per query with score and snippet; at most one row per article.

    The k best chunks are taken first, so fewer than k articles may come back. The dates hold for
    the whole batch; queries can have their own, see `knn_topk`. Chunks and articles that come with
    their buckets are looked up by the hits' ids, others are read whole.
    """
    store = published_between(chunks, date_from, date_to)
    hits = broadcast_if_few(settle(knn_topk(queries, store, k, category)))
    found = H.first_hit(H.with_chunk_columns(hits, store))
    return H.enrich_hits(settle(found), articles).withColumn(
        "total", F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    )


def retrieve_context(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = fixed.CONTEXT_TOP_K,
    category: str | None = None,
) -> DataFrame:
    """The most relevant chunk of every article among the k best chunks, numbered per query."""
    hits = broadcast_if_few(settle(knn_topk(queries, chunks, k, category)))
    return H.numbered(H.best_chunk(H.with_chunk_columns(hits, chunks)))


def search_text(
    queries: DataFrame, model: TextModel, chunks: DataFrame, articles: DataFrame, **options
) -> DataFrame:
    """As `search`, for the texts in `query`: they get vectors of the model that made the chunks'.

    Chunks of another model make it fail.
    """
    return search(model.queries(queries), model.own(chunks), articles, **options)


def _known(column: str) -> Column:
    return F.coalesce(column, F.lit(fixed.UNKNOWN))


def format_context(queries: DataFrame, context: DataFrame) -> DataFrame:
    """One text per query: its numbered source blocks, or a fixed sentence without any."""
    about = [_known(c) for c in ("title", "source", "category", "published_at")]
    block = F.format_string(fixed.CONTEXT_BLOCK, "source_no", *about, "document")
    blocks = context.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("source_no", block.alias("block")))).alias("blocks")
    )
    joined = F.array_join(F.col("blocks.block"), fixed.CONTEXT_SEPARATOR)
    return queries.join(blocks, "query_id", "left").select(
        *queries.columns, F.coalesce(joined, F.lit(fixed.NO_CONTEXT)).alias("context")
    )


def citations(context: DataFrame) -> DataFrame:
    """One row per cited source."""
    return context.select(
        "query_id",
        "source_no",
        _known("title").alias("title"),
        _known("source").alias("source"),
        F.coalesce("url", F.lit("")).alias("url"),
        text.citation_snippet("document").alias("snippet"),
        "relevance",
    )


def citation_lists(context: DataFrame) -> DataFrame:
    """The cited sources of a query as one list, in order."""
    cited = F.struct("source_no", "title", "source", "url", "snippet", "relevance")
    return citations(context).groupBy("query_id").agg(
        F.array_sort(F.collect_list(cited)).alias("sources")
    )


def prompts(contexts: DataFrame) -> DataFrame:
    """The prompt of every query from its context and question."""
    return contexts.withColumn("prompt", F.format_string(fixed.PROMPT, "context", "query"))


def chat(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = fixed.CONTEXT_TOP_K,
    category: str | None = None,
    model: TextModel | None = None,
) -> DataFrame:
    """Per query its prompt and the list of sources cited in it; the table is searched once.

    With a `model` the queries are texts, else they have vectors.
    """
    if model is not None:
        queries, chunks = model.queries(queries), model.own(chunks)
    context = settle(retrieve_context(queries, chunks, k, category))
    asked = queries.select("query_id", "query")
    return prompts(format_context(asked, context)).join(citation_lists(context), "query_id", "left")
