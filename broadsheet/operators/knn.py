"""Exact top-k search of a batch of query vectors over a chunk table.

Every task scores its part of the table against the query vectors as a matrix product and keeps k
rows per query, so the pairs of queries and chunks never become rows. A batch of queries whose
rows and bytes were checked is broadcast in blocks, all of which are scored in one scan of the
table; a larger one is split into blocks that meet the parts of the table in a grid of cells, each
of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import fixed_values as fixed
from broadsheet.functions import vectors

# A batch up to this size is broadcast to the tasks; 8 bytes per vector component. What a task keeps
# are k rows per query.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 16_384
FIRST_ROWS = 2048  # queries that are collected before their size is known
BLOCK_QUERIES = 256  # queries that are scored at once
BLOCK_CHUNKS = 2048  # with so many chunks
# The same where a table has cells, as each block then falls into one piece per cell.
CELL_QUERIES, CELL_CHUNKS = 1024, 4096
# Rows per block of queries and per part of the table, in the grid for larger batches.
GRID_QUERIES = 2048
GRID_CHUNKS = 20_000
# Per query the rows kept by the tasks are merged in this many groups first.
MERGE_GROUPS = 32

HIT = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("cosine", T.DoubleType()),
])


def scorer(k: int) -> Callable[[pa.Table, Iterator[pa.Table]], pa.Table]:
    """The work of one task: top k of its chunks for every query, by (cosine, chunk id).

    Tables with a column `buckets` score only pairs that share a bucket at any position; chunks with
    a `cell` are scored for the queries that have it among their `cells`. Defined as a closure that
    needs nothing but numpy and pyarrow, so it is shipped to the executors as it is. Cosines are
    rounded to 12 digits: equal vectors then tie in every engine. Only those that may be among the
    best so far are rounded, so most pairs cost their product and one comparison; within cells the
    product is one of short floats, and pairs within its error of the bound are multiplied again.
    """

    def matrix(table, name):
        """A column of lists as the rows of a matrix; a missing list is a row of zeros."""
        import numpy as np
        import pyarrow.compute as pc

        column = table.column(name).combine_chunks()
        present = pc.is_valid(column).to_numpy(zero_copy_only=False)
        sizes = pc.unique(pc.list_value_length(column.drop_null())).to_pylist()
        if len(sizes) > 1:
            raise ValueError(f"{name} of different lengths: {sizes}")
        rows = np.zeros((len(column), sizes[0] if sizes else 0))
        if sizes:
            values = np.asarray(column.flatten(), dtype="float64")
            rows[present] = values.reshape(-1, sizes[0])
        return rows

    def code(table, categories):
        """Categories as their place in a list, -1 for others and none."""
        import pyarrow.compute as pc

        place = pc.index_in(table.column("category"), value_set=categories)
        return place.fill_null(-1).to_numpy()

    def unit_length(rows):
        import numpy as np

        # One component that is not finite makes the row a missing vector.
        rows = np.where(np.isfinite(rows).all(axis=1, keepdims=True), rows, 0.0)
        lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return rows / np.where(lengths > 0, lengths, 1.0)

    def best(hits):
        """First k rows per query of a table of hits."""
        import numpy as np

        hits = hits.sort_by([
            ("query", "ascending"), ("cosine", "descending"), ("chunk_id", "ascending"),
        ])
        query = hits.column("query").to_numpy()
        starts = np.searchsorted(query, query)  # where the rows of the same query begin
        return hits.filter(np.arange(len(query)) - starts < k)

    def kth_best(hits, n):
        """The cosine that a further hit of each of n queries has to reach."""
        import numpy as np

        least = np.full(n, -np.inf)
        sizes = np.bincount(hits.column("query").to_numpy(), minlength=n)
        last = np.cumsum(sizes) - 1
        full = sizes == k
        least[full] = hits.column("cosine").to_numpy()[last[full]]
        return least

    def within(queries, part):
        """Per query and chunk, whether the chunk was published in the query's time; None for all."""
        import numpy as np

        if "published" not in part.column_names or "from" not in queries.column_names:
            return None
        at = part.column("published").to_numpy()[None, :]
        first, last = (queries.column(c).to_numpy()[:, None] for c in ("from", "to"))
        asked = ~(np.isnan(first) & np.isnan(last))
        inside = (np.isnan(first) | (at >= first)) & (np.isnan(last) | (at <= last))
        return ~asked | inside

    def candidates(cosine, allowed, least):
        """Rows, columns and rounded cosines of what may be among the best k of its row.

        Ties with the k-th best, here or so far, stay in: the chunk id decides in the end.
        """
        import numpy as np

        open_rows = least == -np.inf
        if allowed is not None:
            cosine = np.where(allowed, cosine, -np.inf)
        near = (cosine >= least[:, None] - 1e-11) & (cosine > -np.inf)
        if open_rows.any() or np.count_nonzero(near) > 4 * k * len(least):
            if cosine.shape[1] > k:
                kth = np.partition(cosine, -k, axis=1)[:, [-k]]
                near &= cosine >= kth - 1e-11
        q, c = np.nonzero(near)
        rounded = np.round(cosine[q, c], 12) + 0.0
        reached = rounded >= least[q]
        return q[reached], c[reached], rounded[reached]

    def near_pairs(vectors, short, rows, unit, short_unit, least):
        """Of some rows what `candidates` gives for their products; None if too many pairs are close.

        The error of a product of unit vectors in short floats is below `slack`, in whatever order.
        """
        import numpy as np

        slack = (vectors.shape[1] + 16) * 2.0 ** -24
        cosine = short[rows] @ short_unit.T
        bound = np.where(least == -np.inf, -2.0, least)
        open_rows = np.nonzero(least == -np.inf)[0]
        if len(open_rows) and cosine.shape[1] > k:
            kth = np.partition(cosine[open_rows], -k, axis=1)[:, -k]
            bound[open_rows] = kth.astype("float64") - slack
        near = np.flatnonzero(cosine >= (bound - slack).astype("float32")[:, None])
        if len(near) > 4 * k * len(least) + CELL_CHUNKS:
            return None
        q, c = np.divmod(near, cosine.shape[1])
        rounded = np.round(np.einsum("ij,ij->i", vectors[rows[q]], unit[c]), 12) + 0.0
        reached = rounded >= least[q]
        return q[reached], c[reached], rounded[reached]

    def score(queries, tables):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids = queries.column("query_id").combine_chunks()
        categories = pc.unique(queries.column("category").drop_null())
        wanted = code(queries, categories)
        vectors = unit_length(matrix(queries, "embedding"))
        short = vectors.astype("float32")
        query_buckets = matrix(queries, "buckets") if "buckets" in queries.column_names else None
        query_cells = matrix(queries, "cells") if "cells" in queries.column_names else None
        nothing = pa.table({
            "query": pa.array([], pa.int64()),
            "chunk_id": pa.array([], pa.string()),
            "cosine": pa.array([], pa.float64()),
        })
        at_once, chunks_at_once = (
            (BLOCK_QUERIES, BLOCK_CHUNKS) if query_cells is None else (CELL_QUERIES, CELL_CHUNKS)
        )
        blocks = range(0, len(ids), at_once)
        kept = {block: nothing for block in blocks}  # bounded: k rows per query
        more = {block: [] for block in blocks}  # hits to be merged, at most about as many
        least = np.full(len(ids), -np.inf)

        def pieces(tables):
            """Parts of the tables with the queries that they are scored for."""
            for t in tables:
                for start in range(0, len(t), chunks_at_once):
                    part = t.slice(start, chunks_at_once)
                    if query_cells is None:
                        yield part, np.arange(len(ids))
                        continue
                    cell = part.column("cell").to_numpy()
                    for c in np.unique(cell):
                        yield part.filter(cell == c), np.nonzero((query_cells == c).any(axis=1))[0]

        def merge(block):
            kept[block] = best(pa.concat_tables([kept[block], *more[block]]))
            more[block].clear()
            bounds = least[block:block + at_once]
            bounds[:] = kth_best(kept[block], len(bounds))

        for part, asking in pieces(tables):
            chunk_ids = part.column("chunk_id").combine_chunks()
            category = code(part, categories)
            unit = unit_length(matrix(part, "embedding"))
            short_unit = unit.astype("float32")
            if query_buckets is not None:
                chunk_buckets = matrix(part, "buckets")
            for block in blocks:
                rows = asking[np.searchsorted(asking, block):np.searchsorted(asking, block + at_once)]
                if not len(rows):
                    continue
                allowed = None
                asked = wanted[rows, None]
                if (asked >= 0).any():
                    allowed = (asked < 0) | (asked == category[None, :])
                if query_buckets is not None:
                    same = (query_buckets[rows, None, :] == chunk_buckets[None, :, :]).any(axis=2)
                    allowed = same if allowed is None else allowed & same
                timely = within(queries.take(rows), part)
                if timely is not None:
                    allowed = timely if allowed is None else allowed & timely
                found = None
                if not (vectors.shape[1] and unit.shape[1]):  # one side has no vector at all
                    found = candidates(np.zeros((len(rows), len(part))), allowed, least[rows])
                elif query_cells is not None and allowed is None:
                    found = near_pairs(vectors, short, rows, unit, short_unit, least[rows])
                if found is None:
                    found = candidates(vectors[rows] @ unit.T, allowed, least[rows])
                q, c, found = found
                if len(q):
                    hits = pa.table({
                        "query": pa.array(rows[q] - block, pa.int64()),
                        "chunk_id": chunk_ids.take(pa.array(c)),
                        "cosine": pa.array(found, pa.float64()),
                    })
                    more[block].append(hits)
                    waiting = sum(map(len, more[block]))
                    if waiting > len(kept[block]) // 2 or (least[rows] == -np.inf).any():
                        merge(block)
        for block in blocks:
            merge(block)
        hits = [
            pa.table({
                "query_id": ids.slice(block, at_once).take(found.column("query").combine_chunks()),
                "chunk_id": found.column("chunk_id"),
                "cosine": found.column("cosine"),
            })
            for block, found in kept.items()
        ]
        return pa.concat_tables(hits) if hits else nothing.rename_columns(["query_id", "chunk_id", "cosine"])

    return score


def small_batch(queries: DataFrame) -> pa.Table | None:
    """The queries, if they are few and small enough to be sent to every task.

    A first part of them tells how large a row is, and whether the rest may be collected at all.
    """
    batch = queries.limit(FIRST_ROWS + 1).toArrow()
    if batch.num_rows > FIRST_ROWS:
        fitting = min(BROADCAST_ROWS, BROADCAST_BYTES * batch.num_rows // max(1, batch.nbytes))
        if fitting <= FIRST_ROWS:
            return None
        batch = queries.limit(fitting + 1).toArrow()
    fits = batch.num_rows <= BROADCAST_ROWS and batch.nbytes <= BROADCAST_BYTES
    return batch if fits else None


def broadcast_topk(batch: pa.Table, store: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, cosine) of the k best chunks per query in each task's part."""
    shared = store.sparkSession.sparkContext.broadcast(batch)
    score = scorer(k)

    def task(batches):
        import pyarrow as pa

        tables = (pa.Table.from_batches([b]) for b in batches)
        yield from score(shared.value, tables).to_batches()

    return store.mapInArrow(task, HIT)


def _grid_topk(queries: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """Queries in blocks times chunks in parts; a cell holds one block and one part."""
    blocks = max(1, -(-queries.count() // GRID_QUERIES))
    parts = max(1, -(-store.count() // GRID_CHUNKS))
    score = scorer(k)

    def cell(block_of_queries, part_of_chunks):
        return score(block_of_queries, [part_of_chunks])

    block, part = F.lit(blocks), F.lit(parts)
    left = (
        queries.withColumn("block", F.pmod(F.xxhash64("query_id"), block))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), part - F.lit(1).cast("long"))))
    )
    right = (
        store.withColumn("part", F.pmod(F.xxhash64("chunk_id"), part))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block - F.lit(1).cast("long"))))
    )
    return (
        left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
        .applyInArrow(cell, HIT)
    )


def knn_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = fixed.CONTEXT_TOP_K,
    category: str | None = None,
) -> DataFrame:
    """(query_id, chunk_id, rank, cosine, relevance) of the k nearest chunks per query.

    `queries` has query_id and embedding, and may have a `category` that its hits must have, a
    `date_from` and a `date_to` between which, both included, they must have been published, and a
    `top_k` of its own. `category` restricts the whole batch and prunes the table's folders. The
    hits of a small batch are bounded by its checked size times k and are marked for broadcast, so
    joining them to a table does not shuffle the table.
    """
    if not 1 <= k <= fixed.MAX_TOP_K:
        raise ValueError(f"k must be 1 to {fixed.MAX_TOP_K}")
    store = chunks if category is None else chunks.filter(F.col("category") == category)
    own = queries.columns
    dated = "date_from" in own or "date_to" in own
    published = [_seconds(F.col("published_at")).alias("published")] if dated else []
    store = store.select("chunk_id", "category", "embedding", *published)
    bounds = [
        _seconds(_bound(c) if c in own else F.lit(None)).alias(name)
        for c, name in (("date_from", "from"), ("date_to", "to")) if dated
    ]
    asked = queries.select(
        F.col("query_id").cast("long").alias("query_id"),
        (F.col("category") if "category" in own else F.lit(None)).cast("string").alias("category"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        *bounds,
    )
    kept = fixed.MAX_TOP_K if "top_k" in own else k
    batch = small_batch(asked)
    if batch is None:
        hits = rank_hits(_grid_topk(asked, store, kept), kept)
    else:
        wanted = set(batch.column("category").to_pylist())
        if wanted and None not in wanted:
            store = store.filter(F.col("category").isin(sorted(wanted)))
        hits = F.broadcast(rank_hits(broadcast_topk(batch, store, kept), kept))
    if "top_k" in own:
        limits = queries.select(
            F.col("query_id").cast("long").alias("query_id"), _checked("top_k", k).alias("_limit")
        )
        hits = hits.join(limits, "query_id").filter(F.col("rank") <= F.col("_limit")).drop("_limit")
    return hits


def _seconds(time: Column) -> Column:
    """A time written as text, in seconds; NaN where there is none, or no such time."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(time.cast("string"))) / 1e6, F.lit(float("nan")))


def _bound(column: str) -> Column:
    """A query's bound; one that is no time fails instead of being left out."""
    text = F.nullif(F.col(column).cast("string"), F.lit(""))
    wrong = F.raise_error(F.format_string(f"{column} is no time: %s", text)).cast("string")
    return F.when(text.isNull() | F.try_to_timestamp(text).isNotNull(), text).otherwise(wrong)


def _checked(top_k: str, default: int) -> Column:
    """A query's own k, or the default; fails outside the bounds."""
    own = F.coalesce(F.col(top_k), F.lit(default))
    refused = F.raise_error(F.lit(f"top_k must be 1 to {fixed.MAX_TOP_K}")).cast("int")
    return F.when(own.between(1, fixed.MAX_TOP_K), own).otherwise(refused)


def rank_hits(local: DataFrame, k: int) -> DataFrame:
    """Top k of (query_id, chunk_id, cosine) per query, merged in groups first.

    With very many tasks one query alone has k rows from each of them; no single task gets them all.
    """
    order = [F.desc("cosine"), F.asc("chunk_id")]
    group = F.pmod(F.xxhash64("chunk_id"), F.lit(MERGE_GROUPS))
    merged = (
        local.withColumn("_group", group)
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_group").orderBy(*order)))
        .filter(F.col("rank") <= k)
    )
    return (
        merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        .filter(F.col("rank") <= k)
        .select(
            "query_id", "chunk_id", "rank", "cosine",
            vectors.relevance(F.col("cosine")).alias("relevance"),
        )
    )
