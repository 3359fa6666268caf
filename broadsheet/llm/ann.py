"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns unit vectors;
a vector's bucket in a table is its nearest signed axis, the largest coordinate with its sign. A
query looks into the buckets of its `PROBES` largest coordinates in each table, and all that is
found there in any table is ranked by the exact distance.

The index is computed where the vectors lie: a task hashes its vectors and finds, per vector, the
queries that probe one of its buckets as the union of bit sets. Queries come in blocks of bounded
size; vectors are never moved, and each task returns k rows per query at most. Queries that find too
few in their buckets are compared with all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stored

TABLES = 32
PROBES = 4
BLOCK = 4096  # queries that are scored in one pass over the vectors
ROWS = 2048  # vectors that a task hashes at a time
SEED = 20240229


class Rotations:
    """The hash tables' pseudo-rotations for vectors of one length."""

    def __init__(self, dimension: int, longest: float, lifted: bool, tables: int = TABLES):
        self.longest, self.lifted = longest, lifted
        need = dimension + lifted
        self.width = 1 << max(0, need - 1).bit_length()
        signs = np.random.default_rng(SEED)
        self.signs = signs.choice([-1.0, 1.0], (tables, 3, self.width))

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        """On the unit sphere, padded. Unequal lengths become one more coordinate."""
        out = np.zeros((len(vectors), self.width))
        out[:, :vectors.shape[1]] = vectors / self.longest
        if self.lifted:
            out[:, vectors.shape[1]] = np.sqrt(np.maximum(0, 1 - (out ** 2).sum(axis=1)))
        return out

    def axes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Coordinates along all signed axes after the table's rotation."""
        for signs in self.signs[table]:
            unit = _hadamard(unit * signs)
        return np.concatenate([unit, -unit], axis=1)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        unit = self.unit(vectors)
        return np.stack([self.axes(unit, t).argmax(axis=1) for t in range(len(self.signs))])

    def probes(self, vectors: np.ndarray, probes: int = PROBES) -> np.ndarray:
        unit = self.unit(vectors)
        probes = min(probes, 2 * self.width)
        return np.stack([
            np.argpartition(-self.axes(unit, t), probes - 1, axis=1)[:, :probes]
            for t in range(len(self.signs))
        ])


def _hadamard(x: np.ndarray) -> np.ndarray:
    rows, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(rows, width)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of rows with an id and a vector of finite components that is not zero."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_column).isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("vector")
    )


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


def _nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:  # ties with the k-th stay in
        few = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
        return few[np.lexsort((ids[few], scores[few]))[:k]]
    return np.lexsort((ids, scores))[:k]


def _search_block(points: DataFrame, block: pa.Table, rotations: Rotations, probes: int, k: int):
    dimension = len(block.column("vector")[0])
    ids = block.column("id").to_numpy()
    queries = _matrix(block.column("vector").combine_chunks(), dimension)
    shared = points.sparkSession.sparkContext.broadcast((ids, queries))  # about `block` rows

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        n = len(ids)
        looks = rotations.probes(queries, probes)
        sets = np.zeros((len(looks), 2 * rotations.width, (n + 7) // 8), np.uint8)
        for table, found in enumerate(looks):
            member = np.zeros((2 * rotations.width, n), bool)
            member[found.T, np.arange(n)] = True
            sets[table] = np.packbits(member, axis=1)
        best = [(np.array([], np.int64), np.array([]))] * n
        scored = np.zeros(n, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                point_ids = part.column("id").to_numpy()
                points = _matrix(part.column("vector"), dimension)
                found = reduce(np.bitwise_or, (
                    s[b] for s, b in zip(sets, rotations.buckets(points), strict=True)
                ))
                hits = np.unpackbits(found, axis=1, count=n).T.astype(bool)
                hits &= point_ids[None, :] != ids[:, None]
                for q in np.flatnonzero(hits.any(axis=1)):
                    rows = np.flatnonzero(hits[q])
                    scored[q] += len(rows)
                    away = points[rows] - queries[q]
                    distance = np.sqrt((away * away).sum(axis=1))
                    near = _nearest(point_ids[rows], distance, k)
                    both_ids = np.concatenate([best[q][0], point_ids[rows][near]])
                    both = np.concatenate([best[q][1], distance[near]])
                    near = np.lexsort((both_ids, both))[:k]
                    best[q] = both_ids[near], both[near]
        count = np.array([len(b[0]) for b in best])
        if count.sum():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(ids, count)),
                pa.array(np.concatenate([b[0] for b in best])),
                pa.array(np.concatenate([b[1] for b in best])),
                pa.array(np.repeat(scored, count)),
            ], names=["query_id", "vec_id", "score", "task_scored"])

    return points.mapInArrow(score, "query_id long, vec_id long, score double, task_scored long"), shared


def _search_blocks(
    points: DataFrame, asked: DataFrame, rotations: Rotations, probes: int, k: int, block: int
) -> DataFrame | None:
    """The k nearest that each query finds, block after block of queries; None without queries.

    One block at a time is in the driver and in the tasks; its result is written before the next.
    """
    blocks = -(-asked.count() // block)
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, 2 * blocks - 1))))
    if blocks > 1:
        numbered = stored(numbered, "queries")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = []
    for b in range(2 * blocks - 1):  # more, smaller blocks than need be: hashing deals unevenly
        rows = numbered.filter(F.col("block") == b).select("id", "vector").toArrow()
        if rows.num_rows:
            hits, shared = _search_block(points, rows, rotations, probes, k)
            best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            found.append(stored(best.select("query_id", "rank", "vec_id", "score"), "nearest"))
            shared.destroy()
    return reduce(DataFrame.unionAll, found) if found else None


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id",
    vector_column: str = "embedding", tables: int = TABLES, probes: int = PROBES, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of the candidates found.

    A query whose buckets hold fewer than k other rows is searched once more, in all of the table.
    A query does not find rows with its own id. Ties go to the smaller id; repeated rows each
    count, repeated queries are one. Vectors that are missing, zero or hold a missing or
    non-finite component take no part, nor do rows without an id, nor vectors of another length
    than the most frequent one. Empty tables give no rows. Other columns do not matter.
    """
    points, asked = usable(vectors, id_column, vector_column), usable(queries, id_column, vector_column)
    length = F.size("vector")
    common = points.groupBy(length.alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dimension = common["d"]
    points = points.filter(length == dimension)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    shortest, longest = points.agg(F.min(norm), F.max(norm)).first()
    asked = asked.filter(length == dimension).dropDuplicates(["id"])
    lifted = longest - shortest > 1e-4 * longest
    found = _search_blocks(points, asked, Rotations(dimension, longest, lifted, tables), probes, k, block)
    if found is None:
        return empty
    full = found.groupBy(F.col("query_id").alias("id")).agg(F.max("rank").alias("n")).filter(F.col("n") == k)
    short = stored(asked.join(full, "id", "left_anti"), "short-queries")
    one = Rotations(dimension, longest, lifted, tables=1)  # its buckets, all probed, hold every row
    more = _search_blocks(points, short, one, 2 * one.width, k, block)
    if more is None:
        return found
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
