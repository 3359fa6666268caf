"""Line dedup: documents that overlap are aligned, and common blocks go from the later one.

Every line that occurs in several documents points from each of them to the first that has it, and
so does every run of short lines, whose first holder may be another. Two documents so connected are
aligned if they share a rare line (one of few documents), or text enough for a block in frequent
ones: copies in thousands have no rare line, and the size of a table must not decide what goes from
it. As a document meets only the first holders of its lines, groups of copies cost linear work, and
each of its shared lines is met where it first occurs.

Pairs are aligned by patience diff over hashes of their lines: equal starts and ends are matched,
then the lines that are unique in both, as far as they keep one order (a longest increasing
subsequence), then the stretches between them in the same way. A block is a run of lines matched
one after the other; blocks of some size are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import documents, free_names, if_few, list_array, mix, quoted, stored

RARE = 32  # documents that share a line which alone makes a pair
BLOCK_CHARS = 40  # of a block that is deleted, at least, and in frequent lines that make a pair


# --- patience diff ----------------------------------------------------------------------------

def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by the first, whose seconds increase.

    Of several it is the one with the latest pairs, chosen from its end.
    """
    ends: list[int] = []
    tops: list[int] = []
    before: list[int | None] = []
    for k, (_, second) in enumerate(pairs):
        at = bisect_left(ends, second)
        before.append(tops[at - 1] if at else None)
        if at == len(ends):
            ends.append(second)
            tops.append(k)
        else:
            ends[at], tops[at] = second, k
    out, k = [], tops[-1] if tops else None
    while k is not None:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(earlier: Sequence[int], later: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places (in the earlier, in the later), in order."""
    out, open_ = [], [(0, len(earlier), 0, len(later))]
    while open_:
        a, a_end, b, b_end = open_.pop()
        while a < a_end and b < b_end and earlier[a] == later[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and earlier[a_end - 1] == later[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        count_a, count_b = Counter(earlier[a:a_end]), Counter(later[b:b_end])
        place = {earlier[i]: i for i in range(a, a_end)}
        unique = [
            (j, place[later[j]]) for j in range(b, b_end)
            if count_b[later[j]] == 1 and count_a[later[j]] == 1
        ]
        chain = _increasing(unique)
        if not chain:
            continue
        from_a, from_b = a, b
        for j, i in chain:
            open_.append((from_a, i, from_b, j))
            out.append((i, j))
            from_a, from_b = i + 1, j + 1
        open_.append((from_a, a_end, from_b, b_end))
    return sorted(out)


def deleted(
    earlier: Sequence[int], later: Sequence[int], chars: Sequence[int], least: int
) -> list[int]:
    """Lines of the later document in common blocks of at least `least` characters."""
    out, block = [], []
    for i, j in [*align(earlier, later), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(chars[k] for _, k in block) >= least:
                out.extend(k for _, k in block)
            block = []
        block.append((i, j))
    return out


# --- over a table -----------------------------------------------------------------------------

def _lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_key, lines, chars): hashes of lines, 0 for blank ones, and their lengths."""
    text = F.col("text").cast("string")
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
        F.transform(split, lambda x: F.when(F.trim(x) == "", 0).otherwise(F.xxhash64(x))).alias("lines"),
        F.transform(split, F.length).alias("chars"),
    ).withColumn("row", F.monotonically_increasing_id())


def runs(lines: pa.ListArray, chars: pa.ListArray, least: int) -> pa.ListArray:
    """Per document hashes of the shortest runs of `least` characters from and up to shorter lines.

    Lines follow each other, with as many blank ones between; the spaces of these do not count. Two
    documents with a block of so much text in common have all of the runs that lie in it, and each
    of its lines lies in one: in the first from the block's start, or else in the one that it ends.
    """
    counts = lines.value_lengths().to_numpy(zero_copy_only=False)
    line = lines.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = chars.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.flatnonzero(line)
    line, size, doc = line[places].view(np.uint64), size[places], np.repeat(np.arange(len(counts)), counts)[places]
    owner, found = [places[:0]], [line[:0]]
    for way in (1, -1):
        start = last = np.flatnonzero(size < least)
        key, length = mix(mix(line[start]) + np.uint64(way == 1)), size[start]
        while len(start):  # a line has a character at least, so `least` rounds at most
            after = np.clip(last + way, 0, len(line) - 1)
            go = (after != last) & (doc[after] == doc[start])
            step = np.abs(places[after] - places[last])[go].astype(np.uint64)
            start, last, key, length = start[go], after[go], key[go], length[go]
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mix(mix(line[last]) + step))
            length = length + size[last]
            done = length >= least
            owner.append(doc[start[done]])
            found.append(key[done])
            start, last, key, length = start[~done], last[~done], key[~done], length[~done]
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return list_array(pa.array(found[order].view(np.int64)), np.bincount(owner, minlength=len(counts)))


def _runs(lines: DataFrame, least: int) -> DataFrame:
    """(row, doc_id, text_key, line, chars): the runs of documents, as if they were lines."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = runs(batch.column("lines"), batch.column("chars"), least)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "text_key")), found],
                names=["row", "doc_id", "text_key", "runs"],
            )

    found = lines.select("row", "doc_id", "text_key", "lines", "chars").mapInArrow(
        find, "row long, doc_id long, text_key long, runs array<long>"
    )
    return found.select(
        "row", "doc_id", "text_key", F.explode("runs").alias("line"), F.lit(least).alias("chars")
    )


def _pairs(lines: DataFrame, rare: int, block_chars: int) -> DataFrame:
    """(later, earlier) rows that are to be aligned, by their lines and by runs of `block_chars`."""
    held = lines.select(
        "row", "doc_id", "text_key", F.explode(F.arrays_zip("lines", "chars")).alias("x")
    ).select("row", "doc_id", "text_key", F.col("x.lines").alias("line"), F.col("x.chars").alias("chars"))
    held = held.unionByName(_runs(lines, block_chars))
    held = held.filter("line != 0").groupBy("line", "row", "doc_id", "text_key").agg(F.max("chars").alias("chars"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "row")
    shared = held.groupBy("line").agg(F.count("*").alias("documents"), F.min(order).alias("first"))
    shared = shared.filter("documents > 1").select("line", "documents", F.col("first.row").alias("earlier"))
    met = held.join(shared, "line").filter("row != earlier").groupBy(
        F.col("row").alias("later"), "earlier"
    ).agg(F.min("documents").alias("rarest"), F.sum("chars").alias("chars"))
    return met.filter((F.col("rarest") <= rare) | (F.col("chars") >= block_chars)).select("later", "earlier")


def decisions(
    docs: DataFrame, rare: int = RARE, block_chars: int = BLOCK_CHARS
) -> tuple[DataFrame, DataFrame]:
    """(rows, deletions): row, doc_id, text_key of all rows; row and its lines to delete, in order."""
    lines = stored(_lines(docs), "lines")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("earlier_lines", "lines", "chars"))
            found = [deleted(*x, block_chars) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(found, pa.list_(pa.int32()))], names=["row", "gone"]
            )

    pairs = stored(_pairs(lines, rare, block_chars), "line-pairs")
    later = lines.select("row", "lines", "chars").join(pairs.withColumnRenamed("later", "row"), "row")
    earlier = lines.select(F.col("row").alias("earlier"), F.col("lines").alias("earlier_lines"))
    aligned = later.join(earlier, "earlier").select("row", "earlier_lines", "lines", "chars").mapInArrow(
        compare, "row long, gone array<int>"
    )
    gone = aligned.filter(F.size("gone") > 0).groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")
    )
    return lines.select("row", "doc_id", "text_key"), stored(gone, "deletions")


def dedup(
    docs: DataFrame, rare: int = RARE, block_chars: int = BLOCK_CHARS, into: str = "_gone"
) -> DataFrame:
    """All rows and columns, text without the deleted lines, and `into`, their numbers from 0.

    Documents are ordered by doc_id, those without one last, then by the hash of their texts;
    repeated rows follow each other, and one of them stays whole. A missing text stays missing and
    has nothing to delete, nor has an empty one; blank lines match each other but point nowhere.
    An empty table gives no rows. Other columns are carried along, whatever their names, but for
    one named as `into`.
    """
    if into.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {into}; name another for the deleted lines")
    id_, key, nth, of, its = free_names(docs, "id", "key", "nth", "of", "its")
    rows, gone = decisions(docs, rare, block_chars)
    named = rows.join(gone, "row", "left")
    # Several rows equal in doc_id and text cannot be told apart by key: they are numbered.
    order = Window.partitionBy("doc_id", "text_key").orderBy(F.size(F.coalesce("gone", F.array())), "row")
    keys = stored(named.withColumn(nth, F.row_number().over(order)).select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("gone").alias(into), nth
    ), "line-keys")
    text = F.col("text").cast("string")
    text_key = F.xxhash64(text)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (text_key == F.col(key))
    many = keys.filter(F.col(nth) == 2).select(id_, key)
    single = keys.filter(F.col(into).isNotNull()).join(
        many.select(F.col(id_).alias("i"), F.col(key).alias("k")),
        F.col(id_).eqNullSafe(F.col("i")) & (F.col(key) == F.col("k")), "left_anti",
    ).drop(nth)
    found = docs.join(single, same, "left").drop(id_, key)
    if not many.isEmpty():
        found = docs.join(if_few(many), same, "left_anti").join(single, same, "left").drop(id_, key)
        numbered = docs.join(if_few(many), same, "left_semi").withColumn(its, text_key).withColumn(
            of, F.row_number().over(Window.partitionBy("doc_id", its).orderBy(F.lit(1)))
        )
        repeated = numbered.join(
            keys, F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
            & (F.col(its) == F.col(key)) & (F.col(of) == F.col(nth)),
        ).drop(id_, key, nth, of, its)
        found = found.unionByName(repeated)
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(into, i))
    return found.withColumn(
        "text", F.when(F.col(into).isNull(), text).otherwise(F.array_join(kept, "\n"))
    )


def summary(docs: DataFrame) -> DataFrame:
    """Per document: how many lines went, their numbers from 0, and a digest of what is left.

    A missing or empty text has nothing to lose and the digest of an empty one. Repeated rows have
    a row each, one of them with all of its lines. An empty table gives no rows.
    """
    gone = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    return dedup(documents(docs)).select(
        "doc_id", F.size(gone).cast("long").alias("n_removed"),
        F.array_join(F.transform(gone, lambda x: x.cast("string")), ",").alias("removed"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows with something left, with their columns; rows that had nothing to delete stay."""
    (gone,) = free_names(docs, "gone")
    found = dedup(docs, into=gone)
    left = F.col(gone).isNull() | (F.trim(F.translate("text", "\n\r\t", "   ")) != "")
    return found.filter(left).select(*map(quoted, docs.columns))
