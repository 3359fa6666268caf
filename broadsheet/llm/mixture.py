"""Sources mixed to target weights by Pareto order sampling.

Sources share the corpus' words by weight; none gets more than `most` times its own. Within a source
every document is expected a number of times that falls slowly with its length, as repeats of long
documents cost most. The whole part of that number is certain. The rest is a chance, unequal from
document to document: documents are ranked by their random odds divided by the odds of that
chance, and the first of them make up the words that are left (a sample of fixed size, in words).
The place at which they do is found from sums over narrow ranges of ranks; only the documents of
the range that it falls into, and of the next one, are looked at one by one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import documents, free_names, if_few, quoted, stored
from broadsheet.llm.running import numbered, repeated, running

WEIGHTS = (5, 2, 1)  # of sources in order, repeating
MOST = 3  # copies of a document, and times of a source's size that it can be given
TILT = 0.25  # the expected number falls with this power of the length, class by class
RANGE_ROWS = 256  # documents in a range of ranks, about
EXCHANGES = 16  # at most, at the end of a source's sample
_ALMOST = 1e-9  # closer to a whole number than this is one

WHITE_SPACE = " \t\n\x0b\x0c\r"


def words(text: str) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; a missing text has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, WHITE_SPACE, "")).cast("long")


def _source(column: Column) -> Column:
    """A source's name as text that is never missing and keeps the order, missing last."""
    return F.coalesce(F.concat(F.lit("0"), column.cast("string")), F.lit("1"))


def _versions(docs: DataFrame) -> DataFrame:
    """(src, doc_id, text_key, size, length, rows): rows equal in these are counted, not kept apart."""
    columns = documents(docs).columns
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _source(F.col("source")).alias("src"))
    sized = rows.select("src", columns[0], F.xxhash64("text").alias("text_key"), words("text").alias("size"))
    length = F.when(F.col("size") == 0, 0).otherwise(F.length(F.bin("size")))  # class of lengths
    return sized.groupBy(*sized.columns, length.alias("length")).agg(F.count(F.lit(1)).alias("rows"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(src, source_size, target) of (src, source_size): `share` of all words, dealt out by weight.

    What a source would get beyond `most` times its size is dealt to the others, until none is
    above. Sums only come to the driver, once per round.
    """
    dealt = F.array(*map(F.lit, weights))
    place = F.col("place") % len(weights)
    rows = stored(numbered(sizes, "src").select("*", F.get(dealt, place.cast("int")).alias("weight")), "sources")
    cap = F.col("source_size") * most
    all_words = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1  # words per unit of weight; how many sources have their most
    while True:
        full = cap < F.col("weight") * level
        given, weight, count = rows.agg(
            F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if count == held or not weight:
            break
        level, held = (all_words - (given or 0)) / weight, count
    return rows.select("src", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def expected(words_of: Sequence[int], weight: Sequence[float], target: float, most: int = MOST) -> list[float]:
    """How often each class is expected: in proportion to `weight`, at most `most` times, so that
    the classes' words add up to `target`."""
    full: set[int] = set()
    while True:
        rest = [i for i in range(len(words_of)) if i not in full and words_of[i]]
        base = sum(weight[i] * words_of[i] for i in rest)
        level = (target - most * sum(words_of[i] for i in full)) / base if base else 0.0
        over = {i for i in rest if level * weight[i] > most}
        if not over:
            return [
                float(most) if i in full else max(0.0, level * weight[i]) if words_of[i] else 0.0
                for i in range(len(words_of))
            ]
        full |= over


def _strata(versions: DataFrame, aims: DataFrame, most: int, tilt: float) -> DataFrame:
    """Per source and class of lengths how many copies are certain and what chance the next one has.

    Also per source the words left to chance, the mean chance, and the documents that have one.
    """
    classes = versions.groupBy("src", "length").agg(
        F.sum("rows").alias("docs"), F.sum(F.col("rows") * F.col("size")).alias("words")
    ).join(if_few(aims), "src")

    def solve(source: pa.Table) -> pa.Table:
        lengths, n, own = (source.column(c).to_pylist() for c in ("length", "docs", "words"))
        number = expected(own, [2.0 ** (-tilt * k) for k in lengths], source.column("target")[0].as_py(), most)
        whole = [int(c + _ALMOST) for c in number]
        chance = [c - w if c - w > _ALMOST else 0.0 for c, w in zip(number, whole, strict=True)]
        drawn = sum(k for k, p in zip(n, chance, strict=True) if p)
        mean = sum(k * p for k, p in zip(n, chance, strict=True)) / drawn if drawn else 0.5
        left = sum(k * p for k, p in zip(own, chance, strict=True))
        rows = source.num_rows
        return pa.table({
            **{c: source.column(c) for c in ("src", "length", "source_size", "target")},
            "whole": pa.array(whole, pa.int64()), "chance": chance,
            "left": [left] * rows, "mean": [mean] * rows, "drawn": pa.array([drawn] * rows, pa.int64()),
        })

    return classes.groupBy("src").applyInArrow(
        solve, "src string, length int, source_size long, target double, whole long, chance double, "
        "`left` double, mean double, drawn long"
    )


def _odds(p: Column) -> Column:
    return p / (1 - p)


def _ranked(versions: DataFrame, strata: DataFrame, seed: int) -> DataFrame:
    """Versions with their rank, from 0 to 1, and the range of ranks it is in.

    Ranks are random odds over inclusion odds, scaled by a source's mean odds to fill the ranges
    evenly, which keeps their order within the source.
    """
    hashed = F.xxhash64(F.lit(seed), "src", "doc_id", "text_key")
    uniform = (F.shiftrightunsigned(hashed, 11) + 0.5) / F.lit(float(1 << 53))
    quotient = _odds(uniform) / _odds(F.col("chance")) * _odds(F.col("mean"))
    ranges = F.greatest(F.lit(1), F.floor(F.col("drawn") / RANGE_ROWS))
    rank = F.when(F.col("chance") > 0, quotient / (1 + quotient))
    return (
        versions.join(if_few(strata), ["src", "length"])
        .withColumn("rank", rank)
        .withColumn("range", F.least(F.floor(F.col("rank") * ranges), ranges - 1).cast("long"))
    )


def _exchange(
    sizes: list[int], rows: list[int], taken: list[int], left: float
) -> tuple[int | None, int | None]:
    """Which row to give back and which to take instead, either or none, to come nearest to `left`."""
    first: dict[int, int] = {0: -1}  # of each size, the first version with a row to take
    for i, n in enumerate(taken):
        if n < rows[i]:
            first.setdefault(sizes[i], i)
    offered = sorted(first)
    best, choice = abs(left), (None, None)
    for i in [None, *(i for i, n in enumerate(taken) if n)]:
        wanted = left + (0 if i is None else sizes[i])
        at = bisect_left(offered, wanted)
        for size in offered[max(0, at - 1):at + 1]:
            if abs(wanted - size) < best:
                best, choice = abs(wanted - size), (i, first[size] if size else None)
    return choice


def _filled(zone: DataFrame) -> DataFrame:
    """`zone` with how many rows of each version are taken.

    In order of rank, a version gives as many rows as still fit; at the end single rows are added
    or exchanged as long as that brings the source nearer to its target. A zone is some hundred versions.
    """

    def fill(source: pa.Table) -> pa.Table:
        source = source.sort_by([("rank", "ascending"), ("doc_id", "ascending"), ("text_key", "ascending")])
        sizes, rows = source.column("size").to_pylist(), source.column("rows").to_pylist()
        left, taken = source.column("open")[0].as_py(), []
        for size, most in zip(sizes, rows, strict=True):
            n = min(most, int(left // size))
            taken.append(n)
            left -= n * size
        for _ in range(EXCHANGES):
            give, get = _exchange(sizes, rows, taken, left)
            if give is None and get is None:
                break
            for i, n in ((give, -1), (get, 1)):
                if i is not None:
                    taken[i] += n
                    left -= n * sizes[i]
        return source.append_column("taken_rows", pa.array(taken, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in zone.schema)
    return zone.groupBy("src").applyInArrow(fill, f"{fields}, taken_rows long")


def plan(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0,
    tilt: float = TILT, seed: int = 0,
) -> DataFrame:
    """What the mix takes of every version of (doc_id, source, text).

    Returns src, doc_id, text_key, size, rows (that are equal in these), source_size, target, whole
    (copies that each of the rows gives) and taken_rows (how many of them give one more). The draw
    depends on seed, source, id and text alone, so reruns agree.
    """
    versions = stored(_versions(docs), "versions")
    sizes = versions.groupBy("src").agg(F.sum(F.col("rows") * F.col("size")).alias("source_size"))
    strata = stored(_strata(versions, stored(targets(sizes, weights, most, share), "targets"), most, tilt), "strata")
    ranked = _ranked(versions, strata, seed)
    drawn = ranked.filter("chance > 0")
    sums = drawn.groupBy("src", "range").agg(
        F.sum(F.col("rows") * F.col("size")).alias("n"), F.first("left").alias("left")
    )
    found = running(stored(sums, "ranges-of-ranks"), "src", "range", "n", bits=40)
    cut = found.filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
    cut = stored(cut.select("src", F.col("range").alias("cut"), (F.col("left") - F.col("before")).alias("open")), "cuts")
    met = ranked.join(if_few(cut), "src", "left")
    in_zone = (F.col("chance") > 0) & (F.col("range") >= F.col("cut")) & (F.col("range") <= F.col("cut") + 1)
    out = ["src", "doc_id", "text_key", "size", "rows", "source_size", "target", "whole", "taken_rows"]
    taken = F.when((F.col("chance") > 0) & (F.col("range") < F.col("cut")), F.col("rows")).otherwise(0)
    clear = met.filter(~F.coalesce(in_zone, F.lit(False))).withColumn("taken_rows", taken)
    return clear.select(*out).unionByName(_filled(met.filter(in_zone)).select(*out))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) of every row of documents.

    A missing text is empty, has no words and is never taken; missing sources are one source, the
    last. Rows equal in id, source and text draw one rank together; how many of them are taken may
    end within them. An empty table gives no rows. Options are those of `plan`.
    """
    rows = repeated(stored(plan(docs, **options), "mix"), "rows")
    copies = F.col("whole") + (F.col("copy") < F.col("taken_rows")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with their columns, as often as the mix takes them."""
    key, src, doc, whole, some, n, copy = free_names(docs, "key", "src", "doc", "whole", "some", "n", "copy")
    found = plan(docs, **options).select(
        F.col("src").alias(src), F.col("doc_id").alias(doc), F.col("text_key").alias(key),
        F.col("whole").alias(whole), "taken_rows", "rows",
    )
    partly = (F.col("taken_rows") > 0) & (F.col("taken_rows") < F.col("rows"))
    found = found.select(
        src, doc, key, F.when(partly, F.col(whole)).otherwise(F.col(whole) + (F.col("taken_rows") > 0).cast("long"))
        .alias(whole), F.when(partly, F.col("taken_rows")).alias(some),
    )
    rows = docs.select(
        "*", F.xxhash64(F.col("text").cast("string")).alias(f"{key}_"), _source(F.col("source")).alias(f"{src}_")
    )
    met = rows.join(found, (F.col("doc_id").cast("long").eqNullSafe(F.col(doc)))
                    & (F.col(f"{key}_") == F.col(key)) & (F.col(f"{src}_") == F.col(src)))
    # The last version that a source gives in part, if it has rows to number at all.
    number = F.row_number().over(Window.partitionBy(src, doc, key).orderBy(F.lit(0)))
    met = met.filter(F.col(some).isNull()).withColumn(n, F.col(whole)).unionByName(
        met.filter(F.col(some).isNotNull()).withColumn(n, F.col(whole) + (number <= F.col(some)).cast("long"))
    )
    return repeated(met, n, copy).select(*map(quoted, docs.columns))
