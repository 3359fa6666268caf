"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text's paragraphs are cut after words whose hash says so (about every eighth), so that an edit
changes the digests around it and no others. Every digest, told apart by how often it occurred
before, is added to one cell in each of three parts of a table; a cell has the count, the
exclusive or of the digests and that of their checks. The tables of two texts are subtracted, and
cells that hold a single digest are peeled until all are empty: what was peeled are the digests of
one text that the other lacks. Where cells are left over, both tables are built anew four times as
large. All texts of a slice of a batch are treated together, as arrays.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import keyed, mix, slices

CELLS = 12  # of the table that is returned as a fingerprint
PARTS = 3
GROWTH = 4
CUT_MASK = np.uint64(7)
BUCKETS = 512  # ranges of doc_id that are walked through in order
KNOWN_WORDS = 300_000

_BREAK = np.uint64(0)  # stands for the end of a paragraph
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
_CHECK = np.uint64(0x452821E638D01377)


class WordHashes(dict):
    """Hashes of words, remembered; never that of a break."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = (xxhash.xxh3_64_intdigest(word) or 1) if word != b"\n" else 0
        return value


def digests(texts: Sequence[str], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, digest) of every piece; equal pieces of a text get different digests."""
    words = [t.encode().replace(b"\n", b" \n ").split(b" ") for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    total = int(count.sum())
    flat = (w for ws in words for w in ws)
    hashes = np.fromiter(map(known.__getitem__, flat), np.uint64, total)
    owner = np.repeat(np.arange(len(texts)), count)

    ends = (hashes == _BREAK) | ((mix(hashes) & CUT_MASK) == 0)
    last = np.cumsum(count) - 1
    ends[last[count > 0]] = True
    stops = np.flatnonzero(ends)
    starts = np.concatenate([[0], stops[:-1] + 1]).astype(np.int64)
    place = np.arange(total, dtype=np.int64) - np.repeat(starts, stops - starts + 1)
    # A polynomial in the place within the piece; powers are looked up, pieces are short.
    power = np.full(int(place.max(initial=0)) + 1, _BASE)
    power[:1] = 1
    power = np.cumprod(power, dtype=np.uint64)
    found = np.add.reduceat(mix(hashes + _CHECK) * power[place], starts) if total else hashes
    empty = (stops == starts) & (hashes[starts] == _BREAK)
    empty |= (stops == starts) & (hashes[starts] == np.uint64(known[b""]))
    owner, found = owner[starts][~empty], mix(found)[~empty]

    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(found))
    before = at - np.maximum.accumulate(np.where(first, at, 0))
    return owner, mix(found + before.astype(np.uint64) * _BASE)


class Tables:
    """A table for each of `n` texts, in one array per kind of field."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.count = np.zeros(n * cells, np.int32)
        self.keys = np.zeros(n * cells, np.uint64)
        self.checks = np.zeros(n * cells, np.uint32)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> "Tables":
        each = self.cells // PARTS
        check = _check(keys)
        for part, seed in enumerate(_SEEDS):
            cell = owner * self.cells + part * each + (mix(keys ^ seed) % np.uint64(each)).astype(np.int64)
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.keys, cell, keys)
            np.bitwise_xor.at(self.checks, cell, check)
        return self

    def minus(self, other: "Tables") -> "Tables":
        out = Tables(0, self.cells)
        out.count = self.count - other.count
        out.keys, out.checks = self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def as_text(self, i: int) -> str:
        here = slice(i * self.cells, (i + 1) * self.cells)
        fields = (self.count[here].astype("<i4"), self.keys[here].astype("<u8"),
                  self.checks[here].astype("<u4"))
        return base64.b64encode(b"".join(f.tobytes() for f in fields)).decode()


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + _CHECK) >> np.uint64(32)).astype(np.uint32)


def peel(difference: Tables, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, digest, sign) of what was recovered, and which of the `n` tables came out empty."""
    out = []
    look = np.flatnonzero(difference.count)
    while len(look):
        count = difference.count[look]
        pure = (np.abs(count) == 1) & (_check(difference.keys[look]) == difference.checks[look])
        cells = look[pure]
        if not len(cells):
            break
        owner, keys, sign = cells // difference.cells, difference.keys[cells], difference.count[cells]
        order = np.lexsort((keys, owner))  # one digest may stand alone in several cells
        owner, keys, sign = owner[order], keys[order], sign[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        owner, keys, sign = owner[new], keys[new], sign[new]
        difference.add(owner, keys, -sign)
        out.append((owner, keys, sign))
        look = look[difference.count[look] != 0]
    rest = (difference.count != 0) | (difference.keys != 0) | (difference.checks != 0)
    empty = ~rest.reshape(n, difference.cells).any(axis=1)
    kinds = (np.int64, np.uint64, np.int32)
    owner, keys, sign = (
        np.concatenate([o[i] for o in out]) if out else np.array([], kind)
        for i, kind in enumerate(kinds)
    )
    return owner, keys, sign, empty


def _of(owner, keys, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the chosen texts, these numbered anew."""
    number = np.full(n, -1)
    number[chosen] = np.arange(len(chosen))
    held = number[owner] >= 0
    return number[owner[held]], keys[held]


def likeness(a, b, n: int) -> np.ndarray:
    """Shared share of the digests of `n` pairs of texts, from what peeling recovers.

    `a` and `b` are (owner, digest) arrays. Two texts without digests are alike.
    """
    n_a, n_b = (np.bincount(x[0], minlength=n) for x in (a, b))
    only_a, only_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, cells = np.arange(n), CELLS
    while len(left):
        # A table with fewer cells than the two counts differ by cannot be peeled.
        now = left[np.abs(n_a[left] - n_b[left]) <= cells]
        if len(now):
            tables = [Tables(len(now), cells).add(*_of(*x, now, n)) for x in (a, b)]
            owner, _, sign, empty = peel(tables[0].minus(tables[1]), len(now))
            for only, s in ((only_a, 1), (only_b, -1)):
                found = np.bincount(owner[sign == s], minlength=len(now))
                only[now[empty]] = found[empty]
            left = np.setdiff1d(left, now[empty], assume_unique=True)
        cells *= GROWTH
    union = n_a + only_b
    return np.where(union > 0, (n_a - only_a) / np.maximum(union, 1), 1.0)


# --- over a table -----------------------------------------------------------------------------

FIELDS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


def _compare(ids: list, texts: list[str], following: list[str], known: WordHashes):
    edited = [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(texts, following, strict=True)]
    n = len(texts)
    own, changed, nexts = (digests(x, known) for x in (texts, edited, following))
    first, second = (Tables(n, CELLS).add(*x) for x in (own, changed))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()),
        pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array([first.as_text(i) for i in range(n)], pa.string()),
        pa.array([second.as_text(i) for i in range(n)], pa.string()),
        pa.array(likeness(own, changed, n)),
        pa.array(likeness(own, nexts, n)),
    ], names=[f.split()[0] for f in FIELDS.split(", ")])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range after the other, each followed by the first row of the next range."""
    known, held = WordHashes(), None  # held: the row whose follower has not come yet
    for batch in slices(batches, most=4 << 20):
        ids, texts, following = [], [], []
        columns = (batch.column("doc_id").to_pylist(),
                   pc.fill_null(batch.column("text"), "").to_pylist(),
                   batch.column("head").to_pylist(), batch.column("range").to_pylist())
        for doc, text, head, place in zip(*columns, strict=True):
            if held is not None and held[2] == place:
                ids.append(held[0])
                texts.append(held[1])
                following.append(text)
            held = None if head else (doc, text, place)
        if ids:
            yield _compare(ids, texts, following, known)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they are.

    The documents follow each other by descending doc_id; rows without one come last, and rows
    with the same one go by the hash of their texts. After the last comes the first; a single
    document follows itself. A missing text is empty. Repeated rows are documents like others. An
    empty table gives no rows. Other columns do not matter.

    The order is cut into ranges of ids at approximate percentiles, so texts are moved once; of
    each range, the first row is also sent to the range before.
    """
    rows = keyed(docs)
    steps = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = rows.agg(F.percentile_approx("doc_id", steps, 100_000)).first()[0] or []
    cuts = sorted(set(cuts))
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    ranged = rows.withColumn("range", F.when(F.col("doc_id").isNull(), BUCKETS).otherwise(above))

    first = F.min(F.struct(F.coalesce(-F.col("doc_id"), F.lit(0)).alias("minus"), "text_key", "doc_id"))
    heads = sorted(ranged.groupBy("range").agg(first.alias("first")).collect())  # <= BUCKETS + 1
    spark = docs.sparkSession
    targets = spark.createDataFrame(
        [(h["first"]["doc_id"], h["first"]["text_key"], heads[i - 1]["range"])
         for i, h in enumerate(heads)],
        "head_id long, head_key long, target int",
    )
    known_ids = [h["first"]["doc_id"] for h in heads if h["first"]["doc_id"] is not None]
    extra = (
        rows.filter(F.col("doc_id").isin(known_ids) | F.col("doc_id").isNull())
        .join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("head_id"))
              & (F.col("text_key") == F.col("head_key")))
        .select("doc_id", "text", "text_key", F.col("target").alias("range"), F.lit(True).alias("head"))
    )
    both = ranged.select("doc_id", "text", "text_key", "range", F.lit(False).alias("head")).unionByName(extra)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, "range").sortWithinPartitions(
        "range", "head", F.desc_nulls_last("doc_id"), "text_key"
    )
    return ordered.select("doc_id", "text", "range", "head").mapInArrow(_in_order, FIELDS)
