"""Removal of byte strings that occur more than once, by sorted suffixes.

A string of `length` bytes is judged by the suffixes that start at its anchors. Anchors are the
places whose hash of `GRAM` bytes is smallest among those of some string of that length, so equal
strings have equal anchors at equal places. Only anchors whose hash occurs at another place too
are looked at again: a class is all places with one hash, each with the bytes around it.

Within a class the right-hand contexts are sorted as suffixes, and the left-hand ones, read
backwards, as well: a mergesort whose comparisons find the common extension of two suffixes by
binary search over their prefix hashes, so a comparison takes a logarithmic number of steps. The
common extensions of neighbours in each order are verified byte by byte, which exposes colliding
hashes. A string that has o bytes before its anchor occurs again if another member of the class
agrees in o bytes to the left and the rest to the right, that is, if both lie in one block of
either order cut where neighbours agree in fewer.

Equal texts, and equal contexts of a class, are counted first and take part once. A class that
still has very many different contexts is settled by counting hashes of its strings instead: of
the bytes that a few neighbouring strings share, and where these occur twice, of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import if_few, keyed, list_array, mix, slices, stored, text_bytes

LENGTH = 200
GRAM = 100  # half the length: shorter lines that very many texts share have no anchor of their own
LARGE = 1024  # different contexts from which a class is counted instead of sorted
CELL = 16  # neighbouring strings that are counted together
STRETCH = 1 << 19  # bytes of a text that are hashed at a time
MEMBERS = 8192  # members of classes that are sorted together

_RNG = np.random.default_rng(200)
_BYTE = _RNG.integers(1, 1 << 63, 257).astype(np.uint64)  # the last stands for the end
_BASE = 0x9E3779B97F4A7C15


# --- anchors ----------------------------------------------------------------------------------

@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        power = np.full(n, base, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power, dtype=np.uint64))
    return out[0], out[1]


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of `gram` bytes, from prefix hashes."""
    power, inverse = _powers(STRETCH + 4 * LENGTH + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:len(data)], out=prefix[1:])
    found = (prefix[gram:] - prefix[:-gram]) * inverse[:len(data) - gram + 1]
    return mix(found)


def _sliding(values: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """`pick` (minimum or maximum) of every run of `width` values."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, fill, values.dtype)
    padded[:len(values)] = values
    padded = padded.reshape(blocks, width)
    before = pick.accumulate(padded, axis=1).ravel()
    after = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(after[:n], before[width - 1:width - 1 + n])


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all strings of `length` bytes, in order."""
    places, hashes = [np.array([], np.int64)], [np.array([], np.uint64)]
    width = length - gram + 1
    for start in range(0, len(data) if len(data) >= length else 0, STRETCH):
        low = max(0, start - length)
        part = np.frombuffer(data, np.uint8, min(len(data), start + STRETCH + length) - low, low)
        if len(part) < length:
            continue
        found = _grams(part, gram)
        smallest = _sliding(found, width, np.minimum, np.uint64(2**64 - 1))
        around = np.zeros(len(smallest) + 2 * (width - 1), np.uint64)
        around[width - 1:width - 1 + len(smallest)] = smallest
        at = np.flatnonzero(_sliding(around, width, np.maximum, np.uint64(0)) == found)
        here = at[(at + low >= start) & (at + low < start + STRETCH)]
        places.append(here + low)
        hashes.append(found[here])
    return np.concatenate(places), np.concatenate(hashes)


def _find_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = text_bytes(batch.column("text"))
            found = [anchors(t, length, gram) for t in texts]
            count = np.array([len(f[0]) for f in found])
            places = np.concatenate([f[0] for f in found])
            hashes = np.concatenate([f[1] for f in found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                list_array(pa.array(places), count), list_array(pa.array(hashes), count),
            ], names=["doc_id", "text_key", "n_bytes", "sha256", "places", "hashes"])

    return rows.mapInArrow(find, (
        "doc_id long, text_key long, n_bytes long, sha256 string, places array<long>, hashes array<long>"
    ))


def _contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, place, class, before, size, context, context_key) for the listed anchors of each text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            out = []
            columns = (batch.column("row").to_pylist(), text_bytes(batch.column("text")),
                       batch.column("held").to_pylist())
            for row, data, held in zip(*columns, strict=True):
                for anchor in held:
                    place = anchor["place"]
                    low = max(0, place - (length - gram))
                    context = data[low:place + length]
                    out.append((row, place, anchor["hash"], place - low, len(context), context,
                                xxhash.xxh3_64_intdigest(context, seed=place - low) - (1 << 63)))
                    if len(out) == 1 << 15:
                        yield _context_batch(out)
                        out = []
            if out:
                yield _context_batch(out)

    return rows.select("row", "text", "held").mapInArrow(cut, (
        "row long, place long, class long, before int, size int, context binary, context_key long"
    ))


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
    names = ["row", "place", "class", "before", "size", "context", "context_key"]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


# --- sorted suffixes --------------------------------------------------------------------------

class Suffixes:
    """Strings, each of a class, compared by class first; prefix hashes of all lengths are kept."""

    def __init__(self, classes: np.ndarray, strings: list[bytes]):
        self.classes = classes
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        width = int(self.size.max(initial=0))
        flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8)
        self.bytes = np.full((len(strings), width + 1), 256, np.int16)
        self.bytes[:, :width] = flat.reshape(len(strings), width)
        self.bytes[np.arange(width + 1)[None, :] >= self.size[:, None]] = 256
        self.prefix = np.zeros((len(strings), width + 1), np.uint64)
        power = _powers(STRETCH + 4 * LENGTH + 1)[0][:width]
        np.cumsum(_BYTE[self.bytes[:, :width]] * power, axis=1, out=self.prefix[:, 1:])

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that the strings have in common from their start, by binary search."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.size[i], self.size[j])
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefix[i, middle] == self.prefix[j, middle]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Negative, zero or positive; a string comes after its extensions."""
        out = np.sign(self.classes[i].astype(np.int64) - self.classes[j])
        same = np.flatnonzero(out == 0)
        x, y = i[same], j[same]
        at = self.extension(x, y)
        out[same] = self.bytes[x, at] - self.bytes[y, at].astype(np.int64)
        return out

    def order(self) -> np.ndarray:
        """The strings in order: a bottom-up mergesort, all merges of a level at once."""
        n = len(self.size)
        order, place, width = np.arange(n), np.arange(n), 1
        while width < n:
            left = (place // width) % 2 == 0
            sibling = np.where(left, (place // width + 1) * width, (place // width - 1) * width)
            low = np.minimum(sibling, n)
            end = high = np.minimum(low + width, n)
            begin = low
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                beside = self.compare(order[middle], order[open_])
                goes = (beside < 0) | ((beside == 0) & ~left[open_])
                low, high = low.copy(), high.copy()
                low[open_] = np.where(goes, middle + 1, low[open_])
                high[open_] = np.where(goes, high[open_], middle)
            start = place // (2 * width) * (2 * width)
            merged = np.empty_like(order)
            merged[start + place % width + (low - begin)] = order
            order, width = merged, 2 * width
            del end
        return order

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """The order, and what each string has in common with the one before; verified."""
        order = self.order()
        before, after = order[:-1], order[1:]
        common = np.where(self.classes[before] == self.classes[after], self.extension(before, after), -1)
        self.verify(before, after, common)
        return order, np.concatenate([[-1], common])

    def verify(self, before: np.ndarray, after: np.ndarray, common: np.ndarray) -> None:
        width = self.bytes.shape[1]
        inside = np.arange(width)[None, :] < common[:, None]
        differ = ((self.bytes[before] != self.bytes[after]) & inside).any(axis=1)
        if differ.any():  # equal hashes of different bytes
            raise HashCollision


class HashCollision(Exception):
    """Two different strings had equal hashes."""


class PlainSuffixes(Suffixes):
    """The same without hashes, for the rare batch in which they collided."""

    def extension(self, i, j):
        differ = self.bytes[i] != self.bytes[j]
        limit = np.minimum(self.size[i], self.size[j])
        return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), limit), limit)


def _blocks(classes: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    try:
        return Suffixes(classes, strings).blocks()
    except HashCollision:
        return PlainSuffixes(classes, strings).blocks()


def repeated(
    classes: np.ndarray, before: np.ndarray, contexts: list[bytes], length: int, gram: int
) -> tuple[np.ndarray, np.ndarray]:
    """Least and most bytes before the anchor in strings that occur again; (1, 0) if none does."""
    n = len(contexts)
    right = _blocks(classes, [c[b:] for c, b in zip(contexts, before, strict=True)])
    left = _blocks(classes, [c[:b][::-1] for c, b in zip(contexts, before, strict=True)])
    least, most = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    blocks = []
    for o in range(length - gram + 1):
        blocks = []
        for (order, common), need in ((left, o), (right, length - o)):
            block = np.empty(n, np.int64)
            block[order] = np.cumsum(common < need)
            blocks.append(block)
        key = blocks[0] * (n + 1) + blocks[1]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        again = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        least[again] = np.minimum(least[again], o)
        most[again] = o
    none = most < 0
    least[none], most[none] = 1, 0
    return least, most


def _sorted_classes(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, start, stop) of what occurs again; rows come class by class."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> pa.RecordBatch:
            classes = np.unique(table.column("class").to_numpy(), return_inverse=True)[1]
            before, place = (table.column(c).to_numpy() for c in ("before", "place"))
            least, most = repeated(classes, before, table.column("context").to_pylist(), length, gram)
            found = np.flatnonzero(most >= least)
            return pa.RecordBatch.from_arrays([
                pa.array(table.column("row").to_numpy()[found]),
                pa.array((place - most)[found]), pa.array((place - least + length)[found]),
            ], names=["row", "start", "stop"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < MEMBERS:
                continue
            table = pa.Table.from_batches(held)
            classes = table.column("class").to_numpy()
            # The last class may go on; what stands before it is complete.
            cut = int(np.flatnonzero(classes != classes[-1])[-1]) + 1 if (classes != classes[-1]).any() else 0
            for at in _cuts(classes[:cut]):
                yield settle(table.slice(*at))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            for at in _cuts(table.column("class").to_numpy()):
                yield settle(table.slice(*at))

    return rows.select("class", "row", "place", "before", "context").mapInArrow(
        search, "row long, start long, stop long"
    )


def _cuts(classes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of whole classes with about MEMBERS rows."""
    starts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]])) if len(classes) else []
    at = 0
    for start, stop in zip(starts, [*starts[1:], len(classes)], strict=True):
        if stop - at >= MEMBERS or stop == len(classes):
            yield at, int(stop) - at
            at = int(stop)
        del start


def _counted_classes(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for classes with very many contexts, by counts of hashes."""
    # Strings with o bytes before the anchor, o from low to high; those of a whole cell share `core`.
    o = F.col("cell") * CELL
    top = F.least(o + CELL - 1, F.lit(length - gram))
    core = F.substring("context", (F.col("before") - o + 1).cast("int"), (length - (top - o)).cast("int"))
    cells = rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit((length - gram) // CELL)))).select(
        "class", "row", "place", F.xxhash64("cell", core).alias("core"),
        F.greatest(o, length - (F.length("context") - F.col("before"))).alias("low"),
        F.least(top, F.col("before")).alias("high"),
    ).filter("low <= high")
    twice = cells.groupBy("class", "core").agg(F.count("*").alias("k")).filter("k > 1").select("class", "core")
    left = cells.join(twice, ["class", "core"]).select("row", "place", "low", "high")
    whole = rows.select("class", "row", "place", "before", "context").join(left, ["row", "place"])
    windows = whole.withColumn("o", F.explode(F.sequence("low", "high"))).withColumn(
        "string", F.substring("context", (F.col("before") - F.col("o") + 1).cast("int"), F.lit(length))
    ).select("class", "row", "place", "o", F.xxhash64("o", "string").alias("h1"), F.hash("string").alias("h2"))
    again = windows.groupBy("class", "h1", "h2").agg(F.count("*").alias("k")).filter("k > 1")
    found = windows.join(again, ["class", "h1", "h2"]).groupBy("row", "place").agg(
        F.min("o").alias("least"), F.max("o").alias("most")
    )
    return found.select("row", (F.col("place") - F.col("most")).alias("start"),
                        (F.col("place") - F.col("least") + length).alias("stop"))


# --- over a table -----------------------------------------------------------------------------

def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE
) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): every row with its size and digest, and what is repeated in the different texts.

    texts: row, doc_id, text_key, n_bytes, sha256, copies (rows with that text).
    spans: row, doc_id, text_key, and an array of (start, stop), in order, apart from each other;
    for one row of each different text, and none where a text of `length` bytes has copies: there
    everything is repeated.
    """
    rows = keyed(docs)
    found = stored(
        _find_anchors(rows, length, gram).withColumn("row", F.monotonically_increasing_id()), "anchors"
    )
    texts = found.drop("places", "hashes")
    same = texts.groupBy("sha256", "n_bytes").agg(F.min("row").alias("first"), F.count("*").alias("copies"))
    # null-safe keys are not needed: digests and sizes are always there
    named = stored(texts.join(same, ["sha256", "n_bytes"]), "texts")
    others = named.filter("row != first").select("row")
    pairs = found.filter(F.size("places") > 0).join(if_few(others), "row", "left_anti").select(
        "row", F.explode(F.arrays_zip("places", "hashes")).alias("x")
    ).select("row", F.col("x.places").alias("place"), F.col("x.hashes").alias("hash"))
    more = pairs.groupBy("hash").agg(F.count("*").alias("k")).filter("k > 1").select("hash")
    held = pairs.join(more, "hash").groupBy("row").agg(F.collect_list(F.struct("place", "hash")).alias("held"))
    held = stored(held.join(named.select("row", "doc_id", "text_key"), "row"), "shared-anchors")

    keys = held.select(F.col("doc_id").alias("key_id"), F.col("text_key").alias("key_text"), "row", "held")
    match = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_key") == F.col("key_text"))
    affected = rows.join(if_few(keys.select("key_id", "key_text")), match, "left_semi")
    with_anchors = _once(affected, named).join(keys, match)
    contexts = stored(_contexts(with_anchors, length, gram), "contexts")

    whole = contexts.groupBy("class", "context_key").agg(
        F.count("*").alias("k"), F.min(F.struct("row", "place")).alias("one")
    )
    whole = stored(whole, "context-counts")
    of_copies = contexts.drop("context").join(whole.filter("k > 1").select("class", "context_key"), ["class", "context_key"])
    equal = of_copies.filter(F.col("size") >= length).select(
        "row", (F.col("place") - F.col("before")).alias("start"),
        (F.col("place") - F.col("before") + F.col("size")).alias("stop"),
    )
    classes = whole.groupBy("class").agg(F.count("*").alias("contexts"), F.min("k").alias("fewest"))
    classes = classes.filter("contexts > 1 and fewest = 1").select("class", "contexts")
    chosen = whole.join(classes, "class").select(
        "contexts", F.col("one.row").alias("row"), F.col("one.place").alias("place")
    )
    live = stored(contexts.drop("context_key", "size").join(chosen, ["row", "place"]), "live-contexts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = live.filter(F.col("contexts") <= large).repartition(4 * parts, "class").sortWithinPartitions("class")
    spans = equal.unionByName(_sorted_classes(few, length, gram)).unionByName(
        _counted_classes(live.filter(F.col("contexts") > large), length, gram)
    )
    merged = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    unresolved = named.filter((F.col("copies") == 1) | (F.col("n_bytes") < length))
    joined = merged.withColumn("spans", _merged("spans")).join(
        unresolved.select("row", "doc_id", "text_key"), "row"
    )
    return named, stored(joined, "spans")


def _once(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """One row of each version of a document; nothing is moved where no version is repeated."""
    repeated = texts.groupBy("doc_id", "text_key").count().filter("count > 1")
    return rows if repeated.isEmpty() else rows.dropDuplicates(["doc_id", "text_key"])


def _merged(spans: str):
    """Sorted spans, with those that touch or overlap made one."""
    last = lambda done: F.element_at(done, -1)
    return F.aggregate(
        spans, F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                last(done)["start"].alias("start"),
                F.greatest(last(done)["stop"], s["stop"]).alias("stop"),
            ))),
        ).otherwise(F.concat(done, F.array(s))),
    )


def _kept(rows: DataFrame) -> DataFrame:
    """(row, n_removed, n_spans, kept_sha256) of the texts with spans."""
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            columns = (batch.column("row").to_pylist(), text_bytes(batch.column("text")),
                       batch.column("spans").to_pylist())
            for row, data, spans in zip(*columns, strict=True):
                digest, at, removed = hashlib.sha256(), 0, 0
                for s in spans:
                    digest.update(data[at:s["start"]])
                    at, removed = s["stop"], removed + s["stop"] - s["start"]
                digest.update(data[at:])
                out.append((row, removed, len(spans), digest.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["row", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.select("row", "text", "spans").mapInArrow(
        remove, "row long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of documents.

    Removed is each byte in a string of `length` bytes of UTF-8 that also starts elsewhere, in the
    same or another row; strings do not cross rows. Repeated rows are copies of each other. A
    missing text is empty and, like any shorter than `length`, stays as it is. An empty table
    gives no rows. Other columns do not matter.
    """
    texts, spans = repeated_spans(docs, length, gram, large)
    keys = spans.select(F.col("doc_id").alias("key_id"), F.col("text_key").alias("key_text"), "row", "spans")
    match = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_key") == F.col("key_text"))
    affected = keyed(docs).join(if_few(keys.select("key_id", "key_text")), match, "left_semi")
    kept = _kept(_once(affected, texts).join(keys, match))
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return texts.join(kept, "row", "left").select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
