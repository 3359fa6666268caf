"""Fill-in-middle by piece tables.

Texts stay where they are, in one buffer per slice of rows; next to it lies a buffer with the
sentinels. A document is a list of descriptors (buffer, start, length) over the two. Cutting splits
a descriptor, an arrangement permutes the parts and puts sentinels before them, and the inverse
permutation brings the text back. Digests are fed one descriptor after the other, so hashing
makes no copy of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import slices

SENTINELS = (b"<P>", b"<S>", b"<M>")  # of prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = range(3)
# Per form, which part stands at each place.
ARRANGED = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLAIN = "plain"
READING_ORDER = (PREFIX, MIDDLE, SUFFIX)

PLAIN_FROM = 90  # of 100 drawn numbers, those from here on leave a document as it is
SPM_BELOW = 20  # of 100 drawn numbers, those below put the suffix first

_BLOCK = 4096  # bytes per entry of a directory of marks

TEXT, SENTINEL = 0, 1  # buffers
_PIECES = "array<struct<buffer: int, start: long, length: long>>"


@dataclass(frozen=True)
class Piece:
    """`length` bytes of a buffer from `start` on."""

    buffer: int
    start: int
    length: int

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.buffer, self.start, at), Piece(self.buffer, self.start + at, self.length - at)


def arrange(parts: Sequence[Piece], form: str) -> list[Piece]:
    """Prefix, suffix and middle in the order of a form, a sentinel before each."""
    out = []
    for part in ARRANGED[form]:
        out += [Piece(SENTINEL, 3 * part, 3), parts[part]]
    return out


def restore(pieces: Sequence[Piece], form: str) -> list[Piece]:
    """The inverse of `arrange`: the parts as they followed each other in the text."""
    placed = dict(zip(ARRANGED[form], pieces[1::2], strict=True))
    return [placed[part] for part in READING_ORDER]


def cut_output(whole: Piece, form: str, buffer: bytes) -> list[Piece]:
    """An output's descriptors, cut at its sentinels; none of them can be in a part."""
    pieces, rest = [], whole
    for part in ARRANGED[form]:
        at = buffer.index(SENTINELS[part], rest.start, rest.start + rest.length) - rest.start
        before, rest = rest.split(at)
        sentinel, rest = rest.split(3)
        pieces += [before, sentinel]
    return [*pieces[1:], rest]  # nothing stands before the first sentinel


def digest(pieces: Sequence[Piece], buffers: Sequence[memoryview]) -> str:
    """Hexadecimal SHA-256 of what the descriptors show, streamed."""
    state = hashlib.sha256()
    for p in pieces:
        state.update(buffers[p.buffer][p.start:p.start + p.length])
    return state.hexdigest()


def shown(pieces: Sequence[Piece], buffers: Sequence[memoryview]) -> bytes:
    return b"".join(buffers[p.buffer][p.start:p.start + p.length] for p in pieces)


class Marks:
    """Marked bytes of a buffer: how many lie before a place, and where the k-th one is.

    Counts per block make both cheap without a list of all marked places.
    """

    def __init__(self, marked: np.ndarray):
        self.marked = marked
        starts = np.arange(0, max(1, len(marked)), _BLOCK)
        counts = np.add.reduceat(marked, starts, dtype=np.int64) if len(marked) else np.zeros(1, np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, place: int) -> int:
        block = place // _BLOCK
        return int(self.before[block]) + int(np.count_nonzero(self.marked[block * _BLOCK:place]))

    def select(self, k: int) -> int:
        """The place of mark number k, from 0; the buffer's length if there are no more than k."""
        if k >= self.before[-1]:
            return len(self.marked)
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(self.marked[block * _BLOCK:(block + 1) * _BLOCK])
        return block * _BLOCK + int(inside[k - int(self.before[block])])


def _buffer(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of a column in one buffer, and where each begins and the last ends."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int64)[column.offset]) if len(column) else 0
    return (data.to_pybytes() if data else b"")[first:first + int(edges[-1])], edges


def _marks(buffer: bytes, edges: np.ndarray) -> tuple[Marks, Marks]:
    """First bytes of code points, and of units: runs of ASCII letters, and other code points."""
    data = np.frombuffer(buffer, np.uint8)
    points = (data & 0xC0) != 0x80
    lower = data | 0x20
    letter = (lower >= ord("a")) & (lower <= ord("z"))  # no byte of a longer code point is in there
    follows = np.zeros(len(data), bool)
    follows[1:] = letter[1:] & letter[:-1]
    begins = edges[:-1]
    follows[begins[begins < len(data)]] = False  # a run ends with its document
    return Marks(points), Marks(points & ~follows)


def draws(key: Column) -> list[Column]:
    """Four numbers of 32 bits, drawn from the hash of a document's id; a missing id counts as ''."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arranged(docs: DataFrame, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """Every document of (doc_id, text) with its descriptors and its output.

    Returns doc_id, n (units of the text), form, prefix_chars and middle_chars (missing if plain),
    pieces (descriptors, in bytes of the text or of the sentinels `<P><S><M>`), output and
    output_sha256. A missing text is an empty one; empty texts and those that hold a sentinel stay
    plain. Whatever else a table has is left behind; equal rows give equal rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.array(*draws(F.col("doc_id").cast("long"))).alias("drawn"),
    )
    sentinels = memoryview(b"".join(SENTINELS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buffer, edges = _buffer(batch.column("text"))
            points, units = _marks(buffer, edges)
            buffers = (memoryview(buffer), sentinels)
            drawn = np.asarray(batch.column("drawn").flatten()).reshape(-1, 4)
            out = {name: [] for name in ("n", "form", "prefix_chars", "middle_chars", "pieces", "output", "sha")}
            for row, (start, stop) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                first = units.rank(start)
                n = units.rank(stop) - first
                h1, h2, h3, h4 = drawn[row].tolist()
                pieces, form, chars = [Piece(TEXT, start, stop - start)], PLAIN, (None, None)
                held = any(buffer.find(s, start, stop) >= 0 for s in SENTINELS)
                if n and not held and h3 % 100 < plain_from:
                    form = "spm" if h4 % 100 < spm_below else "psm"
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    to, end = (min(stop, units.select(first + k)) for k in (a, b))
                    prefix, rest = pieces[0].split(to - start)
                    middle, suffix = rest.split(end - to)
                    at, mid, last = (points.rank(p) for p in (start, to, end))
                    chars = (mid - at, last - mid)
                    pieces = arrange((prefix, suffix, middle), form)
                out["n"].append(n)
                out["form"].append(form)
                out["prefix_chars"].append(chars[0])
                out["middle_chars"].append(chars[1])
                out["pieces"].append([
                    {"buffer": p.buffer, "start": p.start - (start if p.buffer == TEXT else 0), "length": p.length}
                    for p in pieces
                ])
                out["output"].append(shown(pieces, buffers))
                out["sha"].append(digest(pieces, buffers))
            piece = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(out["n"], pa.int64()), pa.array(out["form"], pa.string()),
                    pa.array(out["prefix_chars"], pa.int64()), pa.array(out["middle_chars"], pa.int64()),
                    pa.array(out["pieces"], pa.list_(piece)),
                    pa.array(out["output"], pa.binary()).cast(pa.string()), pa.array(out["sha"], pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"],
            )

    return rows.mapInArrow(
        task,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
        f"pieces {_PIECES}, output string, output_sha256 string",
    )


def restored(outputs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with restored and restored_sha256, made from `output` and `form` alone.

    An output that is not of its form, one without its sentinels, fails the task. A missing output
    is an empty text.
    """
    schema = ", ".join(f"`{c}` {outputs.schema[c].dataType.simpleString()}" for c in keep)
    rows = outputs.select(F.col("output").alias("_output"), F.col("form").alias("_form"), *keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_output"):
            buffer, edges = _buffer(batch.column("_output"))
            buffers = (memoryview(buffer),)
            texts, digests = [], []
            for form, start, stop in zip(
                batch.column("_form").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True
            ):
                pieces = [Piece(TEXT, start, stop - start)]
                if form in ARRANGED:
                    pieces = restore(cut_output(pieces[0], form, buffer), form)
                texts.append(shown(pieces, buffers))
                digests.append(digest(pieces, buffers))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                names=[*keep, "restored", "restored_sha256"],
            )

    return rows.mapInArrow(task, f"{schema}, restored string, restored_sha256 string")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of every output and of the text
    that was made again from it."""
    keep = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    return restored(arranged(docs), keep).drop("restored")
