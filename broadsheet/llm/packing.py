"""Best-fit packing of documents into sequences, planned by a linear grouping scheme.

A plan needs only how many pieces there are of each length, which are at most `capacity` numbers:

1. Lengths above `small_share` of the capacity are large. In descending order they are dealt into
   `groups` groups of equal cardinality, and each is rounded up to the largest of its group.
2. With so few sizes, all configurations (multisets of sizes that fit) can be listed. A linear
   program over them, solved by a small simplex, gives how often each is used, rounded down.
3. The real lengths take the places of the rounded ones, longest first.
4. Small lengths go, longest first, to the fullest sequence they fit in (best fit). So do large
   ones for which the program's rounded-down uses leave no place.
5. This is done for several group counts and bounds of "small"; the shortest plan is taken.

Sequences with equal contents are one line of the plan, so the plan grows with the number of
different lengths, not with the documents. Which piece takes which place is settled by its rank
among the pieces of its length, counted in salted parts so that one frequent length is no hot key.
"""

from __future__ import annotations

import itertools
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import Remembered, documents, of_worker, slices, stored

CAPACITY = 4096
# (groups, share of the capacity up to which a length is small); in the last, all are.
SCHEMES = ((8, 0.2), (16, 0.2), (32, 0.2), (32, 0.3), (0, 1.0))
END_ID = 1
SALT_ROWS = 50_000  # pieces in a part in which those of one length are ranked, about
KNOWN_WORDS = 1_000_000  # words whose ids a worker process remembers, about, at most
TOGETHER = 100  # words of letters that are encoded in one text
WORD_END = "</w>"  # ends the last piece of each word of the vocabulary
MARKS = "!#$%&()*+,-./:;=?@[]^{|}~"  # neither white space nor letters, nor part of a contraction

OTHER_STOP = re.compile(r"[,.](?<![A-Za-z0-9À-ÖØ-öø-ÿ][,.])(?: |$)")  # behind no plain letter or digit

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


class WordIds:
    """Little-endian ids of words, remembered.

    The tokenizer never joins across white space, nor letters with marks behind them, so a comma or
    full stop that ends a word is a word of its own. Words of letters are encoded many in one text, as each of them ends with a piece that is an end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self.known = Remembered(KNOWN_WORDS)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, "<u4") for f in found]

    def _learn_letters(self, words: list[str]) -> None:
        """Words of letters only; a group in which one is not a single word goes word by word."""
        for at in range(0, len(words), TOGETHER):
            group = words[at:at + TOGETHER]
            (ids,) = self._encoded([" ".join(group)])
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(group):
                raw, start = ids.tobytes(), 0
                for word, end in zip(group, ends.tolist(), strict=True):
                    self.known[word] = raw[start:end]
                    start = end
            else:
                for word, own in zip(group, self._encoded(group), strict=True):
                    self.known[word] = own.tobytes()

    def _unknown(self, words: set[str]) -> list[str]:
        """Those of the words that are not remembered; the others stay remembered."""
        known, old = self.known, self.known.old
        absent = [w for w in words if w not in known]
        known.update([(w, old[w]) for w in absent if w in old])
        return [w for w in absent if w not in old]

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words new to all of them are encoded together."""
        split = [_cut(t) for t in texts]
        words = set().union(*split)
        known = self.known
        known.make_room(len(words))
        new = self._unknown(words)
        parts = {w: cut for w in new if (cut := _parts(w)) is not None}
        wanted = {p for cut in parts.values() for p in cut} | {w for w in new if w not in parts}
        unknown = self._unknown(wanted)
        self._learn_letters([w for w in unknown if w.isalpha()])
        others = [w for w in unknown if not w.isalpha()]
        for word, ids in zip(others, self._encoded(others), strict=True):
            known[word] = ids.tobytes()
        for word, (stem, marks) in parts.items():
            known[word] = known[stem] + known[marks]
        return [b"".join(map(known.__getitem__, words)) for words in split]


def _word_ids(path: str) -> WordIds:
    """One per worker process, so that its tasks load the vocabulary and learn a word once."""
    return of_worker("word-ids", path, lambda: WordIds(path))


def _cut(text: str) -> list[str]:
    """The words of a text; where all commas and full stops that end one are behind a plain letter
    or digit, these are words of their own."""
    text = text.replace("\n", " ")
    if not OTHER_STOP.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


def _parts(word: str) -> tuple[str, str] | None:
    """A word of letters and the marks behind it, which are tokens of their own; or None."""
    stem = word.rstrip(MARKS)
    return (stem, word[len(stem):]) if stem and len(stem) < len(word) and stem.isalpha() else None


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut every `capacity` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, end = _word_ids(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches, most=2 << 20):
            rows = []
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.of_texts(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents(docs).mapInArrow(cut, PIECES)


# --- the plan -------------------------------------------------------------------------------

def _grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Large lengths, descending, in groups of equal cardinality: lists of [length, count]."""
    total = sum(counts.values())
    each, out, left = -(-total // groups) if total else 1, [], 0
    for length in sorted(counts, reverse=True):
        count = counts[length]
        while count:
            if not left:
                out.append([])
                left = each
            take = min(count, left)
            out[-1].append([length, take])
            count, left = count - take, left - take
    return out


def _configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """Every non-empty multiset of sizes that fits, as counts per size."""
    found = []
    most = capacity // min(sizes)
    for n in range(1, most + 1):
        for chosen in itertools.combinations_with_replacement(range(len(sizes)), n):
            if sum(sizes[i] for i in chosen) <= capacity:
                found.append(np.bincount(chosen, minlength=len(sizes)))
    return np.array(found)


def _solve(configurations: np.ndarray, demand: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fewest (fractional) uses of configurations that meet the demand: the simplex method."""
    n = len(sizes)
    alone = configurations * (np.count_nonzero(configurations, axis=1) == 1)[:, None]
    basis = np.argmax(alone, axis=0)  # for each size, the configuration with most of it alone
    for _ in range(50 * n):
        matrix = configurations[basis].T.astype(float)
        uses = np.linalg.solve(matrix, demand)
        price = np.linalg.solve(matrix.T, np.ones(n))
        worth = configurations @ price
        enter = int(np.argmax(worth))
        if worth[enter] <= 1 + 1e-9:
            break
        column = np.linalg.solve(matrix, configurations[enter].astype(float))
        ratio = np.where(column > 1e-12, uses / np.where(column > 1e-12, column, 1), np.inf)
        basis[int(np.argmin(ratio))] = enter
    x = np.zeros(len(configurations))
    x[basis] = np.maximum(np.linalg.solve(configurations[basis].T.astype(float), demand), 0)
    return x


def _uses(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, sizes' indexes with repeats) that together take no more than the demand."""
    configurations = _configurations(sizes, capacity)
    left, out = np.array(demand), []
    x = _solve(configurations, left, np.array(sizes))
    for c in np.flatnonzero(x):
        here = configurations[c]
        times = int(min(np.floor(x[c] + 1e-9), (left[here > 0] // here[here > 0]).min()))
        if times:
            left = left - times * here
            out.append((times, tuple(np.repeat(np.arange(len(sizes)), here))))
    return out


def plan(
    counts: dict[int, int], capacity: int = CAPACITY, schemes: Sequence[tuple[int, float]] = SCHEMES
) -> list[tuple[int, list[int]]]:
    """(number of sequences, lengths in each) for `counts` pieces per length; none exceed capacity."""
    plans = [_plan(counts, capacity, groups, share) for groups, share in schemes]
    return min(plans, key=lambda types: sum(t for t, _ in types))


def _plan(
    counts: dict[int, int], capacity: int, groups: int, small_share: float
) -> list[tuple[int, list[int]]]:
    bound = capacity * small_share
    rest = {k: n for k, n in counts.items() if k <= bound}
    large = _grouped({k: n for k, n in counts.items() if k > bound}, groups)
    types: list[tuple[int, list[int]]] = []
    if large:
        sizes = [g[0][0] for g in large]
        distinct = sorted(set(sizes), reverse=True)
        place = {s: i for i, s in enumerate(distinct)}
        runs: list[list[list[int]]] = [[] for _ in distinct]  # groups of one size are one
        for group, size in zip(large, sizes, strict=True):
            runs[place[size]].extend(group)
        demand = [sum(n for _, n in r) for r in runs]
        for r in runs:
            r.reverse()  # taken from the end, longest first
        for times, places in _uses(distinct, demand, capacity):
            need = {g: places.count(g) for g in places}
            while times:
                same = min([times, *(runs[g][-1][1] // m for g, m in need.items())])
                lengths = []
                for g, m in need.items():
                    for _ in range(m):
                        run = runs[g][-1]
                        lengths.append(run[0])
                        run[1] -= max(same, 1)
                        if not run[1]:
                            runs[g].pop()
                types.append((max(same, 1), lengths))
                times -= max(same, 1)
        for length, n in itertools.chain(*runs):
            rest[length] = rest.get(length, 0) + n

    open_: dict[int, list[int]] = {}  # room left -> lines of the plan
    rooms: list[int] = []

    def put(line: int, room: int) -> None:
        if room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append(line)

    for i, (_, lengths) in enumerate(types):
        put(i, capacity - sum(lengths))
    for length in sorted(rest, reverse=True):
        count = rest[length]
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                types.append((-(-count // fit), []))
                put(len(types) - 1, capacity)
                continue
            room = rooms[at]
            line = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            times, lengths = types[line]
            fit = room // length
            full = min(times, count // fit)
            last = min(count - full * fit, fit) if times > full else 0
            count -= full * fit + last
            parts = [(full, fit), (int(last > 0), last), (times - full - (last > 0), 0)]
            for n, more in parts:
                if n:
                    types.append((n, lengths + [length] * more))
                    put(len(types) - 1, room - more * length)
            types[line] = (0, [])  # now told apart in up to three lines
    return [t for t in types if t[0]]


def _places(types: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, places per sequence, offset), sorted."""
    rows, ranks, sequence = [], {}, 0
    for times, lengths in types:
        offset = 0
        for length, same in itertools.groupby(sorted(lengths, reverse=True)):
            m = len(list(same))
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, m, offset))
            ranks[length] = first + times * m
            offset += length * m
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
    schemes: Sequence[tuple[int, float]] = SCHEMES,
) -> DataFrame:
    """Every piece of every document with its sequence and its offset in it.

    A missing or empty text is the end id alone, one piece. Repeated rows and rows without a
    doc_id are documents like others, each with places of its own. An empty table has no rows.
    Other columns are ignored.
    """
    cut = stored(pieces(docs, tokenizer, capacity), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # <= capacity rows
    places = _places(plan(counts, capacity, schemes))

    salts = max(1, -(-max(counts.values(), default=0) // SALT_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = parts.select("length", "salt", (
        F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    ).alias("before"))
    in_part = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("rank", F.row_number().over(in_part) - 1)
        .join(before, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32",
                (F.col("before") + F.col("rank")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (places[:, 0] << 44) + places[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            line = places[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - line[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(line[:, 2] + nth // np.maximum(line[:, 3], 1)),
                 pa.array(line[:, 4] + nth % np.maximum(line[:, 3], 1) * length)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PLACED)
