"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled are: a normaliser (white space to the mark, one mark before the text), the pieces as a
trie with an output and a weight at the end of each, byte pieces for characters outside the
vocabulary, and, for a BPE vocabulary, which pieces may follow each other. Encoding composes them
with a text: the states are places in it, the arcs pieces that end there, and the shortest path in
the tropical semiring (smallest sum of weights) is the encoding.

For a unigram vocabulary weights are negated scores. For BPE they alone would give other results
than its merges do. Merges are local, though: a sequence of pieces is the one they produce if and
only if every two neighbours are what they produce of these two alone. As an automaton over the
last piece this leaves one path to each place, which is then the shortest: it is followed from the
start, arc by arc. Only where a character has no piece are weights compared.

Texts are cut where no piece can reach across: before marks, around line ends, and between letters
and others if the vocabulary has no piece of both. The ids of a stretch are remembered.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import Remembered, documents, of_worker, slices, text_bytes

MARK = "▁"
LETTER = re.compile(r"[^\W\d_]")
KNOWN_STRETCHES = 600_000
KNOWN_PAIRS = 1_000_000
REMEMBERED = 64  # characters of a stretch that is remembered, at most


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        probe = "ﬁ ①  Ａé é"
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("this vocabulary has a normaliser other than the marking of spaces")
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        self.score = [model.get_score(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if byte[i]}
        # In BPE a piece's score is the negated number of its merge.
        self.merges = all(self.score[i] == round(self.score[i]) for i in self.ids.values())
        if any(not re.fullmatch(f"{MARK}*[^{MARK}\n]*", p) for p in self.ids):
            raise ValueError("a piece reaches over a mark or a line end")
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
        kinds = [[LETTER.fullmatch(c) is not None for c in p.lstrip(MARK)] for p in self.ids]
        if not any(a != b for k in kinds for a, b in zip(k, k[1:])):  # no piece joins letters with others
            letter, other = LETTER.pattern, f"(?:(?![{MARK}\n])[\\W\\d_])"
            self.cut = re.compile(f"{MARK}+(?:{letter}+|{other}+)?|\n|{letter}+|{other}+")
        self.longest = max(map(len, self.ids))
        # The trie: a node is a dict from characters; the output is under the empty string. It is
        # walked from the end of a piece, as arcs are looked up by where they end.
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = i
        # The same from the start of a piece, for arcs looked up by where they begin.
        self.starts: dict = {}
        for piece, i in self.ids.items():
            node = self.starts
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.raw = [
            b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.encode()
            for i, p in enumerate(self.pieces)
        ]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.follows: dict[int, bool] = {}  # by both pieces' ids in one number
        self.known = Remembered(KNOWN_STRETCHES)

    # --- encoding -----------------------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored neighbours first, then the leftmost."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = self.score[i], k
            if best is None:
                return parts
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the merges leave these two pieces as they are; of -1 and a piece, whether they
        make it of its own text."""
        pair = (first + 1 << 32) + second
        found = self.follows.get(pair)
        if found is None:
            if len(self.follows) >= KNOWN_PAIRS:
                self.follows.clear()
            parts = [self.pieces[i] for i in (first, second) if i >= 0]
            found = self.follows[pair] = self._merged("".join(parts)) == parts
        return found

    def _only_path(self, text: str) -> list[int] | None:
        """The path of pieces where they have to be able to follow each other, if there is one.

        One path at most leads to a place, so the arcs are tried from the start on, the longest
        first, and a place from which there is no way on is not entered again.
        """
        n, known, starts = len(text), self.follows, self.starts
        path: list[tuple] = []  # (piece, the other arcs beside it, where it begins)
        dead: set[int] = set()
        at, before, arcs = 0, 0, None
        while at < n:
            if arcs is None:
                arcs, node, end = [], starts, at
                while end < n:
                    node = node.get(text[end])
                    if node is None:
                        break
                    end += 1
                    if "" in node:
                        arcs.append((end, node[""]))
            while arcs:
                end, piece = arcs.pop()
                if end in dead:
                    continue
                follows = known.get((before << 32) + piece)
                if self.may_follow(before - 1, piece) if follows is None else follows:
                    path.append((piece, arcs, at))
                    at, before, arcs = end, piece + 1, None
                    break
            else:
                if not path:
                    return None
                dead.add(at)
                _, arcs, at = path.pop()
                before = path[-1][0] + 1 if path else 0
        return [p[0] for p in path]

    def _path(self, text: str) -> list[int]:
        """The shortest path through a stretch; -1 stands for a character without a piece."""
        n, known = len(text), self.follows if self.merges else {}
        weight = [0.0] + [float("inf")] * n
        last: list[int | None] = [None] * (n + 1)
        size = [0] * (n + 1)
        for end in range(1, n + 1):
            node, at = self.trie, end
            single = False
            while at:
                node = node.get(text[at - 1])
                if node is None:
                    break
                at -= 1
                piece = node.get("")
                if piece is None:
                    continue
                single = single or at == end - 1
                if weight[at] == float("inf"):
                    continue
                cost = weight[at] + (1.0 if self.merges else -self.score[piece])
                if cost >= weight[end]:
                    continue
                before = last[at]
                if self.merges:
                    before = -1 if before is None or before < 0 else before
                    follows = known.get((before + 1 << 32) + piece)
                    if not (self.may_follow(before, piece) if follows is None else follows):
                        continue
                weight[end], last[end], size[end] = cost, piece, end - at
            if not single and weight[end - 1] + 1e6 < weight[end]:
                weight[end], last[end], size[end] = weight[end - 1] + 1e6, -1 - ord(text[end - 1]), 1
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _ids(self, stretch: str) -> bytes:
        found = self.known.get_kept(stretch)
        if found is None:
            out = []
            only = self._only_path(stretch) if self.merges else None
            for piece in self._path(stretch) if only is None else only:
                if piece >= 0:
                    out.append(piece)
                elif self.byte_ids:
                    out.extend(self.byte_ids[b] for b in chr(-1 - piece).encode())
                else:
                    out.append(self.unknown)
            found = struct.pack(f"<{len(out)}I", *out)
            if len(stretch) <= REMEMBERED:
                self.known.make_room()
                self.known[stretch] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        known, ids = self.known, self._ids
        return b"".join([known.get(s) or ids(s) for s in self.cut.findall(marked)])

    # --- decoding -----------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text.decode("utf-8", "replace").removeprefix(MARK).replace(MARK, " ")


def _machine(path: str) -> Transducer:
    """One per worker process, so that its tasks compile it and learn a stretch once."""
    return of_worker("transducer", path, lambda: Transducer(path))


def encode(docs: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """(doc_id, ids binary): ids as little-endian unsigned 32-bit numbers.

    A missing text has none, like an empty one. Repeated rows are rows like others, an empty table
    gives none, other columns do not matter.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _machine(model)
        for batch in slices(batches):
            found = [transducer.encode(t.decode()) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", column]
            )

    return documents(docs).mapInArrow(run, f"doc_id long, {column} binary")


def decode(encoded: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; missing ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _machine(model)
        for batch in slices(batches, column):
            found = [transducer.decode(i or b"") for i in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"]
            )

    return encoded.select("doc_id", column).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per document: ids counted and hashed, byte pieces among them, and the decoded text's digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        transducer = _machine(model)
        byte = np.zeros(len(transducer.pieces), bool)
        byte[list(transducer.byte_ids.values())] = True
        for batch in slices(batches):
            rows = []
            for text in text_bytes(batch.column("text")):
                ids = transducer.encode(text.decode())
                numbers = np.frombuffer(ids, "<u4")
                decoded = transducer.decode(ids).encode()
                rows.append((len(numbers), int(byte[numbers].sum()), zlib.crc32(ids),
                             hashlib.sha256(decoded).hexdigest(), decoded == text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "equal"],
            )

    return documents(docs).select("doc_id", F.col("text")).mapInArrow(run, (
        "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, equal boolean"
    ))
