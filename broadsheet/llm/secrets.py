"""Secret scans over a trigram inverted index.

Each rule's regular expression is read into a Boolean query: alternatives, each a set of trigrams
that any match must contain. Every task indexes its rows in segments of a MB (trigram -> rows
that hold it; only trigrams that occur in a query are indexed), intersects and unites the posting
lists as the queries say, and runs a regular expression only over the rows that remain. A rule
with an alternative that demands no trigram is run over all rows. Segments are as large as a slice
of an Arrow batch, so nothing is shuffled and no list grows with the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as reader

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import documents, free_names, quoted, slices

MOST_STATES = 64
SEGMENT = 1 << 20  # bytes of text that are indexed at a time, about; it takes some 20 times as much
MOST_LITERALS = 4  # characters of a class that are told apart


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters; base rules are hashed."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII
    base: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         8, 2, re.ASCII | re.IGNORECASE, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, base=True),
    Rule("hex", r"[0-9a-f]+", 32, base=True),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


# --- from a regular expression to trigrams --------------------------------------------------
# A state is (trigrams seen for sure, the last bytes if they are known). All text is ASCII-lowered.

def _literal(states: set, char: int) -> set:
    out = set()
    for grams, tail in states:
        for byte in chr(char).lower().encode():
            tail = (tail + bytes([byte]))[-3:]
            if len(tail) == 3:
                grams = grams | {tail}
        out.add((grams, tail[-2:]))
    return out


def _class(states: set, items) -> set:
    chars = {value for kind, value in items if kind is op.LITERAL}
    if all(kind is op.LITERAL for kind, _ in items) and len(chars) <= MOST_LITERALS:
        return set().union(*(_literal(states, c) for c in chars))
    return _unknown(states)


def _unknown(states: set) -> set:
    return {(grams, b"") for grams, _ in states}


def _bounded(states: set) -> set:
    if len(states) > MOST_STATES:
        states = {(frozenset.intersection(*(g for g, _ in states)), b"")}
    return states


def _walk(states: set, items) -> set:
    for kind, value in items:
        if kind is op.LITERAL:
            states = _literal(states, value)
        elif kind is op.IN:
            states = _class(states, value)
        elif kind is op.SUBPATTERN:
            states = _walk(states, value[-1])
        elif kind is op.BRANCH:
            states = set().union(*(_walk(states, branch) for branch in value[1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, body = value
            done = states
            for _ in range(min(least, 4)):
                done = _walk(done, body)
            if most == 1 and least == 0:
                states = states | _walk(states, body)
            elif least == most and least <= 4:
                states = done
            else:
                states = _unknown(done)
        elif kind is op.AT:
            pass
        else:
            states = _unknown(states)
        states = _bounded(states)
    return states


def trigram_query(pattern: str, flags: int = 0) -> list[frozenset[bytes]] | None:
    """Alternatives of trigrams every match holds, or None if a match may hold none."""
    if flags & re.IGNORECASE and not flags & re.ASCII:
        return None  # letters outside ASCII may then stand for some inside
    found = {grams for grams, _ in _walk({(frozenset(), b"")}, reader.parse(pattern, flags))}
    if not all(found):
        return None
    return sorted((g for g in found if not any(o < g for o in found)), key=sorted)


class Index:
    """Posting lists of one segment, for the trigrams that the queries name."""

    def __init__(self, queries: Sequence[list[frozenset[bytes]] | None]):
        names = sorted({g for q in queries if q for alternative in q for g in alternative})
        self.place = {g: i + 1 for i, g in enumerate(names)}
        self.table = np.zeros(1 << 24, np.uint16)
        for gram, i in self.place.items():
            self.table[int.from_bytes(gram, "big")] = i

    def postings(self, texts: pa.Array) -> dict[int, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:][:len(texts) + 1]
        held = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        if len(held) < 3 or not self.place:
            return {}
        low = held + np.uint8(32) * ((held >= 65) & (held <= 90))
        code = low[:-2].astype(np.uint32) << 16
        code |= low[1:-1].astype(np.uint32) << 8
        code |= low[2:]
        gram = self.table[code]
        at = np.flatnonzero(gram)
        if not len(at):
            return {}
        rows = np.searchsorted(offsets - offsets[0], at, side="right") - 1
        pairs = np.unique(gram[at].astype(np.int64) << 32 | rows)
        grams, starts = np.unique(pairs >> 32, return_index=True)
        return dict(zip(grams.tolist(), np.split(pairs & 0xFFFFFFFF, starts[1:]), strict=True))

    def candidates(self, query, postings, rows: int) -> np.ndarray:
        if query is None:
            return np.arange(rows)
        none = np.array([], np.int64)
        found = [none]
        for alternative in query:
            lists = sorted((postings.get(self.place[g], none) for g in alternative), key=len)
            both = lists[0]
            for other in lists[1:]:
                both = np.intersect1d(both, other, assume_unique=True)
            found.append(both)
        return np.unique(np.concatenate(found))


def _compiled(rule: Rule) -> re.Pattern:
    """The rule's expression; a bare `class+` finds the same long runs faster with its least length."""
    if rule.least > 1 and rule.group == 0 and re.fullmatch(r"\[[^]\\]*\]\+", rule.pattern):
        return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", rule.flags)
    return re.compile(rule.pattern, rule.flags)


def find(
    docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = (), into: str = "_spans"
) -> DataFrame:
    """(doc_id, _spans array<kind, start, end>), or the `keep` columns and text instead of doc_id.

    The column of spans can be named by `into`.

    Spans are in code points, end exclusive, leftmost and without overlap within a kind, in order
    of start, then of the rules. A missing text has none, like an empty one; repeated rows are
    each scanned; an empty table gives none. Other columns do not matter.
    """
    names = ["doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]]
    rows = docs.select(*map(quoted, names)) if keep else documents(docs)
    span = "array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kept = names if keep else ["doc_id"]
    schema = ", ".join(f"{quoted(c)} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern, r.flags) for r in rules]
        index, compiled = Index(queries), [_compiled(r) for r in rules]
        for batch in slices(batches, most=SEGMENT):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.string())
            postings = index.postings(texts)
            spans: list[list] = [[] for _ in range(len(texts))]
            opened: dict[int, str] = {}
            for rule, query, expression in zip(rules, queries, compiled, strict=True):
                for row in index.candidates(query, postings, len(texts)).tolist():
                    if row not in opened:
                        opened[row] = texts[row].as_py()
                    spans[row].extend(
                        (rule.kind, m.start(), m.end()) for m in expression.finditer(opened[row])
                        if m.end(rule.group) - m.start(rule.group) >= rule.least
                    )
            order = {r.kind: i for i, r in enumerate(rules)}
            for s in spans:
                s.sort(key=lambda x: (x[1], order[x[0]]))
            as_rows = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(as_rows, kind)], names=[*kept, into]
            )

    return rows.mapInArrow(scan, f"{schema}, {into} {span}")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per document: spans of base kinds counted and hashed, and all spans as text."""
    found = find(docs, rules)
    base = [r.kind for r in rules if r.base]

    def of(kind):
        return F.size(F.filter("_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[of(k) for k in base],
        F.sha2(_joined(F.filter("_spans", lambda s: s.kind.isin(base))), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "<secret>") -> DataFrame:
    """The same rows and columns, every span in `text` replaced by `mark`; overlaps are one span.

    A missing text stays missing, and texts without a span stay as they are.
    """
    (spans,) = free_names(docs, "spans")
    found = find(docs, rules, docs.columns, spans)
    # From the last span to the first; `at` is where the part already replaced begins.
    start = F.struct(F.lit("").alias("tail"), (F.length("text") + 1).cast("long").alias("at"))
    merged = F.aggregate(
        spans, F.array().cast("array<struct<start:long,end:long>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] > s.start),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["start"].alias("start"),
                    F.greatest(F.element_at(done, -1)["end"], s.end).alias("end"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s.start.alias("start"), s.end.alias("end"))))),
    )
    clean = F.aggregate(
        F.reverse(merged), start,
        lambda state, s: F.struct(
            F.concat(
                F.lit(mark),
                F.substring(F.col("text"), (s.end + 1).cast("int"),
                            (state["at"] - s.end - 1).cast("int")),
                state["tail"],
            ).alias("tail"),
            (s.start + 1).alias("at"),
        ),
        lambda state: F.concat(
            F.substring(F.col("text"), F.lit(1), (state["at"] - 1).cast("int")), state["tail"]
        ),
    )
    text = F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*map(quoted, docs.columns))
