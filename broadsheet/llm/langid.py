"""Language identification: known words first, shorter and shorter character n-grams after.

A model holds, per language, log frequencies of words and of character n-grams of 1 to 5 letters
of words with their edges marked. A text's words that the model knows in any language are scored
by word; each other word is covered from its start by the longest known n-grams, of 5 letters and
then fewer, down to single ones, and scored by these.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import documents, free_names, if_few, of_worker, quoted, slices, stored

LONGEST = 5
SAMPLE = 5_000  # labelled documents per language that a model is fitted on, about, thinned by hash
SEEN = 2  # times that a word or an n-gram has to be seen in some language to be known
KNOWN_WORDS = 300_000  # tokens whose scores a task remembers from one slice of texts to the next
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Table:
    """Words or n-grams and, as rows of a matrix, their log frequency per language."""

    names: pa.Array
    scores: np.ndarray

    @staticmethod
    def of(scores: dict[str, tuple[float, ...]], languages: int) -> Table:
        rows = np.array(list(scores.values()), np.float32).reshape(-1, languages)
        return Table(pa.array(list(scores), pa.string()), rows)

    def __len__(self) -> int:
        return len(self.names)


@dataclass(frozen=True)
class Model:
    """Languages in order, and what is known of words and of n-grams in them."""

    languages: list[str]
    words: Table
    grams: Table
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def held_out():
    """Whether a document is kept for testing; one without an id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) == 0


def _has_letter(words: list[str]) -> bool:
    """The expression also takes numerals such as superscripts, which are no letters."""
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of the texts, summed per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_worker("counts", None, dict)  # lets go of what other operators' tasks have kept
        for batch in slices(batches):
            tokens: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                tokens.setdefault(lang, Counter()).update(text.lower().split())
            found: Counter = Counter()
            for lang, counts in tokens.items():
                for token, n in counts.items():
                    for word in (token,) if _is_word(token) else _WORD.findall(token):
                        found[lang, word] += n
            yield from _pairs(found)

    counted = rows.mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _is_word(token: str) -> bool:
    """A shortcut for the expression: most tokens are words whole."""
    return token.isalpha()


def _pairs(found: Counter) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found]), pa.array([k[1] for k in found]),
             pa.array(list(found.values()), pa.int64())],
            names=["lang", "word", "n"],
        )


def _grams(word: str) -> list[str]:
    marked = f"_{word}_"
    size = len(marked)
    return [marked[i:i + n] for n in range(1, min(LONGEST, size) + 1) for i in range(size - n + 1)]


def _gram_counts(words: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = found.setdefault(lang, Counter())
                if n == 1:  # most words; a list is counted faster than a loop adds
                    grams.update(_grams(word))
                else:
                    for gram in _grams(word):
                        grams[gram] += n
            yield from _pairs(Counter({(k, g): n for k, grams in found.items() for g, n in grams.items()}))

    counted = words.mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame, languages: list[str], seen: int) -> Table:
    """Log frequencies, add-half smoothed, of what occurs `seen` times in some language."""
    place = F.transform(F.array(*map(F.lit, languages)), lambda lang: F.coalesce(F.col("held")[lang], F.lit(0)))
    by_name = counts.groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("held"), F.max("n").alias("most")
    )
    found = by_name.filter(F.col("most") >= seen).select("word", place.alias("n")).toArrow()
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    total = np.array([totals.get(lang, 0) for lang in languages]) + 0.5 * len(found) + 0.5
    n = np.asarray(found["n"].combine_chunks().flatten(), float).reshape(-1, len(languages))
    names = found["word"].combine_chunks() if len(found) else pa.array([], pa.string())
    return Table(names, np.log((n + 0.5) / total).astype(np.float32))


def fit(docs: DataFrame, sample: int = SAMPLE, seen: int = SEEN) -> Model:
    """A model of the labelled documents that are not held out; lang is read here only.

    Of a language with more than `sample` documents about so many are taken, by a hash of their
    ids; their texts count whole. What is collected are languages, and words and n-grams of the
    sample, as arrays.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
    ).filter(F.col("lang").isNotNull() & ~held_out())
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "languages")
    languages = sorted(r[0] for r in sizes.select("lang").collect())
    if not languages:
        return Model([], Table.of({}, 1), Table.of({}, 1))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20) < F.lit(sample) / F.col("docs")
    sampled = rows.filter(F.col("text").isNotNull()).join(if_few(sizes), "lang").filter(part)
    words = stored(_counted(sampled.select("lang", "text")), "words")
    return Model(
        languages, _table(words, languages, seen),
        _table(stored(_gram_counts(words.select("lang", "word", "n")), "grams"), languages, seen),
    )


class Scores(dict):
    """Row numbers of tokens, which stand between white space, in a matrix of their scores.

    A row has the scores per language, summed over the token's words, then how many words these
    are and whether they have a letter. Rows are filled for all new tokens of a slice at once.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.languages = max(1, len(model.languages))
        nothing = np.zeros((1, self.languages), np.float32)
        self.rows = np.concatenate([model.words.scores, model.grams.scores, nothing])
        self.words = {w: i for i, w in enumerate(model.words.names.to_pylist())}
        self.grams = {g: i for i, g in enumerate(model.grams.names.to_pylist(), len(model.words))}
        self.matrix = np.zeros((0, self.languages + 2))
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = row = len(self)
        self.new.append(token)
        return row

    def _parts(self, word: str, parts: list[int]) -> None:
        """Adds the rows of the model that make up a word's score."""
        known = self.words.get(word)
        if known is not None:
            parts.append(known)
            return
        marked, at, find = f"_{word}_", 0, self.grams.get
        size = len(marked)
        while at < size:
            to = min(at + LONGEST, size)
            while to > at and (gram := find(marked[at:to])) is None:
                to -= 1
            if to > at:
                parts.append(gram)
                at = to
            else:
                at += 1

    def _learn(self) -> None:
        parts, ends, words, letters = [], [], [], []
        nothing = len(self.rows) - 1  # zeros, so that no token is without a row
        for token in self.new:
            parts.append(nothing)
            if _is_word(token):
                self._parts(token, parts)
                words.append(1)
                letters.append(True)
            else:
                found = _WORD.findall(token)
                for word in found:
                    self._parts(word, parts)
                words.append(len(found))
                letters.append(_has_letter(found))
            ends.append(len(parts))
        starts = np.array([0, *ends[:-1]])
        learnt = np.empty((len(ends), self.languages + 2))
        parts = np.array(parts)
        for column in range(self.languages):
            learnt[:, column] = np.add.reduceat(self.rows[parts, column].astype(float), starts)
        learnt[:, -2], learnt[:, -1] = words, letters
        self.matrix = np.concatenate([self.matrix, learnt])
        self.new = []

    def of(self, words: list[str]) -> np.ndarray:
        """Summed scores per language of words, each taken whole."""
        parts: list[int] = []
        for word in words:
            self._parts(word, parts)
        return self.rows[parts].astype(float).sum(axis=0)

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """Per text the sums of its tokens' rows."""
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.matrix = self.matrix[:0]
        tokens = [t.lower().split() for t in texts]
        count = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = (t for ts in tokens for t in ts)
        rows = np.fromiter(map(self.__getitem__, flat), np.int64, int(count.sum()))
        if self.new:
            self._learn()
        out = np.zeros((len(texts), self.matrix.shape[1]))
        some = np.flatnonzero(count)
        if len(some):
            starts = (np.cumsum(count) - count)[some]
            for column in range(out.shape[1]):
                out[some, column] = np.add.reduceat(self.matrix[:, column][rows], starts)
        return out


def _scores_of(model: Model) -> Scores:
    """One per worker process, for all of its tasks with this model."""
    return of_worker("language", model.key, lambda: Scores(model))


def identify(
    docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",),
    into: Sequence[str] = ("lang_pred", "score"),
) -> DataFrame:
    """The `keep` columns and two more: the likeliest language and its share.

    `und` with score 0 where text is missing or has no letter, or where nothing was learnt. Ties
    go to the first language in order. Repeated rows are rows like others.
    """
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.select(*map(quoted, keep)).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # what the sample holds, as arrays
    (given,) = free_names(docs, "text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = _scores_of(model)
        for batch in slices(batches, given, 4 << 20):
            found, sure = [], []
            for sums in scores.of_texts(pc.fill_null(batch.column(given), "").to_pylist()):
                if not model.languages or not sums[-1]:
                    found.append(UNDETERMINED)
                    sure.append(0.0)
                    continue
                total = sums[:-2] / np.sqrt(sums[-2])
                share = np.exp(total - total.max())
                best = int(np.argmax(share))
                found.append(model.languages[best])
                sure.append(float(share[best] / share.sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(found, pa.string()), pa.array(sure, pa.float64())],
                names=[*keep, *into],
            )

    rows = docs.select(F.col("text").cast("string").alias(given), *map(quoted, keep))
    return rows.mapInArrow(predict, f"{schema}, {into[0]} string, {into[1]} double")


def predict_all(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of the others.

    A text that is missing or has no letter is `und` with score 0. A document without an id is held
    out. Repeated rows are rows like others, an empty table gives none; ties go to the first
    language in order. Other columns do not matter.
    """
    found = identify(documents(docs), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def reject(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows, with their columns, whose language can be told with a score of `least`.

    Where the model has learnt nothing no language can be told, and the rows with a letter stay.
    """
    if not len(model.words) and not len(model.grams):
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    into = free_names(docs, "lang_pred", "score")
    places = free_names(docs, *map(str, range(len(docs.columns))))  # two columns may share a name
    at = [c.lower() for c in docs.columns].index("text")
    found = identify(docs.toDF(*places).withColumn("text", F.col(places[at])), model, places, into)
    sure = (F.col(into[0]) != UNDETERMINED) & (F.col(into[1]) >= least)
    return found.filter(sure).select(*places).toDF(*docs.columns)
