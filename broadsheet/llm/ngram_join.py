"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets whose Jaccard similarity reaches the threshold share at least one of the first
p = n - ceil(t * n) + 1 tokens of each in any common order, and at least l of the first p + l - 1.
The order here is that of the tokens' hashes. Each document chooses how far to lengthen its prefix:

* Tokens in very many prefixes (more than `FREQUENT`) are not used to find candidates. A document
  lengthens its prefix by as many places, e, as there are such tokens in it; of the e + 1 tokens
  that it then shares with a similar document at least one is another.
* It lengthens it by m more places, and demands m + 1 shared tokens, as long as the candidates
  saved by this are estimated to cost more than the longer lists.
* Where that would make the prefix too long, the document is dense in frequent tokens. Such
  documents are joined among themselves once more, with all their tokens in order of frequency.

A similar pair is found through the shorter of its two lengthenings, so the smaller demand of the
two holds. Equal sets are one from the start. Candidates are verified in two passes. The first
takes, per token, only the pairs with one of its documents, which ties groups of copies together
in linear time; the second takes all pairs of documents that are not connected by then. So no link
that would connect two documents is lost, and no group is expanded into all its pairs. In that
pass dense documents meet only if their parity sketches leave it possible that they link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import free_names, if_few, keyed, list_array, mix, slices, stored, text_bytes
from broadsheet.llm.components import components

WORDS = 5
THRESHOLD = 75  # per cent
FREQUENT = 64  # a token in more prefixes than these finds no candidates
VERIFY = 0.25  # cost of verifying a candidate per token of its set, in entries of token lists
STEPS = (0, 1, 2, 3, 5, 8, 12, 18, 27, 40, 60, 90, 135, 200, 300)  # values of m that are tried
DENSE = 99  # stands for the demand of a dense document; its partner's is smaller
SLICE = 2 << 20  # bytes of text whose words are in memory at a time, about
SKETCH_BITS = 1024  # a power of two

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


# --- sets of shingles -------------------------------------------------------------------------

def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the hashes of all words; each different word is hashed once."""
    lower = pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string()))
    split = pc.ascii_split_whitespace(lower)  # white space at an end leaves an empty word
    found, count = split.flatten(), split.value_lengths().to_numpy().astype(np.int64)
    empty = pc.equal(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        of_text = np.repeat(np.arange(len(count)), count)
        count = count - np.bincount(of_text[empty], minlength=len(count))
        found = found.filter(pa.array(~empty))
    found = found.dictionary_encode()
    different = found.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different))
    return count, mix(hashes)[found.indices.to_numpy()]


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the runs of `words` words of each text.

    Words are separated by ASCII white space, A to Z are lower-cased. A text with fewer words is
    one shingle; one without a word has none.
    """
    count, hashes = word_hashes(texts)
    runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        runs = runs * _FACTOR + hashes[i:i + len(runs)]
    runs = mix(runs)
    ends = np.cumsum(count)
    starts = ends - count
    for at, end in zip(starts.tolist(), (ends - words + 1).tolist(), strict=True):
        if end > at:
            runs[at:end].sort()
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:] != runs[:-1]
    new[starts[count >= words]] = True
    for at, n in zip(starts.tolist(), count.tolist(), strict=True):
        if n >= words:
            end = at + n - words + 1
            yield runs[at:end][new[at:end]]
        elif n:
            whole = np.array([n], np.uint64)
            for i in range(at, at + n):
                whole = whole * _FACTOR + hashes[i:i + 1]
            yield mix(whole ^ _FACTOR)
        else:
            yield np.array([], np.uint64)


def prefix_length(n, threshold: int):
    """p; works on integers, arrays and, as p >= 1 only matters for n >= 1, on 0."""
    return n - (threshold * n + 99) // 100 + 1


def _slack(p):
    return p // 4 + 2


def lengthening(n, threshold: int):
    """How far a document of n shingles may lengthen its prefix."""
    p = prefix_length(n, threshold)
    return np.minimum(_slack(p), n - p)


def looked_at(n, threshold: int):
    """Tokens looked at of a set: enough for its largest possible partner's lengthening."""
    largest = n * 100 // threshold
    return np.minimum(n, prefix_length(n, threshold) + _slack(prefix_length(largest, threshold)))


def _sets(rows: DataFrame, words: int, threshold: int, tokens: str = "") -> DataFrame:
    """(doc_id, text_key, n, sid) of the sets, and tokens: `all`, or those `looked at`."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            sizes, names, kept = [], [], []
            for found in shingle_sets(text_bytes(batch.column("text")), words):
                n = len(found)
                sizes.append(n)
                names.append(int.from_bytes(
                    hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True
                ))
                if tokens:
                    kept.append(found if tokens == "all" or not n else found[:looked_at(n, threshold)])
            columns = {
                "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"),
                "n": pa.array(sizes, pa.int64()), "sid": pa.array(names, pa.int64()),
            }
            if tokens:
                lengths = np.fromiter(map(len, kept), np.int64, len(kept))
                columns["tokens"] = list_array(pa.array(np.concatenate(kept).view(np.int64)), lengths)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, text_key long, n long, sid long" + (", tokens array<long>" if tokens else "")
    return rows.select("doc_id", "text_key", "text").mapInArrow(compute, schema)


# --- candidates -------------------------------------------------------------------------------

def _choose(
    n: int, at: np.ndarray, df: np.ndarray, threshold: int, limit: int = FREQUENT
) -> tuple[int, int] | None:
    """(prefix length, demand) for a set, from places and frequencies of its shared tokens."""
    p, most = prefix_length(n, threshold), int(lengthening(n, threshold))
    frequent = np.sort(at[df > limit])
    e = next((e for e in range(most + 1) if np.searchsorted(frequent, p + e) <= e), None)
    if e is None:
        return None
    best = None
    for m in [*(m for m in STEPS if m < most - e), most - e]:
        if np.searchsorted(frequent, p + e + m) > e:
            break
        lists = float((df[(at < p + e + m) & (df <= limit)] - 1).sum())
        cost = lists * (1 + VERIFY * n / (1 + m))
        if best is None or cost < best[0]:
            best = cost, p + e + m, 1 + m
    return best[1:]


def _postings(rows: DataFrame, threshold: int, limit: int) -> DataFrame:
    """(sid, n, need, tokens) of each set's lengthened prefix; need is DENSE where none will do."""
    def adapt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column("held")
            ends = np.cumsum(held.value_lengths().to_numpy())[:-1]
            fields = [np.split(f.to_numpy(zero_copy_only=False), ends) for f in held.flatten().flatten()]
            sizes = []
            needs, kept = [], []
            for place, tokens, df in zip(*fields, strict=True):
                n, at = int(place[0] >> 32), place & 0xFFFFFFFF
                sizes.append(n)
                chosen = _choose(n, at, df, threshold, limit)
                length, need = chosen or (n, DENSE)
                needs.append(need)
                kept.append(tokens[(at < length) & (df <= limit)])
            lengths = np.fromiter(map(len, kept), np.int64, len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sid"), pa.array(sizes, pa.int64()), pa.array(needs, pa.int32()),
                 list_array(pa.array(np.concatenate(kept)), lengths)],
                names=["sid", "n", "need", "tokens"],
            )

    grouped = rows.groupBy("sid").agg(F.collect_set(F.struct("place", "token", "df")).alias("held"))
    return grouped.mapInArrow(adapt, "sid long, n long, need int, tokens array<long>")


def _can_link(n_a, alone_a, n_b, alone_b, threshold: int):
    """What two sets can have in common suffices; `alone` are tokens that no other set has."""
    return F.least(n_a - alone_a, n_b - alone_b) * (100 + threshold) >= (n_a + n_b) * threshold


def _sketches(sets: DataFrame) -> DataFrame:
    """(sid, sketch): bit i is the parity of the tokens whose hash starts with i.

    A token that one of two sets lacks changes one bit, so sketches differ in no more bits than
    the sets differ in tokens.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = []
            for tokens in batch.column("tokens"):
                bits = tokens.values.to_numpy().view(np.uint64) >> np.uint64(65 - SKETCH_BITS.bit_length())
                odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
                marks.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            lengths = np.full(len(marks), SKETCH_BITS // 64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sid"), list_array(pa.array(np.concatenate(marks)), lengths)],
                names=["sid", "sketch"],
            )

    return sets.select("sid", "tokens").mapInArrow(mark, "sid long, sketch array<long>")


def _near_enough(n_a, sketch_a, n_b, sketch_b, threshold: int):
    """By their sketches two sets may differ in few enough tokens; true where one has no sketch."""
    bits = sum(
        (F.bit_count(sketch_a[i].bitwiseXOR(sketch_b[i])) for i in range(SKETCH_BITS // 64)), F.lit(0)
    )
    return F.coalesce(bits * (100 + threshold) <= (n_a + n_b) * (100 - threshold), F.lit(True))


class _Join:
    """One run over `docs`; the tables it writes are its steps."""

    def __init__(self, docs: DataFrame, words: int, threshold: int, frequent: int):
        self.rows, self.words, self.threshold = keyed(docs), words, threshold
        self.frequent = frequent
        sets = _sets(self.rows, words, threshold)
        self.sets = stored(sets.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
        # One version of a document stands for each set.
        one = self.sets.filter("n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "text_key")).alias("one"))
        self.keys = stored(one.select("sid", "one.*"), "shingle-keys")
        versions = self.sets.groupBy("doc_id", "text_key").count()
        self.repeated = not versions.filter("count > 1").isEmpty()

    def tokens_of(self, sids: DataFrame) -> DataFrame:
        """(sid, n, tokens) with all tokens of the sets named, computed from their texts again."""
        keys = self.keys.join(sids.select("sid").distinct(), "sid", "left_semi").select(
            F.col("doc_id").alias("key_id"), F.col("text_key").alias("key_text")
        )
        chosen = self.rows.join(if_few(stored(keys, "keys")), F.col("doc_id").eqNullSafe(F.col("key_id"))
                                & (F.col("text_key") == F.col("key_text")), "left_semi")
        whole = _sets(chosen, self.words, self.threshold, "all").select("sid", "n", "tokens")
        return stored(whole.dropDuplicates(["sid"]) if self.repeated else whole, "tokens")

    def postings(self) -> DataFrame:
        """(token, sid, n, need, alone): what finds the candidates."""
        copies = self.sets.filter("n > 0").join(
            self.keys.select("sid", F.struct("doc_id", "text_key").alias("one")), "sid"
        ).filter(F.struct("doc_id", "text_key") != F.col("one")).select(
            F.col("doc_id").alias("key_id"), F.col("text_key").alias("key_text")
        ).distinct()
        kept = self.rows.join(if_few(copies), F.col("doc_id").eqNullSafe(F.col("key_id"))
                              & (F.col("text_key") == F.col("key_text")), "left_anti")
        # Computed twice, once to count and once to look up: tokens hardly compress on disk.
        tokens = _sets(kept, self.words, self.threshold, "looked at")
        rows = tokens.select("sid", "n", F.posexplode("tokens").alias("at", "token")).select(
            "token", "sid", (F.col("n") * (1 << 32) + F.col("at")).alias("place")
        )
        shared = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
        chosen = stored(
            _postings(rows.join(shared, "token"), self.threshold, self.frequent), "prefixes"
        )
        found = chosen.select(
            F.explode("tokens").alias("token"), "sid", "n", "need", F.lit(0).alias("alone"),
            F.lit(None).cast("array<long>").alias("sketch"),
        )

        dense = chosen.filter(F.col("need") == DENSE)
        whole = self.tokens_of(dense)
        every = whole.select("sid", "n", F.explode("tokens").alias("token"))
        # Sets that may differ in more tokens than about half the bits gain nothing by a sketch.
        small = 4 * F.col("n") * (100 - self.threshold) < SKETCH_BITS * (100 + self.threshold)
        sketches = _sketches(whole.filter(small))
        among = every.groupBy("token").agg(F.count("*").alias("df"))
        n = F.col("n")
        p = n - F.floor((n * self.threshold + 99) / 100) + 1
        ordered = every.join(among, "token").groupBy("sid", "n").agg(
            F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"),
            F.count_if(F.col("df") == 1).cast("int").alias("alone"),
        )
        prefix = ordered.join(sketches, "sid", "left").select(
            "sid", "n", "alone", "sketch",
            F.explode(F.slice("held", F.lit(1), p.cast("int"))).alias("t"),
        )
        rare_first = prefix.filter("t.df > 1").select(
            "t.token", "sid", "n", F.lit(1).cast("int").alias("need"), "alone", "sketch"
        )
        return stored(found.unionByName(rare_first), "postings")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of the candidate pairs (a, b) that link, by their whole sets."""
        pairs = stored(pairs, "candidates")
        both = pairs.select(F.explode(F.array("a", "b")).alias("sid"))
        held = self.tokens_of(both)
        left = held.select(F.col("sid").alias("a"), F.col("tokens").alias("tokens_a"))
        right = held.select(F.col("sid").alias("b"), F.col("tokens").alias("tokens_b"))
        threshold = self.threshold

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = (batch.column("tokens_a"), batch.column("tokens_b"))
                good = []
                for x, y in zip(*columns, strict=True):
                    x, y = (v.values.to_numpy() for v in (x, y))
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= threshold * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        # The larger side, pairs, takes on one list of tokens, moves, and meets the other.
        joined = pairs.select("a", "b").join(left, "a").join(right, "b")
        linked = joined.select("a", "b", "tokens_a", "tokens_b").mapInArrow(check, "a long, b long")
        return stored(linked, "links")

    def links(self) -> DataFrame:
        threshold = self.threshold
        postings = self.postings()
        # The set with the fewest tokens of its own is likeliest to be what others are copies of.
        own = (F.col("alone") / F.col("n")).alias("own")
        centre = F.min(F.struct(own, "sid", "n", "need", "alone"))
        centres = postings.groupBy("token").agg(centre.alias("c"), F.count("*").alias("k")).filter("k > 1")
        stars = postings.join(centres, "token").filter(
            (F.col("sid") != F.col("c.sid"))
            & _can_link(F.col("n"), F.col("alone"), F.col("c.n"), F.col("c.alone"), threshold)
        )
        ties = stars.groupBy(F.col("c.sid").alias("a"), F.col("sid").alias("b")).agg(
            F.count("*").alias("shared"), F.min(F.least("need", "c.need")).alias("need")
        )  # tokens they share under another centre are not counted; the second pass counts all
        first = self.verify(ties.filter("shared >= need").select("a", "b"))
        roots = stored(components(first), "roots")

        labelled = postings.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
            "root", F.coalesce("root", "sid")
        )
        # Per token, the component with most documents; it meets only the others.
        sizes = labelled.groupBy("token", "root").agg(F.count("*").alias("k"))
        largest = sizes.groupBy("token").agg(
            F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots")
        ).filter("roots > 1").select("token", F.col("top.root").alias("top"))
        open_ = stored(labelled.join(largest, "token").withColumn("in_top", F.col("root") == F.col("top")).drop("top"), "open")
        x = open_.filter("not in_top").select("token", *(F.col(c).alias(f"x_{c}") for c in ("sid", "n", "need", "alone", "sketch", "root")))
        meets = (F.col("x_root") != F.col("root")) & (F.col("in_top") | (F.col("x_sid") < F.col("sid")))
        pairs = x.join(open_, "token").filter(
            meets & _can_link(F.col("n"), F.col("alone"), F.col("x_n"), F.col("x_alone"), threshold)
            & _near_enough(F.col("n"), F.col("sketch"), F.col("x_n"), F.col("x_sketch"), threshold)
        ).groupBy(
            F.least("sid", "x_sid").alias("a"), F.greatest("sid", "x_sid").alias("b")
        ).agg(F.count("*").alias("shared"), F.min(F.least("need", "x_need")).alias("need"))
        second = self.verify(pairs.filter("shared >= need").select("a", "b"))
        return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)


def near_duplicates(
    docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, frequent: int = FREQUENT
) -> DataFrame:
    """(doc_id, text_key, row, n_shingles, component_id) for every row of documents.

    Two documents link when their sets' Jaccard similarity is at least `threshold` per cent;
    component_id is the smallest doc_id reachable by links. A document without words, or without a
    text, links with nothing and is its own component. Repeated rows are equal sets; rows without
    a doc_id link like others, and have a component_id if any document of theirs has one. An empty
    table gives no rows. Other columns do not matter. Sets are told apart by 64-bit hashes.
    """
    join = _Join(docs, words, threshold, frequent)
    roots = stored(components(join.links()), "roots")
    rows = join.sets.select("doc_id", "text_key", "row", "n", "sid")
    with_root = rows.filter("n > 0").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "root", F.coalesce("root", "sid")
    )
    smallest = with_root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = with_root.join(smallest, "root")
    empty = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_key", "row", F.col("n").alias("n_shingles"), "component_id"]
    return named.select(*columns).unionByName(empty.select(*columns))


def keep_one(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with their columns, one of each group of near duplicates.

    Of a group the row with the smallest doc_id stays, of several with that id one with the
    smallest text_key. Documents without words have no group and all stay.
    """
    found = stored(near_duplicates(docs, words, threshold), "near-duplicates")
    # A group whose documents have no doc_id cannot be told from others by component_id.
    some = found.filter("n_shingles > 0 and component_id is not null")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key", "row")
    first = some.groupBy("component_id").agg(F.min(order).alias("first"))
    gone = some.join(first, "component_id").filter(F.col("row") != F.col("first.row"))
    gone = gone.groupBy("doc_id", "text_key").agg(F.count("*").alias("gone"))
    rows = some.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    id_, key = free_names(docs, "id", "key")
    rows = rows.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), "rows")
    both = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("text_key") == F.col(key))
    fate = stored(gone.join(rows, both).select(id_, key, "gone", "rows"), "fate")
    text_key = F.xxhash64(F.col("text").cast("string"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (text_key == F.col(key))
    kept = docs.join(if_few(fate.filter("gone = rows").select(id_, key)), same, "left_anti")
    repeated = fate.filter("gone < rows").select(id_, key)  # one of some equal rows stays
    if not repeated.isEmpty():
        once = docs.join(if_few(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(if_few(repeated), same, "left_anti").unionByName(once)
    return kept
