"""Merkle manifest of a dataset: leaves find their coordinates in bitmaps, not by sorting.

Per group of rows the ids form a bitmap, of which only words of 64 bits that are not empty are
kept; every word knows, from sums of popcounts, how many leaves lie before it. A leaf's place in
its group is that number plus the popcount below its own bit. Leaves then go by place: blocks of
FANOUT ** BLOCK_LEVELS neighbours meet in a task, are put into an array of slots, and runs of slots
are hashed level by level. Blocks' roots are the leaves of the next round, up to one subroot per
group; subroots are treated alike up to the root. On the way back every block is given what lies
beside its path, once, and its task makes the proofs of its leaves from that and its own slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stored
from broadsheet.llm.running import numbered, repeated, running

FANOUT = 8
BLOCK_LEVELS = 3  # levels that one task hashes at once
BLOCK = FANOUT ** BLOCK_LEVELS

WORD_BITS = 6  # of an id, its place in a word
NO_ID = -(1 << 57) - 1  # the word of rows without an id, before all others

_STEP = "array<struct<`left`: string, `right`: string>>"  # per level, the siblings' digests on both sides


def _value(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Digest of a row: of each value `-` if it is missing, else its bytes' number, `:`, the value."""
    return F.sha2(F.concat(*map(_value, columns)), 256)


def lower_ascii(column: Column) -> Column:
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(column, upper, upper.lower())


def group_key(column: Column) -> Column:
    """A group's name as text that is never missing and keeps the order, missing first."""
    return F.coalesce(F.concat(F.lit("+"), column.cast("string")), F.lit(""))


# --- coordinates ------------------------------------------------------------------------------


def _word(doc_id: str) -> Column:
    return F.coalesce(F.shiftright(doc_id, WORD_BITS), F.lit(NO_ID))


def _bit(doc_id: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({doc_id} & 63 as int))")


def directory(leaves: DataFrame) -> DataFrame:
    """(grp, word, bits, tied, before, total): the groups' bitmaps with what lies before each word.

    Tied words hold an id more than once, or rows without one; there popcounts tell no places.
    """
    words = leaves.groupBy("grp", _word("doc_id").alias("word")).agg(
        F.coalesce(F.bit_or(_bit("doc_id")), F.lit(0)).alias("bits"), F.count(F.lit(1)).alias("n")
    )
    words = stored(words, "bitmap-words")
    ranked = running(words, "grp", "word", "n", bits=64 - WORD_BITS)
    return ranked.select(
        "grp", "word", "bits", (F.bit_count("bits") != F.col("n")).alias("tied"), "before", "total"
    )


def _among_ties(rows: DataFrame) -> DataFrame:
    """Places in tied words: by id, then by digest. Equal rows follow each other in any order.

    Rows are counted, then summed by the first digits of their digests, then within these, so that
    an id which very many rows share is no window of its own.
    """
    same = ["grp", "word", "before", "total", "doc_id"]
    digits = F.substring("leaf", 1, 4).alias("_digits")
    counted = rows.groupBy(*same, digits, "leaf", "presented").agg(F.count(F.lit(1)).alias("_times"))
    upto = (Window.unboundedPreceding, -1)
    bins = counted.groupBy(*same, "_digits").agg(F.sum("_times").alias("_in_bin"))
    bins = bins.withColumn("_bins", F.coalesce(F.sum("_in_bin").over(
        Window.partitionBy("grp", "word").orderBy(F.asc_nulls_first("doc_id"), "_digits").rowsBetween(*upto)
    ), F.lit(0)))
    inner = Window.partitionBy(*same, "_digits").orderBy("leaf", F.asc_nulls_first("presented")).rowsBetween(*upto)
    counted = counted.withColumn("_inner", F.coalesce(F.sum("_times").over(inner), F.lit(0)))
    c, b = counted.alias("c"), bins.alias("b")
    met = c.join(b, (F.col("c.grp") == F.col("b.grp")) & (F.col("c.word") == F.col("b.word"))
                 & F.col("c.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("c._digits") == F.col("b._digits")))
    placed = met.select("c.*", "b._bins")
    place = F.col("before") + F.col("_bins") + F.col("_inner") + F.col("copy")
    return repeated(placed, "_times").select("grp", "total", place.alias("place"), "doc_id", "leaf", "presented")


def coordinates(leaves: DataFrame) -> DataFrame:
    """(grp, total, place, doc_id, leaf, presented): every leaf's place in its group, from 0.

    Places ascend by doc_id, rows without one come first; among rows of one id by leaf.
    """
    words = stored(directory(leaves), "bitmap-directory")
    met = leaves.withColumn("word", _word("doc_id")).join(words, ["grp", "word"])
    lower = F.expr("~shiftleft(-1L, cast(doc_id & 63 as int))")  # the bits below a leaf's own
    below = F.bit_count(F.col("bits").bitwiseAND(lower))
    placed = met.filter(~F.col("tied")).select(
        "grp", "total", (F.col("before") + below).alias("place"), "doc_id", "leaf", "presented"
    )
    ties = words.filter("tied")
    if ties.isEmpty():
        return placed
    tied = leaves.withColumn("word", _word("doc_id")).join(ties, ["grp", "word"])
    return placed.unionByName(_among_ties(tied))


# --- levels -----------------------------------------------------------------------------------


def height(total: int, fanout: int = FANOUT) -> int:
    """Levels above `total` nodes."""
    levels = 0
    while total > 1:
        total, levels = -(-total // fanout), levels + 1
    return levels


def _slots(block: pa.Table, name: str) -> list[str]:
    """The column as an array in which every node has the slot of its place."""
    places = block.column("place").to_pylist()
    slots = [""] * len(places)
    for place, digest in zip(places, block.column(name).to_pylist(), strict=True):
        slots[place % BLOCK] = digest
    return slots


def _reduced(slots: list[str], levels: int) -> list[list[str]]:
    """The slots and the levels above them within the block."""
    out = [slots]
    for _ in range(levels):
        last = out[-1]
        out.append([
            hashlib.sha256("".join(last[i:i + FANOUT]).encode()).hexdigest() for i in range(0, len(last), FANOUT)
        ])
    return out


def _block_levels(block: pa.Table) -> int:
    return min(BLOCK_LEVELS, height(block.column("total")[0].as_py()))


def _block() -> Column:
    return F.floor(F.col("place") / BLOCK).cast("long")


def _round(nodes: DataFrame) -> DataFrame:
    """The roots of all blocks of (grp, total, place, digest), as nodes of the next round."""

    def reduce(block: pa.Table) -> pa.Table:
        root = _reduced(_slots(block, "digest"), _block_levels(block))[-1][0]
        return pa.table({
            "grp": [block.column("grp")[0].as_py()],
            "total": [-(-block.column("total")[0].as_py() // BLOCK)],
            "place": [block.column("block")[0].as_py()],
            "digest": [root],
        })

    dealt = nodes.select("grp", "total", "place", "digest", _block().alias("block"))
    return dealt.groupBy("grp", "block").applyInArrow(reduce, "grp string, total long, place long, digest string")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """`nodes` and the blocks' roots of each round; the last one has a node per group."""
    out = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        out.append(stored(_round(out[-1]), "manifest-round"))
        most = -(-most // BLOCK)
    return out


def _paths(nodes: DataFrame, above: DataFrame, digest: str, keep: Sequence[str]) -> DataFrame:
    """Per node the siblings on its way to the root: those in its block, then the block's own.

    `above` has (grp, place, path, subroot, root) of blocks; the result has place, path, subroot,
    root and what `keep` names. Both sides of a block meet in a task: at most BLOCK nodes and one row.
    """
    fields = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, path {_STEP}, subroot string, root string"
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def descend(block: pa.Table, upper: pa.Table) -> pa.Table:
        levels = _reduced(_slots(block, digest), _block_levels(block))
        over = upper.column("path")[0].as_py()
        steps = []  # per level and run, left and right of each slot
        for level in levels[:-1]:
            steps.append([
                {"left": "".join(level[start:i]), "right": "".join(level[i + 1:start + FANOUT])}
                for i, start in ((i, i - i % FANOUT) for i in range(len(level)))
            ])
        paths = []
        for place in block.column("place").to_pylist():
            at, path = place % BLOCK, []
            for level in steps:
                path.append(level[at])
                at //= FANOUT
            paths.append(path + over)
        n = block.num_rows
        return pa.table({
            **{c: block.column(c) for c in keep},
            "path": pa.array(paths, kind),
            "subroot": pa.array([upper.column("subroot")[0].as_py()] * n, pa.string()),
            "root": pa.array([upper.column("root")[0].as_py()] * n, pa.string()),
        })

    dealt = nodes.select(*dict.fromkeys(["grp", "total", "place", digest, *keep]), _block().alias("block"))
    blocks = above.select("grp", F.col("place").alias("block"), "path", "subroot", "root")
    return dealt.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(descend, schema)


def _descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the blocks that the nodes of the first round lie in, from paths of whole groups."""
    for nodes in levels[:0:-1]:
        above = stored(_paths(nodes, above, "digest", ("grp", "place")), "manifest-paths")
    return above


def proofs(leaves: DataFrame) -> DataFrame:
    """Every leaf of (grp, doc_id, leaf, presented) with its place, path, subroot and root.

    `leaf` is what the manifest is made of; `presented` is handed through. `path` has, from the
    leaf up to the root of all, the digests left and right of the node within its run. A run of one
    has none, but is hashed. Groups are ordered by name. No rows give no rows.
    """
    leaves = stored(leaves, "leaves")
    placed = stored(coordinates(leaves), "manifest-leaves")
    of_groups = rounds(placed.withColumnRenamed("leaf", "digest"))
    subroots = numbered(of_groups[-1].select("grp", F.col("digest").alias("subroot")), "grp")
    subroots = stored(subroots, "subroots")
    n = subroots.count()
    top = subroots.select(
        F.lit("").alias("grp"), F.lit(n).cast("long").alias("total"), "place", F.col("subroot").alias("digest")
    )
    of_all = rounds(top)
    whole = of_all[-1].select(
        "grp", "place", F.array().cast(_STEP).alias("path"), F.lit(None).cast("string").alias("subroot"),
        F.col("digest").alias("root"),
    )
    if n > 1:
        whole = _paths(top, _descend(of_all, whole), "digest", ("place",))
    own = whole.select("place", "path", "root").join(subroots, "place").select(
        "grp", F.lit(0).cast("long").alias("place"), "path", "subroot", "root"
    )
    above = _descend(of_groups, stored(own, "manifest-paths"))
    return _paths(placed, above, "leaf", ("grp", "place", "doc_id", "leaf", "presented"))


def path_digest(path: str) -> Column:
    """SHA-256 of all digests on a path, in order."""
    both = F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"])))
    return F.sha2(F.array_join(both, ""), 256)


def folded(presented: Column, path: str) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(
        path, presented, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256)
    )


def document_leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, presented) of documents, grouped by lang.

    `presented` is the leaf of the row as it is handed over: where 3 divides the checksum of a
    row's id its text has lost its capitals. Rows without an id are handed over unchanged.
    """
    c = {
        "doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"),
        "lang": F.col("lang").cast("string"), "n_chars": F.col("n_chars").cast("long"),
        "text": F.col("text").cast("string"),
    }
    tampered = F.coalesce(F.crc32(c["doc_id"].cast("string")) % 3 == 0, F.lit(False))
    changed = c | {"text": lower_ascii(c["text"])}
    return docs.select(
        group_key(c["lang"]).alias("grp"), c["doc_id"].alias("doc_id"), leaf(*c.values()).alias("leaf"),
        F.when(tampered, leaf(*changed.values())).alias("presented"),
    )


def verified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents.

    Missing values are hashed as such; equal rows are leaves of their own, next to each other; rows
    without an id come first in their language. Further columns are no part of a leaf. An empty
    table gives no rows.
    """
    found = proofs(document_leaves(docs))
    root = folded(F.coalesce("presented", "leaf"), "path")
    return found.select(
        "doc_id", "leaf", "subroot", "root", path_digest("path").alias("proof_sha256"), root.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
