"""Fixity audit of web archives by Merkle trees over ordered offset ranges.

A page is a WARC record. Records lie in shards, one after the other by page_id, so each has an
offset. A record's leaf hashes its place and its bytes; a node hashes the offsets and digests of up to FANOUT
nodes that follow each other, up to one root per shard, and shards' roots are treated alike up to
one root of all. Two replicas are compared from the root: of each level only the children of
nodes that differ are looked at, so what is joined is FANOUT times the damage, not the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stored

FANOUT = 16
SHARD_RECORDS = 512  # of a shard, about

_END = "\r\n"


def record(url: Column, payload: Column) -> Column:
    """The bytes of a WARC resource record; a missing address or payload is empty."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: resource{_END}WARC-Record-ID: <urn:sha256:"),
        F.sha2(url, 256), F.lit(f">{_END}WARC-Date: 1970-01-01T00:00:00Z{_END}WARC-Target-URI: "), url,
        F.lit(f"{_END}Content-Type: text/html{_END}Content-Length: "),
        F.octet_length(payload).cast("string"), F.lit(_END * 2),
    )
    return F.encode(F.concat(head, payload, F.lit(_END * 2)), "utf-8")


def records(pages: DataFrame, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(page_id, shard, record): the records of pages, dealt to shards by a hash of the address, so
    that no host fills one."""
    n = pages.count()
    shards = max(1, -(-n // shard_records))
    url = F.coalesce(F.col("url"), F.lit(""))
    spread = F.concat_ws(":", url, F.coalesce(F.col("page_id"), F.lit(-1)).cast("string"))
    shard = F.conv(F.substring(F.md5(spread), 1, 8), 16, 10).cast("long") % shards
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), shard.alias("shard"),
        record(F.col("url"), F.col("html")).alias("record"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """`rows` with seq, start and stop: they follow each other by page_id within a shard.

    They have page_id, shard, length and sha256. Pages without an id come last; repeated rows are
    records of their own, in any order among themselves.
    """
    order = Window.partitionBy("shard").orderBy(F.asc_nulls_last("page_id"), "sha256")
    stop = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    seq = (F.row_number().over(order) - 1).cast("long")
    numbered = rows.withColumn("seq", seq).withColumn("stop", stop)
    return numbered.withColumn("start", F.col("stop") - F.col("length"))


def measured(rows: DataFrame) -> DataFrame:
    """`rows` with length and sha256 in the place of the record, so that no bytes are shuffled."""
    length = F.octet_length("record").cast("long")
    kept = [c for c in rows.columns if c != "record"]
    return rows.select(*kept, length.alias("length"), F.sha2("record", 256).alias("sha256"))


def archive(pages: DataFrame, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(page_id, shard, record, length, sha256, seq, stop, start): records at their places."""
    rows = records(pages, shard_records)
    length = F.octet_length("record").cast("long")
    return placed(rows.withColumn("length", length).withColumn("sha256", F.sha2("record", 256)))


def leaves(index: DataFrame) -> DataFrame:
    """(shard, at, start, stop, digest) of an index, which need not have all records of its shards.

    A leaf hashes a record's place with its bytes, so records that have moved differ.
    """
    digest = F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.col("stop").cast("string"), "sha256"), 256)
    return index.select("shard", F.col("seq").alias("at"), "start", "stop", digest.alias("digest"))


def _parents(nodes: DataFrame, by: str) -> DataFrame:
    """Nodes over up to FANOUT neighbours, that are numbered by `by` within the rest of the key."""
    child = F.struct(F.col(by).alias("number"), "start", "stop", "digest")
    own = F.floor(F.col(by) / FANOUT).cast("long")
    key = [own.alias("shard"), F.lit(0).cast("long").alias("at")] if by == "shard" else ["shard", own.alias("at")]
    held = nodes.groupBy(*key).agg(F.array_sort(F.collect_list(child)).alias("held"))  # <= FANOUT
    text = F.array_join(F.transform("held", lambda c: F.concat_ws(
        ":", c["number"].cast("string"), c["start"].cast("string"), c["stop"].cast("string"), c["digest"]
    )), ",")
    return held.select(
        "shard", "at", F.element_at("held", 1)["start"].alias("start"),
        F.element_at("held", -1)["stop"].alias("stop"), F.sha2(text, 256).alias("digest"),
    )


def tree(bottom: DataFrame, records_in_shard: int, shards: int) -> list[tuple[str, DataFrame]]:
    """Levels from the leaves to the root, each with what numbers its nodes: at, then shard.

    The first level above the leaves is written, as all others follow from it.
    """
    levels, size = [("at", bottom)], records_in_shard
    while size > 1:
        size = -(-size // FANOUT)
        parents = _parents(levels[-1][1], "at")
        levels.append(("at", stored(parents, "merkle-level") if len(levels) == 1 else parents))
    while shards > 1:
        shards = -(-shards // FANOUT)
        levels.append(("shard", _parents(levels[-1][1], "shard")))
    return levels


def differing(first: list[tuple[str, DataFrame]], second: list[tuple[str, DataFrame]]) -> DataFrame:
    """(shard, at, digest, other_digest) of leaves that differ, found from the root down.

    A digest is missing where that replica lacks the leaf.
    """
    bad = None
    for k in range(len(first) - 1, -1, -1):
        sides = []
        for levels, name in ((first, "digest"), (second, "other_digest")):
            nodes = levels[k][1].select("shard", "at", F.col("digest").alias(name))
            if bad is not None:
                by = levels[k + 1][0]  # what the level above groups by
                number = F.floor(F.col(by) / FANOUT).cast("long").alias("parent")
                up = nodes.select("*", number)
                parent = bad.select(*([F.col("shard").alias("parent")] if by == "shard" else
                                      ["shard", F.col("at").alias("parent")]))
                nodes = up.join(parent, ["parent"] if by == "shard" else ["shard", "parent"], "left_semi").drop("parent")
            sides.append(nodes)
        both = sides[0].join(sides[1], ["shard", "at"], "full_outer")
        bad = stored(both.filter(~F.col("digest").eqNullSafe(F.col("other_digest"))), "differing")
    return bad


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of two indexes (page_id, shard, seq, start, stop, sha256) with its state.

    Returns page_id, shard, seq, start, length, sha256, replica_sha256 and state: `ok`, `altered`
    (other bytes), `moved` (the same bytes elsewhere in the shard), `missing` from the replica or
    `extra`, which only the replica has; of the last, place and page_id are the replica's. Records
    are one if shard and seq are. Two empty indexes give no rows.
    """
    columns = ("page_id", "shard", "seq", "start", "stop", "sha256")
    mine = stored(original.select(*columns), "original-index")
    other = stored(replica.select(*columns), "replica-index")
    most = mine.unionByName(other).agg(F.max("seq"), F.max("shard")).first()
    size, shards = ((most[0] or 0) + 1, (most[1] or 0) + 1)
    bad = differing(tree(leaves(mine), size, shards), tree(leaves(other), size, shards))
    places = bad.select("shard", F.col("at").alias("seq"))
    theirs = other.join(places, ["shard", "seq"], "left_semi").select(
        "shard", "seq", *(F.col(c).alias(f"other_{c}") for c in ("page_id", "start", "stop", "sha256"))
    )
    found = places.withColumn("bad", F.lit(True)).join(theirs, ["shard", "seq"], "left")
    state = (
        F.when(F.col("bad").isNull(), "ok").when(F.col("sha256").isNull(), "extra")
        .when(F.col("other_sha256").isNull(), "missing")
        .when(F.col("sha256") == F.col("other_sha256"), "moved").otherwise("altered")
    )
    start = F.coalesce("start", "other_start")
    return mine.join(found, ["shard", "seq"], "full_outer").select(
        F.when(F.col("sha256").isNull(), F.col("other_page_id")).otherwise(F.col("page_id")).alias("page_id"),
        "shard", "seq", start.alias("start"), (F.coalesce("stop", "other_stop") - start).alias("length"),
        "sha256", F.when(F.col("bad").isNull(), F.col("sha256")).otherwise(F.col("other_sha256"))
        .alias("replica_sha256"),
        state.alias("state"),
    )


def damaged(column: Column, page_id: Column) -> Column:
    """A record of a copy in which some are lost (missing) and some have one byte changed, by page_id."""
    middle = F.floor(F.octet_length(column) / 2).cast("int")
    changed = F.concat(
        F.substring(column, F.lit(1), middle), F.lit(b"\x00"),
        F.substring(column, middle + 2, F.octet_length(column)),
    )
    altered = F.coalesce(page_id % 101 == 7, F.lit(False))
    lost = F.coalesce(page_id % 211 == 5, F.lit(False))
    return F.when(~lost, F.when(altered, changed).otherwise(column))


def audit_copy(pages: DataFrame) -> DataFrame:
    """The audit of the archive of `pages` against a damaged copy with the same places.

    Records and their copies are hashed where they are read; what is shuffled are their digests.
    """
    rows = records(pages)
    copy = F.sha2(damaged(F.col("record"), F.col("page_id")), 256)
    index = stored(placed(measured(rows.withColumn("copy", copy))), "index")
    replica = index.filter(F.col("copy").isNotNull()).withColumn("sha256", F.col("copy"))
    return audit(index, replica)
