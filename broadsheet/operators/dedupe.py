"""First row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import session
from broadsheet.session import broadcast_if_few, settle

BLOCK = 32_768  # bits in one of Spark's bitmaps
CELLS = 32  # cells per wanted place, at least
MOST_PLACES = 8_000_000  # wanted places up to which bitmaps of their cells are broadcast: 64 MB

def first_places(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(_key, _order, _n): the first place of every key in the order, and how many rows stand there.

    Every task first reduces its keys to one place each, so a key that holds most of the rows is
    not collected in one task.
    """
    places = rows.groupBy(F.col(key).alias("_key"), F.col(order).alias("_order")).agg(F.count(F.lit(1)).alias("_n"))
    first = places.groupBy("_key").agg(F.min(F.struct("_order", "_n")).alias("_first"))
    return settle(first.select("_key", "_first._order", "_first._n"))


def rows_at(rows: DataFrame, first: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each of the places in `first`.

    They are fetched by a broadcast of the places if they are few, else of bitmaps, so that whole
    rows are not moved at all. Only where several rows of a key stand at its place are they told
    apart by their other columns.
    """
    named = F.col(key).eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_order"))

    def fetched(which: DataFrame) -> DataFrame:
        wanted = which.select("_key", "_order")
        n = wanted.count()
        if session.FEW_ROWS < n <= MOST_PLACES:
            return _by_cells(rows, wanted, key, order, n)
        return rows.join(broadcast_if_few(wanted), named).select(*rows.columns)

    several = first.filter("_n > 1")
    if several.isEmpty():
        return fetched(first)
    others = [c for c in rows.columns if c not in (key, order)]
    least = fetched(several).groupBy(key).agg(F.min(F.struct(order, *others)).alias("_first"))
    told = least.select(*[c if c == key else F.col("_first")[c].alias(c) for c in rows.columns])
    return fetched(first.filter("_n = 1")).unionByName(told)


def _bit(bitmap: str, at: str) -> Column:
    byte = F.substring(F.col(bitmap), (F.col(at) / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col(at) % 8).cast("int")) == 1


def _by_cells(rows: DataFrame, wanted: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The rows at `n` wanted places (_key, _order), without moving the others or them.

    Places are hashed to cells. All rows of a cell that has wanted places only are taken, and none
    of one without any; bitmaps of both kinds are broadcast. In cells that have both kinds, a few
    per cent of all, the places themselves decide.
    """
    cells = max(BLOCK, 1 << (CELLS * n - 1).bit_length())

    def celled(which: DataFrame, *place: str) -> DataFrame:
        cell = F.pmod(F.xxhash64(*place), F.lit(cells))
        return which.withColumn("_block", F.floor(cell / BLOCK)).withColumn("_at", cell % BLOCK)

    every = rows.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.lit(0).alias("_wanted"))
    places = every.unionByName(wanted.withColumn("_wanted", F.lit(1))).groupBy("_key", "_order").agg(
        F.max("_wanted").alias("_wanted")
    )
    kinds = celled(places, "_key", "_order").groupBy("_block", "_at").agg(
        F.min("_wanted").alias("_all"), F.max("_wanted").alias("_some")
    )
    bitmaps = F.broadcast(settle(kinds.filter("_some = 1").groupBy("_block").agg(
        F.bitmap_construct_agg(F.when(F.col("_all") == 1, F.col("_at"))).alias("_sure"),
        F.bitmap_construct_agg(F.when(F.col("_all") == 0, F.col("_at"))).alias("_mixed"),
    )))
    doubtful = celled(wanted, "_key", "_order").join(bitmaps, "_block").filter(_bit("_mixed", "_at"))
    named = F.col(key).eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_order"))
    told = broadcast_if_few(settle(doubtful.select("_key", "_order", F.lit(True).alias("_told"))))
    sure = _bit("_sure", "_at").alias("_sure")
    near = celled(rows, key, order).join(bitmaps, "_block").filter(_bit("_sure", "_at") | _bit("_mixed", "_at"))
    return near.select(*rows.columns, sure).join(told, named, "left").filter("_sure OR _told").select(*rows.columns)


def dedupe_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key by an order column; exactly one, whatever is delivered twice."""
    return rows_at(rows, first_places(rows, key, order), key, order)
