"""Running totals and places in an order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stored

DIGIT = 20  # bits of a key that one window orders, so its partitions have 2 ** DIGIT rows at most
AT_ONCE = 4096  # rows that one list of numbers stands for


def running(counts: DataFrame, group: str, key: str, n: str, bits: int = 64) -> DataFrame:
    """`counts` with `before`, the sum of `n` over smaller keys of the group, and the group's `total`.

    Keys are longs of `bits` bits with sign and occur once per group; neither they nor groups are
    missing. A directory like that of a radix tree: sums per higher digits come first, in the same
    way, then each window has only the keys that share these digits. Read more than once, so pass
    something stored.
    """
    own = Window.partitionBy(group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    if bits <= DIGIT:
        total = F.sum(n).over(Window.partitionBy(group))
        return counts.withColumn("before", F.coalesce(F.sum(n).over(own), F.lit(0))).withColumn("total", total)
    high = f"_high{bits}"  # a name of its own at each depth
    above = F.shiftright(key, DIGIT).alias(high)
    sums = counts.groupBy(group, above).agg(F.sum(n).alias("_n"))
    upper = running(sums, group, high, "_n", bits - DIGIT).select(
        group, high, F.col("before").alias("_before"), "total"
    )
    inner = Window.partitionBy(group, high).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.select("*", above).withColumn("_inner", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    joined = rows.join(upper, [group, high])
    return joined.select(*counts.columns, (F.col("_before") + F.col("_inner")).alias("before"), "total")


def numbered(rows: DataFrame, by: str, into: str = "place") -> DataFrame:
    """`rows`, distinct in `by`, with their places from 0 in its order.

    They are dealt by ranges; each range is numbered for itself, and what is summed up in one
    window are the ranges' sizes.
    """
    dealt = rows.repartitionByRange(F.col(by)).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    placed = dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_range")
    return placed.select(*rows.columns, (F.col("_start") + F.col("_inside")).alias(into))


def repeated(rows: DataFrame, times: str, into: str = "copy") -> DataFrame:
    """Every row `times` times, numbered from 0; many copies of one row are made by several tasks.

    `rows` are read twice, and have no column of the names `into` and `into`_first.
    """
    first, few = f"{into}_first", F.col(times).between(1, AT_ONCE)
    upto = F.sequence(F.lit(0).cast("long"), F.col(times) - 1)
    starts = F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(AT_ONCE).cast("long"))
    last = F.least(F.col(first) + AT_ONCE, F.col(times)) - 1
    blocks = rows.filter(F.col(times) > AT_ONCE).withColumn(first, F.explode_outer(starts)).hint("rebalance")
    many = blocks.withColumn(into, F.explode_outer(F.sequence(F.col(first), last))).drop(first)
    return rows.filter(few).withColumn(into, F.explode_outer(upto)).unionByName(many)
