"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import stored


def _mark(edges: DataFrame):
    """Tells two sets of edges apart, with overwhelming likelihood."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) of longs; root is the smallest reachable.

    Alternates two steps on edges that point from larger to smaller nodes: every node's larger
    neighbours are tied to its smallest neighbour, then its smaller ones are. That takes a number
    of rounds logarithmic in the longest chain. Smallest neighbours are aggregates, so a node with
    very many links is no hot key; each round is written, so nothing is computed twice. Loops and
    repeated links do not matter; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.filter("a != b").distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        larger = both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = stored(larger.distinct(), "edges")
        smallest = larger.groupBy("a").agg(F.min("b").alias("m"))
        tied = larger.join(smallest, "a")
        edges = tied.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            smallest.select("a", F.col("m").alias("b"))
        )
        edges = stored(edges.distinct(), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
