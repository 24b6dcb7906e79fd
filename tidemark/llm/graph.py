"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SMALL = 100_000  # edges (1.6 MB as longs) that one task works on, so that a round needs no shuffle


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both ends; not as a union, which would break up a single partition."""
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return edges.select(both.alias("e")).select("e.a", "e.b")


def _with_least(rows: DataFrame, key: str, value: str, few: bool) -> DataFrame:
    """Adds m, the least ``value`` of each key: by a join, which can split hot keys, or for few rows in their one partition."""
    if few:
        return rows.withColumn("m", F.min(value).over(Window.partitionBy(key)))
    return rows.join(rows.groupBy(key).agg(F.min(value).alias("m")), key)


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    sides = _with_least(_both_ways(edges), "a", "b", few).where("b > a")
    return sides.select(F.least("a", "m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """A node and its neighbours below it are tied to the least of these."""
    down = _with_least(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), "u", "v", few)  # v < u
    # the row of the least neighbour itself becomes the node's own edge
    return down.select(F.col("m").alias("a"), F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); the component is its least node.

    Alternating stars: each round ties nodes closer to the least one, and the
    rounds end, after about the logarithm of the longest path, when a round
    changes nothing.  Edges with a null end or equal ends count for nothing.
    A node of many edges is a hot key only of counted minima and of joins with
    one row per node on the other side, which Spark can split.  Up to ``SMALL``
    edges, counted first, stay in one partition.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    few = now.count() <= SMALL
    seen = None
    while True:
        now = now.coalesce(1) if few else now
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = cut(_small_star(_large_star(now, few), few))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
