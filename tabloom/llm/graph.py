"""Connected components of a graph whose links are rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def _signature(edges: DataFrame) -> tuple:
    """Number of links and an order-free sum of their hashes."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _lowest(links: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, itself included. Partial before the shuffle."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every node of a link: the smallest node that links reach.

    Alternating star contraction: all larger neighbours of a node move to its smallest
    neighbour, then all smaller ones, until nothing changes; the number of rounds grows
    with the logarithm of the longest path. Every step is a written table, so a lost
    executor costs one task, and both sides of a join are scans, which adaptive execution
    splits where one node has very many links. Links of a node with itself, links with a
    null end and repeated links change nothing; no links give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    now = scratch.write(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .distinct(),
        "links",
    )
    before, seen = None, _signature(now)
    while seen != before and seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(_lowest(both), "lowest")
        large = scratch.write(
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        lower = scratch.write(_lowest(large), "lowest")
        moved = large.join(lower, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
            .alias("e")
        )
        after = scratch.write(moved.select("e.*").where("u != v").distinct(), "links")
        scratch.drop(now, low, large, lower)
        now, before, seen = after, seen, _signature(after)
    # Now every link goes from a node to the smallest node of its component.
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
