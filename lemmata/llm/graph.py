"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation with map-side combining and an equi-join, so no
node's neighbours, no component and no edge list is ever held by one task or
the driver.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs(u, v).  Large: every larger neighbour of u gets u's least neighbour.
    Small (pairs have u > v): u and its smaller neighbours get the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u")
    if large:
        linked = linked.where("v > u")
    out = linked.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return out.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u, v) of one orderable type -> (node, root): root is the least node
    that can be reached.  Nodes without an edge to another node have no row.
    Null ends and self-loops are ignored; repeated edges don't matter."""
    now = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seal = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        new = stage(_star(_star(both, large=True), large=False), "edges")
        unstage(now)
        now = new
        # a fixed point has the same edges: their number and the sum of their hashes stay
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seal or not mark[0]:
            break
        seal = mark
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
