"""Connected components over an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import stage

#: Rows (root, name) that are broadcast, at most.
BROADCAST_ROWS = 200_000


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def named_by_least(nodes: DataFrame) -> DataFrame:
    """(uid, component_id) for nodes (uid, least, root or null): the smallest ``least`` of each component.

    Only components of several nodes are joined, on their root. Their names are broadcast where they are few; beyond
    that the adaptive skew join splits a giant component.
    """
    several = nodes.where("root is not null")
    names = stage(several.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    near = F.broadcast if names.count() <= BROADCAST_ROWS else lambda df: df
    return (several.join(near(names), "root").select("uid", "component_id")
            .unionByName(nodes.where("root is null").select("uid", F.col("least").alias("component_id"))))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of ids to (node, root), root being the smallest id reachable; nodes without links are absent.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every round is two aggregations and joins on
    the node, the number of rounds is logarithmic in practice, and each round is a written table. A node with very
    many links is pre-aggregated before its shuffle and split by the adaptive skew join.
    """
    current = stage(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = _turned(current)
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u")
                 .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
                 .select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        current = stage(small, "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
