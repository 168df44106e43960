"""Connected components by alternating large and small stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of (src, dst): root is the smallest node that can be reached.

    Each round hangs the larger neighbours of every node on its smallest neighbour (large star), then the smaller ones
    (small star); a component of n nodes becomes a star in O(log n) rounds. No group is gathered: a node's minimum is a
    partial aggregate, and joins on a hub can be split by adaptive execution. Each round's edges are stored, so an
    executor that is lost costs at most one round. Null ends and loops are no edges.
    """
    e = edges.where("src is not null and dst is not null and src <> dst")
    e = e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stored(e, "edges")
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
