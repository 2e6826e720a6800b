"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import cut, stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return tuple(r)


def components(edges: DataFrame, src: str = "u", dst: str = "v", rounds: int = 40) -> DataFrame:
    """``(node, component)`` of every node that has an edge; component is the least node reachable.

    ``edges`` holds undirected links in any direction; loops, repeats and null
    ends are ignored. Each round is two grouped minima joined back to the edges,
    so no list of a hub's neighbours is ever built; lineage is cut every round.
    No edges give no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = cut(e.where("u > v and v is not null and u is not null").distinct())
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are stored before their joins, so that Spark may split a hub's edges there
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u > v").distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u").select("u", "v", "m")
        e = cut(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u > v").distinct()
        )
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = e.groupBy("u").agg(F.min("v").alias("component"))
    tops = root.select(F.col("component").alias("node")).distinct()
    return root.withColumnRenamed("u", "node").unionByName(tops.select("node", F.col("node").alias("component")))
