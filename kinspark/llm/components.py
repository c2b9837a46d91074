"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a grouped minimum and an equi-join, so nothing is gathered per
vertex: a hub with a third of all edges only makes one join key heavy, which
AQE can split. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.shared import stored


def _point_to_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): v becomes a child of the least vertex among u and u's neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """(node, component): component is the least node reachable. Only nodes that occur in an edge come back.

    Null ends and loops are ignored; repeated edges do no harm; an empty table gives an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    star = stored(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "star")
    before = None
    for _ in range(max_rounds):
        # Large star: among both directions, larger neighbours hang on the least one.
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _point_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours and the vertex itself hang on the least one.
        small = _point_to_least(large)
        star = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "star")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == before or now[0] == 0:
            break
        # Every vertex has one parent, and no parent has one: these are stars already.
        if now[0] == now[2] and star.join(star.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = star.select(F.col("v").alias("node")).distinct().join(star.select(F.col("u").alias("node")), "node", "left_anti")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
