"""Connected components of a table of links, by contraction: no vertex's links are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, not null). Gives id and root, the smallest id of its component, for every id in a link.

    Each round draws a priority for every vertex by hash, hooks it to the best of itself and its neighbours, follows one
    more hop, and contracts the links. As priorities are new in each round, about a third of the vertices of a path stay
    at most, whatever the order of its ids, so rounds grow with the logarithm of a component. Hooks are minima and need
    no more than one row per key and task; joins on hot vertices are split by AQE."""
    edges = stored(links.select("a", "b").where("a <> b").distinct())
    roots, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("p"), F.col(c).alias("v"))  # noqa: B023, E731
        hooks = stored(both.groupBy("a").agg(F.least(drawn("a"), F.min(drawn("b")))["v"].alias("up")))
        over = hooks.select(F.col("a").alias("up"), F.col("up").alias("top"))
        hops = stored(hooks.join(over, "up").select(F.col("a").alias("id"), F.col("top").alias("to")))
        if roots is None:
            roots = hops.select("id", F.col("to").alias("root"))
        else:
            # roots that took part in this round move on
            moved = hops.select(F.col("id").alias("root"), "to")
            roots = stored(roots.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        ends = hops.select(F.col("id").alias("a"), F.col("to").alias("x"))
        other = hops.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = stored(
            edges.join(ends, "a").join(other, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        )
        turn += 1
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    least = roots.groupBy("root").agg(F.min("id").alias("least"))
    return stored(roots.join(least, "root").select("id", F.col("least").alias("root")))
