"""Connected components by min-label propagation with pointer jumping, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` through plain exchanges, so that adaptive execution can split a hot key."""
    return left.withColumn("_k", F.xxhash64(key)).join(right.withColumn("_k", F.xxhash64(key)), ["_k", key], how).drop("_k")


def label(edges: DataFrame, names: DataFrame, work: runtime.Workspace, most_rounds: int = 200) -> DataFrame:
    """The least name that each vertex reaches.

    edges: (x, y), undirected, between vertices; names: (v, name), one a vertex, any orderable
    name. Returns (v, name, root): the least (name, vertex) of v's component. Every vertex of
    ``names`` is returned, so one without edges keeps its own. Each round takes the least label
    among the neighbours (pre-aggregated before the shuffle) and then jumps to the label of
    that label's vertex, so rounds grow with the logarithm of the longest chain.
    """
    both = work.save(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    if both.isEmpty():
        return names.select("v", "name", F.col("v").alias("root"))
    touched = both.select(F.col("x").alias("v")).distinct()
    labels = work.save(joined(names.select("v", "name"), touched, "v", "left_semi").select("v", F.struct("name", F.col("v").alias("root")).alias("l")))
    kept = labels
    for _ in range(most_rounds):
        heard = joined(both, labels.select(F.col("v").alias("x"), "l"), "x").groupBy(F.col("y").alias("v")).agg(F.min("l").alias("m"))
        met = labels.join(heard, "v").select("v", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        met = met.select("v", "was", "l", F.col("l.root").alias("p"))
        jump = joined(met, labels.select(F.col("v").alias("p"), F.col("l").alias("far")), "p").select("v", "was", F.least("l", "far").alias("l"))
        after = work.save(jump)
        changed = not after.where("was <> l").isEmpty()
        work.drop(kept)
        labels, kept = after.select("v", "l"), after
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = F.struct("name", F.col("v").alias("root"))
    found = joined(names.select("v", "name"), labels, "v", "left").select("v", F.coalesce("l", own).alias("l"))
    return found.select("v", F.col("l.name").alias("name"), F.col("l.root").alias("root"))
