"""Connected components over an edge table, with the driver holding counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, materialize


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 64) -> DataFrame:
    """node, component for every node of ``edges``; component is the smallest node that edges reach.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round links nodes to smaller
    ones only, so hubs turn into flat stars and the number of rounds grows with the logarithm of a path's
    length. Minima are aggregated before they are joined back, so a hub's neighbours never meet in one task.
    Each step is a table in the shared folder, so a join's sides are plain shuffles, of which adaptive
    execution splits a hub's; the tables of the round before are deleted.
    """
    a, b = F.col(u), F.col(v)
    now = materialize(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        found = state(after)
        for old in (now, low, large, least):
            discard(old)
        now = after
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def state(edges: DataFrame) -> tuple[int, int]:
    """Count and checksum: equal before and after a round once nothing changes."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
