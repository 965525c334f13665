"""Access decisions over versioned catalogs: closures of membership, allow and deny."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, materialize


def closure(edges: DataFrame, child: str, parent: str, most_depth: int = 1024, reflexive: bool = False) -> DataFrame:
    """(child, parent) of all paths. Each round joins the paths that the last one found with all that are known, so no pair is derived
    from old ones again, and a chain takes rounds by the logarithm of its length: a shortest path of up to twice the length known
    begins with one of the last round.

    A cycle ends by itself; ``most_depth`` guards against chains without an end. Rounds are tables in the
    shared folder, of which only the last two are kept.
    """
    step = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child is not null and parent is not null").distinct()
    known = first = last = materialize(step, "closure")
    for _ in range(max(1, most_depth - 1).bit_length() + 1):
        reached = last.alias("a").join(known.alias("b"), F.col("a.parent") == F.col("b.child")).select(F.col("a.child"), F.col("b.parent"))
        fresh = materialize(reached.distinct().join(known, ["child", "parent"], "left_anti"), "paths")
        if fresh.isEmpty():
            discard(fresh)
            break
        after = materialize(known.unionByName(fresh), "closure")
        if last is not first:
            discard(last)
        if known is not first:
            discard(known)
        known, last = after, fresh
    else:
        raise RuntimeError(f"paths are longer than {most_depth}")
    if reflexive:
        ends = first.select("child").union(first.select("parent")).distinct()
        known = known.unionByName(ends.select("child", F.col("child").alias("parent"))).distinct()
    return known.select(F.col("child").alias(child), F.col("parent").alias(parent))


def decide(rules: DataFrame, by: list[str], effect: str = "effect") -> DataFrame:
    """``allowed``: some rule allows and none denies."""
    return rules.groupBy(*by).agg((F.bool_or(F.col(effect) == "allow") & ~F.bool_or(F.col(effect) == "deny")).alias("allowed"))


def access(grants: DataFrame, members: DataFrame | None = None, resources: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """principal, resource, allowed after memberships (principal, member_of) and containment (resource, parent) are followed.

    ``wanted`` (principal, resource) asks for those pairs, and denies what no rule names.
    """
    rules = grants
    if members is not None:
        up = closure(members, "principal", "member_of").select(F.col("principal").alias("__who"), F.col("member_of").alias("principal"))
        rules = rules.unionByName(rules.join(up, "principal").drop("principal").withColumnRenamed("__who", "principal").select(rules.columns))
    if resources is not None:
        down = closure(resources, "resource", "parent").select(F.col("resource").alias("__what"), F.col("parent").alias("resource"))
        rules = rules.unionByName(rules.join(down, "resource").drop("resource").withColumnRenamed("__what", "resource").select(rules.columns))
    found = decide(rules, ["principal", "resource"])
    if wanted is None:
        return found
    return wanted.join(found, ["principal", "resource"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
