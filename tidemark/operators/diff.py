"""Differences of two relations, in one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def except_diff(current: DataFrame, previous: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (as a set, null equal to null) of one side only, with ``side``: added or removed.

    Both sides are united and grouped once, with partial aggregation, instead of two set differences.
    """
    columns = columns or current.columns
    both = current.select(*columns, F.lit(True).alias("__now")).unionByName(previous.select(*columns, F.lit(False).alias("__now")))
    seen = both.groupBy(*columns).agg(F.bool_or("__now").alias("__here"), F.bool_and("__now").alias("__only"))
    side = F.when(F.col("__only"), "added").when(~F.col("__here"), "removed")
    return seen.withColumn("side", side).where("side is not null").drop("__here", "__only")


def added(current: DataFrame, previous: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return except_diff(current, previous, columns).where("side = 'added'").drop("side")


def removed(current: DataFrame, previous: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return except_diff(current, previous, columns).where("side = 'removed'").drop("side")


def apply_diff(base: DataFrame, diff: DataFrame) -> DataFrame:
    """The set that ``diff`` makes of ``base``: ``apply_diff(b, except_diff(a, b))`` has the rows of ``a``."""
    gone = diff.where("side = 'removed'").drop("side")
    return base.subtract(gone).unionByName(diff.where("side = 'added'").drop("side").select(base.columns))


def capture_diff(captures: DataFrame, earlier: object, later: object, at: str = "captured_at") -> DataFrame:
    """What changed between two captures of one relation."""
    columns = [c for c in captures.columns if c != at]
    return except_diff(captures.where(F.col(at) == later), captures.where(F.col(at) == earlier), columns)


def backlog_from_states(current: DataFrame, previous: DataFrame, keys: list[str], ts: Column) -> DataFrame:
    """After-images that lead from one state to the next: I, U and D (with the old image), in place of triggers."""
    values = [c for c in current.columns if c not in keys]
    new = current.select(*keys, F.struct(*values).alias("__new"))
    old = previous.select(*keys, F.struct(*values).alias("__old"))
    both = new.join(old, keys, "full")
    operation = F.when(F.col("__old").isNull(), "I").when(F.col("__new").isNull(), "D").when(~F.col("__new").eqNullSafe(F.col("__old")), "U")
    image = F.coalesce("__new", "__old")
    return both.select(ts.alias("ts"), operation.alias("operation"), *keys, image.alias("__image")).where("operation is not null").select("ts", "operation", *keys, "__image.*")


def schema_diff(before: DataFrame, after: DataFrame, name: str = "name", kind: str = "type", order: str = "ordinal") -> DataFrame:
    """``kind``, ``name``, ``before_type``, ``after_type``, ``position``: adds in the new order, retypes, then drops in the old order.

    Types are compared as they are written; renames and order are not seen.
    """
    a = before.select(F.col(name).alias("name"), F.col(kind).alias("before_type"), F.col(order).alias("__from"), F.lit(True).alias("__a"))
    b = after.select(F.col(name).alias("name"), F.col(kind).alias("after_type"), F.col(order).alias("__to"), F.lit(True).alias("__b"))
    both = a.join(b, "name", "full")
    change = F.when(F.col("__a").isNull(), "add").when(F.col("__b").isNull(), "drop").when(~F.col("before_type").eqNullSafe(F.col("after_type")), "retype")
    rank = F.when(F.col("kind") == "add", F.lit(0)).when(F.col("kind") == "retype", F.lit(1)).otherwise(F.lit(2))
    found = both.select(change.alias("kind"), "name", "before_type", "after_type", F.coalesce(F.when(change == "drop", F.col("__from")), F.col("__to")).alias("position")).where("kind is not null")
    return found.orderBy(rank, "position", "name")


def column_set_compare(expected: DataFrame, actual: DataFrame, families: dict[str, str], name: str = "name", kind: str = "type") -> DataFrame:
    """``name``, ``problem`` (missing, extra or family) of columns that a round trip has not kept; families map a type to its class."""
    family = F.create_map(*[F.lit(x) for pair in families.items() for x in pair]) if families else F.create_map(F.lit(""), F.lit(""))
    a = expected.select(F.col(name).alias("name"), F.col(kind).alias("expected_type"), F.lit(True).alias("__a"))
    b = actual.select(F.col(name).alias("name"), F.col(kind).alias("actual_type"), F.lit(True).alias("__b"))
    both = a.join(b, "name", "full")
    of = lambda c: F.coalesce(F.try_element_at(family, F.col(c)), F.col(c))
    problem = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(~of("expected_type").eqNullSafe(of("actual_type")), "family")
    return both.select("name", "expected_type", "actual_type", problem.alias("problem")).where("problem is not null")
