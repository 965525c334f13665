"""Prefix scans over one global order, without a window that puts all rows into one task.

The order column is numeric (a version, an id, an epoch). Rows are dealt into up to ``buckets`` stretches between
quantiles of it, so a value far from the others holds up no task; each stretch is scanned on its own, and what the
stretches before it add up to comes from a table of one row per stretch. Rows of one order value share a stretch.
An empty input gives an empty result; a null order value goes to the first stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__stretch"


def stretched(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """``df`` with the stretch that each row's order value falls into."""
    shares = [i / buckets for i in range(1, buckets)]
    value = F.col(order).cast("double")
    bounds = sorted(set(df.select(value.alias("v")).approxQuantile("v", shares, 1 / (4 * buckets)))) if shares else []

    def place(low: int, high: int) -> Column:
        """The number of bounds below the value, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > bounds[middle], place(middle + 1, high)).otherwise(place(low, middle))

    return df.withColumn(BUCKET, F.when(value.isNull(), F.lit(0)).otherwise(place(0, len(bounds))).cast("int"))


def _before(totals: DataFrame, value: Column) -> DataFrame:
    """One row for each stretch (at most ``buckets``): the value over all stretches before it."""
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select(F.col(BUCKET).alias("__at"), value.over(earlier).alias("__before")))


def _joined(dealt: DataFrame, before: DataFrame) -> DataFrame:
    return dealt.join(before, dealt[BUCKET] == before["__at"]).drop("__at")


def running_max(df: DataFrame, order: str, value: str, name: str, tie: list[str] | None = None, buckets: int = 200) -> DataFrame:
    """``name``: the greatest ``value`` up to and with each row in the global order."""
    dealt = stretched(df, order, buckets)
    before = _before(dealt.groupBy(BUCKET).agg(F.max(value).alias("m")), F.max("m"))
    inside = Window.partitionBy(BUCKET).orderBy(order, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
    return _joined(dealt.withColumn(name, F.max(value).over(inside)), before).withColumn(name, F.greatest(name, "__before")).drop(BUCKET, "__before")


def running_sum(df: DataFrame, order: str, value: str, name: str, tie: list[str] | None = None, buckets: int = 200) -> DataFrame:
    """``name``: the sum of ``value`` up to and with each row in the global order."""
    dealt = stretched(df, order, buckets)
    before = _before(dealt.groupBy(BUCKET).agg(F.sum(value).alias("m")), F.sum("m"))
    inside = Window.partitionBy(BUCKET).orderBy(order, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
    return _joined(dealt.withColumn(name, F.sum(value).over(inside)), before).withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop(BUCKET, "__before")


def row_numbers(df: DataFrame, order: str, name: str, tie: list[str] | None = None, buckets: int = 200) -> DataFrame:
    """``name``: 1, 2, 3, ... in the global order (ids for a bulk load)."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("bigint")), order, "__one", name, tie, buckets).drop("__one")


def previous(df: DataFrame, order: str, columns: list[str], prefix: str = "prev_", tie: list[str] | None = None, buckets: int = 200) -> DataFrame:
    """The columns' values in the row before, in the global order (null for the first)."""
    dealt = stretched(df, order, buckets)
    keys = [order, *(tie or [])]
    last = dealt.groupBy(BUCKET).agg(F.max_by(F.struct(*columns), F.struct(*keys)).alias("m"))
    before = _before(last, F.last("m"))
    inside = Window.partitionBy(BUCKET).orderBy(*keys)
    own = dealt.withColumn("__first", F.row_number().over(inside) == 1).withColumns({f"{prefix}{c}": F.lag(c).over(inside) for c in columns})
    out = _joined(own, before)
    return out.withColumns({f"{prefix}{c}": F.when(F.col("__first"), F.col(f"__before.{c}")).otherwise(F.col(f"{prefix}{c}")) for c in columns}).drop(BUCKET, "__before", "__first")
