"""Relations between relations: what has no partner, what is named elsewhere, categories, lateral tables, sequences.

Edge cases: empty inputs give empty results (or the left side whole, where nothing matches); a null key matches
nothing, unless keys are compared null-safely as said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.profile import equi_depth


def undeleted(insertions: DataFrame, deletions: DataFrame, keys: list[str], inserted: str, deleted: str) -> DataFrame:
    """Insertions without a deletion of the same key after them (C19): compared with the key's last deletion, so one row a key is joined."""
    last = deletions.groupBy(*keys).agg(F.max(deleted).alias("__gone"))
    return insertions.join(last, [*keys], "left").where(F.col("__gone").isNull() | (F.col("__gone") < F.col(inserted))).drop("__gone")


def members(rows: DataFrame, named: DataFrame, on: dict[str, str], flag: str = "is_member") -> DataFrame:
    """Every row, and whether ``named`` lists it (C21, a semi-join that keeps the rest); ``on`` maps columns to those of ``named``."""
    listed = named.select(*[F.col(theirs).alias(f"__{mine}") for mine, theirs in on.items()]).distinct().withColumn("__found", F.lit(True))
    same = F.lit(True)
    for mine in on:
        same = same & (F.col(mine) == F.col(f"__{mine}"))
    return rows.join(listed, same, "left").withColumn(flag, F.coalesce("__found", F.lit(False))).select(*rows.columns, flag)


def by_category(rows: DataFrame, categories: str, wanted: list[str] | None = None, name: str = "category") -> DataFrame:
    """A row for each category of an array column (C23); rows without one stay, with a null, unless some are asked for."""
    out = rows.select(*[c for c in rows.columns if c != categories], F.explode_outer(categories).alias(name))
    return out if wanted is None else out.where(F.col(name).isin(wanted))


def lateral_histograms(df: DataFrame, columns: list[str], steps: int) -> DataFrame:
    """The histogram of each named column beside its name (C14, a lateral table function)."""
    out: DataFrame | None = None
    for column in columns:
        own = equi_depth(df, column, steps).select(F.lit(column).alias("column_name"), "step", F.col("range_high_key").cast("double").alias("range_high_key"), "equal_rows", "range_rows")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no columns")
    return out


def collect_where(df: DataFrame, group: list[str], value: str, condition: Column, name: str = "items") -> DataFrame:
    """A group's values for which ``condition`` holds, sorted, as a JSON array (D7); a group without any has an empty one."""
    return df.groupBy(*group).agg(F.to_json(F.array_sort(F.collect_list(F.when(condition, F.col(value))))).alias(name))


def per_capture(captures: DataFrame, at: str = "captured_at") -> DataFrame:
    """Rows and distinct rows of each capture (D19)."""
    return captures.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*[c for c in captures.columns if c != at])).alias("distinct_rows"))


def sequence(spark: SparkSession, count: int, start: int = 0) -> DataFrame:
    """``i`` from ``start`` on (E9), made by the tasks."""
    return spark.range(start, start + count).select(F.col("id").alias("i"))


def greatest(df: DataFrame, column: str) -> DataFrame:
    """The greatest value, of whole values and never of cut statistics (F3): an aggregate, not a sort."""
    return df.agg(F.max(column).alias("greatest"))


def nulls_first(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows with nulls before all values (F6)."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(limit)


def flags_of(value: Column, names: list[str]) -> list[Column]:
    """A bit mask as booleans, the lowest bit first (H29)."""
    return [(value.bitwiseAND(F.lit(1 << i)) != 0).alias(name) for i, name in enumerate(names)]


def columns_of_sources(columns: DataFrame, sources: DataFrame, key: str, source: str) -> DataFrame:
    """Columns and tables of each source (D18)."""
    return columns.join(sources, key).groupBy(source).agg(F.count(F.lit(1)).alias("columns"), F.count_distinct(F.col(key)).alias("tables"))
