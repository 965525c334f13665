"""Semi-structured values: types per path by one aggregation, and hot paths as typed columns of their own.

A VARIANT column is *shredded* into typed columns for chosen keys and a remainder. A value goes into its column only if
it has the column's type exactly, so that putting both together again gives the same value; anything else stays in
the remainder. A filter on a shredded key then reads one narrow column, with the statistics that files keep of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of a variant that a typed column gives back as they were.
PLAIN = ("BIGINT", "STRING", "BOOLEAN", "DOUBLE", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ")


def parsed(column: Column) -> Column:
    """JSON text as a variant; text that is no JSON is null."""
    return F.try_parse_json(column)


def members(value: Column) -> Column:
    """An object's members as a map, null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def path_types(rows: DataFrame, column: str, depth: int = 4) -> DataFrame:
    """path, rows, nulls, type of every path of keys down to ``depth``: the type that all its values share."""
    level = rows.select(F.lit("$").alias("path"), F.col(column).alias("value")).where("value is not null")
    found = level
    for _ in range(depth):
        level = level.select("path", F.explode(members(F.col("value"))).alias("key", "value")).select(F.concat_ws(".", "path", "key").alias("path"), "value")
        found = found.unionByName(level)
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.is_variant_null("value")).alias("nulls"), F.schema_of_variant_agg("value").alias("type"))


def hot_keys(types: DataFrame, rows: int, share: float = 0.5, most: int = 32) -> dict[str, str]:
    """Keys of the top level that ``share`` of the rows have and whose values are of one plain type: the most frequent ``most``."""
    top = types.where(F.col("type").isin(*PLAIN) & F.col("path").rlike(r"^\$\.[A-Za-z_][A-Za-z0-9_]*$") & (F.col("rows") - F.col("nulls") >= F.lit(share * rows)))
    return {r["path"][2:]: r["type"] for r in top.orderBy(F.desc("rows"), "path").limit(most).collect()}


def shredded_name(column: str, key: str) -> str:
    return f"{column}__{key}"


def shred(rows: DataFrame, column: str, keys: dict[str, str]) -> DataFrame:
    """``rows`` with a typed column for each key, and ``column`` without the members that went there."""
    whole = F.col(column)
    fits = {k: F.coalesce(F.schema_of_variant(F.variant_get(whole, f"$.{k}", "variant")) == kind, F.lit(False)) for k, kind in keys.items()}
    typed = {shredded_name(column, k): F.when(fits[k], F.try_variant_get(whole, f"$.{k}", kind)) for k, kind in keys.items()}
    gone = F.array(*[F.when(fits[k], F.lit(k)) for k in keys]).cast("array<string>")
    rest = F.map_filter(members(whole), lambda k, _: ~F.coalesce(F.array_contains(F.array_compact(gone), k), F.lit(False)))
    left = F.when(members(whole).isNotNull(), F.to_variant_object(rest)).otherwise(whole)
    return rows.select(*[c for c in rows.columns if c != column], *[v.alias(n) for n, v in typed.items()], left.alias(column))


def unshred(rows: DataFrame, column: str, keys: dict[str, str]) -> DataFrame:
    """The rows as they were before :func:`shred`."""
    rest = members(F.col(column))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(shredded_name(column, k)).cast("variant").alias("value")) for k in keys])
    back = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    whole = F.when(rest.isNotNull(), F.to_variant_object(F.map_concat(rest, back))).otherwise(F.col(column))
    return rows.select(*[c for c in rows.columns if c != column and c not in {shredded_name(column, k) for k in keys}], whole.alias(column))


def path_statistics(rows: DataFrame, column: str, keys: dict[str, str]) -> DataFrame:
    """variant_path, shredded_type, value_count, null_count, min_value, max_value of the shredded keys, by one aggregation."""
    stats = [F.struct(F.lit(f"$.{k}").alias("variant_path"), F.lit(kind).alias("shredded_type"), F.count(shredded_name(column, k)).alias("value_count"), F.count_if(F.col(shredded_name(column, k)).isNull()).alias("null_count"), F.min(shredded_name(column, k)).cast("string").alias("min_value"), F.max(shredded_name(column, k)).cast("string").alias("max_value")) for k, kind in keys.items()]
    return rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))
