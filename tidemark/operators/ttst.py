"""Transaction-time state tables: synchronisation from payloads, pruning, upserts and outward projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.intervals import any_different, as_of_version, latest

START, END = "tt_start", "tt_end"


def temporalize(schema: T.StructType, kind: T.DataType | None = None) -> T.StructType:
    """A base schema's names and types with an interval added: as text, or as ``kind``. Ends of type ``kind`` may be null."""
    base = [T.StructField(f.name, f.dataType) for f in schema.fields]
    return T.StructType([*base, T.StructField(START, kind or T.StringType(), False), T.StructField(END, kind or T.StringType(), kind is not None)])


def clean_stage(staged: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row for each key, the latest by ``ts``; rows with a null in any key are left out, for they match nothing."""
    whole = staged.where(F.lit(True) if not keys else ~F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x))
    return latest(whole, keys, [ts, *[c for c in staged.columns if c not in keys and c != ts]])


def ttst_sync(
    current: DataFrame,
    staged: DataFrame,
    keys: list[str],
    ts: str,
    now: Column,
    on_missing: str = "keep",
    closed: DataFrame | None = None,
    compare: list[str] | None = None,
) -> DataFrame:
    """The table after a payload, with ``change``: kept, closed or inserted.

    ``current`` holds the open rows (keys, values, tt_start), ``staged`` the payload (keys, values, ``ts``;
    a null ``ts`` counts as ``now``). A key whose values differ (null-safe) is closed at ``ts`` and inserted
    anew; a change of ``ts`` alone is no version. A payload is partial unless ``on_missing`` is ``close``: only
    then are open keys that it lacks closed, at ``now``. ``compare`` narrows the values that make a version.
    Where ``closed`` names old rows, a new row whose (keys, tt_start) is taken starts at ``now`` instead.

    One full outer join on the keys yields everything; nothing is updated in place.
    """
    if on_missing not in ("keep", "close"):
        raise ValueError("on_missing is keep or close")
    values = [c for c in staged.columns if c not in keys and c != ts]
    judged = values if compare is None else compare
    stage = clean_stage(staged.withColumn(ts, F.coalesce(F.col(ts), now)), keys, ts)
    new = stage.select(*keys, F.struct(*[F.col(v).alias(v) for v in values], F.col(ts).alias(START)).alias("__new"))
    old = current.select(*keys, F.struct(*[F.col(v).alias(v) for v in values], F.col(START).alias(START)).alias("__old"))
    both = old.join(new, keys, "full")
    gone = F.col("__new").isNull()
    fresh = F.col("__old").isNull()
    changed = ~gone & ~fresh & any_different([(F.col(f"__old.{v}"), F.col(f"__new.{v}")) for v in judged])
    out_type = both.schema["__old"].dataType[START].dataType

    def row(side: str, end: Column, change: Column) -> Column:
        return F.struct(*[F.col(f"{side}.{v}").alias(v) for v in values], F.col(f"{side}.{START}").cast(out_type).alias(START), end.cast(out_type).alias(END), change.alias("change"))

    no_end = F.lit(None)
    missing_closes = gone & F.lit(on_missing == "close")
    old_row = row("__old", F.when(changed, F.col(f"__new.{START}")).when(missing_closes, now).otherwise(no_end), F.when(changed | missing_closes, F.lit("closed")).otherwise(F.lit("kept")))
    new_row = row("__new", no_end, F.lit("inserted"))
    rows = both.select(*keys, F.explode(F.array_compact(F.array(F.when(~fresh, old_row), F.when(fresh | changed, new_row)))).alias("__row")).select(*keys, "__row.*")
    if closed is None:
        return rows
    taken = closed.select(*keys, F.col(START).alias("__taken")).distinct().withColumn("__hit", F.lit(True))
    hit = rows.join(taken, [*[rows[k] == taken[k] for k in keys], rows[START] == taken["__taken"], rows["change"] == "inserted"], "left").drop(*[taken[k] for k in keys], "__taken")
    return hit.withColumn(START, F.when(F.col("__hit"), now.cast(out_type)).otherwise(F.col(START))).drop("__hit")


def sync_counts(result: DataFrame, staged: DataFrame) -> DataFrame:
    """One row: rows staged, closed and inserted."""
    return result.agg(F.count_if(F.col("change") == "closed").alias("closed"), F.count_if(F.col("change") == "inserted").alias("inserted")).crossJoin(staged.agg(F.count(F.lit(1)).alias("staged")))


def after_sync(result: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """The whole table again: old closed rows and the result's."""
    rows = result.drop("change")
    return rows if closed is None else closed.select(rows.columns).unionByName(rows)


def prune_noop(delta: DataFrame, existing: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of a delta that are new or differ in a value from the existing row; a newer timestamp alone is no change."""
    held = existing.select(F.col(key).alias("__id"), F.lit(True).alias("__held"), *[F.col(v).alias(f"__{v}") for v in values])
    both = delta.join(held, delta[key] == held["__id"], "left")
    return both.where(F.col("__held").isNull() | any_different([(F.col(v), F.col(f"__{v}")) for v in values])).select(delta.columns)


def promote(delta: DataFrame, existing: DataFrame | None, key: str, values: list[str]) -> DataFrame:
    """The delta to write: pruned against what there is, or whole if there is nothing yet."""
    return delta if existing is None else prune_noop(delta, existing, key, values)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], empty_is_null: bool = False) -> DataFrame:
    """The table after an upsert that leaves equal rows alone, with ``action``: insert, update or keep.

    ``empty_is_null`` treats a null and an empty text as equal.
    """
    old = current.select(*keys, F.struct(*[F.col(v).alias(v) for v in values]).alias("__old"))
    new = incoming.select(*keys, F.struct(*[F.col(v).alias(v) for v in values]).alias("__new"))
    both = old.join(new, keys, "full")
    side = lambda s, v: F.coalesce(F.col(f"{s}.{v}").cast("string"), F.lit("")) if empty_is_null else F.col(f"{s}.{v}")
    differs = any_different([(side("__old", v), side("__new", v)) for v in values])
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNotNull() & differs, "update").otherwise("keep")
    both = both.withColumn("action", action)
    return both.select(*keys, *[F.when(F.col("action") == "keep", F.col(f"__old.{v}")).otherwise(F.col(f"__new.{v}")).alias(v) for v in values], "action")


def hwm(table: DataFrame, start: str = START, end: str = END, zero: object = 0) -> DataFrame:
    """One row ``hwm``: the greatest version that any interval begins or ends at; ``zero`` for an empty table."""
    return table.agg(F.coalesce(F.greatest(F.max(start), F.max(end)), F.lit(zero)).alias("hwm"))


def extract_intervals(rows: DataFrame, snapshots: DataFrame, since: int, begin: str = "begin_snapshot", end: str = "end_snapshot") -> DataFrame:
    """Rows whose interval begins or ends after ``since``, with the times of both snapshots (an open end has none)."""
    crossed = rows.where((F.col(begin) > since) | (F.col(end) > since))
    first = snapshots.select(F.col("snapshot_id").alias(begin), F.col("snapshot_time").alias("tt_start_ts"))
    last = snapshots.select(F.col("snapshot_id").alias(end), F.col("snapshot_time").alias("tt_end_ts"))
    return crossed.join(first, begin).join(last, end, "left").withColumnsRenamed({begin: START, end: END})


def project(intervals: DataFrame, since: int) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows to close) in a target that is current up to ``since``; the same call again changes nothing."""
    return intervals.where(F.col(START) > since), intervals.where((F.col(START) <= since) & (F.col(END) > since))


def apply_projection(target: DataFrame, inserted: DataFrame, closing: DataFrame, keys: list[str]) -> DataFrame:
    """The target after :func:`project`: open rows of the same key and beginning get their end; inserted rows are added."""
    ends = closing.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(START).alias("__start"), F.col(END).alias("__end"), F.col("tt_end_ts").alias("__end_ts"))
    same = (target[START] == ends["__start"]) & target[END].isNull()
    for k in keys:
        same = same & target[k].eqNullSafe(ends[f"__{k}"])
    shut = target.join(ends, same, "left")
    shut = shut.withColumn(END, F.coalesce(END, "__end")).withColumn("tt_end_ts", F.coalesce("tt_end_ts", "__end_ts")).select(target.columns)
    here = target.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(START).alias("__start"))
    known = inserted[START] == here["__start"]
    for k in keys:
        known = known & inserted[k].eqNullSafe(here[f"__{k}"])
    return shut.unionByName(inserted.select(target.columns).join(here, known, "left_anti"))


def sync_outward(source: DataFrame, snapshots: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Bring a target's intervals up to the source's: from the target's high-water mark on, then close and insert."""
    since = hwm(target).first()["hwm"]
    inserted, closing = project(extract_intervals(source, snapshots, since), since)
    return apply_projection(target, inserted, closing, keys)


def intern_catalog(
    resources: DataFrame,
    open_resources: DataFrame,
    open_columns: DataFrame,
    scrape_ts: Column,
    attributes: list[str],
    incremental: bool,
    closed_resources: DataFrame | None = None,
    closed_columns: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both tables (resources, and columns unnested from them) after a scrape of one domain's catalog.

    ``resources`` has resource_id, updated_at, the ``attributes`` and four parallel arrays of columns. What a
    full scrape lacks is closed; an incremental one closes no resource, but its resources are whole, so their
    columns that went are closed.
    """
    one = latest(resources, ["resource_id"], ["updated_at", *attributes])
    ways = "keep" if incremental else "close"
    staged = one.select("resource_id", *attributes, F.col("updated_at").alias("ts"))
    resource_state = ttst_sync(open_resources, staged, ["resource_id"], "ts", scrape_ts, ways, closed_resources)
    fields = F.arrays_zip("columns_field_name", "columns_datatype", "columns_name", "columns_description")
    columns = one.select("resource_id", F.col("updated_at").alias("ts"), F.posexplode(fields).alias("at", "c")).select(
        "resource_id", F.col("c.columns_field_name").alias("field_name"), (F.col("at") + 1).alias("ordinal"), F.col("c.columns_datatype").alias("datatype"), F.col("c.columns_name").alias("display_name"), F.col("c.columns_description").alias("description"), "ts"
    )
    if incremental:
        seen = one.select("resource_id")
        here, rest = open_columns.join(seen, "resource_id", "left_semi"), open_columns.join(seen, "resource_id", "left_anti")
        changed = ttst_sync(here, columns, ["resource_id", "field_name"], "ts", scrape_ts, "close", closed_columns)
        untouched = rest.withColumn(END, F.lit(None).cast(rest.schema[START].dataType)).withColumn("change", F.lit("kept"))
        return resource_state, changed.unionByName(untouched.select(changed.columns))
    return resource_state, ttst_sync(open_columns, columns, ["resource_id", "field_name"], "ts", scrape_ts, "close", closed_columns)


__all__ = ["after_sync", "apply_projection", "as_of_version", "extract_intervals", "hwm", "intern_catalog", "project", "promote", "prune_noop", "sync_counts", "sync_outward", "temporalize", "ttst_sync", "upsert"]
