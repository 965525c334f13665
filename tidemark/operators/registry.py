"""The schema registry: captures of schemas as rows, what they were at an instant, and what became of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.intervals import different, latest
from tidemark.operators.scans import previous

#: The 28 columns of a column in a role.
ROLE_COLUMNS = (
    "db schema_name object_name object_id container_kind grouping_kind grouping_id grouping_name member_name member_id ordinal data_type max_length precision "
    "scale is_nullable default_expr is_identity is_computed is_descending is_included is_unique referenced_object referenced_member on_delete param_direction "
    "cdc_enabled ct_enabled"
).split()
#: What a registry keeps of them, after dataserver, database and sample_time.
REGISTRY_COLUMNS = "schema_name object_name object_id grouping_kind member_name ordinal data_type referenced_object referenced_member".split()
PARTITIONS = ["dataserver", "database"]


def spark_columns(spark: SparkSession, database: str | None = None, tables: list[str] | None = None) -> DataFrame:
    """Columns of the session catalog's tables as rows in the role ``table`` or ``view``: the engine's own dialect.

    One call for each table to the catalog, on the driver: metadata of the control plane, not data.
    """
    rows = []
    for table in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        if tables is not None and table.name not in tables:
            continue
        name = table.name if table.isTemporary else ".".join([*(table.namespace or []), table.name])
        for ordinal, column in enumerate(spark.catalog.listColumns(name), 1):
            rows.append(
                {"db": table.catalog, "schema_name": ".".join(table.namespace or []) or None, "object_name": table.name, "container_kind": "view" if "VIEW" in (table.tableType or "") else "table", "grouping_kind": "view" if "VIEW" in (table.tableType or "") else "table", "grouping_name": table.name, "member_name": column.name, "member_id": ordinal, "ordinal": ordinal, "data_type": column.dataType, "is_nullable": column.nullable}
            )
    return spark.createDataFrame([[r.get(c) for c in ROLE_COLUMNS] for r in rows], role_schema())


def role_schema() -> T.StructType:
    ints = {"object_id", "grouping_id", "member_id", "ordinal", "max_length", "precision", "scale"}
    flags = {c for c in ROLE_COLUMNS if c.startswith("is_") or c.endswith("_enabled")}
    return T.StructType([T.StructField(c, T.LongType() if c in ints else T.BooleanType() if c in flags else T.StringType()) for c in ROLE_COLUMNS])


def union_roles(*roles: DataFrame) -> DataFrame:
    """Rows of several roles as one relation of 28 columns; what a role lacks is null."""
    schema, out = role_schema(), None
    for role in roles:
        whole = role.select(*[(F.col(f.name) if f.name in role.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        out = whole if out is None else out.unionByName(whole)
    if out is None:
        raise ValueError("no roles")
    return out


def capture(roles: DataFrame, server: str, database: str, sample_time: Column, only: list[str] | None = None) -> DataFrame:
    """The registry's columns of a projection, stamped with where and when; ``only`` keeps the named objects (none if empty)."""
    found = roles if only is None else roles.where(F.col("object_name").isin(only) if only else F.lit(False))
    return found.select(F.lit(server).alias("dataserver"), F.lit(database).alias("database"), sample_time.alias("sample_time"), *REGISTRY_COLUMNS)


def write_capture(captured: DataFrame, path: str) -> None:
    """Append a capture; partitions keep reads of one database to its files."""
    captured.write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def schema_as_of(captures: DataFrame, when: Column, where: Column | None = None, at: str = "sample_time") -> DataFrame:
    """Rows of the latest capture not after ``when``. The scalar aggregate prunes what it is partitioned by."""
    scoped = captures if where is None else captures.where(where)
    moment = scoped.where(F.col(at) <= when).agg(F.max(at).alias("__moment"))
    return scoped.join(F.broadcast(moment), F.col(at) == F.col("__moment")).drop("__moment")


def schema_anomalies(probes: DataFrame, keys: list[str], at: str = "sample_time", identity: str = "object_id", modified: str = "modify_date", tie: list[str] | None = None) -> DataFrame:
    """``status`` of each probe against the object's one before: initial, recreated or altered; unchanged ones go.

    An unknown identity or date (null, on either side) is no change.
    """
    order = Window.partitionBy(*keys).orderBy(at, *(tie or []))
    first = F.row_number().over(order) == 1
    was, changed = F.lag(identity).over(order), F.lag(modified).over(order)
    status = F.when(first, "initial").when(F.coalesce(F.col(identity) != was, F.lit(False)), "recreated").when(F.coalesce(F.col(modified) != changed, F.lit(False)), "altered").otherwise("unchanged")
    return probes.withColumn("status", status).where("status <> 'unchanged'")


def dropped_objects(probes: DataFrame, keys: list[str], at: str = "sample_time") -> DataFrame:
    """Objects that the latest probe lacks, with when they were last seen."""
    newest = probes.agg(F.max(at).alias("__newest"))
    return probes.groupBy(*keys).agg(F.max(at).alias("last_seen")).crossJoin(F.broadcast(newest)).where("last_seen < __newest").drop("__newest")


def measure_env(probes: DataFrame, local: str = "local_utc", remote: str = "remote_utc") -> DataFrame:
    """``skew_seconds``: remote clock minus local clock."""
    return probes.withColumn("skew_seconds", (F.unix_micros(F.col(remote).cast("timestamp")) - F.unix_micros(F.col(local).cast("timestamp"))) / 1e6)


def clock_events(probes: DataFrame, order: str = "seq", skew: str = "skew_seconds", created: str = "db_create_id", threshold: float = 120.0, keys: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """``recreated`` and ``stepped`` of each probe against the one before: a new database identity, a skew that moved by more than ``threshold``.

    With ``keys`` each series is scanned by itself; one series over all rows is scanned in stretches.
    """
    if keys:
        over = Window.partitionBy(*keys).orderBy(order, *(tie or []))
        seen = probes.withColumn("__was_created", F.lag(created).over(over)).withColumn("__was_skew", F.lag(skew).over(over))
    else:
        seen = previous(probes, order, [created, skew], "__was_", tie).withColumnsRenamed({f"__was_{created}": "__was_created", f"__was_{skew}": "__was_skew"})
    recreated = F.coalesce(F.col(created) != F.col("__was_created"), F.lit(False))
    stepped = F.coalesce(F.abs(F.col(skew) - F.col("__was_skew")) > threshold, F.lit(False))
    return seen.withColumn("recreated", recreated).withColumn("stepped", stepped).drop("__was_created", "__was_skew")


def dirty_objects(probes: DataFrame, captures: DataFrame, keys: list[str], identity: str = "object_id") -> DataFrame:
    """Keys whose identity in ``probes`` is not that of ``captures``, or that it lacks: what must be captured again."""
    held = captures.select(*keys, F.col(identity).alias("__held")).distinct()
    both = probes.select(*keys, identity).distinct().join(held, keys, "left")
    return both.where(different(F.col(identity), F.col("__held"))).select(*keys).distinct()


def latest_rows(captures: DataFrame, keys: list[str], at: str = "sample_time", tie: list[str] | None = None) -> DataFrame:
    return latest(captures, keys, [at, *(tie or [])])


def pruned_capture(probes: DataFrame, captures: DataFrame, read: object, keys: list[str] | None = None) -> DataFrame:
    """Probe, find what is dirty, and call ``read(names)`` for those objects only."""
    keys = keys or ["object_name"]
    names = sorted(r[keys[-1]] for r in dirty_objects(probes, captures, keys).collect())  # names of a control plane
    return read(names)


def fingerprint(columns: list[tuple[str, str]]) -> str:
    """The first 16 hex digits of the SHA-256 of ordered names and types."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([list(c) for c in columns], separators=(",", ":")).encode()).hexdigest()[:16]


def fingerprints(captures: DataFrame, keys: list[str], name: str = "member_name", kind: str = "data_type", order: str = "ordinal") -> DataFrame:
    """``fingerprint`` of each object's ordered names and types."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.col(kind).alias("t"))))
    text = F.to_json(F.transform(ordered, lambda x: F.array(x["n"], x["t"])))
    return captures.groupBy(*keys).agg(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def catalog_listing(tables: DataFrame, columns: DataFrame, keys: list[str], group: list[str], table: str, column: str) -> DataFrame:
    """Tables and columns of each catalog, with those that have none."""
    return tables.join(columns, keys, "left").groupBy(*group).agg(F.count_distinct(F.col(table)).alias("tables"), F.count(F.col(column)).alias("columns"))


def table_types(columns: DataFrame, resolve: object, table: str = "table_name", name: str = "column_name", kind: str = "data_type", order: str = "ordinal_position") -> dict[str, T.StructType]:
    """``{table: StructType}`` of captured columns (a null ordinal counts as 0); ``resolve(type)`` gives the Spark type."""
    out: dict[str, list] = {}
    rows = columns.select(table, name, kind, F.coalesce(order, F.lit(0)).alias("o")).collect()  # a registry's metadata
    for row in sorted(rows, key=lambda r: (r[table], r["o"], r[name])):
        out.setdefault(row[table], []).append(T.StructField(row[name], resolve(row[kind])))
    return {t: T.StructType(fields) for t, fields in out.items()}


def foreign_keys(constraints: DataFrame) -> DataFrame:
    """Rows of the role ``fk``: each referencing column with the column that it stands for, composite keys place by place.

    ``constraints`` has a row for each column of each constraint: schema_name, constraint_name, constraint_type (PRIMARY KEY,
    UNIQUE or FOREIGN KEY), table_name, column_name, ordinal, and for foreign keys unique_constraint_name,
    position_in_unique_constraint and delete_rule.
    """
    keys = constraints.where(F.col("constraint_type") != "FOREIGN KEY").select(
        "schema_name", F.col("constraint_name").alias("unique_constraint_name"), F.col("ordinal").alias("position_in_unique_constraint"), F.col("table_name").alias("referenced_object"), F.col("column_name").alias("referenced_member")
    )
    found = constraints.where("constraint_type = 'FOREIGN KEY'").drop("referenced_object", "referenced_member").join(keys, ["schema_name", "unique_constraint_name", "position_in_unique_constraint"])
    return union_roles(
        found.select(
            "schema_name", F.col("table_name").alias("object_name"), F.lit("table").alias("container_kind"), F.lit("fk").alias("grouping_kind"), F.col("constraint_name").alias("grouping_name"),
            F.col("column_name").alias("member_name"), "ordinal", "referenced_object", "referenced_member", F.col("delete_rule").alias("on_delete"),
        )
    )
