"""A versioned lake: immutable data files, deletions beside them, a log of commits, and schemas bound by column id.

A commit is one small file that is put only where its number is free (``commitlog``), so it counts whole or not at all,
and one commit may write several tables. Writers that only append take the next number when another was faster; a
change of definitions, a deletion or a replacement fails with ``CommitConflict`` where something newer is in its way, and
changes nothing.

Metadata are rows of catalog tables, appended and never updated: an entity that ends gets a second row, and the latest
counts. Data are Parquet files with column ids, so a renamed column keeps its data and a new one reads as null in old
files. A write of few rows makes no file: its rows stand in the commit (*inlined*) until ``flush`` writes them. Deleted
rows are named by file and place in a file of their own and left out on reading (*merge on read*). Each file's least and
greatest values are kept, and ``read(where=...)`` opens only files that can hold matching rows.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import operator
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import types as registry_types
from tidemark.operators.intervals import as_of_version, change_feed, latest, version_at
from tidemark.session import materialize
from tidemark.sources.commitlog import Commit, CommitLog

# The tables of the catalog and their columns (i: long, s: text, b: boolean, t: timestamp).
CATALOG: dict[str, str] = {
    "metadata": "key:s value:s scope:s scope_id:i",
    "snapshot": "snapshot_id:i snapshot_time:t schema_version:i next_catalog_id:i next_file_id:i",
    "snapshot_changes": "snapshot_id:i changes_made:s author:s commit_message:s commit_extra_info:s",
    "schema_versions": "begin_snapshot:i schema_version:i table_id:i",
    "schema": "schema_id:i schema_uuid:s begin_snapshot:i end_snapshot:i schema_name:s path:s path_is_relative:b",
    "table": "table_id:i table_uuid:s begin_snapshot:i end_snapshot:i schema_id:i table_name:s path:s path_is_relative:b",
    "view": "view_id:i view_uuid:s begin_snapshot:i end_snapshot:i schema_id:i view_name:s dialect:s sql:s column_aliases:s",
    "column": "column_id:i begin_snapshot:i end_snapshot:i table_id:i column_order:i column_name:s column_type:s initial_default:s default_value:s nulls_allowed:b parent_column:i",
    "tag": "object_id:i begin_snapshot:i end_snapshot:i key:s value:s",
    "column_tag": "table_id:i column_id:i begin_snapshot:i end_snapshot:i key:s value:s",
    "data_file": "data_file_id:i table_id:i begin_snapshot:i end_snapshot:i file_order:i path:s path_is_relative:b file_format:s record_count:i file_size_bytes:i footer_size:i row_id_start:i partition_id:i encryption_key:s mapping_id:i partial_max:i",
    "delete_file": "delete_file_id:i table_id:i begin_snapshot:i end_snapshot:i data_file_id:i path:s path_is_relative:b format:s delete_count:i file_size_bytes:i footer_size:i encryption_key:s",
    "file_column_stats": "data_file_id:i table_id:i column_id:i column_size_bytes:i value_count:i null_count:i min_value:s max_value:s contains_nan:b extra_stats:s",
    "file_variant_stats": "data_file_id:i table_id:i column_id:i variant_path:s shredded_type:s column_size_bytes:i value_count:i null_count:i min_value:s max_value:s contains_nan:b extra_stats:s",
    "table_stats": "table_id:i record_count:i next_row_id:i file_size_bytes:i",
    "table_column_stats": "table_id:i column_id:i contains_null:b contains_nan:b min_value:s max_value:s extra_stats:s",
    "partition_info": "partition_id:i table_id:i begin_snapshot:i end_snapshot:i",
    "partition_column": "partition_id:i table_id:i partition_key_index:i column_id:i transform:s",
    "file_partition_value": "data_file_id:i table_id:i partition_key_index:i partition_value:s",
    "column_mapping": "mapping_id:i table_id:i type:s",
    "name_mapping": "mapping_id:i column_id:i source_name:s target_field_id:i parent_column:i is_partition:b",
    "files_scheduled_for_deletion": "data_file_id:i path:s path_is_relative:b schedule_start:t",
    "inlined_data_tables": "table_id:i table_name:s schema_version:i",
    "macro": "schema_id:i macro_id:i macro_name:s begin_snapshot:i end_snapshot:i",
    "macro_impl": "macro_id:i impl_id:i dialect:s sql:s type:s",
    "macro_parameters": "macro_id:i impl_id:i column_id:i parameter_name:s parameter_type:s default_value:s default_value_type:s",
    "sort_info": "sort_id:i table_id:i begin_snapshot:i end_snapshot:i",
    "sort_expression": "sort_id:i table_id:i sort_key_index:i expression:s dialect:s sort_direction:s null_order:s",
}
_KINDS = {"i": T.LongType(), "s": T.StringType(), "b": T.BooleanType(), "t": T.TimestampNTZType()}
VERSION, ENDED = "begin_snapshot", "end_snapshot"


def catalog_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split(":") for c in CATALOG[table].split())])


def with_field_ids(schema: T.StructType, ids: dict[str, int]) -> T.StructType:
    """A schema whose columns are bound to Parquet columns by id."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, "parquet.field.id": ids[f.name]}) for f in schema.fields])


def lake_type(name: str) -> T.DataType:
    """The Spark type of a lake type name; names Spark itself knows are taken as they are."""
    if name in registry_types.LAKE_TYPES:
        return registry_types.LAKE_TYPES[name]
    return T.DataType.fromDDL(name)


#: Catalog tables whose rows are few, a row for each table or column: the driver reads them without a job.
SMALL = ("metadata", "schema", "table", "column", "view", "partition_info", "partition_column", "schema_versions", "inlined_data_tables")
#: Rows of a write that are kept in the commit, rows of a table that may be kept so, and catalog rows that a commit holds itself.
INLINE_ROWS, FLUSH_ROWS, COMMIT_ROWS = 64, 10_000, 1000
#: Commits after which a checkpoint stands for them.
CHECKPOINT = 256
TESTS = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
#: Physical types of Parquet whose ends are in the order of the values.
ORDERED = ("BOOLEAN", "INT32", "INT64", "FLOAT", "DOUBLE", "BYTE_ARRAY")
INLINED = "table_id bigint, row_id string, begin_snapshot bigint, end_snapshot bigint, held map<string,string>"


class CommitConflict(RuntimeError):
    """Another writer has committed since this one last read."""


@dataclass
class WriterState:
    snapshot_id: int
    next_catalog_id: int
    next_file_id: int
    schema_version: int


def as_text(value: object) -> str | None:
    """A value of the driver as text that Spark casts back."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, bytes | bytearray):
        return base64.b64encode(value).decode()
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, list | dict | tuple):
        return json.dumps(value, default=str)
    return repr(value) if isinstance(value, float) else str(value)


def to_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.base64(column)
    return F.to_json(column) if isinstance(kind, T.ArrayType | T.StructType | T.MapType) else column.cast("string")


def from_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unbase64(column)
    return F.from_json(column, kind) if isinstance(kind, T.ArrayType | T.StructType | T.MapType) else column.cast(kind)


def column_statistics(files: DataFrame, ids: dict[str, int]) -> DataFrame:
    """path, column_id, value_count, null_count, min_value, max_value, column_size_bytes: from footers, read by the tasks.

    A file in a store that only Spark reads has no statistics, so it is opened by every read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    fs, place = pafs.FileSystem.from_uri(path)
                    with fs.open_input_file(place) as source:
                        footer = pq.read_metadata(source)
                except (OSError, ValueError, NotImplementedError):
                    continue
                held: dict[str, list] = {}
                for group in range(footer.num_row_groups):
                    for i in range(footer.num_columns):
                        chunk = footer.row_group(group).column(i)
                        if chunk.path_in_schema in ids:  # nested columns have longer paths
                            held.setdefault(chunk.path_in_schema, []).append((chunk.num_values, chunk.total_compressed_size, chunk.statistics if chunk.is_stats_set and chunk.physical_type in ORDERED else None))
                rows = []
                for name, chunks in held.items():
                    stats = [s for _, _, s in chunks]
                    known = [s for s in stats if s is not None and s.has_min_max]
                    # Chunks of nulls alone have no ends; any other chunk without them leaves the column's ends unknown.
                    ends = known if all(s is not None and (s.has_min_max or s.null_count == n) for n, _, s in chunks) else []
                    nulls = sum(s.null_count for s in stats) if all(s is not None and s.has_null_count for s in stats) else None
                    low, high = (min(s.min for s in ends), max(s.max for s in ends)) if ends else (None, None)
                    if isinstance(low, bytes):  # binary columns are not compared
                        low = high = None
                    rows.append((path, ids[name], sum(n for n, _, _ in chunks), nulls, as_text(low), as_text(high), sum(z for _, z, _ in chunks)))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "column_id", "value_count", "null_count", "min_value", "max_value", "column_size_bytes"])

    return files.select("path").repartition(max(1, min(files.count(), 256))).mapInArrow(read, "path string, column_id bigint, value_count bigint, null_count bigint, min_value string, max_value string, column_size_bytes bigint")


class Lake:
    """A lake at ``path``: commits and large catalog tables under ``_catalog``, data under a folder for each table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/_catalog/commits")
        self.known: int | None = None

    # Catalog tables

    def catalog(self, name: str) -> DataFrame:
        """All rows of a catalog table, ended entities included."""
        schema = catalog_schema(name)
        self.log.refresh()
        rows = self.local_frame(self.log.rows(name), schema)
        for part in self.log.parts(name):
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(part))
        if name in ("snapshot", "snapshot_changes"):
            return rows.where(F.col("snapshot_id") >= self.oldest())
        if ENDED not in schema.names:
            return rows
        # A second row of an entity carries its end.
        keys = [c for c in schema.names if c != ENDED]
        return rows.groupBy(*keys).agg(F.max(ENDED).alias(ENDED)).select(*schema.names)

    def local_frame(self, rows: list[dict], schema: T.StructType) -> DataFrame:
        """Rows of the control plane as a frame, in one partition."""
        times = {f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
        read = lambda c, v: dt.datetime.fromisoformat(v) if c in times and isinstance(v, str) else v
        return self.spark.createDataFrame([tuple(read(c, r.get(c)) for c in schema.names) for r in rows], schema).coalesce(1)

    def living(self, name: str, version: int | None = None) -> list[dict]:
        """Rows of a small catalog table as of a version, on the driver and without a job."""
        self.log.refresh()
        upto = self.log.last() if version is None else version
        found: dict[tuple, dict] = {}
        for row in self.log.rows(name):
            key = tuple((c, v) for c, v in sorted(row.items()) if c != ENDED and v is not None)
            if key not in found or row.get(ENDED) is not None:
                found[key] = row
        return [r for r in found.values() if (r.get(VERSION) or 0) <= upto and (r.get(ENDED) is None or r[ENDED] > upto)]

    def entries(self, name: str, table_id: int, version: int | None = None) -> list[dict]:
        """Files or deletions of one table: from the log without a job, or by Spark where some are in Parquet."""
        if self.log.refresh().parts(name):
            return [r.asDict() for r in self.current(name, version).where(F.col("table_id") == table_id).collect()]
        return [r for r in self.living(name, version) if r["table_id"] == table_id]

    def state(self) -> WriterState:
        """The last snapshot's numbers; an empty log gives (0, 1, 0, 0)."""
        rows = self.log.refresh().rows("snapshot")
        row = max(rows, key=lambda r: r["snapshot_id"]) if rows else {}
        return WriterState(*(row.get(c, d) for c, d in zip(("snapshot_id", "next_catalog_id", "next_file_id", "schema_version"), (0, 1, 0, 0), strict=True)))

    def oldest(self) -> int:
        """The first version that is kept."""
        return max((int(r["value"]) for r in self.log.rows("metadata") if r["key"] == "oldest_snapshot"), default=0)

    def init(self, schema_name: str = "main", when: dt.datetime | None = None) -> Lake:
        """An empty lake: snapshot 0 and one schema. A lake that is there already stays as it is."""
        if self.log.refresh().last() < 0:
            rows = {
                "metadata": [{"key": "version", "value": "1"}, {"key": "created_by", "value": "tidemark"}],
                "schema": [{"schema_id": 0, "schema_uuid": str(uuid.uuid4()), VERSION: 0, "schema_name": schema_name, "path": f"{schema_name}/", "path_is_relative": True}],
                "snapshot_changes": [{"snapshot_id": 0, "changes_made": f'created_schema:"{schema_name}"'}],
                "snapshot": [{"snapshot_id": 0, "snapshot_time": when or now(), "schema_version": 0, "next_catalog_id": 1, "next_file_id": 0}],
            }
            self.log.put(Commit(0, "define", [], rows))
        self.known = self.state().snapshot_id
        return self

    def commit(self, kind: str, tables: list[int], changes: str, build: Callable[[WriterState, Commit], None], when: dt.datetime | None = None, provenance: dict | None = None, base: int | None = None) -> int:
        """Put the next snapshot. ``build`` adds its rows and advances the numbers of the state, and runs anew where another writer was first.

        ``append`` gives way to nothing but a changed definition of its tables; ``change`` (deletions and replacements)
        fails if its tables changed after ``base``; ``define`` fails if anything did.
        """
        base = (self.log.refresh().last() if kind != "define" or self.known is None else self.known) if base is None else base
        for _ in range(10_000):
            for other in self.log.refresh().after(base):
                shared = set(other.tables) & set(tables)
                if kind == "define" or (kind == "change" and shared) or (shared and other.kind == "define"):
                    raise CommitConflict(f"snapshot {other.number} is newer than {base}")
            state = self.state()
            state.snapshot_id = self.log.last() + 1
            made = Commit(state.snapshot_id, kind, tables)
            build(state, made)
            made.rows.setdefault("snapshot_changes", []).append({"snapshot_id": state.snapshot_id, "changes_made": changes, **(provenance or {})})
            made.rows.setdefault("snapshot", []).append({"snapshot_id": state.snapshot_id, "snapshot_time": when or now(), "schema_version": state.schema_version + (kind == "define"), "next_catalog_id": state.next_catalog_id, "next_file_id": state.next_file_id})
            if self.log.put(made):
                self.known = state.snapshot_id
                if len(self.log.commits) >= CHECKPOINT:
                    self.checkpoint()
                return state.snapshot_id
        raise CommitConflict("too many writers")

    def checkpoint(self) -> None:
        """One document for all commits so far: small tables in it, large ones as Parquet, inlined rows as they are."""
        upto, every = self.log.last(), self.log.all()
        made = Commit(upto, "append")
        for name in CATALOG:
            rows, parts = self.log.rows(name), self.log.parts(name)
            if name in SMALL or len(rows) <= COMMIT_ROWS:
                made.rows[name], made.parts[name] = rows, parts
            else:
                folder = f"{self.path}/_catalog/{name}/{uuid.uuid4().hex}"
                self.local_frame(rows, catalog_schema(name)).write.parquet(folder)
                made.rows[name], made.parts[name] = rows[-1:] if name == "snapshot" else [], [*parts, folder]
        if made.parts.get("snapshot"):  # the last row stays with the document, so that the state needs no job
            folder = made.parts["snapshot"].pop()
            kept = [r for r in self.log.rows("snapshot") if r["snapshot_id"] < made.rows["snapshot"][0]["snapshot_id"]]
            again = f"{self.path}/_catalog/snapshot/{uuid.uuid4().hex}"
            self.local_frame(kept, catalog_schema("snapshot")).write.parquet(again)
            made.parts["snapshot"].append(again)
            self.remove(folder)
        for commit in every:
            for table, rows in commit.inlined.items():
                # Rows keep the snapshot that they came with, which is a part of their names.
                made.inlined.setdefault(table, []).extend(rows)
            for table, names in commit.ended.items():
                made.ended.setdefault(table, []).extend(n if isinstance(n, list) else [n, commit.number] for n in names)
        self.log.checkpoint(made)

    # Listings

    def snapshots(self) -> DataFrame:
        return self.catalog("snapshot").join(self.catalog("snapshot_changes"), "snapshot_id", "left").orderBy("snapshot_id")

    def current(self, name: str, version: int | None = None) -> DataFrame:
        committed = self.log.refresh().last() if version is None else version
        return as_of_version(self.catalog(name), committed, VERSION, ENDED)

    def current_tables(self, version: int | None = None) -> DataFrame:
        schemas = self.current("schema", version).select("schema_id", "schema_name")
        return self.current("table", version).join(schemas, "schema_id").select("schema_name", "table_name", "table_id", VERSION).orderBy("schema_name", "table_name")

    def current_columns(self, version: int | None = None) -> DataFrame:
        tables = self.current_tables(version).select("schema_name", "table_name", "table_id")
        return self.current("column", version).join(tables, "table_id").select("schema_name", "table_name", "column_id", "column_order", "column_name", "column_type").orderBy("schema_name", "table_name", "column_order")

    def list_files(self, table: str, schema: str = "main", version: int | None = None) -> DataFrame:
        return self.current("data_file", version).where(F.col("table_id") == self.table_id(table, schema, version)).orderBy("data_file_id")

    def table_info(self, version: int | None = None) -> DataFrame:
        """Files, rows and bytes of each table; deleted rows are taken off, inlined ones are counted."""
        files = self.current("data_file", version).groupBy("table_id").agg(F.count(F.lit(1)).alias("files"), F.sum("record_count").alias("held"), F.sum("file_size_bytes").alias("bytes"))
        gone = self.current("delete_file", version).groupBy("table_id").agg(F.sum("delete_count").alias("gone"))
        inline = self.inlined_rows(version).groupBy("table_id").agg(F.count(F.lit(1)).alias("inlined"))
        found = self.current_tables(version).join(files, "table_id", "left").join(gone, "table_id", "left").join(inline, "table_id", "left").na.fill(0, ["files", "held", "bytes", "gone", "inlined"])
        return found.withColumn("rows", F.col("held") - F.col("gone") + F.col("inlined")).drop("held", "gone", "inlined")

    def table_id(self, table: str, schema: str = "main", version: int | None = None) -> int:
        owners = {r["schema_id"] for r in self.living("schema", version) if r["schema_name"] == schema}
        found = [r["table_id"] for r in self.living("table", version) if r["table_name"] == table and r["schema_id"] in owners]
        if not found:
            raise LookupError(f"no table {schema}.{table}" + ("" if version is None else f" at version {version}"))
        return found[0]

    def columns(self, table: str, schema: str = "main", version: int | None = None) -> list[dict]:
        wanted = self.table_id(table, schema, version)
        return sorted((r for r in self.living("column", version) if r["table_id"] == wanted), key=lambda r: r["column_order"])

    # Definitions

    def create_table(self, table: str, columns: list[tuple[str, str]], schema: str = "main", when: dt.datetime | None = None, provenance: dict | None = None) -> int:
        owner = next((r for r in self.living("schema") if r["schema_name"] == schema), None)
        if owner is None:
            raise LookupError(f"no schema {schema}")
        made: list[int] = []

        def build(state: WriterState, commit: Commit) -> None:
            table_id = state.next_catalog_id
            state.next_catalog_id += 1
            made.append(table_id)
            commit.tables = [table_id]
            commit.rows["table"] = [{"table_id": table_id, "table_uuid": str(uuid.uuid4()), VERSION: state.snapshot_id, "schema_id": owner["schema_id"], "table_name": table, "path": f"{table}/", "path_is_relative": True}]
            commit.rows["column"] = [self.column_row(i, table_id, state.snapshot_id, i, n, t) for i, (n, t) in enumerate(columns, 1)]
            commit.rows["schema_versions"] = [{VERSION: state.snapshot_id, "schema_version": state.schema_version + 1, "table_id": table_id}]

        self.commit("define", [], f'created_table:"{schema}"."{table}"', build, when, provenance)
        return made[-1]

    def column_row(self, column_id: int, table_id: int, version: int, order: int, name: str, kind: str) -> dict:
        return {"column_id": column_id, VERSION: version, "table_id": table_id, "column_order": order, "column_name": name, "column_type": kind, "nulls_allowed": True}

    def alter(self, table: str, schema: str, when: dt.datetime | None, build: Callable[[WriterState, Commit, int], None]) -> int:
        table_id = self.table_id(table, schema)
        return self.commit("define", [table_id], f'altered_table:"{schema}"."{table}"', lambda state, commit: build(state, commit, table_id), when)

    def reconcile_columns(self, table: str, desired: list[tuple[str, str]], schema: str = "main", when: dt.datetime | None = None) -> list[str]:
        """Add the columns that are missing, in one snapshot; nothing is dropped or renamed. Returns the names added."""
        have = self.columns(table, schema)
        names = {c["column_name"] for c in have}
        missing = [(n, t) for n, t in desired if n not in names]

        def build(state: WriterState, commit: Commit, table_id: int) -> None:
            ids = max((r["column_id"] for r in self.log.rows("column") if r["table_id"] == table_id), default=0)
            order = max([c["column_order"] for c in have], default=0)
            commit.rows["column"] = [self.column_row(ids + i, table_id, state.snapshot_id, order + i, n, t) for i, (n, t) in enumerate(missing, 1)]
            commit.rows["schema_versions"] = [{VERSION: state.snapshot_id, "schema_version": state.schema_version + 1, "table_id": table_id}]

        if missing:
            self.alter(table, schema, when, build)
        return [n for n, _ in missing]

    def rename_column(self, table: str, old: str, new: str, schema: str = "main", when: dt.datetime | None = None) -> None:
        """The same column id under another name: old files read under it too."""
        found = next((c for c in self.columns(table, schema) if c["column_name"] == old), None)
        if found is None:
            raise LookupError(f"no column {old}")
        self.alter(table, schema, when, lambda state, commit, _: commit.rows.update(column=[{**found, ENDED: state.snapshot_id}, {**found, VERSION: state.snapshot_id, "column_name": new, ENDED: None}]))

    def drop_table(self, table: str, schema: str = "main", when: dt.datetime | None = None) -> None:
        table_id = self.table_id(table, schema)

        def build(state: WriterState, commit: Commit) -> None:
            for name in ("table", "column"):
                commit.rows[name] = [{**r, ENDED: state.snapshot_id} for r in self.living(name) if r["table_id"] == table_id]
            self.end_files(commit, table_id, state.snapshot_id)

        self.commit("define", [table_id], f'dropped_table:"{schema}"."{table}"', build, when)

    def end_files(self, commit: Commit, table_id: int, version: int) -> None:
        """End all that a table holds: files, deletions and inlined rows."""
        for name in ("data_file", "delete_file"):
            ended = self.current(name).where(F.col("table_id") == table_id).withColumn(ENDED, F.lit(version).cast("bigint"))
            self.add_rows(commit, name, ended)
        commit.ended[str(table_id)] = [r["row_id"] for r in self.inlined_of(table_id)]

    def add_rows(self, commit: Commit, name: str, rows: DataFrame) -> None:
        """Catalog rows that Spark made: in the commit if they are few, else as Parquet beside it."""
        some = rows.limit(COMMIT_ROWS + 1).collect()
        if len(some) <= COMMIT_ROWS:
            commit.rows.setdefault(name, []).extend({k: v for k, v in r.asDict().items() if v is not None} for r in some)
            return
        folder = f"{self.path}/_catalog/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        commit.parts.setdefault(name, []).append(folder)

    def set_partitioning(self, table: str, columns: list[str], schema: str = "main", when: dt.datetime | None = None) -> None:
        """Write the table's further files in folders of these columns' values."""
        ids = {c["column_name"]: c["column_id"] for c in self.columns(table, schema)}

        def build(state: WriterState, commit: Commit, table_id: int) -> None:
            number = state.next_catalog_id
            state.next_catalog_id += 1
            commit.rows["partition_info"] = [{"partition_id": number, "table_id": table_id, VERSION: state.snapshot_id}]
            commit.rows["partition_column"] = [{"partition_id": number, "table_id": table_id, "partition_key_index": i, "column_id": ids[c], "transform": "identity"} for i, c in enumerate(columns)]

        self.alter(table, schema, when, build)

    def partitioning(self, table: str, schema: str = "main", version: int | None = None) -> list[str]:
        table_id = self.table_id(table, schema, version)
        spec = max((r["partition_id"] for r in self.living("partition_info", version) if r["table_id"] == table_id), default=None)
        names = {c["column_id"]: c["column_name"] for c in self.columns(table, schema, version)}
        rows = sorted((r for r in self.log.rows("partition_column") if r["partition_id"] == spec), key=lambda r: r["partition_key_index"])
        return [names[r["column_id"]] for r in rows]

    # Data

    def schema_of(self, table: str, schema: str = "main", version: int | None = None) -> T.StructType:
        found = self.columns(table, schema, version)
        plain = T.StructType([T.StructField(c["column_name"], lake_type(c["column_type"])) for c in found])
        return with_field_ids(plain, {c["column_name"]: c["column_id"] for c in found})

    def write(self, table: str, rows: DataFrame | list[dict], schema: str = "main", when: dt.datetime | None = None, provenance: dict | None = None, inline: int = 0) -> int:
        """Append rows as one snapshot; returns its id. Columns that the rows lack are null.

        Up to ``inline`` rows of a frame, and up to ``INLINE_ROWS`` dictionaries, are kept in the commit.
        """
        return self.write_all({table: rows}, schema, when, provenance, inline)

    def write_all(self, tables: dict[str, DataFrame | list[dict]], schema: str = "main", when: dt.datetime | None = None, provenance: dict | None = None, inline: int = 0) -> int:
        """Append to several tables as one snapshot: readers see all of it or nothing."""
        base = self.log.refresh().last()
        staged = [(self.table_id(name, schema), name, *self.stage(name, rows, schema, inline)) for name, rows in tables.items()]

        def build(state: WriterState, commit: Commit) -> None:
            for table_id, _, folder, texts in staged:
                if folder is not None:
                    self.add_files(state, commit, table_id, folder)
                elif texts:
                    commit.inlined[str(table_id)] = [[f"{state.snapshot_id}:{i}", state.snapshot_id, t] for i, t in enumerate(texts)]
                    if not any(r["table_id"] == table_id for r in self.log.rows("inlined_data_tables")):
                        commit.rows.setdefault("inlined_data_tables", []).append({"table_id": table_id, "table_name": f"inlined_{table_id}", "schema_version": state.schema_version})

        made = self.commit("append", [t for t, *_ in staged], ",".join(f'inserted_into_table:"{schema}"."{n}"' for n in tables), build, when, provenance, base)
        for table_id, name, folder, texts in staged:
            if texts and len(self.inlined_of(table_id)) > FLUSH_ROWS:
                self.flush(name, schema)
        return made

    def stage(self, table: str, rows: DataFrame | list[dict], schema: str, inline: int) -> tuple[DataFrame | None, list[dict]]:
        """(files with statistics, none) or (none, rows as texts by column id) of what is to be appended."""
        target = self.schema_of(table, schema)
        ids = {f.name: f.metadata["parquet.field.id"] for f in target.fields}
        if isinstance(rows, list):
            if len(rows) <= max(inline, INLINE_ROWS):
                return None, [{str(ids[c]): as_text(v) for c, v in r.items() if v is not None} for r in rows]
            rows = self.spark.createDataFrame([tuple(r.get(c) for c in target.names) for r in rows], T.StructType([T.StructField(f.name, f.dataType) for f in target.fields]))
        if inline:
            present = [f for f in target.fields if f.name in rows.columns]
            some = rows.select(*[to_text(F.col(f.name).cast(f.dataType), f.dataType).alias(f.name) for f in present]).limit(inline + 1).collect()
            if len(some) <= inline:
                return None, [{str(ids[c]): v for c, v in r.asDict().items() if v is not None} for r in some]
        return self.write_files(table, rows, schema), []

    def write_files(self, table: str, rows: DataFrame, schema: str, files: int | None = None) -> DataFrame:
        """Data files in a folder of their own, not yet part of the table; returns their list with statistics."""
        target = self.schema_of(table, schema)
        folder = f"{self.path}/{schema}/{table}/{uuid.uuid4().hex}"
        chosen = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name, metadata={"parquet.field.id": f.metadata["parquet.field.id"]}) for f in target.fields])
        keys = self.partitioning(table, schema)
        if files:  # dealt evenly, or by partition values and a salt, so that one value's rows can fill several files
            chosen = chosen.repartition(files, *keys, F.pmod(F.xxhash64(*target.names), F.lit(files))) if keys else chosen.repartition(files)
        writer = chosen.write.option("spark.sql.parquet.fieldId.write.enabled", "true")
        (writer.partitionBy(*keys) if keys else writer).parquet(folder)
        return self.measured(folder, {f.name: f.metadata["parquet.field.id"] for f in target.fields})

    def measured(self, folder: str, ids: dict[str, int]) -> DataFrame:
        """path, bytes, n and stats of the files of a folder."""
        counted = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
        counted = materialize(counted, "files")
        names = [c for c in ("column_id", "value_count", "null_count", "min_value", "max_value", "column_size_bytes")]
        stats = column_statistics(counted, ids).groupBy("path").agg(F.collect_list(F.struct(*names)).alias("stats"))
        return materialize(counted.join(stats, "path", "left"), "files")

    def add_files(self, state: WriterState, commit: Commit, table_id: int, files: DataFrame) -> None:
        order = F.row_number().over(Window.orderBy("path")) - 1  # a row for each file of this write
        numbered = files.withColumn("file_order", order.cast("bigint")).withColumn("data_file_id", F.col("file_order") + state.next_file_id)
        fixed = {"table_id": table_id, VERSION: state.snapshot_id, ENDED: None, "path_is_relative": False, "file_format": "parquet", "row_id_start": 0}
        rows = numbered.withColumnsRenamed({"n": "record_count", "bytes": "file_size_bytes"}).withColumns({k: F.lit(v) for k, v in fixed.items()})
        self.add_rows(commit, "data_file", shaped(rows, "data_file"))
        stats = numbered.select("data_file_id", F.explode("stats").alias("s")).select("data_file_id", "s.*").withColumn("table_id", F.lit(table_id))
        self.add_rows(commit, "file_column_stats", shaped(stats, "file_column_stats"))
        state.next_file_id += files.count()

    def register(self, table: str, folder: str, schema: str = "main", when: dt.datetime | None = None, provenance: dict | None = None) -> int:
        """Make the Parquet files of a folder part of a table; the log keeps rows, bytes and the columns' ends of each."""
        table_id = self.table_id(table, schema)
        files = self.measured(folder, {f.name: f.metadata["parquet.field.id"] for f in self.schema_of(table, schema).fields})
        return self.commit("append", [table_id], f'inserted_into_table:"{schema}"."{table}"', lambda state, commit: self.add_files(state, commit, table_id, files), when, provenance)

    # Inlined rows

    def inlined_of(self, table_id: int, version: int | None = None, since: int = -1) -> list[dict]:
        """Rows of a table kept in commits, as of a version."""
        upto = self.log.refresh().last() if version is None else version
        ends: dict[str, int] = {}
        for commit in self.log.all():
            for name in commit.ended.get(str(table_id), []):
                name, at = name if isinstance(name, list) else (name, commit.number)
                ends[name] = min(at, ends.get(name, at))
        found = [{"table_id": table_id, "row_id": name, VERSION: begin, ENDED: ends.get(name), "held": held} for c in self.log.all() for name, begin, held in c.inlined.get(str(table_id), [])]
        return [r for r in found if since < r[VERSION] <= upto and (since >= 0 or r[ENDED] is None or r[ENDED] > upto)]

    def inlined_rows(self, version: int | None = None) -> DataFrame:
        """Inlined rows of all tables as of a version: at most ``FLUSH_ROWS`` of each and what its last writes added."""
        tables = {t for c in self.log.refresh().all() for t in c.inlined}
        rows = [r for t in tables for r in self.inlined_of(int(t), version)]
        return self.spark.createDataFrame([tuple(r[c] for c in ("table_id", "row_id", VERSION, ENDED, "held")) for r in rows], INLINED)

    def flush(self, table: str, schema: str = "main", when: dt.datetime | None = None) -> int | None:
        """Write a table's inlined rows to files, in one commit; versions before it keep reading them where they were."""
        base, table_id = self.log.refresh().last(), self.table_id(table, schema)
        held = self.inlined_of(table_id)
        if not held:
            return None
        files = self.write_files(table, self.inlined_frame(held, self.schema_of(table, schema)), schema)

        def build(state: WriterState, commit: Commit) -> None:
            self.add_files(state, commit, table_id, files)
            commit.ended[str(table_id)] = [r["row_id"] for r in held]

        return self.commit("change", [table_id], f'flushed_inlined_data:"{schema}"."{table}"', build, when, None, base)

    def inlined_frame(self, held: list[dict], target: T.StructType, places: bool = False) -> DataFrame:
        rows = self.spark.createDataFrame([(r["row_id"], r["held"]) for r in held], "row_id string, held map<string,string>")
        columns = [from_text(F.col("held")[str(f.metadata["parquet.field.id"])], f.dataType).alias(f.name) for f in target.fields]
        return rows.select(*columns, *([F.lit(None).cast("string").alias("__file"), F.col("row_id").alias("__row")] if places else []))

    # Reading

    def read(self, table: str, schema: str = "main", version: int | None = None, when: dt.datetime | None = None, where: list[tuple[str, str, object]] | None = None) -> DataFrame:
        """A table as of now, a version or an instant, under the names that its columns had then.

        ``where`` lists (column, one of = < <= > >=, value): all must hold. Files whose ends rule that out are not opened.
        """
        if when is not None:
            version = version_at(self.catalog("snapshot"), when)
            if version is None:
                raise LookupError(f"no snapshot at {when}")
        if version is not None and version < self.oldest():
            raise LookupError(f"version {version} has expired")
        found = self.scan(table, schema, version, where or [])
        for column, sign, value in where or []:
            found = found.where(TESTS[sign](F.col(column), F.lit(value)))
        return found

    def scan(self, table: str, schema: str, version: int | None, where: list[tuple[str, str, object]], places: bool = False) -> DataFrame:
        """The rows of a table; with ``places`` also __file and __row (of inlined rows null and their name)."""
        target = self.schema_of(table, schema, version)
        table_id = self.table_id(table, schema, version)
        paths = {r["data_file_id"]: r["path"] for r in self.entries("data_file", table_id, version)}
        out: DataFrame | None = None
        for column, sign, value in where if paths else []:
            some = self.ruled_out(table_id, target[column], sign, value)
            out = some if out is None else out.unionByName(some)
        for row in out.distinct().collect() if out is not None else []:
            paths.pop(row["data_file_id"], None)
        gone = self.entries("delete_file", table_id, version) if paths else []
        touched = {r["data_file_id"] for r in gone} & set(paths)
        parts = []
        if len(paths) > len(touched):
            parts.append(self.open_files([p for i, p in paths.items() if i not in touched], table, schema, version, target, places))
        if touched:
            # Only files with deleted rows are matched against them.
            opened = self.open_files([paths[i] for i in touched], table, schema, version, target, True)
            deleted = self.spark.read.schema("file string, row bigint").parquet(*sorted({r["path"] for r in gone if r["data_file_id"] in touched}))
            kept = opened.join(deleted, (self.within(opened["__file"]) == self.within(deleted["file"])) & (opened["__row"] == deleted["row"]), "left_anti")
            parts.append(kept if places else kept.select(*target.names))
        held = self.inlined_of(table_id, version)
        if held or not parts:
            parts.append(self.inlined_frame(held, target, places))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found

    def ruled_out(self, table_id: int, column: T.StructField, sign: str, value: object) -> DataFrame:
        """data_file_id of files that hold no value that passes: by the ends of the column, or as it is null throughout."""
        if sign not in TESTS:
            raise ValueError(f"unknown sign {sign}")
        stats = self.catalog("file_column_stats").where((F.col("table_id") == table_id) & (F.col("column_id") == column.metadata["parquet.field.id"]))
        low, high, wanted = F.col("min_value").cast(column.dataType), F.col("max_value").cast(column.dataType), F.lit(value).cast(column.dataType)
        outside = {"=": (low > wanted) | (high < wanted), "<": low >= wanted, "<=": low > wanted, ">": high <= wanted, ">=": high < wanted}[sign]
        return stats.where(outside | (F.col("null_count") == F.col("value_count"))).select("data_file_id")

    def open_files(self, paths: list[str], table: str, schema: str, version: int | None, target: T.StructType, places: bool) -> DataFrame:
        for key in ("enabled", "ignoreMissing"):
            self.spark.conf.set(f"spark.sql.parquet.fieldId.read.{key}", "true")
        extra = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").cast("string").alias("__row")] if places else []
        if not self.partitioning(table, schema, version):
            return self.spark.read.schema(target).parquet(*paths).select(*target.names, *extra)
        # Partition values stand in the path below each write's own folder.
        base, frames = f"{self.path}/{schema}/{table}", {}
        for path in paths:
            frames.setdefault(path.split(f"{base.split(':', 1)[-1].lstrip('/')}/", 1)[1].split("/", 1)[0], []).append(path)
        found: DataFrame | None = None
        for folder, some in sorted(frames.items()):
            part = self.spark.read.schema(target).option("basePath", f"{base}/{folder}").parquet(*some).select(*target.names, *extra)
            found = part if found is None else found.unionByName(part)
        return found

    # Deleting and replacing

    def delete(self, table: str, condition: Column, schema: str = "main", when: dt.datetime | None = None, provenance: dict | None = None) -> int | None:
        """Delete rows as one snapshot, without rewriting a file; None where no row meets the condition."""
        base, table_id = self.log.refresh().last(), self.table_id(table, schema)
        found = materialize(self.scan(table, schema, None, [], places=True).where(condition).select("__file", "__row"), "deleted")
        inlined = [r["__row"] for r in found.where("__file is null").collect()]  # at most what is inlined
        in_files = found.where("__file is not null").select(F.col("__file").alias("file"), F.col("__row").cast("bigint").alias("row"))
        counted = in_files.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        listed = self.list_files(table, schema).select("data_file_id", self.within(F.col("path")).alias("place"))
        files = materialize(counted.withColumn("place", self.within(F.col("file"))).join(listed, "place").drop("place"), "deleted-files")
        if not inlined and files.isEmpty():
            return None
        folder = f"{self.path}/{schema}/{table}/deleted-{uuid.uuid4().hex}"
        in_files.sortWithinPartitions("file", "row").write.parquet(folder)

        def build(state: WriterState, commit: Commit) -> None:
            fixed = {"table_id": table_id, VERSION: state.snapshot_id, ENDED: None, "path": folder, "path_is_relative": False, "format": "parquet"}
            rows = files.withColumnRenamed("n", "delete_count").withColumn("delete_file_id", F.row_number().over(Window.orderBy("file")) - 1 + state.next_file_id).withColumns({k: F.lit(v) for k, v in fixed.items()})
            self.add_rows(commit, "delete_file", shaped(rows, "delete_file"))
            state.next_file_id += files.count()
            if inlined:
                commit.ended[str(table_id)] = inlined

        return self.commit("change", [table_id], f'deleted_from_table:"{schema}"."{table}"', build, when, provenance, base)

    def compact(self, table: str, schema: str = "main", when: dt.datetime | None = None, files: int | None = None, target_bytes: int = 256 << 20) -> int:
        """The same rows in files of about ``target_bytes``, in the table's partitions, as a new snapshot; older versions keep the old files."""
        held = self.list_files(table, schema).agg(F.sum("file_size_bytes")).first()[0] or 0
        return self.replace(table, self.read(table, schema), schema, when, files or max(1, -(-held // target_bytes)), f'compacted_table:"{schema}"."{table}"')

    def replace(self, table: str, rows: DataFrame, schema: str = "main", when: dt.datetime | None = None, files: int | None = None, changes: str | None = None) -> int:
        """``rows`` in place of all that the table holds, as one new snapshot; older versions keep the old files."""
        base, table_id = self.log.refresh().last(), self.table_id(table, schema)
        staged = self.write_files(table, rows, schema, files)

        def build(state: WriterState, commit: Commit) -> None:
            self.end_files(commit, table_id, state.snapshot_id)
            self.add_files(state, commit, table_id, staged)

        return self.commit("change", [table_id], changes or f'inserted_into_table:"{schema}"."{table}"', build, when, None, base)

    # Expiry

    def expire(self, oldest: int, when: dt.datetime | None = None) -> int:
        """Keep versions from ``oldest`` on. Files that no kept version reads are scheduled for deletion, in this snapshot."""

        def build(state: WriterState, commit: Commit) -> None:
            if not 0 <= oldest < state.snapshot_id:
                raise LookupError(f"no version {oldest}")
            commit.rows["metadata"] = [{"key": "oldest_snapshot", "value": str(oldest)}]
            known = self.catalog("files_scheduled_for_deletion").select("path")
            files = self.catalog("data_file").where(F.col(ENDED) <= oldest).select("data_file_id", "path")
            # The rows of one deletion are one folder; it goes once none of its files is read.
            gone = self.catalog("delete_file").groupBy("path").agg(F.max(F.coalesce(ENDED, F.lit(1 << 62))).alias("end"), F.min("delete_file_id").alias("data_file_id")).where(F.col("end") <= oldest)
            due = files.unionByName(gone.select("data_file_id", "path")).join(known, "path", "left_anti")
            due = due.withColumn("path_is_relative", F.lit(False)).withColumn("schedule_start", F.lit(when or now()))
            self.add_rows(commit, "files_scheduled_for_deletion", shaped(due, "files_scheduled_for_deletion"))

        return self.commit("define", [], f"expired_snapshots_before:{oldest}", build, when)

    def clean(self, before: dt.datetime) -> dict[str, int]:
        """Remove files scheduled before an instant, and orphans older than that: what writes left that never were committed.

        A second step after :meth:`expire`, so that readers that opened an expired version have until ``before`` to finish.
        """
        due = [r["path"] for r in self.catalog("files_scheduled_for_deletion").where(F.col("schedule_start") < F.lit(before)).select("path").collect()]
        scheduled = sum(self.remove(p) for p in due)
        named = self.catalog("data_file").select("path").unionByName(self.catalog("delete_file").select("path")).select(self.within(F.col("path")).alias("named"))
        # A deletion is named by its folder, any other file by itself.
        listed = self.listing(before)
        orphans = listed.join(named, self.within(listed["path"]) == named["named"], "left_anti")
        orphans = orphans.join(named, self.within(orphans["folder"]) == named["named"], "left_anti")
        return {"scheduled": scheduled, "orphans": sum(self.remove(r["path"]) for r in orphans.select("path").collect())}

    def listing(self, before: dt.datetime) -> DataFrame:
        """path and folder of every file under the tables' folders that is older than an instant."""
        jvm, found = self.spark._jvm, []
        limit = int(before.replace(tzinfo=dt.UTC).timestamp() * 1000)
        for schema in {r["schema_name"] for r in self.log.rows("schema")}:
            root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{schema}")
            fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            files = fs.listFiles(root, True) if fs.exists(root) else None
            while files is not None and files.hasNext():
                status = files.next()
                if status.getModificationTime() < limit:
                    path = status.getPath()
                    found.append((path.toUri().toString(), path.getParent().toUri().toString()))
        return self.spark.createDataFrame(found, "path string, folder string")

    def within(self, path: Column) -> Column:
        """A path as it goes on from the lake's own: readers and listings write a scheme in different ways."""
        return F.substring_index(path, f"{self.path.split(':', 1)[-1].lstrip('/')}/", -1)

    def remove(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def open(self, prefix: str = "", version: int | None = None) -> list[str]:
        """Every table as a temporary view; returns their names."""
        names = []
        for row in self.current_tables(version).collect():
            name = f"{prefix}{row['table_name']}"
            self.read(row["table_name"], row["schema_name"], version).createOrReplaceTempView(name)
            names.append(name)
        return names

    def changes(self, table: str, after: int, upto: int, schema: str = "main", keys: list[str] | None = None) -> DataFrame:
        """Rows that were added in ``(after, upto]``, or, for a table with intervals, rows that began or ended then.

        Rows that a compaction or a flush wrote again are no additions.
        """
        target = self.schema_of(table, schema, upto)
        if "tt_start" in target.names:
            return change_feed(self.read(table, schema), after, upto)
        table_id = self.table_id(table, schema, upto)
        again = self.catalog("snapshot_changes").where("changes_made like 'compacted_table:%' or changes_made like 'flushed_inlined_data:%'").select(F.col("snapshot_id").alias(VERSION))
        added = self.catalog("data_file").where((F.col("table_id") == table_id) & (F.col(VERSION) > after) & (F.col(VERSION) <= upto)).join(again, VERSION, "left_anti")
        paths = sorted({r["path"] for r in added.select("path").collect()})
        rows = self.inlined_frame(self.inlined_of(table_id, upto, since=max(after, 0)), target)
        if paths:
            rows = self.open_files(paths, table, schema, upto, target, False).unionByName(rows)
        return rows.withColumn("change_type", F.lit("insert"))


def shaped(rows: DataFrame, name: str) -> DataFrame:
    """The columns of a catalog table; those that ``rows`` lacks are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in catalog_schema(name).fields])


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


@dataclass
class HistoryTable:
    """A replica that keeps every version: after-images with version, label and operation, appended and never changed.

    Current rows and states as of a version or an instant are derived; nothing is closed by an update. ``__place`` is the
    order of images within a commit: of several of one key, the last counts.
    """

    lake: Lake
    table: str
    columns: list[tuple[str, str]]
    keys: list[str]
    schema: str = "main"

    META = (("__version", "int64"), ("__label", "timestamp"), ("__op", "varchar"), ("__place", "int64"))

    def create(self, when: dt.datetime | None = None) -> HistoryTable:
        try:
            self.lake.reconcile_columns(self.table, [*self.META, *self.columns], self.schema, when)
        except LookupError:
            self.lake.create_table(self.table, [*self.META, *self.columns], self.schema, when)
        return self

    def log(self) -> DataFrame:
        return self.lake.read(self.table, self.schema)

    def next_version(self) -> int:
        return (self.log().agg(F.max("__version")).first()[0] or 0) + 1

    def apply(self, changes: DataFrame, when: dt.datetime | None = None, provenance: dict | None = None) -> int:
        """Write changes that carry ``version``, ``__tt`` (label) and ``__op`` as one append; returns the commits in it.

        Versions at or before the last one are left out, so the same batch again writes nothing.
        """
        rows, count = self.fresh(changes)
        if count:
            self.lake.write(self.table, rows, self.schema, when, provenance)
        return count

    def fresh(self, changes: DataFrame) -> tuple[DataFrame, int]:
        """Rows of the table for changes of versions that it does not have yet, and how many versions those are."""
        fresh = changes.where(F.col("version") >= self.next_version())
        label = F.col("__label") if "__label" in changes.columns else F.col("__tt")
        return self.placed(fresh.withColumn("__version", F.col("version")).withColumn("__label", label))

    def placed(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """``rows`` with ``__place``, and their commits. Several images of a key in one commit need places, as nothing else orders them."""
        given = "__place" in rows.columns
        rows = rows.withColumn("__place", F.col("__place").cast("bigint") if given else F.lit(0).cast("bigint"))
        groups = rows.groupBy("__version", *self.keys, "__place").agg(F.count(F.lit(1)).alias("images"))
        count, most = groups.agg(F.count_distinct("__version"), F.max("images")).first()
        if count and most > 1:
            raise ValueError(f"{most} images of one key in one commit have no order: give them __place")
        return rows, count

    def apply_commit(self, ops: DataFrame, when: dt.datetime | None = None) -> dict[str, int]:
        """One commit of rows with ``__op``, and ``__place`` where a key has several; returns its version."""
        version = self.next_version()
        rows, _ = self.placed(ops.withColumn("__version", F.lit(version).cast("bigint")).withColumn("__label", F.lit(when or now())))
        self.lake.write(self.table, rows, self.schema, when)
        return {"snapshot_id": version}

    def state(self, version: int | None = None, when: dt.datetime | None = None) -> DataFrame:
        """Rows as of a version or an instant, or now."""
        log = self.log()
        if version is not None:
            log = log.where(F.col("__version") <= version)
        if when is not None:
            log = log.where(F.col("__label") <= F.lit(when))
        return latest(log, self.keys, ["__version", "__place"]).where("__op <> 'D'").drop(*[n for n, _ in self.META])


@dataclass
class CurrentTable(HistoryTable):
    """A replica of the current state: the same log, read as its last state, and compacted to it on request."""

    def apply_net(self, upserts: DataFrame, deletes: DataFrame, when: dt.datetime | None = None) -> dict[str, int]:
        up, down = upserts.withColumn("__op", F.lit("U")), deletes.withColumn("__op", F.lit("D"))
        version = self.apply_commit(up.unionByName(down, allowMissingColumns=True), when)["snapshot_id"]
        return {"snapshot_id": version, "upserts": upserts.count(), "deletes": deletes.count()}
