"""Acquisition: change records from user columns, change tracking, capture logs and backlogs; plans and commits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.intervals import different, latest
from tidemark.operators.scans import row_numbers, running_max

INSERT_OPS, DELETE_OPS = ("I", "INSERT", "insert"), ("D", "DELETE", "delete")


def decode_op(op: Column, inserts: tuple = INSERT_OPS, deletes: tuple = DELETE_OPS) -> Column:
    """I, U or D of a source's own tokens; whatever is neither an insert nor a delete is an update."""
    return F.when(op.isin(*deletes), "D").when(op.isin(*inserts), "I").otherwise("U")


def next_watermark(changes: DataFrame, previous: object, column: str = "__tt") -> object:
    """The greatest transaction time of a poll, or the previous one if there was nothing."""
    found = changes.agg(F.max(column)).first()[0]
    return previous if found is None else found


@dataclass
class UserColumnDriver:
    """Rows whose user column passed the watermark. Strictly after by default; ``inclusive`` reads the boundary again.

    A row that arrives late with the watermark's own time is lost by a strict poll; an inclusive one returns
    boundary rows twice, which a merge by (key, time) makes harmless.
    """

    column: str
    keys: list[str]
    deleted: str | None = None
    inclusive: bool = False
    lag_seconds: int = 0

    def poll(self, source: DataFrame, watermark: object, now: Column | None = None) -> DataFrame:
        at = F.col(self.column)
        rows = source if watermark is None else source.where(at >= watermark if self.inclusive else at > watermark)
        if now is not None:
            rows = rows.where(at < now - F.make_dt_interval(secs=F.lit(self.lag_seconds)))
        gone = F.coalesce(F.col(self.deleted), F.lit(False)) if self.deleted else F.lit(False)
        return rows.select("*", F.when(gone, "D").otherwise("U").alias("__op"), F.struct(*self.keys).alias("__key"), at.alias("__tt"))


@dataclass
class BacklogDriver:
    """Images of an append-only log after the watermark."""

    ts: str
    keys: list[str]
    op: str | None = None
    inclusive: bool = False
    inserts: tuple = INSERT_OPS
    deletes: tuple = DELETE_OPS

    def poll(self, log: DataFrame, watermark: object) -> DataFrame:
        at = F.col(self.ts)
        rows = log if watermark is None else log.where(at >= watermark if self.inclusive else at > watermark)
        code = decode_op(F.col(self.op), self.inserts, self.deletes) if self.op else F.lit("U")
        return rows.select("*", code.alias("__op"), F.struct(*self.keys).alias("__key"), at.alias("__tt"))


@dataclass
class ChangeTrackingDriver:
    """Net changes after a version: the last operation of each key with the live row (none for a delete).

    ``oldest`` is the least version that the source still tracks; a watermark before it needs a full resync.
    Labels are ``epoch + version * unit_seconds``.
    """

    keys: list[str]
    version: str = "version"
    op: str = "op"
    epoch: str = "1970-01-01 00:00:00"
    unit_seconds: int = 1

    def poll(self, changes: DataFrame, live: DataFrame | None, watermark: int, oldest: int | None = None) -> DataFrame:
        if oldest is not None and watermark < oldest:
            raise ResyncRequired(f"watermark {watermark} is before the oldest tracked version {oldest}")
        net = latest(changes.where(F.col(self.version) > watermark), self.keys, [self.version])
        code = decode_op(F.col(self.op))
        rows = net.select(*self.keys, code.alias("__op"), F.col(self.version).alias("__tt"))
        if live is not None:
            rows = rows.join(live, self.keys, "left")
        label = F.lit(self.epoch).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("__tt") * self.unit_seconds)
        return rows.withColumn("__key", F.struct(*self.keys)).withColumn("__label", label)

    def next_watermark(self, server_version: int | None, previous: int) -> int:
        return previous if server_version is None else server_version


class ResyncRequired(RuntimeError):
    """The source no longer has the changes after the watermark."""


@dataclass
class CDCDriver:
    """Every change of a capture log, in order; before-images of updates go. Labels never fall back.

    Operations are 1 (delete), 2 (insert), 3 (before an update) and 4 (after an update).
    """

    keys: list[str]
    lsn: str = "lsn"
    seq: str | None = None
    op: str | None = None
    wall: str = "wall"

    def poll(self, log: DataFrame, watermark: object) -> DataFrame:
        rows = log if watermark is None else log.where(F.col(self.lsn) > watermark)
        if self.op:
            rows = rows.where(F.col(self.op) != 3).withColumn("__op", F.when(F.col(self.op) == 1, "D").when(F.col(self.op) == 2, "I").otherwise("U"))
        tie = [self.seq] if self.seq else None
        if self.seq:
            rows = rows.withColumn("__place", F.col(self.seq).cast("bigint"))
        return running_max(rows.withColumn("__tt", F.col(self.lsn)), self.lsn, self.wall, "__label", tie).withColumn("__key", F.struct(*self.keys))


def staple(changes: DataFrame, tt: str = "__tt", first: int = 1, version: str = "version") -> DataFrame:
    """Every change with the version of its commit: one for each distinct transaction time, in order, by one plan.

    Distinct times are few against changes; they are numbered apart and joined back. A change without a time belongs
    to no commit, and is an error. ``changes`` is read more than once: a poll of a source that grows must be
    materialized before.
    """
    changes = changes.withColumn(tt, F.when(F.col(tt).isNull(), F.raise_error(F.lit("a change has no transaction time"))).otherwise(F.col(tt)))
    times = changes.groupBy(tt).agg(F.count(F.lit(1)).alias("__n"))
    kind = times.schema[tt].dataType
    number = F.unix_micros(F.col(tt).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.unix_date(tt) if isinstance(kind, T.DateType) else F.col(tt).cast("bigint")
    numbered = row_numbers(times.withColumn("__order", number), "__order", version).select(F.col(tt).alias("__at"), (F.col(version) + (first - 1)).alias(version))
    return changes.join(numbered, changes[tt] == numbered["__at"]).drop("__at")


def commits(changes: DataFrame, tt: str = "__tt", first: int = 1) -> DataFrame:
    """One row for each commit: version, tt, changes."""
    return staple(changes, tt, first).groupBy("version", tt).agg(F.count(F.lit(1)).alias("changes"))


def net_changes(log: DataFrame, keys: list[str], version: str, op: str, after: object) -> DataFrame:
    """The last operation of each key after a version."""
    return latest(log.where(F.col(version) > after), keys, [version]).select(*keys, op, version)


def hwm_per_group(rows: DataFrame, group: list[str], at: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.max(at).alias("hwm"), F.count(F.lit(1)).alias("n"))


def half_open_window(rows: DataFrame, at: str, hwm: object, now: Column, margin_seconds: int = 1) -> DataFrame:
    """Rows in ``[hwm, now - margin)``: the boundary is read again, the newest moment is left for the next poll."""
    return rows.where((F.col(at) >= hwm) & (F.col(at) < now - F.make_dt_interval(secs=F.lit(margin_seconds))))


def sync_plan(remote: DataFrame, local: DataFrame, key: str, force: bool = False, span_seconds: int = 3600) -> DataFrame:
    """``action`` and ``reason`` for each dataset: SKIP, FULL or DELTA.

    ``remote`` has min_upd, max_upd, total and error; ``local`` has hwm, rows and has_id. Errors are skipped;
    a forced or first load is full; a remote maximum equal to the local one (to the second) is skipped; a span
    of at most ``span_seconds`` is a bulk replacement and loaded in full; the rest is a delta if the local
    rows have ids and a high-water mark, else full.
    """
    both = remote.join(local, key, "left")
    rows, has_id = F.coalesce("rows", F.lit(0)), F.coalesce("has_id", F.lit(False))
    same = F.coalesce(F.date_trunc("second", "max_upd") == F.date_trunc("second", "hwm"), F.lit(False))
    span = F.unix_micros(F.col("max_upd").cast("timestamp")) - F.unix_micros(F.col("min_upd").cast("timestamp"))
    bulk = F.coalesce(span <= span_seconds * 1_000_000, F.lit(False))
    tail = F.col("hwm").isNotNull() & has_id
    action = (
        F.when(F.col("error").isNotNull(), "SKIP").when(F.lit(force) | (rows == 0), "FULL").when((bulk | tail) & same, "SKIP").when(bulk, "FULL").when(tail, "DELTA").otherwise("FULL")
    )
    reason = (
        F.when(F.col("error").isNotNull(), "error").when(F.lit(force), "forced").when(rows == 0, "initial load").when((bulk | tail) & same, "unchanged").when(bulk, "bulk replace").when(tail, "delta").otherwise("no ids")
    )
    return both.select(key, action.alias("action"), reason.alias("reason"))


def stale(log: DataFrame, cached: DataFrame, keys: list[str], ts: str, mtime: str, op: str | None = None, limit: int | None = None) -> DataFrame:
    """Keys whose last change (deletes aside) is after their cached copy, or that have none; the oldest ``limit`` if given."""
    live = log if op is None else log.where(~F.col(op).isin(*DELETE_OPS))
    last = live.groupBy(*keys).agg(F.max(ts).alias("changed_at"))
    found = last.join(cached.select(*keys, mtime), keys, "left").where(F.col(mtime).isNull() | (F.col("changed_at") > F.col(mtime)))
    return found if limit is None else found.orderBy("changed_at", *keys).limit(limit)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in page order."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns])


@dataclass
class ColumnCollection:
    """The ordered columns of one table revision, with its key, dialect and identity."""

    name: str
    columns: list[tuple[str, str]]
    keys: list[str]
    dialect: str = "spark"
    schema: str | None = None
    object_id: int | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_capture(cls, rows: DataFrame, table: str, keys: list[str], dialect: str = "spark") -> ColumnCollection:
        found = rows.where((F.col("object_name") == table) & F.col("grouping_kind").isin("table", "view")).orderBy("ordinal").collect()
        first = found[0] if found else None
        return cls(table, [(r["member_name"], r["data_type"]) for r in found], keys, dialect, first and first["schema_name"], first and first["object_id"])

    def struct(self, resolve: Callable[[str], T.DataType]) -> T.StructType:
        return T.StructType([T.StructField(n, resolve(t)) for n, t in self.columns])

    def sync(self, changes: DataFrame, replica: object) -> int:
        """Apply polled changes to a replica as one write, a version for each distinct time; returns the commits made."""
        return replica.apply(staple(changes, first=replica.next_version()))


def changed_columns(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each key and column whose value differs between two states: what a mirror check reports."""
    a = before.select(*keys, F.struct(*[F.col(v).cast("string").alias(v) for v in values]).alias("__a"))
    b = after.select(*keys, F.struct(*[F.col(v).cast("string").alias(v) for v in values]).alias("__b"))
    both = a.join(b, keys, "full")
    cells = F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"__a.{v}").alias("before"), F.col(f"__b.{v}").alias("after")) for v in values])
    return both.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where(different(F.col("before"), F.col("after")))
