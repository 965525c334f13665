"""Every registered query of the engine's own operators, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import types as registry_types
from tidemark.functions import extract, text
from tidemark.functions import json as fj
from tidemark.operators import access, acquire, codegen, diff, essence, intervals, profile, provenance, registry, scans, textsearch, ttst
from tidemark.session import scratch_path
from tidemark.sources.lake import HistoryTable, Lake
from tidemark.streaming.replay import replay
from tidemark.streaming.sinks import replicate
from tidemark.streaming.state import changes_only

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moment(text: str) -> Column:
    return F.lit(dt.datetime.fromisoformat(text)).cast("timestamp_ntz")


# Views over the driver's tables: inputs of the operators, in both engines.


def v_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.col("ts").alias("tt"), op.alias("op"), F.col("event_type").alias("kind"), "value")


V_BACKLOG = "(SELECT user_id AS k, event_id AS seq, ts AS tt, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, event_type AS kind, value FROM events)"


def v_cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.col("o_orderdate").alias("tt_start"))


V_CUR = "(SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, o_orderdate AS tt_start FROM orders WHERE o_orderkey % 3 <> 0)"
STAGED_AT = "2030-01-01 00:00:00"


def v_stg(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 5 == 0, "X").when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), status.alias("st"), F.col("o_orderpriority").alias("pr"), moment(STAGED_AT).alias("ts"))


V_STG = f"(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS st, o_orderpriority AS pr, TIMESTAMP '{STAGED_AT}' AS ts FROM orders WHERE o_orderkey % 4 <> 0)"


def v_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    split = moment("2024-01-03")
    now = events.where((F.col("ts") >= split) & (F.col("ts") < moment("2024-01-05"))).select("user_id", "event_type")
    return now, events.where(F.col("ts") < split).select("user_id", "event_type")


def v_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("schema_name"),
        F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("object_name"),
        F.col("ts").alias("sample_time"), F.floor(F.col("value") / 25).cast("bigint").alias("object_id"), F.col("event_type").alias("modify_marker"),
    )


V_IDENTITY = "(SELECT 's' || CAST(user_id % 3 AS VARCHAR) AS schema_name, 'o' || CAST(user_id AS VARCHAR) AS object_name, ts AS sample_time, CAST(floor(value / 25) AS BIGINT) AS object_id, event_type AS modify_marker FROM events)"


def v_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("skew_seconds"), F.floor(F.col("event_id") / 500).cast("bigint").alias("db_create_id"))


def v_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    named = events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("sample_time"), F.concat(F.lit("o"), (F.col("user_id") % 10).cast("string")).alias("object_name"), F.col("event_type").alias("member_name"))
    return named.groupBy("sample_time", "object_name", "member_name").agg(F.count(F.lit(1)).alias("ordinal"))


V_CAPTURE = "(SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS sample_time, 'o' || CAST(user_id % 10 AS VARCHAR) AS object_name, event_type AS member_name, count(*) AS ordinal FROM events GROUP BY 1, 2, 3)"


# Intervals and states


@query(f"SELECT k, seq, op, value, tt AS tt_start, tt_end FROM (SELECT *, lead(tt) OVER (PARTITION BY k ORDER BY tt, seq) AS tt_end FROM {V_BACKLOG}) WHERE op <> 'D'")
def backlog_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.backlog_intervals(v_backlog(spark, sf_dir), ["k"], "tt", "seq", "op").select("k", "seq", "op", "value", "tt_start", "tt_end")


@query(
    f"""SELECT k, seq, kind, tt AS tt_start, lead(tt) OVER (PARTITION BY k ORDER BY tt, seq) AS tt_end FROM (
  SELECT *, row_number() OVER w = 1 OR kind IS DISTINCT FROM lag(kind) OVER w AS fresh FROM {V_BACKLOG} WINDOW w AS (PARTITION BY k ORDER BY tt, seq)) WHERE fresh"""
)
def collapse_value_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.collapse_equal(v_backlog(spark, sf_dir), ["k"], "tt", "seq", ["kind"]).select("k", "seq", "kind", "tt_start", "tt_end")


@query(f"SELECT k, value, tt FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tt DESC, seq DESC) AS rn FROM {V_BACKLOG} WHERE tt <= TIMESTAMP '2024-01-15 00:00:00') WHERE rn = 1 AND op <> 'D'")
def pit_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: what every key looked like at an instant."""
    return intervals.state_as_of(v_backlog(spark, sf_dir), ["k"], "tt", "seq", moment("2024-01-15"), "op").select("k", "value", "tt")


@query("SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def current_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.current_state(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["user_id"], "ts", "event_id")


@query(f"SELECT k, seq, tt, op, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tt DESC, seq DESC) AS rn FROM {V_BACKLOG}) WHERE rn = 1 AND op <> 'D'")
def soft_delete_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.current_state(v_backlog(spark, sf_dir), ["k"], "tt", "seq", "op").select("k", "seq", "tt", "op", "value")


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


FEED = f"(SELECT * FROM (SELECT k, seq, op, value, tt AS tt_start, lead(tt) OVER (PARTITION BY k ORDER BY tt, seq) AS tt_end FROM {V_BACKLOG}) WHERE op <> 'D')"


@query(
    f"""SELECT k, seq, tt_start, tt_end, 'insert' AS change_type FROM {FEED} WHERE tt_start > TIMESTAMP '2024-01-10' AND tt_start <= TIMESTAMP '2024-01-12'
UNION ALL SELECT k, seq, tt_start, tt_end, 'delete' AS change_type FROM {FEED} WHERE tt_end > TIMESTAMP '2024-01-10' AND tt_end <= TIMESTAMP '2024-01-12'"""
)
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.backlog_intervals(v_backlog(spark, sf_dir), ["k"], "tt", "seq", "op")
    return intervals.change_feed(rows, moment("2024-01-10"), moment("2024-01-12")).select("k", "seq", "tt_start", "tt_end", "change_type")


@query(
    f"""SELECT k, seq, op, tt_start, tt_end FROM (SELECT *, dense_rank() OVER (ORDER BY tt, seq) AS v FROM {V_BACKLOG}) b
JOIN (SELECT k AS k2, seq AS s2, tt_start, tt_end FROM {FEED}) i ON i.k2 = b.k AND i.s2 = b.seq WHERE tt_start <= TIMESTAMP '2024-01-20' AND (tt_end > TIMESTAMP '2024-01-20' OR tt_end IS NULL)"""
)
def as_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.backlog_intervals(v_backlog(spark, sf_dir), ["k"], "tt", "seq", "op")
    return intervals.as_of_version(rows, moment("2024-01-20")).select("k", "seq", "op", "tt_start", "tt_end")


@query("SELECT CAST(0 AS BIGINT) AS overlapping")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property: intervals derived from a backlog never overlap."""
    return intervals.overlaps(intervals.backlog_intervals(v_backlog(spark, sf_dir), ["k"], "tt", "seq", "op"), ["k"]).agg(F.count(F.lit(1)).alias("overlapping"))


# Synchronisation


def synced(spark: SparkSession, sf_dir: str, on_missing: str = "keep", closed: DataFrame | None = None) -> DataFrame:
    return ttst.ttst_sync(v_cur(spark, sf_dir), v_stg(spark, sf_dir), ["k"], "ts", moment("2030-01-02"), on_missing, closed)


@query(
    f"""SELECT (SELECT count(*) FROM {V_STG}) AS staged,
  (SELECT count(*) FROM {V_CUR} c JOIN {V_STG} s USING (k) WHERE c.st IS DISTINCT FROM s.st OR c.pr IS DISTINCT FROM s.pr) AS closed,
  (SELECT count(*) FROM {V_STG} s LEFT JOIN {V_CUR} c USING (k) WHERE c.tt_start IS NULL OR c.st IS DISTINCT FROM s.st OR c.pr IS DISTINCT FROM s.pr) AS inserted"""
)
def ttst_sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttst.sync_counts(synced(spark, sf_dir), v_stg(spark, sf_dir))


SYNCED = f"""SELECT c.k, c.st, c.pr, c.tt_start, CASE WHEN s.ts IS NOT NULL AND (c.st IS DISTINCT FROM s.st OR c.pr IS DISTINCT FROM s.pr) THEN s.ts {{missing}} END AS tt_end FROM {V_CUR} c LEFT JOIN {V_STG} s USING (k)
UNION ALL SELECT s.k, s.st, s.pr, s.ts AS tt_start, NULL AS tt_end FROM {V_STG} s LEFT JOIN {V_CUR} c USING (k) WHERE c.tt_start IS NULL OR c.st IS DISTINCT FROM s.st OR c.pr IS DISTINCT FROM s.pr"""


@query(SYNCED.format(missing=""))
def ttst_sync_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttst.after_sync(synced(spark, sf_dir)).select("k", "st", "pr", "tt_start", "tt_end")


@query(SYNCED.format(missing="WHEN s.ts IS NULL THEN TIMESTAMP '2030-01-02 00:00:00'"))
def ttst_full_sync_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttst.after_sync(synced(spark, sf_dir, "close")).select("k", "st", "pr", "tt_start", "tt_end")


@query(
    f"""SELECT k, st, pr, CASE WHEN k % 10 = 1 AND change = 'inserted' THEN TIMESTAMP '2030-01-02 00:00:00' ELSE tt_start END AS tt_start FROM (
  SELECT *, CASE WHEN tt_end IS NULL AND tt_start = TIMESTAMP '{STAGED_AT}' THEN 'inserted' END AS change FROM ({SYNCED.format(missing="")})) WHERE change = 'inserted'"""
)
def ttst_collision_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with an old row that began when the new one would: the new one begins at the scrape instead."""
    closed = v_stg(spark, sf_dir).where("k % 10 = 1").select("k", F.col("ts").alias("tt_start"))
    return synced(spark, sf_dir, closed=closed).where("change = 'inserted'").select("k", "st", "pr", "tt_start")


@query(
    f"""SELECT k, st, pr, action FROM (SELECT coalesce(c.k, s.k) AS k,
  CASE WHEN c.k IS NULL THEN 'insert' WHEN s.k IS NOT NULL AND (c.st IS DISTINCT FROM s.st OR c.pr IS DISTINCT FROM s.pr) THEN 'update' ELSE 'keep' END AS action,
  CASE WHEN s.k IS NOT NULL AND (c.k IS NULL OR c.st IS DISTINCT FROM s.st OR c.pr IS DISTINCT FROM s.pr) THEN s.st ELSE c.st END AS st,
  CASE WHEN s.k IS NOT NULL AND (c.k IS NULL OR c.st IS DISTINCT FROM s.st OR c.pr IS DISTINCT FROM s.pr) THEN s.pr ELSE c.pr END AS pr
  FROM {V_CUR} c FULL OUTER JOIN {V_STG} s ON c.k = s.k)"""
)
def upsert_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttst.upsert(v_cur(spark, sf_dir), v_stg(spark, sf_dir), ["k"], ["st", "pr"])


@query(
    """SELECT d.id, d.a, d.b FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 2 = 0) d
LEFT JOIN (SELECT o_orderkey AS id, o_orderstatus AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 10 <> 0) e ON d.id = e.id
WHERE e.id IS NULL OR d.a IS DISTINCT FROM e.a OR d.b IS DISTINCT FROM e.b"""
)
def prune_noop_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    existing = orders.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_orderdate").alias("updated_at"))
    delta = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("a"), F.col("o_orderpriority").alias("b"), moment(STAGED_AT).alias("updated_at"))
    return ttst.prune_noop(delta, existing, "id", ["a", "b"]).select("id", "a", "b")


@query(f"SELECT greatest(max(tt_start), max(tt_end)) AS hwm FROM {FEED}")
def ttst_hwm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.backlog_intervals(v_backlog(spark, sf_dir), ["k"], "tt", "seq", "op")
    return ttst.hwm(rows, zero=dt.datetime(1970, 1, 1))


# Differences


@query(
    """WITH c AS (SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-05 00:00:00'),
p AS (SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00')
SELECT user_id, event_type, 'added' AS side FROM (SELECT * FROM c EXCEPT SELECT * FROM p)
UNION ALL SELECT user_id, event_type, 'removed' AS side FROM (SELECT * FROM p EXCEPT SELECT * FROM c)"""
)
def except_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.except_diff(*v_windows(spark, sf_dir))


def values_sql(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS st FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS st FROM orders WHERE o_orderkey % 4 <> 0)
SELECT TIMESTAMP '2030-01-01 00:00:00' AS ts, coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'I' WHEN b.k IS NULL THEN 'D' ELSE 'U' END AS operation, CASE WHEN b.k IS NULL THEN a.st ELSE b.st END AS st
FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.st IS DISTINCT FROM b.st"""
)
def backlog_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"))
    new = orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("st"))
    return diff.backlog_from_states(new, old, ["k"], moment(STAGED_AT))


# Acquisition


@query(f"SELECT CAST(d.version AS BIGINT) AS version, d.day, count(*) AS changes FROM (SELECT CAST(date_trunc('day', tt) AS TIMESTAMP) AS day, dense_rank() OVER (ORDER BY date_trunc('day', tt)) AS version FROM {V_BACKLOG}) d GROUP BY ALL")
def staple_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = v_backlog(spark, sf_dir).withColumn("day", F.date_trunc("day", "tt").cast("timestamp_ntz"))
    return acquire.commits(changes, "day").withColumnsRenamed({"day": "day"})


@query(f"SELECT k, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM {V_BACKLOG} WHERE seq > 100) WHERE rn = 1")
def net_changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.net_changes(v_backlog(spark, sf_dir), ["k"], "seq", "op", 100)


@query("SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, ts AS tt, max(ts) OVER () AS next_watermark FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00'")
def poll_user_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events").withColumn("gone", F.col("event_type") == "error")
    changes = acquire.UserColumnDriver("ts", ["event_id"], deleted="gone").poll(source, moment("2024-01-29"))
    upto = changes.agg(F.max("__tt").alias("next_watermark"))
    return changes.crossJoin(F.broadcast(upto)).select("event_id", "user_id", F.col("__op").alias("op"), F.col("__tt").alias("tt"), "next_watermark")


V_CDC = "(SELECT event_id AS lsn, user_id AS k, CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END AS wall FROM events)"


@query(f"SELECT lsn, k, max(wall) OVER (ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM {V_CDC}")
def cdc_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = F.when(F.col("event_id") % 11 == 0, F.col("ts") - F.expr("INTERVAL '2' HOUR")).otherwise(F.col("ts"))
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.col("user_id").alias("k"), wall.alias("wall"))
    return acquire.CDCDriver(["k"]).poll(log, None).select("lsn", "k", F.col("__label").alias("label"))


@query("SELECT event_type, max(ts) AS hwm, count(*) AS n FROM events GROUP BY event_type")
def hwm_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.hwm_per_group(table(spark, sf_dir, "events"), ["event_type"], "ts")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00' - INTERVAL 1 SECOND")
def half_open_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.half_open_window(table(spark, sf_dir, "events"), "ts", moment("2024-01-20"), moment("2024-01-22")).select("event_id", "ts")


@query(
    """WITH r AS (SELECT user_id, min(ts) AS min_upd, max(ts) AS max_upd, CASE WHEN user_id % 17 = 0 THEN 'x' END AS error FROM events WHERE user_id % 7 <> 0 OR event_type = 'signup' GROUP BY user_id),
l AS (SELECT user_id, max(ts) AS hwm, count(*) AS rows, user_id % 3 <> 0 AS has_id FROM events WHERE user_id % 5 <> 0 AND (user_id % 2 = 0 OR ts < TIMESTAMP '2024-01-20 00:00:00') GROUP BY user_id),
j AS (SELECT r.*, l.hwm, coalesce(l.rows, 0) AS rows, coalesce(l.has_id, false) AS has_id, coalesce(date_trunc('second', max_upd) = date_trunc('second', hwm), false) AS same, max_upd - min_upd <= INTERVAL 1 HOUR AS bulk FROM r LEFT JOIN l USING (user_id))
SELECT user_id, CASE WHEN error IS NOT NULL THEN 'SKIP' WHEN rows = 0 THEN 'FULL' WHEN (bulk OR (hwm IS NOT NULL AND has_id)) AND same THEN 'SKIP' WHEN bulk THEN 'FULL' WHEN hwm IS NOT NULL AND has_id THEN 'DELTA' ELSE 'FULL' END AS action,
CASE WHEN error IS NOT NULL THEN 'error' WHEN rows = 0 THEN 'initial load' WHEN (bulk OR (hwm IS NOT NULL AND has_id)) AND same THEN 'unchanged' WHEN bulk THEN 'bulk replace' WHEN hwm IS NOT NULL AND has_id THEN 'delta' ELSE 'no ids' END AS reason FROM j"""
)
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    remote = events.where("user_id % 7 <> 0 OR event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("min_upd"), F.max("ts").alias("max_upd"), F.count(F.lit(1)).alias("total"))
    remote = remote.withColumn("error", F.when(F.col("user_id") % 17 == 0, "x"))
    local = events.where("user_id % 5 <> 0").where((F.col("user_id") % 2 == 0) | (F.col("ts") < moment("2024-01-20"))).groupBy("user_id").agg(F.max("ts").alias("hwm"), F.count(F.lit(1)).alias("rows"))
    return acquire.sync_plan(remote, local.withColumn("has_id", F.col("user_id") % 3 != 0), "user_id")


@query(
    """SELECT a.user_id, a.changed_at FROM (SELECT user_id, max(ts) AS changed_at FROM events WHERE event_type <> 'error' GROUP BY user_id) a
LEFT JOIN (SELECT user_id, max(ts) AS mtime FROM events WHERE event_type = 'error' GROUP BY user_id) b USING (user_id) WHERE b.mtime IS NULL OR a.changed_at > b.mtime"""
)
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cached = events.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("mtime"))
    return acquire.stale(events.where("event_type <> 'error'"), cached, ["user_id"], "ts", "mtime").select("user_id", "changed_at")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.first_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["event_id"])


# Provenance and access


@query(
    """SELECT event_id, user_id, ts, start_event_id, start_ts FROM (SELECT e.event_id, e.user_id, e.ts, s.event_id AS start_event_id, s.ts AS start_ts,
  row_number() OVER (PARTITION BY e.event_id ORDER BY s.ts DESC, s.event_id DESC) AS rn FROM events e JOIN events s ON s.user_id = e.user_id AND s.ts < e.ts WHERE e.event_type = 'error' AND s.event_type = 'signup') WHERE rn = 1"""
)
def temporal_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    errors = events.where("event_type = 'error'").drop("event_type")
    signups = events.where("event_type = 'signup'").drop("event_type")
    return provenance.temporal_semi_join(errors, signups, ["user_id"], "ts", "ts", ["event_id"])


@query(f"SELECT b.k, b.seq, b.op, t.session_id FROM {V_BACKLOG} b LEFT JOIN (SELECT event_id - 1 AS ct_version, user_id AS session_id FROM events WHERE event_id % 2 = 0) t ON b.seq = t.ct_version + 1")
def ct_provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    transactions = table(spark, sf_dir, "events").where("event_id % 2 = 0").select((F.col("event_id") - 1).alias("ct_version"), F.col("user_id").alias("session_id"))
    return provenance.provenance_chain(v_backlog(spark, sf_dir), transactions, version="seq").select("k", "seq", "op", "session_id")


@query("WITH RECURSIVE e AS (SELECT s_suppkey AS child, s_suppkey // 2 AS parent FROM supplier WHERE s_suppkey > 1), c AS (SELECT child, parent FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON c.parent = e.child) SELECT child, parent FROM c")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "supplier").where("s_suppkey > 1").select(F.col("s_suppkey").alias("child"), F.floor(F.col("s_suppkey") / 2).cast("bigint").alias("parent"))
    return access.closure(edges, "child", "parent")


@query("SELECT resource, bool_or(effect = 'allow') AND NOT bool_or(effect = 'deny') AS allowed FROM (SELECT c_nationkey AS resource, CASE WHEN c_acctbal < 0 THEN 'deny' ELSE 'allow' END AS effect FROM customer) GROUP BY resource")
def access_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("resource"), F.when(F.col("c_acctbal") < 0, "deny").otherwise("allow").alias("effect"))
    return access.decide(rules, ["resource"])


# Registry


@query(f"SELECT sample_time, object_name, member_name, ordinal FROM {V_CAPTURE} WHERE sample_time = (SELECT max(sample_time) FROM {V_CAPTURE} WHERE sample_time <= TIMESTAMP '2024-01-15 12:00:00')")
def schema_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.schema_as_of(v_capture(spark, sf_dir), moment("2024-01-15T12:00:00")).select("sample_time", "object_name", "member_name", "ordinal")


@query(
    f"""SELECT * FROM (SELECT schema_name, object_name, sample_time, CASE WHEN row_number() OVER w = 1 THEN 'initial' WHEN object_id <> lag(object_id) OVER w THEN 'recreated' WHEN modify_marker <> lag(modify_marker) OVER w THEN 'altered' END AS status
FROM {V_IDENTITY} WINDOW w AS (PARTITION BY schema_name, object_name ORDER BY sample_time)) WHERE status IS NOT NULL"""
)
def schema_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.schema_anomalies(v_identity(spark, sf_dir), ["schema_name", "object_name"], modified="modify_marker")
    return found.select("schema_name", "object_name", "sample_time", "status")


@query(
    """SELECT seq, coalesce(db_create_id <> lag(db_create_id) OVER w, false) AS recreated, coalesce(abs(skew_seconds - lag(skew_seconds) OVER w) > 120, false) AS stepped
FROM (SELECT event_id AS seq, value AS skew_seconds, CAST(floor(event_id / 500) AS BIGINT) AS db_create_id FROM events) WINDOW w AS (ORDER BY seq)"""
)
def clock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.clock_events(v_clock(spark, sf_dir)).select("seq", "recreated", "stepped")


@query(
    f"""WITH p AS (SELECT schema_name, object_name, object_id FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, object_name ORDER BY sample_time DESC) AS rn FROM {V_IDENTITY}) WHERE rn = 1),
c AS (SELECT schema_name, object_name, object_id FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, object_name ORDER BY sample_time DESC) AS rn FROM {V_IDENTITY} WHERE sample_time < TIMESTAMP '2024-01-10 00:00:00' AND schema_name <> 's1') WHERE rn = 1)
SELECT DISTINCT p.schema_name, p.object_name FROM p LEFT JOIN c USING (schema_name, object_name) WHERE c.object_id IS DISTINCT FROM p.object_id"""
)
def dirty_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, probes = ["schema_name", "object_name"], v_identity(spark, sf_dir)
    early = probes.where(F.col("sample_time") < moment("2024-01-10")).where("schema_name <> 's1'")
    return registry.dirty_objects(registry.latest_rows(probes, keys), registry.latest_rows(early, keys), keys)


@query("SELECT r_name AS catalog_name, count(DISTINCT n_name) AS tables, count(c_custkey) AS columns FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name", F.col("n_nationkey").alias("c_nationkey"))
    tables = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("catalog_name")).join(nations, "r_regionkey", "left")
    columns = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return registry.catalog_listing(tables, columns, ["c_nationkey"], ["catalog_name"], "n_name", "c_custkey")


#: Types that the captured columns below have in turn, and a capture of columns that the parts name: a table for each brand.
COLUMN_TYPES = ["INTEGER", "TEXT", "NUMERIC(10,2)", "BLOB", "POLYGON", "REAL"]
V_COLUMNS = "(SELECT p_brand AS table_name, 'c' || p_partkey AS column_name, (" + str(COLUMN_TYPES) + ")[p_size % 6 + 1] AS data_type, p_partkey AS o FROM part)"
#: Two revisions of one table whose columns the parts name: some are added, some dropped, some of another type.
V_BEFORE = f"(SELECT column_name AS name, data_type AS type, o FROM {V_COLUMNS} WHERE o % 3 <> 0)"
V_AFTER = f"(SELECT column_name AS name, CASE WHEN o % 5 = 0 THEN 'REAL' WHEN o % 7 = 0 THEN 'VARCHAR' ELSE data_type END AS type, o FROM {V_COLUMNS} WHERE o % 4 <> 0)"


def v_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in COLUMN_TYPES])
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_name"), F.concat(F.lit("c"), "p_partkey").alias("column_name"), kinds[F.col("p_size") % 6].alias("data_type"), F.col("p_partkey").alias("o"))


def revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    columns = v_columns(spark, sf_dir)
    changed = F.when(F.col("o") % 5 == 0, "REAL").when(F.col("o") % 7 == 0, "VARCHAR").otherwise(F.col("data_type"))
    name, order = F.col("column_name").alias("name"), F.col("o").alias("ordinal")
    return columns.where("o % 3 <> 0").select(name, F.col("data_type").alias("type"), order), columns.where("o % 4 <> 0").select(name, changed.alias("type"), order)



@query(
    f"""SELECT * FROM (SELECT CASE WHEN a.name IS NULL THEN 'add' WHEN b.name IS NULL THEN 'drop' WHEN a.type <> b.type THEN 'retype' END AS kind,
  coalesce(a.name, b.name) AS name, a.type AS before_type, b.type AS after_type, CAST(coalesce(b.o, a.o) AS BIGINT) AS position
  FROM {V_BEFORE} a FULL OUTER JOIN {V_AFTER} b ON a.name = b.name) WHERE kind IS NOT NULL"""
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.schema_diff(*revisions(spark, sf_dir))


@query(f"SELECT data_type, count(*) AS n FROM {V_COLUMNS} GROUP BY data_type")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distribution(v_columns(spark, sf_dir), ["data_type"])


@query(
    f"""SELECT table_name, column_name, v.data_type, coalesce(sa_type, 'String') AS sa_type, coalesce(lake_type, 'varchar') AS lake_type FROM {V_COLUMNS} v
LEFT JOIN {values_sql([(r.type_name.lower(), r.sa_type, r.lake_type) for r in registry_types.REFERENCE if r.dialect == "sqlite"])} t(type_name, sa_type, lake_type) ON t.type_name = lower(trim(split_part(v.data_type, '(', 1)))"""
)
def type_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_types.resolve_columns(v_columns(spark, sf_dir), "sqlite").select("table_name", "column_name", "data_type", "sa_type", "lake_type")


@query("SELECT role, count(*) AS n FROM (SELECT 'table' AS role FROM orders UNION ALL SELECT 'pk' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'fk' FROM orders WHERE o_custkey % 3 = 0) GROUP BY role")
def union_all_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    role = lambda name, rows: rows.select(F.lit(name).alias("grouping_kind"), F.col("o_orderkey").alias("object_id"))
    roles = registry.union_roles(role("table", orders), role("pk", orders.where("o_orderkey % 2 = 0")), role("fk", orders.where("o_custkey % 3 = 0")))
    return roles.groupBy(F.col("grouping_kind").alias("role")).agg(F.count(F.lit(1)).alias("n"))


# Profiles


def profile_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS cardinality, CAST(min({c}) AS VARCHAR) AS smallest, CAST(max({c}) AS VARCHAR) AS largest FROM {source}" for c in columns)


@query(profile_sql("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"]))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    """WITH v AS (SELECT l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1), c AS (SELECT *, sum(k) OVER (ORDER BY v) AS upto, sum(k) OVER () AS total FROM v),
s AS (SELECT *, CAST(floor(CAST((upto - k) * 20 AS DOUBLE) / total) AS INT) AS step FROM c), h AS (SELECT step, arg_max(k, v) AS equal_rows, sum(k) - arg_max(k, v) AS range_rows, count(*) - 1 AS drr FROM s GROUP BY step)
SELECT round(CAST(sum(drr + 1) AS DOUBLE) / sum(equal_rows + range_rows), 6) AS cardinality_ratio, round(avg(equal_rows), 4) AS repeatability, round(avg(CAST(range_rows = 0 AS DOUBLE)), 6) AS discreteness, round(CAST(sum(range_rows) AS DOUBLE) / greatest(sum(drr), 1), 4) AS range_density FROM h"""
)
def histogram_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram_shape(table(spark, sf_dir, "lineitem"), "l_quantity", 20)


OVERLAP = """WITH a AS (SELECT DISTINCT c_nationkey AS v FROM customer WHERE c_custkey % 7 < 5 AND c_nationkey < 20), b AS (SELECT DISTINCT s_nationkey AS v FROM supplier),
n AS (SELECT (SELECT count(*) FROM a) AS in_a, (SELECT count(*) FROM b) AS in_b, (SELECT count(*) FROM a JOIN b USING (v)) AS in_both)"""


def overlapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.overlap(table(spark, sf_dir, "customer").where("c_custkey % 7 < 5 AND c_nationkey < 20"), table(spark, sf_dir, "supplier"), "c_nationkey", "s_nationkey")


@query(f"{OVERLAP} SELECT in_a, in_b, in_both, round(CAST(in_both AS DOUBLE) / in_a, 6) AS containment FROM n")
def fingerprint_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapped(spark, sf_dir).drop("jaccard")


@query(f"{OVERLAP} SELECT round(CAST(in_both AS DOUBLE) / (in_a + in_b - in_both), 6) AS jaccard FROM n")
def fingerprint_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapped(spark, sf_dir).select("jaccard")


@query("SELECT event_type, count(*) AS requests, round(sum(value), 2) AS bytes, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 4) AS avg_ms, count(DISTINCT user_id % 3) AS statuses FROM events GROUP BY event_type")
def traffic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").withColumn("status", F.col("user_id") % 3)
    stats = profile.traffic_stats(requests, ["event_type"], "value", "value", "status")
    return stats.withColumn("statuses", F.size("statuses").cast("bigint"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS list FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def ordered_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return profile.ordered_list(joined, ["r_name"], "n_name", ["n_nationkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


# JSON, arrays and text


@query("SELECT user_id, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id")
def json_props_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "events").select("user_id", fj.field("props", "k").alias("k"))
    return fields.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.sum(F.expr("try_cast(k AS bigint)")).alias("total"))


@query(f"SELECT table_name AS object_name, row_number() OVER (PARTITION BY table_name ORDER BY o) AS ordinal, column_name AS member_name, data_type FROM {V_COLUMNS}")
def array_unnest_ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrays for each table, names and types, back as rows with their places."""
    members = F.array_sort(F.collect_list(F.struct("o", "column_name", "data_type")))
    rows = v_columns(spark, sf_dir).groupBy(F.col("table_name").alias("object_name")).agg(members.alias("m")).select("object_name", F.col("m.column_name").alias("names"), F.col("m.data_type").alias("types"))
    return fj.unzip_rows(rows, ["object_name"], {"names": "member_name", "types": "data_type"})


@query(
    """SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{80}-\\x{FFFF}]+')) AS t FROM documents) WHERE t = 'the' GROUP BY doc_id"""
)
def text_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.search(table(spark, sf_dir, "documents"), "doc_id", "text", "the")


# Sources, essences, texts and the lake


@query("SELECT n_regionkey AS region, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def json_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array in one text, back as rows of text columns; keys with a colon need quoting."""
    packed = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias(":id"), F.col("n_name").alias("name")))).alias("payload"))
    return fj.json_rows(packed, "payload", [":id", "name"], ["region"]).withColumnRenamed(":id", "key")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 100 AS id FROM orders")
def bulk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids for a bulk load, from an offset, without a global sort in one task."""
    return scans.row_numbers(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "id").withColumn("id", F.col("id") + 100)


@query("SELECT op, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op FROM events) GROUP BY op")
def decode_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = table(spark, sf_dir, "events").select(acquire.decode_op(F.col("event_type"), ("signup",), ("error",)).alias("op"))
    return decoded.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def star() -> essence.Config:
    """A join graph over the driver's tables: lines to orders to customers, and nations where there are any."""
    config = essence.Config()
    config.add("catalog_source", {"dialect": "d", "essence": "line", "where_sql": "o.o_orderstatus <> 'P'", "change_signal": "o.o_orderdate"})
    config.add("catalog_attr", *[{"dialect": "d", "essence": "line", "ord": i, "attr": a, "expr": e} for i, (a, e) in enumerate([("orderkey", "l.l_orderkey"), ("line", "l.l_linenumber"), ("customer", "c.c_name"), ("nation", "n.n_name")])])
    config.add("catalog_table", *[{"dialect": "d", "essence": "line", "alias": a, "expr": e, "is_root": r} for a, e, r in [("l", "lineitem", 1), ("o", "orders", 0), ("c", "customer", 0), ("n", "nation", 0)]])
    config.add("catalog_join", {"dialect": "d", "essence": "line", "child": "l", "parent": "o", "child_col": "l_orderkey", "parent_col": "o_orderkey"}, {"dialect": "d", "essence": "line", "child": "o", "parent": "c", "child_col": "o_custkey", "parent_col": "c_custkey"}, {"dialect": "d", "essence": "line", "child": "c", "parent": "n", "child_col": "c_nationkey", "parent_col": "n_nationkey", "is_outer": 1})
    return config


LINES = "SELECT l_orderkey AS orderkey, l_linenumber AS line, c_name AS customer, n_name AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P'"


@query(LINES)
def essence_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return essence.projection(star(), "d", "line", lambda name: table(spark, sf_dir, name))


@query(LINES + " AND o_orderdate > TIMESTAMP '1996-01-01 00:00:00'")
def essence_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return essence.projection(star(), "d", "line", lambda name: table(spark, sf_dir, name), moment("1996-01-01"))


@query(f"SELECT table_name, substr(sha256('[' || string_agg('[\"' || column_name || '\",\"' || data_type || '\"]', ',' ORDER BY o) || ']'), 1, 16) AS fingerprint FROM {V_COLUMNS} GROUP BY table_name")
def schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.fingerprints(v_columns(spark, sf_dir), ["table_name"], "column_name", "data_type", "o")


@query(f"SELECT table_name, string_agg('\"' || column_name || '\" ' || data_type, ', ' ORDER BY o) AS ddl FROM {V_COLUMNS} GROUP BY table_name")
def table_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegen.table_ddl(v_columns(spark, sf_dir), ["table_name"], order="o")


@query(
    f"""SELECT * FROM (SELECT coalesce(a.name, b.name) AS name, a.type AS expected_type, b.type AS actual_type, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'extra' WHEN coalesce(x.f, a.type) <> coalesce(y.f, b.type) THEN 'family' END AS problem
FROM {V_BEFORE} a FULL OUTER JOIN {V_AFTER} b ON a.name = b.name LEFT JOIN {values_sql(sorted(registry_types.family_map().items()))} x(t, f) ON x.t = a.type LEFT JOIN {values_sql(sorted(registry_types.family_map().items()))} y(t, f) ON y.t = b.type) WHERE problem IS NOT NULL"""
)
def column_set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.column_set_compare(*revisions(spark, sf_dir), registry_types.family_map())


VERSIONED = f"(SELECT k, seq AS begin_snapshot, value, end_snapshot FROM (SELECT k, seq, op, value, lead(seq) OVER (PARTITION BY k ORDER BY seq) AS end_snapshot FROM {V_BACKLOG}) WHERE op <> 'D')"


def versioned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = intervals.backlog_intervals(v_backlog(spark, sf_dir).withColumn("at", F.col("seq")), ["k"], "at", "seq", "op")
    snapshots = table(spark, sf_dir, "events").select(F.col("event_id").alias("snapshot_id"), F.col("ts").alias("snapshot_time"))
    return rows.select("k", "value", F.col("tt_start").alias("begin_snapshot"), F.col("tt_end").alias("end_snapshot")), snapshots


@query(f"SELECT k, v.value, begin_snapshot AS tt_start, end_snapshot AS tt_end, b.ts AS tt_start_ts, e.ts AS tt_end_ts FROM {VERSIONED} v JOIN events b ON b.event_id = v.begin_snapshot LEFT JOIN events e ON e.event_id = v.end_snapshot WHERE begin_snapshot > 500 OR end_snapshot > 500")
def extract_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttst.extract_intervals(*versioned(spark, sf_dir), since=500).select("k", "value", "tt_start", "tt_end", "tt_start_ts", "tt_end_ts")


@query(f"SELECT count(*) FILTER (WHERE begin_snapshot > 500) AS inserted, count(*) FILTER (WHERE begin_snapshot <= 500 AND end_snapshot > 500) AS closed FROM {VERSIONED}")
def project_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    inserted, closing = ttst.project(ttst.extract_intervals(*versioned(spark, sf_dir), since=500), 500)
    return inserted.agg(F.count(F.lit(1)).alias("inserted")).crossJoin(closing.agg(F.count(F.lit(1)).alias("closed")))


@query(f"SELECT k, v.value, begin_snapshot AS tt_start, end_snapshot AS tt_end, b.ts AS tt_start_ts, e.ts AS tt_end_ts FROM {VERSIONED} v JOIN events b ON b.event_id = v.begin_snapshot LEFT JOIN events e ON e.event_id = v.end_snapshot")
def outward_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that stood at snapshot 500, brought up to date: the same intervals as from nothing."""
    rows, snapshots = versioned(spark, sf_dir)
    then = rows.where("begin_snapshot <= 500").withColumn("end_snapshot", F.when(F.col("end_snapshot") <= 500, F.col("end_snapshot")))
    target = ttst.extract_intervals(then, snapshots, -1).select("k", "value", "tt_start", "tt_end", "tt_start_ts", "tt_end_ts")
    inserted, closing = ttst.project(ttst.extract_intervals(rows, snapshots, 500), 500)
    return ttst.apply_projection(target, inserted, closing, ["k"])


@query(ORACLES["temporal_semi_join"])
def temporal_semi_join_stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as-of join with each key's time cut into days, for keys that hold many rows."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    errors = events.where("event_type = 'error'").drop("event_type")
    signups = events.where("event_type = 'signup'").drop("event_type")
    return provenance.temporal_semi_join(errors, signups, ["user_id"], "ts", "ts", ["event_id"], stretch="day")


@query(
    """WITH v AS (SELECT l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1), c AS (SELECT *, sum(k) OVER (ORDER BY v) AS upto, sum(k) OVER () AS total FROM v), s AS (SELECT *, CAST(floor(CAST((upto - k) * 20 AS DOUBLE) / total) AS INT) AS step FROM c)
SELECT step, arg_max(k, v) AS equal_rows, CAST(sum(k) - arg_max(k, v) AS BIGINT) AS range_rows, count(*) - 1 AS distinct_range_rows, max(v) AS range_high_key FROM s GROUP BY step"""
)
def equi_depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.equi_depth(table(spark, sf_dir, "lineitem"), "l_quantity", 20)


@query(f"SELECT k, count(*) AS versions, count(*) FILTER (WHERE op <> 'D') AS images FROM {V_BACKLOG} GROUP BY k")
def fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many versions of a key a backlog keeps; a net poll keeps one."""
    return v_backlog(spark, sf_dir).groupBy("k").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("op") != "D").alias("images"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS millis, upper(hex(event_type)) AS hexed, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, 's_' || replace(replace('data.' || event_type || '-x', '.', '_'), '-', '_') AS schema_name FROM events")
def scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", extract.epoch_millis(F.col("ts")).alias("millis"), extract.to_hex(F.col("event_type")).alias("hexed"), extract.to_iso(F.col("ts")).alias("iso"),
        text.domain_to_schema(F.concat(F.lit("data."), F.col("event_type"), F.lit("-x"))).alias("schema_name"),
    )


@query(
    """SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS hits FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{80}-\\x{FFFF}]+')) AS term FROM documents) WHERE term <> '' GROUP BY doc_id, term) GROUP BY term"""
)
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = textsearch.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("hits"))


@query(f"SELECT schema_name, object_name, max(sample_time) AS last_seen FROM {V_IDENTITY} GROUP BY ALL HAVING max(sample_time) < (SELECT max(sample_time) FROM {V_IDENTITY})")
def dropped_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.dropped_objects(v_identity(spark, sf_dir), ["schema_name", "object_name"])


@query("SELECT n_nationkey AS id, n_name AS label, CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey END AS region FROM nation")
def lake_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes with a column added between and one renamed after: old files read as null and under the new name."""
    nations, store = table(spark, sf_dir, "nation"), Lake(spark, scratch_path(spark, "lake")).init()
    store.create_table("nation", [("id", "int32"), ("name", "varchar")])
    store.write("nation", nations.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    store.reconcile_columns("nation", [("region", "int32")])
    store.write("nation", nations.where("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    store.rename_column("nation", "name", "label")
    return store.read("nation")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0")
def lake_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as of the version before its second write."""
    nations, store = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), Lake(spark, scratch_path(spark, "lake")).init()
    store.create_table("nation", [("id", "int32"), ("name", "varchar")])
    first = store.write("nation", nations.where("id % 2 = 0"))
    store.write("nation", nations.where("id % 2 = 1"))
    return store.read("nation", version=first)


@query("SELECT 'events' AS source, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of several tables as one report; Parquet footers answer them."""
    parts = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("source"), "n") for n in ("events", "orders", "customer")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Streams: the events replayed, and the table that the stream wrote


@query(ORACLES["current_merge_on_read"].replace("event_type, value", "event_type"))
def stream_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state after a stream of changes has been applied to a lake batch by batch."""
    changes = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    history = HistoryTable(Lake(spark, scratch_path(spark, "lake")).init(), "events", [("event_id", "int64"), ("ts", "timestamp_ntz"), ("user_id", "int64"), ("event_type", "varchar")], ["user_id"]).create()
    stream = replay(changes, "ts").withColumn("__op", F.lit("U")).withColumn("__tt", F.col("ts"))
    replicate(stream, history, scratch_path(spark, "checkpoint"), "events")
    return history.state().select("event_id", "ts", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE fresh")
def stream_change_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that differ from the key's last one, by a stateful stream."""
    stream = replay(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "ts")
    target = scratch_path(spark, "changes")
    kept = changes_only(stream, ["user_id"], ["ts", "event_id"], ["event_type"])
    kept.writeStream.option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).format("parquet").start(target).awaitTermination()
    return spark.read.schema(kept.schema).parquet(target).select("event_id", "user_id", "event_type")
