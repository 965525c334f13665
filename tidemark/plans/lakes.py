"""Registered queries over lakes made from the given tables: versions, inlined rows, pruning, deletions, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import replica
from tidemark.plans.catalogue import moment, query, table
from tidemark.session import scratch_path
from tidemark.sources import lake
from tidemark.sources.lake import Lake
from tidemark.streaming.replay import replay
from tidemark.streaming.state import retained_changes

SUPPLIER = [("s_suppkey", "int64"), ("s_name", "varchar"), ("s_nationkey", "int32"), ("s_acctbal", "float64")]
ORDERS = [("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "varchar"), ("o_totalprice", "float64"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "varchar")]
CUSTOMER = [("c_custkey", "int64"), ("c_nationkey", "int32"), ("c_acctbal", "float64")]


def new_lake(spark: SparkSession, **tables: list[tuple[str, str]]) -> Lake:
    store = Lake(spark, scratch_path(spark, "lake")).init()
    for name, columns in tables.items():
        store.create_table(name, columns)
    return store


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal, s_nationkey < 5 OR s_acctbal < 0 AS old FROM supplier WHERE s_nationkey < 15 AND (s_nationkey < 5 OR s_acctbal >= 0) ORDER BY s_suppkey")
def lake_inlined_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of few rows, one for each nation, kept in the log; some rows deleted and the rest flushed to files, and a version between read."""
    suppliers, store = table(spark, sf_dir, "supplier"), new_lake(spark, supplier=SUPPLIER)
    for nation in range(25):
        store.write("supplier", suppliers.where(F.col("s_nationkey") == nation), inline=lake.INLINE_ROWS)
        if nation == 14:
            at = store.delete("supplier", (F.col("s_nationkey") >= 5) & (F.col("s_acctbal") < 0)) or store.log.last()
    store.flush("supplier")
    return store.read("supplier", version=at).withColumn("old", (F.col("s_nationkey") < 5) | (F.col("s_acctbal") < 0))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-06-01 00:00:00' AND o_totalprice > 1000")
def lake_pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of a year of a table written by date: the files of other dates are ruled out by their ends and not opened."""
    store = new_lake(spark, orders=ORDERS)
    store.write("orders", table(spark, sf_dir, "orders").repartitionByRange(16, "o_orderdate"))
    found = store.read("orders", where=[("o_orderdate", ">=", moment("1996-03-01 00:00:00")), ("o_orderdate", "<", moment("1996-06-01 00:00:00")), ("o_totalprice", ">", 1000.0)])
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT 'now' AS at, o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey % 100 <> 7 AND o_orderstatus <> 'P' GROUP BY 2 UNION ALL SELECT 'first', o_orderstatus, count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey % 100 <> 7 GROUP BY 2 UNION ALL SELECT 'before', o_orderstatus, count(*), sum(o_orderkey)::BIGINT FROM orders GROUP BY 2")
def lake_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundredth of the rows deleted, then those of one status, without rewriting a file; all three versions read."""
    store = new_lake(spark, orders=ORDERS)
    before = store.write("orders", table(spark, sf_dir, "orders"))
    first = store.delete("orders", F.col("o_orderkey") % 100 == 7) or before
    store.delete("orders", F.col("o_orderstatus") == "P")
    found = [store.read("orders", version=v).withColumn("at", F.lit(name)) for name, v in (("now", None), ("first", first), ("before", before))]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("at", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_acctbal >= 0 AS kept FROM customer")
def lake_expired_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions before a replacement expired and their files and an aborted write's removed: what is kept reads as before."""
    customers, store = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), new_lake(spark, customer=CUSTOMER)
    store.write("customer", customers.where("c_acctbal < 0"))
    whole = store.replace("customer", customers)
    store.write_files("customer", customers, "main")
    store.delete("customer", F.col("c_acctbal") < 0)
    store.expire(whole)
    store.clean(lake.now() + lake.dt.timedelta(minutes=1))
    left = store.read("customer").select("c_custkey").withColumn("left", F.lit(True))
    return store.read("customer", version=whole).join(left, "c_custkey", "left").select("c_custkey", "c_nationkey", "c_acctbal", F.coalesce("left", F.lit(False)).alias("kept"))


@query("SELECT 'orders' AS table_name, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS rows, 1 AS columns_added UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 0")
def lake_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables written by one commit, one of them partitioned and widened: rows and columns from the catalog's listings."""
    store = new_lake(spark, orders=ORDERS, customer=CUSTOMER)
    store.set_partitioning("orders", ["o_orderstatus"])
    made = store.write_all({"orders": table(spark, sf_dir, "orders"), "customer": table(spark, sf_dir, "customer")})
    store.reconcile_columns("orders", [*ORDERS, ("o_comment", "varchar")])
    store.delete("orders", F.col("o_orderstatus") != "F")
    was = store.current_columns(made).groupBy("table_name").agg(F.count(F.lit(1)).alias("was"))
    columns = store.current_columns().groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).join(was, "table_name")
    return store.table_info().join(columns, "table_name").select("table_name", "rows", (F.col("n") - F.col("was")).cast("int").alias("columns_added"))


@query("SELECT snapshot_id, changes_made FROM (VALUES (1, 'created_table:\"main\".\"customer\"'), (2, 'inserted_into_table:\"main\".\"customer\"'), (3, 'deleted_from_table:\"main\".\"customer\"'), (4, 'compacted_table:\"main\".\"customer\"'), (5, 'dropped_table:\"main\".\"customer\"')) AS t(snapshot_id, changes_made) WHERE (SELECT count(*) FROM customer WHERE c_acctbal < 0) > 0")
def lake_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version changed, from the log: a table's life from its creation to its end."""
    store = new_lake(spark, customer=CUSTOMER)
    store.write("customer", table(spark, sf_dir, "customer"))
    store.delete("customer", F.col("c_acctbal") < 0)
    store.compact("customer")
    store.drop_table("customer")
    return store.snapshots().where("snapshot_id > 0").select("snapshot_id", "changes_made")


@query("SELECT 'orders' AS source, o_custkey AS id, max(o_orderkey) AS last, count(*) AS images FROM orders GROUP BY o_custkey UNION ALL SELECT 'events', user_id, max(event_id), count(*) FROM events GROUP BY user_id UNION ALL SELECT 'customer', c_nationkey, max(c_custkey), count(*) FROM customer GROUP BY c_nationkey")
def lake_synced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources synced into one lake; one fails at first, and the next run takes up what is missing and no more."""
    store, away = new_lake(spark), {"events"}
    keys = {"orders": ("o_custkey", "o_orderkey"), "events": ("user_id", "event_id"), "customer": ("c_nationkey", "c_custkey")}

    def copy(name: str) -> replica.Replica:
        key, order = keys[name]
        rows = table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("id"), F.col(order).cast("bigint").alias("last"))

        def poll(watermark: str | None) -> DataFrame:
            if name in away:
                raise ConnectionError(name)
            # A commit for each thousand of the source's own numbers.
            new = rows.withColumn("__tt", F.floor(F.col("last") / 1000)).where(F.col("__tt") > (-1 if watermark is None else int(watermark)))
            return new.select("*", F.lit("U").alias("__op"), F.col("last").alias("__place"), F.timestamp_seconds("__tt").cast("timestamp_ntz").alias("__label"))

        return replica.Replica(store, name, ["id"], lambda: [("id", "int64"), ("last", "int64")], poll)

    copies = [copy(n) for n in keys]
    replica.sync_all(copies, lake.now(), batch_rows=20_000)
    away.clear()
    replica.sync_all(copies, lake.now(), batch_rows=20_000)
    found: DataFrame | None = None
    for name in keys:
        history = lake.HistoryTable(store, name, [("id", "int64"), ("last", "int64")], ["id"])
        counts = history.log().groupBy("id").agg(F.count(F.lit(1)).alias("images"))
        some = history.state().join(counts, "id").select(F.lit(name).alias("source"), "id", "last", "images")
        found = some if found is None else found.unionByName(some)
    return found


# Streams with event time


@query(
    """WITH e AS (SELECT user_id, ts, event_id, event_type, lag(ts) OVER w AS before, lag(event_type) OVER w AS was, lead(ts) OVER w AS next, max(ts) OVER () - INTERVAL 1 HOUR AS mark FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT user_id, 'change' AS kind, ts, event_id, event_type FROM e WHERE before IS NULL OR before + INTERVAL 12 HOUR <= ts OR was IS DISTINCT FROM event_type
UNION ALL SELECT user_id, 'expired', ts, event_id, event_type FROM e, m WHERE ts + INTERVAL 12 HOUR <= coalesce(next, m.mark)"""
)
def stream_retained_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each key in event time, and keys silent for half a day, from a replayed stream whose state expires."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    found = retained_changes(replay(events, "ts", 6), ["user_id"], "ts", "event_id", ["event_type"], "1 hour", lake.dt.timedelta(hours=12))
    target = scratch_path(spark, "retained")
    found.writeStream.option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).format("parquet").start(target).awaitTermination()
    return spark.read.schema(found.schema).parquet(target).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
