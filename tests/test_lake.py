"""The lake's commits, inlined rows, pruning, deletions and expiry."""

import datetime as dt
import multiprocessing
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replica
from tidemark.sources import commitlog, lake


@pytest.fixture
def store(spark, tmp_path):
    return lake.Lake(spark, f"file://{tmp_path}/lake").init()


def data_files(path):
    return [f"{folder}/{n}" for folder, _, names in os.walk(str(path)) if "_catalog" not in folder for n in names if n.endswith(".parquet")]


def test_a_thousand_small_commits_make_no_file(spark, store, tmp_path):
    store.create_table("t", [("id", "int64"), ("name", "varchar"), ("price", "float64"), ("at", "timestamp_ntz"), ("raw", "binary")])
    rows = [{"id": i, "name": None if i % 7 == 0 else f"n{i}", "price": i / 3, "at": dt.datetime(2026, 1, 1, microsecond=i), "raw": bytes([i % 256])} for i in range(1000)]
    versions = [store.write("t", [r]) for r in rows]
    assert versions == list(range(2, 1002)) and not data_files(tmp_path)
    key = lambda r: r["id"]
    for upto in (1, 300, 1000):
        assert sorted((r.asDict() for r in store.read("t", version=versions[upto - 1]).collect()), key=key) == rows[:upto]
    assert store.read("t", version=1).count() == 0
    again = lake.Lake(spark, store.path).init()  # from the last checkpoint and what followed
    assert again.log.base is not None and again.known == 1001
    assert again.read("t").agg(F.sum("id")).first()[0] == sum(range(1000))
    again.delete("t", F.col("id") >= 500)
    again.flush("t")
    assert len(data_files(tmp_path)) >= 1 and again.read("t").count() == 500
    assert again.read("t", version=versions[699]).count() == 700 and again.read("t", version=1002).count() == 500
    assert again.inlined_of(again.table_id("t")) == [] and again.changes("t", 1, 1005).count() == 1000


def test_inlined_rows_read_like_files(spark, tmp_path):
    stores = [lake.Lake(spark, f"file://{tmp_path}/{n}").init() for n in ("inline", "files")]
    frames = [spark.createDataFrame([(i, f"v{i}", [i, i + 1], {"a": i}) for i in range(k, k + 3)], "id long, v string, list array<int>, held map<string,int>") for k in (0, 10, 20)]
    for store, inline in zip(stores, (10, 0), strict=True):
        store.create_table("t", [("id", "int64"), ("v", "varchar"), ("list", "array<int>"), ("held", "map<string,int>")])
        store.write("t", frames[0], inline=inline)
        store.rename_column("t", "v", "w")
        store.reconcile_columns("t", [("more", "decimal(9,2)")])
        store.write("t", frames[1].withColumnRenamed("v", "w").withColumn("more", F.lit("1.25").cast("decimal(9,2)")), inline=inline)
        store.delete("t", F.col("id").isin(1, 11))
        store.write("t", frames[2].withColumnRenamed("v", "w"), inline=inline)
    assert stores[0].list_files("t").isEmpty() and not stores[1].list_files("t").isEmpty()
    for version in (2, 3, 4, 5, 6, 7):
        one, other = (sorted(map(str, s.read("t", version=version).collect())) for s in stores)
        assert one == other and one
    assert [s.table_info().first()["rows"] for s in stores] == [7, 7]


def test_only_files_that_can_match_are_opened(spark, store):
    store.create_table("t", [("k", "int64"), ("day", "date"), ("s", "varchar"), ("n", "float64")])
    rows = spark.range(4000).select(F.col("id").alias("k"), F.expr("date_add(date'2026-01-01', cast(id / 100 as int))").alias("day"), F.format_string("%06d", "id").alias("s"), F.when(F.col("id") >= 3000, F.col("id") * 1.0).alias("n"))
    store.write("t", rows.repartitionByRange(8, "k"))
    assert store.list_files("t").count() == 8 and store.catalog("file_column_stats").count() == 32
    cases = [([("k", ">=", 3900)], 1, 100), ([("k", ">", 499), ("k", "<", 501)], 1, 1), ([("day", "=", dt.date(2026, 1, 3))], 1, 100), ([("s", "<=", "000010")], 1, 11), ([("n", ">", 0.0)], 3, 1000), ([("k", "<", 0)], 0, 0)]
    for where, files, count in cases:
        found = store.read("t", where=where)
        assert found.count() == count
        if files:
            opened = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
            assert len(opened) <= files <= 3 and len(found.inputFiles()) <= files
    store.rename_column("t", "k", "key")
    assert len(store.read("t", where=[("key", "=", 7)]).inputFiles()) == 1
    with pytest.raises(ValueError, match="unknown sign"):
        store.read("t", where=[("key", "<>", 7)])


def test_deletions_rewrite_nothing(spark, store, tmp_path):
    store.create_table("t", [("p", "int64"), ("k", "int64")])
    store.set_partitioning("t", ["p"])
    store.write("t", spark.range(10_000).select((F.col("id") % 3).alias("p"), F.col("id").alias("k")).repartition(4))
    store.write("t", [{"p": 1, "k": -1}, {"p": 2, "k": -2}])
    before, files = store.log.last(), set(data_files(tmp_path))
    assert store.delete("t", F.col("k") % 100 == 0) == before + 1
    assert store.read("t").count() == 9902 and store.read("t", version=before).count() == 10_002
    assert store.delete("t", F.col("k") % 100 == 0) is None
    store.delete("t", (F.col("k") % 100 == 1) | (F.col("k") == -1))
    assert sorted(r["k"] for r in store.read("t").collect()) == [-2, *(k for k in range(10_000) if k % 100 > 1)]
    assert {f for f in data_files(tmp_path) if "deleted-" not in f} == files
    assert store.table_info().first()["rows"] == 9801
    store.compact("t")
    assert store.read("t").count() == 9801 and store.current("delete_file").isEmpty() and store.read("t", version=before + 1).count() == 9902


def test_expired_files_and_orphans_go(spark, store, tmp_path):
    store.create_table("t", [("k", "int64")])
    first = store.write("t", spark.range(100).toDF("k"))
    store.delete("t", F.col("k") < 10)
    kept = store.replace("t", spark.range(5).toDF("k"))
    store.delete("t", F.col("k") == 0)
    store.write_files("t", spark.range(7).toDF("k"), "main")  # a write that never was committed
    held = len(data_files(tmp_path))
    store.expire(kept)
    assert len(data_files(tmp_path)) == held
    with pytest.raises(LookupError, match="expired"):
        store.read("t", version=first)
    assert store.clean(dt.datetime(2000, 1, 1)) == {"scheduled": 0, "orphans": 0}
    later = lake.now() + dt.timedelta(hours=1)
    gone = store.clean(later)
    assert gone["scheduled"] >= 2 and gone["orphans"] >= 1 and len(data_files(tmp_path)) < held
    assert store.read("t", version=kept).count() == 5 and sorted(r["k"] for r in store.read("t").collect()) == [1, 2, 3, 4]
    assert store.snapshots().first()["snapshot_id"] == kept


def writer(path, name, count):
    store = lake.Lake(None, path)
    for i in range(count):
        store.write_all({"t": [{"who": name, "n": i}], "u": [{"who": name, "n": -i}]})


def test_many_writers_lose_and_double_nothing(spark, store):
    for name in ("t", "u"):
        store.create_table(name, [("who", "int64"), ("n", "int64")])
    processes = [multiprocessing.get_context("spawn").Process(target=writer, args=(store.path, i, 50)) for i in range(8)]
    for p in processes:
        p.start()
    for p in processes:
        p.join()
    assert [p.exitcode for p in processes] == [0] * 8
    for name, sign in (("t", 1), ("u", -1)):
        assert sorted((r["who"], r["n"]) for r in store.read(name).collect()) == sorted((w, sign * n) for w in range(8) for n in range(50))
    assert store.log.last() == 402
    assert store.read("t", version=102).count() == store.read("u", version=102).count() == 100  # both or neither


def test_changes_conflict_and_appends_do_not(spark, store):
    store.create_table("t", [("k", "int64")])
    store.write("t", [{"k": 1}])
    other = lake.Lake(spark, store.path).init()
    stale = store.log.refresh().last()
    other.write("t", [{"k": 2}])
    store.write("t", [{"k": 3}])
    assert sorted(r["k"] for r in other.read("t").collect()) == [1, 2, 3]
    with pytest.raises(lake.CommitConflict):
        store.commit("change", [store.table_id("t")], "x", lambda *_: None, base=stale)
    assert store.commit("change", [99], "x", lambda *_: None, base=stale) == other.log.refresh().last()


def test_the_clusters_file_system_puts_once(spark, tmp_path):
    logs = [commitlog.CommitLog(spark, f"file:{tmp_path}/log").refresh() for _ in range(2)]
    assert all(log.folder.local is None for log in logs)
    assert logs[0].put(commitlog.Commit(0, rows={"x": [{"a": "é"}]})) and not logs[1].put(commitlog.Commit(0))
    assert logs[1].refresh().rows("x") == [{"a": "é"}] and logs[1].put(commitlog.Commit(1)) and not logs[0].put(commitlog.Commit(1))
    assert [c.number for c in logs[0].refresh().commits] == [0, 1]


def test_a_sync_that_fails_before_it_remembers_writes_nothing_twice(spark, store, monkeypatch):
    source = [(1, 1, "a"), (2, 2, "b")]

    def poll(watermark):
        rows = spark.createDataFrame(source, "id bigint, tt bigint, v string").where(F.col("tt") > int(watermark or 0))
        return rows.select("id", "v", F.lit("U").alias("__op"), F.col("tt").alias("__tt"), F.lit(dt.datetime(2026, 1, 1)).alias("__label"))

    control = replica.ControlStore(store)
    copy = replica.Replica(store, "t", ["id"], lambda: [("id", "int64"), ("v", "varchar")], poll, control=control)
    with monkeypatch.context() as broken:
        broken.setattr(control, "write", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            copy.sync(dt.datetime(2026, 1, 1))
    assert copy.sync(dt.datetime(2026, 1, 1))["commits"] == 0
    history = lake.HistoryTable(store, "t", [("id", "int64"), ("v", "varchar")], ["id"])
    assert history.log().count() == 2 and history.next_version() == 3 and control.trail("t") == ["2"]
    source.append((1, 3, "c"))
    assert copy.sync(dt.datetime(2026, 1, 2)) == {"watermark": "3", "first": False, "evolved": False, "commits": 1, "facets": {}}
    assert {r["id"]: r["v"] for r in history.state().collect()} == {1: "c", 2: "b"}


def test_images_without_an_order_are_refused(spark, store):
    history = lake.HistoryTable(store, "t", [("id", "int64"), ("v", "varchar")], ["id"]).create()
    twice = spark.createDataFrame([(1, "a", "U"), (1, "b", "U")], "id long, v string, __op string")
    with pytest.raises(ValueError, match="no order"):
        history.apply_commit(twice)
    with pytest.raises(ValueError, match="no order"):
        history.apply(twice.withColumn("version", F.lit(1)).withColumn("__tt", F.lit(dt.datetime(2026, 1, 1))))
    history.apply_commit(twice.withColumn("__place", F.when(F.col("v") == "a", 2).otherwise(1)))
    assert [r["v"] for r in history.state().collect()] == ["a"]


def test_many_sources_go_on_where_one_fails(spark, store, monkeypatch):
    sources = {"a": [(1, 1, "x"), (2, 2, "y")], "b": [(1, 5, "p")], "c": [(i, i, "q") for i in range(1, 40)]}
    broken, polls = {"b"}, []

    def replica_of(name):
        def poll(watermark):
            polls.append((name, watermark))
            if name in broken:
                raise RuntimeError("source is away")
            rows = spark.createDataFrame(sources[name], "id bigint, tt bigint, v string").where(F.col("tt") > int(watermark or 0))
            return rows.select("id", "v", F.lit("U").alias("__op"), F.col("tt").alias("__tt"), F.lit(dt.datetime(2026, 1, 1)).alias("__label"))

        return replica.Replica(store, name, ["id"], lambda: [("id", "int64"), ("v", "varchar")], poll)

    copies = [replica_of(n) for n in sources]
    now = dt.datetime(2026, 1, 2)
    write, calls = store.write_all, []
    monkeypatch.setattr(store, "write_all", lambda *a, **k: (calls.append(sorted(a[0])), write(*a, **k) if len(calls) != 2 else 1 / 0)[1])
    with pytest.raises(ZeroDivisionError):  # the run stops between its two batches
        replica.sync_all(copies, now, batch_rows=39)
    assert calls == [["c"], ["a"]]
    assert replica.sync_all(copies, now, batch_rows=39) == {"b": {"error": "RuntimeError: source is away"}, "a": {"commits": 2, "watermark": "2"}, "c": {"commits": 0, "watermark": "39"}}
    broken.clear()
    sources["a"].append((1, 9, "z"))
    last = replica.sync_all(copies, now, batch_rows=39)
    assert last == {"a": {"commits": 1, "watermark": "9"}, "b": {"commits": 1, "watermark": "5"}, "c": {"commits": 0, "watermark": "39"}} and calls[-1] == ["a", "b"]
    for name, rows in sources.items():
        history = lake.HistoryTable(store, name, [("id", "int64"), ("v", "varchar")], ["id"])
        assert history.log().count() == len(rows)
        assert {r["id"]: r["v"] for r in history.state().collect()} == {i: v for i, _, v in rows}
    assert ("c", "39") in polls and ("a", "2") in polls


def test_a_file_without_statistics_is_always_opened(spark, store, tmp_path, monkeypatch):
    store.create_table("t", [("k", "int64")])
    store.write("t", spark.range(10).toDF("k"))
    elsewhere = spark.createDataFrame([("nowhere://x/y.parquet",), (f"file://{tmp_path}/missing.parquet",)], "path string")
    assert lake.column_statistics(elsewhere, {"k": 1}).count() == 0
    monkeypatch.setattr(lake, "column_statistics", lambda files, ids: spark.createDataFrame([], "path string, column_id bigint, value_count bigint, null_count bigint, min_value string, max_value string, column_size_bytes bigint"))
    store.write("t", spark.range(10, 20).toDF("k"))
    assert [r["k"] for r in store.read("t", where=[("k", "=", 15)]).collect()] == [15] and store.read("t", where=[("k", ">", 100)]).count() == 0
    plain = commitlog.Folder(spark, str(tmp_path / "plain"))
    assert plain.local == str(tmp_path / "plain") and plain.put("a", "x") and not plain.put("a", "y") and plain.read("a") == "x"
