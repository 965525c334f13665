"""Intervals, synchronisation and differences on hand fixtures, edge cases and properties."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import acquire, diff, intervals, registry, scans, ttst

T = [dt.datetime(2026, 6, 30, h) for h in (10, 11, 12, 13)]
LOG = [(1, 1, "a", "I", T[0]), (2, 2, "b", "I", T[0]), (3, 3, "c", "I", T[0]), (4, 2, "b2", "U", T[1]), (5, 2, "b3", "U", T[2]), (6, 3, "c", "D", T[3]), (7, 4, "d", "I", T[3])]
STATES = [{1: "a", 2: "b", 3: "c"}, {1: "a", 2: "b2", 3: "c"}, {1: "a", 2: "b3", 3: "c"}, {1: "a", 2: "b3", 4: "d"}]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, "seq int, id long, name string, op string, ts timestamp_ntz")


def test_backlog_replay(log):
    for when, state in zip(T, STATES, strict=True):
        assert {r["id"]: r["name"] for r in intervals.state_as_of(log, ["id"], "ts", "seq", when, "op").collect()} == state
    rows = intervals.backlog_intervals(log, ["id"], "ts", "seq", "op")
    for when, state in zip(T, STATES, strict=True):
        assert {r["id"]: r["name"] for r in intervals.as_of_version(rows, F.lit(when)).collect()} == state
    assert intervals.overlaps(rows, ["id"]).isEmpty()
    assert {r["id"]: r["name"] for r in intervals.current_state(log, ["id"], "ts", "seq", "op").collect()} == STATES[-1]


def test_properties_of_intervals_hold_for_random_logs(spark):
    rng = random.Random(0)
    rows = [(i, rng.randint(0, 8), rng.choice([None, "x", "y"]), rng.choice("IUD"), rng.randint(0, 30)) for i in range(300)]
    log = spark.createDataFrame(rows, "seq int, k int, v string, op string, tt long")
    found = intervals.backlog_intervals(log, ["k"], "tt", "seq", "op")
    kept = found.where("tt_end is null or tt_end > tt_start")
    assert intervals.overlaps(kept, ["k"]).isEmpty()
    assert found.where("tt_end is null").groupBy("k").count().where("count > 1").isEmpty()
    for at in (0, 7, 15, 30):
        direct = {}
        for seq, k, v, op, tt in sorted(rows, key=lambda r: (r[4], r[0])):
            if tt <= at:
                direct[k] = None if op == "D" else (seq, v)
        wanted = {k: x for k, x in direct.items() if x}
        assert {r["k"]: (r["seq"], r["v"]) for r in intervals.as_of_version(found, at).collect()} == wanted
        assert {r["k"]: (r["seq"], r["v"]) for r in intervals.state_as_of(log, ["k"], "tt", "seq", at, "op").collect()} == wanted


def test_labels_that_fall_back_are_refused(spark):
    snapshots = spark.createDataFrame([(1, T[0]), (2, T[2]), (3, T[1])], "snapshot_id long, snapshot_time timestamp_ntz")
    with pytest.raises(ValueError):
        intervals.version_at(snapshots, T[2])
    assert intervals.version_at(snapshots, T[1], strict=False) == 3
    assert intervals.version_at(snapshots.where("snapshot_id < 3"), T[1]) == 1
    assert intervals.version_at(snapshots.limit(0), T[1]) is None


@pytest.mark.parametrize("stretch", [None, "hour"])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_join_equals_brute_force(spark, stretch, strict):
    rng = random.Random(1)
    at = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randint(0, 600))
    left = [(i, rng.randint(0, 3), at()) for i in range(80)]
    right = [(i, rng.randint(0, 4), at()) for i in range(60)]
    joined = intervals.asof_join(spark.createDataFrame(left, "a int, k int, ts timestamp_ntz"), spark.createDataFrame(right, "b int, k int, ts timestamp_ntz"), ["k"], "ts", "ts", ["b"], strict, stretch=stretch)
    best = lambda k, t: max(((x, b) for b, q, x in right if q == k and (x < t if strict else x <= t)), default=(None, None))[1]
    assert {r["a"]: r["r_b"] for r in joined.collect()} == {a: best(k, t) for a, k, t in left}


def test_sync_closes_inserts_and_repeats_nothing(spark):
    open_ = spark.createDataFrame([(1, "a", None, 1), (2, "b", "x", 1), (3, None, None, 1), (4, "d", "x", 1)], "k int, v string, w string, tt_start long")
    stage = spark.createDataFrame([(1, "a", None, 5), (2, "b2", "x", 4), (2, "b3", "x", 5), (3, "c", None, None), (5, "e", None, 5), (None, "z", None, 5)], "k int, v string, w string, ts long")
    result = ttst.ttst_sync(open_, stage, ["k"], "ts", F.lit(9))
    rows = sorted((r["k"], r["v"], r["tt_start"], r["tt_end"] or 0, r["change"]) for r in result.collect() if r["v"] is not None)
    assert rows == [(1, "a", 1, 0, "kept"), (2, "b", 1, 5, "closed"), (2, "b3", 5, 0, "inserted"), (3, "c", 9, 0, "inserted"), (4, "d", 1, 0, "kept"), (5, "e", 5, 0, "inserted")]
    assert ttst.sync_counts(result, stage).first().asDict() == {"closed": 2, "inserted": 3, "staged": 6}
    now_open = ttst.after_sync(result).where("tt_end is null").select("k", "v", "w", "tt_start")
    again = ttst.ttst_sync(now_open, stage, ["k"], "ts", F.lit(9))
    assert again.where("change <> 'kept'").isEmpty()
    full = ttst.ttst_sync(open_, stage, ["k"], "ts", F.lit(9), on_missing="close")
    assert [(r["k"], r["tt_end"]) for r in full.where("change = 'closed' and k = 4").collect()] == [(4, 9)]
    taken = spark.createDataFrame([(2, 5)], "k int, tt_start long")
    assert ttst.ttst_sync(open_, stage, ["k"], "ts", F.lit(9), closed=taken).where("k = 2 and change = 'inserted'").first()["tt_start"] == 9
    assert ttst.ttst_sync(open_, stage.limit(0), ["k"], "ts", F.lit(9)).where("change <> 'kept'").isEmpty()


def test_sync_without_values_never_closes(spark):
    open_, stage = spark.createDataFrame([(1, 1)], "k int, tt_start long"), spark.createDataFrame([(1, 5), (2, 5)], "k int, ts long")
    assert sorted((r["k"], r["change"]) for r in ttst.ttst_sync(open_, stage, ["k"], "ts", F.lit(9)).collect()) == [(1, "kept"), (2, "inserted")]


def test_outward_projection_is_idempotent(spark):
    snapshots = spark.createDataFrame([(i, T[i - 1]) for i in range(1, 5)], "snapshot_id long, snapshot_time timestamp_ntz")
    empty = spark.createDataFrame([], "id long, name string, tt_start long, tt_end long, tt_start_ts timestamp_ntz, tt_end_ts timestamp_ntz")
    first = spark.createDataFrame([(1, "a", 1, None), (2, "b", 1, None), (3, "c", 1, None)], "id long, name string, begin_snapshot long, end_snapshot long")
    target = ttst.sync_outward(first, snapshots, empty, ["id"])
    assert target.where("tt_end is null").count() == 3
    later = spark.createDataFrame([(1, "a", 1, None), (2, "b", 1, 2), (2, "b2", 2, None), (3, "c", 1, 3), (4, "d", 3, None)], "id long, name string, begin_snapshot long, end_snapshot long")
    after = ttst.sync_outward(later, snapshots, target, ["id"])
    rows = sorted((r["id"], r["name"], r["tt_start"], r["tt_end"]) for r in after.where("tt_end is not null").collect())
    assert rows == [(2, "b", 1, 2), (3, "c", 1, 3)] and after.count() == 5
    again = ttst.sync_outward(later, snapshots, after, ["id"])
    assert sorted(map(str, again.collect())) == sorted(map(str, after.collect()))
    assert {r["id"]: r["name"] for r in intervals.as_of_version(again, 1).collect()} == {1: "a", 2: "b", 3: "c"}


def test_interning_a_catalog(spark):
    schema = "resource_id string, updated_at timestamp_ntz, name string, columns_field_name array<string>, columns_datatype array<string>, columns_name array<string>, columns_description array<string>"
    scrape = spark.createDataFrame([("r1", T[1], "one", ["a", "b"], ["Text", "Number"], ["A", "B"], [None]), ("r1", T[0], "old", ["z"], ["Text"], ["Z"], ["z"]), ("r2", T[1], "two", [], [], [], [])], schema)
    resources = spark.createDataFrame([("r1", "one", T[0]), ("r3", "three", T[0])], "resource_id string, name string, tt_start timestamp_ntz")
    columns = spark.createDataFrame([("r1", "a", 1, "Text", "A", None, T[0]), ("r1", "gone", 2, "Text", "G", None, T[0]), ("r3", "c", 1, "Text", "C", None, T[0])], "resource_id string, field_name string, ordinal int, datatype string, display_name string, description string, tt_start timestamp_ntz")
    for incremental in (False, True):
        r, c = ttst.intern_catalog(scrape, resources, columns, F.lit(T[3]), ["name"], incremental)
        state = {(x["resource_id"], x["change"]) for x in r.collect()}
        assert state == {("r1", "kept"), ("r2", "inserted"), ("r3", "kept" if incremental else "closed")}
        found = {(x["resource_id"], x["field_name"], x["change"]) for x in c.collect()}
        assert found == {("r1", "a", "kept"), ("r1", "b", "inserted"), ("r1", "gone", "closed"), ("r3", "c", "kept" if incremental else "closed")}


def test_upsert_can_treat_empty_as_null(spark):
    old, new = spark.createDataFrame([(1, None)], "k int, v string"), spark.createDataFrame([(1, "")], "k int, v string")
    assert ttst.upsert(old, new, ["k"], ["v"]).first()["action"] == "update"
    assert ttst.upsert(old, new, ["k"], ["v"], empty_is_null=True).first()["action"] == "keep"


def test_differences(spark):
    before = spark.createDataFrame([("person", "id"), ("person", "name"), ("gone", "x"), ("gone", "x"), (None, None)], "t string, c string")
    after = spark.createDataFrame([("person", "id"), ("person", "name"), ("person", "age"), ("org", "title"), (None, None)], "t string, c string")
    found = diff.except_diff(after, before)
    assert sorted(map(tuple, found.collect())) == [("gone", "x", "removed"), ("org", "title", "added"), ("person", "age", "added")]
    assert sorted(map(str, diff.apply_diff(before, found).distinct().collect())) == sorted(map(str, after.distinct().collect()))
    captures = after.withColumn("captured_at", F.lit(2)).unionByName(before.withColumn("captured_at", F.lit(1)))
    assert diff.capture_diff(captures, 1, 2).count() == 3


def test_prefix_scans_equal_windows(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1000), i, rng.choice([None, rng.randint(0, 99)])) for i in range(500)]
    df = spark.createDataFrame(rows, "o long, i int, v int")
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    high, total, expected = None, 0, {}
    for n, (_, i, v) in enumerate(ordered):
        high = v if high is None else high if v is None else max(high, v)
        total += 1
        expected[i] = (high, total, ordered[n - 1][2] if n else None)
    a = {r["i"]: r["m"] for r in scans.running_max(df, "o", "v", "m", ["i"], 7).collect()}
    b = {r["i"]: r["n"] for r in scans.row_numbers(df, "o", "n", ["i"], 7).collect()}
    c = {r["i"]: r["prev_v"] for r in scans.previous(df, "o", ["v"], tie=["i"], buckets=7).collect()}
    assert {i: (a[i], b[i], c[i]) for i in expected} == expected
    assert scans.running_max(df.limit(0), "o", "v", "m").count() == 0


# Acquisition


def test_user_column_polls(spark):
    rows = spark.createDataFrame([(1, "a", T[0], False), (2, "b2", T[1], False), (3, "c", T[0], True), (4, "d", T[2], None)], "id int, v string, at timestamp_ntz, gone boolean")
    driver = acquire.UserColumnDriver("at", ["id"], "gone")
    assert {(r["id"], r["__op"]) for r in driver.poll(rows, None).collect()} == {(1, "U"), (2, "U"), (3, "D"), (4, "U")}
    assert {r["id"] for r in driver.poll(rows, T[1]).collect()} == {4}
    driver.inclusive = True
    assert {r["id"] for r in driver.poll(rows, T[1]).collect()} == {2, 4}
    assert acquire.next_watermark(driver.poll(rows, None), None) == T[2]
    assert acquire.next_watermark(driver.poll(rows.limit(0), None), T[1]) == T[1]


def test_change_tracking_is_net_and_can_expire(spark):
    changes = spark.createDataFrame([(1, 1, "I"), (2, 1, "I"), (2, 2, "U"), (3, 1, "I"), (3, 3, "D")], "id int, version long, op string")
    live = spark.createDataFrame([(1, "a"), (2, "b2")], "id int, v string")
    driver = acquire.ChangeTrackingDriver(["id"], epoch="2026-01-01 00:00:00")
    found = {r["id"]: (r["__op"], r["v"], r["__label"]) for r in driver.poll(changes, live, 1).collect()}
    assert found == {2: ("U", "b2", dt.datetime(2026, 1, 1, 0, 0, 2)), 3: ("D", None, dt.datetime(2026, 1, 1, 0, 0, 3))}
    with pytest.raises(acquire.ResyncRequired):
        driver.poll(changes, live, 1, oldest=2)


def test_capture_logs_keep_every_change_and_order(spark):
    log = spark.createDataFrame([(1, 0, 2, T[1]), (2, 0, 3, T[1]), (2, 1, 4, T[0]), (3, 0, 1, T[2])], "lsn long, seq int, code int, wall timestamp_ntz")
    found = [(r["lsn"], r["__op"], r["__label"]) for r in acquire.CDCDriver(["lsn"], seq="seq", op="code").poll(log, None).orderBy("lsn").collect()]
    assert found == [(1, "I", T[1]), (2, "U", T[1]), (3, "D", T[2])]


def test_staple_numbers_times_in_order(spark, log):
    found = acquire.staple(acquire.BacklogDriver("ts", ["id"], "op").poll(log, None), first=5)
    assert sorted({(r["__tt"], r["version"]) for r in found.collect()}) == list(zip(T, range(5, 9), strict=True))


def test_registry_series(spark):
    probes = spark.createDataFrame([("o", 1, 7, "x"), ("o", 2, 7, "x"), ("o", 3, 7, "y"), ("o", 4, 8, "y"), ("o", 5, None, "y"), ("p", 1, 1, None), ("p", 2, 1, "z"), ("q", 1, 1, "z")], "n string, at int, object_id int, modify_date string")
    found = {(r["n"], r["at"], r["status"]) for r in registry.schema_anomalies(probes, ["n"], "at").collect()}
    assert found == {("o", 1, "initial"), ("o", 3, "altered"), ("o", 4, "recreated"), ("p", 1, "initial"), ("q", 1, "initial")}
    assert {r["n"] for r in registry.dropped_objects(probes, ["n"], "at").collect()} == {"p", "q"}
    env = spark.createDataFrame([(T[0], T[1])], "local_utc timestamp_ntz, remote_utc timestamp_ntz")
    assert registry.measure_env(env).first()["skew_seconds"] == 3600
    assert registry.fingerprint([("a", "int")]) == spark.createDataFrame([("t", "a", "int", 1)], "t string, member_name string, data_type string, ordinal int").transform(lambda d: registry.fingerprints(d, ["t"])).first()["fingerprint"]


def test_pruned_capture_reads_what_is_dirty(spark):
    held = spark.createDataFrame([("a", 1), ("b", 2)], "object_name string, object_id int")
    now = spark.createDataFrame([("a", 1), ("b", 9), ("c", 3)], "object_name string, object_id int")
    assert registry.pruned_capture(now, held, lambda names: names) == ["b", "c"]


def test_a_far_value_holds_up_no_stretch(spark):
    rows = [(i, i) for i in range(2000)] + [(99_999_999, 2000)]
    dealt = scans.stretched(spark.createDataFrame(rows, "o bigint, i bigint"), "o", 10)
    held = [r["count"] for r in dealt.groupBy(scans.BUCKET).count().collect()]
    assert len(held) == 10 and max(held) < 2 * len(rows) / 10
    assert {r["n"] for r in scans.row_numbers(spark.createDataFrame(rows, "o bigint, i bigint"), "o", "n").collect()} == set(range(1, 2002))
