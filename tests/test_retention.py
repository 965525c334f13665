"""Event-time order, changes and expiry of keys in a replayed stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.streaming import state

HOUR, START = dt.timedelta(hours=1), dt.datetime(2026, 1, 1)


def test_keys_expire_and_disorder_does_not_matter(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), START + i * dt.timedelta(minutes=5), rng.choice([None, 1.5, 2.5])) for i in range(60)]
    rows += [(100, "a", START + 20 * HOUR, 1.5), (101, "a", START + 20 * HOUR, 2.5), (102, "b", START + 30 * HOUR, None), (103, "z", START + 40 * HOUR, 0.0), (104, "z", START + 41 * HOUR, 0.0)]
    files = [rows[:30], rows[30:], [(200, "c", START, 9.0)]]  # the last row is behind the watermark by then
    for number, some in enumerate(files):
        rng.shuffle(some)
        spark.createDataFrame(some, "seq long, k string, at timestamp, v double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("seq long, k string, at timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    found = state.retained_changes(stream, ["k"], "at", "seq", ["v"], "2 hours", 6 * HOUR)
    query = found.writeStream.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out")
    query.awaitTermination()
    got = sorted((r["k"], r["at"], r["seq"], r["kind"], r["v"]) for r in spark.read.schema(found.schema).parquet(f"file://{tmp_path}/out").collect())
    last_mark, want = START + 39 * HOUR, []
    for key in "abcz":
        held = None
        for seq, _, at, v in sorted((r for r in rows if r[1] == key and r[2] <= last_mark), key=lambda r: (r[2], r[0])):
            if held and held[2] + 6 * HOUR <= at:
                want.append((key, held[2], held[0], "expired", held[3]))
                held = None
            if held is None or held[3] != v:
                want.append((key, at, seq, "change", v))
            held = (seq, key, at, v)
        if held and held[2] + 6 * HOUR <= last_mark:
            want.append((key, held[2], held[0], "expired", held[3]))
    key = lambda r: (*r[:4], str(r[4]))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[3] == "expired" for r in got) >= 4
