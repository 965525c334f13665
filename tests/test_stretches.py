"""Intervals of a hot key, cut into stretches, against the plain window."""

import datetime as dt
import random

from tidemark.operators import intervals


def test_stretches_change_nothing(spark):
    rng = random.Random(5)
    start = dt.datetime(2026, 1, 1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "cold", None]), rng.randrange(0, 4000), rng.choice("IUD")) for i in range(900)]
    log = spark.createDataFrame([(*r, start + dt.timedelta(minutes=r[2])) for r in rows] + [(900, "once", 7, "I", start), (901, "hot", None, "U", None)], "seq int, k string, n int, op string, at timestamp_ntz").repartition(3)
    for tt, stretch in (("at", "hour"), ("at", "day"), ("n", 100), ("n", 7)):
        for op in (None, "op"):
            plain, cut = (sorted(map(str, intervals.backlog_intervals(log, ["k"], tt, "seq", op, s).select("seq", "k", "op", "tt_start", "tt_end").collect())) for s in (None, stretch))
            assert plain == cut and len(plain) > 500
