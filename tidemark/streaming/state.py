"""Stateful streams: pass on only what changes, and windows over event time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class ChangeFilter(StatefulProcessor):
    """Keeps each key's last values and passes rows that differ from them; one value of state for each key."""

    def __init__(self, order: list[str], values: list[str]) -> None:
        self.order, self.values = order, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("values", T.StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer: object) -> Iterator[Row]:
        state = self.last.get()
        held = before = state[0] if state else None
        whole = list(rows)
        order, values = ([whole[0].__fields__.index(c) for c in names] for names in (self.order, self.values))
        for row in sorted(whole, key=lambda r: [(False, r[c]) if r[c] is not None and r[c] == r[c] else (True,) for c in order]):
            text = repr(tuple(None if row[c] is None or row[c] != row[c] else row[c] for c in values))
            if text != held:
                yield row
            held = text
        if held != before:
            self.last.update((held,))

    def close(self) -> None:
        pass


def changes_only(stream: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A stream without the images that equal the key's last one. Needs the RocksDB state store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(*keys).transformWithState(ChangeFilter(order, values), stream.schema, "Append", "None")


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str, delay: str) -> DataFrame:
    """Sessions of each key: begin, end and rows, once the watermark has passed them."""
    window = F.session_window(at, gap)
    found = stream.withWatermark(at, delay).groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*keys, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def tumbling(stream: DataFrame, keys: list[str], at: str, width: str, delay: str) -> DataFrame:
    """Rows of each key in windows of fixed width."""
    found = stream.withWatermark(at, delay).groupBy(*keys, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*keys, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Each (key, time) once, within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([*keys, at])


class RetainedKeys(StatefulProcessor):
    """Rows of each key in the order of their times, changed ones only, and a notice when a key has been silent too long.

    A key's rows wait in state until the watermark has passed them and are then taken in order, whatever order they came
    in: when the key has rows again, or at a timer. All of a key's state is one value, and one timer is set at most, so a batch
    costs a key a few calls of state and not some for each row. Values are held as they are, under their own types.
    ``retention`` after a key's last row its state goes and an ``expired`` row asks for a resync: the next row counts as new.
    """

    def __init__(self, names: list[str], kinds: T.StructType, at: str, order: str, values: list[str], retention: dt.timedelta) -> None:
        self.names, self.kinds, self.at, self.order, self.values, self.retention = names, kinds, at, order, values, retention // dt.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = T.StructType([self.kinds[self.at], self.kinds[self.order], *(self.kinds[v] for v in self.values)])
        self.held = handle.getValueState("held", T.StructType([T.StructField("timer", T.LongType()), T.StructField("last", row), T.StructField("waiting", T.ArrayType(row))]))

    def micros(self, at: dt.datetime) -> int:
        return round(at.timestamp() * 1_000_000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer: object) -> Iterator[Row]:
        came = list(rows)
        places = [came[0].__fields__.index(c) for c in (self.at, self.order, *self.values)]
        return self.settle(key, [tuple(row[i] for i in places) for row in came], timer.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N803 (names are the caller's)
        return self.settle(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def settle(self, key: tuple, came: list[tuple], mark: int, fired: int | None) -> Iterator[Row]:
        now, row_of = mark * 1000, Row(*self.names)
        timer, last, waiting = self.held.get() or (None, None, [])
        last = tuple(last) if last is not None else None
        then = self.micros(last[0]) if last is not None else 0
        every = sorted(((self.micros(row[0]), tuple(row)) for row in (*waiting, *came)), key=lambda e: (e[0], e[1][1]))
        rest = [e for e in every if e[0] > now]
        for at, row in every[: len(every) - len(rest)]:
            if last is not None and then + self.retention <= at:
                yield row_of(*key, "expired", *last)
                last = None
            if last is None or last[2:] != row[2:]:
                yield row_of(*key, "change", *row)
            last, then = row, at
        if last is not None and then + self.retention <= now:
            yield row_of(*key, "expired", *last)
            last = None
        # The next whole millisecond at which a row that waits has been passed, or the last one is too old.
        due = [-(-at // 1000) for at in ([rest[0][0]] if rest else []) + ([then + self.retention] if last is not None else [])]
        wanted = min(due, default=None)
        if timer == fired:
            timer = None
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if wanted is None:
            self.held.clear()
        else:
            self.held.update((wanted, last, [row for _, row in rest]))

    def close(self) -> None:
        pass


def retained_changes(stream: DataFrame, keys: list[str], at: str, order: str, values: list[str], delay: str, retention: dt.timedelta) -> DataFrame:
    """keys, kind (change or expired), at, order, values: changes of each key in event time, and keys that need a resync.

    ``order`` is a whole number of 0 or more that orders rows of one time. Rows behind the watermark, which lags by
    ``delay``, are dropped by Spark and counted in the query's progress. Needs the RocksDB state store.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = stream.select(*keys, at, order, *values).schema
    out = T.StructType([*(kinds[k] for k in keys), T.StructField("kind", T.StringType()), kinds[at], kinds[order], *(kinds[v] for v in values)])
    processor = RetainedKeys(out.names, kinds, at, order, values, retention)
    return stream.withWatermark(at, delay).groupBy(*keys).transformWithState(processor, out, "Append", "EventTime")
