"""One poll-and-apply cycle of a replicated table, and the stores that remember where it stood."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.acquire import staple
from tidemark.operators.essence import capture_essence
from tidemark.operators.registry import fingerprint
from tidemark.session import discard, materialize
from tidemark.sources.lake import HistoryTable, Lake


@dataclass
class ControlStore:
    """Watermark, schema fingerprint and time of each table's last sync: appended to, the latest row counts."""

    lake: Lake
    name: str = "sync_state"

    COLUMNS = (("target", "varchar"), ("watermark", "varchar"), ("fingerprint", "varchar"), ("last_sync", "timestamp"), ("seq", "int64"))

    def table(self) -> str:
        try:
            self.lake.table_id(self.name)
        except LookupError:
            self.lake.create_table(self.name, list(self.COLUMNS))
        return self.name

    def read(self, target: str) -> dict | None:
        rows = self.lake.read(self.table()).where(F.col("target") == target)
        found = rows.orderBy(F.desc("seq")).first()  # top one, not a sort
        return None if found is None else found.asDict()

    def write(self, target: str, watermark: object, mark: str, when: object) -> None:
        last = self.read(target)
        row = (target, None if watermark is None else str(watermark), mark, when, 1 if last is None else last["seq"] + 1)
        self.lake.write(self.table(), self.lake.spark.createDataFrame([row], "target string, watermark string, fingerprint string, last_sync timestamp_ntz, seq bigint"))

    def trail(self, target: str) -> list[str | None]:
        return [r["watermark"] for r in self.lake.read(self.table()).where(F.col("target") == target).orderBy("seq").collect()]


@dataclass
class Replica:
    """Keeps one table of a source as a history in a lake.

    ``columns()`` gives the source's present (name, lake type) list, ``poll(watermark)`` its change records
    (``__op``, ``__tt`` and the columns) after a watermark, and each facet a frame to be captured beside them.
    """

    lake: Lake
    target: str
    keys: list[str]
    columns: Callable[[], list[tuple[str, str]]]
    poll: Callable[[str | None], DataFrame]
    facets: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    control: ControlStore | None = None

    def sync(self, now: object) -> dict[str, object]:
        """Read the schema, widen the target, apply what is new as one write, capture facets, remember.

        The write names the target and the watermark that it reaches, so one that counted is never made again, wherever
        a later step fails: the next poll begins after it.
        """
        control = self.control or ControlStore(self.lake)
        found = self.columns()
        mark, last = fingerprint(found), control.read(self.target)
        history = HistoryTable(self.lake, self.target, found, self.keys).create(now)
        # Read once: what is stapled, written and counted is one poll, however the source grows meanwhile.
        before = self.reached() or (last and last["watermark"])
        changes = materialize(self.poll(before), "poll")
        upto = changes.agg(F.max("__tt").cast("string")).first()[0]
        watermark = upto if upto is not None else before
        applied = history.apply(staple(changes, first=history.next_version()), now, marks({self.target: watermark}))
        discard(changes)
        captured = {name: capture_essence(self.lake, f"{self.target}_{name}", read(), now) for name, read in self.facets.items()}
        control.write(self.target, watermark, mark, now)
        return {"watermark": watermark, "first": last is None, "evolved": last is not None and last["fingerprint"] != mark, "commits": applied, "facets": captured}

    def reached(self) -> str | None:
        """The watermark of the last write to the target, from the lake's own log."""
        held = F.from_json(F.get_json_object("commit_extra_info", "$.watermarks"), "map<string,string>")[self.target]
        found = self.lake.catalog("snapshot_changes").select("snapshot_id", held.alias("watermark")).where("watermark is not null")
        return found.agg(F.max_by("watermark", "snapshot_id")).first()[0]

    def define(self, now: object) -> HistoryTable:
        """The target with all columns that the source has now."""
        return HistoryTable(self.lake, self.target, self.columns(), self.keys).create(now)


def marks(watermarks: dict[str, str | None]) -> dict[str, str]:
    """What a commit says of the watermarks that it reaches."""
    return {"commit_extra_info": json.dumps({"watermarks": watermarks})}


@dataclass
class Polled:
    """One source's new changes: what a batch writes of it."""

    replica: Replica
    history: HistoryTable
    changes: DataFrame
    rows: int
    watermark: str | None


def sync_all(replicas: list[Replica], now: object, batch_rows: int = 1_000_000, threads: int = 4) -> dict[str, dict]:
    """Sync many sources into one lake; returns what became of each target: commits and watermark, or an error.

    Sources are polled side by side, each from its own watermark. By the rows found, small ones are dealt into batches of
    about ``batch_rows`` and large ones stand alone; a batch is one commit of all its tables with their watermarks, so a run
    that stops midway leaves whole batches, and the next one goes on from there. A source that fails is left out.
    """
    results: dict[str, dict] = {}

    def attempt(replica: Replica, step: Callable) -> object:
        try:
            return step()
        except Exception as error:  # kept apart: the others go on, and the caller sees it
            results[replica.target] = {"error": f"{type(error).__name__}: {error}"}
            return None

    # Definitions one by one, as each is a commit; polls side by side.
    defined = [(r, h) for r in replicas if (h := attempt(r, lambda r=r: r.define(now))) is not None]

    def poll(replica: Replica, history: HistoryTable) -> Polled:
        before = replica.reached()
        changes = materialize(replica.poll(before), "poll")
        count, upto = changes.agg(F.count(F.lit(1)), F.max("__tt").cast("string")).first()
        return Polled(replica, history, changes, count, before if upto is None else upto)

    with ThreadPoolExecutor(threads) as pool:
        polled = [p for p in pool.map(lambda d: attempt(d[0], lambda: poll(*d)), defined) if p is not None]
    for batch in dealt(polled, batch_rows):
        rows, counts = {}, {}
        for source in batch:
            fresh = attempt(source.replica, lambda s=source: s.history.fresh(staple(s.changes, first=s.history.next_version())))
            if fresh is not None:
                counts[source.replica.target] = fresh[1]
                if fresh[1]:
                    rows[source.replica.target] = fresh[0]
        written = [s for s in batch if s.replica.target in counts]
        if rows:
            batch[0].replica.lake.write_all(rows, when=now, provenance=marks({s.replica.target: s.watermark for s in written}))
        for source in written:
            results[source.replica.target] = {"commits": counts[source.replica.target], "watermark": source.watermark}
        for source in batch:
            discard(source.changes)
    return results


def dealt(polled: list[Polled], most: int) -> list[list[Polled]]:
    """Batches of about ``most`` rows, the largest sources first."""
    batches: list[tuple[int, list[Polled]]] = []
    for source in sorted(polled, key=lambda s: -s.rows):
        at = next((i for i, (held, _) in enumerate(batches) if held + source.rows <= most), None)
        if at is None:
            batches.append((source.rows, [source]))
        else:
            batches[at] = (batches[at][0] + source.rows, [*batches[at][1], source])
    return [b for _, b in batches]
