"""Applying a stream of changes to a lake, exactly once for each batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.acquire import staple
from tidemark.sources.lake import HistoryTable


def applied(history: HistoryTable, stream: str, batch: int) -> bool:
    """Whether the lake's log has this batch already."""
    marks = history.lake.catalog("snapshot_changes").select(F.get_json_object("commit_extra_info", "$.stream").alias("s"), F.get_json_object("commit_extra_info", "$.batch").alias("b"))
    return not marks.where((F.col("s") == stream) & (F.col("b") == str(batch))).isEmpty()


def sink(history: HistoryTable, stream: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: gives the batch's changes their versions and appends them as one snapshot.

    The snapshot names the stream and the batch. A batch that is replayed after a failure is found there and
    written no second time.
    """

    def write(batch: DataFrame, number: int) -> None:
        if applied(history, stream, number):
            return
        changes = prepare(batch) if prepare else batch
        history.apply(staple(changes, first=history.next_version()), provenance={"commit_extra_info": json.dumps({"stream": stream, "batch": number})})

    return write


def replicate(changes: DataFrame, history: HistoryTable, checkpoint: str, stream: str, prepare: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Run a stream of change records (``__op``, ``__tt`` and columns) into a history table."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink(history, stream, prepare))
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def newest(batch: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each (key, time) in a batch: an inclusive poll's boundary rows, once."""
    return batch.dropDuplicates([*keys, at])
