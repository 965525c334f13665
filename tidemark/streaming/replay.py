"""A table replayed as a stream, a stretch of time to a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import BUCKET, stretched
from tidemark.session import scratch_path

#: Rows of a file; no stretch is cut into so many files that its rows might not reach each of them.
FILE_ROWS, LEAST_ROWS = 250_000, 10_000


def replay(rows: DataFrame, order: str, files: int = 4, name: str = "replay") -> DataFrame:
    """The rows as a stream: equal stretches of a time column, written one after the other, and read one stretch to a batch.

    A file stream takes files in the order in which they were written, so the stretches arrive in order. Long stretches
    are written and read as several files each, as many for one as for the other.
    """
    spark, folder = rows.sparkSession, scratch_path(rows.sparkSession, name)
    numbered = stretched(rows.withColumn("__order", F.unix_micros(F.col(order).cast("timestamp"))), "__order", files)
    counts = {r[BUCKET]: r["n"] for r in numbered.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()} or {0: 0}
    each = max(1, min(-(-max(counts.values()) // FILE_ROWS), min(counts.values()) // LEAST_ROWS))
    for part in sorted(counts):
        some = numbered.where(F.col(BUCKET) == part).drop("__order", BUCKET)
        (some.repartition(each) if each > 1 else some.coalesce(1)).write.mode("append").parquet(folder)
    written = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
    # A batch must not reach into the next stretch; were a file missing, stretches would come in several batches.
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each if written == each * len(counts) else 1).parquet(folder)
