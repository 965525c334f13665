"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


#: Rows of an Arrow batch between the JVM and Python: texts are long, and both sides hold a batch whole.
BATCH_ROWS = 1000


def slim(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names: other columns of the input can't clash with an operator's own.

    Every operator begins here, so the session's Arrow batches are made small here, too.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs.select(*[docs[source].alias(name) for name, source in columns.items()])


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one batch hold about ``limit`` bytes at most (or one text)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


SPACE = re.compile(r"\s")


def text_spans(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Pieces of ``size`` characters or more that end after white space: no word is cut, a run without white space is one piece."""
    start = 0
    while len(text) - start > size:
        found = SPACE.search(text, start + size)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


def keep_texts(docs: DataFrame, test: Callable[[], Callable[[str | None], bool]], text: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows whose text fails. ``test()`` makes the test once a task; nothing is shuffled."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for batch in small_batches(batches, text):
            yield batch.filter(pa.array([passes(value.as_py()) for value in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
