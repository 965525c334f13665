"""Token counts of documents in flat token files that have no index, by a separator scan.

A token file is a run of little-endian token ids; a document ends with an end-of-document id. Files are read
in blocks of fixed length by independent tasks, each of which finds the separators of its block in one
vectorised comparison. A block knows where its documents end but not where its first one began, nor how many
came before: a prefix scan over the blocks' separator counts and last separators, two numbers a block, gives both.

Edge cases: an empty file has no documents; documents without tokens count 0; tokens after the last separator
are a document that is not ``closed``; separators at a block's first or last place and documents longer than
a block need no care of their own. Writing: a null or empty text is a document without tokens, repeated rows
are documents of their own, and an empty table gives no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slim, small_batches
from tidemark.llm.tokens import encoder
from tidemark.session import materialize, scratch_path


def write_token_files(docs: DataFrame, folder: str, vocabulary: dict[str, str], end_id: int, dtype: str = "<u2", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode documents into flat token files under ``folder``; returns file, doc_index, doc_id of every row.

    Each task attempt writes a file under a name of its own, and the returned table, which is written before
    it is returned, names those of the attempts that counted: a task that runs again does no harm.
    """
    source = slim(docs, doc_id=doc_id, text=text)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, name, index, out = encoder(**vocabulary).encode, f"{folder}/{uuid.uuid4().hex}.tokens", 0, None
        try:
            for batch in small_batches(batches, "text"):
                if out is None:
                    fs, path = pafs.FileSystem.from_uri(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                for value in batch.column("text"):
                    ids = encode(value.as_py())
                    if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                        raise ValueError(f"id {int(ids.max())} does not fit {dtype}")
                    out.write(np.append(ids, np.uint32(end_id)).astype(dtype).tobytes())
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * rows), pa.array(np.arange(index, index + rows)), batch.column("doc_id")], ["file", "doc_index", "doc_id"])
                index += rows
        finally:
            if out is not None:
                out.close()

    return materialize(source.mapInArrow(write, f"file string, doc_index bigint, doc_id {source.schema['doc_id'].dataType.simpleString()}"), "token-manifest")


def file_blocks(files: DataFrame, dtype: str, block_tokens: int) -> DataFrame:
    """file, block, first (its first token's place), n (its tokens), from a column ``file``."""
    width = np.dtype(dtype).itemsize

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name in batch.column("file").to_pylist():
                fs, path = pafs.FileSystem.from_uri(name)
                sizes.append(fs.get_file_info(path).size // width)
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], ["file", "tokens"])

    sized = files.select("file").mapInArrow(measure, "file string, tokens bigint").where("tokens > 0")
    blocks = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / block_tokens).cast("int"))
    cut = sized.select("file", "tokens", F.explode(blocks).alias("block")).withColumn("first", F.col("block").cast("bigint") * block_tokens)
    return cut.select("file", "block", "first", F.least(F.lit(block_tokens).cast("bigint"), F.col("tokens") - F.col("first")).alias("n"))


def separators(blocks: DataFrame, end_id: int, dtype: str) -> DataFrame:
    """One row for each block: its separators' places in the file."""
    width = np.dtype(dtype).itemsize

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["file"])
                with fs.open_input_file(path) as source:
                    source.seek(row["first"] * width)
                    ids = np.frombuffer(source.read(row["n"] * width), dtype)
                ends = np.flatnonzero(ids == end_id) + row["first"]
                yield pa.RecordBatch.from_arrays([*(pa.array([row[c]], pa.string() if c == "file" else pa.int64()) for c in ("file", "block", "first", "n")), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "first", "n", "ends"])

    # A block to a task at most: what a task reads does not depend on how many files there are.
    return blocks.repartition("file", "block").mapInArrow(scan, "file string, block bigint, first bigint, n bigint, ends array<bigint>")


def count_tokens(files: DataFrame, end_id: int, dtype: str = "<u2", block_tokens: int = 4 << 20) -> DataFrame:
    """file, doc_index, start, n_tokens, closed of every document of the files named in column ``file``."""
    found = materialize(separators(file_blocks(files.distinct(), dtype, block_tokens), end_id, dtype), "separators")
    # The scan sees a count and a place of each block; its separators stay where they are until they are joined.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file", "block", F.size("ends").alias("held"), F.try_element_at("ends", F.lit(-1)).alias("last_end")).select(
        "file",
        "block",
        F.coalesce(F.sum("held").over(before), F.lit(0)).alias("index"),
        (F.coalesce(F.max("last_end").over(before), F.lit(-1)) + 1).alias("begun"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("last"),
    )
    stitched = found.join(materialize(carried, "carried"), ["file", "block"]).select("file", "first", "n", "ends", "index", "begun", "last")
    # Places where documents begin, moved up by one against the places where they end.
    starts = F.concat(F.array("begun"), F.transform("ends", lambda e: e + 1))
    open_end = F.when(F.col("last") & (F.element_at(starts, -1) < F.col("first") + F.col("n")), F.array(F.col("first") + F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    ends = F.concat("ends", open_end)
    docs = stitched.select("file", "index", F.size("ends").alias("closed"), F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size(ends)).alias("start"), ends.alias("end"))).alias("at", "doc"))
    return docs.select("file", (F.col("index") + F.col("at")).cast("bigint").alias("doc_index"), F.col("doc.start").alias("start"), (F.col("doc.end") - F.col("doc.start")).alias("n_tokens"), (F.col("at") < F.col("closed")).alias("closed"))


def document_token_counts(spark: SparkSession, docs: DataFrame, vocabulary: dict[str, str], end_id: int, dtype: str = "<u2", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, doc_index, start, n_tokens: documents written to flat token files and counted by the scan of those files."""
    folder = scratch_path(spark, "token-files")
    written = write_token_files(docs, folder, vocabulary, end_id, dtype, doc_id, text)
    counted = count_tokens(written.select("file"), end_id, dtype)
    joined = materialize(written.join(counted, ["file", "doc_index"], "full").select("doc_id", "doc_index", "start", "n_tokens", "closed"), "token-counts")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return joined
