"""Token ids in files of directly addressable codes: any token is read without decoding others.

An id is cut into chunks of eight bits, the lowest first. Level 0 has one chunk of every id; a bitmap beside it says
which ids go on, and level 1 has the next chunk of those alone, and so on. The place of an id's next chunk is the
number of set bits before it, which a directory of counts, one every 512 bits, gives at once. Ids are as long as they
need to be, and a range of tokens is a range of bytes on every level.

A file holds whole documents in the order of their ids, about ``file_ids`` tokens, and a table of its documents. Tasks
take ranges of document ids, encode and write; what is read back is read range by range from the files. Files are named
anew by every attempt, and only those of attempts that counted are in the returned table.

Edge cases: a null or empty text is the end id alone; null document ids come first; rows of equal ids are ordered by a
hash of their texts, and equal rows are documents of their own; a document longer than ``file_ids`` has a file of
its own and is read a stretch at a time; an empty table gives no file and no rows. Other columns are not read.
"""

from __future__ import annotations

import io
import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slim, small_batches
from tidemark.session import discard, materialize, scratch_path

MAGIC = b"TDAC"
#: Bits to an entry of the rank directory.
RANK_BITS = 512

# Encoding

#: Texts of these characters are the same in composed form, and their lower case goes character by character.
SAFE = "\t\n\r" + "".join(map(chr, range(0x20, 0x7F))) + "".join(chr(c) for c in range(0xA1, 0x180) if c not in (0xAD, 0x130)) + "–—‘’“”…€"


def of_class(kind: str) -> str:
    return "".join(re.escape(c) for c in SAFE if unicodedata.category(c)[0] == kind)


PLAIN = re.compile(f"[{re.escape(SAFE)}]*")
#: The vocabulary's own rule of words, for these characters.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of_class('L')}]+|[{of_class('N')}]|[^\\s{of_class('L')}{of_class('N')}]+")
LONG_TEXT = 1 << 20


class WordEncoder(dict):
    """Ids of texts by a vocabulary file whose words are encoded each on its own; words met before are looked up."""

    def __init__(self, vocabulary: str, most: int = 1_200_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(vocabulary), most
        self.tokenizer.encode_special_tokens = True

    def slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = self.slow(word)
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; long ones are cut before white space, where words end in any case."""
        parts, at = [], 0
        while text and at < len(text):
            end = text.find(" ", at + LONG_TEXT)
            end = len(text) if end < 0 else end
            part = text[at:end]
            if PLAIN.fullmatch(part):
                parts.extend(map(self.__getitem__, WORDS.findall(part.lower())))
            else:
                parts.append(self.slow(part))
            at = end
        return np.frombuffer(b"".join(parts), "<u4")


@lru_cache(maxsize=2)
def word_encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)


# Files


def encode_file(ids: np.ndarray, table: pa.RecordBatch) -> bytes:
    """A file of ``ids`` and its table of documents."""
    levels, sections = [], []

    def put(data: bytes) -> list[int]:
        place = [sum(map(len, sections)), len(data)]
        sections.append(data)
        return place

    left = ids.astype(np.uint32)
    while True:
        more = left > 0xFF
        level = {"count": len(left), "chunks": put(left.astype(np.uint8).tobytes())}
        levels.append(level)
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint64)
        level["bitmap"] = put(bits.tobytes())
        level["ranks"] = put(np.append(np.uint64(0), np.cumsum(counts)[:-1]).astype("<u8").tobytes())
        left = left[more] >> np.uint32(8)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    head = json.dumps({"levels": levels, "documents": put(sink.getvalue())}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


class TokenFile:
    """Random access to a file of ids; ``source`` reads bytes at a place."""

    def __init__(self, source) -> None:
        self.source = source
        magic, size = struct.unpack("<4sI", source.read_at(8, 0))
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.head, self.base = json.loads(source.read_at(size, 8)), 8 + size
        self.count = self.head["levels"][0]["count"]

    def read(self, section: list[int], start: int, size: int) -> bytes:
        return self.source.read_at(min(size, section[1] - start), self.base + section[0] + start)

    def documents(self) -> pa.Table:
        return pa.ipc.open_stream(self.read(self.head["documents"], 0, self.head["documents"][1])).read_all()

    def flags(self, level: dict, start: int, n: int) -> np.ndarray:
        held = np.frombuffer(self.read(level["bitmap"], start // 8, (start + n + 7) // 8 - start // 8), np.uint8)
        return np.unpackbits(held, bitorder="little")[start % 8 : start % 8 + n].astype(bool)

    def rank(self, level: dict, place: int) -> int:
        """Set bits before ``place``."""
        block = place // RANK_BITS
        if block * 8 >= level["ranks"][1]:  # the place after the last one, at a block's end
            block -= 1
        known = int(np.frombuffer(self.read(level["ranks"], 8 * block, 8), "<u8")[0])
        return known + int(self.flags(level, block * RANK_BITS, place - block * RANK_BITS).sum())

    def slice(self, start: int, n: int) -> np.ndarray:
        """Ids from place ``start``: on each level the chunks of that range and no others."""
        if not 0 <= start <= start + n <= self.count:
            raise IndexError(f"{start} and {n} of {self.count} ids")
        ids, open_at = np.zeros(n, np.uint32), np.arange(n)
        for shift, level in enumerate(self.head["levels"]):
            if not len(open_at):
                break
            chunks = np.frombuffer(self.read(level["chunks"], start, len(open_at)), np.uint8)
            ids[open_at] |= chunks.astype(np.uint32) << np.uint32(8 * shift)
            if "bitmap" not in level:
                break
            more = self.flags(level, start, len(open_at))
            start, open_at = self.rank(level, start), open_at[more]
        return ids

    def __getitem__(self, place: int) -> int:
        return int(self.slice(place, 1)[0])


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, file_ids: int = 8 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, number, file, n_ids of the files written, which are in the order of part and number."""
    source = slim(docs, doc_id=doc_id, text=text)
    ordered = source.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    # The place cuts ranges within one id or one text, too, so that none is too much for a task.
    ordered = ordered.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_encoder(vocabulary).encode, TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        lengths: list[int] = []
        size = number = 0

        def out() -> pa.RecordBatch:
            nonlocal size, number
            n = np.array(lengths, np.int64)
            table = pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(np.cumsum(n) - n), pa.array(n)], ["doc_id", "start", "n_tokens"])
            file = f"{folder}/{part:08d}-{number:06d}-{uuid.uuid4().hex}.dac"
            fs, path = pafs.FileSystem.from_uri(file)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as sink:
                sink.write(encode_file(np.concatenate(held), table))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([file]), pa.array([size], pa.int64())], ["part", "number", "file", "n_ids"])
            held.clear(), names.clear(), lengths.clear()
            size, number = 0, number + 1
            return row

        for batch in small_batches(batches, "text"):
            first = 0
            for i, value in enumerate(batch.column("text")):
                ids = np.append(encode(value.as_py()), np.uint32(end_id)).astype(np.uint32)
                if lengths and size + len(ids) > file_ids:
                    names.append(batch.column("doc_id").slice(first, i - first))
                    first = i
                    yield out()
                held.append(ids)
                lengths.append(len(ids))
                size += len(ids)
            names.append(batch.column("doc_id").slice(first))
        if lengths:
            yield out()

    return materialize(ordered.mapInArrow(write, "part bigint, number bigint, file string, n_ids bigint"), "token-files")


def read_documents(files: DataFrame, id_type: str = "bigint", stretch: int = 4 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files named in the table of files."""
    earlier = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = materialize(files.select("file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before")), "placed")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["file"])
                with fs.open_input_file(path) as source:
                    tokens = TokenFile(source)
                    for some in tokens.documents().to_batches(max_chunksize=10_000):
                        starts, lengths = some.column("start").to_numpy(), some.column("n_tokens").to_numpy()
                        sums = np.zeros(len(starts), np.int64)
                        i = 0
                        while i < len(starts):
                            # Documents that together fill a stretch are read at once, a longer one in several.
                            end = max(i + 1, int(np.searchsorted(starts + lengths, starts[i] + stretch, "right")))
                            total = int(starts[end - 1] + lengths[end - 1] - starts[i])
                            if end > i + 1 or total <= stretch:
                                ids = tokens.slice(int(starts[i]), total).astype("<u4")
                                for k in range(i, end):
                                    at = int(starts[k] - starts[i])
                                    sums[k] = zlib.crc32(ids[at : at + int(lengths[k])].tobytes())
                            else:
                                crc = 0
                                for at in range(0, total, stretch):
                                    crc = zlib.crc32(tokens.slice(int(starts[i]) + at, min(stretch, total - at)).astype("<u4").tobytes(), crc)
                                sums[i] = crc
                            i = end
                        yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(starts + row["before"]), pa.array(lengths), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A file to a task: the number is given, as adaptive execution would join tasks by the little that their rows hold.
    return placed.repartition(max(1, placed.count()), "file").mapInArrow(read, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_round_trip(docs: DataFrame, vocabulary: str, end_id: int, file_ids: int = 8 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: documents written to files of directly addressable codes and read back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "dac-files")
    files = write_token_files(docs, folder, vocabulary, end_id, file_ids, doc_id, text)
    found = materialize(read_documents(files, docs.schema[doc_id].dataType.simpleString()), "token-documents")
    discard(files)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found
