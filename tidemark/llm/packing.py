"""Harmonic packing of token sequences.

A document gives whole sequences of ``capacity`` ids, and what is left of it falls into a class by its length:
class ``k`` has the lengths from ``capacity / (k + 1)``, exclusive, to ``capacity / k``, and a bin of it takes
``k`` pieces, whatever they are. The last class, of pieces of ``capacity / CLASSES`` or less, fills the room that
full bins leave, cut where room ends; where there is more of it than room, it makes sequences of its own. While
bins with room wait for more than ``reserve`` ids, pieces of any class are cut to fill them, so nothing is padded.

Workers are the tasks that read and encode documents: each fills bins of its own in the order of its rows, with
bounded memory and without a shuffle, whatever the share of a source or key. A task that runs again meets the same
rows in the same order, so it gives the same sequences; read in other partitions, the table gives other sequences
of the same ids. At the end of a task, bins that lack pieces are used up as filling, and the less than ``capacity``
ids that remain make sequences of powers of two, at most ten for 1024.

Edge cases: a null or empty text is a document of the end token alone; an empty table gives an empty
result; repeated rows are packed once each; rows with a null id take part; other columns are not read; very long
texts are cut while they are packed and no row holds more than ``capacity`` ids.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import slim, small_batches
from tidemark.llm.tokens import encoder

#: Classes of lengths.
CLASSES = 32
#: A piece: its document, its first id's place there, its ids, and the document's number of ids.
Piece = tuple[object, int, np.ndarray, int]


class Packer:
    """Fills bins; ``done`` has the sequences that are complete, as lists of pieces."""

    def __init__(self, capacity: int, reserve: int | None = None) -> None:
        self.capacity, self.reserve = capacity, 64 * capacity if reserve is None else reserve
        self.bins: dict[int, list[Piece]] = {}
        self.waiting: deque[tuple[list[Piece], int]] = deque()  # full bins, and the room that each has left
        self.filler: deque[Piece] = deque()
        self.room = self.held = 0  # ids that waiting bins lack, and that the filler has
        self.done: list[list[Piece]] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while total - at >= self.capacity:
            self.done.append([(doc, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        if at < total:
            self.place((doc, at, ids[at:].copy() if at else ids, total))  # a view would hold the whole document

    def place(self, piece: Piece) -> None:
        number = self.capacity // len(piece[2])
        if number >= CLASSES or self.room > self.reserve:
            self.fill_with(piece)
            return
        pieces = self.bins.setdefault(number, [])
        pieces.append(piece)
        if len(pieces) == number:
            self.close(self.bins.pop(number))

    def close(self, pieces: list[Piece]) -> None:
        left = self.capacity - sum(len(p[2]) for p in pieces)
        if not left:
            self.done.append(pieces)
            return
        self.waiting.append((pieces, left))
        self.room += left
        self.fill()

    def fill_with(self, piece: Piece) -> None:
        self.filler.append(piece)
        self.held += len(piece[2])
        self.fill()

    def fill(self) -> None:
        """Fill the waiting bins; without any, make sequences of filling alone."""
        while self.filler and (self.waiting or self.held >= self.capacity):
            pieces, left = self.waiting.popleft() if self.waiting else ([], 0)
            taken = self.take(left or self.capacity)
            pieces, short = pieces + taken, (left or self.capacity) - sum(len(p[2]) for p in taken)
            self.room -= left - short if left else 0
            if short:
                self.waiting.appendleft((pieces, short))
            else:
                self.done.append(pieces)

    def take(self, wanted: int) -> list[Piece]:
        """Up to ``wanted`` ids of the filling; the last piece is cut."""
        out = []
        while wanted and self.filler:
            doc, start, ids, total = self.filler.popleft()
            if len(ids) > wanted:
                self.filler.appendleft((doc, start + wanted, ids[wanted:], total))
                ids = ids[:wanted]
            out.append((doc, start, ids, total))
            wanted -= len(ids)
            self.held -= len(ids)
        return out

    def finish(self) -> None:
        for number in sorted(self.bins):
            for piece in self.bins.pop(number):
                self.fill_with(piece)
        while self.waiting:
            pieces, left = self.waiting.pop()
            self.room -= left
            for piece in pieces:
                self.fill_with(piece)
        for bit in reversed(range(self.capacity.bit_length())):
            if self.held >> bit & 1:
                self.done.append(self.take(1 << bit))


def harmonic_pack(docs: DataFrame, vocabulary: dict[str, str], capacity: int = 1024, end_id: int = 0, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, (ids), sequence_id and offset of every piece of every document."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    source = slim(docs, doc_id=doc_id, text=text)
    id_type = source.schema["doc_id"].dataType.simpleString()
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in numbers) + (", ids array<int>" if with_ids else "")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, made = encoder(**vocabulary).encode, Packer(capacity), 0
        first = TaskContext.get().partitionId() << 33
        kind = None

        def rows() -> pa.RecordBatch:
            nonlocal made
            docs, values, ids = [], [], []
            for pieces in packer.done:
                at = 0
                for doc, start, piece, total in pieces:
                    docs.append(doc)
                    values.append((start, len(piece), zlib.crc32(piece.tobytes()), total, first + made, at))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
                    at += len(piece)
                made += 1
            packer.done.clear()
            table = np.array(values, np.int64).reshape(-1, len(numbers))
            columns = [pa.array(docs, kind), *(pa.array(table[:, i]) for i in range(len(numbers)))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))] if with_ids else columns, ["doc_id", *numbers, "ids"] if with_ids else ["doc_id", *numbers])

        for batch in small_batches(batches, "text"):
            kind = batch.column("doc_id").type
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc, np.append(encode(value.as_py()), np.uint32(end_id)).astype("<u4"))
                if len(packer.done) >= 512:
                    yield rows()
        packer.finish()
        if packer.done:
            yield rows()

    return source.mapInArrow(pack, schema)
