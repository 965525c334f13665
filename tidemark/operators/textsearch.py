"""Full-text search over tables: an inverted index in place of triggers and virtual tables."""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.intervals import latest
from tidemark.session import discard, materialize, sparing
from tidemark.sources.lake import Lake, lake_type

SEPARATORS = r"[^a-z0-9\x80-￿]+"
#: A character of a word, in either case (patterns that ignore case do so for A-Z alone), and no half of a pair.
INSIDE = r"[A-Za-z0-9\x80-\uD7FF\uE000-\uFFFF]"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Postings in a file of an index, and in a batch that leaves Python.
RANGE_ROWS, BATCH_ROWS = 2_000_000, 50_000
#: Rows and words of a chunk, from which a task makes blocks of postings; words of a block, unless one row has more: ranges hold
#: like numbers of blocks, so frequent words are cut small.
CHUNK_ROWS, CHUNK_WORDS, BLOCK_WORDS = 4096, 2_000_000, 256
#: Chunks up to which the bits that tell their outdated rows go to every task.
OUTDATED_ROWS = 100_000
BLOCKS = [("term", "varchar"), ("field", "varchar"), ("chunk", "int64"), ("n", "int64"), ("packed", "binary")]



def terms(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters and digits."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, SEPARATORS), lambda t: t != "")


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf: how often each term is in each row. Counts are added up per row before anything is shuffled."""
    return docs.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def search(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, hits: rows that have every word of the query, with how often they have any. A scan that needs no index.

    Words are counted where they stand, so no text is cut into all of its words.
    """
    wanted = sorted({t for t in query.lower().split() if t})
    if not wanted:
        return docs.select(key, F.lit(0).cast("bigint").alias("hits"))
    if any(words_of(t) != [t] for t in wanted):  # no word of a text has a separator in it
        return docs.select(key, F.lit(0).cast("bigint").alias("hits")).where(F.lit(False))
    counts = [F.regexp_count(F.col(text), F.lit(f"(?i)(?<!{INSIDE}){re.escape(t)}(?!{INSIDE})")) for t in wanted]
    found = docs.select(key, F.array(*counts).alias("counts")).where(F.forall("counts", lambda n: n > 0))
    return found.select(key, F.aggregate("counts", F.lit(0).cast("bigint"), lambda total, n: total + n).alias("hits"))


def search_index(index: DataFrame, key: str, query: str) -> DataFrame:
    """The same answer from an :func:`inverted_index`."""
    wanted = sorted({t for t in query.lower().split() if t})
    found = index.where(F.col("term").isin(*wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("__terms"), F.sum("tf").alias("hits"))
    return found.where(F.col("__terms") == len(wanted)).drop("__terms")


# A stored index


class TextIndex:
    """A full-text index kept in a lake: postings with positions, in files that hold a range of terms each.

    Rows that a task takes in together are a chunk. A block is the postings of one term in one chunk, their number and one
    binary of row numbers, counts and positions, so a posting costs a few bytes where it is written, sorted and kept.
    The table of rows tells which key and version a row number of a chunk stands for; only what it names counts.

    A search opens the files whose least and greatest term admit its words, and no others. Upkeep takes changes: a batch
    is one commit of the new postings and of each row's new version, and postings of older versions no longer count.
    Nothing is rewritten until ``merge`` drops what no longer counts. A batch that was applied already is left out.
    """

    def __init__(self, lake: Lake, name: str, fields: list[str], key: str = "key", kind: str = "int64") -> None:
        self.lake, self.fields, self.key = lake, fields, key
        self.postings, self.rows = f"{name}_postings", f"{name}_rows"
        made = {r["table_name"] for r in lake.living("table")}
        columns = {self.postings: BLOCKS, self.rows: [("key", kind), ("version", "int64"), ("live", "boolean"), ("chunk", "int64"), ("row", "int64")]}
        for table, wanted in columns.items():
            if table not in made:
                lake.create_table(table, wanted)

    def posted(self, texts: DataFrame) -> DataFrame:
        """Blocks of rows with key, version, the fields and perhaps live; and for each chunk a row without term, with keys, versions and live of its rows.

        A row's words meet in its own task.
        """
        live = F.col("live") if "live" in texts.columns else F.lit(True)
        own = [T.StructField(f"{c}s", T.ArrayType(texts.schema[c].dataType)) for c in ("key", "version")] + [T.StructField("lives", T.ArrayType(T.BooleanType()))]
        kinds = T.StructType([*[T.StructField(c, lake_type(k)) for c, k in BLOCKS], *own])
        return texts.select("key", "version", live.alias("live"), *[F.col(f).cast("binary").alias(f"text{i}") for i, f in enumerate(self.fields)]).mapInArrow(postings(self.fields), kinds)

    def in_ranges(self, held: DataFrame, rows: int, least: int | None) -> DataFrame:
        """Blocks sorted by term, in ``least`` ranges, or more where there are many postings (``rows``)."""
        ranges = max(least or 1, -(-rows // RANGE_ROWS))
        return held.repartitionByRange(ranges, "term", "chunk").sortWithinPartitions("term", "field", "chunk")

    def apply(self, changes: DataFrame, op: str = "__op", order: str = "__version", ranges: int | None = None) -> int | None:
        """Changes (key, fields, ``op``: D deletes, ``order``) into the index, as one commit; the last image of a key counts.

        Orders up to the last one applied are left out; None where nothing is new. ``ranges`` is the least number of files.
        The changes are read once, and their texts neither kept nor shuffled: of a key's images the table of rows gets the last.
        """
        last = self.reached()
        fresh = changes.where(F.col(order) > last) if last is not None else changes
        images = fresh.select(F.col(self.key).alias("key"), F.col(order).cast("bigint").alias("version"), (F.col(op) != "D").alias("live"), *self.fields)
        with sparing(self.lake.spark):
            held = materialize(self.posted(images), "postings")
            chunks = held.where("term IS NULL").select("chunk", F.posexplode(F.arrays_zip("keys", "versions", "lives")).alias("row", "own"))
            rows = latest(chunks.select(F.col("own.keys").alias("key"), F.col("own.versions").alias("version"), F.col("own.lives").alias("live"), "chunk", "row"), ["key"], ["version"])
            upto, n = held.agg(F.max(F.array_max("versions")), F.sum("n")).first()
            if upto is None:
                discard(held)
                return None
            blocks = held.where("term IS NOT NULL").select(*[c for c, _ in BLOCKS])
            mark = {"commit_extra_info": json.dumps({"index": self.postings, "upto": upto})}
            made = self.lake.write_all({self.postings: self.in_ranges(blocks, n or 0, ranges), self.rows: rows}, provenance=mark)
            discard(held)
        return made

    def reached(self) -> int | None:
        """The last order applied, from the lake's log."""
        marks = self.lake.catalog("snapshot_changes").where(F.get_json_object("commit_extra_info", "$.index") == self.postings)
        return marks.agg(F.max(F.get_json_object("commit_extra_info", "$.upto").cast("bigint"))).first()[0]

    def live(self, version: int | None = None) -> DataFrame:
        """key, version, chunk, row of the rows that count."""
        return latest(self.lake.read(self.rows, version=version), ["key"], ["version"]).where("live").drop("live")

    def outdated(self, version: int | None = None) -> DataFrame:
        """key, version of postings that no longer count, as their rows have changed or gone since: few against the postings."""
        rows = self.lake.read(self.rows, version=version)
        held = rows.groupBy("key").agg(F.max("version").alias("last"), F.collect_list(F.when(F.col("live"), F.col("version"))).alias("held"))
        return materialize(held.select("key", F.explode(F.filter("held", lambda v: v < F.col("last"))).alias("version")), "outdated")

    def found(self, low: str, high: str, field: str | None, version: int | None) -> DataFrame:
        """term, field, chunk, row, positions of terms in a range, both ends included, whether they count or not."""
        held = self.lake.read(self.postings, version=version, where=[("term", ">=", low), ("term", "<=", high)])
        held = held.where(F.col("field") == field) if field else held
        return held.mapInArrow(unpacked, "term string, field string, chunk bigint, row bigint, positions array<int>")

    def counting(self, found: DataFrame, version: int | None) -> DataFrame:
        """``found`` with key and version, where it counts."""
        return found.join(self.live(version), ["chunk", "row"]).drop("chunk", "row")

    def of(self, low: str, high: str, field: str | None, version: int | None) -> DataFrame:
        """Postings that count, of terms in a range, both ends included."""
        return self.counting(self.found(low, high, field, version), version).select("term", "field", "key", "version", "positions")

    def words(self, query: str, field: str | None = None, version: int | None = None) -> DataFrame:
        """key, hits: rows that have every word of ``query``, with how often they have any."""
        wanted = words_of(query)
        found: DataFrame | None = None
        for word in sorted(set(wanted)):
            some = self.found(word, word, field, version).groupBy("chunk", "row", "term").agg(F.sum(F.size("positions")).alias("tf"))
            found = some if found is None else found.unionByName(some)
        if found is None:
            return self.live(version).select("key", F.lit(0).cast("bigint").alias("hits"))
        hits = found.groupBy("chunk", "row").agg(F.count(F.lit(1)).alias("held"), F.sum("tf").alias("hits"))
        return self.counting(hits.where(F.col("held") == len(set(wanted))), version).select("key", "hits")

    def phrase(self, query: str, field: str | None = None, version: int | None = None) -> DataFrame:
        """key, hits: rows in which the words stand one after the other, with how often."""
        wanted = words_of(query)
        found: DataFrame | None = None
        for place, word in enumerate(wanted):
            some = self.found(word, word, field, version).select("chunk", "row", "field", F.lit(place).alias("place"), F.transform("positions", lambda p: p - place).alias("begins"))
            found = some if found is None else found.unionByName(some)
        if found is None:
            return self.live(version).select("key", F.lit(0).cast("bigint").alias("hits"))
        # A row's positions of one word are one array, so a phrase costs a row for each word and field.
        lists = [F.first(F.when(F.col("place") == i, F.col("begins")), ignorenulls=True) for i in range(len(wanted))]
        both = lists[0]
        for other in lists[1:]:
            both = F.array_intersect(both, other)
        hits = found.groupBy("chunk", "row", "field").agg(F.coalesce(F.size(both), F.lit(0)).cast("bigint").alias("n"))
        return self.counting(hits.groupBy("chunk", "row").agg(F.sum("n").alias("hits")).where("hits > 0"), version).select("key", "hits")

    def prefix(self, start: str, field: str | None = None, version: int | None = None) -> DataFrame:
        """key, hits: rows with words that begin so."""
        wanted = words_of(start)
        if len(wanted) != 1:
            raise ValueError("a prefix is the beginning of one word")
        hits = self.found(wanted[0], wanted[0] + chr(0x10FFFF), field, version).groupBy("chunk", "row").agg(F.sum(F.size("positions")).cast("bigint").alias("hits"))
        return self.counting(hits, version).select("key", "hits")

    def merge(self, ranges: int | None = None) -> None:
        """Rewrite the postings that count, sorted anew, and each row's last version; older versions of the lake stay as they are."""
        every = self.lake.read(self.postings)
        counts = self.live().where("key IS NOT NULL").groupBy("chunk").agg(F.sort_array(F.collect_list("row")).alias("kept"))
        bits = materialize(counts.mapInArrow(bits_of, "chunk bigint, bits binary"), "bits")
        near = F.broadcast(bits) if bits.count() <= OUTDATED_ROWS else bits.hint("shuffle_hash")
        held = every.join(near, "chunk").select(*every.columns, "bits").mapInArrow(sifted, every.schema)
        with sparing(self.lake.spark):
            self.lake.replace(self.postings, self.in_ranges(held, every.agg(F.sum("n")).first()[0] or 0, ranges), changes=f"compacted_table:{self.postings}")
            self.lake.replace(self.rows, latest(self.lake.read(self.rows), ["key"], ["version"]), changes=f"compacted_table:{self.rows}")
        discard(bits)


def postings(fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches of key, version, live and texts as bytes: blocks of postings, and a row for each chunk."""
    pattern = re.compile("[a-z0-9\x80-\uffff]+")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(f"text{i}") for i in range(len(fields))]
            begin = 0
            while begin < batch.num_rows:
                vocabularies, codes, lengths = [defaultdict(int) for _ in fields], [array("i") for _ in fields], [array("q") for _ in fields]
                for held in vocabularies:
                    held.default_factory = held.__len__
                end = begin
                while end < batch.num_rows and end - begin < CHUNK_ROWS and sum(map(len, codes)) < CHUNK_WORDS:
                    counts = batch.column("key")[end].is_valid and batch.column("live")[end].as_py()
                    for i, column in enumerate(texts):
                        text = column[end].as_py() if counts else None
                        words = pattern.findall((text or b"").translate(LOWER).decode("utf-8", "replace"))
                        codes[i].extend(map(vocabularies[i].__getitem__, words))
                        lengths[i].append(len(words))
                    end += 1
                chunk, own = uuid.uuid4().int >> 65, batch.slice(begin, end - begin)
                for i, field in enumerate(fields):
                    if codes[i]:
                        blocks = packed(list(vocabularies[i]), np.frombuffer(codes[i], np.int32), np.frombuffer(lengths[i], np.int64))
                        yield filled([blocks[0], pa.array([field] * len(blocks[0])), pa.array(np.full(len(blocks[0]), chunk)), *blocks[1:]], own.schema)
                yield filled([None, None, pa.array([chunk]), None, None, *[listed(own.column(c)) for c in ("key", "version", "live")]], own.schema)
                begin = end

    return post


def filled(columns: list[pa.Array | None], rows: pa.Schema) -> pa.RecordBatch:
    """A batch of blocks, or of a chunk's row; what it lacks is null."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(rows.field(c).type) for c in ("key", "version", "live")]]
    n = len(columns[2])
    columns = columns + [None] * (len(kinds) - len(columns))
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, k in zip(columns, kinds, strict=True)], [*[c for c, _ in BLOCKS], "keys", "versions", "lives"])


def listed(values: pa.Array) -> pa.Array:
    """An array as the one list of an array of lists."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def packed(words: list[str], codes: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    """term, n, packed of blocks: from each word's number among ``words``, row by row, and each row's number of words."""
    rows = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    places = np.arange(len(codes), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    order = np.argsort(codes, kind="stable")
    codes, rows, places = codes[order], rows[order], places[order]
    at = np.flatnonzero(differs(codes) | differs(rows))  # where postings begin
    terms, own = codes[at], rows[at]
    begun = np.maximum.accumulate(np.where(differs(terms), at, 0))
    firsts = np.flatnonzero(differs(terms) | differs((at - begun) // BLOCK_WORDS))  # postings with which blocks begin
    return [pa.array(words, pa.string()).take(pa.array(terms[firsts])), pa.array(np.diff(firsts, append=len(at))), bound(own, np.diff(at, append=len(codes)), since(places, at), firsts)]


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, field, chunk, row, positions of blocks."""
    for batch in slices(batches):
        n, rows, counts, deltas = opened(batch)
        blocks = pa.array(np.repeat(np.arange(len(n)), n))
        ends = np.concatenate([[0], np.cumsum(counts)])
        places = upto(deltas, ends[:-1], counts)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(blocks) for c in ("term", "field", "chunk")], pa.array(rows), lists], ["term", "field", "chunk", "row", "positions"])


def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, bits: bit r of byte r // 8 is 1 if row r is among those ``kept``."""
    for batch in batches:
        bits = []
        for rows in batch.column("kept"):
            held = np.asarray(rows.values)
            flags = np.zeros(held[-1] + 1, np.uint8)
            flags[held] = 1
            bits.append(np.packbits(flags, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(bits, pa.binary())], ["chunk", "bits"])


def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks without the postings of rows whose bit is not 1."""
    for batch in slices(batches):
        n, rows, counts, deltas = opened(batch)
        bits, begins = content(batch.column("bits"))
        block = np.repeat(np.arange(len(n)), n)
        byte = begins[block] + rows // 8
        kept = byte < begins[block + 1]
        kept[kept] = bits[byte[kept]] >> (rows[kept] % 8) & 1 == 1
        block, rows = block[kept], rows[kept]
        if not len(rows):
            continue
        firsts = np.flatnonzero(differs(block))
        some = batch.take(pa.array(block[firsts]))
        columns = {"n": pa.array(np.diff(firsts, append=len(rows))), "packed": bound(rows, counts[kept], deltas[np.repeat(kept, counts)], firsts)}
        yield pa.RecordBatch.from_arrays([columns[c] if c in columns else some.column(c) for c, _ in BLOCKS], [c for c, _ in BLOCKS])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that what is in them, opened, stays small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(content(batch.column("packed"))[1])
        part = np.cumsum(sizes) // (8 * BATCH_ROWS)
        ends = np.append(np.flatnonzero(differs(part)), batch.num_rows)
        for begin, end in zip(ends[:-1], ends[1:], strict=True):
            yield batch.slice(begin, end - begin)


def bound(rows: np.ndarray, counts: np.ndarray, deltas: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """Blocks that begin with the postings ``firsts``, each as one binary: row numbers, counts above 1, differences of positions."""
    n, many = np.diff(firsts, append=len(rows)), counts > 1
    extras, words = np.add.reduceat(many, firsts, dtype=np.int64), np.add.reduceat(counts, firsts)
    sizes = n + extras + words
    begins = np.cumsum(sizes) - sizes
    mixed = np.empty(sizes.sum(), np.int64)
    mixed[runs(begins, n)] = since(rows, firsts) * 2 + many
    mixed[runs(begins + n, extras)] = counts[many] - 2
    mixed[runs(begins + n + extras, words)] = deltas
    return cut(mixed, begins)


def opened(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """n of each block; row, count and differences of positions of its postings."""
    n, (held, offsets) = np.asarray(batch.column("n")), content(batch.column("packed"))
    mixed, begins, firsts = numbers(held), np.concatenate([[0], np.cumsum(held < 128)])[offsets[:-1]], np.cumsum(n) - n
    steps = mixed[runs(begins, n)]
    many, counts = steps & 1 == 1, np.ones(len(steps), np.int64)
    extras = np.add.reduceat(many, firsts, dtype=np.int64)
    counts[many] = mixed[runs(begins + n, extras)] + 2
    return n, upto(steps >> 1, firsts, n), counts, mixed[runs(begins + n + extras, np.add.reduceat(counts, firsts))]


def runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each of some runs, one after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binaries without nulls, and where each of them begins, with the end."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def differs(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    return np.concatenate([[True], values[1:] != values[:-1]])


def since(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Differences from the value before, but the values themselves at ``firsts``."""
    out = np.diff(values, prepend=0)
    out[firsts] = values[firsts]
    return out


def upto(deltas: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What :func:`since` was made from."""
    sums = np.cumsum(deltas)
    return sums - np.repeat(sums[firsts] - deltas[firsts], sizes)


def cut(values: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """Whole numbers from 0 as bytes of 7 bits, low ones first, the last below 128; a binary begins at each of ``firsts``."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        more = values >> 7 * k > 0
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    begins, out = ends - sizes, np.empty(ends[-1], np.uint8)
    for k in range(sizes.max()):
        on = np.flatnonzero(sizes > k)
        out[begins[on] + k] = values[on] >> 7 * k & 127 | (sizes[on] > k + 1) * 128
    offsets = np.append(begins[firsts], ends[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def numbers(held: np.ndarray) -> np.ndarray:
    """The whole numbers that :func:`cut` wrote."""
    ends = np.flatnonzero(held < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    sizes, out = ends - begins + 1, (held[begins] & 127).astype(np.int64)
    for k in range(1, sizes.max()):
        on = np.flatnonzero(sizes > k)
        out[on] |= (held[begins[on] + k] & 127).astype(np.int64) << 7 * k
    return out


def words_of(query: str) -> list[str]:
    """The words of a query, cut as texts are."""
    return [w for w in re.split("[^a-z0-9\x80-￿]+", query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
