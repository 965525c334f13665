"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes. The
index posts each distinct fingerprint under groups of 4 byte positions, the 14 blocks of the Steiner system
S(3,4,8): any 5 positions contain a whole block, so every such pair meets under at least one of 14 keys of
32 bits. (Lists of a single byte would each hold a 256th of all fingerprints; a block is the exact refinement of
four of them.) In a list, the positional bytes that pairs share are tallied: pairs below 5, as most of those that
share the block alone, are cut, and what remains is verified by its differing bits.

A posting list that is longer than ``limit`` is split exactly, not capped: of its remaining bits, cut into
4 groups, a pair within 3 bits agrees on one group whole, so each entry moves to 4 longer keys, until at
most ``2**r`` values can share a key. Lists emit a spanning forest, never all pairs. Exact copies are one
fingerprint throughout.

Edge cases: null and empty texts (and texts of white space) have fingerprint 0 and are linked like any
other; rows with a null id take part, and are named by the smallest id that is not null (null if the group
has none); repeated rows give a row each; an empty table gives an empty result; very long texts are hashed
in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slim, small_batches
from tidemark.llm.graph import components
from tidemark.session import materialize

BITS, DISTANCE, SHARED = 64, 3, 5
SHINGLE, SEED = 3, 42


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII white space, a bounded stretch of the text at a time."""
    start = 0
    while start < len(data):
        end = min(len(data), start + size)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end = min([x for x in (data.find(c, end) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")) if x >= 0], default=len(data))
        yield data[start:end].split()
        start = end


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values; as a signed 64-bit number."""
    total, sums, kept, whole = 0, np.zeros(BITS, np.int64), [], []
    digest = xxhash.xxh64_intdigest
    for words in word_blocks((text or "").encode().lower()):
        words = kept + words
        if not total and len(words) < shingle:
            kept = words
            continue
        hashes = np.array([digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))], np.uint64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        kept = words[len(words) - shingle + 1 :]
    if not total:
        whole = kept
        if not whole:
            return 0
        return int(np.uint64(digest(b" ".join(whole), SEED)).view(np.int64))
    return int(np.packbits(2 * sums > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp of every row."""
    source = slim(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [fingerprint(value.as_py(), shingle) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fp"])

    return source.mapInArrow(hashed, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def byte_masks() -> list[int]:
    """The 14 sets of 4 byte positions whose numbers cancel under exclusive or, as bit masks."""
    blocks = [x for x in combinations(range(8), 4) if x[0] ^ x[1] ^ x[2] ^ x[3] == 0]
    return [sum(0xFF << (8 * i) for i in block) for block in blocks]


def longer_masks(mask: int) -> list[int]:
    """``mask`` with each of 4 groups of the bits that it leaves: a pair within 3 bits agrees on one group."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [round(i * len(rest) / (DISTANCE + 1)) for i in range(DISTANCE + 2)]
    return [mask | sum(1 << b for b in rest[x:y]) for x, y in zip(cuts, cuts[1:])]


def positional(values: np.ndarray) -> np.ndarray:
    """The 8 positional bytes of each fingerprint."""
    return values.view(np.uint8).reshape(-1, 8)


def tallied(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many positional bytes each of ``some`` shares with its partner in ``others`` (or with the only one)."""
    return (some == others).sum(axis=1, dtype=np.int8)


def close(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Verification of pairs that have passed the count filter."""
    return np.bitwise_count(some ^ others) <= DISTANCE


def linked(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places of the pairs that are linked: those that share too few bytes are cut, the rest are verified."""
    kept = np.flatnonzero(tallied(positional(some), positional(others)) >= SHARED)
    return kept[close(some[kept], others[kept] if len(others) == len(some) else others)]


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Edges (place, place) that join the places of ``values`` which links connect."""
    left, edges = np.arange(len(values)), []
    while len(left) > 1:
        root, left, todo = left[0], left[1:], [left[0]]
        while todo and len(left):
            at = todo.pop()
            near = np.zeros(len(left), bool)
            near[linked(values[left], values[at : at + 1])] = True
            found, left = left[near], left[~near]
            edges += [(int(root), int(x)) for x in found]
            todo += found.tolist()
    return edges


def list_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of posting lists that arrive in key order; a list that two batches share is carried over."""

    def edges(mask: np.ndarray, part: np.ndarray, fp: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, int]:
        starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])]))
        ends = np.append(starts[1:], len(fp))
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        u, v, values = [], [], fp.view(np.uint64)
        two = starts[ends - starts == 2]
        two = two[linked(values[two], values[two + 1])]
        u.append(fp[two])
        v.append(fp[two + 1])
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            if found := forest(values[s:e]):
                pairs = np.array(found) + s
                u.append(fp[pairs[:, 0]])
                v.append(fp[pairs[:, 1]])
        return np.concatenate(u), np.concatenate(v), int(ends[-1]) if len(ends) else 0

    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([x, batch.column(n).to_numpy()]) for x, n in zip(held, ("mask", "part", "fp"), strict=True)]
        if len(held[0]):
            u, v, done = edges(*held, last=False)
            held = [x[done:] for x in held]
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    if len(held[0]):
        u, v, _ = edges(*held, last=True)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(values: DataFrame, limit: int = 4096) -> DataFrame:
    """u, v: edges between distinct fingerprints (column fp) with the same components as all linked pairs.

    ``limit`` bounds the entries of a posting list that meet in one task; it drops nothing.
    """
    spark, masks = values.sparkSession, byte_masks()
    posted = values.select("fp", F.explode(F.array(*[F.lit(signed(m)).cast("bigint") for m in masks])).alias("mask"))
    found: DataFrame | None = None
    while True:
        posted = posted.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("part"), "fp")
        lengths = materialize(posted.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
        listed = posted.join(lengths, ["mask", "part"])
        short = listed.where(F.col("n") <= limit).select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        more = short.mapInArrow(list_edges, "u bigint, v bigint")
        found = more if found is None else found.unionByName(more)
        if lengths.where(F.col("n") > limit).isEmpty():
            return found
        # A mask leaves r bits; at most 2**r values share a key, and r shrinks by a quarter each time.
        masks = [m for m in masks if 2 ** (BITS - m.bit_count()) > limit]
        children = spark.createDataFrame([(signed(m), [signed(x) for x in longer_masks(m)]) for m in masks], T.StructType([T.StructField("mask", T.LongType()), T.StructField("longer", T.ArrayType(T.LongType()))]))
        posted = materialize(listed.where(F.col("n") > limit).select("mask", "fp").join(F.broadcast(children), "mask").select("fp", F.explode("longer").alias("mask")).distinct(), "longer")
        masks = sorted({x for m in masks for x in longer_masks(m)})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = 4096) -> DataFrame:
    """doc_id, text_hash, fp, component_id and keeper (id and text hash of the row that stands for the group)."""
    each = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    nodes = materialize(each.groupBy("fp").agg(F.min(row).alias("first")), "nodes")
    groups = materialize(components(links(nodes.select("fp"), limit)), "components")
    # Tables of their own before each join by a key that may be hot: adaptive execution then splits it.
    linked = materialize(groups.join(nodes, groups["node"] == nodes["fp"]).select("fp", "component", "first"), "linked")
    least = materialize(linked.groupBy("component").agg(F.min("first").alias("keeper")), "least")
    named = linked.join(least, "component").select("fp", "keeper")
    keepers = materialize(nodes.join(named, "fp", "left").select("fp", F.coalesce("keeper", "first").alias("keeper")), "keepers")
    return each.join(keepers, "fp").select("doc_id", "text_hash", "fp", F.col("keeper.doc_id").alias("component_id"), "keeper")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id.

    Texts are linked within ``DISTANCE`` bits or, where a ``similarity`` of shingle sets is asked for, by that. A pair of
    similarity 0.8 differs in 10 of 64 bits on average, which leaves no positional byte that it must share; its candidates
    come from the byte positions of a wider fingerprint (``nearcopies``).
    """
    if similarity is not None:
        from tidemark.llm import nearcopies

        if (shingle, similarity) != (nearcopies.SHINGLE, 0.8):
            raise ValueError("similarity is known for five-word shingles and 0.8")
        return nearcopies.keep_one(docs, doc_id, text)
    found = materialize(near_duplicates(docs, doc_id, text, shingle), "groups")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash")))
    kept = kept.groupBy(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).agg(F.count(F.lit(1)).alias("rows"))
    kept = materialize(kept, "kept")
    stay = docs.join(kept, docs[doc_id].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs[text]) == kept["kept_hash"]), "left_semi")
    if kept.where("rows > 1").isEmpty():
        return stay
    return stay.dropDuplicates([doc_id, text])
