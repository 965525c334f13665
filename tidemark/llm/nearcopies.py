"""Near-duplicate texts by SimHash: a byte-position inverted index, count filtering, verification of similarity.

Two texts are linked if their sets of five-word shingles have a similarity of 0.8 or more. The method is that of
``simhash`` with a wider fingerprint, as such a pair differs in 15 % of the bits, which is out of reach for 3 of 64:

* Fingerprint: 2,560 bits (320 positional bytes), each the majority over a text's distinct shingles.
* Index: a text is posted under each two neighbouring bytes, with their position: 160 keys of 16 bits. A pair of
  similarity 0.8 shares a key with probability 0.072 and misses all with 6e-6; a closer pair more rarely still.
  Ties make texts of 4 and 5 shingles differ in up to 19 % of the bits, so they have 480 keys. Texts of up to 3 are similar
  to none but those of the same shingles, so they have one key, made of the carried bits.
* Postings carry the number of shingles and 192 bits of the fingerprint that no key uses, so that a shared key says nothing
  about them. Who is near no other member of a list leaves it: near is within 54 bits, which a pair of similarity 0.8
  exceeds with probability 1e-6 and two unrelated texts reach with 6e-10; for texts of at most 5 shingles within 62 (one of
  4 and 5 exceeds that with 2e-6). Texts of one size below 9 are similar only if they are equal, and must have no bit
  different: ties make bits of even sizes rarer, and unrelated ones alike. Chance pairs of n texts of one size are then
  some 1.4e-12 n a text.
* Count filter: pairs of what remains that share fewer than 44 of 320 positional bytes are cut (86 are expected at 0.8).
* Verification: pairs that differ in more than 500 bits are cut (388 are expected at 0.8), of the others the whole
  shingle sets are compared; a spanning forest of the links is emitted, never all pairs.

Texts that near pairs connect are a cluster and meet once, not list by list; only clusters of more than ``limit``
shingles are compared by their lists. A list or cluster that is large is dealt into chunks, and each chunk also
gets some 32 members of the whole. Members that are then in another component than most meet every chunk in a second
round, so all pairs that are not connected yet are compared: nothing is capped, and a list of near copies costs its
length, not the square. Comparisons by the carried bits grow with the square of the texts over 65,536: a list of the
160 positions has that share of the texts, and is compared whole up to ``LONG`` entries, which is 69 billion texts.

Edge cases: texts without a word are copies of each other; a text of fewer than five words is one shingle;
rows with a null id take part; repeated rows give one row; of very long texts the hashes are held, not the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slim, small_batches
from tidemark.llm.graph import components
from tidemark.llm.simhash import word_blocks
from tidemark.session import discard, materialize

SHINGLE, SEED = 5, 42
#: Keys of two positional bytes each, shingles up to which a text has more of them, and how many times as many.
KEYS, SMALL, MORE = 160, 5, 3
#: Sizes up to which only equal sets are similar, and below which sets of one size are only if they are equal.
ALONE, EQUAL = 3, 9
#: Numbers of 64 bits that a posting carries.
WORDS = 3
#: Cuts, for texts above ``SMALL`` and others: differing bits of those that a posting carries; shared positional bytes and
#: differing bits of all.
CARRIED, SHARED, DIFFERING = (54, 62), (44, 20), (500, 620)
PIVOTS = 32
#: Positions whose lists are compared first.
FIRST = 32
#: Entries of a list that are held at once, of some 50 bytes; a longer list keeps all its members.
LONG = 1 << 20
#: A mask and a multiplier for each 64 bits of a fingerprint.
MASKS, FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, MORE * KEYS // 4), np.uint64) | np.uint64(1)
OWN_MASKS, OWN_FACTORS = np.random.default_rng(SEED + 1).integers(0, 1 << 64, (2, WORDS), np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, block by block; a text with fewer words is one shingle."""
    kept, some = [], False
    for words in word_blocks((text or "").encode().lower()):
        words = kept + words
        if not some and len(words) < shingle:
            kept = words
            continue
        yield np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))], np.uint64)
        some, kept = True, words[len(words) - shingle + 1 :]
    if not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles as hashes, ascending."""
    return np.unique(np.concatenate(list(shingle_hashes(text))))


def majorities(shingles: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """64 bits, as bytes, for each mask: a bit is 1 if it is set in over half of the distinct shingles' hashes."""
    sums = np.zeros(64 * len(masks), np.int64)
    for at in range(0, len(shingles), 255):  # sums of so many bits fit a byte
        part = (shingles[at : at + 255, None] ^ masks) * factors
        part = (part ^ (part >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(29)
        sums += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * sums > len(shingles), bitorder="little")


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """Positional bytes, of which keys are made."""
    words = (MORE if len(shingles) <= SMALL else 1) * KEYS // 4
    return majorities(shingles, MASKS[:words], FACTORS[:words])


def carried_bits(shingles: np.ndarray) -> np.ndarray:
    """Further bits of the fingerprint, of which no key is made."""
    return majorities(shingles, OWN_MASKS, OWN_FACTORS).view(np.int64)


def position_keys(print_: np.ndarray, carried: np.ndarray, size: int) -> np.ndarray:
    """Each two neighbouring bytes, with their position; of a text that only its equals are similar to, one key below those."""
    if size <= ALONE:
        mixed = np.bitwise_xor.reduce(carried.view(np.uint64) * OWN_FACTORS) * np.uint64(0x9E3779B97F4A7C15)
        return np.array([-1 - int(mixed >> np.uint64(34))], np.int32)
    pairs = print_.view(np.uint16)
    return (np.arange(len(pairs), dtype=np.int32) << 16) | pairs


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, size, a, b, c (the carried bits), keys of every row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sizes, prints, carried = [], [], []
            for value in batch.column("text"):
                shingles = shingle_set(value.as_py())
                sizes.append(len(shingles))
                prints.append(fingerprint(shingles))
                carried.append(carried_bits(shingles))
            bits = np.array(carried, np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int32()), *(pa.array(bits[:, i]) for i in range(WORDS)), pa.array([position_keys(*x) for x in zip(prints, carried, sizes, strict=True)], pa.list_(pa.int32()))],
                ["doc_id", "text_hash", "size", "a", "b", "c", "keys"],
            )

    return docs.mapInArrow(signed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, size int, a bigint, b bigint, c bigint, keys array<int>")


def near_roots(key: np.ndarray, size: np.ndarray, carried: list[np.ndarray], short: int = 256) -> np.ndarray:
    """For entries of lists in key order: the first entry of the list that near pairs lead to, -1 for entries that are near no other.

    Near are entries with carried bits within ``CARRIED`` and sizes that allow the similarity.
    """
    words, size = [x.view(np.uint64) for x in carried], size.astype(np.int64)
    most = np.where(size <= SMALL, CARRIED[1], CARRIED[0])

    def near(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        fits = (5 * size[some] >= 4 * size[others]) & (5 * size[others] >= 4 * size[some])
        apart = sum(np.bitwise_count(w[some] ^ w[others]) for w in words)
        equal = (size[some] == size[others]) & (size[some] < EQUAL)
        return fits & (apart <= np.where(equal, 0, np.maximum(most[some], most[others])))

    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(starts[1:], len(key))
    lengths = ends - starts
    u, v = [], []
    some, end, step = np.flatnonzero(np.repeat(lengths <= short, lengths)), np.repeat(ends, lengths), 1
    while len(some):
        some = some[some + step < end[some]]
        found = some[near(some, some + step)]
        u.append(found)
        v.append(found + step)
        step += 1
    for s, e in zip(starts[lengths > short], ends[lengths > short], strict=True):
        left = np.arange(s, e)
        while len(left) > 1:
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                at = todo.pop()
                met = near(left, np.array([at]))
                found, left = left[met], left[~met]
                u.append(np.full(len(found), at))
                v.append(found)
                todo += found.tolist()
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (u, v))
    roots, before = np.arange(len(key)), None
    while before is None or (roots != before).any():
        before = roots.copy()
        least = np.minimum(roots[u], roots[v])
        np.minimum.at(roots, u, least)
        np.minimum.at(roots, v, least)
        roots = roots[roots]
    alone = np.ones(len(key), bool)
    alone[u] = alone[v] = False
    roots[alone] = -1
    return roots


def near_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings in key order those that are near another of their list, with the smallest text hash that near pairs lead to.

    A list that batches share is carried over; one of more than ``LONG`` entries passes whole, as if all were near.
    """
    names = ("key", "text_hash", "size", "a", "b", "c")
    held, whole, first = None, 1 << 40, 0  # whole: the key of the last list that passes whole; first: its first text hash

    def kept(columns: list[np.ndarray]) -> pa.RecordBatch:
        passes = columns[0] == whole
        root, tested = np.full(len(passes), first), np.flatnonzero(~passes)
        if len(tested):
            key, _, size, *carried = (x[tested] for x in columns)
            found = near_roots(key, size, carried)
            tested, found = tested[found >= 0], found[found >= 0]
            least = np.full(len(passes), np.iinfo(np.int64).max)
            np.minimum.at(least, found, columns[1][tested])
            root[tested], passes[tested] = least[found], True
        return pa.RecordBatch.from_arrays([pa.array(x[passes]) for x in (*columns[:3], root)], [*names[:3], "root"])

    for batch in batches:
        new = [batch.column(n).to_numpy() for n in names]
        held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        last = held[0][-1]
        done = int(np.searchsorted(held[0], last))
        if done > 1 << 14 or (done and (last == whole or len(held[0]) - done > LONG)):
            yield kept([x[:done] for x in held])
            held = [x[done:] for x in held]
        if len(held[0]) > LONG and held[0][0] == last and last != whole:
            whole, first = last, held[1][0]
        if held[0][0] == last == whole:
            yield kept(held)
            held = None
    if held is not None and len(held[0]):
        yield kept(held)


def postings(each: DataFrame) -> DataFrame:
    """key, text_hash, size, root: the index, without entries that are near no other of their list."""
    texts = each.groupBy("text_hash").agg(F.first(F.struct("size", "a", "b", "c", "keys")).alias("x"))
    posted = texts.select("text_hash", "x.size", "x.a", "x.b", "x.c", F.explode("x.keys").alias("key"))
    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(near_entries, "key int, text_hash bigint, size int, root bigint")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """text_hash, shingles (distinct, ascending), print (the positional bytes that all texts have) of each distinct text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [shingle_set(value.as_py()) for value in batch.column("text")]
            prints = [fingerprint(x)[: 2 * KEYS].tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), pa.array([np.sort(x.view(np.int64)) for x in found], pa.list_(pa.int64())), pa.array(prints, pa.binary())], ["text_hash", "shingles", "print"])

    return docs.mapInArrow(sets, "text_hash bigint, shingles array<bigint>, print binary")


def sharing(prints: np.ndarray, sizes: np.ndarray, some: np.ndarray, at: int) -> np.ndarray:
    """Which of ``some`` share enough positional bytes with ``at``, and of these differ in few enough bits."""
    small = int(sizes[at] <= SMALL + 1)
    some = some[np.count_nonzero(prints[some] == prints[at], axis=1) >= SHARED[small]]
    return some[np.bitwise_count(prints[some].view(np.uint64) ^ prints[at].view(np.uint64)).sum(axis=1, dtype=np.int64) <= DIFFERING[small]]


def forest(sets: list[np.ndarray], prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges (place, place) that join the places of ``sets`` which links connect; pairs that share too few bytes are cut first."""
    sizes, flat = np.array([len(s) for s in sets]), np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left, edges = np.arange(len(sets)), []
    while len(left) > 1:
        root, left, todo = left[0], left[1:], [left[0]]
        while todo and len(left):
            at = todo.pop()
            some = left[(5 * sizes[left] >= 4 * sizes[at]) & (5 * sizes[at] >= 4 * sizes[left])]
            some = sharing(prints, sizes, some, at)
            if not len(some):
                continue
            lengths = sizes[some]
            ends = np.cumsum(lengths)
            values = flat[np.arange(ends[-1]) + np.repeat(starts[some] - (ends - lengths), lengths)]
            places = np.minimum(np.searchsorted(sets[at], values), sizes[at] - 1)
            shared = np.add.reduceat((sets[at][places] == values).astype(np.int64), ends - lengths)
            found = some[9 * shared >= 4 * (lengths + sizes[at])]  # shared / union >= 4 / 5
            left = left[~np.isin(left, found)]
            edges += [(int(root), int(x)) for x in found]
            todo += found.tolist()
    return edges


def list_edges(table: pa.Table) -> pa.Table:
    """u, v: a spanning forest of the links of one list."""
    names = table.column("text_hash").to_numpy()
    _, first = np.unique(names, return_index=True)
    column = table.column("shingles").combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    prints = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint8).reshape(-1, 2 * KEYS)
    pairs = np.array(forest([flat[ends[i] : ends[i + 1]] for i in first], prints[first]), np.int64).reshape(-1, 2)
    return pa.table({"u": names[first[pairs[:, 0]]], "v": names[first[pairs[:, 1]]]})


def compared(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v of the lists in ``cells``: key, block, chunk, text_hash."""
    whole = materialize(cells, "cells").join(sets, "text_hash")
    return materialize(whole.groupBy("key", "block", "chunk").applyInArrow(list_edges, "u bigint, v bigint").distinct(), "links")


def links(docs: DataFrame, each: DataFrame, limit: int) -> DataFrame:
    """u, v: edges between text hashes with the same components as all linked pairs.

    Texts that near pairs connect are a cluster, compared as one list. A cluster of more than ``limit`` shingles is compared
    list by list instead: those of the first positions, then of the others those whose members are not yet connected.
    """
    posted = materialize(postings(each), "posted")
    needed = materialize(posted.select("text_hash", "size").distinct(), "needed")
    texts = docs.join(needed, "text_hash", "left_semi").select("text_hash", "text")
    sets = materialize(shingle_sets(texts).dropDuplicates(["text_hash"]), "sets")
    # A text and its roots are tied to the smallest of them: far fewer distinct edges than to each root.
    tied = posted.groupBy("text_hash").agg(F.min("root").alias("v"), F.collect_set("root").alias("roots"))
    tied = tied.select(F.explode(F.concat("roots", F.array("text_hash"))).alias("u"), "v")
    clusters = materialize(components(tied), "clusters")
    members = materialize(needed.join(clusters, needed["text_hash"] == clusters["node"]).select(F.col("component").alias("key"), "text_hash", "size"), "members")
    large = materialize(members.groupBy("key").agg(F.sum("size").alias("held")).where(F.col("held") > limit).select("key"), "large")
    found = list_links(materialize(members.join(large, "key", "left_anti"), "small"), sets, limit // 8)
    if large.isEmpty():
        discard(posted)
        return found
    within = materialize(members.join(large, "key", "left_semi").select("text_hash"), "within")
    listed = posted.join(within, "text_hash", "left_semi")
    listed = materialize(listed.select(F.xxhash64("key", "root").alias("key"), (F.shiftright("key", 16) < FIRST).alias("early"), "text_hash", "size"), "listed")
    discard(posted)
    found = found.unionByName(list_links(listed.where("early"), sets, limit))
    groups = materialize(components(found), "components")
    named = listed.where("not early").join(groups, listed["text_hash"] == groups["node"], "left")
    named = materialize(named.select("key", "text_hash", "size", F.coalesce("component", "text_hash").alias("component")), "named")
    apart = materialize(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"), "apart")
    rest = materialize(named.join(apart, "key", "left_semi").select("key", "text_hash", "size"), "rest")
    return found.unionByName(list_links(rest, sets, limit))


def list_links(posted: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """u, v: edges with the same components as the linked pairs that meet in a list of ``posted``."""
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"), F.bit_xor(F.xxhash64("text_hash")).alias("a"), F.bit_xor(F.xxhash64("text_hash", F.lit(1))).alias("b"))
    lists = lists.where("n > 1").groupBy("n", "a", "b").agg(F.min(F.struct("key", "held")).alias("list"))
    lists = materialize(lists.select(F.col("list.key").alias("key"), "n", F.ceil(F.col("list.held") / limit).alias("chunks")), "lists")
    entries = materialize(posted.join(lists, "key").select("key", "n", "chunks", "text_hash", F.pmod(F.xxhash64("text_hash", "key"), "chunks").alias("chunk")), "entries")

    wide = entries.where("chunks > 1")
    pivots = wide.where(F.pmod(F.xxhash64("key", "text_hash"), "n") < PIVOTS).select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "text_hash")
    cells = entries.select("key", "chunk", "text_hash").unionByName(pivots).select("key", F.lit(0).cast("bigint").alias("block"), "chunk", "text_hash")
    found = compared(cells, sets)
    if wide.isEmpty():
        return found

    # Second round: members outside a list's main component meet each of its chunks.
    groups = materialize(components(found), "components")
    named = materialize(wide.join(groups, wide["text_hash"] == groups["node"], "left").select("key", "n", "chunks", "chunk", "text_hash", F.coalesce("component", "text_hash").alias("component")), "named")
    counts = materialize(named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held")), "counts")
    main = materialize(counts.groupBy("key").agg(F.max(F.struct("held", "component"))["component"].alias("main")), "main")
    rest = materialize(named.join(main, "key").where("component <> main").select("key", "n", "chunks", "text_hash"), "rest")
    if rest.isEmpty():
        return found
    held = rest.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("chunks").alias("chunks"))
    held = materialize(held.select("key", F.ceil(F.col("m") * F.col("chunks") / F.col("n")).alias("blocks")), "held")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    dealt = rest.join(held, "key").withColumn("block", F.pmod(F.xxhash64("text_hash", "key"), "blocks")).select("key", "block", upto("chunks").alias("chunk"), "text_hash")
    met = named.join(held, "key").select("key", upto("blocks").alias("block"), "chunk", "text_hash")
    return found.unionByName(compared(dealt.unionByName(met), sets))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 1 << 20) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id.

    ``limit`` bounds the shingles that meet in one task (two texts and the members that all chunks get aside); it drops nothing.
    """
    # Texts without a word are one text here, as they have the same shingle.
    source = slim(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    each = materialize(signatures(source), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    nodes = materialize(each.groupBy("text_hash").agg(F.min(row).alias("first")), "nodes")
    groups = materialize(components(links(source, each, limit)), "components")
    discard(each)
    # Tables of their own before each join by a key that may be hot: adaptive execution then splits it.
    linked = materialize(groups.join(nodes, groups["node"] == nodes["text_hash"]).select("text_hash", "component", "first"), "linked")
    least = linked.groupBy("component").agg(F.min("first").alias("keeper")).select("keeper")
    alone = nodes.join(linked.select("text_hash"), "text_hash", "left_anti").select(F.col("first").alias("keeper"))
    kept = materialize(least.unionByName(alone).select(F.col("keeper.doc_id").alias("kept_id"), F.col("keeper.text_hash").alias("kept_hash")), "kept")
    stay = docs.join(kept, docs[doc_id].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs[text]) == kept["kept_hash"]), "left_semi")
    repeated = each_repeats(source, kept)
    return stay.dropDuplicates([doc_id, text]) if repeated else stay


def each_repeats(source: DataFrame, kept: DataFrame) -> bool:
    """Whether a kept row stands in the table more than once."""
    rows = source.select("doc_id", "text_hash").join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
    return not rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
