"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are normalised and rotated (random signs, then a Walsh-Hadamard transform) and split into blocks of
few dimensions. Two vectors of cosine ``threshold`` or more are at most ``2 - 2 * threshold`` apart in
squared distance, so in some block they are within its proportional share of that budget. Each block is
range-joined on a grid: a vector lives in one cell and visits those later cells that its ball touches. What visits
is an id and its coordinates in the block. Only members of a cell that are near another one on the block get their
vectors, by a join; their pairs are kept in the first block that admits them only, and verified by their cosine in
double precision. The union over the blocks has every pair, once.

A cell that holds more than ``limit`` vectors is dealt into chunks that meet pairwise in separate tasks.
Tasks emit counts and a spanning forest, never pairs; equal vectors are one class with a count throughout.
The grid uses more coordinates of a block the more vectors there are, so cells stay small.

Edge cases: a vector that is null, empty or zero, or holds a null or a component that is not finite, and a
vector with a null label, links with nothing; vectors of different lengths do not link; repeated rows count
as vectors of their own; null ids are allowed, and a component is named by its smallest id that is not
null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slim
from tidemark.llm.graph import components
from tidemark.session import materialize

SLACK = 1e-9
OFFSET, CELL_BITS = 512, 10


def rotated(vectors: np.ndarray, seed: int = 7) -> np.ndarray:
    """Unit vectors under random signs and a Walsh-Hadamard transform: a row's result depends on that row alone."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    out = np.zeros((len(vectors), width))
    out[:, : vectors.shape[1]] = vectors
    peak = np.abs(out).max(axis=1, keepdims=True)
    out /= np.where(peak > 0, peak, 1)
    out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    out *= np.random.default_rng(seed).choice([-1.0, 1.0], width)
    half = 1
    while half < width:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
        half *= 2
    return out / math.sqrt(width)


def block_slices(width: int, blocks: int) -> list[slice]:
    blocks = max(1, min(blocks, width))
    cuts = [round(i * width / blocks) for i in range(blocks + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def budget(part: slice, width: int, threshold: float) -> float:
    return max(0.0, 2 - 2 * threshold) * (part.stop - part.start) / width + SLACK


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def cells(points: np.ndarray, radius: float, coordinates: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row numbers, cell, home): each point's own cell, then the later cells that its ball touches."""
    width = max(2 * radius, 2.0 / (OFFSET - 2))
    at = points[:, :coordinates] / width
    base = np.floor(at).astype(np.int64)
    below, above = (at - base) * width, (base + 1 - at) * width

    def packed(cell: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), np.int64)
        for i in range(cell.shape[1]):
            out = (out << CELL_BITS) | (cell[:, i] + OFFSET)
        return out

    home = packed(base)
    yield np.arange(len(points)), home, True
    for move in product((-1, 0, 1), repeat=coordinates):
        if not any(move):
            continue
        gap = sum((below[:, i] if m < 0 else above[:, i]) ** 2 for i, m in enumerate(move) if m)
        cell = packed(base + np.array(move))
        near = np.flatnonzero((gap <= radius**2 + SLACK) & (cell > home))
        if len(near):
            yield near, cell[near], False


def join_root(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest places reachable, after links i-j are added."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(root, root[root]):
            root = root[root]


def compare(vectors: np.ndarray, home: np.ndarray, side: np.ndarray, block: int, blocks: int, threshold: float, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task: what each member gains in linked vectors, and the smallest place it is joined to.

    ``side`` has 1 and 2 for members of two chunks that meet (pairs across only), 0 for all within one.
    """
    spun = rotated(vectors)
    width = spun.shape[1]
    parts = block_slices(width, blocks)
    limits = [budget(p, width, threshold) for p in parts]
    own = spun[:, parts[block]]
    # Scaled by powers of two, which is exact and keeps squares finite.
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0.0))[1])
    squares, norms = (own * own).sum(axis=1), np.sqrt((vectors * vectors).sum(axis=1))
    gained, root = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
    for start in range(0, len(vectors), 256):
        rows = slice(start, start + 256)
        apart = squares[rows, None] + squares[None, :] - 2 * own[rows] @ own.T
        i, j = np.nonzero(apart <= limits[block] + 1e-6)
        i += start
        wanted = (i < j) & (home[i] | home[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[wanted], j[wanted]
        for part, limit in zip(parts[: block + 1], limits, strict=False):
            within = ((spun[i, part] - spun[j, part]) ** 2).sum(axis=1) <= limit
            stay = within if part is parts[block] else ~within
            i, j = i[stay], j[stay]
        linked = (vectors[i] * vectors[j]).sum(axis=1) / (norms[i] * norms[j]) >= threshold
        i, j = i[linked], j[linked]
        if len(i):
            np.add.at(gained, i, counts[j])
            np.add.at(gained, j, counts[i])
            root = join_root(root, i, j)
    return gained, root


def have_partners(own: np.ndarray, home: np.ndarray, side: np.ndarray, limit: float) -> np.ndarray:
    """Which members of one task are within the budget of another one on the block: by coordinates of single precision, with room for it."""
    own = own.astype(np.float64)
    squares, found = (own * own).sum(axis=1), np.zeros(len(own), bool)
    for start in range(0, len(own), 256):
        rows = slice(start, start + 256)
        apart = squares[rows, None] + squares[None, :] - 2 * own[rows] @ own.T
        near = (apart <= limit + 1e-5) & (home[rows, None] | home[None, :]) & ((side[rows, None] == 0) | (side[rows, None] != side[None, :]))
        near[np.arange(len(near)), np.arange(start, start + len(near))] = False
        found[rows] |= near.any(axis=1)
    return found


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of rows that arrive in order of their key."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        start = 0
        while start < len(keys):
            end = start
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if held and keys[start] != key:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = keys[start]
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def sides(table: pa.Table, a: int, b: int) -> np.ndarray:
    return np.zeros(table.num_rows, np.int8) if a == b else np.where(table.column("chunk").to_numpy() == a, 1, 2)


def valid() -> str:
    return "label is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"


def near_duplicates(
    table: DataFrame,
    threshold: float = 0.98,
    blocks: int = 8,
    limit: int = 4096,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    source = slim(table, vec_id=vec_id, vector=vector, label=label)
    kept = "float" if source.schema["vector"].dataType.elementType == T.FloatType() else "double"  # as narrow as the table's
    keys = [F.xxhash64("label", "vector").alias("k1"), F.xxhash64(F.lit(1), "vector", "label").alias("k2")]
    good = F.coalesce(F.expr(valid()), F.lit(False))
    rows = materialize(source.select("vec_id", F.when(good, keys[0]).alias("k1"), F.when(good, keys[1]).alias("k2")), "rows")
    classes = source.where(good).groupBy("label", F.col("vector").cast(f"array<{kept}>").alias("vector")).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("members"), F.first(keys[0]).alias("k1"), F.first(keys[1]).alias("k2"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "classes")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    coordinates = max(1, min(6, round(math.log(max(most, 1) / limit) / math.log(3))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims):
                batch = whole.filter(pa.array(dims == dim))
                spun = rotated(matrix(batch.column("vector")))
                flat = spun.astype(np.float32)
                for number, part in enumerate(block_slices(spun.shape[1], blocks)):
                    radius = math.sqrt(budget(part, spun.shape[1], threshold))
                    for at, cell, home in cells(spun[:, part], radius, min(coordinates, part.stop - part.start)):
                        own = pa.array([x.tobytes() for x in np.ascontiguousarray(flat[at, part])], pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("label").take(pa.array(at)), batch.column("dim").take(pa.array(at)), pa.array(np.full(len(at), number, np.int32)), pa.array(cell), pa.array(np.full(len(at), home)), batch.column("cid").take(pa.array(at)), own],
                            ["label", "dim", "block", "cell", "home", "cid", "own"],
                        )

    label_type = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "dim", "cid", "vector").mapInArrow(place, f"label {label_type}, dim int, block int, cell bigint, home boolean, cid bigint, own binary")
    cell_key = ["label", "dim", "block", "cell"]
    placed = materialize(placed, "placed")
    full = placed.groupBy(*cell_key).agg(F.count(F.lit(1)).alias("held"), F.max("home").alias("any_home")).where("held > 1 and any_home")
    met = placed.join(full.select(*cell_key, F.ceil(F.col("held") / limit).cast("int").alias("chunks")), cell_key)
    chunk = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    met = met.withColumn("chunk", chunk).withColumn("other", F.explode(others))
    met = met.select(*cell_key, F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "home", "cid", "own")
    group = [*cell_key, "a", "b"]
    in_order = lambda rows: rows.repartition(*group).sortWithinPartitions(*group)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim, block, _, a, b), table in groups(batches, group):
            width = 1 << max(0, dim - 1).bit_length()
            part = block_slices(width, blocks)[block]
            own = np.frombuffer(b"".join(table.column("own").to_pylist()), np.float32).reshape(table.num_rows, -1)
            near = have_partners(own, table.column("home").to_numpy(), sides(table, a, b), budget(part, width, threshold))
            yield from table.filter(pa.array(near)).select([*group, "chunk", "home", "cid"]).to_batches()

    # Who is near another on the block: an entry of a cell, not a pair.
    near = materialize(in_order(met).mapInArrow(sift, f"label {label_type}, dim int, block int, cell bigint, a int, b int, chunk int, home boolean, cid bigint"), "near")
    dealt = in_order(near.join(classes.select("cid", "members", "vector"), "cid"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, block, _, a, b), table in groups(batches, group):
            cid = table.column("cid").to_numpy()
            gained, root = compare(matrix(table.column("vector").combine_chunks()), table.column("home").to_numpy(), sides(table, a, b), block, blocks, threshold, table.column("members").to_numpy())
            some = np.flatnonzero(gained > 0)
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(cid[root[some]]), pa.array(gained[some])], ["u", "v", "gained"])

    found = materialize(dealt.mapInArrow(work, "u bigint, v bigint, gained bigint"), "links")
    gained = found.groupBy(F.col("u").alias("cid")).agg(F.sum("gained").alias("gained"))
    linked = components(found.where("u <> v"))
    named = classes.select("cid", "first", "members", "k1", "k2").join(gained, "cid", "left").join(linked.withColumnRenamed("node", "cid"), "cid", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "cid")), "named")
    least = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = named.join(least, "component").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("members") - 1 + F.coalesce("gained", F.lit(0))).alias("links"), "component_id")
    named = materialize(named, "named")
    joined = rows.join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    alone = F.col("k1").isNull()
    result = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return result.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
