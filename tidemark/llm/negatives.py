"""Hard negatives by ball-tree branch and bound.

Components are scaled and floored, so that inner products are whole numbers. Rows are cut into chunks of one label
that lie together: ranges of (length, label, signs of a rotation), with a row number last, so that a label or a
vector that many rows share fills many tasks. Anchors, the rows asked about, are dealt into blocks of like signs.
A block and the chunks of a range meet in a task, which holds the block and one chunk at a time. Each chunk gets a
ball tree, and for every node a centre and a radius bound the inner products with an anchor from above and below:
nodes whose bounds lie outside an anchor's score window, or strictly beneath its current k-th score, are pruned for
that anchor. What an anchor has found stays with it over the chunks of a task. Blocks and chunks have balls, too: pairs
that can't reach any window of the block never meet.

The first search finds each anchor's positives: its best rows of the same label. The second finds, for each positive,
the best rows of another label in the window that the positive's score gives. Results are exact.

Edge cases: rows whose label or vector is null, or that hold a null or non-finite component, take no part; vectors of
different lengths do not meet; vectors may be empty (their products are 0); a null id is no anchor, comes last among
ties and is null in the result (the largest long is taken for null too); repeated rows count one by one, and a copy of
an anchor is another row; a positive whose score is negative has no window; an anchor without positives or negatives
gives no rows; an empty table gives none. Scores beyond 64 bits are held to the ends of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slim
from tidemark.llm.embeddings import matrix, rotated
from tidemark.session import materialize

#: Rows of a leaf.
LEAF = 64
NO_ID, NO_SCORE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: Whole numbers of a float64 are exact up to here.
EXACT = float(1 << 53)


def inner(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, rows by anchors."""
    if not rows.shape[1]:
        return np.zeros((len(rows), len(anchors)), np.int64)
    most = np.abs(rows).max(initial=0.0) * np.abs(anchors).max(initial=0.0) * rows.shape[1]
    if most < EXACT:
        return (rows @ anchors.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(rows) @ whole(anchors).T, NO_SCORE + 1, NO_ID).astype(np.int64)


class BallTree:
    """Nodes over rows that are ordered so that a node is a range; the children of node i are 2i+1 and 2i+2."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.arange(len(vectors))
        self.nodes: dict[int, tuple[int, int, np.ndarray, float]] = {}
        waiting = [(0, 0, len(vectors))]
        while waiting:
            node, start, end = waiting.pop()
            own = vectors[self.order[start:end]]
            centre = own.mean(axis=0)
            self.nodes[node] = (start, end, centre, float(np.sqrt(((own - centre) ** 2).sum(axis=1).max(initial=0.0))))
            if end - start > LEAF and self.nodes[node][3] > 0:
                # Split between the row farthest from the centre and the row farthest from that one.
                one = own[((own - centre) ** 2).sum(axis=1).argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                # Each row goes to the nearer one, or, where that leaves a side too little, to one half.
                along = own @ (one - other)
                middle = int((along < (one @ one - other @ other) / 2).sum())
                if min(middle, end - start - middle) < LEAF // 16:
                    middle = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(along, middle)]
                waiting += [(2 * node + 1, start, start + middle), (2 * node + 2, start + middle, end)]


class Search:
    """The best ``k`` rows of each slot of each anchor: a slot is a window of scores, both ends included."""

    def __init__(self, vectors: np.ndarray, rids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.vectors, self.rids, self.labels, self.low, self.high, self.same = vectors, rids, labels, low, high, same
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.score = np.full((*low.shape, k), NO_SCORE, np.int64)
        self.ids, self.found = np.full((*low.shape, k), NO_ID, np.int64), np.full((*low.shape, k), -1, np.int64)

    def reach(self, active: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
        """Which of the anchors may find something better in a ball."""
        middle = self.vectors[active] @ centre
        # Room for the rounding of centres and products.
        spread = radius * self.norms[active] + 1e-9 * (np.abs(middle) + (radius + np.sqrt((centre * centre).sum())) * self.norms[active]) + 1e-6
        least = np.maximum(self.low[active], self.score[active][:, :, -1])
        # Bounds that overflow prune nothing.
        return (~((middle + spread)[:, None] < least) & ~((middle - spread)[:, None] > self.high[active])).any(axis=1)

    def leaf(self, active: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        scores = inner(vectors, self.vectors[active]).T  # anchors by rows
        least = np.maximum(self.low[active], self.score[active][:, :, -1])
        fits = (scores[:, None, :] >= least[:, :, None]) & (scores[:, None, :] <= self.high[active][:, :, None])
        fits &= (rids[None, :] != self.rids[active][:, None])[:, None, :]
        a, s = np.nonzero(fits.any(axis=2))
        if not len(a):
            return
        rows = active[a]
        k = self.score.shape[2]
        all_scores = np.concatenate([self.score[rows, s], np.where(fits[a, s], scores[a], NO_SCORE)], axis=1)
        all_ids = np.concatenate([self.ids[rows, s], np.where(fits[a, s], ids, NO_ID)], axis=1)
        all_rids = np.concatenate([self.found[rows, s], np.where(fits[a, s], rids, -1)], axis=1)
        # Higher scores first; -1 - x turns the order round without leaving 64 bits.
        best = np.lexsort((all_ids, -1 - all_scores), axis=1)[:, :k]
        for held, every in ((self.score, all_scores), (self.ids, all_ids), (self.found, all_rids)):
            held[rows, s] = np.take_along_axis(every, best, axis=1)

    def visit(self, vectors: np.ndarray, ids: np.ndarray, rids: np.ndarray, label: object) -> None:
        """One chunk of one label, depth first, the child that promises more first."""
        active = np.flatnonzero((self.labels == label) == self.same)
        tree = BallTree(vectors)
        waiting = [(0, active)]
        while waiting:
            node, active = waiting.pop()
            start, end, centre, radius = tree.nodes[node]
            active = active[self.reach(active, centre, radius)] if len(active) else active
            if not len(active):
                continue
            if 2 * node + 1 in tree.nodes:
                sides = [2 * node + 1, 2 * node + 2]
                promise = [(self.vectors[active] @ tree.nodes[n][2]).mean() for n in sides]
                first, second = sides if promise[0] >= promise[1] else sides[::-1]
                waiting += [(second, active), (first, active)]
                continue
            for at in range(start, end, LEAF):  # a leaf of equal vectors may be long
                rows = tree.order[at : min(end, at + LEAF)]
                self.leaf(active, vectors[rows], ids[rows], rids[rows])


def usable() -> str:
    return "label is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def in_pieces(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``piece`` and ``part``: pieces of at most ``most`` rows of one length and label that lie together."""
    keys = ["dim", "label", "code", "salt"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, held, key = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            numbers = []
            for now in zip(batch.column("dim").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if now != key or held == most:
                    key, held, piece = now, 0, piece + 1
                held += 1
                numbers.append((part << 32) + piece)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array([part] * len(numbers), pa.int32())], [*batch.schema.names, "piece", "part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return materialize(dealt.mapInArrow(cut, f"{schema}, piece bigint, part int"), "pieces")


def in_blocks(anchors: DataFrame, by: list[str], size: int) -> DataFrame:
    """``anchors`` with ``block``: about ``size`` of one ``by`` and of neighbouring codes.

    An anchor's place is that of its code, by the counts of codes, and a hash within it: no sort, and a code that many share
    is dealt evenly.
    """
    codes = anchors.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))  # at most 65,536 for each ``by``
    earlier = Window.partitionBy(*by).orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    codes = materialize(codes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "codes")
    share = F.pmod("salt", F.lit(1 << 20)) / F.lit(float(1 << 20))
    number = F.floor((F.col("before") + F.floor(F.col("n") * share)) / F.lit(size))
    return materialize(anchors.join(codes, [*by, "code"]).withColumn("block", F.concat_ws("/", "dim", number, *by[1:])).drop("n", "before"), "blocks")


def balls(rows: DataFrame, piece: str, low: Column, high: Column) -> DataFrame:
    """dim, label, part, piece with centre, radius and the outer ends of its windows: a row for each piece and label, or a few."""
    placed = rows.select("dim", "label", "part", F.col(piece).alias("piece"), "vector", low.alias("low"), high.alias("high"))
    names = {f.name: f.dataType.simpleString() for f in placed.schema.fields}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pieces follow one another; of one that is spread over batches, each batch gives a ball.
        for batch in batches:
            pieces = list(zip(batch.column("piece").to_pylist(), batch.column("label").to_pylist(), strict=True))
            cuts = [i for i in range(len(pieces) + 1) if i in (0, len(pieces)) or pieces[i] != pieces[i - 1]]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                own, first = batch.slice(s, e - s), batch.slice(s, 1)
                vectors = matrix(own.column("vector"))
                centre = vectors.mean(axis=0)
                radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max(initial=0.0)))
                ends = [min(own.column("low").to_pylist()), max(own.column("high").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(first.column(c) for c in ("dim", "label", "part", "piece")), pa.array([centre], pa.list_(pa.float64())), pa.array([radius]), pa.array(ends[:1], pa.int64()), pa.array(ends[1:], pa.int64())], ["dim", "label", "part", "piece", "centre", "radius", "low", "high"])

    return materialize(placed.mapInArrow(measure, f"dim int, label {names['label']}, part int, piece {names['piece']}, centre array<double>, radius double, low bigint, high bigint"), "balls")


def meeting(blocks: DataFrame, chunks: DataFrame, same: bool) -> DataFrame:
    """block, piece, part: the chunks that a block has to see, by the bounds of their balls."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, p: total + p)
    length = lambda side: F.sqrt(dot(F.col(f"{side}.centre"), F.col(f"{side}.centre")))
    b, c = blocks.alias("b"), chunks.alias("c")
    on = [F.col("b.dim") == F.col("c.dim"), (F.col("b.label") == F.col("c.label")) if same else (F.col("b.label") != F.col("c.label"))]
    middle = dot(F.col("b.centre"), F.col("c.centre"))
    spread = F.col("b.radius") * length("c") + F.col("c.radius") * length("b") + F.col("b.radius") * F.col("c.radius")
    spread = spread * (1 + 1e-9) + F.abs(middle) * 1e-9 + 1.0
    known = ~F.isnan(middle) & ~F.isnan(spread) & (spread < float("inf"))
    met = b.join(c, on).where(~known | ((middle + spread >= F.col("b.low")) & (middle - spread <= F.col("b.high"))))
    return met.select(F.col("b.piece").alias("block"), F.col("c.piece").alias("piece"), F.col("c.part").alias("part")).distinct()


def search(anchors: DataFrame, rows: DataFrame, chunks: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor (its rid), slot, score, id, rid of the best ``k`` rows of each slot, up to ``k`` from each task.

    ``anchors`` has rid, dim, label, vector, block, lows, highs (the windows of its slots).
    """
    gathered = anchors.withColumn("part", F.lit(0)).repartition("block").sortWithinPartitions("block", "label")
    blocks = balls(gathered, "block", F.array_min("lows"), F.array_max("highs"))
    pairs = materialize(meeting(blocks, chunks, same), "pairs")
    none = F.array().cast("array<bigint>")
    columns = ["block", "part", "kind", "piece", "label", "rid", "id", "vector", "lows", "highs"]
    asked = anchors.join(pairs.select("block", "part").distinct(), "block").withColumn("kind", F.lit(0)).withColumn("piece", F.lit(-1).cast("bigint"))
    seen = rows.join(pairs.select("block", "piece"), "piece").withColumn("kind", F.lit(1)).withColumn("lows", none).withColumn("highs", none)
    group = ["block", "part"]
    dealt = asked.select(*columns).unionByName(seen.select(*columns)).repartition(*group).sortWithinPartitions(*group, "kind", "piece")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Search | None = None
        held: list[pa.RecordBatch] = []
        key = None

        def take() -> tuple:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            column = lambda c: table.column(c).combine_chunks()
            return matrix(column("vector")), column("rid").to_numpy(), column("id").to_numpy(), np.array(column("label").to_pylist()), column

        def close() -> None:
            nonlocal state
            if not held:
                return
            vectors, rids, ids, labels, column = take()
            if key[2] == 0:
                low, high = (np.array(column(c).to_pylist(), np.int64) for c in ("lows", "highs"))
                state = Search(vectors, rids, labels, low, high, k, same)
            else:
                state.visit(vectors, ids, rids, labels[0])

        def out() -> Iterator[pa.RecordBatch]:
            if state is not None:
                a, s, r = np.nonzero(state.found >= 0)
                for i in range(0, len(a), 1 << 16):
                    at = tuple(x[i : i + (1 << 16)] for x in (a, s, r))
                    yield pa.RecordBatch.from_arrays([pa.array(state.rids[at[0]]), pa.array(at[1].astype(np.int32)), *(pa.array(x[at]) for x in (state.score, state.ids, state.found))], ["anchor", "slot", "score", "id", "rid"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "part", "kind", "piece")]
            keys = list(zip(*columns, strict=True))
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != key:
                    close()
                    if key is not None and keys[start][:2] != key[:2]:
                        yield from out()
                        state = None
                    key = keys[start]
                held.append(batch.slice(start, end - start))
                start = end
        close()
        yield from out()

    return dealt.mapInArrow(work, "anchor bigint, slot int, score bigint, id bigint, rid bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "rid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine_hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    scale: float = 256.0,
    chunk_bytes: int = 16 << 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``. A negative's score lies between ``least`` and ``most`` per cent
    of the positive's. A chunk holds at most ``chunk_bytes`` of vectors.
    """
    source = slim(table, id=vec_id, vector=vector, label=label)
    good = source.where(usable()).select(F.coalesce(F.col("id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("id").isNotNull().alias("named"), "label", F.col("vector").cast("array<double>").alias("vector"))
    good = good.withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")).withColumn("salt", F.xxhash64("rid"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                vectors = np.floor(scale * matrix(some.column("vector"))).reshape(some.num_rows, dim)
                spun = rotated(vectors) if dim else np.zeros((some.num_rows, 1))
                signs = (spun[:, :16] > 0) @ (1 << np.arange(min(16, spun.shape[1])))
                cells = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * dim), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("named"), some.column("label"), cells, some.column("rid"), some.column("dim"), some.column("salt"), pa.array(signs.astype(np.int64))], [*some.schema.names, "code"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in good.schema.fields)
    rows = materialize(good.mapInArrow(code, f"{schema}, code bigint"), "vectors")
    widest = rows.agg(F.coalesce(F.max("dim"), F.lit(1))).first()[0] or 1
    size = max(LEAF, chunk_bytes // (8 * widest))
    chunked = in_pieces(rows, size)
    chunks = balls(chunked, "piece", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    anchors, most_asked = rows.where(F.col("named") & is_anchor), max(LEAF, size // 4)
    everything = lambda value: F.array(F.lit(int(value)).cast("bigint"))
    open_ = anchors.withColumn("lows", everything(NO_SCORE + 1)).withColumn("highs", everything(NO_ID))
    first = search(in_blocks(open_, ["dim", "label"], most_asked), chunked, chunks, positives, True)
    near = materialize(best(first, positives).select("anchor", "place", "score", F.col("id").alias("positive_id")), "positives")
    # A window with no room above its low end takes nothing; slots of an anchor are its positives in order.
    window = near.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("slots"))
    low = F.transform("slots", lambda s: F.ceil(s["score"].cast("decimal(38,0)") * least / 100).cast("bigint"))
    high = F.transform("slots", lambda s: F.floor(s["score"].cast("decimal(38,0)") * most / 100).cast("bigint"))
    pad = lambda column, value: F.concat(column, F.array_repeat(F.lit(int(value)).cast("bigint"), F.lit(positives) - F.size(column)))
    asked = anchors.join(window.withColumnRenamed("anchor", "rid"), "rid").withColumn("lows", pad(low, NO_ID)).withColumn("highs", pad(high, NO_SCORE)).drop("slots")
    second = search(in_blocks(materialize(asked, "asked"), ["dim"], most_asked), chunked, chunks, negatives, False)
    far = best(second, negatives).select("anchor", (F.col("slot") + 1).alias("at"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = rows.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    result = far.join(near, (far["anchor"] == near["anchor"]) & (far["at"] == near["place"])).drop(near["anchor"]).join(named, "anchor")
    or_null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return result.select("anchor_id", or_null("positive_id"), F.col("rank").cast("int").alias("rank"), or_null("negative_id"), F.col("score").alias("positive_score"), "negative_score")
