"""Balanced label propagation: linked documents drift to the shard of their neighbours, sizes stay even.

Documents with equal texts are linked. Every document starts in a shard by hash. In each round a group's
members outside its largest shard ask to move there; opposite requests of two shards (and rings of three) are
granted against each other, the others up to the room that the shard's quota leaves, those that gain most
neighbours first. Rounds go on until they keep no more links together. What a round needs is a group's count in each shard, so no edge of
a group is ever written out, and a group of a third of all rows is at most one row per shard. Groups larger
than a quota gather in as few shards as hold them. Documents without links fill what room is left, so the
counts of any two shards differ by at most one (law ``rows``).

Positions are counted within hash buckets and added up over the buckets' totals; no sort holds a whole shard
or group. All of it is DataFrame operations; the driver sees totals per shard
and pair of shards.

Edge cases: a null text has no bytes, crc 0 and no links; an empty text links with other empty texts; rows
that repeat in id and text are linked and interchangeable; a null id is hashed like any value; an empty
table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slim
from tidemark.session import discard, materialize

OVERHEAD = 16
#: Rows of a bucket in which positions are counted, and groups of a bucket in which grants are dealt.
BUCKET_ROWS, BUCKET_GROUPS = 20_000, 1_000_000
#: Buckets of a small table: enough to keep all tasks busy.
LEAST_BUCKETS = 64
GROUP = ["text_hash", "text_crc32"]


def positions(rows: DataFrame, group: list[str], name: str, buckets: int) -> DataFrame:
    """``rows`` with ``name``: a gapless number from 0 within each group, counted bucket by bucket.

    Buckets are hashed with ``name``: shards are given out by position, so with one hash for positions and slots
    a shard would hold few buckets, and each of them whole.
    """
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(name), "doc_id", "text_hash"), F.lit(buckets)))
    key = [*group, "bucket"]
    totals = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
    over = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"at_{c}") for c in key], F.coalesce(F.sum("held").over(over), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "text_hash", "text_crc32", "size")) - 1
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"at_{c}"))
    return dealt.withColumn("own", own).join(before, same).withColumn(name, (F.col("before") + F.col("own")).cast("bigint")).drop("bucket", "own", "before", *[f"at_{c}" for c in key])


def by_shard(values: list[int]) -> Column:
    """The value of each row's shard."""
    return F.get(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), F.col("shard"))


def loads(state: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [int(found.get(s, 0)) for s in range(shards)]


def kept_links(state: DataFrame) -> int:
    """Linked pairs whose documents share a shard."""
    return int(state.agg(F.sum((F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)"))).first()[0] or 0) // 2


def grants(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the members that ask to move from one shard to another may: opposite requests, rings of three, then spare room."""
    left, granted, room = dict(asked), dict.fromkeys(asked, 0), list(room)

    def grant(pairs: list[tuple[int, int]], n: int) -> None:
        for pair in pairs:
            left[pair] -= n
            granted[pair] += n

    for x, y in sorted(asked):
        if x < y and (y, x) in left:
            grant([(x, y), (y, x)], min(left[x, y], left[y, x]))
    after: dict[int, list[int]] = {}
    for x, y in sorted(asked):
        after.setdefault(x, []).append(y)
    for x, y in sorted(asked):
        for z in after.get(y, ()):
            if left[x, y] and left[y, z] and left.get((z, x)):
                grant([(x, y), (y, z), (z, x)], min(left[x, y], left[y, z], left[z, x]))
    moved = True
    while moved:  # a member that goes leaves room
        moved = False
        for x, y in sorted(asked):
            n = min(left[x, y], room[y])
            if n > 0:
                grant([(x, y)], n)
                room[x], room[y], moved = room[x] + n, room[y] - n, True
    return granted


def propagate(state: DataFrame, quota: list[int], rounds: int, groups_per_bucket: int, patience: int = 3) -> DataFrame:
    """state: a group's count ``n`` in each shard. Members move towards their group's largest shards within quotas.

    Ends when ``patience`` rounds on end have kept no more links together, or after ``rounds``; gives the best state.
    """
    shards, floor, idle = len(quota), max(1, min(quota)), 0
    best, most = state, kept_links(state)
    for turn in range(rounds):
        room = [q - n for q, n in zip(quota, loads(state, shards), strict=True)]
        parts = max(1, state.count() // groups_per_bucket)
        whole = Window.partitionBy(*GROUP)
        # Shards with room come first, then those with most members; ties fall anew each round, so requests go both ways.
        open_ = (by_shard(room) > 0).cast("int")
        tie = F.xxhash64(*GROUP, "shard", F.lit(turn))
        ranked = state.withColumn("total", F.sum("n").over(whole)).withColumn("place", F.row_number().over(whole.orderBy(F.desc(F.col("n") * (1 + open_)), tie, "shard")))
        wide = F.least(F.ceil(F.col("total") / floor).cast("int"), F.lit(shards))
        ranked = ranked.withColumn("wide", wide).withColumn("goal", F.when(F.col("place") > F.col("wide"), F.pmod(F.col("place") - 1, F.col("wide")) + 1))
        heads = ranked.where("place <= wide").select(*[F.col(c).alias(f"to_{c}") for c in GROUP], F.col("place").alias("to_place"), F.col("shard").alias("to_shard"), F.col("n").alias("there"))
        same = (F.col("goal") == F.col("to_place")) & (F.col("text_hash") == F.col("to_text_hash")) & (F.col("text_crc32") == F.col("to_text_crc32"))
        asks = ranked.where("goal is not null").join(heads, same).select(*GROUP, "shard", "to_shard", "n", "there").withColumn("part", F.pmod(F.xxhash64(*GROUP), F.lit(parts)))
        asks = materialize(asks, "asks")
        asked = {(r["shard"], r["to_shard"], r["part"]): r["n"] for r in asks.groupBy("shard", "to_shard", "part").agg(F.sum("n").alias("n")).collect()}
        pairs: dict[tuple[int, int], int] = {}
        for (x, y, _), n in asked.items():
            pairs[x, y] = pairs.get((x, y), 0) + n
        granted, shares = grants(pairs, room), []
        for (x, y, part), n in sorted(asked.items()):  # what one part does not use goes to the next
            share = min(n, granted[x, y])
            granted[x, y] -= share
            if share:
                shares.append((x, y, part, share))
        if not shares:
            discard(asks)
            break
        allowed = state.sparkSession.createDataFrame(shares, "shard int, to_shard int, part bigint, share bigint")
        order = Window.partitionBy("shard", "to_shard", "part").orderBy(F.desc("there"), *GROUP).rowsBetween(Window.unboundedPreceding, 0)
        dealt = F.greatest(F.least(F.col("n"), F.col("share") - (F.sum("n").over(order) - F.col("n"))), F.lit(0)).cast("bigint")
        moves = asks.join(F.broadcast(allowed), ["shard", "to_shard", "part"]).withColumn("granted", dealt).where("granted > 0").select(*GROUP, "shard", "to_shard", "granted")
        moves = materialize(moves, "moves")
        flows = state.unionByName(moves.select(*GROUP, "shard", (-F.col("granted")).alias("n"))).unionByName(moves.select(*GROUP, F.col("to_shard").alias("shard"), F.col("granted").alias("n")))
        after = materialize(flows.groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).where("n > 0"), "state")
        discard(asks)
        discard(moves)
        kept = kept_links(after)
        if state is not best:
            discard(state)
        state = after
        if kept > most:
            discard(best)
            best, most, idle = after, kept, 0
        else:
            idle += 1
            if idle == patience:
                break
    if state is not best:
        discard(state)
    return best


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 60, doc_id: str = "doc_id", text: str = "text", groups_per_bucket: int = BUCKET_GROUPS) -> DataFrame:
    """doc_id, size, text_crc32, text_hash, shard and slot (gapless from 0 in its shard) of every row.

    Propagation ends after ``rounds``, or sooner once rounds keep no more links. ``groups_per_bucket`` bounds the
    groups whose requests one task puts in order; what one bucket does not use of a grant goes to the next.
    """
    source = slim(docs, doc_id=doc_id, text=text)
    rows = source.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"),
    )
    rows = materialize(rows, "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    buckets = max(LEAST_BUCKETS, total // BUCKET_ROWS)

    counted = rows.where("text_hash is not null").groupBy(*GROUP, F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    state = counted.withColumn("total", F.sum("n").over(Window.partitionBy(*GROUP))).where("total > 1").select(*GROUP, "shard", "n")
    state = propagate(materialize(state, "state"), quota, rounds, groups_per_bucket)

    # A shard that its start has overfilled keeps its quota; the rest go with the documents without links.
    held = loads(state, shards)
    if any(n > q for n, q in zip(held, quota, strict=True)):
        parts = max(1, state.count() // groups_per_bucket)
        dealt = state.withColumn("part", F.pmod(F.xxhash64(*GROUP), F.lit(parts)))
        ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = dealt.groupBy("shard", "part").agg(F.sum("n").alias("m")).select("shard", "part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before"))
        over = Window.partitionBy("shard", "part").orderBy(F.desc("n"), *GROUP).rowsBetween(Window.unboundedPreceding, 0)
        room = by_shard(quota) - F.col("before") - (F.sum("n").over(over) - F.col("n"))
        state = dealt.join(before, ["shard", "part"]).withColumn("n", F.greatest(F.least(F.col("n"), room), F.lit(0)).cast("bigint")).where("n > 0").select(*GROUP, "shard", "n")
        held = [min(n, q) for n, q in zip(held, quota, strict=True)]
    ends = Window.partitionBy(*GROUP).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    plan = state.withColumn("end", F.sum("n").over(ends)).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("plan"))
    plan = materialize(plan.select(*[F.col(c).alias(f"plan_{c}") for c in GROUP], "plan"), "plan")
    members = rows.join(plan, (F.col("text_hash") == F.col("plan_text_hash")) & (F.col("text_crc32") == F.col("plan_text_crc32")), "left").drop("plan_text_hash", "plan_text_crc32")
    members = materialize(members, "members")

    linked = positions(members.where("plan is not null"), GROUP, "position", buckets)
    linked = linked.withColumn("shard", F.get(F.filter("plan", lambda p: p["end"] > F.col("position")), F.lit(0))["shard"]).drop("plan", "position")
    linked = materialize(linked, "linked")
    free = members.where("plan is null").drop("plan").unionByName(linked.where("shard is null").drop("shard"))
    room, filled = [], 0
    for q, n in zip(quota, held, strict=True):
        filled += q - n
        room.append(filled)
    ends_of_room = F.array(*[F.lit(x).cast("bigint") for x in room])
    free = positions(free, [], "position", buckets).withColumn("shard", F.size(F.filter(ends_of_room, lambda e: e <= F.col("position"))).cast("int")).drop("position")
    placed = materialize(linked.where("shard is not null").unionByName(free), "placed")
    return positions(placed, ["shard"], "slot", buckets).select("doc_id", "size", "text_crc32", "text_hash", "shard", "slot")
