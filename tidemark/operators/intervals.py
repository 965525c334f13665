"""Transaction time from after-images: intervals, states as of a version or an instant, change feeds.

The store is append-only: a row is an after-image of a key with a transaction time ``tt`` and a sequence that
breaks ties. Intervals are half-open, ``[tt_start, tt_end)``; an open one has a null ``tt_end``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import previous

DELETE_OPS = ("D", "DELETE", "delete")
#: The open end in the text form of an interval.
OPEN_TEXT = "9999-12-31T00:00:00+00:00"


def different(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)


def any_different(pairs: Sequence[tuple[Column, Column]]) -> Column:
    out = F.lit(False)
    for a, b in pairs:
        out = out | different(a, b)
    return out


def deletes(op: str | None) -> Column:
    return F.lit(False) if op is None else F.col(op).isin(*DELETE_OPS)


def backlog_intervals(log: DataFrame, keys: list[str], tt: str, seq: str, op: str | None = None, stretch: str | int | None = None) -> DataFrame:
    """Intervals of a backlog: each image holds until the key's next; a delete ends one and begins none.

    ``stretch`` (a calendar unit, or a width for numbers) cuts a key's time into tasks of their own, so that a key with a third of
    all images is spread out; where a stretch ends, the next one's first time comes from one row for each key and stretch.
    """
    begun = log.withColumn("tt_start", F.col(tt))
    if stretch is None:
        bounded = begun.withColumn("tt_end", F.lead(tt).over(Window.partitionBy(*keys).orderBy(tt, seq)))
    else:
        part = F.date_trunc(stretch, tt) if isinstance(stretch, str) else F.floor(F.col(tt) / stretch)
        cut = begun.withColumn("__part", part)
        firsts = cut.groupBy(*keys, "__part").agg(F.min(tt).alias("__first"))
        following = firsts.withColumn("__next", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__part"))).drop("__first")
        same = following.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__part"])], "__next")
        inside = cut.withColumn("tt_end", F.lead(tt).over(Window.partitionBy(*keys, "__part").orderBy(tt, seq)))
        on = [inside[k].eqNullSafe(same[f"__k{i}"]) for i, k in enumerate([*keys, "__part"])]
        bounded = inside.join(same, on).withColumn("tt_end", F.coalesce("tt_end", "__next")).drop("__part", "__next", *[f"__k{i}" for i in range(len(keys) + 1)])
    return bounded.where(~F.coalesce(deletes(op), F.lit(False))) if op else bounded


def collapse_equal(log: DataFrame, keys: list[str], tt: str, seq: str, values: list[str]) -> DataFrame:
    """Intervals after runs of equal images of a key are made one: an image that changes nothing is no version."""
    order = Window.partitionBy(*keys).orderBy(tt, seq)
    first = F.row_number().over(order) == 1
    marked = log.withColumn("__new", first | any_different([(F.col(v), F.lag(v).over(order)) for v in values]))
    return backlog_intervals(marked.where("__new").drop("__new"), keys, tt, seq)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate with partial results, so a hot key is no hot task."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def state_as_of(log: DataFrame, keys: list[str], tt: str, seq: str, when: object, op: str | None = None) -> DataFrame:
    """What every key looked like at ``when``: its last image up to then, unless that is a delete."""
    upto = latest(log.where(F.col(tt) <= when), keys, [tt, seq])
    return upto.where(~F.coalesce(deletes(op), F.lit(False))) if op else upto


def current_state(log: DataFrame, keys: list[str], tt: str, seq: str, op: str | None = None) -> DataFrame:
    """Merge on read: the last image of each key; deleted keys go if ``op`` is named."""
    now = latest(log, keys, [tt, seq])
    return now.where(~F.coalesce(deletes(op), F.lit(False))) if op else now


def as_of_version(rows: DataFrame, version: int | Column, begin: str = "tt_start", end: str = "tt_end") -> DataFrame:
    """Rows whose interval holds ``version``."""
    at = version if isinstance(version, Column) else F.lit(version)
    return rows.where((F.col(begin) <= at) & (F.col(end).isNull() | (F.col(end) > at)))


def version_at(snapshots: DataFrame, when: object, version: str = "snapshot_id", label: str = "snapshot_time", strict: bool = True) -> int | None:
    """The latest version whose label is not after ``when``; None before the first.

    Labels come from sources and need not ascend with versions. Where they don't, an instant doesn't name one
    state: the call fails, unless ``strict`` is off.
    """
    if strict:
        bad = previous(snapshots.select(version, label), version, [label], "__was_").where(F.col(label) < F.col(f"__was_{label}"))
        if not bad.isEmpty():
            raise ValueError("snapshot labels do not ascend with versions; ask by version")
    return snapshots.where(F.col(label) <= when).agg(F.max(version)).first()[0]


def as_of_time(rows: DataFrame, snapshots: DataFrame, when: object, strict: bool = True, begin: str = "tt_start", end: str = "tt_end") -> DataFrame:
    """Rows as of an instant: the version of that instant, then :func:`as_of_version`."""
    version = version_at(snapshots, when, strict=strict)
    return rows.limit(0) if version is None else as_of_version(rows, version, begin, end)


def change_feed(rows: DataFrame, after: object, upto: object, begin: str = "tt_start", end: str = "tt_end") -> DataFrame:
    """Rows that began or ended in ``(after, upto]``, with ``change_type`` insert or delete."""
    begun = rows.where((F.col(begin) > after) & (F.col(begin) <= upto)).withColumn("change_type", F.lit("insert"))
    ended = rows.where((F.col(end) > after) & (F.col(end) <= upto)).withColumn("change_type", F.lit("delete"))
    return begun.unionByName(ended)


def overlaps(rows: DataFrame, keys: list[str], begin: str = "tt_start", end: str = "tt_end") -> DataFrame:
    """Intervals that begin before the one before them (of the same key) has ended: none in a sound table."""
    order = Window.partitionBy(*keys).orderBy(begin, F.col(end).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    reach, open_ = F.max(end).over(order), F.max(F.col(end).isNull()).over(order)
    return rows.withColumn("__reach", reach).withColumn("__open", open_).where((F.col("__reach") > F.col(begin)) | F.col("__open")).drop("__reach", "__open")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tie: list[str] | None = None, strict: bool = True, prefix: str = "r_", stretch: str | None = None) -> DataFrame:
    """Each left row with the last right row of its keys before it (``strict``) or not after it; nulls if none.

    Both sides are united and scanned once per key: linear in the rows, where a join with an inequality is
    quadratic in a key's rows. ``stretch`` names a calendar unit (``day``, ``hour``, ...) by which a key's
    time is cut into tasks of its own; what came before a stretch is carried over by a small aggregate, so a
    key with a third of all rows is spread out.
    """
    tie = tie or []
    right_columns = [c for c in right.columns if c not in keys]
    a = left.select(*keys, F.col(left_ts).alias("__ts"), F.lit(0 if strict else 1).alias("__side"), F.struct(*[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in tie]).alias("__tie") if tie else F.lit(0).alias("__tie"), F.struct(*left.columns).alias("__left"))
    b = right.select(*keys, F.col(right_ts).alias("__ts"), F.lit(1 if strict else 0).alias("__side"), F.struct(*tie).alias("__tie") if tie else F.lit(0).alias("__tie"), F.struct(*right_columns).alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)
    part = list(keys)
    if stretch:
        both = both.withColumn("__stretch", F.date_trunc(stretch, "__ts"))
        part.append("__stretch")
    order = Window.partitionBy(*part).orderBy("__ts", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__match", F.last("__right", ignorenulls=True).over(order))
    if stretch:
        ends = both.where("__right is not null").groupBy(*part).agg(F.max_by("__right", F.struct("__ts", "__tie")).alias("__end"))
        every = both.select(*part).distinct().join(ends, part, "left")
        carried = every.withColumn("__carry", F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))).select(*part, "__carry")
        seen = seen.join(carried, part, "left").withColumn("__match", F.coalesce("__match", "__carry"))
    return seen.where("__left is not null").select("__left.*", *[F.col(f"__match.{c}").alias(f"{prefix}{c}") for c in right_columns])
