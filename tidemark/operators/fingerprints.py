"""Columns as bucketed bitmaps of hashed values, and the search for columns that lie within others.

A value's hash is a bit among 2**24, and a column a bitmap of 32,768 bits for each bucket that it has bits in. Bitmaps
are built by one aggregation that holds no values and can be kept and compared later. A contained column has all its
bits in its container: a few bits of each column are looked up in the bitmaps of their buckets, only what holds them is
compared bitmap by bitmap, and what is left is held against the values themselves. No pairs of all columns are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Bits of a hash, and bits of a column that are looked up.
BITS, PROBES = 24, 4


def unpivoted(tables: dict[str, DataFrame]) -> DataFrame:
    """column (table.column), value (as text) of every value that is not null."""
    found: DataFrame | None = None
    for name, frame in tables.items():
        cells = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in frame.columns])).alias("cell")
        some = frame.select(cells).select("cell.*").where("value is not null")
        found = some if found is None else found.unionByName(some)
    return found


def place(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(1 << BITS))


def bitmaps(values: DataFrame) -> DataFrame:
    """column, bucket, bitmap of (column, value) rows; repeated values set one bit."""
    placed = values.select("column", place(F.col("value")).alias("place"))
    return placed.groupBy("column", F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))


def has_bit(bitmap: Column, position: Column) -> Column:
    octet = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.getbit(octet, (position % 8).cast("int")) == 1


def similarity(one: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, in_a, in_b, in_both, containment, jaccard of column pairs, by their bitmaps: counts of bits, not of values."""
    sizes = one.groupBy("column").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))
    sides = [pairs.join(one, pairs[s] == one["column"]).select("a", "b", "bucket", "bitmap") for s in ("a", "b")]
    both = sides[0].unionByName(sides[1]).groupBy("a", "b", "bucket").agg(F.bitmap_and_agg("bitmap").alias("met"), F.count(F.lit(1)).alias("sides"))
    met = both.where("sides = 2").groupBy("a", "b").agg(F.sum(F.bitmap_count("met")).alias("in_both"))
    found = pairs.join(met, ["a", "b"], "left").join(sizes.select(F.col("column").alias("a"), F.col("n").alias("in_a")), "a").join(sizes.select(F.col("column").alias("b"), F.col("n").alias("in_b")), "b")
    found = found.withColumn("in_both", F.coalesce("in_both", F.lit(0)).cast("bigint"))
    return found.withColumn("containment", F.col("in_both") / F.col("in_a")).withColumn("jaccard", F.col("in_both") / (F.col("in_a") + F.col("in_b") - F.col("in_both")))


def contained(tables: dict[str, DataFrame]) -> DataFrame:
    """a, b, n: every pair of columns where all ``n`` distinct values of ``a``, one at least, are among those of ``b``."""
    values = unpivoted(tables)
    kept = materialize(bitmaps(values), "bitmaps")
    distinct = materialize(values.distinct(), "values")
    placed = distinct.select("column", place(F.col("value")).alias("place"))
    # The least places of a column: few, whatever its size.
    probes = least_places(placed)
    looked = probes.select(F.col("column").alias("a"), F.size("places").alias("wanted"), F.explode("places").alias("place"))
    looked = looked.withColumn("bucket", F.bitmap_bucket_number("place")).withColumn("bit", F.bitmap_bit_position("place"))
    index = kept.select(F.col("column").alias("b"), "bucket", "bitmap")
    held = looked.join(index, "bucket").where((F.col("a") != F.col("b")) & has_bit(F.col("bitmap"), F.col("bit")))
    candidates = materialize(held.groupBy("a", "b", "wanted").agg(F.count(F.lit(1)).alias("held")).where("held = wanted").select("a", "b"), "candidates")
    within = materialize(similarity(kept, candidates).where("in_both = in_a").select("a", "b"), "within")
    asked = distinct.select(F.col("column").alias("a"), "value").join(within, "a")
    missing = asked.join(distinct.select(F.col("column").alias("b"), "value"), ["b", "value"], "left_anti").select("a", "b").distinct()
    counts = distinct.groupBy(F.col("column").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return within.join(missing, ["a", "b"], "left_anti").join(counts, "a").select("a", "b", "n")


def least_places(placed: DataFrame) -> DataFrame:
    """column, places: the least of each of ``PROBES`` parts of a column's places, as many as have any."""
    part = F.pmod(F.xxhash64("place"), F.lit(PROBES))
    least = placed.groupBy("column", part.alias("part")).agg(F.min("place").alias("place"))
    return least.groupBy("column").agg(F.collect_list("place").alias("places"))
