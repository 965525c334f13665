"""Column profiles, histogram shapes, value fingerprints and traffic statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import running_sum


def column_profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """column_name, n, non_null, nulls, cardinality, smallest, largest (as text, in the column's own order).

    The plain measures are one aggregate over all columns. Distinct values are counted by unpivoting to
    (column, value) and grouping with partial aggregates, so no column's values multiply the others' rows;
    ``approximate`` takes a sketch in the first pass instead.
    """
    measures = []
    for i, c in enumerate(columns):
        measures += [F.count(F.col(c)).alias(f"n{i}"), F.min(c).cast("string").alias(f"s{i}"), F.max(c).cast("string").alias(f"l{i}")]
        if approximate:
            measures.append(F.approx_count_distinct(c).alias(f"d{i}"))
    one = df.agg(F.count(F.lit(1)).alias("n"), *measures)
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n"), F.col(f"n{i}").alias("non_null"), (F.col("n") - F.col(f"n{i}")).alias("nulls"), F.col(f"s{i}").alias("smallest"), F.col(f"l{i}").alias("largest"), *([F.col(f"d{i}").alias("cardinality")] if approximate else [])) for i, c in enumerate(columns)])
    rows = one.select(F.explode(parts).alias("p")).select("p.*")
    if approximate:
        return rows.select("column_name", "n", "non_null", "nulls", "cardinality", "smallest", "largest")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    distinct = df.select(F.explode(cells).alias("p")).select("p.*").where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("k"))
    counts = distinct.groupBy("column_name").agg(F.count(F.lit(1)).alias("cardinality"))
    return rows.join(F.broadcast(counts), "column_name", "left").select("column_name", "n", "non_null", "nulls", F.coalesce("cardinality", F.lit(0)).alias("cardinality"), "smallest", "largest")


def equi_depth(df: DataFrame, column: str, steps: int) -> DataFrame:
    """step, equal_rows (of the step's highest value), range_rows, distinct_range_rows, range_high_key.

    Values are counted first; a value falls whole into the step in which its first row lies.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    total = values.agg(F.sum("k")).first()[0] or 0
    placed = running_sum(values, "v", "k", "upto").withColumn("step", F.floor((F.col("upto") - F.col("k")) * steps / max(total, 1)).cast("int"))
    top = placed.groupBy("step").agg(F.max_by("k", "v").alias("equal_rows"), F.max("v").alias("range_high_key"), F.sum("k").alias("rows"), F.count(F.lit(1)).alias("values"))
    return top.select("step", "equal_rows", (F.col("rows") - F.col("equal_rows")).alias("range_rows"), (F.col("values") - 1).alias("distinct_range_rows"), "range_high_key")


def histogram_shape(df: DataFrame, column: str, steps: int = 50) -> DataFrame:
    """One row: cardinality_ratio, repeatability (mean rows of a step's highest value), discreteness (share of steps without a range), range_density."""
    histogram = equi_depth(df, column, steps)
    rows = F.sum(F.col("equal_rows") + F.col("range_rows"))
    return histogram.agg(
        F.round(F.sum(F.col("distinct_range_rows") + 1) / rows, 6).alias("cardinality_ratio"),
        F.round(F.avg("equal_rows"), 4).alias("repeatability"),
        F.round(F.avg((F.col("range_rows") == 0).cast("double")), 6).alias("discreteness"),
        F.round(F.sum("range_rows") / F.greatest(F.sum("distinct_range_rows"), F.lit(1)), 4).alias("range_density"),
    )


def overlap(a: DataFrame, b: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """One row: values of each side and of both, containment of ``a`` in ``b``, and their Jaccard index. Exact."""
    both = a.select(F.col(column_a).alias("v"), F.lit(1).alias("s")).unionByName(b.select(F.col(column_b).alias("v"), F.lit(2).alias("s"))).where("v is not null")
    sides = both.groupBy("v").agg(F.bit_or("s").alias("s"))
    counts = sides.agg(F.count_if(F.col("s").isin(1, 3)).alias("in_a"), F.count_if(F.col("s").isin(2, 3)).alias("in_b"), F.count_if(F.col("s") == 3).alias("in_both"))
    return counts.select("*", F.round(F.try_divide("in_both", "in_a"), 6).alias("containment"), F.round(F.try_divide(F.col("in_both"), F.col("in_a") + F.col("in_b") - F.col("in_both")), 6).alias("jaccard"))


def sketch(df: DataFrame, column: str) -> DataFrame:
    """A theta sketch of a column's values: kept once, compared with many."""
    return df.agg(F.theta_sketch_agg(column).alias("sketch"))


def sketch_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Estimated containment and Jaccard index of two one-row sketch tables."""
    both = a.select(F.col("sketch").alias("a")).crossJoin(b.select(F.col("sketch").alias("b")))
    size = lambda e: F.theta_sketch_estimate(e)
    met, joined = size(F.theta_intersection("a", "b")), size(F.theta_union("a", "b"))
    return both.select(F.try_divide(met, size(F.col("a"))).alias("containment"), F.try_divide(met, joined).alias("jaccard"))


def traffic_stats(requests: DataFrame, host: list[str], size: str, millis: str, status: str, cached: str | None = None) -> DataFrame:
    """Requests, bytes, least, greatest and mean time of each host, with a map of counts by status."""
    by_status = requests.groupBy(*host, status).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), F.min(millis).alias("lo"), F.max(millis).alias("hi"), F.sum(millis).alias("t"), *([F.count_if(F.col(cached)).alias("c")] if cached else []))
    out = by_status.groupBy(*host).agg(
        F.sum("n").alias("requests"), F.round(F.sum("b"), 2).alias("bytes"), F.min("lo").alias("min_ms"), F.max("hi").alias("max_ms"), F.round(F.sum("t") / F.sum("n"), 4).alias("avg_ms"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(status), F.col("n"))))).alias("statuses"), *([(F.sum("c") / F.sum("n")).alias("hit_rate")] if cached else []),
    )
    return out


def distribution(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """Rows of each value, the most frequent first; the ``top`` ones if given."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counted if top is None else counted.orderBy(F.desc("n"), *columns).limit(top)


def ordered_list(df: DataFrame, group: list[str], value: str, order: list[str], separator: str = ",", name: str = "list") -> DataFrame:
    """A group's values in order as one text."""
    return df.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).cast("string").alias("v")))), lambda x: x["v"]), separator).alias(name))


def ranked(df: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group; limits are applied before rows are shuffled."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= limit)
