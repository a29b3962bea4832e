"""Counts, percentiles and profiles that the reports are made of. All exact.

``percentile`` keeps a count for each different value in one buffer, which suits counts per record, as few sizes occur.
``quantiles`` suits values that are all different: it never holds a group's values in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.storage import settled


def percentile(column: str | Column, fraction: float, times: Column | int = 1) -> Column:
    """Interpolated percentile, of each value as often as ``times`` says; 0 where there are no values."""
    return F.coalesce(F.percentile(column, F.lit(fraction), times), F.lit(0.0))


def value_counts(rows: DataFrame, *keys: str, by_key: bool = False, times: Column | None = None) -> DataFrame:
    """Rows per value, each as often as ``times`` says, most frequent first and equal ones by value; or ordered by value."""
    counts = rows.groupBy(*keys).agg((F.count("*") if times is None else F.sum(times)).alias("n"))
    return counts.orderBy(*keys) if by_key else counts.orderBy(F.desc("n"), *keys)


def describe(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    quartiles = [F.percentile(c, F.lit(q)).alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return rows.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *quartiles, F.max(c).alias("max"))


def five_numbers(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return rows.agg(F.min(c).alias("min"), *[percentile(c, q).alias(n) for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))], F.max(c).alias("max"))


def size_report(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Total, mean, median, p90, p95, p99 and max; per group of ``keys`` if given."""
    c = F.col(column)
    tops = [percentile(c, q).alias(n) for q, n in ((0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))]
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(c), F.lit(0)).alias("total"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), *tops, F.coalesce(F.max(c), F.lit(0)).alias("max"))


def quantiles(rows: DataFrame, value: str, fractions: dict[str, float], keys: list[str], times: Column | None = None) -> DataFrame:
    """(*keys, n, min, max, and a column for each fraction): exact interpolated quantiles of each group's values that aren't null.

    Different values with their counts are dealt to ranges. Counts of the ranges tell in which of them a rank lies; only these
    are read again, and counted up to the rank. Groups without values have no row; of keys, null is a value. A row counts as
    often as ``times`` says.
    """
    name = "_value"
    each = F.lit(1).cast("long") if times is None else times
    counts = rows.select(*keys, F.col(value).cast("double").alias(name), each.alias("_n")).filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.sum("_n").alias("_c"))
    ranged = settled(counts.repartitionByRange(*keys, name).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_size"), F.min(name).alias("_min"), F.max(name).alias("_max"))
    parts = parts.select(*keys, "_part", "_size", (F.sum("_size").over(group.orderBy("_part")) - F.col("_size")).alias("_before"), F.sum("_size").over(group).alias("n"), F.min("_min").over(group).alias("min"), F.max("_max").over(group).alias("max"))
    at = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*[f(at(q)).cast("long") for q in fractions.values() for f in (F.floor, F.ceil)]))
    inside = lambda r, first, size: (r >= first) & (r < first + size)
    wanted = parts.withColumn("_ranks", F.filter(ranks, lambda r: inside(r, F.col("_before"), F.col("_size")))).filter(F.size("_ranks") > 0)
    other = lambda df: df.withColumnsRenamed({k: f"_of_{k}" for k in (*keys, "_part")})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_part")]
    read = ranged.join(other(wanted), same).select(*keys, "_part", name, "_c", "_before", "_ranks")
    first = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy(name)) - F.col("_c")
    hit = read.withColumn("_first", first).withColumn("_hit", F.filter("_ranks", lambda r: inside(r, F.col("_first"), F.col("_c")))).filter(F.size("_hit") > 0)
    found = hit.groupBy(*keys).agg(F.map_from_entries(F.flatten(F.collect_list(F.transform("_hit", lambda r: F.struct(r, F.col(name)))))).alias("_of"))
    totals = parts.select(*keys, "n", "min", "max").distinct()
    both = totals.join(other(found), same[:-1]) if keys else totals.crossJoin(found)  # a row each
    low, high = (lambda q: F.col("_of")[F.floor(at(q)).cast("long")]), (lambda q: F.col("_of")[F.ceil(at(q)).cast("long")])
    between = lambda q: low(q) + (high(q) - low(q)) * (at(q) - F.floor(at(q)))
    return both.select(*keys, "n", "min", *[between(q).alias(c) for c, q in fractions.items()], "max")


def distribution(rows: DataFrame, value: str, *keys: str, times: Column | None = None) -> DataFrame:
    """n, min, median, p90 and max of a column per group."""
    return quantiles(rows, value, {"median": 0.5, "p90": 0.9}, list(keys), times)


def profile(rows: DataFrame) -> DataFrame:
    """(column_name, rows, missing): per column, rows and nulls, in one pass."""
    one = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(rows.columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(rows.columns)])
    return one.select("rows", F.explode(each).alias("x")).select("x.column_name", "rows", "x.missing")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """One row: how many rows repeat a key that another row has."""
    return rows.agg((F.count("*") - F.countDistinct(key)).alias("duplicates"))
