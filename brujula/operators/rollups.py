"""Group summaries: clusters, outlets, majorities, latest values, grids, time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brujula.session import cut


def majority(df: DataFrame, keys: list[str], value: str, name: str, default: str | None = None) -> DataFrame:
    """The commonest value of each group, ties alphabetically; counts are combined before the shuffle."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.max(F.when(F.col(value).isNotNull(), F.col("_n"))).alias("_m"))
    first = counts.join(best, keys).filter(F.col("_n") == F.col("_m")).filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(name))
    return best.select(*keys).join(first, keys, "left").withColumn(name, F.coalesce(name, F.lit(default)) if default else F.col(name))


def top_per_group(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """keys, value, n, puesto: the k commonest values of each group, ties alphabetically."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc_nulls_last(value))
    return counts.withColumn("puesto", F.row_number().over(w)).filter(F.col("puesto") <= k)


def complete_grid(df: DataFrame, axes: list[str], value: str) -> DataFrame:
    """All combinations of the axes' distinct values (small lists), with the value where there is one."""
    grid = None
    for axis in axes:
        one = df.select(axis).distinct()
        grid = one if grid is None else grid.crossJoin(one)
    return grid.join(df.select(*axes, value), axes, "left")


def latest_with_value(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, order, value of the last row of each key whose value isn't null."""
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(order, value)))
    return df.groupBy(*keys).agg(best.alias("b")).filter("b IS NOT NULL").select(*keys, f"b.{order}", f"b.{value}")


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with its place (from 1) in the given total order, without gathering the rows in one task.

    The rows are sorted by ranges and kept as a table with their place inside their range; the
    ranges' sizes, as many as tasks, give what is to be added.
    """
    kept = cut(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranked")
    sizes = kept.groupBy("_p").agg(F.min("_i").alias("_m"), F.count("*").alias("_n"))
    before = sizes.select("_p", "_m", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    return kept.join(before, "_p").withColumn(name, F.col("_i") - F.col("_m") + F.col("_s") + 1).drop("_p", "_i", "_m", "_s")


def months_between(first: Column, last: Column) -> Column:
    """First days of all months that [first, last] touches."""
    return F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))


def in_period(col: Column, start: str, end: str) -> Column:
    """start <= col < end; a null is outside."""
    return F.coalesce((col >= F.lit(start).cast("timestamp")) & (col < F.lit(end).cast("timestamp")), F.lit(False))


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, bucket_s: int) -> DataFrame:
    """Points inside spans, by equi-join on time buckets and the exact condition on top.

    A span is listed in every bucket that it touches; a point is in one, so no pair comes twice.
    """
    b = lambda c: F.floor(F.unix_micros(c) / (bucket_s * 1_000_000)).cast("long")
    left = points.filter(F.col(at).isNotNull()).withColumn("_b", b(F.col(at)))
    right = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_b", F.explode(F.sequence(b(F.col(start)), b(F.col(end)))))
    return left.join(right, "_b").filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")
