"""Merging sources: keep-first rows, source priority, filling from another source, splits.

Keep-first is one aggregation (the least ordering struct per key), not a window: it is
combined before the shuffle, so a key that fills a third of the table costs nothing extra.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first by order; rows with a null key are all kept out."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    best = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_r")))
    return picked.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b._r.*").select(*df.columns)


def priority(col: Column, names: tuple[str, ...]) -> Column:
    """Place of a value in a list, the list's length for any other."""
    return F.coalesce(*[F.when(col == n, F.lit(i)) for i, n in enumerate(names)], F.lit(len(names)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fill_from(df: DataFrame, source: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the least value that source holds for the row's key (null where it has none)."""
    least = source.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(name))
    return df.join(least, key, "left")


def todo(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not done yet."""
    return wanted.join(done, keys, "left_anti")
