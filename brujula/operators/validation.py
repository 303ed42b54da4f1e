"""Row validation: bad rows are listed with every problem, the load never fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text dates that count as readable: ISO 8601, year first (a fixed pattern).
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
ID_PATTERN = r"^N-[0-9a-f]{10}$"
URL_PATTERN = r"^https?://[^/?#]*\.[^/?#]*"


def iso_timestamp(col: Column) -> Column:
    """UTC timestamp of an ISO 8601 text, null for anything else; a bare cast would also read '10:00' as today."""
    full = F.regexp_replace(col, r"([T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")  # the cast wants seconds before an offset
    return F.when(col.rlike(ISO_DATE), F.try_to_timestamp(full))


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def issues(df: DataFrame, key: str, required: list[str], dates: list[str], url: str, ident: str, allowed: dict[str, tuple[str, ...]], seen: tuple[str, str, tuple[str, ...], str] | None = None) -> DataFrame:
    """key, campo, problema of every problem of every row; a repeated id is reported on all rows but its first.

    seen: (date field, origin field, origins that have no such date of their own, origin that has): rows of the
    former may only carry the earliest date that the latter gives for their id.
    """
    found = [F.when(blank_to_null(F.col(c)).isNull(), F.struct(F.lit(c).alias("campo"), F.lit("vacío").alias("problema"))) for c in required]
    found += [F.when(F.col(c).isNotNull() & iso_timestamp(F.col(c)).isNull(), F.struct(F.lit(c).alias("campo"), F.lit("fecha inválida").alias("problema"))) for c in dates]
    found.append(F.when(F.col(url).isNotNull() & ~F.col(url).rlike(URL_PATTERN), F.struct(F.lit(url).alias("campo"), F.lit("URL rota").alias("problema"))))
    found.append(F.when(F.col(ident).isNotNull() & ~F.col(ident).rlike(ID_PATTERN), F.struct(F.lit(ident).alias("campo"), F.lit("ID inválido").alias("problema"))))
    found += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*names), F.struct(F.lit(c).alias("campo"), F.lit("fuera de lista").alias("problema"))) for c, names in allowed.items()]
    single = df.select(key, F.explode(F.array_compact(F.array(*found))).alias("x")).select(key, "x.*")
    good = df.filter(F.col(ident).rlike(ID_PATTERN)).select(key, ident)
    first = good.groupBy(ident).agg(F.min(key).alias("_first"))
    again = good.join(first, ident).filter(F.col(key) != F.col("_first")).select(key, F.lit(ident).alias("campo"), F.lit("duplicado").alias("problema"))
    out = single.unionByName(again)
    if seen:
        field, origin, without, source = seen
        dated = df.select(key, ident, origin, iso_timestamp(F.col(field)).alias("_t")).filter("_t IS NOT NULL")
        known = dated.filter((F.col(origin) == source) & F.col(ident).isNotNull()).groupBy(ident).agg(F.min("_t").alias("_seen"))
        own = dated.filter(F.col(origin).isin(*without)).join(known, ident, "left").filter(F.col("_seen").isNull() | (F.col("_seen") != F.col("_t")))
        out = out.unionByName(own.select(key, F.lit(field).alias("campo"), F.concat_ws(" en ", F.lit(field), origin).alias("problema")))
    return out


def split(df: DataFrame, problems: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows)."""
    bad = problems.select(key).distinct()
    return df.join(bad, key, "left_anti"), df.join(bad, key, "left_semi")


def null_counts(df: DataFrame) -> DataFrame:
    """columna, nulos of every column, in one pass."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(f"`{c}`").alias("nulos")) for c in df.columns])).alias("x")).select("x.*")
