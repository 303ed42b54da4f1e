"""Writers: CSV, JSON lines, GeoJSON, append-only logs, file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _iso(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if t == "timestamp" else F.col(c).cast("string").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Deterministic CSV: rows in order, UTF-8, line feeds, null as an empty cell, dates as ISO UTC."""
    _iso(df.sortWithinPartitions(*order) if not order else df.orderBy(*order)).write.mode("overwrite").option("header", True).option("lineSep", "\n").option("emptyValue", '""').option("nullValue", "").option("escape", '"').csv(path)


def write_csv_once(df: DataFrame, path: str) -> None:
    """CSV that refuses to overwrite."""
    _iso(df).write.mode("error").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines; the job's commit makes the result appear whole or not at all."""
    _iso(df).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, states: tuple[str, ...]) -> DataFrame:
    """Appends the rows with an id and a known state to a JSON-lines log; returns the others."""
    ok = F.coalesce(F.col("estado_revision").isin(*states), F.lit(False)) & (F.trim(F.coalesce("id_caso", F.lit(""))) != "")
    df.filter(ok).write.mode("append").json(path)
    return df.filter(~ok)


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """Parquet, rows in order inside each file, replaced as a whole."""
    df.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def feature_collection(df: DataFrame) -> DataFrame:
    """One GeoJSON text (column value) of all features by time and id; for tables that fit one document."""
    entries = F.array_sort(F.collect_list(F.struct(F.coalesce("time", F.lit("")).alias("_t"), "id", _feature(df).alias("f"))))
    return df.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform(entries, lambda e: e.f).alias("features"))).alias("value"))


def _feature(df: DataFrame):
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude", "depth").alias("coordinates"))
    rest = F.struct(*[c for c in df.columns if c not in ("longitude", "latitude", "depth")])
    return F.struct(F.lit("Feature").alias("type"), F.col("id"), point.alias("geometry"), rest.alias("properties"))


def write_geojson(df: DataFrame, path: str) -> None:
    """One feature per line (newline-delimited GeoJSON), ordered by time and id."""
    df.orderBy(F.coalesce("time", F.lit("")), "id").select(F.to_json(_feature(df)).alias("value")).write.mode("overwrite").text(path)


def outlets_json(rollup: DataFrame) -> DataFrame:
    """One JSON text with a list of outlets per origin (the outlet rollup is a small table)."""
    per = rollup.groupBy("origen").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("_o"), "dominio", "n", "medio_comun"))).alias("medios"))
    return per.select("origen", F.to_json(F.struct("origen", F.transform("medios", lambda m: F.struct(m.dominio.alias("dominio"), m.n.alias("n"), m.medio_comun.alias("medio"))).alias("medios"))).alias("json"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """archivo, bytes, sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("archivo"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(now: DataFrame, then: DataFrame) -> DataFrame:
    """archivo, problema: files of `then` that are missing or differ."""
    both = then.select("archivo", F.col("sha256").alias("_s")).join(now.select("archivo", "sha256"), "archivo", "left")
    return both.filter(F.col("sha256").isNull() | (F.col("sha256") != F.col("_s"))).select("archivo", F.when(F.col("sha256").isNull(), "falta").otherwise("distinto").alias("problema"))


def quality_report(totals: DataFrame, issues: DataFrame, nulls: DataFrame) -> str:
    """Markdown of three small aggregates (rendered on the driver)."""
    t = totals.first()
    lines = [f"# Calidad\n\nLeídas {t['leidas']}, válidas {t['validas']}, rechazadas {t['rechazadas']}.\n\n| campo | problema | filas |\n| --- | --- | --- |"]
    lines += [f"| {r['campo']} | {r['problema']} | {r['filas']} |" for r in issues.orderBy("campo", "problema").collect()]
    lines += ["\n| columna | nulos |\n| --- | --- |"] + [f"| {r['columna']} | {r['nulos']} |" for r in nulls.orderBy("columna").collect()]
    return "\n".join(lines) + "\n"


def quality_counts(totals: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: leidas, validas, rechazadas, and the issues as a map from field and problem to rows."""
    per = issues.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(": ", "campo", "problema"), "filas")))).alias("problemas"))  # a row per kind of problem
    return totals.crossJoin(per).select("leidas", "validas", "rechazadas", "problemas")  # one row each


def coverage_note(df: DataFrame, when: str, start: str, end: str, days: int = 31) -> DataFrame:
    """One row: parcial, whether the dates end more than `days` short of either end of the period (false without dates)."""
    a, b = F.min(when), F.max(when)
    gap = F.expr(f"interval {days} day")
    return df.agg(F.coalesce((a - F.lit(start).cast("timestamp") > gap) | (F.lit(end).cast("timestamp") - b > gap), F.lit(False)).alias("parcial"))


def benchmark_report(ratios: DataFrame, failures: DataFrame) -> str:
    """Markdown of measured ratios (medida, numerador, denominador) and their failures (medida, caso); small aggregates, rendered on the driver."""
    lines = ["# Mediciones", "", "| medida | valor |", "| --- | --- |"]
    lines += [f"| {r['medida']} | {'sin casos' if not r['denominador'] else f'{r['numerador']}/{r['denominador']}'} |" for r in ratios.orderBy("medida").collect()]
    for r in failures.groupBy("medida").agg(F.array_sort(F.collect_list("caso")).alias("c")).orderBy("medida").collect():
        lines += ["", f"## {r['medida']}", "", *[f"- {c}" for c in r["c"]]]
    return "\n".join(lines) + "\n"
