"""Normalising date texts of mixed formats, precisions and zones to UTC instants.

Defined cases: null and blank cells are left out (or null in `normalise`); a text that
names no existing date and time is 'invalida'; an unknown outlet has no zone, so a text
without a zone of its own is then unusable; an empty table gives no row; further columns,
whatever their names, are left alone because only the named ones are selected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brujula.session import spread
from brujula.functions.dates import INVALID, iso_micros, to_utc_micros, zone_tables

NEWS_FIELDS = ("fecha_publicacion", "fecha_deteccion", "fecha_extraccion")
PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def with_outlet_zone(news: DataFrame, outlets: DataFrame, columns: list[str]) -> DataFrame:
    """columns of news with zona and mes_primero of the row's outlet (null for an unknown one).

    The outlet table is joined without a hint: Spark broadcasts it only if its size is below
    the session's threshold, else it shuffles.
    """
    o = outlets.select(F.col("dominio").alias("_dominio"), F.col("zona_horaria").alias("zona"), (F.col("orden_fecha") == "MDY").alias("mes_primero")).dropDuplicates(["_dominio"])
    return spread(news.select(*dict.fromkeys([*columns, "dominio"])), columns[0]).join(o, F.col("dominio") == F.col("_dominio"), "left").select(*columns, "zona", "mes_primero")


def outlet_zones(outlets: DataFrame, limit: int = 1000) -> dict:
    """Transition tables of the zones in use. Zone names number under 600 in the database; more than `limit` are an error."""
    names = [r[0] for r in outlets.select("zona_horaria").filter(F.col("zona_horaria").isNotNull()).distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} time zones")
    return zone_tables(names)


def field_micros(batch: pa.RecordBatch, name: str, local: bool, tables: dict) -> np.ndarray:
    """UTC microseconds of one date column of a batch that has zona and mes_primero."""
    values = batch.column(name)
    zones = batch.column("zona") if local else pa.array(["UTC"] * len(values), type=pa.string())
    first = pc.fill_null(batch.column("mes_primero"), False).to_numpy(zero_copy_only=False)
    return to_utc_micros(values, zones, first, tables)


def irregular_dates(news: DataFrame, outlets: DataFrame, key: str = "fila", fields: tuple[str, ...] = NEWS_FIELDS, local: str = "fecha_publicacion") -> DataFrame:
    """key, campo, utc of each date cell that isn't already a valid yyyy-MM-ddTHH:mm:ssZ.

    local is the field whose texts without a zone are in the outlet's zone; in the others they are UTC.
    """
    tables = outlet_zones(outlets)
    rows = with_outlet_zone(news, outlets, [key, *fields])

    def run(batches):
        for b in batches:
            for name in fields:
                values = b.column(name)
                micros = field_micros(b, name, name == local, tables)
                blank = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(pc.fill_null(values, ""))), 0).to_numpy(zero_copy_only=False)
                plain = pc.match_substring_regex(pc.fill_null(values, ""), PLAIN).to_numpy(zero_copy_only=False)
                take = pa.array(~blank & ~(plain & (micros != INVALID)))
                text = pc.fill_null(iso_micros(micros).filter(take), "invalida")
                keys = b.column(key).filter(take)
                yield pa.RecordBatch.from_arrays([keys, pa.array([name] * len(keys), type=pa.string()), text], names=[key, "campo", "utc"])

    kind = news.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, campo string, utc string")


def normalise(news: DataFrame, outlets: DataFrame, key: str = "fila", fields: tuple[str, ...] = NEWS_FIELDS, local: str = "fecha_publicacion") -> DataFrame:
    """key, each field as a UTC timestamp (null where null, blank or unusable), and version_zonas of the zone tables used."""
    tables = outlet_zones(outlets)
    rows = with_outlet_zone(news, outlets, [key, *fields])

    def run(batches):
        for b in batches:
            out = [b.column(key)]
            for name in fields:
                m = field_micros(b, name, name == local, tables)
                out.append(pa.array(m, mask=m == INVALID).cast(pa.timestamp("us", "UTC")))
            yield pa.RecordBatch.from_arrays(out, names=[key, *fields])

    kind = news.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{f}` timestamp" for f in fields))
    return out.withColumn("version_zonas", F.lit(tables["version"]))
