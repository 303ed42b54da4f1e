"""The news contract: its columns and types, and bringing any source to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns and types of the news table, in order (fixed values).
NEWS = {
    "id_noticia": "string", "titulo": "string", "descripcion": "string", "url": "string", "medio": "string", "dominio": "string",
    "idioma": "string", "fecha_publicacion": "timestamp", "fecha_deteccion": "timestamp", "fecha_extraccion": "timestamp",
    "origen": "string", "alcance_texto": "string", "procedencia_id": "string", "tema": "string", "tema_confianza": "double",
    "cluster_id": "string", "sintetico": "boolean",
}


def finalize(df: DataFrame) -> DataFrame:
    """The contract's columns in order and type; missing ones are null, sintetico is false where unknown."""
    have = set(df.columns)
    cols = [F.try_to_timestamp(F.col(c).cast("string")).alias(c) if t == "timestamp" and c in have and dict(df.dtypes)[c] == "string" else (F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in NEWS.items()]
    return df.select(*cols).withColumn("sintetico", F.coalesce("sintetico", F.lit(False)))
