"""Report queries: catalog, evidence texts, cache keys, display forms, flags, work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brujula.operators import claims, lexical, metrics, rollups, validation
from brujula.plans.tables import _iso, latest_review
from brujula.session import table

#: Names under which codes are shown (fixed values).
ORIGIN_NAMES = {"tvn_rss": "canal RSS", "tvn_web": "sitio web", "gdelt": "agregador"}
INDICATOR_NAMES = {
    "NY.GDP.MKTP.KD.ZG": "crecimiento del PIB",
    "FP.CPI.TOTL.ZG": "inflación (precios al consumidor)",
    "SL.UEM.TOTL.ZS": "desempleo",
    "NE.EXP.GNFS.ZS": "exportaciones de bienes y servicios",
    "IT.NET.USER.ZS": "uso de internet",
}
COUNTRY_NAMES = {"PAN": "Panamá", "CRI": "Costa Rica", "COL": "Colombia", "DOM": "República Dominicana", "MEX": "México", "GTM": "Guatemala"}


def _map(names: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def _news(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "noticias")


def catalog(spark, d):
    """Per origin: rows, span of ISO publication days, and its four commonest languages as one text."""
    n = _news(spark, d)
    day = F.date_format(validation.iso_timestamp(F.col("fecha_publicacion")), "yyyy-MM-dd")
    base = n.groupBy("origen").agg(F.count("*").alias("filas"), F.concat_ws(" a ", F.min(day), F.max(day)).alias("periodo"))
    top = rollups.top_per_group(n.filter("idioma IS NOT NULL"), ["origen"], "idioma", 4)
    text = top.groupBy("origen").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("puesto", "idioma"))), lambda x: x.idioma), ", ").alias("idiomas"))
    return base.join(text, "origen", "left")


def official_passages(spark, d):
    """Texts by which official figures and quakes are found, with their id and recency."""
    i = table(spark, d, "indicadores").filter("valor IS NOT NULL")
    wb = i.select(
        F.concat_ws("-", F.lit("WB"), "pais_iso3", "indicador_id", F.col("anio").cast("string")).alias("pasaje"),
        F.concat_ws(" ", F.coalesce(_map(INDICATOR_NAMES)[F.col("indicador_id")], "indicador_id"), F.coalesce(_map(COUNTRY_NAMES)[F.col("pais_iso3")], "pais_iso3"), F.col("anio").cast("string"), "unidad").alias("texto"),
        F.col("anio").cast("long").alias("reciente"),
    )
    q = table(spark, d, "sismos")
    quakes = q.select(
        F.col("id").alias("pasaje"),
        F.concat_ws(" ", F.lit("sismo terremoto temblor magnitud"), F.when(F.col("magnitude").isNotNull(), F.format_string("%.1f", "magnitude")), "place", F.substring("time", 1, 10)).alias("texto"),
        F.coalesce(F.unix_seconds(F.try_to_timestamp("time")), F.lit(0)).alias("reciente"),
    )
    return wb.unionByName(quakes)


def search_official(spark, d):
    """Ten best official passages of some questions, by year and with short names widened."""
    asked = [("q1", "¿Cuál fue la inflación de Panamá en 2019?"), ("q2", "desempleo en Costa Rica"), ("q3", "PIB de México 2021"), ("q4", "temblor de magnitud en Panamá"), ("q5", "internet en la República Dominicana"), ("q6", "noticias de deportes")]
    q = spark.createDataFrame(asked, "consulta string, texto string")
    names = spark.createDataFrame([("PIB", "Producto interno bruto"), ("IPC", "precios al consumidor")], "corto string, largo string")
    return lexical.retried_search(q, official_passages(spark, d), names)


def cache_keys(spark, d):
    """Digest under which an answer on a row would be kept: of the JSON of its texts in fixed order."""
    return _news(spark, d).select("fila", F.sha2(F.to_json(F.struct("titulo", "descripcion", "url"), {"ignoreNullFields": "false"}), 256).alias("clave"))


def local_dates(spark, d):
    """ISO publication times in Panama, as shown."""
    t = validation.iso_timestamp(F.col("fecha_publicacion"))
    return _news(spark, d).filter(t.isNotNull()).select("fila", F.date_format(F.from_utc_timestamp(t, "America/Panama"), "dd/MM/yyyy HH:mm").alias("hora"), F.coalesce(_map(ORIGIN_NAMES)[F.col("origen")], "origen").alias("origen"))


def order_flags(spark, d):
    """Which families of patterns each document's text shows: orders to its reader, keys, accusations, today, forecasts."""
    families = [f for f in claims.PATTERNS if f != "instrucciones"]
    return table(spark, d, "documents").select("doc_id", *[claims.flag(F.col("text"), f).alias(f) for f in families])


def without_vector(spark, d):
    """Documents that have no stored vector yet."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def review_tally(spark, d):
    """Cases by what any of their reviews says: accepted before discarded before open; and the share of accepted ones."""
    r = table(spark, d, "revisiones").filter("id_caso <> ''")
    one = r.groupBy("id_caso").agg(F.bool_or(F.col("estado_revision") == "aprobado como borrador").alias("a"), F.bool_or(F.col("estado_revision") == "descartado").alias("b"))
    return one.agg(
        F.count_if("a").alias("aceptados"), F.count_if(~F.col("a") & F.col("b")).alias("descartados"), F.count_if(~F.col("a") & ~F.col("b")).alias("abiertos"),
        metrics.ratio(F.count_if("a"), F.nullif(F.count_if(F.col("a") | F.col("b")), F.lit(0))).alias("parte"),
    )


def reviewers(spark, d):
    """Latest review of each case by reviewer and state."""
    return latest_review(spark, d).groupBy("revisor", "estado_revision").agg(F.count("*").alias("casos"))


def claim_checks(spark, d):
    """Labels as statements (title and description together) that cite their row's title: which stand, and what is wrong with the others."""
    e = table(spark, d, "etiquetas").filter("titulo IS NOT NULL").groupBy("titulo").agg(F.min("id_noticia").alias("id"), F.min("descripcion").alias("d"))
    c = e.select(F.col("titulo").alias("claim"), F.concat_ws(" ", "titulo", "d").alias("texto"), "id", F.lit("titulo").alias("campo"), F.col("titulo").alias("pasaje"))
    news = _news(spark, d).filter("id_noticia IS NOT NULL").groupBy("id_noticia").agg(F.min_by("titulo", "fila").alias("t"))
    return claims.check(c, news.select(F.col("id_noticia").alias("id"), F.map_filter(F.create_map(F.lit("titulo"), "t"), lambda k, v: v.isNotNull()).alias("campos")))


QUERIES = {f.__name__: f for f in (catalog, official_passages, search_official, cache_keys, local_dates, order_flags, without_vector, review_tally, reviewers, claim_checks)}

_CASE = lambda c, names: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {c} END"
_DAY = f"strftime({_iso('fecha_publicacion')}, '%Y-%m-%d')"
_NORMAL = rf"trim(regexp_replace(translate(strip_accents(lower(text)), '«»“”‘’', '{'"' * 4 + "''" * 2}'), '[\s\x{{00A0}}]+', ' ', 'g'))"

SQL = {
    "catalog": f"SELECT b.*, t.idiomas FROM (SELECT origen, count(*) AS filas, concat_ws(' a ', min({_DAY}), max({_DAY})) AS periodo FROM noticias GROUP BY 1) b LEFT JOIN (SELECT origen, string_agg(idioma, ', ' ORDER BY p) AS idiomas FROM (SELECT origen, idioma, row_number() OVER (PARTITION BY origen ORDER BY count(*) DESC, idioma) AS p FROM noticias WHERE idioma IS NOT NULL GROUP BY 1, 2) WHERE p <= 4 GROUP BY 1) t USING (origen)",
    "official_passages": f"SELECT 'WB-' || pais_iso3 || '-' || indicador_id || '-' || anio AS pasaje, concat_ws(' ', {_CASE('indicador_id', INDICATOR_NAMES)}, {_CASE('pais_iso3', COUNTRY_NAMES)}, CAST(anio AS VARCHAR), unidad) AS texto, anio AS reciente FROM indicadores WHERE valor IS NOT NULL UNION ALL SELECT id, concat_ws(' ', 'sismo terremoto temblor magnitud', CASE WHEN magnitude IS NOT NULL THEN printf('%.1f', magnitude) END, place, left(time, 10)), coalesce(CAST(floor(epoch(try_cast(replace(replace(time, 'T', ' '), 'Z', '') AS TIMESTAMP))) AS BIGINT), 0) FROM sismos",
    "cache_keys": "SELECT fila, sha256(CAST(json_object('titulo', titulo, 'descripcion', descripcion, 'url', url) AS VARCHAR)) AS clave FROM noticias",
    "local_dates": f"SELECT fila, strftime(t - INTERVAL 5 HOUR, '%d/%m/%Y %H:%M') AS hora, {_CASE('origen', ORIGIN_NAMES)} AS origen FROM (SELECT fila, origen, {_iso('fecha_publicacion')} AS t FROM noticias) WHERE t IS NOT NULL",
    "order_flags": "SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches({'text' if f == 'secreto' else _NORMAL}, '(?:{')|(?:'.join(ps)})'), false) AS {f}" for f, ps in claims.PATTERNS.items() if f != "instrucciones") + " FROM documents",
    "without_vector": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "review_tally": "WITH o AS (SELECT id_caso, bool_or(estado_revision = 'aprobado como borrador') AS a, bool_or(estado_revision = 'descartado') AS b FROM revisiones WHERE id_caso <> '' GROUP BY 1) SELECT count(*) FILTER (a) AS aceptados, count(*) FILTER (NOT a AND b) AS descartados, count(*) FILTER (NOT a AND NOT b) AS abiertos, round(count(*) FILTER (a) / nullif(count(*) FILTER (a OR b), 0), 6) AS parte FROM o",
    "reviewers": "SELECT revisor, estado_revision, count(*) AS casos FROM (SELECT *, row_number() OVER (PARTITION BY id_caso ORDER BY linea DESC) AS r FROM revisiones WHERE estado_revision IN ('nuevo', 'en revisión', 'requiere evidencia', 'aprobado como borrador', 'descartado') AND id_caso <> '') WHERE r = 1 GROUP BY 1, 2",
}
