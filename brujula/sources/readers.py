"""Readers for the source formats: CSV, GeoJSON, JSON lines, RSS, sitemaps, article pages, API lists.

All are DataFrame readers, so that folders of any number of files are read in parallel;
nothing downloads. Unreadable rows become rejected rows, never errors.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brujula.functions.normal import news_id, normal_url, plain_text, provisional_cluster
from brujula.session import spread
from brujula.sources.contract import NEWS, finalize

INDICATORS = "pais_iso3 STRING, indicador_id STRING, anio BIGINT, valor DOUBLE, unidad STRING, fuente_url STRING, fecha_extraccion STRING, licencia STRING"
REVIEW = "id_caso STRING, estado_revision STRING, revisor STRING, fecha_revision STRING, nota STRING"
#: Language names of the list API and their codes (fixed values).
LANGUAGE_CODES = {"spanish": "es", "english": "en", "portuguese": "pt", "french": "fr", "german": "de", "italian": "it"}


def indicators(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV; an empty valor is null, other blanks stay empty texts."""
    text = spark.read.option("header", True).schema(INDICATORS.replace("DOUBLE", "STRING").replace("BIGINT", "STRING")).csv(path)
    return text.select(*[F.expr(f"try_cast({c} AS {t})").alias(c) if t != "STRING" else F.coalesce(c, F.lit("")).alias(c) for c, t in (x.split(" ") for x in INDICATORS.split(", "))])


def news_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-text CSV with true/false flags; blanks are null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    flags = {c: F.lower(F.trim(c)) == "true" for c in ("sintetico", "recirculada") if c in df.columns}
    return df.withColumns(flags)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: its flat properties, longitude, latitude and depth."""
    schema = "features ARRAY<STRUCT<id: STRING, properties: STRUCT<id: STRING, mag: DOUBLE, magnitude: DOUBLE, time: STRING, updated: STRING, place: STRING, status: STRING, url: STRING, longitude: DOUBLE, latitude: DOUBLE, depth: DOUBLE>, geometry: STRUCT<coordinates: ARRAY<DOUBLE>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    iso = lambda c: F.when(F.col(c).rlike(r"^\d+$"), F.date_format(F.timestamp_millis(F.col(c).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.col(c))
    at = lambda i: F.try_element_at("geometry.coordinates", F.lit(i + 1))
    return f.select(
        F.coalesce("id", "properties.id").alias("id"), F.coalesce("properties.mag", "properties.magnitude").alias("magnitude"), iso("properties.time").alias("time"), iso("properties.updated").alias("updated"),
        F.coalesce(at(0), "properties.longitude").alias("longitude"), F.coalesce(at(1), "properties.latitude").alias("latitude"), F.coalesce(at(2), "properties.depth").alias("depth"),
        "properties.place", "properties.status", "properties.url",
    )


def json_lines(spark: SparkSession, path: str, schema: str, good=None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of a JSON-lines file; `good` is a condition that rows must fulfil, too. Blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    flagged = parsed.select("value", "r.*").withColumn("_ok", F.expr("_corrupt IS NULL") & (F.lit(True) if good is None else F.coalesce(good, F.lit(False))))
    names = [x.name for x in T._parse_datatype_string(schema).fields]
    return flagged.filter("_ok").select(*names), flagged.filter("NOT _ok").select(F.col("value").alias("linea"))


def strict_json_lines(spark: SparkSession, path: str, schema: str, good) -> DataFrame:
    """Like json_lines, but a rejected line raises when the rows are read."""
    rows, bad = json_lines(spark, path, schema, good)
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"invalid line: {first[0][0][:120]}")
    return rows


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file that aren't blank or comments."""
    return spark.read.text(path).select(F.trim("value").alias("consulta")).filter((F.col("consulta") != "") & ~F.col("consulta").startswith("#"))


def _from_item(df: DataFrame, link, title, description, published, when, origin: str, scope: str, outlet: str, domain: str, language: str) -> DataFrame:
    d = plain_text(description)
    url = F.nullif(F.trim(link), F.lit(""))
    ident = news_id(normal_url(url))
    return df.select(
        ident.alias("id_noticia"), plain_text(title).alias("titulo"), d.alias("descripcion"), url.alias("url"), F.lit(outlet).alias("medio"), F.lit(domain).alias("dominio"),
        F.lit(language).alias("idioma"), published.alias("fecha_publicacion"), F.lit(None).cast("timestamp").alias("fecha_deteccion"), when.alias("fecha_extraccion"), F.lit(origin).alias("origen"),
        F.when(d.isNotNull(), scope).otherwise("titular/metadatos").alias("alcance_texto"), provisional_cluster(ident).alias("cluster_id"), F.lit(False).alias("sintetico"),
    )


def _stamp_of_file(pattern: str = r"(\d{8}T\d{6}Z)"):
    return F.try_to_timestamp(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit("yyyyMMdd'T'HHmmss'Z'"))


def rss(spark: SparkSession, path: str, outlet: str, domain: str, language: str, origin: str = "tvn_rss") -> DataFrame:
    """Items of RSS files in the news contract; the capture time is in the file's or folder's name."""
    schema = "title STRING, link STRING, description STRING, pubDate STRING"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).withColumn("_when", _stamp_of_file())
    day = F.regexp_replace(F.trim("pubDate"), r"^[A-Za-z]+,\s*", "")
    when = F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp("pubDate"))
    return finalize(_from_item(items, F.col("link"), F.col("title"), F.col("description"), when, F.col("_when"), origin, "descripcion_rss", outlet, domain, language))


def sitemap(spark: SparkSession, path: str, domain: str, disallowed: tuple[str, ...] = ("/api/", "/buscador/", "/tag/")) -> DataFrame:
    """Distinct addresses of a sitemap that lie on the domain and not under a disallowed path."""
    locs = spark.read.format("xml").option("rowTag", "url").schema("loc STRING").load(path).select(F.trim("loc").alias("url"))
    path_of = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    bad = F.lit(False)
    for p in disallowed:
        bad = bad | F.startswith(path_of, F.lit(p))
    return locs.filter(F.coalesce(F.endswith(F.try_parse_url("url", F.lit("HOST")), F.lit(domain)), F.lit(False)) & ~bad).distinct()


_BLOCK = r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"
_META = r"(?is)<meta[^>]+article:published_time[^>]+content=[\"']([^\"']+)"
_NODE = "`@type`: STRING, headline: STRING, description: STRING, datePublished: STRING"


def _article(page: Column) -> Column:
    """The first node of a page's linked data whose type is a kind of article; null without one."""
    schema = f"ARRAY<STRUCT<{_NODE}, `@graph`: ARRAY<STRUCT<{_NODE}>>>>"
    names = ("@type", "headline", "description", "datePublished")
    node = lambda x: F.struct(*[x[n].alias(n.strip("@")) for n in names])
    read = lambda block: F.coalesce(F.from_json(block, schema, {"allowUnquotedControlChars": "true"}), F.array())
    inside = lambda x: F.concat(F.array(node(x)), F.transform(F.coalesce(x["@graph"], F.array()), node))
    nodes = F.flatten(F.transform(F.regexp_extract_all(page, F.lit(_BLOCK), 1), lambda b: F.flatten(F.transform(read(b), inside))))
    # a list of types comes as its JSON text
    return F.try_element_at(F.filter(nodes, lambda x: x.type.rlike(r'Article("|$)')), F.lit(1))


def articles(pages: DataFrame, url: str, html: str, when: str, outlet: str, domain: str, language: str, origin: str = "tvn_web") -> DataFrame:
    """News rows of article pages (columns url, html, when); pages without an article or title give none."""
    rows = pages.select(F.col(url).alias("u"), F.col(html).alias("h"), F.col(when).alias("w"), _article(F.col(html)).alias("x")).filter("x IS NOT NULL")
    published = F.coalesce("x.datePublished", F.nullif(F.regexp_extract("h", _META, 1), F.lit("")))
    out = _from_item(rows, F.col("u"), F.col("x.headline"), F.col("x.description"), F.try_to_timestamp(published), F.col("w"), origin, "descripcion_web", outlet, domain, language)
    return finalize(out.filter(F.col("titulo").isNotNull()))


def article_list(spark: SparkSession, path: str, origin: str = "gdelt") -> DataFrame:
    """News rows of stored answers of the list API (one JSON object per file), first capture of a url first."""
    schema = "articles ARRAY<STRUCT<url: STRING, title: STRING, seendate: STRING, domain: STRING, language: STRING>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_when", _stamp_of_file())
    a = raw.select("_when", F.explode("articles").alias("a")).select("_when", "a.*")
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    lang = F.nullif(F.lower(F.trim("language")), F.lit(""))
    host = F.nullif(F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", ""), F.lit(""))
    url = F.nullif(F.trim("url"), F.lit(""))
    ident = news_id(normal_url(url))
    rows = a.select(
        ident.alias("id_noticia"), F.nullif(F.trim("title"), F.lit("")).alias("titulo"), url.alias("url"), host.alias("medio"), host.alias("dominio"), F.coalesce(codes[lang], lang).alias("idioma"),
        F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("fecha_deteccion"), F.col("_when").alias("fecha_extraccion"), F.lit(origin).alias("origen"),
        F.lit("titular/metadatos").alias("alcance_texto"), provisional_cluster(ident).alias("cluster_id"), F.lit(False).alias("sintetico"),
    )
    w = Window.partitionBy("id_noticia").orderBy(F.asc_nulls_last("fecha_extraccion"), "url")
    return finalize(rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1"))


def response_status(texts: DataFrame, column: str) -> DataFrame:
    """column, estado: whether a stored API answer is JSON, empty, a rate-limit text or something else."""
    c = F.col(column)
    empty = F.trim(F.coalesce(c, F.lit(""))) == ""
    status = F.when(empty, "vacia").when(F.try_parse_json(c).isNotNull(), "json").when(F.lower(c).contains("limit requests"), "limite").otherwise("otra")
    return texts.select(column, status.alias("estado"))


def junit(spark: SparkSession, path: str) -> DataFrame:
    """File of tests, n, failed, skipped and seconds of JUnit XML reports."""
    schema = "_classname STRING, _name STRING, _time DOUBLE, failure STRING, error STRING, skipped STRING"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    bad = F.col("failure").isNotNull() | F.col("error").isNotNull()
    return cases.groupBy(F.col("_classname").alias("archivo")).agg(F.count("*").alias("n"), F.count_if(bad).alias("fallidas"), F.count_if(F.col("skipped").isNotNull() & ~bad).alias("omitidas"), F.round(F.sum("_time"), 3).alias("segundos"))


def vectors(spark: SparkSession, path: str, ids: str) -> DataFrame:
    """id, vector of a stored matrix with its list of ids (rows by position).

    The driver reads the header and the ids; each task maps the file and reads its own rows of
    the matrix, so the file has to lie where the executors can read it.
    """
    import numpy as np

    names = spark.read.option("multiLine", True).option("wholetext", True).text(ids).select(F.posexplode(F.from_json("value", "ARRAY<STRING>")).alias("fila", "id"))
    rows, width = np.load(path, mmap_mode="r").shape
    if names.count() != rows:
        raise ValueError("ids and matrix differ in length")

    def run(batches):
        m = np.load(path, mmap_mode="r")
        for b in batches:
            own = np.ascontiguousarray(m[b.column("fila").to_numpy()], dtype="float32")
            v = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), width).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), v], names=["id", "vector"])

    return spread(names, "fila").mapInArrow(run, "id string, vector array<float>")


def query_url(base: str, countries: list[str], first: int, last: int) -> str:
    """Address of an indicator request: countries joined by ';', the years by ':'."""
    return f"{base}/{';'.join(countries)}?date={first}:{last}"


EMPTY_NEWS = ", ".join(f"{c} {t}" for c, t in NEWS.items())


def stored_articles(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """News rows of stored article files (one JSON object each): without those marked to skip, the first extraction of
    an id, published in [start, end)."""
    schema = ", ".join(f"{c} STRING" for c in NEWS if c not in ("tema_confianza", "sintetico")) + ", skip BOOLEAN"
    rows = finalize(spark.read.schema(schema).option("multiLine", True).json(path).filter("NOT coalesce(skip, false) AND id_noticia IS NOT NULL"))
    first = rows.groupBy("id_noticia").agg(F.min_by(F.struct(*rows.columns), F.struct(F.col("fecha_extraccion").isNull(), "fecha_extraccion", "url")).alias("r")).select("r.*")
    kept = first.filter((F.col("fecha_publicacion") >= F.lit(start).cast("timestamp")) & (F.col("fecha_publicacion") < F.lit(end).cast("timestamp")))
    return kept.withColumn("cluster_id", provisional_cluster(F.col("id_noticia"))).select(*NEWS)


def rss_snapshots(captures: DataFrame) -> DataFrame:
    """Rows of several captures of a feed, each id once: the earliest capture (then the smaller url)."""
    r = F.min_by(F.struct(*captures.columns), F.struct(F.col("fecha_extraccion").isNull(), "fecha_extraccion", "url"))
    return captures.filter("id_noticia IS NOT NULL").groupBy("id_noticia").agg(r.alias("r")).select("r.*")


def cached_answers(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """clave, respuesta of the wanted keys (column clave) that a folder of <clave>.json files holds; unreadable files count as missing."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("clave"), F.col("value").alias("respuesta"))
    return files.filter(F.try_parse_json("respuesta").isNotNull()).join(keys.select("clave").distinct(), "clave", "left_semi")


def rules(spark: SparkSession, path: str, expected: dict[str, set[str]]) -> dict:
    """Rules of a YAML file (small, read on the driver); groups or keys other than the expected ones are an error."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading rules needs a YAML library") from e
    found = yaml.safe_load("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))
    if not isinstance(found, dict):
        raise ValueError("rules have to be groups of keys")
    for group, names in expected.items():
        have = set(found.get(group) or {})
        if have != names:
            raise ValueError(f"{group}: missing {sorted(names - have)}, unknown {sorted(have - names)}")
    return found


def test_matrix(spark: SparkSession, path: str) -> DataFrame:
    """id, fecha, estado, pasaron, de of a CSV matrix of tests (columns ID, Observado, Evidencia); what it doesn't state is null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    part = lambda i: F.nullif(F.regexp_extract(F.coalesce("Observado", F.lit("")), r"^\s*(Pasa|Falla)\s*\((\d+)/(\d+)\)", i), F.lit(""))
    day = F.nullif(F.regexp_extract(F.coalesce("Evidencia", F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return rows.select(F.col("ID").alias("id"), day.alias("fecha"), F.lower(part(1)).alias("estado"), part(2).cast("int").alias("pasaron"), part(3).cast("int").alias("de"))
