"""Relational queries over the news tables: merging, validation, rollups, context, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brujula.functions.text import folded
from brujula.operators import merge, rollups, validation
from brujula.session import spread, table

ORIGINS = ("tvn_rss", "tvn_web", "gdelt")
SCOPES = ("titular/metadatos", "descripcion_rss", "descripcion_web")
DATES = ("fecha_publicacion", "fecha_deteccion", "fecha_extraccion")
#: States of a review (fixed values).
STATES = ("nuevo", "en revisión", "requiere evidencia", "aprobado como borrador", "descartado")
#: Official indicators that may go with a topic, and words of a text that call for them (fixed values).
TOPIC_INDICATORS = {
    "economía": ("NY.GDP.MKTP.KD.ZG", "FP.CPI.TOTL.ZG", "SL.UEM.TOTL.ZS", "NE.EXP.GNFS.ZS"),
    "logística/Canal": ("NE.EXP.GNFS.ZS",),
    "servicios públicos": ("IT.NET.USER.ZS",),
}
INDICATOR_WORDS = {
    "NY.GDP.MKTP.KD.ZG": ("pib", "producto interno bruto", "crecimiento economico", "crecimiento de la economia", "economia crecio", "economia crece", "gdp", "economic growth"),
    "FP.CPI.TOTL.ZG": ("inflacion", "ipc", "indice de precios", "costo de vida", "canasta basica", "alza de precios", "aumento de precios", "inflation", "consumer prices"),
    "SL.UEM.TOTL.ZS": ("desempleo", "desocupacion", "tasa de empleo", "mercado laboral", "unemployment"),
    "NE.EXP.GNFS.ZS": ("exportaciones", "comercio exterior", "exports"),
    "IT.NET.USER.ZS": ("internet", "conectividad", "banda ancha", "telecomunicacion", "fibra optica"),
}


def _news(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "noticias")


def _rank():
    return merge.priority(F.col("origen"), ORIGINS)


def first_capture(spark, d):
    news = _news(spark, d).select("id_noticia", "fila", "carga", "origen")
    return merge.keep_first(news, ["id_noticia"], [F.col("carga"), F.col("fila")])


def source_priority(spark, d):
    news = _news(spark, d).select("id_noticia", "fila", "carga", "origen")
    return merge.keep_first(news, ["id_noticia"], [_rank(), F.col("carga"), F.col("fila")])


def earliest_seen(spark, d):
    news = _news(spark, d).select("fila", "id_noticia", "origen", "fecha_deteccion")
    own, seen = news.filter("origen <> 'gdelt'").select("fila", "id_noticia"), news.filter("origen = 'gdelt'")
    return merge.fill_from(own, seen, "id_noticia", "fecha_deteccion", "vista").select("fila", "id_noticia", "vista")


def source_union(spark, d):
    """UNION ALL of the three sources, each with its own columns."""
    news = _news(spark, d)
    parts = [news.filter(F.col("origen") == o).select("fila", "titulo", "origen", *(["descripcion"] if o != "gdelt" else ["fecha_deteccion"])) for o in ORIGINS]
    return merge.union_all(parts).select("fila", "titulo", "origen", "descripcion", "fecha_deteccion")


def _issues(spark, d):
    return validation.issues(
        _news(spark, d), "fila", ["id_noticia", "titulo", "url", "medio", "dominio"], list(DATES), "url", "id_noticia", {"origen": ORIGINS, "alcance_texto": SCOPES},
        ("fecha_deteccion", "origen", ORIGINS[:2], "gdelt"),
    )


def validation_issues(spark, d):
    return _issues(spark, d)


def issues_by_problem(spark, d):
    return _issues(spark, d).groupBy("campo", "problema").agg(F.countDistinct("fila").alias("filas"))


def validation_totals(spark, d):
    valid, bad = validation.split(_news(spark, d).select("fila"), _issues(spark, d), "fila")
    return valid.agg(F.count("*").alias("validas")).crossJoin(bad.agg(F.count("*").alias("rechazadas"))).select("validas", "rechazadas", (F.col("validas") + F.col("rechazadas")).alias("leidas"))


def null_counts(spark, d):
    return validation.null_counts(_news(spark, d))


def iso_dates(spark, d):
    """Dates in ISO form only, in UTC to the second; everything else is null."""
    s = lambda c: F.date_format(validation.iso_timestamp(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    return _news(spark, d).select("fila", *[s(c) for c in DATES])


def recirculated(spark, d):
    """Rows detected seven days or more after their publication (false if a date is missing)."""
    p, q = validation.iso_timestamp(F.col("fecha_publicacion")), validation.iso_timestamp(F.col("fecha_deteccion"))
    return _news(spark, d).select("fila", F.coalesce(q - p >= F.expr("interval 7 day"), F.lit(False)).alias("tardia"))


def outlet_rollup(spark, d):
    news = _news(spark, d).filter("origen IS NOT NULL AND dominio IS NOT NULL")
    base = news.groupBy("origen", "dominio").agg(F.count("*").alias("n"), F.min("carga").alias("primera"), F.max("carga").alias("ultima"))
    return base.join(rollups.majority(news, ["origen", "dominio"], "medio", "medio_comun"), ["origen", "dominio"])


def origin_counts(spark, d):
    return _news(spark, d).groupBy("origen").agg(F.count("*").alias("n"))


def top_languages(spark, d):
    return rollups.top_per_group(_news(spark, d), ["origen"], "idioma", 4)


def cluster_rollup(spark, d):
    news = _news(spark, d).withColumn("prov", F.coalesce("procedencia_id", F.concat(F.lit("P-"), F.coalesce("dominio", F.lit("desconocido")))))
    base = news.groupBy("cluster_id").agg(
        F.array_join(F.array_sort(F.collect_list("fila")), ",").alias("filas"),
        F.count("*").alias("n_registros"),
        F.countDistinct("prov").alias("n_procedencias"),
        F.countDistinct("medio").alias("n_medios"),
        F.array_join(F.sort_array(F.collect_set("medio")), "|").alias("medios"),
        F.bool_or("recirculada").alias("recirculada"),
    )
    return base.join(rollups.majority(news, ["cluster_id"], "tema", "tema", "otro"), "cluster_id")


def cluster_key(spark, d):
    """Stable id of a group: its own id if alone, else a digest of all sorted ids."""
    news = _news(spark, d).filter("id_noticia IS NOT NULL").select("cluster_id", "id_noticia").distinct()
    ids = news.groupBy("cluster_id").agg(F.sort_array(F.collect_list("id_noticia")).alias("ids"))
    single = F.concat(F.lit("K-"), F.substring(F.col("ids")[0], 3, 100))
    group = F.concat(F.lit("K-"), F.substring(F.sha1(F.array_join("ids", "|")), 1, 10))
    return ids.select("cluster_id", F.when(F.size("ids") == 1, single).otherwise(group).alias("clave"))


def latest_title(spark, d):
    """Headline of each cluster: es, then en, then others; the latest load, then the smallest row."""
    news = _news(spark, d).filter("titulo IS NOT NULL").select("cluster_id", "titulo", "idioma", "carga", "fila")
    lang = merge.priority(F.coalesce("idioma", F.lit("")), ("es", "en"))
    return merge.keep_first(news, ["cluster_id"], [lang, -F.col("carga"), F.col("fila")]).select("cluster_id", "titulo", "fila")


def period_filter(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.filter(rollups.in_period(F.col("t"), "2024-01-05 00:00:00", "2024-01-20 00:00:00")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def month_windows(spark, d):
    """[start, end) of every month of the orders' period, the first and the last one clipped to it."""
    span = table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    m = span.select("a", F.date_add("b", 1).alias("b"), F.explode(rollups.months_between(F.col("a"), F.col("b"))).alias("m"))
    return m.select(F.date_format("m", "yyyy-MM").alias("mes"), F.date_format(F.greatest("a", "m"), "yyyy-MM-dd").alias("inicio"), F.date_format(F.least("b", F.add_months("m", 1)), "yyyy-MM-dd").alias("fin"))


def _month():
    return F.when(F.col("fecha_deteccion").rlike(r"^\d{8}T\d{6}Z$"), F.substring("fecha_deteccion", 1, 6))


def todo_requests(spark, d):
    """Months and topics of the corpus for which no row was detected yet."""
    news = _news(spark, d).select(_month().alias("mes"), "tema", "origen").filter("mes IS NOT NULL AND tema IS NOT NULL")
    wanted = news.select("mes").distinct().crossJoin(news.select("tema").distinct()).crossJoin(news.select("origen").distinct())
    return merge.todo(wanted, news.distinct(), ["mes", "tema", "origen"])


def month_quota(spark, d):
    """Of each month the first 200 pages in hash order, and of those the first 100 that have a description or come from an agency feed."""
    news = _news(spark, d).select("fila", _month().alias("mes"), F.sha1("url").alias("h"), "procedencia_id").filter("mes IS NOT NULL AND h IS NOT NULL")
    w = Window.partitionBy("mes").orderBy("h", "fila")
    cut = news.withColumn("r", F.row_number().over(w)).filter("r <= 200").filter("procedencia_id IS NOT NULL")
    return cut.withColumn("puesto", F.row_number().over(w)).filter("puesto <= 100").select("mes", "fila", "puesto")


def grid_complete(spark, d):
    return rollups.complete_grid(table(spark, d, "indicadores").filter("valor IS NOT NULL"), ["pais_iso3", "indicador_id", "anio"], "valor")


def latest_indicator(spark, d):
    return rollups.latest_with_value(table(spark, d, "indicadores"), ["pais_iso3", "indicador_id"], "anio", "valor").withColumn("valor", F.round("valor", 6))


def indicator_context(spark, d):
    """Clusters and the latest official values that their topic allows and their words call for."""
    news = _news(spark, d)
    topic = rollups.majority(news, ["cluster_id"], "tema", "tema", "otro")
    allowed = F.create_map(*[x for t, ids in TOPIC_INDICATORS.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in ids]))])
    text = F.concat(F.lit(" "), F.regexp_replace(folded(F.concat_ws(" ", "titulo", "descripcion")), r"\W+", " "))
    found = F.transform(F.array(text), lambda x: F.array_compact(F.array(*[F.when(x.rlike(" (?:" + "|".join(ws) + ")"), F.lit(i)) for i, ws in INDICATOR_WORDS.items()])))
    hits = spread(news.select("cluster_id", "fila", "titulo", "descripcion"), "fila").select("cluster_id", F.explode(F.flatten(found)).alias("indicador_id")).distinct()
    links = topic.select("cluster_id", F.explode(allowed[F.col("tema")]).alias("indicador_id")).join(hits, ["cluster_id", "indicador_id"])
    years = latest_indicator(spark, d).filter("pais_iso3 = 'PAN'").select("indicador_id", "anio")
    return links.join(years, "indicador_id").select("cluster_id", F.concat_ws("-", F.lit("WB-PAN"), "indicador_id", F.col("anio").cast("string")).alias("id_evidencia"))


def _quake_spans(spark, d):
    t = F.try_to_timestamp("time")
    return table(spark, d, "sismos").select("id", (t - F.expr("interval 72 hour")).alias("desde"), (t + F.expr("interval 72 hour")).alias("hasta"))


def quake_news(spark, d):
    """Rows on natural events whose ISO publication lies within 72 hours of a quake."""
    news = _news(spark, d).filter("tema = 'eventos naturales'").select("fila", validation.iso_timestamp(F.col("fecha_publicacion")).alias("t"))
    return rollups.interval_join(news, _quake_spans(spark, d), "t", "desde", "hasta", 72 * 3600).select("fila", "id")


def quakes_sorted(spark, d):
    """One row per event, the last updated, with its place in time order."""
    s = table(spark, d, "sismos").select("id", "time", "updated", "magnitude")
    one = merge.keep_first(s.filter("updated IS NOT NULL"), ["id"], [-F.unix_micros(F.try_to_timestamp("updated"))])
    ranked = rollups.global_rank(one.withColumn("_t", F.coalesce("time", F.lit(""))), ["_t", "id"], "puesto")
    return ranked.select("id", "time", F.round("magnitude", 2).alias("magnitude"), "puesto")


def context_kinds(spark, d):
    """Sorted kinds of official evidence of each cluster; clusters without any have an empty list."""
    links = table(spark, d, "contexto").groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_set("tipo")), "|").alias("tipos"), F.count("*").alias("enlaces"))
    return _news(spark, d).select("cluster_id").distinct().join(links, "cluster_id", "left").select("cluster_id", F.coalesce("tipos", F.lit("")).alias("tipos"), F.coalesce("enlaces", F.lit(0)).alias("enlaces"))


def missing_evidence(spark, d):
    """Every context link, whether its evidence is in the official tables."""
    wb = table(spark, d, "indicadores").filter("valor IS NOT NULL").select(F.concat_ws("-", F.lit("WB"), "pais_iso3", "indicador_id", F.col("anio").cast("string")).alias("id_evidencia"))
    official = wb.unionByName(table(spark, d, "sismos").select(F.col("id").alias("id_evidencia")))
    links = table(spark, d, "contexto").select("cluster_id", "id_evidencia", "tipo")
    return links.join(official.distinct().withColumn("presente", F.lit(True)), "id_evidencia", "left").select("cluster_id", "id_evidencia", "tipo", F.coalesce("presente", F.lit(False)).alias("presente"))


def _reviews(spark, d):
    return table(spark, d, "revisiones").filter(F.col("estado_revision").isin(*STATES) & (F.col("id_caso") != ""))


def latest_review(spark, d):
    return merge.keep_first(_reviews(spark, d), ["id_caso"], [-F.col("linea")]).select("id_caso", "linea", "estado_revision", "revisor")


def review_history(spark, d):
    """States of each case, newest first."""
    h = F.sort_array(F.collect_list(F.struct("fecha_revision", "linea", "estado_revision")), asc=False)
    return _reviews(spark, d).groupBy("id_caso").agg(F.count("*").alias("n"), F.array_join(F.transform(h, lambda x: x.estado_revision), " > ").alias("historia"))


def review_rejects(spark, d):
    r = table(spark, d, "revisiones")
    bad = ~F.coalesce(F.col("estado_revision").isin(*STATES), F.lit(False)) | (F.coalesce("id_caso", F.lit("")) == "")
    return r.filter(bad).groupBy("estado_revision").agg(F.count("*").alias("n"))


def case_state(spark, d):
    """Every cluster's case with its latest review, 'nuevo' where there is none."""
    cases = _news(spark, d).select(F.concat(F.lit("F-"), "cluster_id").alias("id_caso")).distinct()
    last = latest_review(spark, d)
    return cases.join(last, "id_caso", "left").select("id_caso", F.coalesce("estado_revision", F.lit("nuevo")).alias("estado"), "revisor")


def ranked_clusters(spark, d):
    """The ten clusters with the most independent origins, then rows; ties by id (top-k report)."""
    news = _news(spark, d).groupBy("cluster_id").agg(F.countDistinct(F.coalesce("procedencia_id", "dominio")).alias("procedencias"), F.count("*").alias("n"))
    top = news.orderBy(F.desc("procedencias"), F.desc("n"), "cluster_id").limit(10)
    return top.withColumn("posicion", F.row_number().over(Window.orderBy(F.desc("procedencias"), F.desc("n"), "cluster_id")))


def weighted_rank(spark, d):
    """Official place of each topic by weighted parts, its place under other weights, and the change."""
    t = _news(spark, d).filter("tema IS NOT NULL").groupBy("tema").agg(
        F.countDistinct("dominio").alias("a"), F.count_if(F.col("descripcion").isNotNull()).alias("b"), F.count("*").alias("n")
    )
    t = t.select("tema", (F.col("b") / F.col("n")).alias("y"), (F.col("a") / F.col("n")).alias("x"))
    p, q = F.rint((30 * F.col("x") + 70 * F.col("y")) * 1e6) / 1e6, F.rint((70 * F.col("x") + 30 * F.col("y")) * 1e6) / 1e6
    w = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "tema"))
    out = t.withColumn("p", p).withColumn("q", q)
    return out.select("tema", "p", "q", w("p").alias("oficial"), w("q").alias("simulado")).withColumn("cambio", F.col("oficial") - F.col("simulado"))


def inbox(spark, d):
    """Clusters of two rows or more in Spanish or English, with headline, languages, kinds of evidence and state."""
    news = _news(spark, d)
    base = news.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("idioma")).alias("l"), F.bool_or("sintetico").alias("sintetico"))
    base = base.filter((F.col("n") >= 2) & F.arrays_overlap("l", F.array(F.lit("es"), F.lit("en")))).select("cluster_id", "n", F.array_join("l", "|").alias("idiomas"), "sintetico")
    out = base.join(latest_title(spark, d).select("cluster_id", "titulo"), "cluster_id", "left").join(context_kinds(spark, d).select("cluster_id", "tipos"), "cluster_id", "left")
    state = case_state(spark, d).select(F.expr("substring(id_caso, 3)").alias("cluster_id"), "estado")
    return out.join(state, "cluster_id", "left")


QUERIES = {
    f.__name__: f
    for f in (
        first_capture, source_priority, earliest_seen, source_union, validation_issues, issues_by_problem, validation_totals, null_counts, iso_dates,
        recirculated, outlet_rollup, origin_counts, top_languages, cluster_rollup, cluster_key, latest_title, period_filter, month_windows, todo_requests,
        month_quota, grid_complete, latest_indicator, indicator_context, quake_news, quakes_sorted, context_kinds, missing_evidence, latest_review,
        review_history, review_rejects, case_state, ranked_clusters, weighted_rank, inbox,
    )
}

_RANK = "CASE origen WHEN 'tvn_rss' THEN 0 WHEN 'tvn_web' THEN 1 WHEN 'gdelt' THEN 2 ELSE 3 END"
_ISO = r"'^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$'"


def _iso(c: str) -> str:
    base = rf"regexp_replace({c}, '(Z|[+-]\d{{2}}:\d{{2}})$', '')"
    minutes = rf"coalesce(try_cast(regexp_extract({c}, '([+-]\d{{2}}):\d{{2}}$', 1) AS INTEGER) * 60 + try_cast(regexp_extract({c}, '([+-])\d{{2}}:(\d{{2}})$', 1) || regexp_extract({c}, '[+-]\d{{2}}:(\d{{2}})$', 1) AS INTEGER), 0)"
    return f"CASE WHEN regexp_matches({c}, {_ISO}) THEN try_cast(replace(CASE WHEN length({base}) = 16 THEN {base} || ':00' ELSE {base} END, 'T', ' ') AS TIMESTAMP) - to_minutes({minutes}) END"


_STATES = ", ".join(f"'{s}'" for s in STATES)
_FOLDED = "' ' || regexp_replace(strip_accents(lower(concat_ws(' ', titulo, descripcion))), '[^a-z0-9_]+', ' ', 'g')"
_ISSUES = f"""
    SELECT fila, c AS campo, 'vacío' AS problema FROM (SELECT fila, unnest(['id_noticia','titulo','url','medio','dominio']) AS c, unnest([id_noticia,titulo,url,medio,dominio]) AS v FROM noticias) WHERE nullif(trim(v), '') IS NULL
    UNION ALL SELECT fila, c, 'fecha inválida' FROM (SELECT fila, unnest(['fecha_publicacion','fecha_deteccion','fecha_extraccion']) AS c, unnest([fecha_publicacion,fecha_deteccion,fecha_extraccion]) AS v FROM noticias) WHERE v IS NOT NULL AND ({_iso("v")}) IS NULL
    UNION ALL SELECT fila, 'url', 'URL rota' FROM noticias WHERE NOT regexp_matches(url, '^https?://[^/?#]*\\.[^/?#]*')
    UNION ALL SELECT fila, 'id_noticia', 'ID inválido' FROM noticias WHERE NOT regexp_matches(id_noticia, '^N-[0-9a-f]{{10}}$')
    UNION ALL SELECT fila, 'origen', 'fuera de lista' FROM noticias WHERE origen NOT IN ('tvn_rss','tvn_web','gdelt')
    UNION ALL SELECT fila, 'alcance_texto', 'fuera de lista' FROM noticias WHERE alcance_texto NOT IN ('titular/metadatos','descripcion_rss','descripcion_web')
    UNION ALL SELECT fila, 'id_noticia', 'duplicado' FROM (SELECT fila, row_number() OVER (PARTITION BY id_noticia ORDER BY fila) AS r FROM noticias WHERE regexp_matches(id_noticia, '^N-[0-9a-f]{{10}}$')) WHERE r > 1
    UNION ALL SELECT a.fila, 'fecha_deteccion', 'fecha_deteccion en ' || a.origen FROM (SELECT fila, id_noticia, origen, {_iso("fecha_deteccion")} AS t FROM noticias WHERE origen IN ('tvn_rss','tvn_web')) a
    LEFT JOIN (SELECT id_noticia, min({_iso("fecha_deteccion")}) AS t FROM noticias WHERE origen = 'gdelt' AND id_noticia IS NOT NULL GROUP BY 1) g USING (id_noticia) WHERE a.t IS NOT NULL AND a.t IS DISTINCT FROM g.t"""
_MAJ = "SELECT {k}, v FROM (SELECT {k}, {v} AS v, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {v}) AS r FROM noticias WHERE {v} IS NOT NULL GROUP BY {k}, {v}) WHERE r = 1"
_TITLE = "SELECT cluster_id, titulo, fila FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE idioma WHEN 'es' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, carga DESC, fila) AS r FROM noticias WHERE titulo IS NOT NULL) WHERE r = 1"
_LATEST = f"SELECT id_caso, linea, estado_revision, revisor FROM (SELECT *, row_number() OVER (PARTITION BY id_caso ORDER BY linea DESC) AS r FROM revisiones WHERE estado_revision IN ({_STATES}) AND id_caso <> '') WHERE r = 1"
_CASES = f"SELECT c.id_caso, coalesce(r.estado_revision, 'nuevo') AS estado, r.revisor FROM (SELECT DISTINCT 'F-' || cluster_id AS id_caso FROM noticias) c LEFT JOIN ({_LATEST}) r USING (id_caso)"
_KINDS = "SELECT n.cluster_id, coalesce(c.tipos, '') AS tipos, coalesce(c.enlaces, 0) AS enlaces FROM (SELECT DISTINCT cluster_id FROM noticias) n LEFT JOIN (SELECT cluster_id, string_agg(DISTINCT tipo, '|' ORDER BY tipo) AS tipos, count(*) AS enlaces FROM contexto GROUP BY 1) c USING (cluster_id)"
_MONTH = r"CASE WHEN regexp_matches(fecha_deteccion, '^\d{8}T\d{6}Z$') THEN left(fecha_deteccion, 6) END"
_LATEST_WB = "SELECT pais_iso3, indicador_id, max(anio) AS anio, round(arg_max(valor, anio), 6) AS valor FROM indicadores WHERE valor IS NOT NULL GROUP BY 1, 2"

SQL = {
    "first_capture": "SELECT id_noticia, fila, carga, origen FROM (SELECT *, row_number() OVER (PARTITION BY id_noticia ORDER BY carga, fila) AS r FROM noticias WHERE id_noticia IS NOT NULL) WHERE r = 1",
    "source_priority": f"SELECT id_noticia, fila, carga, origen FROM (SELECT *, row_number() OVER (PARTITION BY id_noticia ORDER BY {_RANK}, carga, fila) AS r FROM noticias WHERE id_noticia IS NOT NULL) WHERE r = 1",
    "earliest_seen": "SELECT a.fila, a.id_noticia, g.vista FROM noticias a LEFT JOIN (SELECT id_noticia, min(fecha_deteccion) AS vista FROM noticias WHERE origen = 'gdelt' GROUP BY 1) g USING (id_noticia) WHERE a.origen <> 'gdelt'",
    "source_union": "SELECT fila, titulo, origen, CASE WHEN origen <> 'gdelt' THEN descripcion END AS descripcion, CASE WHEN origen = 'gdelt' THEN fecha_deteccion END AS fecha_deteccion FROM noticias WHERE origen IN ('tvn_rss','tvn_web','gdelt')",
    "validation_issues": _ISSUES,
    "issues_by_problem": f"SELECT campo, problema, count(DISTINCT fila) AS filas FROM ({_ISSUES}) GROUP BY 1, 2",
    "validation_totals": f"SELECT count(*) FILTER (b.fila IS NULL) AS validas, count(b.fila) AS rechazadas, count(*) AS leidas FROM noticias n LEFT JOIN (SELECT DISTINCT fila FROM ({_ISSUES})) b USING (fila)",
    "null_counts": "SELECT columna, CAST(sum(x) AS BIGINT) AS nulos FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS columna, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS x FROM noticias" for c in ("fila id_noticia titulo descripcion url medio dominio idioma fecha_publicacion fecha_deteccion fecha_extraccion origen alcance_texto procedencia_id tema tema_confianza cluster_id sintetico recirculada carga").split()) + ") GROUP BY 1",
    "iso_dates": "SELECT fila, " + ", ".join(f"strftime({_iso(c)}, '%Y-%m-%dT%H:%M:%SZ') AS {c}" for c in DATES) + " FROM noticias",
    "recirculated": f"SELECT fila, coalesce(({_iso('fecha_deteccion')}) - ({_iso('fecha_publicacion')}) >= INTERVAL 7 DAY, false) AS tardia FROM noticias",
    "outlet_rollup": "SELECT n.*, m.v AS medio_comun FROM (SELECT origen, dominio, count(*) AS n, min(carga) AS primera, max(carga) AS ultima FROM noticias WHERE origen IS NOT NULL AND dominio IS NOT NULL GROUP BY 1, 2) n JOIN (" + _MAJ.format(k="origen, dominio", v="medio") + ") m USING (origen, dominio)",
    "origin_counts": "SELECT origen, count(*) AS n FROM noticias GROUP BY 1",
    "top_languages": "SELECT * FROM (SELECT origen, idioma, count(*) AS n, row_number() OVER (PARTITION BY origen ORDER BY count(*) DESC, idioma ASC NULLS LAST) AS puesto FROM noticias GROUP BY 1, 2) WHERE puesto <= 4",
    "cluster_rollup": "SELECT c.*, coalesce(m.v, 'otro') AS tema FROM (SELECT cluster_id, string_agg(CAST(fila AS VARCHAR), ',' ORDER BY fila) AS filas, count(*) AS n_registros, count(DISTINCT coalesce(procedencia_id, 'P-' || coalesce(dominio, 'desconocido'))) AS n_procedencias, count(DISTINCT medio) AS n_medios, string_agg(DISTINCT medio, '|' ORDER BY medio) AS medios, bool_or(recirculada) AS recirculada FROM noticias GROUP BY 1) c LEFT JOIN (" + _MAJ.format(k="cluster_id", v="tema") + ") m USING (cluster_id)",
    "cluster_key": "SELECT cluster_id, CASE WHEN count(*) = 1 THEN 'K-' || substring(min(id_noticia), 3) ELSE 'K-' || left(sha1(string_agg(id_noticia, '|' ORDER BY id_noticia)), 10) END AS clave FROM (SELECT DISTINCT cluster_id, id_noticia FROM noticias WHERE id_noticia IS NOT NULL) GROUP BY 1",
    "latest_title": _TITLE,
    "period_filter": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1",
    "month_windows": "SELECT strftime(m, '%Y-%m') AS mes, strftime(greatest(a, m), '%Y-%m-%d') AS inicio, strftime(least(b + INTERVAL 1 DAY, m + INTERVAL 1 MONTH), '%Y-%m-%d') AS fin FROM (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b, unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)",
    "todo_requests": f"WITH n AS (SELECT DISTINCT {_MONTH} AS mes, tema, origen FROM noticias WHERE tema IS NOT NULL) SELECT * FROM (SELECT DISTINCT mes FROM n WHERE mes IS NOT NULL) CROSS JOIN (SELECT DISTINCT tema FROM n WHERE mes IS NOT NULL) CROSS JOIN (SELECT DISTINCT origen FROM n WHERE mes IS NOT NULL) EXCEPT SELECT mes, tema, origen FROM n",
    "month_quota": f"SELECT mes, fila, puesto FROM (SELECT mes, fila, row_number() OVER (PARTITION BY mes ORDER BY h, fila) AS puesto FROM (SELECT *, row_number() OVER (PARTITION BY mes ORDER BY h, fila) AS r FROM (SELECT fila, {_MONTH} AS mes, sha1(url) AS h, procedencia_id FROM noticias WHERE url IS NOT NULL) WHERE mes IS NOT NULL) WHERE r <= 200 AND procedencia_id IS NOT NULL) WHERE puesto <= 100",
    "grid_complete": "WITH i AS (SELECT * FROM indicadores WHERE valor IS NOT NULL) SELECT p.pais_iso3, q.indicador_id, y.anio, i.valor FROM (SELECT DISTINCT pais_iso3 FROM i) p CROSS JOIN (SELECT DISTINCT indicador_id FROM i) q CROSS JOIN (SELECT DISTINCT anio FROM i) y LEFT JOIN i ON i.pais_iso3 = p.pais_iso3 AND i.indicador_id = q.indicador_id AND i.anio = y.anio",
    "latest_indicator": _LATEST_WB,
    "indicator_context": "WITH t AS (SELECT c.cluster_id, coalesce(m.v, 'otro') AS tema FROM (SELECT DISTINCT cluster_id FROM noticias) c LEFT JOIN (" + _MAJ.format(k="cluster_id", v="tema") + ") m USING (cluster_id)), w(i, p) AS (VALUES " + ", ".join(f"('{i}', ' ({'|'.join(ws)})')" for i, ws in INDICATOR_WORDS.items()) + "), a(tema, i) AS (VALUES " + ", ".join(f"('{t}', '{i}')" for t, ids in TOPIC_INDICATORS.items() for i in ids) + f"), h AS (SELECT DISTINCT n.cluster_id, w.i FROM noticias n JOIN w ON regexp_matches({_FOLDED}, w.p)) SELECT t.cluster_id, 'WB-PAN-' || a.i || '-' || y.anio AS id_evidencia FROM t JOIN a USING (tema) JOIN h ON h.cluster_id = t.cluster_id AND h.i = a.i JOIN ({_LATEST_WB}) y ON y.indicador_id = a.i AND y.pais_iso3 = 'PAN'",
    "quake_news": f"SELECT n.fila, s.id FROM (SELECT fila, {_iso('fecha_publicacion')} AS t FROM noticias WHERE tema = 'eventos naturales') n JOIN (SELECT id, try_cast(replace(replace(time, 'T', ' '), 'Z', '') AS TIMESTAMP) AS q FROM sismos) s ON n.t BETWEEN s.q - INTERVAL 72 HOUR AND s.q + INTERVAL 72 HOUR",
    "quakes_sorted": "SELECT id, time, round(magnitude, 2) AS magnitude, row_number() OVER (ORDER BY coalesce(time, ''), id) AS puesto FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC) AS r FROM sismos WHERE updated IS NOT NULL) WHERE r = 1",
    "context_kinds": _KINDS,
    "missing_evidence": "SELECT cluster_id, id_evidencia, tipo, id_evidencia IN (SELECT 'WB-' || pais_iso3 || '-' || indicador_id || '-' || anio FROM indicadores WHERE valor IS NOT NULL UNION SELECT id FROM sismos) AS presente FROM contexto",
    "latest_review": _LATEST,
    "review_history": f"SELECT id_caso, count(*) AS n, string_agg(estado_revision, ' > ' ORDER BY fecha_revision DESC, linea DESC) AS historia FROM revisiones WHERE estado_revision IN ({_STATES}) AND id_caso <> '' GROUP BY 1",
    "review_rejects": f"SELECT estado_revision, count(*) AS n FROM revisiones WHERE NOT coalesce(estado_revision IN ({_STATES}), false) OR coalesce(id_caso, '') = '' GROUP BY 1",
    "case_state": _CASES,
    "ranked_clusters": "SELECT *, row_number() OVER (ORDER BY procedencias DESC, n DESC, cluster_id) AS posicion FROM (SELECT cluster_id, count(DISTINCT coalesce(procedencia_id, dominio)) AS procedencias, count(*) AS n FROM noticias GROUP BY 1) QUALIFY posicion <= 10",
    "weighted_rank": "WITH t AS (SELECT tema, count(descripcion) / count(*) AS y, count(DISTINCT dominio) / count(*) AS x FROM noticias WHERE tema IS NOT NULL GROUP BY 1), u AS (SELECT tema, round_even((30 * x + 70 * y) * 1e6, 0) / 1e6 AS p, round_even((70 * x + 30 * y) * 1e6, 0) / 1e6 AS q FROM t), v AS (SELECT *, row_number() OVER (ORDER BY p DESC, tema) AS oficial, row_number() OVER (ORDER BY q DESC, tema) AS simulado FROM u) SELECT *, oficial - simulado AS cambio FROM v",
    "inbox": f"SELECT b.*, t.titulo, k.tipos, s.estado FROM (SELECT cluster_id, count(*) AS n, string_agg(DISTINCT idioma, '|' ORDER BY idioma) AS idiomas, bool_or(sintetico) AS sintetico FROM noticias GROUP BY 1 HAVING count(*) >= 2 AND bool_or(idioma IN ('es', 'en'))) b LEFT JOIN ({_TITLE}) t USING (cluster_id) LEFT JOIN ({_KINDS}) k USING (cluster_id) LEFT JOIN (SELECT substring(id_caso, 3) AS cluster_id, estado FROM ({_CASES})) s USING (cluster_id)",
}
