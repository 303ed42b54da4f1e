"""Queries around a case: official context by rules, inputs of its score, sources, inbox, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brujula.functions.text import folded
from brujula.operators import merge, rollups, validation
from brujula.plans import tables
from brujula.plans.reports import INDICATOR_NAMES
from brujula.plans.tables import INDICATOR_WORDS, TOPIC_INDICATORS
from brujula.session import spread, table

#: How a text says that it is on the country: a word's part, and whole words (fixed values).
COUNTRY_PART, COUNTRY_WORDS = "panam", ("inec", "mef", "ima", "acp", "css", "idaan")
QUAKE_WORDS = ("sismo", "terremoto", "temblor", "earthquake", "quake")
NATURAL = "eventos naturales"
WINDOW_H = 72


def _news(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "noticias")


def _seen(column: str):
    return validation.iso_timestamp(F.col(column))


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _mentions(spark, d):
    """cluster_id, pais (named), sismo (named), dichas (indicator, word's number and word) over all texts of each cluster."""
    text = F.concat(F.lit(" "), F.regexp_replace(folded(F.concat_ws(" ", "titulo", "descripcion")), r"\W+", " "), F.lit(" "))
    country = lambda x: x.contains(COUNTRY_PART) | x.rlike(" (?:" + "|".join(COUNTRY_WORDS) + ") ")
    words = [(i, n, w) for i, ws in INDICATOR_WORDS.items() for n, w in enumerate(ws)]
    said = lambda x: F.array_compact(F.array(*[F.when(x.contains(" " + w), F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(w).alias("w"))) for i, n, w in words]))
    read = F.transform(F.array(text), lambda x: F.struct(country(x).alias("pais"), x.rlike(" (?:" + "|".join(QUAKE_WORDS) + ")").alias("sismo"), said(x).alias("dichas")))[0]
    rows = spread(_news(spark, d).select("cluster_id", "fila", "titulo", "descripcion"), "fila").select("cluster_id", read.alias("r"))
    return rows.groupBy("cluster_id").agg(F.bool_or("r.pais").alias("pais"), F.bool_or("r.sismo").alias("sismo"), F.array_distinct(F.flatten(F.collect_set("r.dichas"))).alias("dichas"))


def context_links(spark, d):
    """Union of both rules, sorted: cluster_id, id_evidencia, tipo, regla.

    Indicators: the topic allows them, the texts name the country and one of their words (the first three named
    stand in the rule); latest year with a value. Quakes: natural events that name a quake, within 72 hours of the cluster's span.
    """
    topic = rollups.majority(_news(spark, d), ["cluster_id"], "tema", "tema", "otro")
    said = _mentions(spark, d).join(topic, "cluster_id")
    allowed = F.create_map(*[x for t, ids in TOPIC_INDICATORS.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in ids]))])
    names = F.create_map(*[F.lit(x) for pair in INDICATOR_NAMES.items() for x in pair])
    own = said.filter("pais").select("cluster_id", "tema", "dichas", F.explode(allowed[F.col("tema")]).alias("i"))
    first = F.slice(F.transform(F.array_sort(F.filter("dichas", lambda x: x.i == F.col("i"))), lambda x: x.w), 1, 3)
    own = own.select("cluster_id", "tema", "i", F.array_join(first, ", ").alias("palabras")).filter("palabras <> ''")
    years = tables.latest_indicator(spark, d).filter("pais_iso3 = 'PAN'").select(F.col("indicador_id").alias("i"), "anio")
    rule = F.concat(F.lit("tema '"), "tema", F.lit("' + menciona Panamá + menciona "), "palabras", F.lit(" -> "), names[F.col("i")])
    indicators = own.join(years, "i").select("cluster_id", F.concat_ws("-", F.lit("WB-PAN"), "i", F.col("anio").cast("string")).alias("id_evidencia"), F.lit("indicador").alias("tipo"), rule.alias("regla"))
    when = F.coalesce(_seen("fecha_publicacion"), _seen("fecha_deteccion"))
    hours = F.expr(f"interval {WINDOW_H} hour")
    spans = _news(spark, d).select("cluster_id", when.alias("t")).groupBy("cluster_id").agg((F.min("t") - hours).alias("desde"), (F.max("t") + hours).alias("hasta"))
    spans = spans.join(said.filter((F.col("tema") == NATURAL) & F.col("sismo")).select("cluster_id"), "cluster_id")
    quakes = table(spark, d, "sismos").select("id", F.try_to_timestamp("time").alias("q"))
    near = rollups.interval_join(quakes, spans, "q", "desde", "hasta", WINDOW_H * 3600)
    rule = F.lit("tema 'eventos naturales' + menciona un sismo + sismo a 72 h o menos")
    return indicators.unionByName(near.select("cluster_id", F.col("id").alias("id_evidencia"), F.lit("sismo").alias("tipo"), rule.alias("regla")))


def score_inputs(spark, d):
    """What a cluster's score is made of: counts, official kinds, and the latest publication, else detection (ISO dates)."""
    news = _news(spark, d).select("cluster_id", "procedencia_id", "dominio", "recirculada", _seen("fecha_publicacion").alias("p"), _seen("fecha_deteccion").alias("q"))
    base = news.groupBy("cluster_id").agg(
        F.count("*").alias("n_registros"), F.countDistinct(F.coalesce("procedencia_id", "dominio")).alias("n_procedencias"), F.max("p").alias("p"), F.max("q").alias("q"),
        F.least(F.min("p"), F.min("q")).alias("primera"), F.coalesce(F.bool_or("recirculada"), F.lit(False)).alias("recirculada"),
    )
    kinds = table(spark, d, "contexto").groupBy("cluster_id").agg(F.bool_or(F.col("tipo") == "indicador").alias("hay_indicador"), F.lit(True).alias("hay_oficial"))
    basis = F.when(F.col("p").isNotNull(), "publicacion").when(F.col("q").isNotNull(), "deteccion").otherwise("sin_fecha")
    out = base.join(kinds, "cluster_id", "left")
    return out.select("cluster_id", "n_registros", "n_procedencias", "recirculada", F.coalesce("hay_indicador", F.lit(False)).alias("hay_indicador"), F.coalesce("hay_oficial", F.lit(False)).alias("hay_oficial"), _iso(F.coalesce("p", "q")).alias("referencia"), basis.alias("base"), _iso("primera").alias("primera"))


def corpus_latest(spark, d):
    """Latest publication or detection of the corpus."""
    both = _news(spark, d).select(F.explode(F.array(_seen("fecha_publicacion"), _seen("fecha_deteccion"))).alias("t"))
    return both.agg(_iso(F.max("t")).alias("ultima"))


def cluster_sources(spark, d):
    """Rows of the clusters of two or more, newest first by detection, else publication (undated last, then by row)."""
    news = _news(spark, d).select("cluster_id", "fila", "titulo", F.coalesce(_seen("fecha_deteccion"), _seen("fecha_publicacion")).alias("t"))
    several = news.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n > 1").select("cluster_id")
    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("t"), "fila")
    return news.join(several, "cluster_id").select("cluster_id", "fila", F.row_number().over(w).alias("puesto"))


def recent_title(spark, d):
    """Title of each cluster's most recent row (publication, else detection; undated last)."""
    t = F.coalesce(_seen("fecha_publicacion"), _seen("fecha_deteccion"))
    news = _news(spark, d).filter("titulo IS NOT NULL").select("cluster_id", "titulo", "fila", t.alias("t"))
    return merge.keep_first(news, ["cluster_id"], [F.col("t").isNull(), -F.unix_micros("t"), F.col("fila")]).select("cluster_id", "fila", "titulo")


def filter_inbox(inbox: DataFrame, topics=None, states=None, languages=None, top: int | None = 20) -> DataFrame:
    """The inbox in order of posicion with the given topics, states and languages only (none given: all), its head."""
    for column, allowed in (("tema", topics), ("estado", states)):
        if allowed:
            inbox = inbox.filter(F.col(column).isin(*allowed))
    if languages:
        inbox = inbox.filter(F.arrays_overlap(F.split("idiomas", r"\|"), F.array(*[F.lit(x) for x in languages])))
    return inbox.orderBy("posicion").limit(top) if top else inbox


def _ranked_inbox(spark, d):
    news = _news(spark, d)
    topic = rollups.majority(news, ["cluster_id"], "tema", "tema", "otro")
    size = news.groupBy("cluster_id").agg(F.countDistinct(F.coalesce("procedencia_id", "dominio")).alias("procedencias"))
    rows = tables.inbox(spark, d).join(topic, "cluster_id").join(size, "cluster_id")
    order = rows.select("cluster_id", "n", (-F.col("procedencias")).alias("_p"), (-F.col("n")).alias("_q"))
    return rows.join(rollups.global_rank(order, ["_p", "_q", "cluster_id"], "posicion").select("cluster_id", "posicion"), "cluster_id")


def inbox_head(spark, d):
    """The first twenty clusters in Spanish on economy, services or regulation that are still open (top-k report)."""
    head = filter_inbox(_ranked_inbox(spark, d), ("economía", "servicios públicos", "regulación"), ("nuevo", "en revisión", "requiere evidencia"), ("es",))
    return head.select("cluster_id", "posicion", "tema", "estado", "idiomas", "n")


def pushed_out(spark, d):
    """Topics of the official first three and of the simulated first three, and which are pushed out by the simulation."""
    r = tables.weighted_rank(spark, d).filter("oficial <= 3 OR simulado <= 3")
    return r.select("tema", "oficial", "simulado", ((F.col("oficial") <= 3) & (F.col("simulado") > 3)).alias("sale"))


def topic_keys(spark, d):
    """Topics and the keys under which rules hold them."""
    key = F.regexp_replace(F.regexp_replace(folded(F.col("tema")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return _news(spark, d).select("tema").filter("tema IS NOT NULL").distinct().select("tema", key.alias("clave"))


def news_text(spark, d):
    """The text by which a row is read: title and description."""
    return _news(spark, d).select("fila", F.trim(F.concat_ws(" ", F.coalesce("titulo", F.lit("")), F.coalesce("descripcion", F.lit("")))).alias("texto"))


def case_cards(spark, d):
    """One card per cluster of two rows or more: sources, counts, official evidence, title and latest review."""
    news = _news(spark, d).select("cluster_id", "fila", "id_noticia", "recirculada", "sintetico", F.coalesce("procedencia_id", "dominio").alias("prov"))
    base = news.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.countDistinct("prov").alias("procedencias"), F.array_join(F.sort_array(F.collect_set("id_noticia")), "|").alias("fuentes"),
        F.coalesce(F.bool_or("recirculada"), F.lit(False)).alias("recirculada"), F.coalesce(F.bool_or("sintetico"), F.lit(False)).alias("sintetico"),
    ).filter("n > 1")
    official = table(spark, d, "contexto").groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_set("id_evidencia")), "|").alias("oficiales"))
    title = recent_title(spark, d).select("cluster_id", "titulo")
    state = tables.latest_review(spark, d).select("id_caso", "estado_revision", "revisor")
    cards = base.join(official, "cluster_id", "left").join(title, "cluster_id", "left").withColumn("id_caso", F.concat(F.lit("F-"), "cluster_id")).join(state, "id_caso", "left")
    return cards.select("id_caso", "titulo", "n", "procedencias", "fuentes", F.coalesce("oficiales", F.lit("")).alias("oficiales"), "recirculada", "sintetico", F.coalesce("estado_revision", F.lit("nuevo")).alias("estado"), "revisor")


QUERIES = {
    f.__name__: f
    for f in (context_links, score_inputs, corpus_latest, cluster_sources, recent_title, inbox_head, pushed_out, topic_keys, news_text, case_cards)
}

_P, _Q = tables._iso("fecha_publicacion"), tables._iso("fecha_deteccion")
_DAY = "'%Y-%m-%dT%H:%M:%SZ'"
_WORDS = ", ".join(f"('{i}', {n}, '{w}')" for i, ws in INDICATOR_WORDS.items() for n, w in enumerate(ws))
_ALLOWED = ", ".join(f"('{t}', '{i}')" for t, ids in TOPIC_INDICATORS.items() for i in ids)
_NAMES = ", ".join(f"('{i}', '{n}')" for i, n in INDICATOR_NAMES.items())
_TOPIC = "SELECT c.cluster_id, coalesce(m.v, 'otro') AS tema FROM (SELECT DISTINCT cluster_id FROM noticias) c LEFT JOIN (" + tables._MAJ.format(k="cluster_id", v="tema") + ") m USING (cluster_id)"
_RANKED = f"SELECT b.*, t.tema, row_number() OVER (ORDER BY s.p DESC, b.n DESC, b.cluster_id) AS posicion FROM ({tables.SQL['inbox']}) b JOIN ({_TOPIC}) t USING (cluster_id) JOIN (SELECT cluster_id, count(DISTINCT coalesce(procedencia_id, dominio)) AS p FROM noticias GROUP BY 1) s USING (cluster_id)"
_RECENT = f"SELECT cluster_id, fila, titulo FROM (SELECT cluster_id, fila, titulo, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce({_P}, {_Q}) DESC NULLS LAST, fila) AS r FROM noticias WHERE titulo IS NOT NULL) WHERE r = 1"

SQL = {
    "context_links": f"""
        WITH x AS (SELECT cluster_id, {tables._FOLDED} || ' ' AS x, coalesce({_P}, {_Q}) AS t FROM noticias), t AS ({_TOPIC}),
        w(i, n, w) AS (VALUES {_WORDS}), a(tema, i) AS (VALUES {_ALLOWED}), m(i, nombre) AS (VALUES {_NAMES}),
        c AS (SELECT cluster_id, bool_or(contains(x, '{COUNTRY_PART}') OR regexp_matches(x, ' ({'|'.join(COUNTRY_WORDS)}) ')) AS pais, bool_or(regexp_matches(x, ' ({'|'.join(QUAKE_WORDS)})')) AS sismo, min(t) AS desde, max(t) AS hasta FROM x GROUP BY 1),
        h AS (SELECT DISTINCT x.cluster_id, w.i, w.n, w.w FROM x JOIN w ON contains(x.x, ' ' || w.w)),
        k AS (SELECT cluster_id, i, string_agg(w, ', ' ORDER BY n) AS palabras FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, i ORDER BY n) AS r FROM h) WHERE r <= 3 GROUP BY 1, 2)
        SELECT t.cluster_id, 'WB-PAN-' || a.i || '-' || y.anio AS id_evidencia, 'indicador' AS tipo, 'tema ''' || t.tema || ''' + menciona Panamá + menciona ' || k.palabras || ' -> ' || m.nombre AS regla
        FROM t JOIN c USING (cluster_id) JOIN a USING (tema) JOIN k ON k.cluster_id = t.cluster_id AND k.i = a.i JOIN m ON m.i = a.i JOIN ({tables._LATEST_WB}) y ON y.indicador_id = a.i AND y.pais_iso3 = 'PAN' WHERE c.pais
        UNION ALL SELECT t.cluster_id, s.id, 'sismo', 'tema ''eventos naturales'' + menciona un sismo + sismo a 72 h o menos'
        FROM t JOIN c USING (cluster_id) JOIN (SELECT id, try_cast(replace(replace(time, 'T', ' '), 'Z', '') AS TIMESTAMP) AS q FROM sismos) s ON s.q BETWEEN c.desde - INTERVAL 72 HOUR AND c.hasta + INTERVAL 72 HOUR WHERE t.tema = '{NATURAL}' AND c.sismo""",
    "score_inputs": f"""
        WITH n AS (SELECT cluster_id, coalesce(procedencia_id, dominio) AS v, recirculada, {_P} AS p, {_Q} AS q FROM noticias),
        b AS (SELECT cluster_id, count(*) AS n_registros, count(DISTINCT v) AS n_procedencias, coalesce(bool_or(recirculada), false) AS recirculada, max(p) AS p, max(q) AS q, least(min(p), min(q)) AS primera FROM n GROUP BY 1),
        k AS (SELECT cluster_id, bool_or(tipo = 'indicador') AS i FROM contexto GROUP BY 1)
        SELECT b.cluster_id, n_registros, n_procedencias, recirculada, coalesce(k.i, false) AS hay_indicador, k.cluster_id IS NOT NULL AS hay_oficial, strftime(coalesce(p, q), {_DAY}) AS referencia,
        CASE WHEN p IS NOT NULL THEN 'publicacion' WHEN q IS NOT NULL THEN 'deteccion' ELSE 'sin_fecha' END AS base, strftime(primera, {_DAY}) AS primera FROM b LEFT JOIN k USING (cluster_id)""",
    "corpus_latest": f"SELECT strftime(max(t), {_DAY}) AS ultima FROM (SELECT {_P} AS t FROM noticias UNION ALL SELECT {_Q} FROM noticias)",
    "cluster_sources": f"SELECT cluster_id, fila, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce({_Q}, {_P}) DESC NULLS LAST, fila) AS puesto FROM noticias WHERE cluster_id IN (SELECT cluster_id FROM noticias GROUP BY 1 HAVING count(*) > 1)",
    "recent_title": _RECENT,
    "inbox_head": f"SELECT cluster_id, posicion, tema, estado, idiomas, n FROM ({_RANKED}) WHERE tema IN ('economía', 'servicios públicos', 'regulación') AND estado IN ('nuevo', 'en revisión', 'requiere evidencia') AND list_contains(string_split(idiomas, '|'), 'es') ORDER BY posicion LIMIT 20",
    "pushed_out": f"SELECT tema, oficial, simulado, oficial <= 3 AND simulado > 3 AS sale FROM ({tables.SQL['weighted_rank']}) WHERE oficial <= 3 OR simulado <= 3",
    "topic_keys": "SELECT DISTINCT tema, regexp_replace(regexp_replace(strip_accents(lower(tema)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS clave FROM noticias WHERE tema IS NOT NULL",
    "news_text": "SELECT fila, trim(coalesce(titulo, '') || ' ' || coalesce(descripcion, '')) AS texto FROM noticias",
    "case_cards": f"""
        WITH b AS (SELECT cluster_id, count(*) AS n, count(DISTINCT coalesce(procedencia_id, dominio)) AS procedencias, coalesce(string_agg(DISTINCT id_noticia, '|' ORDER BY id_noticia), '') AS fuentes, coalesce(bool_or(recirculada), false) AS recirculada, coalesce(bool_or(sintetico), false) AS sintetico FROM noticias GROUP BY 1 HAVING count(*) > 1),
        o AS (SELECT cluster_id, string_agg(DISTINCT id_evidencia, '|' ORDER BY id_evidencia) AS oficiales FROM contexto GROUP BY 1)
        SELECT 'F-' || b.cluster_id AS id_caso, t.titulo, b.n, b.procedencias, b.fuentes, coalesce(o.oficiales, '') AS oficiales, b.recirculada, b.sintetico, coalesce(r.estado_revision, 'nuevo') AS estado, r.revisor
        FROM b LEFT JOIN o USING (cluster_id) LEFT JOIN ({_RECENT}) t USING (cluster_id) LEFT JOIN ({tables._LATEST}) r ON r.id_caso = 'F-' || b.cluster_id""",
}
