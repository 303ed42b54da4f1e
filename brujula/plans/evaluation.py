"""Queries that measure: guard on answers, choice of a threshold, same base of two systems, blind labels, recall of the search, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brujula.operators import guard, lexical, metrics, validation, vectors
from brujula.plans import scores, texts
from brujula.session import cut, table

THRESHOLDS, CURRENT = (0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8), 0.45
#: What a note says of a label that isn't blind (fixed value of these tables).
SEEN = "dudoso"
LANGUAGES = ("es", "en")
SEEDS = 40
PRICE_IN, PRICE_OUT = 0.15, 0.60  # of a million tokens


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """id_fuente, tipo, campos, anio of news (first row of an id), indicator cells and quakes."""
    news = table(spark, d, "noticias").filter("id_noticia IS NOT NULL").groupBy("id_noticia").agg(F.min_by(F.struct("titulo", "descripcion", "medio"), "fila").alias("x"))
    full = lambda m: F.map_filter(m, lambda k, v: v.isNotNull())
    fields = full(F.create_map(F.lit("titulo"), "x.titulo", F.lit("descripcion"), "x.descripcion", F.lit("medio"), "x.medio"))
    one = news.select(F.col("id_noticia").alias("id_fuente"), F.lit("noticia").alias("tipo"), fields.alias("campos"), F.lit(None).cast("bigint").alias("anio"))
    i = table(spark, d, "indicadores").filter("valor IS NOT NULL")
    cell = full(F.create_map(*[x for c in ("indicador_id", "pais_iso3", "anio", "valor", "unidad") for x in (F.lit(c), F.col(c).cast("string"))]))
    two = i.select(F.concat_ws("-", F.lit("WB"), "pais_iso3", "indicador_id", F.col("anio").cast("string")).alias("id_fuente"), F.lit("indicador").alias("tipo"), cell.alias("campos"), F.col("anio").cast("bigint").alias("anio"))
    quake = full(F.create_map(*[x for c in ("magnitude", "time", "place", "depth") for x in (F.lit(c), F.col(c).cast("string"))]))
    three = table(spark, d, "sismos").select(F.col("id").alias("id_fuente"), F.lit("sismo").alias("tipo"), quake.alias("campos"), F.lit(None).cast("bigint").alias("anio"))
    return one.unionByName(two).unionByName(three)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer (JSON) per label: its title as a fact with a citation of its row, its description as the draft."""
    e = table(spark, d, "etiquetas").filter("id_noticia IS NOT NULL AND titulo IS NOT NULL").groupBy("id_noticia").agg(F.min(F.struct("titulo", "descripcion")).alias("x"))
    cite = F.struct(F.col("id_noticia").alias("id_fuente"), F.lit("titulo").alias("campo"), F.substring("x.titulo", 1, 60).alias("pasaje"))
    claim = F.struct(F.col("x.titulo").alias("texto"), F.lit("hecho").alias("tipo"), F.array(cite).alias("citas"))
    body = F.struct(F.lit(False).alias("abstencion"), F.array(claim).alias("afirmaciones"), F.col("x.descripcion").alias("borrador"))
    return e.select(F.col("id_noticia").alias("id"), F.concat(F.lit("```json\n"), F.to_json(body), F.lit("\n```")).alias("salida"))


def guard_report(spark, d):
    """What the guard leaves of each answer."""
    return guard.guard(_answers(spark, d), _evidence(spark, d))


def guard_totals(spark, d):
    """Ratios of the guard's work over all answers; null without cases."""
    g = cut(guard_report(spark, d), "guard")
    return g.agg(
        F.count("*").alias("respuestas"), metrics.ratio(F.sum("afirmaciones_validas"), F.nullif(F.sum("afirmaciones"), F.lit(0))).alias("afirmaciones"),
        metrics.ratio(F.sum("citas_validas"), F.nullif(F.sum("citas"), F.lit(0))).alias("citas"), F.count_if("abstencion").alias("abstenciones"), F.count_if(F.col("bloqueada").isNotNull()).alias("bloqueadas"),
    )


def threshold_choice(spark, d):
    """Macro-F1 of each threshold on the calibration half, and the one chosen (best; ties: the current one, then the lower)."""
    rows = scores._labelled(spark, d).filter("tema_humano IS NOT NULL").join(scores.split_halves(spark, d), "id_noticia").filter("mitad = 1")
    grid = rows.select("tema_humano", "tema", "tema_confianza", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("umbral"))
    said = grid.select("umbral", "tema_humano", F.when(F.col("tema_confianza") >= F.col("umbral"), F.col("tema")).otherwise("otro").alias("dicho"))
    both = said.select("umbral", "tema_humano", "dicho", F.explode(F.array_distinct(F.array("tema_humano", "dicho"))).alias("e")).filter("e IS NOT NULL")
    f = both.groupBy("umbral", "e").agg(F.count_if((F.col("tema_humano") == F.col("e")) & (F.col("dicho") == F.col("e"))).alias("vp"), F.count_if(F.col("tema_humano") == F.col("e")).alias("a"), F.count_if(F.col("dicho") == F.col("e")).alias("b"))
    per = f.groupBy("umbral").agg(F.round(F.avg(2 * F.col("vp") / (F.col("a") + F.col("b"))), 6).alias("macro_f1"))
    best = F.max(F.struct(F.coalesce("macro_f1", F.lit(0.0)).alias("m"), (F.col("umbral") == CURRENT).alias("c"), (-F.col("umbral")).alias("u"))).over(Window.partitionBy())  # a row per threshold
    return per.withColumn("_b", best).select("umbral", "macro_f1", (F.col("umbral") == -F.col("_b.u")).alias("elegido"))


def same_base(spark, d):
    """Macro-F1 of the stored topics and of those by keywords over the same topics: those measured for both, or for either (a missing one counts 0)."""
    rows = cut(scores._labelled(spark, d).join(texts.topic_keywords(spark, d).select("fila", F.col("tema").alias("clave")), "fila"), "labelled")
    one = metrics.label_scores(rows, "tema_humano", "tema").select("etiqueta", F.col("f1").alias("a"))
    two = metrics.label_scores(rows, "tema_humano", "clave").select("etiqueta", F.col("f1").alias("b"))
    both = one.join(two, "etiqueta", "full").filter("a IS NOT NULL OR b IS NOT NULL")
    mean = lambda rows, base: rows.agg(F.lit(base).alias("base"), F.count("*").alias("temas"), F.round(F.avg(F.coalesce("a", F.lit(0.0))), 6).alias("guardado"), F.round(F.avg(F.coalesce("b", F.lit(0.0))), 6).alias("palabras"))
    return mean(both.filter("a IS NOT NULL AND b IS NOT NULL"), "comunes").unionByName(mean(both, "union"))


def blind_pairs(spark, d):
    """Pair scores with every label whose note says that it isn't blind put back to an event of its own."""
    rows = scores._labelled(spark, d)
    own = F.when(F.contains(F.lower(F.coalesce("nota", F.lit(""))), F.lit(SEEN)), F.concat(F.lit("ciega-"), "id_noticia")).otherwise(F.col("cluster_humano"))
    return metrics.pair_scores(rows.withColumn("cluster_humano", own), "cluster_humano", "cluster_id")


def distance_grid(spark, d):
    """Pair scores of complete linkage at several cosine distances against the labels of the vectors."""
    e = table(spark, d, "embeddings")
    pairs = cut(vectors.all_close_pairs(e, "vec_id", "embedding", 0.3 - 1e-9).withColumn("d", 1 - F.col("coseno")), "pairs")
    out = None
    for x in (0.5, 0.6, 0.7):
        g = vectors.linkage_clusters(e, "vec_id", pairs.filter(F.col("d") <= x + 1e-9)).join(e.select("vec_id", "label"), "vec_id")
        one = metrics.pair_scores(g, "label", "grupo").select(F.lit(x).alias("distancia"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def search_recall(spark, d):
    """Of the rows that carry a searched label's id, how many the search finds among its evidence."""
    asked = texts._asked(spark, d).select("consulta")
    want = asked.join(table(spark, d, "noticias").filter("titulo IS NOT NULL").select(F.col("id_noticia").alias("consulta"), F.col("fila").cast("string").alias("evidencia")), "consulta")
    hit = texts.search_evidence(spark, d).select("consulta", "evidencia", F.lit(1).alias("h"))
    per = want.join(hit, ["consulta", "evidencia"], "left")
    return per.agg(F.countDistinct("consulta").alias("consultas"), F.count("*").alias("esperadas"), F.count("h").alias("halladas"), metrics.ratio(F.count("h"), F.nullif(F.count("*"), F.lit(0))).alias("recall"))


def cost_summary(spark, d):
    """Per source of documents: number, median and 95th percentile of their sizes and what reading and writing them would cost,
    null as soon as one size is unknown (never assumed free)."""
    n = table(spark, d, "documents").select("source", "n_chars", metrics.cost_usd(F.col("n_chars"), F.col("n_chars") / 2, PRICE_IN, PRICE_OUT).alias("c"))
    per = n.groupBy("source").agg(F.count("*").alias("textos"), F.count("c").alias("conocidos"), F.round(F.sum("c"), 8).alias("s"))
    p = metrics.percentiles(n, ["source"], "n_chars").select(F.col("source").alias("_s"), "p95", "mediana")
    return per.join(p, per["source"].eqNullSafe(p["_s"])).select("source", "textos", "mediana", "p95", F.when(F.col("conocidos") == F.col("textos"), F.col("s")).alias("costo_usd"))


def _pool(spark, d):
    when = F.coalesce(validation.iso_timestamp(F.col("fecha_publicacion")), validation.iso_timestamp(F.col("fecha_deteccion")))
    news = table(spark, d, "noticias").filter(F.col("idioma").isin(*LANGUAGES) & F.col("id_noticia").isNotNull())
    return news.select(F.col("fila").alias("id"), "id_noticia", F.unix_seconds(when).alias("t"), F.concat_ws(" ", "titulo", "descripcion").alias("texto"))


def nearest_in_time(spark, d):
    """For the rows whose number divides by 100 the most similar other row within 72 hours (words of title and description)."""
    pool = cut(_pool(spark, d), "pool")
    return lexical.nearest_in_window(pool, pool.filter("id % 100 = 0").select("id"), 72 * 3600)


def label_sample(spark, d):
    """A fixed sample for labelling: the first rows in a seeded hash order (a sampling operator) and the nearest neighbour of each within 72 hours."""
    pool = cut(_pool(spark, d), "pool")
    seeds = cut(pool.orderBy(F.sha1(F.concat(F.lit("42|"), "id_noticia")), "id").limit(SEEDS).select("id"), "seeds")
    near = lexical.nearest_in_window(pool, seeds, 72 * 3600).select(F.col("vecino").alias("id")).distinct().join(seeds, "id", "left_anti")
    return seeds.withColumn("papel", F.lit("semilla")).unionByName(near.withColumn("papel", F.lit("vecino"))).select(F.col("id").alias("fila"), "papel")


QUERIES = {
    f.__name__: f
    for f in (guard_report, guard_totals, threshold_choice, same_base, blind_pairs, distance_grid, search_recall, cost_summary, nearest_in_time, label_sample)
}

_KEY = f"SELECT fila, tema AS clave FROM ({texts.SQL['topic_keywords']})"
_F1 = "SELECT e, 2 * count(*) FILTER (h = e AND g = e) / (count(*) FILTER (h = e) + count(*) FILTER (g = e)) AS f1 FROM (SELECT h, g, unnest(list_distinct([h, g])) AS e FROM {t}) WHERE e IS NOT NULL GROUP BY 1"
_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_noticia ORDER BY fila) AS r FROM noticias WHERE id_noticia IS NOT NULL) WHERE r = 1"
_BLIND = f"l AS (SELECT e.id_noticia, CASE WHEN contains(lower(coalesce(e.nota, '')), '{SEEN}') THEN 'ciega-' || e.id_noticia ELSE e.cluster_humano END AS cluster_humano, n.cluster_id FROM etiquetas e JOIN ({_FIRST}) n USING (id_noticia))"
_POOL = f"pool AS (SELECT fila AS id, id_noticia, CAST(floor(epoch({texts._WHEN})) AS BIGINT) AS t, concat_ws(' ', titulo, descripcion) AS texto FROM noticias WHERE idioma IN ('es', 'en') AND id_noticia IS NOT NULL)"
_NEAR = (
    texts._TFIDF.format(key="id", text="texto", src="pool", tok=texts._TOK2)
    + ", near AS (SELECT a.k AS id, b.k AS vecino, round(sum(a.x * b.x), 6) AS s FROM asked q JOIN x a ON a.k = q.id JOIN pool pa ON pa.id = a.k JOIN x b ON b.w = a.w AND b.k <> a.k JOIN pool pb ON pb.id = b.k AND abs(pa.t - pb.t) <= 259200 GROUP BY 1, 2), best AS (SELECT id, vecino, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, vecino) AS r FROM near WHERE s > 0)"
)

SQL = {
    "threshold_choice": f"""
        WITH {scores._L}, h AS (SELECT id_noticia FROM ({scores.SQL['split_halves']}) WHERE mitad = 1), u AS (SELECT CAST(unnest({list(THRESHOLDS)}) AS DOUBLE) AS umbral),
        s AS (SELECT u.umbral, l.tema_humano AS h, CASE WHEN l.tema_confianza >= u.umbral THEN l.tema ELSE 'otro' END AS g FROM l JOIN h USING (id_noticia) CROSS JOIN u WHERE l.tema_humano IS NOT NULL),
        f AS (SELECT umbral, e, 2 * count(*) FILTER (h = e AND g = e) / (count(*) FILTER (h = e) + count(*) FILTER (g = e)) AS f1 FROM (SELECT umbral, h, g, unnest(list_distinct([h, g])) AS e FROM s) WHERE e IS NOT NULL GROUP BY 1, 2),
        m AS (SELECT umbral, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY 1)
        SELECT umbral, macro_f1, row_number() OVER (ORDER BY coalesce(macro_f1, 0) DESC, umbral = {CURRENT} DESC, umbral) = 1 AS elegido FROM m""",
    "same_base": f"""
        WITH n AS ({_FIRST}), k AS ({_KEY}), r AS (SELECT e.tema_humano AS h, n.tema AS g, k.clave AS g2 FROM etiquetas e JOIN n USING (id_noticia) JOIN k USING (fila)),
        a AS ({_F1.format(t='r')}), b AS ({_F1.format(t='(SELECT h, g2 AS g FROM r)')}),
        j AS (SELECT round(a.f1, 6) AS a, round(b.f1, 6) AS b FROM a FULL JOIN b USING (e) WHERE a.f1 IS NOT NULL OR b.f1 IS NOT NULL)
        SELECT 'comunes' AS base, count(*) AS temas, round(avg(coalesce(a, 0)), 6) AS guardado, round(avg(coalesce(b, 0)), 6) AS palabras FROM j WHERE a IS NOT NULL AND b IS NOT NULL
        UNION ALL SELECT 'union', count(*), round(avg(coalesce(a, 0)), 6), round(avg(coalesce(b, 0)), 6) FROM j""",
    "blind_pairs": f"WITH {_BLIND}, a AS ({scores._PAIRS.format(k='cluster_humano, cluster_id')}), b AS ({scores._PAIRS.format(k='cluster_id')}), c AS ({scores._PAIRS.format(k='cluster_humano')}) SELECT a.p AS ambos, b.p AS propuestos, c.p AS verdaderos, round(a.p / nullif(b.p, 0), 6) AS precision, round(a.p / nullif(c.p, 0), 6) AS recall FROM a, b, c",
    "search_recall": "WITH hits AS (" + texts.SQL["search_evidence"] + "), w AS (SELECT q.consulta, CAST(n.fila AS VARCHAR) AS evidencia FROM (SELECT DISTINCT id_noticia AS consulta FROM etiquetas WHERE id_noticia IS NOT NULL AND titulo IS NOT NULL) q JOIN noticias n ON n.id_noticia = q.consulta AND n.titulo IS NOT NULL) SELECT count(DISTINCT w.consulta) AS consultas, count(*) AS esperadas, count(h.evidencia) AS halladas, round(count(h.evidencia) / nullif(count(*), 0), 6) AS recall FROM w LEFT JOIN hits h USING (consulta, evidencia)",
    "cost_summary": f"SELECT source, count(*) AS textos, round(median(n_chars), 6) AS mediana, quantile_disc(n_chars, 0.95) AS p95, CASE WHEN count(n_chars) = count(*) THEN round(sum(n_chars / 1e6 * {PRICE_IN} + n_chars / 2 / 1e6 * {PRICE_OUT}), 8) END AS costo_usd FROM documents GROUP BY 1",
    "nearest_in_time": f"WITH {_POOL}, asked AS (SELECT id FROM pool WHERE id % 100 = 0), {_NEAR} SELECT id, vecino, s AS parecido FROM best WHERE r = 1",
    "label_sample": f"WITH {_POOL}, asked AS (SELECT id FROM pool ORDER BY sha1('42|' || id_noticia), id LIMIT {SEEDS}), {_NEAR} SELECT id AS fila, 'semilla' AS papel FROM asked UNION ALL SELECT DISTINCT vecino, 'vecino' FROM best WHERE r = 1 AND vecino NOT IN (SELECT id FROM asked)",
}
