"""Queries of evaluation, vectors and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brujula.operators import lexical, merge, metrics, vectors
from brujula.session import cut, table
from brujula.plans.texts import stems_sql
from brujula.streaming import events as stream


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the first captured row of their id."""
    news = table(spark, d, "noticias").select("id_noticia", "fila", "tema", "tema_confianza", "cluster_id")
    first = merge.keep_first(news, ["id_noticia"], [F.col("fila")])
    return table(spark, d, "etiquetas").select("id_noticia", "tema_humano", "cluster_humano", "nota").join(first, "id_noticia")


def topic_scores(spark, d):
    return metrics.label_scores(_labelled(spark, d), "tema_humano", "tema")


def macro_f1(spark, d):
    one = topic_scores(spark, d)
    return one.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("f1").alias("temas"))


def pair_scores(spark, d):
    return metrics.pair_scores(_labelled(spark, d), "cluster_humano", "cluster_id")


def split_halves(spark, d):
    return metrics.half_split(table(spark, d, "etiquetas").select("id_noticia").filter("id_noticia IS NOT NULL").distinct(), "id_noticia")


def threshold_grid(spark, d):
    return metrics.threshold_grid(_labelled(spark, d), "tema_humano", "tema", "tema_confianza", [0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8], "otro")


def percentiles(spark, d):
    return metrics.percentiles(table(spark, d, "events"), ["event_type"], "value")


def capture_ratios(spark, d):
    """Share of described, dated and labelled rows of each origin; null without cases."""
    n = table(spark, d, "noticias").groupBy("origen").agg(
        F.count("*").alias("n"), F.count("descripcion").alias("a"), F.count("fecha_publicacion").alias("b"), F.count(F.when(F.col("descripcion").isNotNull(), F.col("tema"))).alias("c")
    )
    return n.select("origen", "n", metrics.ratio(F.col("a"), F.col("n")).alias("descritas"), metrics.ratio(F.col("b"), F.col("n")).alias("fechadas"), metrics.ratio(F.col("c"), F.col("a")).alias("con_tema"))


def vector_class(spark, d):
    """Label of each vector by its nearest label centroid."""
    e = table(spark, d, "embeddings")
    return vectors.best_class(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding"), 0.1, "otro")


def vector_pairs(spark, d):
    """Close pairs of all rows."""
    out = vectors.all_close_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.35)
    return out.select("a", "b", F.round("coseno", 4).alias("coseno"))


def vector_clusters(spark, d):
    """Complete linkage of all rows up to a cosine distance of 0.7."""
    e = table(spark, d, "embeddings")
    pairs = vectors.all_close_pairs(e, "vec_id", "embedding", 0.3 - 1e-9).withColumn("d", 1 - F.col("coseno"))
    return vectors.linkage_clusters(e, "vec_id", pairs)


def _dated_vectors(spark, d):
    """Vectors of documents with their capture time and content stems."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "fecha_captura", lexical.event_stems(F.col("text")).alias("raices"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(docs, "doc_id")


def event_pairs(spark, d):
    """Documents at most 72 hours apart with two content stems and a cosine of 0.2 or more in common."""
    return vectors.event_pairs(_dated_vectors(spark, d), "doc_id", "embedding", "fecha_captura", "raices", 0.2).select("a", "b", F.round("coseno", 4).alias("coseno"))


def event_groups(spark, d):
    """Complete linkage of the documents inside those pairs; a group's id is its document's, or a digest of all its sorted ids."""
    rows = cut(_dated_vectors(spark, d), "dated")
    pairs = vectors.event_pairs(rows, "doc_id", "embedding", "fecha_captura", "raices", 0.2).withColumn("d", 1 - F.col("coseno"))
    groups = cut(vectors.linkage_clusters(rows, "doc_id", pairs), "groups")
    ids = groups.groupBy("grupo").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), "|").alias("ids"), F.count("*").alias("n"))
    named = ids.select("grupo", "n", F.concat(F.lit("K-"), F.when(F.col("n") == 1, F.col("ids")).otherwise(F.substring(F.sha1("ids"), 1, 10))).alias("clave"))
    return groups.join(named, "grupo").select("doc_id", "grupo", "clave", "n")


def vector_neighbours(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), "vec_id", "embedding").select("consulta", "vecino", F.round("coseno", 4).alias("coseno"), "puesto")


def stream_hours(spark, d):
    return stream.hourly(spark, d)


def stream_first(spark, d):
    return stream.first_seen(spark, d)


def sessions(spark, d):
    """Sessions of each user: gaps of 12 hours or more end one."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    s = e.groupBy("user_id", F.session_window("t", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sesiones"), F.max("n").alias("mayor"))


QUERIES = {
    f.__name__: f
    for f in (
        topic_scores, macro_f1, pair_scores, split_halves, threshold_grid, percentiles, capture_ratios, vector_class, vector_pairs, vector_clusters, event_pairs, event_groups,
        vector_neighbours, stream_hours, stream_first, sessions,
    )
}

_CLUSTER_STOP = ", ".join(f"'{w}'" for w in lexical.CLUSTER_STOP)
_L = "l AS (SELECT e.id_noticia, e.tema_humano, e.cluster_humano, n.tema, n.tema_confianza, n.cluster_id FROM etiquetas e JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_noticia ORDER BY fila) AS r FROM noticias WHERE id_noticia IS NOT NULL) WHERE r = 1) n USING (id_noticia))"
_SCORES = f"WITH {_L}, t AS (SELECT tema_humano AS etiqueta FROM l WHERE tema_humano IS NOT NULL UNION SELECT tema FROM l WHERE tema IS NOT NULL), s AS (SELECT etiqueta, count(*) FILTER (tema_humano = etiqueta AND tema = etiqueta) AS vp, count(*) FILTER (tema = etiqueta AND tema_humano IS DISTINCT FROM etiqueta) AS fp, count(*) FILTER (tema_humano = etiqueta AND tema IS DISTINCT FROM etiqueta) AS fn FROM t CROSS JOIN l GROUP BY 1) SELECT *, round(vp / nullif(vp + fp, 0), 6) AS precision, round(vp / nullif(vp + fn, 0), 6) AS recall, round(2 * vp / nullif(2 * vp + fp + fn, 0), 6) AS f1 FROM s"
_PAIRS = "SELECT CAST(coalesce(sum(n * (n - 1) / 2), 0) AS BIGINT) AS p FROM (SELECT count(*) AS n FROM l WHERE cluster_humano IS NOT NULL AND cluster_id IS NOT NULL GROUP BY {k})"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(y AS DOUBLE) / sqrt(" + _DOT.format(a="embedding", b="embedding") + ")) AS u FROM embeddings)"

SQL = {
    "topic_scores": _SCORES,
    "macro_f1": f"SELECT round(avg(f1), 6) AS macro_f1, count(f1) AS temas FROM ({_SCORES})",
    "pair_scores": f"WITH {_L}, a AS ({_PAIRS.format(k='cluster_humano, cluster_id')}), b AS ({_PAIRS.format(k='cluster_id')}), c AS ({_PAIRS.format(k='cluster_humano')}) SELECT a.p AS ambos, b.p AS propuestos, c.p AS verdaderos, round(a.p / nullif(b.p, 0), 6) AS precision, round(a.p / nullif(c.p, 0), 6) AS recall FROM a, b, c",
    "split_halves": "SELECT id_noticia, CASE WHEN row_number() OVER (ORDER BY sha1(id_noticia), id_noticia) <= count(*) OVER () // 2 THEN 1 ELSE 2 END AS mitad FROM (SELECT DISTINCT id_noticia FROM etiquetas WHERE id_noticia IS NOT NULL)",
    "threshold_grid": f"WITH {_L} SELECT umbral, count(*) FILTER (CASE WHEN tema_confianza >= umbral THEN tema ELSE 'otro' END = tema_humano) AS aciertos, count(*) AS n, round(count(*) FILTER (CASE WHEN tema_confianza >= umbral THEN tema ELSE 'otro' END = tema_humano) / count(*), 6) AS exactitud FROM l CROSS JOIN (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8]) AS DOUBLE) AS umbral) WHERE tema_humano IS NOT NULL GROUP BY 1",
    "percentiles": "SELECT event_type, count(value) AS n, quantile_disc(value, 0.95) AS p95, round(median(value), 6) AS mediana FROM events GROUP BY 1",
    "capture_ratios": "SELECT origen, count(*) AS n, round(count(descripcion) / count(*), 6) AS descritas, round(count(fecha_publicacion) / count(*), 6) AS fechadas, round(count(tema) FILTER (descripcion IS NOT NULL) / nullif(count(descripcion), 0), 6) AS con_tema FROM noticias GROUP BY 1",
    "vector_pairs": f"WITH {_UNIT} SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_DOT.format(a='a.u', b='b.u')} AS c FROM u a JOIN u b ON a.vec_id < b.vec_id) WHERE c >= 0.35".replace("SELECT * FROM (", "SELECT a, b, round(c, 4) AS coseno FROM ("),
    "vector_neighbours": f"WITH {_UNIT}, s AS (SELECT q.vec_id AS consulta, r.vec_id AS vecino, round({_DOT.format(a='q.u', b='r.u')}, 6) AS c FROM u q JOIN u r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) SELECT consulta, vecino, round(c, 4) AS coseno, row_number() OVER (PARTITION BY consulta ORDER BY c DESC, vecino) AS puesto FROM s QUALIFY puesto <= 10",
    "stream_hours": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hora, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_first": "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id FROM events) GROUP BY 1, 2",
    "sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS nueva FROM events), s AS (SELECT user_id, sum(nueva) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sesiones, max(n) AS mayor FROM c GROUP BY 1",
    "event_pairs": f"WITH {_UNIT}, d AS (SELECT doc_id, fecha_captura, list_distinct(list_filter({stems_sql('text')}, lambda w: NOT regexp_matches(w, '^[0-9]') AND w NOT IN ({_CLUSTER_STOP}))) AS ws FROM documents WHERE text IS NOT NULL), r AS (SELECT * FROM d JOIN u ON u.vec_id = d.doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, {_DOT.format(a='a.u', b='b.u')} AS c FROM r a JOIN r b ON a.doc_id < b.doc_id AND abs(epoch_us(a.fecha_captura) - epoch_us(b.fecha_captura)) <= 259200000000 AND len(list_intersect(a.ws, b.ws)) >= 2) SELECT a, b, round(c, 4) AS coseno FROM p WHERE c >= 0.2",
    "vector_class": f"WITH {_UNIT}, m AS (SELECT CAST(label AS VARCHAR) AS clase, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT clase, list(x ORDER BY i) AS v FROM m GROUP BY 1), n AS (SELECT clase, list_transform(v, lambda y: y / sqrt({_DOT.format(a='v', b='v')})) AS v FROM c), s AS (SELECT u.vec_id, n.clase, {_DOT.format(a='u.u', b='n.v')} AS s FROM u CROSS JOIN n), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, clase DESC) AS r FROM s) SELECT vec_id, CASE WHEN s >= 0.1 THEN clase ELSE 'otro' END AS clase, round(s, 4) AS parecido FROM b WHERE r = 1",
}
