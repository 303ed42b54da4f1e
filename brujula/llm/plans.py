"""Queries of the llm operators over the driver's tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brujula.functions.dates import INVALID
from brujula.functions.urls import page_keys
from brujula.llm import encoding, events, languages, mixing, neardup, splitting, survivors
from brujula.operators import timestamps
from brujula.operators.profile import NEWS_SPECS
from brujula.session import cut, table


def _language_model(spark: SparkSession, d: str):
    path = encoding.tokenizer_path(spark, "piece_bpe_32k.model")
    return languages.train(table(spark, d, "noticias"), "titulo", "idioma", path)


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "noticias")
    return languages.segments(news, _language_model(spark, d), "fila", "titulo", "idioma")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_segments(spark, d).filter("caso").select(F.col("fila").cast("bigint").alias("fila"), "segmento", "idioma")


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(table(spark, d, "documents"), _language_model(spark, d), "doc_id", "text", "lang")


NEWS_TEXTS = [neardup.Field("titulo"), neardup.Field("descripcion", least=8)]
NEAR = 0.75


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.similar_classes(table(spark, d, "noticias"), "fila", NEWS_TEXTS, NEAR)
    return neardup.row_links(members, links, "fila").select(F.col("a").cast("bigint").alias("fila_a"), F.col("b").cast("bigint").alias("fila_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "noticias")
    members, links = neardup.similar_classes(news, "fila", NEWS_TEXTS, NEAR)
    return neardup.groups(news, members, links, "fila")


def _events(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "noticias")
    rows = languages.sample(news, "titulo", "idioma")
    model = languages.fit_sample(rows, encoding.tokenizer_path(spark, "piece_bpe_32k.model"))
    described = events.described(news, table(spark, d, "medios"), model, events.corpus_common_words(news))
    return events.clustered(cut(described, "described"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links = events.event_links(cut(_events(spark, d), "clustered"))
    return links.select(F.col("a").cast("bigint").alias("fila_a"), F.col("b").cast("bigint").alias("fila_b"))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """fila, cluster_id of every row; rows that can't be placed in time are clusters of their own."""
    placed = events.event_clusters(_events(spark, d)).select("fila", F.concat(F.lit("K-"), F.lower(F.hex("cluster"))).alias("cluster_id"))
    alone = F.concat(F.lit("K-"), F.lower(F.hex(F.xxhash64("fila", F.lit("sola")))))
    return table(spark, d, "noticias").select("fila").join(placed, "fila", "left").select("fila", F.coalesce("cluster_id", alone).alias("cluster_id"))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """cluster_id, tamano and the most typical titulo and descripcion of each cluster of two rows or more."""
    typical = events.typical_members(cut(events.event_clusters(_events(spark, d)), "members")).filter("tamano > 1")
    news = table(spark, d, "noticias").select("fila", "titulo", "descripcion")
    return typical.join(news, "fila").select(F.concat(F.lit("K-"), F.lower(F.hex("cluster"))).alias("cluster_id"), "tamano", "fila", "titulo", "descripcion")


#: Origins by trust; any other comes after them (fixed values).
ORIGINS = ("tvn_rss", "tvn_web", "gdelt")


def usable(name: str):
    """Whether the cell of a news column has the column's right form."""
    return NEWS_SPECS[name].right(F.col(name))


def _rank(origin):
    out = F.lit(len(ORIGINS))
    for i, name in enumerate(ORIGINS):
        out = F.when(origin == name, i).otherwise(out)
    return out


def captures(spark: SparkSession, d: str) -> DataFrame:
    """fila, pagina (digest of the page's normal form, null for unusable urls) and what the choice of a record needs:
    titulo, origen, rango, descripcion (null if unusable), fecha_deteccion (of the aggregator, null if unusable) and the instants."""
    news, outlets = table(spark, d, "noticias"), table(spark, d, "medios")
    tables = timestamps.outlet_zones(outlets)
    rows = news.select(
        "fila", "dominio", "titulo", F.when(usable("url"), F.col("url")).alias("url"), F.coalesce("origen", F.lit("")).alias("origen"), _rank(F.col("origen")).cast("int").alias("rango"),
        F.when(usable("descripcion"), F.col("descripcion")).alias("descripcion"), "fecha_extraccion", F.when(F.col("origen") == "gdelt", F.col("fecha_deteccion")).alias("fecha_deteccion"),
    )
    rows = timestamps.with_outlet_zone(rows, outlets, [c for c in rows.columns if c != "dominio"])
    kept = ["fila", "titulo", "origen", "rango", "descripcion", "fecha_deteccion"]

    def run(batches):
        for b in batches:
            times = []
            for name in ("fecha_extraccion", "fecha_deteccion"):
                m = timestamps.field_micros(b, name, False, tables)
                times.append(pa.array(m, mask=m == INVALID))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], page_keys(b.column("url")), *times], names=[*kept, "url", "extraccion", "deteccion"])

    out = rows.mapInArrow(run, "fila bigint, titulo string, origen string, rango int, descripcion string, fecha_deteccion string, url string, extraccion bigint, deteccion bigint")
    return out.withColumn("pagina", F.unhex(F.md5("url")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    policies = {
        "origen": survivors.Policy(F.col("origen"), order=(F.col("rango"), F.coalesce(-F.col("extraccion"), F.lit(2**62)))),
        "descripcion": survivors.Policy(F.col("descripcion"), order=(-F.length("descripcion"),)),
        "fecha_deteccion": survivors.Policy(F.when(F.col("deteccion").isNotNull(), F.col("fecha_deteccion")), order=(F.col("deteccion"),)),
    }
    return survivors.consensus(captures(spark, d), "pagina", "fila", policies).select("grupo", "campo", "fila")


def p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Elected title of each page that was captured twice or more, more trusted origins weighing more."""
    policies = {"titulo": survivors.Policy(F.col("titulo"), weight=4.0 - F.col("rango"))}
    return survivors.consensus(captures(spark, d), "pagina", "fila", policies).select("fila", "valor", "distancia", "valores")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), encoding.tokenizer_path(spark))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.xxhash64("text").alias("h"))
    sizes = cut(encoding.token_counts(docs, encoding.tokenizer_path(spark), ["doc_id", "source", "h"]), "tokens")
    copies = sizes.groupBy("h").agg(F.count("*").alias("k"))
    return sizes.join(copies, "h").select("doc_id", "source", "tokens", "k")


def p8_mezcla(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(cut(_sizes(spark, d), "sizes"), table(spark, d, "mezcla_objetivo"))[0]


def p8_partes(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*mixing.mix(cut(_sizes(spark, d), "sizes"), table(spark, d, "mezcla_objetivo")))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_long(table(spark, d, "documents"), encoding.tokenizer_path(spark))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_long(table(spark, d, "documents"), encoding.tokenizer_path(spark))
    return pieces.filter("pieza = 1").select(F.col("doc_id").cast("bigint").alias("doc_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p1_documents, p4_found, p4_groups, p5_found, p5_members, p5_clusters, p6_found, p6_consensus, p7_ids, p8_mezcla, p8_partes, p9_found, p9_pieces)}

#: Sets of words per row and field; a pair is looked up by the first words of both in the order of rarity, then counted.
_WORDS = r"list_distinct(regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{N}}]+'))"
SQL = {
    "p4_found": f"""
        WITH s AS MATERIALIZED (SELECT fila, 0 AS campo, {_WORDS.format(c="titulo")} AS ws FROM noticias WHERE titulo IS NOT NULL UNION ALL SELECT fila, 1, {_WORDS.format(c="descripcion")} FROM noticias WHERE descripcion IS NOT NULL),
        r AS MATERIALIZED (SELECT fila, campo, ws, len(ws) AS n FROM s WHERE len(ws) >= CASE campo WHEN 0 THEN 1 ELSE 8 END),
        w AS (SELECT fila, campo, n, unnest(ws) AS w FROM r), d AS (SELECT campo, w, count(*) AS df FROM w GROUP BY 1, 2),
        p AS MATERIALIZED (SELECT fila, campo, n, w FROM (SELECT w.*, row_number() OVER (PARTITION BY fila, w.campo ORDER BY df, w.w) AS k FROM w JOIN d USING (campo, w)) WHERE k <= n - ceil(0.75 * n) + 1),
        c AS (SELECT DISTINCT a.campo, a.fila AS a, b.fila AS b FROM p a JOIN p b ON a.campo = b.campo AND a.w = b.w AND a.fila < b.fila AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n)),
        v AS (SELECT c.a, c.b, len(list_intersect(x.ws, y.ws)) AS i, x.n AS m, y.n AS n FROM c JOIN r x ON x.fila = c.a AND x.campo = c.campo JOIN r y ON y.fila = c.b AND y.campo = c.campo)
        SELECT DISTINCT a AS fila_a, b AS fila_b FROM v WHERE i >= 0.75 * (m + n - i)""",
}
