import json

import numpy as np
import pytest

from brujula.operators import merge
from brujula.plans.tables import STATES
from brujula.sources import contract, readers, sinks
from pyspark.sql import functions as F


def test_csv_readers(spark, tmp_path):
    (tmp_path / "i.csv").write_text("pais_iso3,indicador_id,anio,valor,unidad,fuente_url,fecha_extraccion,licencia\nPAN,X,2020,,%,u,,CC\nPAN,X,2021,1.5,%,u,f,CC\n")
    a, b = readers.indicators(spark, str(tmp_path / "i.csv")).orderBy("anio").collect()
    assert (a["valor"], a["fecha_extraccion"], b["valor"], b["anio"]) == (None, "", 1.5, 2021)
    (tmp_path / "n.csv").write_text('titulo,sintetico\n"a, ""b""\nc", TRUE \nd,no\n')
    got = [tuple(r) for r in readers.news_csv(spark, str(tmp_path / "n.csv")).collect()]
    assert got == [('a, "b"\nc', True), ("d", False)]


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"id": "q1", "properties": {"mag": 4.5, "time": 1761896367624, "place": "x"}, "geometry": {"coordinates": [-80.5, 7.5]}}, {"id": "q2", "properties": {"magnitude": None, "time": None}, "geometry": None}]}
    (tmp_path / "q.json").write_text(json.dumps(doc))
    df = readers.geojson(spark, str(tmp_path / "q.json"))
    rows = {r["id"]: r for r in df.collect()}
    assert rows["q1"]["time"] == "2025-10-31T07:39:27.624Z" and rows["q1"]["depth"] is None and rows["q2"]["magnitude"] is None
    sinks.write_geojson(df, str(tmp_path / "out"))
    lines = [json.loads(x) for x in spark.read.text(str(tmp_path / "out")).toPandas()["value"]]
    assert [x["id"] for x in lines] == ["q2", "q1"]


def test_json_lines(spark, tmp_path):
    f = tmp_path / "r.jsonl"
    f.write_text('{"id_caso": "F-1", "estado_revision": "nuevo"}\n\nnot json\n{"id_caso": "", "estado_revision": "nuevo"}\n{"id_caso": "F-2", "estado_revision": "raro"}\n')
    good = F.expr("id_caso <> ''") & F.col("estado_revision").isin(*STATES)
    rows, bad = readers.json_lines(spark, str(f), readers.REVIEW, good)
    assert [r["id_caso"] for r in rows.collect()] == ["F-1"] and bad.count() == 3
    with pytest.raises(ValueError):
        readers.strict_json_lines(spark, str(f), readers.REVIEW, good)
    log = str(tmp_path / "log")
    df = spark.createDataFrame([("F-1", "nuevo", "a", "2026", None), ("F-2", "raro", "a", "2026", None)], readers.REVIEW)
    assert sinks.append_log(df, log, STATES).count() == 1 and sinks.append_log(df, log, STATES).count() == 1
    assert spark.read.schema(readers.REVIEW).json(log).count() == 2


def test_questions_status_and_urls(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# nota\n\n¿Qué pasa?\n  otra  \n")
    assert [r[0] for r in readers.questions(spark, str(tmp_path / "q.txt")).collect()] == ["¿Qué pasa?", "otra"]
    df = spark.createDataFrame([('{"a": 1}',), ("",), ("Please limit requests to one every 5 seconds",), ("<html>",), (None,)], "t string")
    assert [r["estado"] for r in readers.response_status(df, "t").collect()] == ["json", "vacia", "limite", "otra", "vacia"]
    assert readers.query_url("https://x.example/v2", ["PAN", "CRI"], 2010, 2024) == "https://x.example/v2/PAN;CRI?date=2010:2024"


RSS = """<rss><channel><item><title>Uno &amp; dos</title><link>https://a.example/1?utm_source=x</link><description>&lt;p&gt;Hola&lt;/p&gt;</description><pubDate>Mon, 06 Oct 2025 16:27:27 -0500</pubDate></item>
<item><title>Tres</title><link></link><pubDate>ayer</pubDate></item></channel></rss>"""


def test_rss_and_sitemap(spark, tmp_path):
    (tmp_path / "20251007T000000Z.xml").write_text(RSS)
    rows = readers.rss(spark, str(tmp_path / "20251007T000000Z.xml"), "Canal", "a.example", "es").orderBy("titulo").collect()
    assert rows[0].__fields__ == list(contract.NEWS)
    three, one = rows
    assert one["titulo"] == "Uno & dos" and one["descripcion"] == "Hola" and str(one["fecha_publicacion"]) == "2025-10-06 21:27:27" and one["alcance_texto"] == "descripcion_rss" and str(one["fecha_extraccion"]) == "2025-10-07 00:00:00"
    assert three["url"] is None and three["fecha_publicacion"] is None and three["id_noticia"] is None
    (tmp_path / "s.xml").write_text("<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in ("https://www.a.example/x", "https://a.example/tag/y", "https://b.example/x", " https://a.example/z ")) + "</urlset>")
    assert {r[0] for r in readers.sitemap(spark, str(tmp_path / "s.xml"), "a.example").collect()} == {"https://www.a.example/x", "https://a.example/z"}


def test_articles(spark):
    ld = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    pages = [
        ("https://a.example/1", "<script type='application/ld+json'>{bad</script>" + ld({"@graph": [{"@type": "WebPage"}, {"@type": ["NewsArticle"], "headline": "T&eacute; uno", "description": "", "datePublished": "2026-01-02T03:04:05Z"}]})),
        ("https://a.example/2", ld([{"@type": "ReportageNewsArticle", "headline": "Dos", "description": "d"}]) + '<meta property="article:published_time" content="2026-02-03T00:00:00-05:00">'),
        ("https://a.example/3", ld({"@type": "Product", "headline": "no"})),
        ("https://a.example/4", None),
    ]
    df = spark.createDataFrame(pages, "url string, html string").withColumn("w", F.lit("2026-03-01").cast("timestamp"))
    out = {r["url"]: r for r in readers.articles(df, "url", "html", "w", "Canal", "a.example", "es").collect()}
    assert set(out) == {"https://a.example/1", "https://a.example/2"}
    assert out["https://a.example/1"]["titulo"] == "Té uno" and out["https://a.example/1"]["descripcion"] is None and str(out["https://a.example/2"]["fecha_publicacion"]) == "2026-02-03 05:00:00"


def test_article_list_keeps_first_capture(spark, tmp_path):
    for stamp, lang in (("20260102T000000Z", "Spanish"), ("20260101T000000Z", "Klingon")):
        (tmp_path / f"{stamp}.json").write_text(json.dumps({"articles": [{"url": "https://www.b.example/x", "title": " Hola ", "seendate": "20260101T101500Z", "domain": "www.B.example", "language": lang}, {"url": f"https://c.example/{stamp}", "title": "", "seendate": "malo", "domain": None, "language": ""}]}))
    rows = {r["url"]: r for r in readers.article_list(spark, str(tmp_path)).collect()}
    x = rows["https://www.b.example/x"]
    assert len(rows) == 3 and x["idioma"] == "klingon" and x["dominio"] == "b.example" and x["titulo"] == "Hola" and str(x["fecha_deteccion"]) == "2026-01-01 10:15:00"


def test_junit_vectors_and_manifest(spark, tmp_path):
    (tmp_path / "j.xml").write_text('<testsuites><testsuite><testcase classname="t1" name="a" time="0.5"/><testcase classname="t1" name="b" time="0.25"><failure>x</failure></testcase><testcase classname="t2" name="c" time="1"><skipped message="s">s</skipped></testcase></testsuite></testsuites>')
    got = {r["archivo"]: tuple(r)[1:] for r in readers.junit(spark, str(tmp_path / "j.xml")).collect()}
    assert got == {"t1": (2, 1, 0, 0.75), "t2": (1, 0, 1, 1.0)}
    np.save(tmp_path / "v.npy", np.eye(2))
    (tmp_path / "v.json").write_text('["a", "b"]')
    assert readers.vectors(spark, str(tmp_path / "v.npy"), str(tmp_path / "v.json")).collect()[1]["vector"] == [0.0, 1.0]
    (tmp_path / "m").mkdir()
    for k in "ab":
        (tmp_path / "m" / k).write_text(k)
    then = sinks.manifest(spark, str(tmp_path / "m")).toPandas()
    (tmp_path / "m" / "a").write_text("changed")
    (tmp_path / "m" / "b").unlink()
    out = sinks.verify(sinks.manifest(spark, str(tmp_path / "m")), spark.createDataFrame(then)).collect()
    assert {tuple(r) for r in out} == {("a", "distinto"), ("b", "falta")}


def test_csv_sink_and_union(spark, tmp_path):
    df = spark.createDataFrame([(2, None, True), (1, "", False)], "k int, t string, s boolean").withColumn("d", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    sinks.write_csv(df, str(tmp_path / "c"), ["k"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("*.csv")))
    assert "1,\"\",false,2026-01-02T03:04:05Z\n" in text and "2,,true,2026-01-02T03:04:05Z\n" in text
    sinks.write_csv_once(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv_once(df, str(tmp_path / "o"))
    u = merge.union_all([df.select("k"), df.select("k", "t")])
    assert u.columns == ["k", "t"] and u.count() == 4
    assert contract.finalize(df.select("k")).columns == list(contract.NEWS)
    report = sinks.quality_report(spark.sql("SELECT 3 AS leidas, 2 AS validas, 1 AS rechazadas"), spark.sql("SELECT 'url' AS campo, 'URL rota' AS problema, 1 AS filas"), spark.sql("SELECT 'url' AS columna, 0 AS nulos"))
    assert "| url | URL rota | 1 |" in report


def test_stored_and_cached_files(spark, tmp_path):
    import json

    d = tmp_path / "articles"
    d.mkdir()
    base = {"titulo": "Uno", "url": "https://a.b/1", "fecha_publicacion": "2026-01-05T00:00:00Z"}
    files = [
        {**base, "id_noticia": "N-0000000001", "fecha_extraccion": "2026-02-02T00:00:00Z", "titulo": "Tarde"}, {**base, "id_noticia": "N-0000000001", "fecha_extraccion": "2026-02-01T00:00:00Z"},
        {**base, "id_noticia": "N-0000000002", "skip": True}, {**base, "id_noticia": "N-0000000003", "fecha_publicacion": "2027-01-05T00:00:00Z"}, {**base, "id_noticia": "N-0000000004", "fecha_publicacion": None},
    ]
    for i, x in enumerate(files):
        (d / f"{i}.json").write_text(json.dumps(x))
    out = readers.stored_articles(spark, str(d), "2026-01-01", "2026-12-31").collect()
    assert [(r["id_noticia"], r["titulo"], r["cluster_id"]) for r in out] == [("N-0000000001", "Uno", "K-0000000001")]
    c = tmp_path / "cache"
    c.mkdir()
    for k, v in {"a": '{"x": 1}', "b": "roto{", "c": "[]"}.items():
        (c / f"{k}.json").write_text(v)
    keys = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "clave string")
    assert [tuple(r) for r in readers.cached_answers(spark, str(c), keys).collect()] == [("a", '{"x": 1}')]
    m = tmp_path / "m.csv"
    m.write_text('ID,Observado,Evidencia\nT1,"Pasa (3/3), bien",corrida 2026-10-05\nT2,Falla (1/2),\nT3,,x\n')
    assert [tuple(r) for r in readers.test_matrix(spark, str(m)).orderBy("id").collect()] == [("T1", "2026-10-05", "pasa", 3, 3), ("T2", None, "falla", 1, 2), ("T3", None, None, None, None)]


def test_snapshots_and_reports(spark, tmp_path):
    from brujula.sources import sinks

    rows = spark.createDataFrame([("N-1", "b", "2026-01-02 00:00:00"), ("N-1", "a", "2026-01-01 00:00:00"), (None, "x", "2026-01-01 00:00:00"), ("N-2", "c", None)], "id_noticia string, url string, fecha_extraccion string").withColumn("fecha_extraccion", F.to_timestamp("fecha_extraccion"))
    assert {(r["id_noticia"], r["url"]) for r in readers.rss_snapshots(rows).collect()} == {("N-1", "a"), ("N-2", "c")}
    quakes = spark.createDataFrame([("b", "2026-01-02", 1.0, 2.0, 3.0), ("a", "2026-01-01", 1.0, 2.0, 3.0)], "id string, time string, longitude double, latitude double, depth double")
    import json

    doc = json.loads(sinks.feature_collection(quakes).first()[0])
    assert doc["type"] == "FeatureCollection" and [f["id"] for f in doc["features"]] == ["a", "b"] and doc["features"][0]["geometry"]["coordinates"] == [1.0, 2.0, 3.0]
    sinks.write_table(quakes, str(tmp_path / "q"), ["id"])
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
    ratios = spark.createDataFrame([("b", 1, 2), ("a", 0, 0)], "medida string, numerador int, denominador int")
    text = sinks.benchmark_report(ratios, spark.createDataFrame([("b", "caso 1")], "medida string, caso string"))
    assert "| a | sin casos |" in text and "| b | 1/2 |" in text and "- caso 1" in text
    dates = rows.select("fecha_extraccion")
    assert [sinks.coverage_note(dates, "fecha_extraccion", *p).first()[0] for p in (("2026-01-01", "2026-01-20"), ("2025-01-01", "2026-01-20"), ("2026-01-01", "2026-06-01"))] == [False, True, True]
    q = sinks.quality_counts(spark.createDataFrame([(5, 3, 2)], "leidas int, validas int, rechazadas int"), spark.createDataFrame([("url", "rota", 2)], "campo string, problema string, filas int")).first()
    assert q["problemas"] == {"url: rota": 2}
