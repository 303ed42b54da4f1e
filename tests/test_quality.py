from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brujula.functions.urls import page_key
from brujula.operators import profile, timestamps
from brujula.plans import quality

SCHEMA = "fila bigint, id_noticia string, url string, descripcion string, carga int"


def rows(spark, values):
    return spark.createDataFrame(values, SCHEMA)


GOOD = [(i, f"N-{i:010x}", f"https://a.example/{i}", f"Una descripción normal número {i}.", 1) for i in range(100, 140)]


def found(spark, values):
    out = profile.violations(rows(spark, GOOD + values), profile.NEWS_SPECS, "fila").collect()
    return {(r["fila"], r["columna"]) for r in out}


def test_rare_masks(spark):
    bad_ids = ["n-0123456789", "N-012345678", "N-01234567890", "N-01234567G9", "N_0123456789", "K-0123456789", "0123456789", "N-01234 6789", "", "  "]
    bad_urls = ["ftp://a.example/x", "https://", "http://localhost/x", "/x/y", "javascript:void(0)", "https:/a.example/x", "http//a.example", "https://a.example/x y", "a.example/x", ""]
    bad_texts = ["", "   ", "-", "N/D", "null", "(vacío)", "Sin descripción", "No description available.", "...", "<p>Hola</p>", "texto<br/>", "caf&eacute; bueno", "a &amp; b", "a&#233;b", "informÃ³ que", "AsÃ\xad serÃ¡", "detall� ante"]
    ok = [(1, " N-0123456789 ", "  HTTPS://A.example/x?y=1#z ", 'El margen fue < 3 %. (I+D: 4 > 3) Investigación & Desarrollo. Cita: "sin descripción".', 1), (2, None, None, None, 1), (3, "N-abcdefabcd", "http://b.test", "SÃO PAULO e Ânimo, año", 1)]
    values = ok + [(1000 + i, v, None, None, 1) for i, v in enumerate(bad_ids)] + [(2000 + i, None, v, None, 1) for i, v in enumerate(bad_urls)] + [(3000 + i, None, None, v, 1) for i, v in enumerate(bad_texts)]
    want = {(1000 + i, "id_noticia") for i in range(len(bad_ids))} | {(2000 + i, "url") for i in range(len(bad_urls))} | {(3000 + i, "descripcion") for i in range(len(bad_texts))}
    assert found(spark, values) == want


def test_the_share_decides_how_much_is_tested_not_what_is_found(spark, data):
    """Dominant masks that prove their values spare the test; at any share the cells found are those of the test alone."""
    news = spark.read.parquet(f"{data}/noticias.parquet")
    want = {(c, r["fila"]) for c, f in profile.NEWS_SPECS.items() for r in news.filter(F.col(c).isNotNull() & ~f.right(F.col(c))).select("fila").collect()}
    for share in (0.0001, 0.01, 0.9):
        assert {(r["columna"], r["fila"]) for r in profile.violations(news, profile.NEWS_SPECS, "fila", share).collect()} == want
    masks = profile.dominant_masks(profile.mask_counts(news, profile.NEWS_SPECS), 0.01).collect()
    assert all(any(m["columna"] == c and spark.range(1).select(F.lit(m["mascara"]).rlike(f.proof)).first()[0] for m in masks) for c, f in profile.NEWS_SPECS.items())


def test_ranges_keep_the_type(spark):
    df = spark.createDataFrame([(9, "b"), (100000, "a"), (None, None)], "n long, t string")
    p = {r["columna"]: r for r in profile.column_profile(df).collect()}
    assert (p["n"]["minimo"], p["n"]["maximo"], p["n"]["distintos"], p["n"]["nulos"]) == ("9", "100000", 2, 1) and p["t"]["minimo"] == "a"


def test_masks(spark):
    df = spark.createDataFrame([("Ab c 12-x",), ("informÃ³ que",), (" http://A.example/uno-dos-3/ ",)], "t string")
    got = [tuple(r) for r in df.select(profile.GENERIC.mask(F.col("t")), profile.TEXT.mask(F.col("t")), profile.ADDRESS.mask(F.col("t"))).collect()]
    assert got[0][0] == "w a 9-a" and got[1][1] == "wÃ³ w" and got[2][2] == profile.WEB + "://a.w/s/"


def test_frequent_bad_masks_and_infrequent_good_ones(spark):
    """The forms are absolute: a wrong one is reported however frequent, a right one never."""
    n = len(GOOD)
    bad = [(1000 + i, "K-0123456789", "https://a.example/x y", "Sin descripción" if i % 2 else "texto<br/>", 1) for i in range(9 * n)]
    bad += [(9000, "N-hhhhhhhhhh", profile.WEB, "a &amp; b", 1)]
    ok = [(9001, None, f"https://{profile.WEB}.example/", None, 1)]
    assert found(spark, bad + ok) == {(v[0], c) for v in bad for c in ("id_noticia", "url", "descripcion")}
    mined = profile.violations(rows(spark, GOOD + bad), {"id_noticia": profile.GENERIC, "descripcion": profile.TEXT}, "fila").groupBy("columna").count().collect()
    assert dict(map(tuple, mined))["descripcion"] == len(bad) and len(mined) == 2  # a column without a known form still goes by its dominant masks


def test_loads_against_brute_force(spark):
    values = []
    for load, (nulls, distinct, length) in enumerate([(0.1, 1.0, 10), (0.5, 1.0, 10), (0.5, 0.5, 10), (0.5, 0.5, 20), (0.45, 0.5, 22)], 1):
        n = 40
        for i in range(n):
            v = None if i < nulls * n else f"{(i if i < distinct * n else 0):02d}" + "x" * (length - 2)
            values.append((load * 1000 + i, None, v, None, load))
    values += [(9000 + i, None, None, None, 7) for i in range(5)]  # load 6 is missing, load 7 has only nulls
    out = profile.load_shifts(profile.load_figures(rows(spark, values), ["url"], "carga")).collect()
    by = defaultdict(list)
    for v in values:
        by[v[4]].append(v[2])
    want = set()
    for load, cells in by.items():
        if load - 1 not in by:
            continue
        f = lambda c: (sum(x is None for x in c) / len(c), *((len({x for x in c if x is not None}) / k, sum(map(len, filter(None, c))) / k) if (k := sum(x is not None for x in c)) else (None, None)))
        (a0, b0, c0), (a, b, c) = f(by[load - 1]), f(cells)
        want |= {("url", p, load) for p, hit in (("nulos", abs(a - a0) > 0.1), ("distintos", None not in (b, b0) and abs(b - b0) > 0.1), ("longitud", None not in (c, c0) and abs(c - c0) > 0.2 * c0)) if hit}
    assert {tuple(r) for r in out} == want and want


def test_empty_tables_and_clashing_columns(spark):
    empty = rows(spark, [])
    assert profile.violations(empty, profile.NEWS_SPECS, "fila").count() == 0
    assert profile.load_shifts(profile.load_figures(empty, ["url"], "carga")).count() == 0
    assert profile.mask_divergence(empty, profile.NEWS_SPECS, "carga").count() == 0
    assert profile.column_profile(empty).count() == 0
    clash = rows(spark, GOOD).withColumns({c: F.lit("x") for c in ("columna", "valor", "mascara", "n", "total", "h", "largo")})
    assert profile.violations(clash, profile.NEWS_SPECS, "fila").count() == 0
    assert profile.load_figures(clash, ["url"], "carga").count() == 1
    assert profile.column_profile(clash).count() == len(clash.columns)


def test_divergence_bounds(spark):
    a = [(i, None, "https://a.example/x", None, 1) for i in range(10)] + [(20 + i, None, "ayer", None, 2) for i in range(10)] + [(40 + i, None, "ayer", None, 3) for i in range(10)]
    out = {r["carga"]: r["divergencia"] for r in profile.mask_divergence(rows(spark, a), {"url": profile.ADDRESS}, "carga").collect()}
    assert out == {2: pytest.approx(1.0), 3: pytest.approx(0.0)}


def test_profile_figures(spark):
    p = {r["columna"]: r for r in profile.column_profile(rows(spark, [*GOOD, (1, None, None, None, 2)]), profile.NEWS_SPECS).collect()}
    assert p["url"]["nulos"] == 1 and p["url"]["filas"] == 41 and p["id_noticia"]["mascara_dominante"] == "N-" + "h" * 10


OUTLETS = [("a.example", "Europe/Madrid", "DMY"), ("b.example", "America/New_York", "MDY"), ("c.example", None, None)]


def test_irregular_dates_frame(spark):
    o = spark.createDataFrame(OUTLETS, "dominio string, zona_horaria string, orden_fecha string")
    news = spark.createDataFrame(
        [
            (1, "a.example", "02/03/2026 10:00", "20260302T090000Z", "2026-03-02T10:00:00Z"),
            (2, "b.example", "02/03/2026 10:00", None, ""),
            (3, "zzz", "02/03/2026 10:00", "ayer", "2026-02-31T10:00:00Z"),
            (4, None, None, None, None),
            (5, "c.example", "2026-03-02 10:00", "02/03/2026 10:00", None),
        ],
        "fila bigint, dominio string, fecha_publicacion string, fecha_deteccion string, fecha_extraccion string",
    ).withColumns({c: F.lit("x") for c in ("zona", "mes_primero", "campo", "utc")})
    got = {(r["fila"], r["campo"]): r["utc"] for r in timestamps.irregular_dates(news, o).collect()}
    assert got == {
        (1, "fecha_publicacion"): "2026-03-02T09:00:00.000000Z", (1, "fecha_deteccion"): "2026-03-02T09:00:00.000000Z",
        (2, "fecha_publicacion"): "2026-02-03T15:00:00.000000Z",
        (3, "fecha_publicacion"): "invalida", (3, "fecha_deteccion"): "invalida", (3, "fecha_extraccion"): "invalida",
        (5, "fecha_publicacion"): "invalida", (5, "fecha_deteccion"): "2026-03-02T10:00:00.000000Z",
    }
    assert timestamps.irregular_dates(news.limit(0), o).count() == 0 and timestamps.irregular_dates(news, o.limit(0)).count() == 8
    assert timestamps.normalise(news, o).filter("fila = 4").first()[1:4] == (None, None, None)


def test_page_keys():
    same = ["https://A.example/X/?utm_source=q&id=3&fbclid=z#top", " https://a.example/x/?id=3 ", "HTTPS://A.EXAMPLE/X/?ID=3&UTM_Campaign=z"]
    assert {page_key(u) for u in same} == {"https://a.example/x/?id=3"}
    assert page_key("https://a.example/x/?utm_medium=rss#c") == "https://a.example/x" == page_key("https://a.example/x/")
    assert page_key("https://a.example/x?id=3&ref=") == "https://a.example/x?id=3&ref="
    assert page_key("https://a.example/x?q=caf%C3%A9+b") == "https://a.example/x?q=caf%c3%a9+b"
    assert page_key("http://[::1") is None and page_key(None) is None and page_key("https://www.a.example/x") != page_key("https://a.example/x")


def test_found_queries_over_tables(spark, data):
    p2, p3 = quality.p2_found(spark, data).toPandas(), quality.p3_found(spark, data).toPandas()
    assert list(p2.columns) == ["columna", "problema", "clave"] and list(p3.columns) == ["fila", "campo", "utc"]
    assert not p2.duplicated().any() and not p3.duplicated().any() and len(p3)
    assert p3.utc.str.fullmatch(r"invalida|\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z").all()
    assert isinstance(p2, pd.DataFrame)
