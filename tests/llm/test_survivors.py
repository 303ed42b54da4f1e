import random

import pandas as pd
from pyspark.sql import functions as F

from brujula.functions.dates import INVALID  # noqa: F401 - the core's module is what the plan uses
from brujula.functions.urls import page_key
from brujula.llm import plans, survivors


def chosen(df, policies):
    out = survivors.consensus(df, "g", "fila", policies)
    assert out.columns == ["g", "grupo", "campo", "fila", "valor", "distancia", "valores"]
    return {(r["g"], r["campo"]): r for r in out.collect()}


def test_orders_and_ties(spark):
    rows = [(1, "g", 2, "2026-01-02"), (2, "g", 1, "2026-01-01"), (3, "g", 1, "2026-01-03"), (4, "g", 1, "2026-01-03"), (5, None, 0, None), (6, None, 0, None), (7, "solo", 0, None), (8, "h", 9, None), (9, "h", 9, None)]
    df = spark.createDataFrame(rows, "fila long, g string, rango int, dia string").withColumns({c: F.lit(1) for c in ("grupo", "campo", "k", "n", "v", "m", "peso", "valor")})
    day = F.regexp_replace("dia", "-", "").cast("long")
    p = {"a": survivors.Policy(F.col("rango"), order=(F.col("rango"),)), "b": survivors.Policy(F.col("dia"), order=(day,)), "c": survivors.Policy(F.col("dia"), order=(-day,))}
    got = {k: (r["grupo"], r["fila"]) for k, r in chosen(df, p).items()}
    assert got == {("g", "a"): (1, 2), ("g", "b"): (1, 2), ("g", "c"): (1, 3), ("h", "a"): (8, 8)}
    assert chosen(df.limit(0), p) == {}


def elected(values, weights):
    return survivors.aligned([survivors.Columns.of(v, w) for v, w in zip(values, weights)]).elected()


def test_columns():
    v = ["el puerto cierra hoy", "el puerto cierra", "el puerto cierra ya", "puerto cierra", "el perro cierra"]
    assert elected(v, [1.0] * 5) == ["el", "puerto", "cierra"]
    assert elected(v, [9.0, 1, 1, 1, 1]) == ["el", "puerto", "cierra", "hoy"]
    assert elected(["solo"], [1.0]) == ["solo"] and elected([""], [1.0]) == [] and elected(["", "a b"], [1.0, 3.0]) == ["a", "b"]
    one, two = (survivors.aligned([survivors.Columns.of(x, 1.0) for x in part]) for part in (v[:3], v[3:]))
    assert one.merged(two).elected() == ["el", "puerto", "cierra"] and one.merged(two).seen == 5
    back = survivors.Columns.read(one.text())
    assert back.columns == one.columns and back.seen == one.seen
    assert survivors.token_edits("a b c".split(), "a x c d".split()) == 2 and survivors.token_edits([], ["a"]) == 1


def test_the_preferred_row_outweighs_its_group():
    """Whatever the others say and however they align: the vote is the first row's value."""
    rng = random.Random(4)
    for _ in range(200):
        values = [" ".join(rng.choices("abcdef", k=rng.randrange(9))) for _ in range(rng.randrange(1, 7))]
        weights = sorted((float(rng.randrange(1, 4)) for _ in values), reverse=True)
        assert elected(values, [sum(weights) + weights[0], *weights[1:]]) == values[0].split()


def test_votes(spark):
    rows = [(1, "g", "el puerto cierra hoy"), (2, "g", "el puerto cierra"), (3, "g", "el puerto cierra"), (4, "g", "el pueto cierra"), (5, "g", None), (6, "h", "x"), (7, "h", "x"), (8, "solo", "y"), (9, None, "z"), (10, None, "z"), (11, "t", "a b"), (12, "t", "a c"), (13, "v", ""), (14, "v", "")]
    df = spark.createDataFrame(rows, "fila long, g string, v string").withColumns({c: F.lit(1) for c in ("valor", "peso", "k", "n", "texto")})
    got = {g: (r["valor"], r["fila"], r["distancia"], r["valores"]) for (g, _), r in chosen(df, {"v": survivors.Policy(F.col("v"))}).items()}
    assert got["g"] == ("el puerto cierra", 2, 0, 3) and got["h"] == ("x", 6, 0, 1) and got["v"] == ("", 13, 0, 1) and got["t"][1] in (11, 12) and set(got) == {"g", "h", "t", "v"}


def test_large_group_is_aligned_by_columns(spark, monkeypatch):
    monkeypatch.setattr(survivors, "CHUNK", 8)
    rng = random.Random(1)
    base = "la empresa aplaza la obra del puerto por falta de fondos".split()
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(len(w))] = f"error{i}"
        rows.append((i, "g", " ".join(w), i))
    rows.append((999, "g", " ".join(base), 7))
    rows.append((1000, "h", "dos", 1))
    rows.append((1001, "h", "dos", 1))
    df = spark.createDataFrame(rows, "fila long, g string, v string, o long")
    got = chosen(df, {"v": survivors.Policy(F.col("v")), "o": survivors.Policy(F.col("v"), order=(-F.col("o"),))})
    assert got["g", "v"]["valor"] == " ".join(base) and got["g", "v"]["fila"] == 999 and got["g", "v"]["valores"] == 301
    assert got["g", "o"]["fila"] == 299 and got["h", "v"]["fila"] == 1000 == got["h", "o"]["fila"]


def test_found_against_brute_force(spark, data):
    from brujula.operators import timestamps
    from brujula.plans.quality import p2_found

    n = spark.read.parquet(f"{data}/noticias.parquet").toPandas()
    bad = {(r["columna"], r["clave"]) for r in p2_found(spark, data).filter("problema = 'patron'").collect()}
    when = timestamps.normalise(spark.read.parquet(f"{data}/noticias.parquet"), spark.read.parquet(f"{data}/medios.parquet"))
    t = {r["fila"]: r for r in when.select("fila", F.unix_micros("fecha_extraccion").alias("x"), F.unix_micros("fecha_deteccion").alias("d")).collect()}
    n["p"] = [page_key(u) if u is not None and ("url", f) not in bad else None for u, f in zip(n.url, n.fila)]
    want = set()
    for _, g in n[n.p.notna()].groupby("p"):
        if len(g) < 2:
            continue
        rank = {"tvn_rss": 0, "tvn_web": 1, "gdelt": 2}
        key = int(g.fila.min())
        want.add((key, "origen", min(g.itertuples(), key=lambda r: (rank.get(r.origen, 3), -(t[r.fila]["x"] if t[r.fila]["x"] is not None else -(2**62)), r.fila)).fila))
        d = [r for r in g.itertuples() if isinstance(r.descripcion, str) and ("descripcion", r.fila) not in bad]
        if d:
            want.add((key, "descripcion", min(d, key=lambda r: (-len(r.descripcion), r.fila)).fila))
        s = [r for r in g.itertuples() if r.origen == "gdelt" and t[r.fila]["d"] is not None]
        if s:
            want.add((key, "fecha_deteccion", min(s, key=lambda r: (t[r.fila]["d"], r.fila)).fila))
    out = plans.p6_found(spark, data)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("grupo", "bigint"), ("campo", "string"), ("fila", "bigint")]
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert isinstance(plans.p6_consensus(spark, data).toPandas(), pd.DataFrame)
