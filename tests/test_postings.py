"""Search and novelty by lists of postings: the same as brute force, without tables of pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brujula.operators import lexical


def watched(monkeypatch):
    """The number of rows of every table that is cut, by name."""
    rows, real = [], lexical.cut

    def cut(df, name="cut"):
        out = real(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(lexical, "cut", cut)
    return rows


def unit(counts, idf, sublinear):
    v = {w: ((1 + math.log(n)) if sublinear else n) * idf[w] for w, n in counts.items() if w in idf}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / norm for w, x in v.items()}


def brute_search(queries, passages, k=10, least=0.1, coverage=0.5, boost=0.15):
    bags = {p: Counter(t.split()) for p, t, _ in passages}
    content = {p: Counter({w: n for w, n in b.items() if not w[0].isdigit()}) for p, b in bags.items()}
    df = Counter(w for b in content.values() for w in b)
    idf = {w: math.log((1 + len(passages)) / (1 + n)) + 1 for w, n in df.items()}
    vectors = {p: unit(b, idf, True) for p, b in content.items()}
    out = set()
    for q, text in queries:
        stems = set(text.split())
        x = unit(Counter(w for w in text.split() if not w[0].isdigit()), idf, True)
        good = []
        for p, _, recent in passages:
            held = stems & set(bags[p])
            s = sum(v * vectors[p].get(w, 0) for w, v in x.items()) + (boost if any(w[:2] in ("19", "20") and len(w) == 4 for w in held) else 0)
            if held and len(held) >= coverage * len(stems) and s >= least:
                good.append((-round(s, 6), recent is None, -(recent or 0), p, s))
        out |= {(q, p, i, round(s, 4)) for i, (_, _, _, p, s) in enumerate(sorted(good)[:k], 1)}
    return out


@pytest.mark.parametrize("slice_rows", [40, 200_000])
def test_search_is_exact_and_makes_no_table_of_candidates(spark, monkeypatch, slice_rows):
    """Queries and passages of one template: every passage covers half of every query, as many candidates as pairs."""
    r = random.Random(5)
    names = ["zu" + a + b for a in "bcdfg" for b in "aeiou"]
    text = lambda: " ".join(["cons", "obra", "rio", *(["obra"] * r.randint(0, 1)), *r.sample(names, r.randint(1, 3)), *(["2021"] if r.random() < 0.2 else []), *(["37"] if r.random() < 0.2 else [])])
    passages = [(f"p{i:03d}", text(), r.choice([None, 1, 2, 3])) for i in range(200)] + [("leer", "", 1), ("pnum", "2021 37", 4)]
    queries = [(f"q{i}", text()) for i in range(60)] + [("nada", "xyzxy 2021 37 44"), ("vacia", "de la")]
    monkeypatch.setattr(lexical, "SLICE", slice_rows, raising=False)
    rows = watched(monkeypatch)
    got = lexical.ranked_search(spark.createDataFrame(queries, "consulta string, texto string"), spark.createDataFrame(passages, "pasaje string, texto string, reciente long"))
    assert {(x["consulta"], x["pasaje"], x["puesto"], x["puntaje"]) for x in got.collect()} == brute_search(queries, passages)
    assert max(n for _, n in rows) <= len(passages) + len(queries), rows


def templated(spark, data, path):
    """The tables of the search with all titles of news and labels made of one template and a name."""
    for name, key in (("noticias", "fila"), ("etiquetas", "id_noticia"), ("indicadores", None), ("sismos", None)):
        df = spark.read.parquet(f"{data}/{name}.parquet")
        if key:
            df = df.withColumn("titulo", F.concat(F.lit("consorcio revisa obras rio zu"), F.translate(F.pmod(F.xxhash64(key), F.lit(997)).cast("string"), "0123456789", "abcdefghij")))
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("query", ["search_evidence", "search_recall"])
def test_searches_cut_no_table_larger_than_the_passages(spark, monkeypatch, data, tmp_path, query):
    from brujula.plans import evaluation, texts

    rows = watched(monkeypatch)
    (texts.QUERIES | evaluation.QUERIES)[query](spark, templated(spark, data, tmp_path / "t")).collect()
    assert max(n for _, n in rows) == dict(rows)["passages"], rows


def test_stems_search_joined_letters_only_where_there_is_an_ampersand(spark):
    df = spark.createDataFrame([("Plan R & D, A&B",), ("Rock & rol",), ("signo 2024",), ("",), (None,)], "texto string").select(lexical.stems(F.col("texto")).alias("s"))
    assert [r["s"] for r in df.collect()] == [["plan", "rd", "ab"], ["rock", "rol"], ["signo", "2024"], [], None]
    assert "CASE WHEN contains(" in df._jdf.queryExecution().optimizedPlan().toString().replace("Contains(", "contains(")


@pytest.mark.parametrize("slice_rows", [30, 200_000])
def test_novelty_is_exact_in_parts(spark, monkeypatch, slice_rows):
    """Texts of one template with some names, so that common words decide for many; shuffled rows stay in proportion to the items."""
    r = random.Random(7)
    names = ["zu" + a + b for a in "bcdfghlm" for b in "aeiou"]
    text = lambda: " ".join(["el", "consorcio", "de", "la", r.choice(["obra", "via"]), *["de"] * r.randint(0, 2), *r.sample(["rio", "mar", "luz", "paz", "sol"], 2), *r.sample(names, r.randint(0, 3))])
    day = 86400
    items = [(f"k{i:03d}", None if r.random() < 0.1 else r.randint(-20 * day, 20 * day), text()) for i in range(300)]
    items += [("a", 100 * day, "solo aqui"), ("b", 107 * day, "solo aqui"), ("c", 114 * day + 1, "solo aqui"), ("d", 114 * day + 1, "x"), ("e", 5, ""), (None, 5, text())]
    monkeypatch.setattr(lexical, "SLICE", slice_rows, raising=False)
    df = spark.createDataFrame(items, "id string, t long, texto string")
    bags = {i: Counter(w for w in s.split() if len(w) > 1) for i, _, s in items}
    n = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log((1 + sum(map(bool, bags.values()))) / (1 + m)) + 1 for w, m in n.items()}
    vectors = {i: unit(b, idf, False) if b else {} for i, b in bags.items()}
    first = {i: t for i, t, _ in items}
    seen = lambda i: [j for j, t in first.items() if i and j and None not in (t, first[i]) and 0 < first[i] - t <= 7 * day]
    want = {i: round(max(0.0, 1 - max([0.0, *(sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) for j in seen(i))])), 4) for i in first}
    got = {x["id"]: x["novedad"] for x in lexical.novelty(df).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1.01e-4) for i in want)
    assert sum(got[i] != want[i] for i in want) <= 2  # halves of the last place
    assert got["b"] == 0.0 and got["c"] == 1.0
    plan = lexical.novelty(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [w" not in plan and "SortMergeJoin [w" not in plan, plan
