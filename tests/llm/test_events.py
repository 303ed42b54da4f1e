import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from brujula.llm import events, plans

HOUR = 3600 * 1_000_000
SCHEMA = "fila long, lengua byte, varias boolean, t long, nombres string, e long, pagina long"


def frame(spark, rows):
    df = spark.createDataFrame(rows, "fila long, lengua byte, varias boolean, t long, nombres string, pagina long")
    return df.withColumn("e", F.xxhash64("lengua", "nombres"))


def names(rng):
    s = "ba ce di fo gu la me ni po ru sa te vi zo".split()
    return "".join(rng.choice(s) for _ in range(4))


def test_agree():
    assert events.agree("a1xxxx b1xxxx c1xxxx", "a1xxxx b1xxxx c1xxxx")
    assert events.agree("bodila guruzo", "bodila guruzo savite")  # a name is missing on one side only
    assert not events.agree("bodila guruzo savite", "bodila guruzo mefopo")  # another place
    assert events.agree("bodila guruzo savite", "bodila guruzo saviet")  # misspelt
    assert not events.agree("bodila", "guruzo") and events.agree("bodila", "bodila")
    assert events.agree("bodila guruzo savite hoyx", "ayer1 bodila guruzo savite")


def test_links_match_brute_force(spark):
    rng = random.Random(5)
    actors = [(names(rng), names(rng), names(rng)) for _ in range(60)]
    rows = []
    for i in range(900):
        a = list(rng.choice(actors))
        if rng.random() < 0.15:
            a.pop(rng.randrange(3))
        elif rng.random() < 0.15:
            k = rng.randrange(3)
            a[k] = a[k][:3] + a[k][4] + a[k][3] + a[k][5:]
        rows.append((i, rng.randrange(2), False, rng.randrange(400) * HOUR + rng.randrange(3), " ".join(sorted(set(a))), None))
    got = {tuple(r) for r in events.event_links(events.clustered(frame(spark, rows))).collect()}
    want = {(x[0], y[0]) for x, y in combinations(rows, 2) if x[1] == y[1] and abs(x[3] - y[3]) <= 72 * HOUR and set(x[4].split()) & set(y[4].split()) and events.agree(x[4], y[4])}
    assert got <= want and len(got) >= 0.97 * len(want) > 100


def test_edges_and_odd_cases(spark):
    n = "bodila guruzo savite"
    rows = [
        (1, 0, False, 0, n, 10), (2, 0, False, 72 * HOUR, n, 11), (3, 0, False, 72 * HOUR + 1, n, 12), (4, 1, False, 0, n, 13), (5, 0, False, 0, "", 14), (6, 0, False, 1, "", 15),
        (7, 0, True, 0, n + " otrano", 20), (8, 0, True, 5, n + " otrano", 20), (9, 0, True, 5, n + " otrano", 21), (10, 0, False, 9, n, 20), (11, 0, True, 90 * HOUR, n, 20), (12, 0, True, 0, n, None),
    ]
    rows_df = events.clustered(frame(spark, rows))
    got = {tuple(r) for r in events.event_links(rows_df).collect()}
    assert got == {(1, 2), (1, 10), (2, 10), (2, 3), (3, 10), (7, 8), (7, 10), (8, 10)} - ({(3, 10)} if 72 * HOUR + 1 - 9 > 72 * HOUR else set())
    assert events.event_links(events.clustered(frame(spark, rows).limit(0))).count() == 0
    c = {r["fila"]: r["cluster"] for r in events.event_clusters(rows_df).collect()}
    assert len(c) == 12 and c[1] == c[2] == c[10] and c[5] != c[6] and c[1] != c[4]


def test_divided_blocks(spark, monkeypatch):
    """All entries share a name: divided blocks bring together all that share or nearly share a second one."""
    rng = random.Random(8)
    sets = [" ".join(sorted(("comunal", names(rng), names(rng)))) for _ in range(60)]
    sets += [" ".join(sorted([*s.split()[:-1], s.split()[-1][:5] + s.split()[-1][6:]])) for s in sets[:20]]
    sets += ["comunal", *(" ".join(sorted(("comunal", "segundo", names(rng)))) for _ in range(30)), "comunal segundo"]
    rows = [(i, s) for i, s in enumerate(dict.fromkeys(sets))]
    leaves = spark.createDataFrame([(i, 1, s, 0) for i, s in rows], "e long, n long, nombres string, lengua byte")
    for split in (16, 4):
        monkeypatch.setattr(events, "SPLIT", split)
        blocks = {}
        for r in events.named_blocks(leaves).collect():
            blocks.setdefault(r["k"], set()).add(r["e"])
        together = {p for b in blocks.values() for p in combinations(sorted(b), 2)}
        want = {(i, j) for (i, x), (j, y) in combinations(rows, 2) if set(x.split()) & set(y.split()) and events.agree(x, y)}
        assert want <= together and len(want) > 100
        assert max(map(len, blocks.values())) < len(rows)


def test_tree_of_features():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, events.DIMENSIONS))
    v = np.repeat(centres, 12, axis=0) + rng.normal(size=(480, events.DIMENSIONS)) * 0.05
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    n = rng.integers(1, 9, 480).astype(float)
    tree = events.FeatureTree()
    for i in rng.permutation(480).tolist():
        tree.insert(n[i], v[i], i)
    weights, sums, entries = tree.features()
    assert sorted(i for e in entries for i in e) == list(range(480)) and not tree.root.leaf
    assert np.allclose(weights.sum(), n.sum()) and np.allclose(sums.sum(axis=0), (v * n[:, None]).sum(axis=0))
    for w, s, e in zip(weights, sums, entries):  # features are the sums of what they absorbed, within the radius
        assert np.isclose(w, n[e].sum()) and np.allclose(s, (v[e] * n[e][:, None]).sum(axis=0)) and 1 - s @ s / w**2 <= events.RADIUS + 1e-9
    clusters = [sorted(i for x in c for i in entries[x]) for c in events.ward(weights, sums)]
    assert sorted(clusters) == [list(range(12 * k, 12 * k + 12)) for k in range(40)]


def test_ward_joins_by_cost_and_updates_the_features():
    """Against Ward's joins by brute force over the members themselves."""
    rng = np.random.default_rng(7)
    for _ in range(20):
        k = int(rng.integers(2, 12))
        x = rng.normal(size=(k, events.DIMENSIONS)) * 0.05
        x[:, 0] += np.where(rng.random(k) < 0.5, 1, 0)
        n = rng.integers(1, 6, k).astype(float)
        own = [[i] for i in range(k)]
        mean = lambda c: (x[c] * n[c][:, None]).sum(axis=0) / n[c].sum()  # noqa: E731, B023
        while True:
            costs = []
            for a, b in combinations(range(len(own)), 2):
                d = ((mean(own[a]) - mean(own[b])) ** 2).sum()
                if d / 2 <= events.WARD:
                    na, nb = n[own[a]].sum(), n[own[b]].sum()
                    costs.append((na * nb / (na + nb) * d, a, b))
            if not costs:
                break
            _, a, b = min(costs)
            own[a] += own.pop(b)
        assert sorted(map(sorted, events.ward(n, x * n[:, None]))) == sorted(map(sorted, own))


def test_ward_vectors():
    v = events.name_vectors(["bodila guruzo savite", "bodila guruzo saviet", "bodila guruzo", "bodila guruzo mefopo", "bodila"])
    d = 2 - 2 * v @ v.T
    assert d[0, 1] / 2 <= events.WARD and d[0, 2] / 2 <= events.WARD < d[0, 3] / 2 and d[0, 4] / 2 > events.WARD
    assert events.name_vectors([]).shape == (0, events.DIMENSIONS)


def test_common_words():
    texts = [f"Empresa Nom{i}bre Ape{i}llido aplaza la obra en Lu{i}gar" for i in range(100)] + ["Empresa Nom3bre Ape3llido aplaza la fiesta en Lu3gar"] * 8
    got = events.common_words(texts)
    assert {"empresa", "aplaza", "obra"} <= got and not any(w.startswith(("nom3", "ape3", "lu3")) for w in got)
    tell = events.Names(got)
    assert tell.of(["empresa", "emprsea", "emresa", "nombreraro", "obra", "de"]) == "nombreraro"


def hot_titles():
    rng = random.Random(3)
    facts = [" ".join(x) for x in zip(["aplaza", "critica", "aprueba", "retrasa"] * 6, ["obra nueva", "feria anual", "tarifa media"] * 8)]
    title = lambda a: f"Empresa {a[0]} {a[1]} {rng.choice(facts)} en {a[2]}{rng.choice([' ahora', '', ' despues'])}"
    texts = [title(a) for a in [(names(rng), names(rng), names(rng)) for _ in range(150)] for _ in range(2)]
    return texts + [title(("Bodila", "Guruzo", "Savite")) for _ in range(400)]


def test_names_of_a_hot_actor_stay_names(spark):
    texts = hot_titles()
    got = events.common_words(texts)
    assert {"empresa", "aplaza", "obra", "feria", "tarifa", "ahora"} <= got and got.isdisjoint({"bodila", "guruzo", "savite"})
    assert events.Names(got).of(["empresa", "bodila", "aplaza", "obra"]) == "bodila"
    news = spark.createDataFrame([(t,) for t in [*texts, None, "", "735"]], "titulo string")
    assert events.corpus_common_words(news) == events.common_words([*texts, "", "735"])
    assert events.corpus_common_words(news.limit(0)) == set()


def test_titles_without_names_link_with_their_copies(spark, data):
    news = spark.read.parquet(f"{data}/noticias.parquet")
    first = news.filter("titulo IS NOT NULL AND idioma = 'es' AND fecha_publicacion LIKE '20%Z'").limit(1).drop("fila", "titulo")
    rows = first.crossJoin(spark.createDataFrame([(1, "La obra se aplaza por la lluvia"), (2, "LA OBRA se aplaza por la lluvia"), (3, "La lluvia se aplaza por la obra")], "fila long, titulo string"))
    common = {"obra", "aplaza", "lluvia"}
    described = events.described(rows, spark.read.parquet(f"{data}/medios.parquet"), plans._language_model(spark, data), common)
    assert {tuple(r) for r in events.event_links(events.clustered(described.cache())).collect()} == {(1, 2)}


def test_typical_members(spark):
    rows = [(i, "bodila guruzo savite") for i in range(3)] + [(5, "bodila guruzo"), (6, "bodila guruzo savite extran")]
    m = spark.createDataFrame([(f, n, 1) for f, n in rows] + [(9, "otro solo", 2)], "fila long, nombres string, cluster long")
    got = {r["cluster"]: (r["tamano"], r["fila"]) for r in events.typical_members(m).collect()}
    assert got == {1: (5, 0), 2: (1, 9)}
    assert events.typical_members(m.limit(0)).count() == 0


def test_queries_over_tables(spark, data):
    p = plans.p5_found(spark, data).toPandas()
    assert list(p.columns) == ["fila_a", "fila_b"] and (p.fila_a < p.fila_b).all() and not p.duplicated().any() and len(p)
    rows = spark.read.parquet(f"{data}/noticias.parquet").count()
    m = plans.p5_members(spark, data).toPandas()
    assert len(m) == rows == m.fila.nunique()
    c = plans.p5_clusters(spark, data).toPandas()
    sizes = m.groupby("cluster_id").size()
    assert (c.set_index("cluster_id").tamano == sizes[sizes > 1].reindex(c.cluster_id)).all() and len(c) == (sizes > 1).sum()
