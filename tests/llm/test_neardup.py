import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from brujula.functions.text import words
from brujula.llm import neardup, plans
from brujula.llm.sketches import super_min_hash

FIELDS = [neardup.Field("titulo"), neardup.Field("descripcion", least=8)]
SCHEMA = "fila long, titulo string, descripcion string"


def brute(rows, t=0.75):
    sets = [(r[0], [frozenset(words(x)) if x else frozenset() for x in r[1:3]]) for r in rows]
    out = set()
    for (a, x), (b, y) in combinations(sets, 2):
        for u, v, least in zip(x, y, (1, 8)):
            if min(len(u), len(v)) >= least and len(u & v) >= t * len(u | v) and a != b:
                out.add((min(a, b), max(a, b)))
    return out


def links(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    members, found = neardup.similar_classes(df, "fila", FIELDS, 0.75)
    return df, members, found, {tuple(r) for r in neardup.row_links(members, found, "fila").collect()}


def edited(rng, t):
    ws = t.split()
    for _ in range(rng.randrange(3)):
        i = rng.randrange(len(ws))
        ws[i] = rng.choice([ws[i] + "x", "hoy " + ws[i], "", ws[i][::-1]])
    if rng.random() < 0.3:
        rng.shuffle(ws)
    return " ".join(w for w in ws if w)


def test_links_match_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"comun{i}" for i in range(25)]
    base = [" ".join(rng.sample(vocabulary, 8) + [f"nombre{rng.randrange(120)}", f"lugar{rng.randrange(120)}"]) for _ in range(150)]
    rows = [(i, edited(rng, rng.choice(base)), edited(rng, rng.choice(base)) if rng.random() < 0.5 else None) for i in range(700)]
    assert links(spark, rows)[3] == brute(rows)


def test_texts_of_frequent_words_only(spark):
    rng = random.Random(2)
    vocabulary = [f"comun{i}" for i in range(40)]
    rows = [(i, " ".join(rng.sample(vocabulary, 12)), None) for i in range(300)]
    rows += [(1000 + i, edited(rng, rows[i][1]), None) for i in range(200)]
    want, got = brute(rows), links(spark, rows)[3]
    assert got == want and len(want) > 100


def test_long_texts_of_frequent_words(spark):
    rng = random.Random(6)
    vocabulary = [f"comun{i}" for i in range(300)]
    rows = [(i, " ".join(rng.sample(vocabulary, 50 + i % 40)), None) for i in range(120)]
    for i in range(120):
        ws = rows[i][1].split()
        ws[: rng.randrange(12)] = [f"raro{i}x{j}" for j in range(rng.randrange(12))]
        rows.append((1000 + i, " ".join(ws), None))
    want, got = brute(rows), links(spark, rows)[3]
    assert got == want and len(want) > 100


def test_divided_buckets(spark, monkeypatch):
    """Every bucket with more than four pairs is divided by further words, down to blocks: nothing is lost."""
    rng = random.Random(3)
    template = [f"comun{i}" for i in range(14)]
    rows = []
    for i in range(60):
        ws = list(template)
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(14)] = f"otra{rng.randrange(6)}"
        rows.append((i, " ".join(ws + ["corto"] * (i % 2)), " ".join(rng.sample(template, 9)) if i % 3 else None))
    want = brute(rows)
    for split in (1, 2, 5):
        monkeypatch.setattr(neardup, "SPLIT", split)
        assert links(spark, rows)[3] == want
    assert len(want) > 100


def test_share_found_by_bands(spark, data):
    """The bands of the signatures find nearly all links; the prefix words complete them."""
    _, classes = neardup.text_classes(spark.read.parquet(f"{data}/noticias.parquet"), "fila", FIELDS)
    common = neardup.frequent_words(classes)
    found = [neardup.class_links(classes, common, 0.75, bands, prefix).count() for bands, prefix in ((True, False), (False, True), (True, True))]
    assert found[0] >= 0.95 * found[2] and found[1] == found[2] > 100


def test_odd_cases_and_groups(spark):
    text = "uno dos tres cuatro cinco seis siete ocho"
    rows = [(1, "Uno, dos TRES cuatro", None), (2, "uno dós tres cuatro", None), (3, None, text), (4, "", text + " nueve"), (5, "!!!", None), (6, "solo", "uno dos"), (7, "otra cosa distinta", "uno dos"), (8, None, None), (9, "palabra " * 5000, None), (10, "palabra", None)]
    df, members, found, got = links(spark, rows)
    assert got == {(1, 2), (3, 4), (9, 10)} == brute(rows)
    g = {r["fila"]: (r["grupo"], r["enlaces"]) for r in neardup.groups(df, members, found, "fila").collect()}
    assert g == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (8, 0), 9: (9, 1), 10: (9, 1)}
    clash = df.withColumns({c: F.lit(1) for c in ("campo", "palabras", "c", "k", "w", "a", "b")})
    members, found = neardup.similar_classes(clash, "fila", FIELDS, 0.75)
    assert neardup.row_links(members, found, "fila").count() == 3
    members, found = neardup.similar_classes(df.limit(0), "fila", FIELDS, 0.75)
    assert neardup.row_links(members, found, "fila").count() == 0 and neardup.groups(df.limit(0), members, found, "fila").count() == 0


def test_many_copies(spark):
    rows = [(i, "el mismo titulo repetido muchas veces", None) for i in range(60)] + [(100, "el mismo titulo repetido muchas", None)]
    _, members, found, got = links(spark, rows)
    assert len(got) == 61 * 60 // 2 and found.count() == 1  # copies are one class: one link between texts


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(3)
    words_ = rng.integers(0, 2**32, 4000, dtype=np.uint32)
    errors = []
    for _ in range(150):
        shared, own = rng.choice(words_, 30), rng.choice(words_, (2, 10))
        a, b = np.unique(np.append(shared, own[0])), np.unique(np.append(shared, own[1]))
        s = super_min_hash(np.append(a, b), np.array([0, len(a), len(a) + len(b)]), 64)
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.055  # independent hashes: 0.061


def test_early_stopping_changes_nothing():
    """Dealing all rounds by brute force gives the same signature."""
    from brujula.llm.sketches import mixed

    rng = np.random.default_rng(5)
    slots = 16
    for n in (1, 2, 5, 40, 300):
        h = np.unique(rng.integers(0, 2**32, n, dtype=np.uint32))
        want = np.full(slots, np.iinfo(np.uint64).max, dtype=np.uint64)
        for x in h:
            base, perm = mixed(np.array([x], dtype=np.uint64) ^ (np.uint64(1) << np.uint64(40))), list(range(slots))
            for j in range(slots):
                base = mixed(base)
                k = j + int(base[0] >> np.uint64(33)) % (slots - j)
                perm[j], perm[k] = perm[k], perm[j]
                v = (j << 58) | ((int(base[0]) & ((1 << 26) - 1)) << 32) | int(x)
                want[perm[j]] = min(int(want[perm[j]]), v)
        assert (super_min_hash(h, np.array([0, len(h)]), slots)[0] == want).all()


def test_found_over_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/noticias.parquet").select("fila", "titulo", "descripcion").collect()]
    p = plans.p4_found(spark, data).toPandas()
    assert list(p.columns) == ["fila_a", "fila_b"] and set(zip(p.fila_a, p.fila_b)) == brute(rows) and len(p)


def test_links_of_a_row_over_both_fields(spark):
    """enlaces counts the rows linked through either field, each once."""
    rng = random.Random(4)
    vocabulary = [f"palabra{i}" for i in range(60)]
    base = [[" ".join(rng.sample(vocabulary, 9)) for _ in range(6)] for _ in range(2)]

    def near(text):
        return text + rng.choice(["", "", " uno", " dos"])

    rows = [(i, near(rng.choice(base[0])) if i % 7 else None, near(rng.choice(base[1])) if i % 5 else None) for i in range(90)]
    df, members, found, pairs = links(spark, rows)
    want = {i: sum(i in p for p in pairs) for i in range(90)}
    assert pairs == brute(rows)
    assert {r["fila"]: r["enlaces"] for r in neardup.groups(df, members, found, "fila").collect()} == want
