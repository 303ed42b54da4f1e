import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brujula.llm import languages as L

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def test_label_spellings():
    same = {"es": ["es", " ES ", "es-PA", "es_ES", "español", "castellano", "Spanish", "spa"], "en": ["inglés", "English", "en-US", "eng"], "pt": ["pt-BR", "português", "por"], "de": ["Deutsch", "deu", "de-DE"], "fr": ["français", "fra"], "it": ["italiano", "ita"]}
    for code, names in same.items():
        assert {L.label_code(n) for n in names} == {code}
    assert all(L.label_code(n) is None for n in (None, "", "  ", "n/d", "null", "--", "xx", "ro", "ca", "gl", "und", "?", "desconocido"))


def test_forward_sums_all_segmentations():
    pieces = L.Pieces([" a", " ab", "a", "b", "c", "bc", "abc", " "])
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces.pieces), 2))
    index = {x: i for i, x in enumerate(pieces.pieces)}

    def brute(s, lang):
        total = 0.0
        stack = [(0, 1.0)]
        while stack:
            at, q = stack.pop()
            if at == len(s):
                total += q
                continue
            stack.append((at + 1, q * (L.UNKNOWN**0.5 if at == 0 else L.UNKNOWN)))
            for n in range(1, len(s) - at + 1):
                if (i := index.get(s[at : at + n])) is not None:
                    stack.append((at + n, q * p[i, lang]))
        return np.log(total)

    words = ["a", "ab", "abc", "bca", "aabbcc", "zz", "abcabc"]
    got = L.word_scores(pieces, p, words)
    assert np.allclose(got, [[brute(" " + w, k) for k in range(2)] for w in words])


def test_expectation_matches_differences():
    """The gradient of the log likelihood by log p is the expected count, so one EM round raises the likelihood."""
    pieces = L.Pieces([" a", "a", "b", "ab", " ", " b"])
    counts = {"ab": np.array([5.0, 0, 1, 1, 1, 1]), "aab": np.array([1.0, 4, 1, 1, 1, 1]), "bb": np.array([0.0, 3, 1, 1, 1, 1])}

    def likelihood(p):
        s = L.word_scores(pieces, p, sorted(counts))
        return sum((np.array([counts[w] for w in sorted(counts)]) * s).sum(axis=0))

    values = [likelihood(L.fit(pieces, counts, rounds=r, mixed=0.0)) for r in (1, 2, 4)]
    assert values[0] <= values[1] + 1e-6 <= values[2] + 2e-6


@pytest.fixture(scope="module")
def news(data):
    return pd.read_parquet(f"{data.replace('sf0.001', 'sf0.01')}/noticias.parquet", columns=["fila", "titulo", "idioma"])


@pytest.fixture(scope="module")
def model(news):
    rows = news[news.titulo.notna()].assign(l=news.idioma.map(L.label_code)).dropna(subset=["l"])
    train = rows[rows.fila % 2 == 0].groupby("l").head(1500)
    return L.fit_sample(train.rename(columns={"titulo": "t"})[["l", "t"]], PATH)


def test_held_out_accuracy(news, model):
    held = news[(news.fila % 2 == 1) & news.titulo.notna() & news.idioma.map(L.label_code).notna()]
    got = L.Labeller(*model).stretches(held.titulo.tolist(), True)
    agree = np.mean([L.LANGUAGES[s[0][0]] == L.label_code(i) for s, i in zip(got, held.idioma)])
    assert agree > 0.96  # about 2 % of the labels themselves are wrong


def test_mixed_titles(news, model):
    held = news[(news.fila % 2 == 1) & news.titulo.notna()].assign(l=news.idioma.map(L.label_code)).dropna(subset=["l"])
    lab = L.Labeller(*model)
    sure = [(t, code) for t, code, s in zip(held.titulo, held.l, lab.stretches(held.titulo.tolist(), True)) if len(s) == 1 and L.LANGUAGES[s[0][0]] == code and len(t) > 60]
    by = {c: [t for t, x in sure if x == c] for c in L.LANGUAGES}
    rng = random.Random(4)
    texts, want = [], []
    for _ in range(300):
        codes = rng.sample([c for c in by if by[c]], rng.choice([1, 2, 2, 3]))
        texts.append(rng.choice([" | ", " — ", ": ", " / "]).join(rng.choice(by[c]) for c in codes))
        want.append(codes)
    got = [[L.LANGUAGES[x[0]] for x in s] for s in lab.stretches(texts, True)]
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.95


def test_odd_texts(spark, model):
    rows = [(1, None, "es"), (2, "", "es"), (3, "12 — 34 ?!", None), (4, "x" * 20_000, "en"), (5, "El precio de la luz sube hoy otra vez", None), (6, "El precio de la luz sube hoy otra vez", "castellano"), (6, "El precio de la luz sube hoy otra vez", "castellano"), (7, "漢字 ﬁ ａｂｃ", "es")]
    df = spark.createDataFrame(rows, "fila long, titulo string, idioma string").withColumns({c: F.lit(1) for c in ("segmento", "confianza", "caso", "inicio")})
    got = L.segments(df, model, "fila", "titulo", "idioma").collect()
    assert {r["fila"] for r in got} == {4, 5, 6, 7} and sum(r["fila"] == 6 for r in got) == 2
    five = next(r for r in got if r["fila"] == 5)
    assert five["idioma"] == "es" and five["caso"] and five["segmento"] == 1 and five["confianza"] > 0.9 and (five["inicio"], five["fin"]) == (0, 37)
    assert not next(r for r in got if r["fila"] == 6)["caso"]
    assert L.segments(df.limit(0), model, "fila", "titulo", "idioma").count() == 0


def test_training_on_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (2, "hola", "xx")], "fila long, titulo string, idioma string")
    pieces, p = L.train(df, "titulo", "idioma", PATH)
    assert np.isfinite(p).all() and L.segments(df, (pieces, p), "fila", "titulo", "idioma").count() == 1


def test_found_columns(spark, data):
    from brujula.llm import plans

    out = plans.p1_found(spark, data)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("fila", "bigint"), ("segmento", "int"), ("idioma", "string")]
    p = out.toPandas()
    assert not p.duplicated().any() and set(p.idioma) <= set(L.LANGUAGES)
    assert (p.groupby("fila").segmento.apply(sorted).map(lambda s: s == list(range(1, len(s) + 1)))).all()


def test_long_words_are_scored_whole(monkeypatch):
    """A word beyond LONGEST has the same sum as if all words were scored at once; endless ones have a finite score."""
    rng = np.random.default_rng(2)
    pieces = L.Pieces([" a", "ab", "a", "b", "c", "bc", "abc", "ca"])
    p = rng.random((len(pieces.pieces), 3)) / 3
    words = ["".join(rng.choice(list("abcx"), n)) for n in (3, 20, 41, 60, 90)]
    one_by_one = [L.long_word_score(pieces, p, w) for w in words]
    monkeypatch.setattr(L, "LONGEST", 200)
    assert np.allclose(L.word_scores(pieces, p, words), one_by_one)
    endless = L.long_word_score(pieces, p, "abc" * 3000)
    assert np.isfinite(endless).all() and (endless < -1000).all()
