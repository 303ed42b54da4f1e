import numpy as np
import pytest
from pyspark.sql import functions as F

from brujula.llm import splitting
from brujula.llm.bpe import Encoder

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def check(text, encoder, limit=1024, overlap=64):
    pieces = splitting.split_text(text, encoder, limit, overlap)
    n = int(encoder.counts([text])[0])
    assert bool(pieces) == (n > limit)
    end = 0
    for k, (a, b, tokens, own, _) in enumerate(pieces):
        assert tokens == int(encoder.counts([text[a:b]])[0]) <= limit
        assert (a == 0) if k == 0 else ((a < end or not overlap) and end < b)  # overlaps the piece before and goes beyond it
        if k:
            assert overlap <= own <= overlap + 4
        end = b
    assert not pieces or end == len(text)
    return pieces


SENTENCE = "El Dr. Pérez, de la empresa Uno S. A., dijo hoy que el plan sigue. "


def test_boundaries_are_natural(encoder):
    doc = "\n\n".join(["# Parte " + str(i) + "\n\n" + "\n\n".join(SENTENCE * 6 for _ in range(4)) for i in range(6)])
    pieces = check(doc, encoder)
    assert {p[4] for p in pieces[1:]} <= {"seccion", "parrafo"} and any(p[4] == "seccion" for p in pieces)
    starts = [doc[: pieces[0][1]]]
    assert starts[0].rstrip().endswith(".")
    sentences = check(SENTENCE * 120, encoder)
    assert {p[4] for p in sentences[1:]} == {"oracion"}
    # abbreviations end no sentence
    words = ["El", " Dr", ".", " Pérez", " vino", ".", " Luego"]
    assert splitting.strengths(words).tolist() == [0, 1, 1, 1, 1, 1, 3]


@pytest.mark.parametrize("text", ["x" * 9000, "á" * 4000, "😀" * 3000, "sin_espacios_" * 900, "palabra " * 3000, "\n" * 5000, " " * 6000, "1234567890" * 800, "a. " * 3000, "<p>uno</p>\r\n" * 900, "- punto\n" * 1500, "汉字" * 3000])
def test_texts_without_good_boundaries(encoder, text):
    assert len(check(text, encoder)) > 1


def test_other_limits(encoder):
    for limit, overlap in ((64, 0), (64, 16), (200, 64)):
        check(SENTENCE * 40, encoder, limit, overlap)
    assert splitting.split_text("corto", encoder, 64, 8) == [] and splitting.split_text("", encoder, 64, 8) == []


def test_pack_merges_siblings_and_enters_only_large_nodes():
    tokens = np.array([4, 4, 4, 4, 20, 3, 3])
    strength = np.array([0, 3, 5, 3, 5, 1, 1])
    assert splitting.pack(tokens, strength, 16) == [(0, 4), (4, 5), (5, 7)]
    assert splitting.pack(tokens[:4], strength[:4], 8) == [(0, 2), (2, 4)]
    assert splitting.pack(np.array([], dtype=int), np.array([], dtype=int), 8) == []


def test_an_entered_node_keeps_apart_from_its_siblings():
    """(0, 2) fits; (2, 5) is too large and is entered; its first part isn't glued to what lies before it."""
    tokens = np.array([2, 2, 6, 6, 6, 2, 2])
    strength = np.array([0, 1, 9, 3, 3, 9, 1])
    assert splitting.pack(tokens, strength, 12) == [(0, 2), (2, 4), (4, 5), (5, 7)]
    # siblings after an entered node are merged among themselves again
    assert splitting.pack(np.array([20, 20, 2, 2, 2]), np.array([0, 3, 9, 9, 9]), 20) == [(0, 1), (1, 2), (2, 5)]


def brute_pack(tokens, strength, cap):
    """The tree built node by node, then packed."""

    def tree(a, b):
        inner = [int(x) for x in strength[a + 1 : b]]
        if not inner:
            return (a, b, [])
        cuts = [a, *(i + a + 1 for i, x in enumerate(inner) if x == max(inner)), b]
        return (a, b, [tree(x, y) for x, y in zip(cuts, cuts[1:])])

    size = lambda n: int(sum(tokens[n[0] : n[1]]))

    def pieces(n):
        if size(n) <= cap or not n[2]:
            return [n[:2]]
        out, run = [], []
        for c in n[2]:
            if size(c) > cap and c[2]:
                out, run = out + ([(run[0][0], run[-1][1])] if run else []) + pieces(c), []
            elif run and int(sum(tokens[run[0][0] : c[1]])) <= cap:
                run.append(c)
            else:
                out, run = out + ([(run[0][0], run[-1][1])] if run else []), [c]
        return out + ([(run[0][0], run[-1][1])] if run else [])

    return pieces(tree(0, len(tokens)))


def test_packing_matches_the_tree():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        tokens, strength = rng.integers(1, 9, n), rng.integers(1, 7, n)
        strength[0] = 0
        assert splitting.pack(tokens, strength, 14) == brute_pack(tokens, strength, 14)


def levels(text, encoder):
    (words,) = encoder.words([text])[2]
    s = splitting.strengths(words)
    return {"".join(words[i : i + 6]).strip().split("\n")[0].split(" fin")[0]: int(s[i]) for i in range(len(words)) if s[i] >= splitting.LINE}


def test_levels_of_structure(encoder):
    s = splitting
    got = levels("Inicio.\n# Uno fin\n## Dos fin\n### Tres fin\nTexto suelto fin.\n\nOtro fin.\n- a uno fin\n  - b dos fin\n    - c tres fin\n1. d cuatro fin\n", encoder)
    pick = lambda start: next(v for k, v in got.items() if k.startswith(start))
    assert [pick("# Uno"), pick("## Dos"), pick("### Tres")] == [s.SECTION + 5, s.SECTION + 4, s.SECTION + 3]
    assert pick("Texto") == s.LINE and pick("Otro") == s.PARAGRAPH
    assert [pick("- a"), pick("- b"), pick("- c"), pick("1.")] == [s.ITEM, s.ITEM - 1, s.ITEM - 2, s.ITEM]
    law = levels("Ley.\nTÍTULO I fin\nCAPÍTULO 2 fin\nSección 3 fin\nArtículo 4 fin\nArtículos varios fin\n", encoder)
    assert sorted(law.values(), reverse=True) == [s.SECTION + 5, s.SECTION + 4, s.SECTION + 3, s.SECTION + 2, s.LINE]
    page = levels("x\n<h1>Uno fin</h1>\n<h2>Dos fin</h2>\n<div>tres fin</div>\n<p>cuatro fin</p>\n<li>cinco fin</li>\n</ul> fin\n", encoder)
    assert sorted(page.values(), reverse=True) == [s.SECTION + 5, s.SECTION + 4, s.BLOCK, s.PARAGRAPH, s.ITEM, s.LINE]


def test_nested_sections_stay_whole(encoder):
    """Every piece of nested sections begins at a heading, and no piece mixes the end of a chapter with the next one."""
    sub = lambda i, j: f"## Parte {i}.{j}\n\n" + SENTENCE * 12 + "\n\n"
    doc = "".join(f"# Capítulo {i}\n\n" + "".join(sub(i, j) for j in range(5)) for i in range(4))
    pieces = check(doc, encoder, overlap=0)
    for a, b, _, _, kind in pieces:
        assert kind in ("inicio", "seccion") and doc[a:b].lstrip().startswith("#")
        assert doc[a:b].count("\n# ") == 0  # a chapter is larger than the limit, so none shares a piece with another


def test_a_piece_over_the_limit_is_an_error(encoder, monkeypatch):
    monkeypatch.setattr(splitting, "pack", lambda tokens, strength, cap: [(0, len(tokens))])
    text = "palabra " * 400

    class Wrong(Encoder):
        def counts(self, texts):
            return [10_000] * len(texts)

    with pytest.raises(RuntimeError):
        splitting.split_text(text, Wrong(PATH), 64, 8)


def test_frame(spark, data, encoder):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    long = {r["doc_id"] for r in docs.collect() if encoder.counts([r["text"]])[0] > 1024}
    out = splitting.split_long(docs.withColumns({c: F.lit(0) for c in ("pieza", "inicio", "tokens", "texto")}), PATH)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == long and max(r["tokens"] for r in rows) <= 1024
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d in long:
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["pieza"])
        assert [r["pieza"] for r in own] == list(range(1, len(own) + 1))
        assert "".join(text[d][(r["inicio"] if k == 0 else own[k - 1]["fin"]) : r["fin"]] for k, r in enumerate(own)) == text[d]
        assert all(r["texto"] == text[d][r["inicio"] : r["fin"]] for r in own)
    assert splitting.split_long(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        splitting.split_long(docs, PATH, overlap=600)
