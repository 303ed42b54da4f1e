import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brujula.llm import encoding
from brujula.llm.bpe import Encoder, merge_words, vocabulary

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def ours(texts):
    flat, offsets = Encoder(PATH).encode(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


CASES = ["", " ", "  \n\n x", "aaaaaaaaaaaaaaaa", "abababababab", "<|endoftext|>hola <|endoftext|>", "İstanbul ŞİŞLİ ﬁn", "😀😀👩‍👩‍👧 é", "don't I'll WE'RE", "﻿​ x", "١٢٣ 三四五 ²", "x" * 5000, "á" * 3000, "no-break" * 500, "\r\n\r\n\t a", "\x00\x01"]


def test_known_cases(reference):
    assert ours(CASES) == [reference(c) for c in CASES]
    assert ours([None, ""]) == [[], []] and ours([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60), max_size=6))
def test_any_text(reference, texts):
    assert ours(texts) == [reference(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab aA.\n", max_size=80))
def test_overlapping_pairs(reference, text):
    assert ours([text]) == [reference(text)]


def test_round_trip_and_batches():
    e = Encoder(PATH)
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
    for batch in (CASES, CASES[::-1], ["nuevo texto, otra vez"] * 3):
        flat, offsets = e.encode(batch)
        assert [b"".join(ranks[i] for i in flat[a:b].tolist()).decode() for a, b in zip(offsets, offsets[1:])] == batch
        assert e.counts(batch).tolist() == np.diff(offsets).tolist()
    flat, lengths = merge_words([], vocabulary(PATH))
    assert len(flat) == 0 and len(lengths) == 0


def test_frame(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = encoding.encode(docs, PATH).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r["ids"] == reference(r["text"] or "") for r in rows)
    clash = docs.withColumns({c: F.lit(1) for c in ("ids", "tokens", "key")})
    assert encoding.encode(clash, PATH).columns == ["doc_id", "ids"]
    n = {r["doc_id"]: r["tokens"] for r in encoding.token_counts(clash, PATH, ["doc_id"]).collect()}
    assert n == {r["doc_id"]: len(r["ids"]) for r in rows}
    assert encoding.encode(docs.limit(0), PATH).count() == 0
    twice = docs.limit(5).unionByName(docs.limit(5))
    assert encoding.encode(twice, PATH).count() == 10
