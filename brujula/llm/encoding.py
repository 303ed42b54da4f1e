"""Encoding of a corpus with a public byte-level tokenizer (problem 7).

Defined cases: a null and an empty text both get an empty list (0 tokens); the strings of
special tokens are plain text; repeated rows are encoded each; an empty table gives an
empty table; further columns are not read. The tokenizer file is read once per worker
from a path that is a parameter (spark.brujula.tokenizers, default /opt/tokenizers).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brujula.llm.bpe import Encoder
from brujula.session import spread


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    return f"{spark.conf.get('spark.brujula.tokenizers', '/opt/tokenizers').rstrip('/')}/{name}"


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) of each row."""

    def run(batches):
        encoder = Encoder(path)
        for b in batches:
            flat, offsets = encoder.encode(b.column(text).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(key), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and tokens (bigint) of each row's text."""

    def run(batches):
        encoder = Encoder(path)
        for b in batches:
            n = encoder.counts(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(n, type=pa.int64())], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return spread(df.select(*keep, *([text] if text not in keep else [])), keep[0]).mapInArrow(run, f"{kinds}, tokens bigint")
