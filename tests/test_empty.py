"""The data queries over empty tables and over tables of nulls: no crash, a result of the same columns."""

import pytest
from pyspark.sql import functions as F

from brujula.plans import quality

NAMES = ("noticias", "medios", "documents", "mezcla_objetivo")


@pytest.fixture(scope="module")
def odd(spark, data, tmp_path_factory):
    """Folders of the tables without rows, and of ten rows in which everything but the key is null."""
    out = {}
    for kind in ("empty", "nulls"):
        d = tmp_path_factory.mktemp(kind)
        for name in NAMES:
            df = spark.read.parquet(f"{data}/{name}.parquet")
            keys = {"noticias": ("fila",), "documents": ("doc_id",)}.get(name, ())
            df = df.limit(0) if kind == "empty" else df.limit(10).select(*[F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
            df.coalesce(1).write.parquet(f"{d}/{name}.parquet")
        out[kind] = str(d)
    return out


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(quality.QUERIES))
def test_core(spark, odd, name, kind):
    rows = quality.QUERIES[name](spark, odd[kind]).collect()
    if kind == "empty" or name.endswith("_found"):
        assert not rows
