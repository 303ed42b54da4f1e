"""The llm queries over empty tables and over tables of nulls."""

import pytest

from brujula.llm import plans
from tests.test_empty import odd  # noqa: F401 - fixture

EXPECT = {"p4_groups": 10, "p5_members": 10, "p7_ids": 10}


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_llm(spark, odd, name, kind):  # noqa: F811
    rows = plans.QUERIES[name](spark, odd[kind]).collect()
    want = EXPECT.get(name, 0) if kind == "nulls" else 0
    if name == "p8_partes":
        assert len(rows) <= 1
    else:
        assert len(rows) == want
