"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation and one join, so no node's neighbours are ever collected, and
a hub of any degree is spread by the join's key on the other side only through its minimum.
The edges are cut to a table in the shared folder after every round. The number of rounds
grows with the logarithm of the longest chain.

Defined cases: null ends and loops are dropped, repeated edges count once, an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brujula.session import cut


def _star(edges: DataFrame) -> DataFrame:
    """Links every node to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    small = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(small, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """nodo, componente (its least node) of every node that has an edge."""
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    mark = None
    for _ in range(rounds):
        now = cut(_star(now), "star")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("u").alias("nodo"), F.col("v").alias("componente")).unionByName(now.select(F.col("v").alias("nodo"), F.col("v").alias("componente")).distinct())
