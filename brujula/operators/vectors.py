"""Dense vectors: nearest sentences, close pairs, complete-linkage clusters.

Pairs of all rows are made in groups of two blocks of bounded size, each one matrix product;
pairs of dated texts only where both hold a common stem in neighbouring time buckets. Clusters
are joined in rounds of mutually nearest ones over tables of links, so no task sees more than
a block of rows or the links of its partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brujula.session import cut

BLOCK = 2000  # rows of a block


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(col: Column) -> Column:
    """Unit vector; nulls of the same length for a zero vector."""
    norm = F.sqrt(dot(col, col))
    return F.transform(col, lambda x: F.try_divide(x.cast("double"), norm))


def best_class(df: DataFrame, key: str, vector: str, classes: DataFrame, threshold: float, other: str, most: int = 1000) -> DataFrame:
    """key, clase, parecido: the class with the greatest cosine (ties: the greater name); `other` below the threshold.

    classes: clase, v (unit vectors). The list is a vocabulary of at most `most` classes, which is
    checked; it enters the expression as a literal, so the rows are neither joined nor moved.
    """
    known = classes.limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} classes")
    if not known:
        return df.select(key, F.lit(other).alias("clase"), F.lit(None).cast("double").alias("parecido"))
    table = F.array(*[F.struct(F.lit(r["clase"]).alias("clase"), F.lit(list(map(float, r["v"]))).alias("v")) for r in known])
    best = F.array_max(F.transform(table, lambda c: F.struct(dot(F.col("u"), c.v).alias("s"), c.clase.alias("clase"))))
    scored = df.select(key, unit(F.col(vector)).alias("u")).select(key, best.alias("b"))
    return scored.select(key, F.when(F.col("b.s") >= threshold, F.col("b.clase")).otherwise(other).alias("clase"), F.round("b.s", 4).alias("parecido"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """clase, v: the unit mean vector of each label."""
    long = df.select(F.col(label).cast("string").alias("clase"), F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy("clase", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("clase").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e.m).alias("v")).select("clase", unit(F.col("v")).alias("v"))


def _blocks(df: DataFrame, key: str, vector: str, rows: int) -> tuple[DataFrame, int]:
    """(k, u, p): the unit vectors of all rows with one, dealt to blocks of about `rows`; and the number of blocks."""
    one = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), unit(F.col(vector)).alias("u")).filter(F.try_element_at("u", F.lit(1)).isNotNull())
    blocks = max(1, -(-df.count() // rows))
    return one.withColumn("p", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")), blocks


def all_close_pairs(df: DataFrame, key: str, vector: str, least: float, rows: int = BLOCK) -> DataFrame:
    """a < b, coseno of all rows whose cosine is at least `least`; a null or zero vector has no pair.

    Each pair of blocks is one product of a task. The work is that of all pairs; rows with dates and texts
    take `event_pairs`.
    """
    dealt, blocks = _blocks(df, key, vector, rows)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sides = dealt.select("k", "u", "p", other.alias("q")).select("k", "u", "p", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
    kind = df.schema[key].dataType.simpleString()

    def product(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["x"].iloc[0], g["y"].iloc[0]
        left, right = g[g["p"] == x], g[g["p"] == y]
        out = {"a": g["k"].iloc[:0], "b": g["k"].iloc[:0], "coseno": pd.Series(dtype="float64")}
        if len(left) and len(right):
            s = np.stack(left["u"].to_numpy()) @ np.stack(right["u"].to_numpy()).T
            i, j = np.nonzero(s >= least)
            ki, kj = left["k"].to_numpy()[i], right["k"].to_numpy()[j]
            take = ki < kj if x == y else ki != kj
            ki, kj, s = ki[take], kj[take], s[i[take], j[take]]
            out = {"a": np.where(ki < kj, ki, kj), "b": np.where(ki < kj, kj, ki), "coseno": s}
        return pd.DataFrame(out)

    return sides.groupBy("x", "y").applyInPandas(product, f"a {kind}, b {kind}, coseno double")


def event_pairs(df: DataFrame, key: str, vector: str, when: str, words: str, least: float, hours: int = 72, shared: int = 2) -> DataFrame:
    """a < b, coseno of the rows whose cosine is at least `least`, at most `hours` apart and with `shared` common words.

    words: an array of distinct words. Two rows with `shared` common words have one of them in common even without
    each row's shared - 1 most frequent ones, so those aren't posted; the postings meet by word and time bucket.
    Rows without a vector, an instant or enough words are in no pair.
    """
    span = hours * 3600 * 1_000_000
    one = df.filter(F.col(vector).isNotNull() & F.col(when).isNotNull() & (F.size(words) >= shared)).select(F.col(key).alias("k"), unit(F.col(vector)).alias("u"), F.unix_micros(when).alias("t"), F.col(words).alias("ws"))
    one = cut(one.filter(F.try_element_at("u", F.lit(1)).isNotNull()), "dated")
    long = one.select("k", "t", F.explode("ws").alias("w"))
    counts = long.groupBy("w").agg(F.count("*").alias("n"))
    ranked = long.join(counts, "w").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "w")))
    posted = ranked.filter(F.col("r") >= shared).select("k", "t", "w", F.floor(F.col("t") / span).cast("long").alias("g"))
    left = posted.select(F.col("k").alias("a"), F.col("t").alias("ta"), "w", F.explode(F.array("g", F.col("g") + 1, F.col("g") - 1)).alias("g"))
    right = posted.select(F.col("k").alias("b"), F.col("t").alias("tb"), "w", "g")
    near = left.join(right, ["w", "g"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= span)).select("a", "b").distinct()
    both = near.join(one.select(F.col("k").alias("a"), F.col("u").alias("ua"), F.col("ws").alias("wa")), "a").join(one.select(F.col("k").alias("b"), F.col("u").alias("ub"), F.col("ws").alias("wb")), "b")
    enough = both.filter(F.size(F.array_intersect("wa", "wb")) >= shared).select("a", "b", dot(F.col("ua"), F.col("ub")).alias("coseno"))
    return enough.filter(F.col("coseno") >= least)


def nearest(df: DataFrame, key: str, vector: str, every: int = 100, k: int = 10, rows: int = 20_000, asked: int = 1000) -> DataFrame:
    """consulta, vecino, coseno, puesto: for each row whose key divides by `every` its k nearest rows (ties: smaller key).

    Blocks of `rows` rows meet blocks of `asked` queries; every meeting keeps its k best per query, which are
    merged at the end. A null or zero vector has no neighbour and is none.
    """
    dealt, blocks = _blocks(df, key, vector, rows)
    queries = dealt.filter(F.col("k") % every == 0)
    parts = max(1, -(-queries.count() // asked))
    q = queries.select("k", "u", F.pmod(F.xxhash64("k", F.lit("q")), F.lit(parts)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("p"))
    r = dealt.select("k", "u", "p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q"))
    kind = df.schema[key].dataType.simpleString()

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame({"consulta": one["k"].iloc[:0], "vecino": one["k"].iloc[:0], "coseno": pd.Series(dtype="float64")})
        s = np.round(np.stack(one["u"].to_numpy()) @ np.stack(two["u"].to_numpy()).T, 6)
        ids = two["k"].to_numpy()
        s[one["k"].to_numpy()[:, None] == ids[None, :]] = -2
        out = []
        for i, own in enumerate(one["k"]):
            top = np.lexsort((ids, -s[i]))[:k]
            out.append(pd.DataFrame({"consulta": own, "vecino": ids[top], "coseno": s[i][top]}))
        return pd.concat(out)

    found = q.groupBy("p", "q").cogroup(r.groupBy("p", "q")).applyInPandas(best, f"consulta {kind}, vecino {kind}, coseno double").filter("coseno > -2")
    w = Window.partitionBy("consulta").orderBy(F.desc("coseno"), "vecino")
    return found.withColumn("puesto", F.row_number().over(w)).filter(F.col("puesto") <= k)


def complete_linkage(pairs: DataFrame, rounds: int = 500) -> DataFrame:
    """nodo, grupo (least node of its cluster) of every node of the close pairs a, b, d (distance).

    Complete linkage over the pairs within the threshold alone: clusters with any members farther apart never join, so
    a link of two clusters is there only if all their members are linked, and its length is the greatest of theirs.
    In every round all clusters that are mutually nearest (by distance, then ids) join at once; the distance
    of a joined cluster never falls, so this is what joining one pair after the other gives. A round is two
    aggregations and two joins over the links that are left; ties go to the smaller ids.
    """
    links = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("d", 12).alias("d")).filter("a <> b").distinct(), "links")
    nodes = links.select(F.col("a").alias("nodo")).unionByName(links.select(F.col("b").alias("nodo"))).distinct()
    label = cut(nodes.withColumn("grupo", F.col("nodo")), "labels")
    for _ in range(rounds):
        if links.isEmpty():
            return label
        ends = links.select(F.explode(F.array("a", "b")).alias("x"), "d", "a", "b")
        first = ends.groupBy("x").agg(F.min(F.struct("d", "a", "b")).alias("m"))
        joined = cut(first.groupBy("m").agg(F.count("*").alias("n")).filter("n = 2").select(F.col("m.b").alias("b"), F.col("m.a").alias("a")), "joined")
        label = cut(label.join(joined.select(F.col("b").alias("grupo"), F.col("a").alias("_a")), "grupo", "left").select("nodo", F.coalesce("_a", "grupo").alias("grupo")), "labels")
        # how many of a cluster's two parts a link needs on either side
        parts = joined.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("a").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y")
        one = links.join(parts.select(F.col("x").alias("a"), F.col("y").alias("na")), "a", "left").join(parts.select(F.col("x").alias("b"), F.col("y").alias("nb")), "b", "left")
        one = one.select(F.coalesce("na", "a").alias("p"), F.coalesce("nb", "b").alias("q"), "d", (F.when(F.col("na").isNull(), 1).otherwise(2) * F.when(F.col("nb").isNull(), 1).otherwise(2)).alias("need")).filter("p <> q")
        moved = one.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "d", "need").groupBy("a", "b").agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("need").alias("need"))
        links = cut(moved.filter("n = need").select("a", "b", "d"), "links")
    raise RuntimeError(f"no end after {rounds} rounds")


def linkage_clusters(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """key, grupo (least key of the cluster) of all rows; pairs: a, b, d of the rows that may share a cluster."""
    found = complete_linkage(pairs).select(F.col("nodo").alias(key), "grupo")
    return df.select(key).join(found, key, "left").select(key, F.coalesce("grupo", key).alias("grupo"))
