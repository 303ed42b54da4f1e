"""Mixing sources to target weights by Pareto order sampling (problem 8).

Each source of a mix has a target of weight x fraction x all tokens. It is met as far as
supply and the cap on repetitions allow. Every document of the source gets the whole
copies that all of them get with certainty; the rest of the target is drawn by Pareto
order sampling: document i has inclusion probability p_i = min(1, lambda / copies of its
text), so a text that the corpus holds several times isn't preferred, and documents are
taken in ascending order of (U/(1-U)) / (p/(1-p)) as long as the rest of the target holds them;
the gap that is left then gets the one document that comes closest to it.

The order is cut without sorting a source in one task: documents are counted in fine
classes of their rank variable (a bounded number), the class in which the target is
reached is found on those counts, and only documents of that class are sorted.

Defined cases: null and empty texts have no tokens and are in no mix; documents without a
source are in none; a source without documents or with weight 0 gets no document, and a
report row that says so; an empty corpus gives an empty mix; repeated target rows of one
mix and source are added up; ties of the rank variable go by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brujula.session import cut

CLASSES = 64  # classes of the rank variable per factor e
EDGE = 40.0  # ranks beyond exp(+-EDGE) share the outermost classes


def targets(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per mix and source: objetivo, oferta, alcanzable and the certain copies and the rest in tokens."""
    supply = sizes.groupBy("source").agg(F.sum("tokens").alias("oferta"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("todo"))
    g = goals.groupBy("mezcla_id", "source").agg(F.sum("peso").alias("peso"), F.max("max_repeticiones").alias("max_repeticiones"), F.max("fraccion_total").alias("fraccion_total"))
    return (
        g.join(supply, "source", "left")
        .crossJoin(total)  # one row
        .select(
            "mezcla_id", "source", "peso", "max_repeticiones", F.coalesce("oferta", F.lit(0)).alias("oferta"),
            (F.col("peso") * F.col("fraccion_total") * F.col("todo")).alias("objetivo"),
        )
        .withColumn("alcanzable", F.least("objetivo", F.col("oferta") * F.greatest(F.col("max_repeticiones"), F.lit(0))))
        .withColumn("enteras", F.coalesce(F.floor(F.try_divide("alcanzable", "oferta")), F.lit(0)).cast("int"))
        .withColumn("resto", F.col("alcanzable") - F.col("enteras") * F.col("oferta"))
    )


def inclusion(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """mezcla_id, source, lambda with sum(min(1, lambda/k) x tokens) = resto over the source's documents.

    Solved on one row per source and number of copies k: prefix sums over k tell which k
    have p = 1 (the smallest ones), the others share what is left.
    """
    by_k = sizes.groupBy("source", "k").agg(F.sum("tokens").alias("x"))
    w = Window.partitionBy("mezcla_id", "source").orderBy("k")
    full = F.sum("x").over(w)
    tail = F.sum(F.col("x") / F.col("k")).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = goal.filter("resto > 0").select("mezcla_id", "source", "resto").join(by_k, "source")
    rows = rows.select("mezcla_id", "source", "resto", "k", "x", full.alias("lleno"), F.coalesce(tail, F.lit(0.0)).alias("cola"), F.lead("k").over(w).alias("k_luego"))
    # with the first classes up to k full: lambda = (resto - lleno) / cola, valid if k <= lambda < k_luego
    lam = F.when(F.col("cola") > 0, (F.col("resto") - F.col("lleno")) / F.col("cola")).otherwise(F.col("k").cast("double"))
    fits = rows.filter((F.col("lleno") <= F.col("resto")) & (lam >= F.col("k"))).groupBy("mezcla_id", "source").agg(F.max(lam).alias("lam_lleno"))
    none = rows.groupBy("mezcla_id", "source").agg((F.first("resto") / F.sum(F.col("x") / F.col("k"))).alias("lam_vacio"))
    return none.join(fits, ["mezcla_id", "source"], "left").select("mezcla_id", "source", F.coalesce(F.when(F.col("lam_lleno") > 0, F.col("lam_lleno")), F.col("lam_vacio")).alias("lam"))


def mix(sizes: DataFrame, goals: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows, targets). rows: mezcla_id, source, doc_id, tokens, copias (at least 1).

    sizes: doc_id, source, tokens, k (number of documents with the same text).
    """
    sizes = sizes.filter((F.col("tokens") > 0) & F.col("source").isNotNull())
    goal = cut(targets(sizes, goals), "goal")
    lam = inclusion(sizes, goal)
    own = cut(goal.filter("alcanzable > 0").join(lam, ["mezcla_id", "source"], "left").select("mezcla_id", "source", "enteras", "resto", "lam"), "own")
    docs = sizes.join(own, "source")
    p = F.least(F.lit(1.0), F.coalesce(F.col("lam"), F.lit(0.0)) / F.col("k"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mezcla_id", "doc_id"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    log_rank = F.log(u / (1 - u)) - F.when(p >= 1, F.lit(EDGE * 2)).when(p <= 0, F.lit(-EDGE * 2)).otherwise(F.log(p / (1 - p)))
    docs = docs.withColumn("rango", log_rank).withColumn("clase", F.floor(F.greatest(F.least(F.col("rango"), F.lit(EDGE)), F.lit(-EDGE)) * CLASSES).cast("int"))
    docs = cut(docs.select("mezcla_id", "source", "doc_id", "tokens", "enteras", "resto", "rango", "clase"), "ranked")
    sums = docs.filter("resto > 0").groupBy("mezcla_id", "source", "clase").agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy("mezcla_id", "source").orderBy("clase")
    sums = cut(sums.select("mezcla_id", "source", "clase", (F.sum("t").over(w) - F.col("t")).alias("antes"), F.sum("t").over(w).alias("hasta")), "sums")
    docs = docs.join(sums, ["mezcla_id", "source", "clase"], "left")
    inside = docs.filter((F.col("antes") < F.col("resto")) & (F.col("hasta") > F.col("resto")))
    order = Window.partitionBy("mezcla_id", "source").orderBy("rango", "doc_id")
    edge = inside.withColumn("una", (F.col("antes") + F.sum("tokens").over(order) <= F.col("resto")).cast("int"))
    rest = docs.filter(F.col("antes").isNull() | (F.col("antes") >= F.col("resto")) | (F.col("hasta") <= F.col("resto")))
    rest = rest.withColumn("una", F.coalesce((F.col("hasta") <= F.col("resto")).cast("int"), F.lit(0)))
    cols = ["mezcla_id", "source", "doc_id", "tokens", "enteras", "resto", "una"]
    drawn = cut(rest.select(*cols).unionByName(edge.select(*cols)), "drawn")
    # what is missing to the target is filled by the one document not drawn that comes closest to it
    lack = F.col("resto") - F.col("suma")
    sums = drawn.filter("resto > 0").groupBy("mezcla_id", "source").agg(F.sum(F.col("tokens") * F.col("una")).alias("suma"))
    last = (
        drawn.filter("una = 0 AND resto > 0").join(sums, ["mezcla_id", "source"])
        .filter(F.abs(F.col("tokens") - lack) < lack)
        .groupBy("mezcla_id", "source").agg(F.min(F.struct(F.abs(F.col("tokens") - lack).alias("d"), "doc_id")).alias("b"))
        .select("mezcla_id", "source", F.col("b.doc_id").alias("cierre"))
    )
    rows = drawn.join(last, ["mezcla_id", "source"], "left")
    copies = F.col("enteras") + F.col("una") + F.coalesce((F.col("doc_id") == F.col("cierre")).cast("int"), F.lit(0))
    return rows.select("mezcla_id", "source", "doc_id", "tokens", copies.cast("int").alias("copias")).filter("copias > 0"), goal


def report(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Target and actual share of each source of each mix."""
    got = rows.groupBy("mezcla_id", "source").agg(F.sum(F.col("tokens") * F.col("copias")).alias("tokens"), F.count("*").alias("documentos"), F.max("copias").alias("copias_max"))
    total = got.groupBy("mezcla_id").agg(F.sum("tokens").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        goal.join(got, ["mezcla_id", "source"], "left").join(total, "mezcla_id", "left")
        .select(
            "mezcla_id", "source", "peso", "max_repeticiones", "oferta", F.round("objetivo", 3).alias("objetivo"), F.round("alcanzable", 3).alias("alcanzable"),
            zero("tokens"), zero("documentos"), zero("copias_max"), F.coalesce(F.round(F.col("tokens") / F.col("total"), 6), F.lit(0.0)).alias("parte"),
        )
    )
