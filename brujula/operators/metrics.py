"""Evaluation: per-label scores, pair precision and recall by counting, ratios, percentiles.

A ratio whose denominator is 0 is null ("no cases"), never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brujula.operators.rollups import global_rank


def ratio(num: Column, den: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(num.cast("double"), den), digits)


def label_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """etiqueta, vp, fp, fn, precision, recall, f1 of every label that occurs on either side."""
    both = df.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("etiqueta"), truth, guess).filter(F.col("etiqueta").isNotNull())
    hit, said, was = F.col(truth) == F.col(guess), F.col(guess) == F.col("etiqueta"), F.col(truth) == F.col("etiqueta")
    one = both.groupBy("etiqueta").agg(
        F.count_if(F.coalesce(hit, F.lit(False))).alias("vp"),
        F.count_if(F.coalesce(said, F.lit(False)) & ~F.coalesce(hit, F.lit(False))).alias("fp"),
        F.count_if(F.coalesce(was, F.lit(False)) & ~F.coalesce(hit, F.lit(False))).alias("fn"),
    )
    vp, fp, fn = F.col("vp"), F.col("fp"), F.col("fn")
    return one.select("*", ratio(vp, vp + fp).alias("precision"), ratio(vp, vp + fn).alias("recall"), ratio(2 * vp, 2 * vp + fp + fn).alias("f1"))


def pair_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Pairs together in both, in the guess and in the truth, with precision and recall.

    Counted as n(n-1)/2 per group, so no pair is ever made.
    """
    known = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    pairs = lambda keys: known.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("p"))
    out = pairs([truth, guess]).select(F.col("p").alias("ambos")).crossJoin(pairs([guess]).select(F.col("p").alias("propuestos"))).crossJoin(pairs([truth]).select(F.col("p").alias("verdaderos")))
    return out.select("*", ratio(F.col("ambos"), F.col("propuestos")).alias("precision"), ratio(F.col("ambos"), F.col("verdaderos")).alias("recall"))


def cost_usd(read: Column, written: Column, price_in: float, price_out: float) -> Column:
    """Price of a call, prices being of a million tokens; null where a size is unknown."""
    return read / 1e6 * price_in + written / 1e6 * price_out


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, nearest-rank 95th percentile and median (mean of the middle pair)."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)").alias("p95"),
        F.round(F.median(value), 6).alias("mediana"),
    )


def half_split(df: DataFrame, key: str) -> DataFrame:
    """key, mitad (1 for the rows whose sha1 is among the lower half): a fixed split of a label table."""
    total = df.agg(F.count("*").alias("n"))  # one row
    ranked = global_rank(df.select(key), [F.sha1(F.col(key)), F.col(key)], "r")
    return ranked.crossJoin(total).select(key, F.when(F.col("r") <= F.floor(F.col("n") / 2), 1).otherwise(2).alias("mitad"))


def threshold_grid(df: DataFrame, truth: str, guess: str, confidence: str, thresholds: list[float], other: str) -> DataFrame:
    """umbral, aciertos, n, exactitud: the guess counts only from the threshold on, else it is `other`."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("umbral")
    rows = df.filter(F.col(truth).isNotNull()).select(truth, guess, confidence, grid)
    said = F.when(F.col(confidence) >= F.col("umbral"), F.col(guess)).otherwise(F.lit(other))
    return rows.groupBy("umbral").agg(F.count_if(said == F.col(truth)).alias("aciertos"), F.count("*").alias("n")).withColumn("exactitud", ratio(F.col("aciertos"), F.col("n")))
