"""Selection effects between two populations: standardised differences, rank AUC, KS, support, weights, the gate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import unpivoted
from tidemark.operators.ranks import quantiles, sums_below
from tidemark.sources.store import stored

#: Bands of the gate.
SMD_BANDS, AUC_BANDS, STRONG_AUC, LEAST_SUPPORT = (0.10, 0.25), (0.55, 0.65), 0.75, 0.05


def _long(df: DataFrame, columns: list[str], accepted: Column) -> DataFrame:
    return unpivoted(df.withColumn("_a", accepted), columns, "double", ["_a"]).where("value IS NOT NULL AND NOT isnan(value)")


def smd(df: DataFrame, columns: list[str], accepted: Column) -> DataFrame:
    """(feature, smd): difference of means over the pooled deviation; null where that is 0 or a side has fewer than two values."""
    a, b = F.when(F.col("_a"), F.col("value")), F.when(~F.col("_a"), F.col("value"))
    g = _long(df, columns, accepted).groupBy(F.col("column").alias("feature")).agg(F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), F.count(a).alias("n1"), F.count(b).alias("n2"))
    pooled = F.sqrt((F.col("v1") + F.col("v2")) / 2)
    return g.select("feature", F.round(F.when((F.col("n1") >= 2) & (F.col("n2") >= 2) & (pooled > 1e-12), (F.col("m1") - F.col("m2")) / pooled), 6).alias("smd"))


def _ladder(df: DataFrame, columns: list[str], accepted: Column) -> DataFrame:
    """Counts of both sides per distinct value, with the counts below it."""
    cells = _long(df, columns, accepted).groupBy("column", "value").agg(F.count_if("_a").alias("a"), F.count_if(~F.col("_a")).alias("b"))
    return sums_below(cells, ["column"], "value", {"below_a": "a", "below_b": "b"}, {"all_a": "a", "all_b": "b"})


def rank_auc(df: DataFrame, columns: list[str], accepted: Column, ladder: DataFrame | None = None) -> DataFrame:
    """(feature, rank_auc): how often an accepted value is above a rejected one, ties half."""
    g = (ladder or _ladder(df, columns, accepted)).groupBy(F.col("column").alias("feature")).agg(F.sum(F.col("a") * (F.col("below_b") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    return g.select("feature", F.round(F.when((F.col("n1") >= 2) & (F.col("n2") >= 2), F.col("u") / (F.col("n1") * F.col("n2"))), 6).alias("rank_auc"))


def ks(df: DataFrame, columns: list[str], accepted: Column, ladder: DataFrame | None = None) -> DataFrame:
    """(feature, ks, p): the largest gap of the two distribution functions, and Kolmogorov's limit for its chance under equal populations."""
    gap = F.abs((F.col("below_a") + F.col("a")) / F.greatest("all_a", F.lit(1)) - (F.col("below_b") + F.col("b")) / F.greatest("all_b", F.lit(1)))
    g = (ladder or _ladder(df, columns, accepted)).groupBy(F.col("column").alias("feature")).agg(F.max(gap).alias("d"), F.max("all_a").alias("n1"), F.max("all_b").alias("n2"))
    return g.select("feature", F.round("d", 6).alias("ks"), F.round(kolmogorov(F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))) * F.col("d")), 6).alias("p"))


def kolmogorov(x: Column) -> Column:
    """The chance that Kolmogorov's statistic exceeds x: the alternating series, or the theta series where that converges slowly."""
    far = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, 9)), F.lit(0.0))
    near = F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / x * sum((F.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8.0 * x * x)) for k in range(1, 6)), F.lit(0.0))
    return F.when(x <= 1e-9, 1.0).when(x < 1.0, F.least(near, F.lit(1.0))).otherwise(F.greatest(far, F.lit(0.0)))


def common_support(df: DataFrame, score: str, accepted: Column) -> DataFrame:
    """(low, high, share_in_support): the share of rejected scores between the accepted ones' 1st and 99th percentiles."""
    marked = df.withColumn("_a", accepted)
    q = quantiles(marked.where("_a"), [], score, [0.01, 0.99])
    inside = F.col(score).between(F.col("q")[0], F.col("q")[1])
    return marked.where("NOT _a").crossJoin(F.broadcast(q)).groupBy(F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("high")).agg(F.round(F.avg(inside.cast("int")), 6).alias("share_in_support"))  # one row


def verdicts(df: DataFrame, good: list[str], partial: list[str], accepted: Column) -> DataFrame:
    """(feature, comparability, smd, rank_auc, ks, verdict). Like-for-like features are judged by SMD, others by rank AUC."""
    every = [*good, *partial]
    ladder = stored(_ladder(df, every, accepted))
    rows = smd(df, every, accepted).join(rank_auc(df, every, accepted, ladder), "feature").join(ks(df, every, accepted, ladder).drop("p"), "feature")
    grade = F.when(F.col("feature").isin(*good), "good").otherwise("partial")
    size = F.when(grade == "good", F.abs("smd")).otherwise(F.abs(F.col("rank_auc") - 0.5) + 0.5)
    low, high = F.when(grade == "good", SMD_BANDS[0]).otherwise(AUC_BANDS[0]), F.when(grade == "good", SMD_BANDS[1]).otherwise(AUC_BANDS[1])
    verdict = F.when(size.isNull(), "unknown").when(size >= high, "substantial").when(size >= low, "notable").otherwise("negligible")
    return rows.select("feature", grade.alias("comparability"), "smd", "rank_auc", "ks", verdict.alias("verdict"))


def gate(features: DataFrame, separability: DataFrame, support: DataFrame) -> DataFrame:
    """(n_substantial, separability_auc, share_in_support, decision). separability: (rank_auc); support: (share_in_support); one row each."""
    n = features.agg(F.count_if(F.col("verdict") == "substantial").alias("n_substantial"))
    row = n.crossJoin(separability.select(F.col("rank_auc").alias("separability_auc"))).crossJoin(support.select("share_in_support"))
    biased = (F.col("n_substantial") > 0) | (F.col("separability_auc") >= STRONG_AUC)
    return row.withColumn("decision", F.when(~biased, "no_correction_needed").when(F.col("share_in_support") >= LEAST_SUPPORT, "apply_correction").otherwise("correction_unjustified"))


def kish(df: DataFrame, weight: Column, by: list[str] | None = None) -> DataFrame:
    """Effective sample size over finite positive weights."""
    w = F.when((weight > 0) & (weight < float("inf")), weight)
    return df.groupBy(*(by or [])).agg(F.count(w).alias("n"), F.round(F.pow(F.sum(w), 2) / F.nullif(F.sum(w * w), F.lit(0.0)), 4).alias("ess"))


def inverse_weights(df: DataFrame, propensity: str) -> DataFrame:
    """Adds weight: 1 / propensity, clipped to its own 1st and 99th percentiles, with mean 1."""
    raw = df.withColumn("_w", 1 / F.nullif(F.col(propensity), F.lit(0.0)))
    q = quantiles(raw, [], "_w", [0.01, 0.99]).withColumnRenamed("q", "_q")
    clipped = raw.crossJoin(F.broadcast(q)).withColumn("_w", F.least(F.greatest("_w", F.col("_q")[0]), F.col("_q")[1]))
    mean = clipped.agg(F.avg("_w").alias("_m"))
    return clipped.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_q", "_m")  # one row each
