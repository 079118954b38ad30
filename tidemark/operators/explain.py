"""Attributions over time, in long form (row_id, feature, t, phi): importance, stability, comparison, reasons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sampling import row_seed


def area(phi: DataFrame, signed: bool = False, by: list[str] | None = None) -> DataFrame:
    """(by..., feature, importance): trapezoid of |phi| (or phi) over t, by its span, averaged over rows."""
    by = by or []
    w = Window.partitionBy(*by, "row_id", "feature").orderBy("t")
    v = F.col("phi") if signed else F.abs("phi")
    rows = phi.withColumn("_v", v).withColumns({"_t0": F.lag("t").over(w), "_v0": F.lag("_v").over(w)})
    each = rows.groupBy(*by, "row_id", "feature").agg((F.sum((F.col("t") - F.col("_t0")) * (F.col("_v") + F.col("_v0")) / 2) / F.nullif(F.max("t") - F.min("t"), F.lit(0))).alias("a"))
    return each.groupBy(*by, "feature").agg(F.round(F.avg("a"), 8).alias("importance"))


def row_areas(phi: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., row_id, feature, area, signed): the trapezoid of |phi| and of -phi (positive: more risk) over t, by its span."""
    by = by or []
    w = Window.partitionBy(*by, "row_id", "feature").orderBy("t")
    rows = phi.withColumns({"_t0": F.lag("t").over(w), "_p0": F.lag("phi").over(w)})
    mean = lambda x, y: F.sum((F.col("t") - F.col("_t0")) * (x + y) / 2) / F.nullif(F.max("t") - F.min("t"), F.lit(0))
    return rows.groupBy(*by, "row_id", "feature").agg(mean(F.abs("phi"), F.abs("_p0")).alias("area"), mean(-F.col("phi"), -F.col("_p0")).alias("signed"))


def importances(phi: DataFrame) -> DataFrame:
    """(feature, importance, signed), averaged over rows."""
    return mean_areas(row_areas(phi))


def mean_areas(areas: DataFrame) -> DataFrame:
    """(feature, importance, signed) of row_areas."""
    return areas.groupBy("feature").agg(F.round(F.avg("area"), 8).alias("importance"), F.round(F.avg("signed"), 8).alias("signed"))


def time_variation(phi: DataFrame) -> DataFrame:
    """(feature, variation): mean |phi - its mean over t| by mean |phi|."""
    m = F.avg("phi").over(Window.partitionBy("row_id", "feature"))
    rows = phi.withColumn("_d", F.abs(F.col("phi") - m))
    return rows.groupBy("feature").agg(F.round(F.avg("_d") / F.nullif(F.avg(F.abs("phi")), F.lit(0.0)), 6).alias("variation"))


def ranked(table: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Adds rank: 1 for the largest, ties averaged."""
    by = by or []
    part = by or [F.lit(1)]
    r = F.rank().over(Window.partitionBy(*part).orderBy(F.desc(value))) + (F.count(F.lit(1)).over(Window.partitionBy(*part, value)) - 1) / 2
    return table.withColumn("rank", r)


#: Bars of the verdicts on methods, shifts and segments.
SPEARMAN_FLOOR, TOP5_FLOOR, SHIFT_SPEARMAN, SHIFT_TOP5 = 0.8, 0.6, 0.9, 0.6
RANK_FLOOR, OVERLAP_FLOOR, CV_CEILING = 0.85, 0.7, 0.5


def _correlation(a: str, b: str) -> Column:
    """Pearson's over the rows that have both; null without any spread."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def _jaccard(a: str, b: str, k: int) -> Column:
    return F.round(F.try_divide(F.count_if((F.col(a) <= k) & (F.col(b) <= k)), F.count_if((F.col(a) <= k) | (F.col(b) <= k))), 6)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(feature, ia, ra, sa, ib, rb, sb): importance, rank and signed importance in two tables of (feature, importance, signed). As many rows as features."""
    side = lambda t, n: ranked(t, "importance").select("feature", F.col("importance").alias(f"i{n}"), F.col("rank").alias(f"r{n}"), F.col("signed").alias(f"s{n}"))
    return side(a, "a").join(side(b, "b"), "feature")


def compare_methods(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for two tables of (feature, importance, signed), positive signs meaning more risk in both: Spearman, Pearson, Jaccard of the top 5 and 10, agreement of signs, largest rank shift, verdict."""
    rows = paired(a, b)
    both = (F.abs("sa") > 1e-9) & (F.abs("sb") > 1e-9)
    against = both & (F.signum("sa") != F.signum("sb"))
    top = (F.col("ra") <= 5) | (F.col("rb") <= 5)
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("feature")))), ",")
    row = rows.agg(
        F.round(_correlation("ra", "rb"), 6).alias("spearman"), F.round(_correlation("ia", "ib"), 6).alias("pearson"), _jaccard("ra", "rb", 5).alias("top5_overlap"), _jaccard("ra", "rb", 10).alias("top10_overlap"),
        F.round(F.try_divide(F.count_if(both & ~against), F.count_if(both)), 6).alias("sign_agreement"), listed(against).alias("sign_disagreements"), listed(against & top).alias("top5_sign_disagreements"), F.max(F.abs(F.col("ra") - F.col("rb"))).alias("largest_shift"),
    )
    verdict = F.when(F.col("top5_sign_disagreements") != "", "material disagreement").when((F.col("spearman") < SPEARMAN_FLOOR) | (F.col("top5_overlap") < TOP5_FLOOR), "meaningful disagreement").otherwise("broad agreement")
    return row.withColumn("verdict", verdict)


def noise_floor(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how far two draws of coalitions agree on importance. Without any spread Spearman is 1 for equal draws, else 0."""
    rows = paired(a.withColumn("signed", F.lit(0.0)), b.withColumn("signed", F.lit(0.0)))
    row = rows.agg(_correlation("ra", "rb").alias("rho"), _jaccard("ra", "rb", 5).alias("top5_jaccard"), _jaccard("ra", "rb", 10).alias("top10_jaccard"), F.avg(F.abs(F.col("ia") - F.col("ib"))).alias("gap"), F.avg((F.col("ia") + F.col("ib")) / 2).alias("scale"))
    rho = F.when(F.col("rho").isNull() | F.isnan("rho"), (F.col("gap") < 1e-8).cast("double")).otherwise(F.col("rho"))
    return row.select(F.round(rho, 6).alias("spearman"), "top5_jaccard", "top10_jaccard", F.round(F.when(F.col("scale") > 0, F.col("gap") / F.col("scale")).otherwise(0.0), 6).alias("mean_relative_gap"))


def explanation_shift(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, verdict) of importance before and after a refit. table: (feature, before, after, rank_before, rank_after, change, percent), a side that lacks the feature counts 0; verdict: one row."""
    side = lambda t, n: ranked(t, "importance").select("feature", F.col("importance").alias(n), F.col("rank").alias(f"rank_{n}"))
    rows = side(before, "before").join(side(after, "after"), "feature", "full_outer").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in ("before", "after")})
    change = F.col("after") - F.col("before")
    table = rows.select("feature", "before", "after", "rank_before", "rank_after", F.round(change, 8).alias("change"), F.round(F.try_divide(100 * change, F.nullif(F.col("before"), F.lit(0.0))), 4).alias("percent"))
    row = rows.agg(F.round(_correlation("rank_before", "rank_after"), 6).alias("spearman"), _jaccard("rank_before", "rank_after", 5).alias("top5_overlap"))
    return table, row.withColumn("verdict", F.when((F.col("spearman") < SHIFT_SPEARMAN) | (F.col("top5_overlap") < SHIFT_TOP5), "explanations shift").otherwise("explanations hold"))


def segment_stability(by_level: DataFrame, whole: DataFrame, level: str, sizes: DataFrame, k: int = 5, least: int = 30) -> DataFrame:
    """(level, n_rows, spearman, topk_overlap): each level's ranks against the whole's; levels below `least` rows are left out. sizes: (level, n_rows)."""
    g = ranked(whole, "importance").select("feature", F.col("rank").alias("rg"))
    rows = ranked(by_level, "importance", [level]).join(g, "feature").join(sizes.where(F.col("n_rows") >= least), level)
    return rows.groupBy(level).agg(F.max("n_rows").alias("n_rows"), F.round(_correlation("rank", "rg"), 6).alias("spearman"), _jaccard("rank", "rg", k).alias("topk_overlap"))


def segment_variation(by_level: DataFrame, level: str, sizes: DataFrame, least: int = 30) -> DataFrame:
    """(feature, cv): deviation over mean of the levels' importance, 0 where the mean is 0."""
    rows = by_level.join(sizes.where(F.col("n_rows") >= least), level)
    return rows.groupBy("feature").agg(F.round(F.coalesce(F.try_divide(F.stddev_samp("importance"), F.nullif(F.avg("importance"), F.lit(0.0))), F.lit(0.0)), 6).alias("cv"))


def stability_verdict(levels: DataFrame, variation: DataFrame, level: str) -> DataFrame:
    """One row: the least rank correlation and its level, the mean overlap, how many features vary, and the verdict by floors set beforehand."""
    row = levels.agg(F.count(F.lit(1)).alias("n_levels"), F.round(F.min("spearman"), 6).alias("least_spearman"), F.min_by(level, F.struct("spearman", level)).alias("worst_level"), F.round(F.avg("topk_overlap"), 6).alias("mean_overlap"))
    row = row.crossJoin(variation.agg(F.count_if(F.col("cv") > CV_CEILING).alias("n_unstable")))  # one row each
    verdict = F.when(F.col("n_levels") == 0, "inconclusive").when((F.col("least_spearman") < RANK_FLOOR) | (F.col("mean_overlap") < OVERLAP_FLOOR), "drifts").otherwise("stable")
    return row.withColumn("verdict", verdict)


_POISSON = np.cumsum([1 / np.e / f for f in (1, 1, 2, 6, 24, 120)])  # shares of the draws 0, 0-1, ... 0-5


def bootstrap_ranks(values: DataFrame, level: str, target: str, reference: list[str], features: list[str], *, rounds: int = 2000, seed: int = 21, ci: float = 0.95) -> DataFrame:
    """Bootstrap of features' ranks in one level against reference levels, resampled within each level.

    values: (row_id, level, feature, value), the values being time-integrated |phi|. A row's weight in a
    round is a Poisson(1) draw by ((s + round * g) mod 2 ** 32), s and g (odd) hashed from the row: the same for any
    partitioning, independent between rows, pairwise independent between rounds; each task sums all
    rounds of its rows by one matrix product. Round 0 has all weights 1. A feature that a row lacks is
    left out of its mean. Returns a row per feature: rank_target, rank_reference, rank_shift and
    share_ratio with their intervals, the reference levels' range of ranks, the share of rounds
    in which the target's rank is outside it, and whether the intervals exclude 0 and 1.
    """
    own = values.where(F.col(level).isin(target, *reference))
    wide = own.groupBy("row_id", level).agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"_{i}") for i, f in enumerate(features)])
    seeded = wide.select(level, *[f"_{i}" for i in range(len(features))], row_seed(seed, F.col("row_id")).alias("_s"), row_seed(seed + 1, F.col("row_id")).alias("_g"))
    n_features = len(features)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        r = np.arange(1, rounds + 1, dtype=np.uint64)
        for part in parts:
            for name, rows in part.groupby(level):
                for a in range(0, len(rows), 512):
                    some = rows.iloc[a : a + 512]
                    s, g = some["_s"].to_numpy(np.uint64), some["_g"].to_numpy(np.uint64) | np.uint64(1)
                    u = (((s[:, None] + r * g[:, None]) & np.uint64(2**32 - 1)).astype(float) + 0.5) / 2**32
                    w = np.concatenate([np.ones((len(some), 1)), np.searchsorted(_POISSON, u, "left")], axis=1)
                    v = some[[f"_{i}" for i in range(n_features)]].to_numpy(float)
                    has = ~np.isnan(v)
                    part_sums = np.stack([w.T @ np.where(has, v, 0.0), w.T @ has.astype(float)])
                    total[name] = total.get(name, 0.0) + part_sums
        for name, (s, w) in total.items():
            yield pd.DataFrame({level: name, "round": np.repeat(np.arange(rounds + 1, dtype=np.int32), n_features), "feature": np.tile(features, rounds + 1), "s": s.ravel(), "w": w.ravel()})

    parts = seeded.mapInPandas(sums, f"{level} string, round int, feature string, s double, w double").groupBy(level, "round", "feature").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    pooled = parts.where(F.col(level) != target).groupBy("round", "feature").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).select(F.lit("(pooled)").alias(level), "round", "feature", "s", "w")
    means = parts.unionByName(pooled).withColumn("m", F.round(F.try_divide("s", "w"), 8))
    order = Window.partitionBy(level, "round").orderBy(F.desc("m"), "feature")
    placed = means.withColumns({"rank": F.row_number().over(order), "share": F.col("m") / F.sum("m").over(Window.partitionBy(level, "round"))})
    of = lambda name, c: F.max(F.when(F.col(level) == name, F.col(c)))
    single = ~F.col(level).isin(target, "(pooled)")
    per = placed.groupBy("round", "feature").agg(of(target, "rank").alias("rank_target"), of("(pooled)", "rank").alias("rank_reference"), of(target, "share").alias("_st"), of("(pooled)", "share").alias("_sr"), F.min(F.when(single, F.col("rank"))).alias("_lo"), F.max(F.when(single, F.col("rank"))).alias("_hi"))
    per = per.select("round", "feature", "rank_target", "rank_reference", (F.col("rank_target") - F.col("rank_reference")).alias("rank_shift"), F.try_divide("_st", "_sr").alias("share_ratio"), "_lo", "_hi", ((F.col("rank_target") < F.col("_lo")) | (F.col("rank_target") > F.col("_hi"))).cast("int").alias("_out"))
    draw, point = F.col("round") > 0, F.col("round") == 0
    names = ("rank_target", "rank_reference", "rank_shift", "share_ratio")
    low, high = (1 - ci) / 2, 1 - (1 - ci) / 2
    ends = [F.percentile(F.when(draw, F.col(n)), [low, high]).alias(f"_q_{n}") for n in names]  # `rounds` values a feature
    row = per.groupBy("feature").agg(*[F.max(F.when(point, F.col(n))).alias(n) for n in names], *ends, F.concat_ws("-", F.max(F.when(point, F.col("_lo"))), F.max(F.when(point, F.col("_hi")))).alias("reference_range"), F.round(F.avg(F.when(draw, F.col("_out"))), 6).alias("outside_share"))
    out = [c for n in names for c in (F.round(F.col(n).cast("double"), 6).alias(n), F.round(F.col(f"_q_{n}")[0], 6).alias(f"{n}_low"), F.round(F.col(f"_q_{n}")[1], 6).alias(f"{n}_high"))]
    beside = lambda n, x: (F.col(f"{n}_low") > x) | (F.col(f"{n}_high") < x)
    return row.select("feature", *out, "reference_range", "outside_share").withColumns({"shift_excludes_zero": beside("rank_shift", 0), "share_excludes_one": beside("share_ratio", 1)})


def efficiency_residual(phi: DataFrame, totals: DataFrame) -> DataFrame:
    """(t, max_residual, mean_residual): |prediction - base - sum of phi|. totals: (row_id, t, base, prediction)."""
    sums = phi.groupBy("row_id", "t").agg(F.sum("phi").alias("s"))
    gap = F.abs(F.col("prediction") - F.col("base") - F.col("s"))
    return totals.join(sums, ["row_id", "t"]).groupBy("t").agg(F.round(F.max(gap), 6).alias("max_residual"), F.round(F.avg(gap), 6).alias("mean_residual"))


def reasons(scores: DataFrame, templates: DataFrame, medians: DataFrame, barred: list[str], most: int = 4, flagged_top: int = 8) -> DataFrame:
    """(row_id, reasons, features, n_reasons, inconsistent, flags): the stated reasons of each row with an adverse feature.

    scores: (row_id, feature, phi, value); templates: (feature, reason, higher_is_adverse), medians:
    (feature, median): a row per feature each. Adverse features (phi < 0) stand strongest first; barred
    ones are skipped; `x_missing` takes the template of `x`, others without one are skipped; a text is
    given once; `most` at most. inconsistent: stated features whose value lies on the side of the median
    that does not speak against the applicant (a value equal to it, or a missing one, is consistent).
    flags: barred features among the `flagged_top` strongest adverse ones.
    """
    adverse = scores.where("phi < 0").withColumn("_top", F.row_number().over(Window.partitionBy("row_id").orderBy("phi", "feature")))
    bad = F.col("feature").isin(*barred)
    named = adverse.where(~bad).withColumn("_base", F.regexp_replace("feature", "_missing$", "")).join(F.broadcast(templates.withColumnRenamed("feature", "_base")), "_base").join(F.broadcast(medians), "feature", "left")
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("row_id", "reason").orderBy("phi", "feature"))).where("_n = 1")
    placed = first.withColumn("_n", F.row_number().over(Window.partitionBy("row_id").orderBy("phi", "feature"))).where(F.col("_n") <= most)
    wrong = F.when(F.col("higher_is_adverse"), F.col("value") < F.col("median")).otherwise(F.col("value") > F.col("median")) & F.col("higher_is_adverse").isNotNull()
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "; ")
    stated = placed.groupBy("row_id").agg(listed(F.struct("_n", F.col("reason").alias("t"))).alias("reasons"), listed(F.struct("_n", F.col("feature").alias("t"))).alias("features"), F.count(F.lit(1)).alias("n_reasons"), listed(F.when(wrong, F.struct("_n", F.col("feature").alias("t")))).alias("inconsistent"))
    flags = adverse.where(bad & (F.col("_top") <= flagged_top)).groupBy("row_id").agg(listed(F.struct(F.col("_top"), F.col("feature").alias("t"))).alias("flags"))
    return stated.join(flags, "row_id", "full_outer").select("row_id", F.coalesce("reasons", F.lit("")).alias("reasons"), F.coalesce("features", F.lit("")).alias("features"), F.coalesce("n_reasons", F.lit(0)).cast("long").alias("n_reasons"), F.coalesce("inconsistent", F.lit("")).alias("inconsistent"), F.coalesce("flags", F.lit("")).alias("flags"))


def riskiest(scores: DataFrame, risk: str, keep: list[str]) -> DataFrame:
    """The row of the highest risk among those that have an explanation (ties by row_id): one partial aggregate."""
    return scores.agg(F.max_by(F.struct("row_id", risk, *keep), F.struct(risk, -F.col("row_id"))).alias("_r")).select("_r.*")
