"""No group of rows meets in one task: no plan sorts or frames all values of a column by the column alone."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, drift, governance, profile, ranks, selection


def frame(spark):
    return spark.range(500).select("id", (F.col("id") * 7 % 101).cast("double").alias("a"), (F.col("id") * 3 % 50).cast("double").alias("b"), (F.col("id") % 9).cast("string").alias("s"), (F.col("id") % 2 == 0).alias("side"))


CASES = {
    "quantiles": lambda df: ranks.quantiles(profile.unpivoted(df, ["a", "b"], "double"), ["column"], "value", [0.1, 0.5]),
    "ks": lambda df: selection.ks(df, ["a", "b"], F.col("side")),
    "rank_auc": lambda df: selection.rank_auc(df, ["a", "b"], F.col("side")),
    "psi": lambda df: drift.psi(df, ["a", "b"], F.col("side")),
    "tvd": lambda df: drift.tvd(df, ["s"], F.col("side")),
    "fit_levels": lambda df: clean.fit_levels(df, ["s"], 5),
    "frequencies": lambda df: profile.frequencies(df, ["s", "a"], 3),
    "applicant_ids": lambda df: governance.with_applicant_ids(df.withColumn("given", F.lit("")), "given", "id"),
    "winsorised": lambda df: clean.winsorised(df, "a"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_windows_are_over_ranges_sums_or_limits(spark, name):
    plan = CASES[name](frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        parts = line.split("Window [", 1)[-1].split("], [")
        if "Window [" in line and len(parts) > 1 and "_b#" not in parts[1]:  # not inside a range
            over_sums = re.search(r"sum\(_t_|sum\(_n#|sum\(r#|sum\(c#", parts[0])  # a row per partition or bin
            limit = "row_number()" in parts[0] and "WindowGroupLimit" in plan
            assert over_sums or limit, line


def test_kolmogorov(spark):
    """Values of the limit that tables print, and both series at their border."""
    got = spark.createDataFrame([(0.0,), (0.5,), (0.999999,), (1.0,), (1.358,), (1.628,), (5.0,)], "x double").select("x", selection.kolmogorov(F.col("x")).alias("p")).collect()
    want = {0.0: 1.0, 0.5: 0.963945, 0.999999: 0.270001, 1.0: 0.27, 1.358: 0.05, 1.628: 0.01, 5.0: 0.0}
    assert all(abs(r.p - want[r.x]) < 2e-4 for r in got)


def test_ks_rejects_a_shift_and_not_equal_halves(spark):
    df = spark.range(2000).select((F.col("id") % 2 == 0).alias("side"), F.hash("id").cast("double").alias("same"), (F.hash("id") % 1000 + F.when(F.col("id") % 2 == 0, 200).otherwise(0)).cast("double").alias("moved"))
    got = {r.feature: r for r in selection.ks(df, ["same", "moved"], F.col("side")).collect()}
    assert got["same"].p > 0.05 and got["moved"].p < 1e-5


def test_group_ranks(spark):
    df = frame(spark).withColumn("neg", -F.col("a"))
    got = {r.id: r.r for r in ranks.row_ranks(df, "neg", ["id"], ["s"]).collect()}
    rows = df.collect()
    for level in {r.s for r in rows}:
        own = sorted((r for r in rows if r.s == level), key=lambda r: (r.neg, r.id))
        assert [got[r.id] for r in own] == list(range(1, len(own) + 1))


def test_many_quantiles_meet_each_value_a_few_times(spark):
    """Unsorted, repeated and dense probabilities over ties, single values and gaps: as numpy has them; a rank meets only probabilities near it."""
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.hash("id")).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)], "g string, v double"))
    values = {}
    for r in df.where("v IS NOT NULL").collect():
        values.setdefault(r.g, []).append(r.v)
    for wanted in ([i / 253 for i in range(1, 253)], [1.0, 0.0, 0.5, 0.5, 0.999]):
        got = {r.g: r.q for r in ranks.quantiles(df, ["g"], "v", wanted).collect()}
        assert set(got) == set(values) and all(np.allclose(got[g], np.quantile(v, wanted), rtol=1e-12) for g, v in values.items())
    met = spark.range(100_000).select(F.size(ranks._nearby([i / 253 for i in range(1, 253)], F.col("id"), F.col("id"), F.lit(100_000))).alias("n"))
    assert met.agg(F.max("n")).first()[0] <= 4
