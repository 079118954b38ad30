"""Data profiles: overview, missing values, numeric and categorical summaries, outliers, correlations, rates.

Medians of durations use `percentile`, whose buffer holds a number per distinct month; other quantiles
are those of ranks.py.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import quantiles


def unpivoted(df: DataFrame, columns: list[str], kind: str, keep: list[str] | None = None) -> DataFrame:
    """(keep..., column, value): one row per value, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*(keep or []), F.explode(pairs).alias("x")).select(*(keep or []), "x.column", "x.value")


def overview(df: DataFrame, id_column: str = "id") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), (F.count(id_column) - F.count_distinct(id_column)).alias("duplicate_ids"),
        F.date_format(F.min("issue_month"), "yyyy-MM-dd").alias("first_month"), F.date_format(F.max("issue_month"), "yyyy-MM-dd").alias("last_month"),
        F.round(F.avg("event"), 4).alias("event_rate"), F.expr("percentile(duration_months, 0.5)").alias("median_duration"),
    )


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    long = unpivoted(df, columns, "string")
    return long.groupBy("column").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.round(F.avg(F.col("value").isNull().cast("int")), 4).alias("missing_share"), F.count_distinct("value").alias("distinct"))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quantiles are exact and linear between ranks; skew is adjusted for bias."""
    n = F.count("value")
    long = unpivoted(df, columns, "double")
    out = long.groupBy("column").agg(n.alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("s")).join(quantiles(long, ["column"], "value", [0.01, 0.25, 0.5, 0.75, 0.99]), "column")
    skew = F.when(F.col("n") > 2, F.col("s") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2))
    names = ("p1", "p25", "median", "p75", "p99")
    return out.where("n > 0").select("column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(names)], "max", F.round(skew, 6).alias("skew"))


def frequencies(df: DataFrame, columns: list[str], top: int = 15) -> DataFrame:
    """The most frequent levels of each column (ties by level), and the rest as one row."""
    counts = unpivoted(df, columns, "string").groupBy("column", F.coalesce(F.trim("value"), F.lit("(missing)")).alias("level")).count()
    every = F.broadcast(counts.groupBy("column").agg(F.sum("count").alias("all"), F.count(F.lit(1)).alias("levels")))  # a row per column
    named = counts.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "level"))).where(F.col("r") <= top).drop("r")  # a limit a group, applied before the exchange
    named = named.join(every, "column")
    rest = named.groupBy("column").agg((F.max("all") - F.sum("count")).alias("count"), (F.max("levels") - F.count(F.lit(1))).alias("others"), F.max("all").alias("all")).where("others > 0")
    rest = rest.select("column", F.concat(F.lit("(other "), F.col("others").cast("string"), F.lit(" levels)")).alias("level"), "count", "all")
    return named.select("column", "level", "count", "all").unionByName(rest).select("column", "level", "count", F.round(F.col("count") / F.col("all"), 4).alias("share"))


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    long = unpivoted(df, columns, "double")
    q = quantiles(long, ["column"], "value", [0.005, 0.25, 0.75, 0.995])
    iqr = F.col("q")[2] - F.col("q")[1]
    out = (F.col("value") < F.col("q")[1] - 1.5 * iqr) | (F.col("value") > F.col("q")[2] + 1.5 * iqr)
    beyond = (F.col("value") < F.col("q")[0]) | (F.col("value") > F.col("q")[3])
    joined = long.join(F.broadcast(q), "column")  # a row per column
    return joined.groupBy("column").agg(F.count_if(out).alias("iqr_outliers"), F.round(F.count_if(out) / F.count(F.lit(1)), 4).alias("iqr_share"), F.count_if(beyond).alias("beyond_tails"), F.round(F.max("value") / F.max(F.when(F.col("q")[3] > 0, F.col("q")[3])), 2).alias("max_over_tail"))


def correlations(df: DataFrame, columns: list[str], threshold: float | None = None) -> DataFrame:
    """Pearson, pairwise complete, of every pair in one pass; with a threshold the strong ones only."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.round(F.col(f"c{i}"), 4).alias("correlation")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
    return long if threshold is None else long.where(F.abs("correlation") >= threshold)


def target_rates(df: DataFrame, by: str, least: int = 50) -> DataFrame:
    """Default rate, events and median duration by segment."""
    g = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("(missing)")).alias(by)).agg(F.count(F.lit(1)).alias("loans"), F.sum("event").alias("events"), F.expr("percentile(duration_months, 0.5)").alias("median_duration"))
    return g.select(by, "loans", "events", F.round(F.col("events") / F.col("loans"), 4).alias("default_rate"), "median_duration", (F.col("loans") < least).alias("small_segment")).orderBy(F.desc("default_rate"), by)


def missing_by_year(df: DataFrame, families: dict[str, list[str]], year: str = "issue_year") -> DataFrame:
    """Mean share of missing values per year and family of columns."""
    shares = [F.round(sum(F.avg(F.col(c).isNull().cast("int")) for c in cols) / len(cols), 6).alias(name) for name, cols in families.items()]
    return df.groupBy(year).agg(*shares)


def breakdowns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, level, loans, event_rate, median_duration, admin_share) of several columns in one pass."""
    long = unpivoted(df, columns, "string", ["event", "outcome", "duration_months"])
    return long.groupBy(F.col("column").alias("dimension"), F.coalesce("value", F.lit("(missing)")).alias("level")).agg(F.count(F.lit(1)).alias("loans"), F.round(F.avg("event"), 6).alias("event_rate"), F.expr("percentile(duration_months, 0.5)").alias("median_duration"), F.round(F.avg((F.col("outcome") == "censored_admin").cast("int")), 6).alias("admin_share"))
