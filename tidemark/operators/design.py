"""Derived features and design matrices: what to compute from what is there, and how to encode it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators.profile import unpivoted
from tidemark.operators.ranks import quantiles
from tidemark.sources.shipping import ship


class Rule(NamedTuple):
    feature: str
    needs: tuple[str, ...]
    make: Callable[..., Column]


RULES = (
    Rule("term_months", ("term",), parse.term_months),
    Rule("fico_range_high", ("fico_range_low",), lambda low: low + 4),
    Rule("installment", ("loan_amnt", "int_rate", "term_months"), parse.instalment),
    Rule("fico_midpoint", ("fico_range_low", "fico_range_high"), lambda low, high: (low + high) / 2),
    Rule("loan_to_income", ("loan_amnt", "annual_inc"), parse.ratio),
    Rule("installment_to_income", ("installment", "annual_inc"), lambda p, i: parse.ratio(p, i / 12)),
    Rule("emp_length_years", ("emp_length",), parse.employment_years),
    Rule("log_annual_inc", ("annual_inc",), lambda i: F.when(i.isNotNull(), F.log1p(F.greatest(i, F.lit(0.0))))),
)


def derive(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, dict[str, str]]:
    """Adds every feature whose needs are there, or can be derived first; (frame, feature -> what it lacks).

    Expressions only: nothing is computed here. A derived column may still be null in every row, which
    `empty_columns` tells.
    """
    have, todo = set(df.columns), [r for r in rules if r.feature not in df.columns]
    while ready := [r for r in todo if have.issuperset(r.needs)]:
        df = df.withColumns({r.feature: r.make(*map(F.col, r.needs)) for r in ready})
        have |= {r.feature for r in ready}
        todo = [r for r in todo if r.feature not in have]
    return df, {r.feature: ", ".join(sorted(set(r.needs) - have)) for r in todo}


def closure(wanted: list[str], rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The columns to read so that all wanted features are there or derivable."""
    by, todo, out = {r.feature: r for r in rules}, list(wanted), []
    while todo:
        c = todo.pop(0)
        if c not in out:
            out.append(c)
            todo += by[c].needs if c in by else ()
    return out


def empty_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled): 0 filled means that a derivation gave nothing."""
    return unpivoted(df, columns, "string").groupBy("column").agg(F.count("value").alias("filled"))


def stand_ins(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(column, missing_rate, stand_in): the median, or the most frequent level (ties by level), as text."""
    rate = F.round(F.avg(F.col("value").isNull().cast("int")), 6).alias("missing_rate")
    long = unpivoted(df, numeric, "double")
    n = long.groupBy("column").agg(rate).join(quantiles(long, ["column"], "value", [0.5]), "column", "left").select("column", "missing_rate", F.format_string("%.4f", F.col("q")[0]).alias("stand_in"))
    counts = unpivoted(df, categorical, "string").groupBy("column", "value").count()
    c = counts.groupBy("column").agg(F.round(F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)) / F.sum("count"), 6).alias("missing_rate"), F.min_by("value", F.struct(F.when(F.col("value").isNotNull(), -F.col("count")).otherwise(1), F.col("value"))).alias("stand_in"))
    return n.unionByName(c)


def pooled_levels(df: DataFrame, column: str, least: int = 100, total: int = 2000) -> DataFrame:
    """(level, events, pooled): levels with fewer events than `least` join the reference, unless all events are fewer than `total`."""
    g = df.groupBy(F.coalesce(F.col(column), F.lit("(missing)")).alias("level")).agg(F.sum("event").alias("events"))
    every = F.broadcast(g.agg(F.sum("events").alias("_e")))  # one row
    return g.crossJoin(every).select("level", "events", ((F.col("_e") >= total) & (F.col("events") < least)).alias("pooled"))


def one_hot(df: DataFrame, column: str, levels: list[str], keep: list[str]) -> DataFrame:
    """A 0/1 column per level but the first, which is the reference; unseen and missing levels are all 0."""
    return df.select(*keep, *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in levels[1:]])


#: Events below which a level joins the reference, and below which no level is judged.
LEVEL_EVENTS, ALL_EVENTS = 100, 2000


@dataclass
class Design:
    """A fitted encoding: what a split is filled, scaled and spread by, whatever its own rows are.

    numbers: column -> (fill, mean, deviation); flags: columns with a missing indicator; levels: column
    -> its levels with a column of their own (the reference and pooled levels have none); columns: the
    matrix's columns in order; dropped: column -> why it isn't there.
    """

    numbers: dict[str, tuple[float, float, float]]
    flags: list[str]
    levels: dict[str, list[str]]
    columns: list[str]
    dropped: dict[str, str]

    def expressions(self) -> dict[str, Column]:
        out = {}
        for c, (fill, mean, sd) in self.numbers.items():
            out[c] = (F.coalesce(_number(c), F.lit(fill)) - mean) / sd
        for c in self.flags:
            out[f"{c}_missing"] = F.isnull(_number(c)).cast("double")
        for c, levels in self.levels.items():
            out |= {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for v in levels}
        return out

    def encode(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep and exactly the fitted columns, none of them null; unseen and missing levels are the reference."""
        made = self.expressions()
        return df.select(*keep, *[made[c].alias(c) for c in self.columns])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Design:
        made = json.loads(spark.read.text(path).first()[0])
        return cls(**{**made, "numbers": {c: tuple(v) for c, v in made["numbers"].items()}})


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def gram(df: DataFrame, columns: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, sums, sums of products) of the columns: a packed array a task, added up; what reaches the driver is columns by columns."""
    ship(df.sparkSession)
    p = len(columns)

    def pack(batches):
        total = np.zeros(1 + p + p * p)
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([i for i in range(len(total))], pa.int32()), pa.array(total)], names=["i", "v"])

    sums = df.select(*[F.col(f"`{c}`").cast("double") for c in columns]).mapInArrow(pack, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(1 + p + p * p)
    for r in sums:
        total[r.i] = r.v
    return total[0], total[1 : 1 + p], total[1 + p :].reshape(p, p)


def collinear(n: float, sums: np.ndarray, products: np.ndarray, tolerance: float = 1e-8) -> list[int]:
    """Columns that the ones before them explain, a constant among them: Cholesky of the correlations, column by column."""
    cov = products / n - np.outer(sums, sums) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    r, found, kept = cov / np.outer(sd, sd), [], []
    low = np.zeros((len(sums), len(sums)))
    for j in range(len(sums)):
        for m, k in enumerate(kept):
            low[j, m] = (r[j, k] - low[j, :m] @ low[k, :m]) / low[k, m]
        rest = r[j, j] - low[j, : len(kept)] @ low[j, : len(kept)]
        if rest > tolerance:
            low[j, len(kept)] = np.sqrt(rest)
            kept.append(j)
        else:
            found.append(j)
    return found


def fit_design(df: DataFrame, numeric: list[str], categorical: list[str], structural: list[str] = [], *, event: str = "event", most: int = 60, least: int = LEVEL_EVENTS, total: int = ALL_EVENTS) -> Design:  # noqa: B006
    """Learns the encoding from the training rows.

    Numbers: the median for gaps, then mean 0 and deviation 1. Levels: a column each but the first by
    name, which is the reference; levels with fewer than `least` events join it, unless all events are
    fewer than `total`; a column of more than `most` levels is left out. Columns without variance and
    columns that others before them explain are named and left out.
    """
    dropped = {c: "absent from input" for c in [*numeric, *categorical] if c not in df.columns}
    numeric, categorical = [c for c in numeric if c not in dropped], [c for c in categorical if c not in dropped]
    long = unpivoted(df.select(*[_number(c).alias(c) for c in numeric]), numeric, "double") if numeric else None
    fills = {r["column"]: r["q"][0] for r in quantiles(long, ["column"], "value", [0.5]).collect()} if numeric else {}
    filled = [F.coalesce(_number(c), F.lit(fills.get(c, 0.0))) for c in numeric]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(event), F.lit(0)).alias("e"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)], *[F.stddev_samp(x).alias(f"s{i}") for i, x in enumerate(filled)]).first()
    numbers = {}
    for i, c in enumerate(numeric):
        sd = row[f"s{i}"] or 0.0
        numbers[c] = (float(fills.get(c, 0.0)), float(row[f"m{i}"] or 0.0), float(sd) if sd > 1e-12 else 1.0)
        if sd <= 1e-12:
            dropped[c] = "zero variance"
    levels: dict[str, list[str]] = {}
    if categorical:
        counts = unpivoted(df, categorical, "string", [event]).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("e"))
        sizes = {r["column"]: r["k"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
        dropped |= {c: f"{k} levels, more than {most}" for c, k in sizes.items() if k > most}
        for r in counts.where(F.col("column").isin([c for c, k in sizes.items() if k <= most])).orderBy("column", "value").collect():  # `most` rows a column
            levels.setdefault(r["column"], []).append(r["value"])
            if len(levels[r["column"]]) > 1:
                if r["n"] == row["n"]:
                    dropped[f"{r['column']}_{r['value']}"] = "zero variance"
                elif least and row["e"] >= total and r["e"] < least:
                    dropped[f"{r['column']}_{r['value']}"] = f"{r['e']} events in this level, fewer than {least}; in the reference level"
        levels = {c: [v for v in levels.get(c, [])[1:] if f"{c}_{v}" not in dropped] for c in categorical if c not in dropped}
    design = Design(numbers, [c for c in structural if c in numbers], levels, [], dropped)
    columns = [c for c in design.expressions() if c not in dropped]
    if columns:
        design.columns = columns
        n, sums, products = gram(design.encode(df, []), columns)
        if n:
            for j in collinear(n, sums, products):
                constant = products[j, j] / n - (sums[j] / n) ** 2 <= 1e-12
                dropped[columns[j]] = "zero variance" if constant else "explained by the columns before it"
    design.columns = [c for c in columns if c not in dropped]
    return design


#: Bars of the cost tiers.
REQUIRED_DROP, COSTED_DROP, LEARNED_FROM = 0.010, 0.002, 0.01


def cost_tiers(costs: DataFrame, structural: list[str]) -> DataFrame:
    """costs: (feature, drop, train_missing). Adds tier: what an upload without the feature loses."""
    d = F.col("drop")
    tier = F.when(d.isNull(), "unmeasured").when(d >= REQUIRED_DROP, "required").when((F.col("train_missing") < LEARNED_FROM) & ~F.col("feature").isin(*structural), "unlearned").when(d >= COSTED_DROP, "costed").otherwise("free")
    return costs.withColumn("tier", tier)
