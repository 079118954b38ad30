"""Models: discrete-time hazard, separability, background clusters; boosting.py has trees, cox.py Cox regression.

The hazard model here is a logistic regression of Spark ML over person-period rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import unpivoted
from tidemark.operators.ranks import quantiles
from tidemark.operators.shapley import Curve
from tidemark.operators.survival import person_period
from tidemark.sources.store import stored


def standardised(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Medians for missing values, then mean 0 and deviation 1 as learned on `fit_on`; constant columns become 0. One row is learned. What is learned from is stored, as medians, moments and the rows themselves each read it."""
    source = stored(df if fit_on is None else fit_on)
    df = source if fit_on is None else df
    medians = {r["column"]: r["q"][0] for r in quantiles(unpivoted(source, columns, "double"), ["column"], "value", [0.5]).collect()}  # a row per column
    stats = source.sparkSession.range(1).select(*[F.lit(medians.get(c)).cast("double").alias(f"_m_{c}") for c in columns])
    filled = source.crossJoin(F.broadcast(stats))
    moments = filled.agg(*[f(F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"))).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(moments))
    scaled = {c: F.when(F.col(f"_s_{c}") > 1e-12, (F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) - F.col(f"_a_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return out.withColumns(scaled).drop(*[c for c in out.columns if c.startswith(("_m_", "_a_", "_s_"))])


@dataclass
class HazardModel:
    model: object
    features: list[str]
    months: int

    def survival(self, times: list[int], default: bool = False) -> Curve:
        """A numpy function (matrix of features) -> (rows, times) of survival, or of 1 - survival; it runs in tasks and holds the coefficients only."""
        w, b = np.array(self.model.coefficients.toArray()), float(self.model.intercept)
        ends = [max(0, -(-t // self.months)) for t in times]
        k = np.arange(1, max(ends, default=0) + 1)
        return Curve(w[:-2], b, np.exp(np.log1p(k) * w[-2] + k / 12 * w[-1]), ends, default)

    def hazards(self, df: DataFrame, periods: int, keep: list[str]) -> DataFrame:
        """(keep..., period, hazard) for each row and period up to `periods`."""
        rows = df.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
        scored = self.model.transform(_assembled(rows, self.features))
        return scored.select(*keep, "period", vector_to_array("probability")[1].alias("hazard"))


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    rows = rows.withColumns({"_p1": F.log1p(F.col("period").cast("double")), "_p2": F.col("period").cast("double") / 12})
    return VectorAssembler(inputCols=[*features, "_p1", "_p2"], outputCol="features").transform(rows)


def fit_hazard(df: DataFrame, features: list[str], *, months: int = 3, horizon: int = 36, weight: str | None = None) -> HazardModel:
    """P(default in this period | alive before it) from the features and the period; weight: a column of loan weights."""
    rows = person_period(df, months=months, horizon=horizon, columns=["id", *features, *([weight] if weight else [])])
    if weight:
        rows = rows.withColumn("weight", F.col("weight") * F.col(weight))
    data = _assembled(rows, features).withColumn("label", F.col("y").cast("double"))
    return HazardModel(LogisticRegression(regParam=1e-4, weightCol="weight", maxIter=50).fit(data), features, months)


def fit_propensity(df: DataFrame, features: list[str], label: Column) -> tuple[DataFrame, list[tuple[str, float]]]:
    """The rows with propensity, the probability of `label` by logistic regression on standardised features, fitted on all rows; and (feature, coefficient), the largest first."""
    data = VectorAssembler(inputCols=features, outputCol="features").transform(standardised(df, features).withColumn("label", label.cast("double")))
    model = LogisticRegression(regParam=1e-4, maxIter=50).fit(data)
    scored = model.transform(data).withColumn("propensity", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    return scored, sorted(zip(features, map(float, model.coefficients)), key=lambda r: (-abs(r[1]), r[0]))


def propensity(df: DataFrame, features: list[str], label: Column) -> DataFrame:
    """The rows of fit_propensity."""
    return fit_propensity(df, features, label)[0]


def background(df: DataFrame, numeric: list[str], categorical: list[str], k: int, seed: int = 1) -> DataFrame:
    """(cluster, n, numeric..., categorical...): k-means on standardised numbers with medians for gaps; each cluster's medians (null where the cluster has no value) and most frequent levels (ties by level)."""
    scaled = standardised(df.select("*", *[F.col(c).alias(f"_z_{c}") for c in numeric]), [f"_z_{c}" for c in numeric])
    data = VectorAssembler(inputCols=[f"_z_{c}" for c in numeric], outputCol="_z").transform(scaled)
    rows = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster").fit(data).transform(data).select("cluster", *numeric, *categorical)
    rows = stored(rows)
    medians = quantiles(unpivoted(rows, numeric, "double", ["cluster"]), ["cluster", "column"], "value", [0.5])
    wide = medians.groupBy("cluster").agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(c) for c in numeric])
    out = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(wide, "cluster", "left")
    for c in categorical:
        counts = rows.where(F.col(c).isNotNull()).groupBy("cluster", c).count()
        out = out.join(counts.groupBy("cluster").agg(F.min_by(c, F.struct(-F.col("count"), F.col(c))).alias(c)), "cluster", "left")
    return out


#: How near to chance a concordance, and how large a coefficient, means a failed fit.
CHANCE_BAND, MOST_COEFFICIENT = 0.02, 10.0


def fit_guard(table: DataFrame) -> DataFrame:
    """table: (model, concordance, largest_coefficient), one row a fit. Adds problem: not_a_number, no_better_than_chance, runaway_coefficient, or null for a sound fit."""
    c = F.col("concordance")
    problem = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "not_a_number").when(F.abs(c - 0.5) <= CHANCE_BAND, "no_better_than_chance").when(F.abs("largest_coefficient") > MOST_COEFFICIENT, "runaway_coefficient")
    return table.withColumn("problem", problem)
