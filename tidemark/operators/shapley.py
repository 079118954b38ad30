"""Shapley attributions of survival predictions: kernel and linear forms, as jobs over rows; boosting.py has the tree form.

The kernel form takes any predict(matrix) -> (rows, times) and draws its coalitions once per run, by
the run's seed: every task solves the same small system for all its rows at once, and the result
doesn't depend on partitions. The background is a bounded set of rows on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Predictions made at once: rows by coalitions by background; of curves, whose arrays stay small enough for a core's cache.
_AT_ONCE, _CURVES_AT_ONCE = 400_000, 50_000


@dataclass
class Curve:
    """Survival of a logistic hazard in discrete time: it depends on a row by one number, offset + x @ weights.

    odds: of each period, by which exp(that number) is multiplied; ends: periods at which survival is
    wanted (0: the start); default: 1 - survival instead. As 1 - hazard is 1 / (1 + odds), a prediction
    takes one exponential and a product.
    """

    weights: np.ndarray
    offset: float
    odds: np.ndarray
    ends: list[int]
    default: bool = False

    def of(self, margin: np.ndarray) -> np.ndarray:
        """(rows, ends) of rows with this margin."""
        out = np.ones((len(self.ends), len(margin)))
        with np.errstate(over="ignore"):  # survival is 0 there
            u, product = np.exp(margin), np.ones(len(margin))
            for k in range(1, max(self.ends, default=0) + 1):
                product *= 1 + u * self.odds[k - 1]
                for j, end in enumerate(self.ends):
                    if end == k:
                        out[j] = 1 / product
        return (1 - out if self.default else out).T

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.of(self.offset + x @ self.weights)


def coalitions(p: int, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(which features each coalition has, weights). Sizes are taken whole from both ends while they fit in `samples` (sizes 1 and p - 1 always); the rest is drawn in complementary pairs."""
    share = {s: (p - 1) / (s * (p - s)) for s in range(1, p)}  # kernel weight of all coalitions of a size
    rows, weights, left, rng = [], [], max(samples, 2 * p), np.random.default_rng(seed)
    todo = [s for s in range(1, p // 2 + 1)]
    while todo:
        s = todo[0]
        sizes = {s, p - s}
        n = sum(comb(p, k) for k in sizes)
        if n > left and s > 1:
            break
        for k in sizes:
            for chosen in combinations(range(p), k):
                rows.append(np.isin(np.arange(p), chosen))
                weights.append(share[k] / comb(p, k))
        left -= n
        todo.pop(0)
    if todo and left > 1:
        rest = [k for s in todo for k in sorted({s, p - s})]
        chance = np.array([share[k] for k in rest])
        drawn = []
        for _ in range(left // 2):
            row = np.zeros(p, bool)
            row[rng.choice(p, rng.choice(rest, p=chance / chance.sum()), replace=False)] = True
            drawn += [row, ~row]
        rows += drawn
        weights += [chance.sum() / len(drawn)] * len(drawn)
    return np.array(rows, bool).reshape(-1, p), np.array(weights)


def kernel_values(x: np.ndarray, ground: np.ndarray, predict: Callable, z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phi: rows, features, times; base: times; prediction: rows, times) by weighted least squares, no penalty; attributions add up to prediction - base."""
    p, base = x.shape[1], predict(ground).mean(axis=0)
    prediction = predict(x)
    total = prediction - base
    if p == 1:
        return total[:, None], base, prediction
    curve = isinstance(predict, Curve)
    step, y = max(1, (_CURVES_AT_ONCE if curve else _AT_ONCE) // (len(z) * len(ground))), []
    rest = predict.offset + (~z * predict.weights) @ ground.T if curve else None
    for a in range(0, len(x), step):
        if curve:  # the margin of a mixed row is the sum of both sides' parts
            margin = (x[a : a + step] @ (z * predict.weights).T)[:, :, None] + rest[None]
            y.append(predict.of(margin.ravel()).reshape(-1, len(z), len(ground), total.shape[1]).mean(axis=2))
            continue
        mixed = np.where(z[None, :, None, :], x[a : a + step, None, None, :], ground[None, None])
        y.append(predict(mixed.reshape(-1, p)).reshape(-1, len(z), len(ground), total.shape[1]).mean(axis=2))
    y = np.concatenate(y) - base if y else np.zeros((0, len(z), total.shape[1]))
    root = np.sqrt(w)
    solve = np.linalg.pinv((z[:, :-1].astype(float) - z[:, -1:]) * root[:, None]) * root  # the last feature takes what the sum leaves
    front = np.einsum("jm,nmt->njt", solve, y - z[:, -1].astype(float)[None, :, None] * total[:, None])
    return np.concatenate([front, (total - front.sum(axis=1))[:, None]], axis=1), base, prediction


def kernel_shap(rows: DataFrame, ground: np.ndarray, features: list[str], predict: Callable, times: list[int], *, samples: int = 600, seed: int = 101) -> DataFrame:
    """(row_id, feature, t, phi, base, prediction): KernelSHAP of predict(matrix) -> (rows, times). With 2 ** p <= samples all coalitions are used and the values are exact."""
    z, w = coalitions(len(features), samples, seed)

    def explain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            phi, base, prediction = kernel_values(part.iloc[:, 1:].to_numpy(float), ground, predict, z, w)
            n, p, m = phi.shape
            yield pd.DataFrame({
                "row_id": np.repeat(part["row_id"].to_numpy(), p * m), "feature": np.tile(np.repeat(features, m), n), "t": np.tile(np.array(times, np.int32), n * p),
                "phi": phi.ravel(), "base": np.tile(base, n * p), "prediction": np.repeat(prediction, p, axis=0).ravel(),
            })

    return rows.select("row_id", *[F.col(f).cast("double") for f in features]).mapInPandas(explain, "row_id long, feature string, t int, phi double, base double, prediction double")


def kernel_areas(rows: DataFrame, ground: np.ndarray, features: list[str], predict: Callable, times: list[int], *, samples: int = 600, seed: int = 101) -> DataFrame:
    """(row_id, feature, area, signed): explain.row_areas of kernel_shap's attributions, made where these are, so that no row per time is shuffled."""
    z, w = coalitions(len(features), samples, seed)
    order = np.argsort(times)
    steps = np.diff(np.array(times, float)[order])

    def explain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            phi = kernel_values(part.iloc[:, 1:].to_numpy(float), ground, predict, z, w)[0][:, :, order]
            mean = lambda v: ((v[:, :, 1:] + v[:, :, :-1]) / 2 @ steps / steps.sum()).ravel() if steps.sum() else np.full(v.shape[0] * v.shape[1], np.nan)
            yield pd.DataFrame({"row_id": np.repeat(part["row_id"].to_numpy(), len(features)), "feature": np.tile(features, len(part)), "area": mean(np.abs(phi)), "signed": mean(-phi)})

    return rows.select("row_id", *[F.col(f).cast("double") for f in features]).mapInPandas(explain, "row_id long, feature string, area double, signed double")


def hazard_linear_shap(df: DataFrame, weights: dict[str, float], intercept: float, period: Callable, periods: int, keep: list[str]) -> DataFrame:
    """(keep..., feature, phi) of a logistic hazard with linear margin: minus the sum over periods of the row's own hazard times weight * (x - mean of x). period: number -> its part of the margin."""
    means = F.broadcast(df.agg(*[F.avg(f).alias(f"_a_{f}") for f in weights]))  # one row
    margin = F.lit(intercept) + sum((F.col(f) * float(w) for f, w in weights.items()), F.lit(0.0))
    hazard = sum((1 / (1 + F.exp(-(margin + period(k)))) for k in range(1, periods + 1)), F.lit(0.0))
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), (-F.col("_h") * float(w) * (F.col(f) - F.col(f"_a_{f}"))).alias("phi")) for f, w in weights.items()])
    return df.crossJoin(means).withColumn("_h", hazard).select(*keep, F.explode(parts).alias("x")).select(*keep, "x.feature", "x.phi")
