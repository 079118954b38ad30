"""Cox regression by Newton's method; ties are Efron's.

A step is one job: each task sums the moments of its rows by month in numpy, one packed array a month,
and these arrays are added by month. What reaches the driver is months by features squared, whatever
the number of loans, and no array of the driver is as long as a month's events: sums over tied events
are integrals with their end corrections.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shipping import ship

#: Tied events that are summed one by one; more are integrated in parts over which the terms change by a factor of two at most.
ONE_BY_ONE = 4096
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def tie_sums(s0: float, e0: float, d: int) -> np.ndarray:
    """Sums over k < d, with c = k / d and a = s0 - c e0, of 1 / a, c / a, 1 / a^2, c / a^2, c^2 / a^2 and log a."""

    def terms(k: np.ndarray) -> np.ndarray:
        c = k / d
        w = 1 / (s0 - c * e0)
        return np.stack([w, c * w, w * w, c * w * w, c * c * w * w, -np.log(w)])

    def slopes(k: np.ndarray) -> np.ndarray:
        c, q = k / d, e0 / d
        w = 1 / (s0 - c * e0)
        return np.stack([q * w**2, w / d + c * q * w**2, 2 * q * w**3, w**2 / d + 2 * c * q * w**3, 2 * c * w**2 / d + 2 * c**2 * q * w**3, -q * w])

    total, a = np.zeros(6), 0
    while d - a > ONE_BY_ONE:  # the next part ends where s0 - c e0 has halved, or short of the last events
        z = min(d - ONE_BY_ONE // 2, a + max(ONE_BY_ONE // 2, int((s0 / e0 * d - a) / 2) if e0 > 0 else d))
        half = (z - a) / 2
        ends = np.array([a, z], float)
        total += (terms(a + half * (1 + _NODES)) * _WEIGHTS).sum(axis=1) * half
        total += (terms(ends) @ [1, -1]) / 2 + (slopes(ends) @ [-1, 1]) / 12
        a = z
    return total + terms(np.arange(a, d, dtype=float)).sum(axis=1)


@dataclass
class Month:
    """Of one month: events, their features' sum, the sums over ties, and the moments of the risk set and of the events."""

    month: int
    d: int
    x: np.ndarray
    s0: float
    s1: np.ndarray
    e0: float
    e1: np.ndarray
    ties: np.ndarray

    @property
    def expected(self) -> np.ndarray:
        """The sum of the risk set's mean features over the month's events."""
        return self.s1 * self.ties[0] - self.e1 * self.ties[1]


@dataclass
class CoxModel:
    features: list[str]
    beta: np.ndarray
    variance: np.ndarray
    baseline: list[tuple[int, float]]
    converged: bool
    steps: int
    log_likelihood: float
    months: list[Month] = field(default_factory=list)

    def risk(self) -> Column:
        """The linear predictor."""
        return sum((F.col(f) * float(b) for f, b in zip(self.features, self.beta)), F.lit(0.0))


def _moments(df: DataFrame, features: list[str], beta: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Per month, the last first: sums of w, w x, w x x' of all rows, then of the events, then the events' number and x; w = exp(beta x)."""
    p, b = len(features), np.array(beta)

    def pack(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            month, event = batch.column(0).to_numpy(), batch.column(1).to_numpy() == 1
            x = np.stack([batch.column(2 + i).to_numpy() for i in range(p)], axis=1) if p else np.zeros((len(month), 0))
            w = np.exp(x @ b)
            for m in np.unique(month):
                here = month == m
                parts = []
                for own in (here, here & event):
                    wx = x[own] * w[own, None]
                    parts += [[w[own].sum()], wx.sum(axis=0), (x[own].T @ wx).ravel()]
                row = np.concatenate([*parts, [(here & event).sum()], x[here & event].sum(axis=0)])
                found[int(m)] = found[int(m)] + row if int(m) in found else row
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], names=["month", "sums"])

    def add(key, table):
        total = np.sum([v for v in table.column("sums").to_pylist()], axis=0)
        return pa.table({"month": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    rows = df.select(F.col("duration_months").cast("int"), F.col("event").cast("int"), *[F.col(f).cast("double") for f in features])
    kind = "month int, sums array<double>"
    return sorted(((r.month, np.array(r.sums)) for r in rows.mapInArrow(pack, kind).groupBy("month").applyInArrow(add, kind).collect()), reverse=True)  # a row per month


def _likelihood(moments: list, beta: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray, list[Month]]:
    """(penalised log-likelihood, gradient, negative hessian, months with events, the last first)."""
    p = len(beta)
    value, gradient, hessian = -ridge * float(beta @ beta) / 2, -ridge * beta, ridge * np.eye(p)
    total, months = np.zeros(1 + p + p * p), []
    for month, v in moments:
        k = 1 + p + p * p
        total = total + v[:k]
        d = round(v[2 * k])
        if not d:
            continue
        own, x = v[k : 2 * k], v[2 * k + 1 :]
        s0, s1, s2 = total[0], total[1 : 1 + p], total[1 + p :].reshape(p, p)
        e0, e1, e2 = own[0], own[1 : 1 + p], own[1 + p :].reshape(p, p)
        t = tie_sums(s0, e0, d)
        m = Month(month, d, x, s0, s1, e0, e1, t)
        value += float(x @ beta) - t[5]
        gradient = gradient + x - m.expected
        cross = np.outer(s1, e1)
        hessian = hessian + s2 * t[0] - e2 * t[1] - (np.outer(s1, s1) * t[2] - (cross + cross.T) * t[3] + np.outer(e1, e1) * t[4])
        months.append(m)
    return value, gradient, hessian, months


def fit_cox(df: DataFrame, features: list[str], *, ridge: float = 0.05, steps: int = 25, tolerance: float = 1e-7) -> CoxModel:
    """Newton's method on the penalised partial likelihood; features should be standardised and complete.

    A step that does not raise the likelihood is halved. converged: the last step was below the tolerance.
    """
    ship(df.sparkSession)
    p = len(features)
    df = df.select("duration_months", "event", *features)
    beta, move = np.zeros(p), np.zeros(p)
    value, gradient, hessian, months = _likelihood(_moments(df, features, beta), beta, ridge)
    converged, taken = p == 0, 0
    while taken < steps and not converged:
        move = np.linalg.solve(hessian, gradient)
        for _ in range(20):
            taken += 1
            new = _likelihood(_moments(df, features, beta + move), beta + move, ridge)
            if np.isfinite(new[0]) and new[0] >= value - 1e-9 * abs(value):
                beta, (value, gradient, hessian, months) = beta + move, new
                break
            move = move / 2
        else:
            break
        converged = bool(np.abs(move).max() < tolerance)
    total, baseline = 0.0, []
    for m in reversed(months):
        total += m.ties[0]
        baseline.append((m.month, float(total)))
    return CoxModel(features, beta, np.linalg.inv(hessian), baseline, converged, taken, value, months)


def p_value(z: float) -> float:
    """Of a standard normal, two-sided."""
    return erfc(abs(z) / sqrt(2))


def cox_table(spark, model: CoxModel) -> DataFrame:
    """(feature, coef, hazard_ratio, se, low, high, z, p), by size of the coefficient."""
    rows = []
    for f, b, s in zip(model.features, model.beta, np.sqrt(np.diag(model.variance))):
        b, s = float(b), float(s)
        rows.append((f, b, float(np.exp(b)), s, b - 1.96 * s, b + 1.96 * s, b / s, p_value(b / s)))
    rows.sort(key=lambda r: -abs(r[1]))
    return spark.createDataFrame(rows, "feature string, coef double, hazard_ratio double, se double, low double, high double, z double, p double")


def cox_survival(df: DataFrame, model: CoxModel, times: list[int], keep: list[str]) -> DataFrame:
    """(keep..., t, survival) from the cumulative baseline hazard."""
    at = [(t, max([h for m, h in model.baseline if m <= t], default=0.0)) for t in times]
    grid = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(h).alias("h")) for t, h in at])
    return df.select(*keep, model.risk().alias("_r"), F.explode(grid).alias("g")).select(*keep, "g.t", F.exp(-F.col("g.h") * F.exp("_r")).alias("survival"))


def proportional(spark, model: CoxModel, limit: float = 0.01) -> DataFrame:
    """(feature, statistic, p, violated): scaled Schoenfeld residuals against the rank of the event's time, chi-square with one degree of freedom.

    Ranks of tied events are averaged and means are Efron's. Residuals are summed by month, which the
    last step of the fit has, so no row is read again.
    """
    months, n = sorted(model.months, key=lambda m: m.month), sum(m.d for m in model.months)
    before = np.cumsum([0, *(m.d for m in months)])[:-1]
    rank = np.array([b + (m.d + 1) / 2 for b, m in zip(before, months)])
    ranks = rank - (n + 1) / 2
    spread = float(sum(m.d * r * r for m, r in zip(months, ranks)))
    along = sum((r * (m.x - m.expected) for m, r in zip(months, ranks)), np.zeros(len(model.features)))
    rows = []
    for i, f in enumerate(model.features):
        scaled = n * float(model.variance[i] @ along)
        statistic = scaled**2 / (n * float(model.variance[i, i]) * spread) if spread else 0.0
        p = erfc(sqrt(statistic / 2))
        rows.append((f, statistic, p, p < limit))
    return spark.createDataFrame(rows, "feature string, statistic double, p double, violated boolean")
