"""Cox regression with ties, its likelihood and its proportional-hazards test, against numpy over every loan."""

from math import erfc, sqrt

import numpy as np
import pytest

from tidemark.operators import cox


def table(spark, x, t, e):
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(*map(float, r), int(d), int(v)) for r, d, v in zip(x, t, e)], ", ".join(f"{n} double" for n in names) + ", duration_months int, event int").repartition(5), names


def plain_fit(x, t, e, ridge=0.05, steps=40):
    """Efron by its definition: (beta, information, [(month, events, sum of x, sum of means)], log-likelihood)."""
    p = x.shape[1]
    beta = np.zeros(p)
    for _ in range(steps):
        g, h, months, value = -ridge * beta, ridge * np.eye(p), [], -ridge * beta @ beta / 2
        w = np.exp(x @ beta)
        for month in np.unique(t[e == 1]):
            risk, dead = t >= month, (t == month) & (e == 1)
            d, means = dead.sum(), np.zeros(p)
            for k in range(d):
                weight = w * risk - k / d * w * dead
                a = weight.sum()
                m = weight @ x / a
                means += m
                value -= np.log(a)
                h = h + (x.T * weight) @ x / a - np.outer(m, m)
            g = g + x[dead].sum(axis=0) - means
            value += (x[dead] @ beta).sum()
            months.append((month, d, x[dead].sum(axis=0), means))
        beta = beta + np.linalg.solve(h, g)
    return beta, h, months, value


def plain_test(beta, h, months):
    """Grambsch and Therneau's statistic on ranks, event by event."""
    v, n = np.linalg.inv(h), sum(m[1] for m in months)
    g, r, at = [], [], 0
    for _, d, x, means in months:
        g += [at + (d + 1) / 2] * d
        r += [(x - means) / d] * d
        at += d
    g = np.array(g) - np.mean(g)
    scaled = n * np.array(r) @ v
    return (g @ scaled) ** 2 / (n * np.diag(v) * (g @ g))


def data(seed, n=400, p=3, months=9, crossing=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    rate = 0.1 * np.exp(0.6 * x[:, 0] - 0.4 * x[:, 1])
    t = rng.exponential(1 / rate)
    if crossing:  # the effect of x0 turns round after the fourth month
        early = rng.exponential(1 / (0.1 * np.exp(1.5 * x[:, 0])))
        late = 4 + rng.exponential(1 / (0.3 * np.exp(-1.5 * x[:, 0])))
        t = np.where(early < 4, early, late)
    return x, np.minimum(np.ceil(t), months), (t <= months).astype(int)


def test_fit_with_ties_equals_its_definition(spark):
    x, t, e = data(1)
    df, names = table(spark, x, t, e)
    model = cox.fit_cox(df, names)
    beta, h, months, value = plain_fit(x, t, e)
    assert np.abs(model.beta - beta).max() < 1e-7 and np.abs(model.variance - np.linalg.inv(h)).max() < 1e-8
    assert model.converged and abs(model.log_likelihood - value) < 1e-6
    for r in cox.cox_table(spark, model).collect():
        assert abs(r.p - erfc(abs(r.z) / sqrt(2))) < 1e-12 and abs(r.z - r.coef / r.se) < 1e-12
    statistic = plain_test(beta, h, months)
    got = {r.feature: r for r in cox.proportional(spark, model).collect()}
    assert all(abs(got[n].statistic - s) < 1e-6 and abs(got[n].p - erfc(sqrt(s / 2))) < 1e-7 for n, s in zip(names, statistic))


def test_crossing_hazards_are_found_and_proportional_ones_are_not(spark):
    df, names = table(spark, *data(2, n=1500))
    assert not any(r.violated for r in cox.proportional(spark, cox.fit_cox(df, names)).collect())
    df, names = table(spark, *data(3, n=1500, crossing=True))
    assert [r.feature for r in cox.proportional(spark, cox.fit_cox(df, names)).collect() if r.violated] == ["x0"]


@pytest.mark.parametrize("s0, e0, d", [(50.0, 20.0, 7), (1e6, 999_999.5, 900_000), (1e6, 1e6, 500_000), (1e6, 10.0, 300_000), (3e5, 2e5, 200_000), (1e6, 0.0, 50_000)])
def test_sums_over_many_ties(s0, e0, d):
    c = np.arange(d) / d
    w = 1 / (s0 - c * e0)
    want = [w.sum(), (c * w).sum(), (w * w).sum(), (c * w * w).sum(), (c * c * w * w).sum(), -np.log(w).sum()]
    assert np.allclose(cox.tie_sums(s0, e0, d), want, rtol=1e-11)


def test_a_fit_that_was_stopped_says_so(spark):
    df, names = table(spark, *data(4))
    assert not cox.fit_cox(df, names, steps=1).converged
    apart = np.array([[-1.0]] * 30 + [[1.0]] * 30)  # separated: no finite maximum without a penalty
    df, names = table(spark, apart, np.array([9] * 30 + list(range(1, 9)) * 3 + [1] * 6), np.array([0] * 30 + [1] * 30))
    free = cox.fit_cox(df, names, ridge=1e-9, steps=6)
    assert not free.converged and free.beta[0] > 3 and np.isfinite(free.log_likelihood)
    assert cox.fit_cox(df, names, ridge=0.5).converged


def test_no_events_and_no_features(spark):
    df, names = table(spark, np.ones((5, 1)), np.arange(1, 6), np.zeros(5))
    model = cox.fit_cox(df, names)
    assert model.beta.tolist() == [0.0] and model.baseline == [] and cox.proportional(spark, model).first().statistic == 0.0
