"""The fitted design matrix."""

import numpy as np
import pytest

from tidemark.operators import design

SCHEMA = "id long, a double, b double, state string, event int"


def rows(seed, n=3000, rare=2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        state = "ID" if i < 40 else rng.choice(["CA", "TX", "NV"])
        event = int(i < rare) if i < 40 else int(rng.random() < 0.8)
        out.append((i, None if i % 5 == 0 else float(rng.normal(3, 2)), float(rng.lognormal(1, 1)), None if i % 97 == 0 else str(state), event))
    return out


def frame(spark, *args, **kw):
    return spark.createDataFrame(rows(*args, **kw), SCHEMA)


def test_training_and_other_splits_get_the_same_columns(spark, tmp_path):
    made = design.fit_design(frame(spark, 1), ["a", "b", "c"], ["state"], ["a"])
    assert made.columns == ["a", "b", "a_missing", "state_NV", "state_TX"]
    assert made.dropped == {"c": "absent from input", "state_ID": "1 events in this level, fewer than 100; in the reference level"}
    made.save(spark, str(tmp_path / "design"))
    again = design.Design.load(spark, str(tmp_path / "design"))
    assert again == made
    other = again.encode(frame(spark, 2, n=500, rare=30).unionByName(spark.createDataFrame([(9999, float("nan"), None, "unseen", 0)], SCHEMA)), ["id"])
    assert other.columns == ["id", *made.columns]
    got = {r.id: r for r in other.collect()}
    data = {r[0]: r for r in rows(2, n=500, rare=30)}
    fill, mean, sd = made.numbers["a"]
    for i, r in got.items():
        a, state = (data[i][1], data[i][3]) if i in data else (None, "unseen")
        assert abs(r.a - ((fill if a is None else a) - mean) / sd) < 1e-9 and r.a_missing == float(a is None)
        assert (r.state_NV, r.state_TX) == (float(state == "NV"), float(state == "TX"))


def test_fitted_moments_are_the_training_rows(spark):
    made = design.fit_design(frame(spark, 3), ["a", "b"], [])
    a = np.array([r[1] for r in rows(3)], float)
    median = float(np.nanmedian(a))
    full = np.where(np.isnan(a), median, a)
    assert np.allclose(made.numbers["a"], (median, full.mean(), full.std(ddof=1)))
    x = np.array([r.a for r in made.encode(frame(spark, 3), []).collect()])
    assert abs(x.mean()) < 1e-9 and abs(x.std(ddof=1) - 1) < 1e-9


@pytest.mark.parametrize("least, total, pooled", [(100, 2000, True), (0, 2000, False), (100, 10**6, False)])
def test_pooling_needs_enough_events_to_judge(spark, least, total, pooled):
    made = design.fit_design(frame(spark, 4), ["a"], ["state"], least=least, total=total)
    assert ("state_ID" in made.dropped) == pooled and ("state_ID" in made.columns) != pooled


def test_constant_and_collinear_columns_are_named(spark):
    df = frame(spark, 5).selectExpr("*", "7.0 AS seven", "2 * b - a + 1 AS mix", "b * b AS square", "state AS copy", "CAST(NULL AS DOUBLE) AS none")
    made = design.fit_design(df.where("a IS NOT NULL"), ["a", "b", "seven", "mix", "square", "none"], ["state", "copy"], least=0)
    assert made.dropped == {"seven": "zero variance", "none": "zero variance", "mix": "explained by the columns before it", "copy_ID": "explained by the columns before it", "copy_NV": "explained by the columns before it", "copy_TX": "explained by the columns before it"}
    n, sums, products = design.gram(made.encode(df, []), made.columns)
    assert n == 3000 and design.collinear(n, sums, products) == []


def test_columns_of_many_levels_are_left_out(spark):
    df = frame(spark, 6).selectExpr("*", "CAST(id AS STRING) AS name")
    made = design.fit_design(df, [], ["name", "state"], most=10, least=0)
    assert made.dropped == {"name": "3000 levels, more than 10"} and made.columns == ["state_ID", "state_NV", "state_TX"]


def test_empty_training_split(spark):
    made = design.fit_design(spark.createDataFrame([], SCHEMA), ["a"], ["state"])
    assert made.columns == [] and made.encode(frame(spark, 7, n=3), ["id"]).count() == 3
