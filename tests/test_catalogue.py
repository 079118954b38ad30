"""Every registered query with an oracle gives the oracle's rows on the small tables."""

import os
from math import erfc, sqrt

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the small tables are not here")


def _rows(df: pd.DataFrame) -> list:
    df = df.reindex(sorted(df.columns), axis=1)
    text = lambda v: "NULL" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return [list(df.columns), *sorted([text(v) for v in r] for r in df.itertuples(index=False))]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_oracle(spark, oracle, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert _rows(got) == _rows(oracle.sql(entry.oracle_sql()[name]).df())


def _sums(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def _adds_up(rows):
    """Attributions of a row and time add up to prediction - base."""
    groups = _sums(rows, lambda r: (r.row_id, r.t)).values()
    return len(groups) > 1000 and all(len(g) == 6 and abs(g[0].base + sum(r.phi for r in g) - g[0].prediction) < 1e-9 and 0 <= g[0].prediction <= 1 for g in groups)


#: What the rows of queries without an oracle must hold; their operators are held against brute force in test_semantics.py.
HOLDS = {
    "hazard_fit": lambda rows: len(rows) == 10 and sum(r.n for r in rows) > 1000 and all(0 < r.predicted_survival < 1 and abs(r.error) < 0.15 for r in rows),
    "hazard_trees_importance": lambda rows: len(rows) == 8 and abs(sum(r.gain for r in rows) - 1) < 1e-6 and all((r.gain > 0) == (r.splits > 0) for r in rows) and [r.gain for r in rows] == sorted((r.gain for r in rows), reverse=True),
    "hazard_boosting": lambda rows: [r.trees for r in rows] == list(range(len(rows))) and (loss := [r.train_loss for r in rows if r.kept]) == sorted(loss, reverse=True) and min(rows, key=lambda r: r.valid_loss).trees == sum(r.kept for r in rows) - 1,
    "hazard_trees_survival": lambda rows: len(rows) == 10 and (n := sum(r.n for r in rows)) > 1000 and all(0 < r.predicted_survival <= 1 for r in rows) and abs(sum(r.n * r.error for r in rows)) / n < 0.03 and sum(r.n * abs(r.error) for r in rows) / n < 0.08 and rows[-1].observed_survival - rows[0].observed_survival > 0.1,
    "cox_fit": lambda rows: len(rows) == 3 and all(r.low < r.coef < r.high and abs(r.z - r.coef / r.se) < 1e-9 and abs(r.coef) < 1 and abs(r.p - erfc(abs(r.z) / sqrt(2))) < 1e-12 for r in rows),
    "cox_survival": lambda rows: [r.t for r in sorted(rows)] == [6, 12, 24, 36] and all(1 >= r.most >= r.mean_survival >= r.least > 0 for r in rows) and sorted((r.mean_survival for r in rows), reverse=True) == [r.mean_survival for r in sorted(rows, key=lambda r: r.t)],
    "cox_ph_test": lambda rows: len(rows) == 3 and all(r.statistic >= 0 and abs(r.p - erfc(sqrt(r.statistic / 2))) < 1e-12 and r.violated == (r.p < 0.01) for r in rows),
    "separability": lambda rows: len(rows) == 1 and 0.5 <= rows[0].rank_auc <= 1 and rows[0].low < rows[0].high and 0 <= rows[0].share_in_support <= 1,
    "ablation": lambda rows: (v := {r.dropped: r for r in rows}) and v["(none)"].concordance_drop == v["(none)"].auc_drop == 0 and v["(all)"].concordance == v["(all)"].auc == 0.5 and v["(none)"].concordance > 0.5 and len(v) == 6,
    "ablation_missing": lambda rows: (v := {r.dropped: r for r in rows}) and v["(none)"].concordance_drop == v["(none)"].auc_drop == 0 and v["(all)"].concordance == v["(all)"].auc == 0.5 and v["(none)"].concordance > 0.55 and len(v) == 7 and sum(r.concordance_drop for r in rows) > 0,
    "background_summary": lambda rows: len(rows) == 50 and all(r.n > 0 and r.purpose for r in rows) and any(r.mths_since_delinq is None or r.mths_since_delinq >= 0 for r in rows),
    "separability_coefficients": lambda rows: sorted(r.feature for r in rows) == ["annual_inc", "dti", "loan_amnt"] and [abs(r.coefficient) for r in rows] == sorted((abs(r.coefficient) for r in rows), reverse=True),
    "survshap": lambda rows: _adds_up(rows) and {r.t for r in rows} == {6, 12, 24, 36},
    "naive_shap": lambda rows: _adds_up(rows) and {r.t for r in rows} == {36},
    "noise_floor": lambda rows: len(rows) == 1 and 0.5 <= rows[0].spearman <= 1 and 0 <= rows[0].mean_relative_gap < 0.5 and rows[0].top10_jaccard == 1,
    "tree_shap": lambda rows: all(len(g) == 7 for g in _sums(rows, lambda r: r.row_id).values()) and any(r.phi < 0 for r in rows) and any(r.phi > 0 for r in rows),
    "weighted_refit": lambda rows: len(rows) == 6 and all(r.before >= 0 and abs(r.after - r.before - r.change) < 1e-7 for r in rows) and sorted(r.rank_before for r in rows) == [1, 2, 3, 4, 5, 6],
}


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"))
def test_other_queries_hold(spark, name):
    assert HOLDS[name](entry.queries()[name](spark, SF).collect())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "default_rate" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
