"""The operators against small hand-made cases and properties."""

import datetime
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import matching, parse
from tidemark.operators import clean, cox, drift, evaluate, explain, label, models, ranks, sampling, scoring, selection, shapley, survival
from tidemark.sources import tables
from tidemark.sources.shipping import ship

#: status, issued, last paid, term, then the target: duration, event, reason. One case a branch and a boundary each side.
CASES = {
    "loss": ("Charged Off", "2011-03-09", "Aug-2012", "60 months", 17, 1, None),
    "loss before any payment": ("Default", "Oct-2013", None, "36mo", 1, 1, None),
    "loss in the month of issue": ("Charged Off", "Oct-2013", "Oct-2013", " 36 months", 1, 1, None),
    "paid off": ("Fully Paid", "2010-01", "05/31/2012", "36", 28, 0, None),
    "paid off at once": ("Fully Paid", "Feb-2016", "Feb-2016", " 36 months", 1, 0, None),
    "open": ("Current", "Nov-2014", "Jun-2015", " 60 months", 30, 0, None),
    "new": ("Issued", "May-2017", None, " 60 months", 1, 0, None),
    "two weeks late": ("Late (16-30 days)", "Sep-2015", "Mar-2017", " 60 months", 18, 0, None),
    "two months late": ("Late (31-120 days)", "Sep-2015", "Apr-2017", " 60 months", 19, 0, None),
    "in grace": ("In Grace Period", "Sep-2015", "Feb-2017", " 60 months", 17, 0, None),
    "odd spaces": ("\tfully   PAID ", "Dec-09", "Mar-10", "36", 3, 0, None),
    "overrun by twelve months": ("Fully Paid", "Jan-2009", "Jan-2013", " 36 months", 48, 0, None),
    "overrun by thirteen": ("Fully Paid", "Jan-2009", "Feb-2013", " 36 months", None, None, "term_overrun"),
    "outside the policy": ("Does not meet the credit policy. Status:Fully Paid", "Jul-2009", "Jul-2010", " 36 months", None, None, "excluded_status"),
    "no status": (" ", "Jul-2009", "Jul-2010", " 36 months", None, None, "excluded_status"),
    "no issue month": ("Current", "soon", "Jan-2016", " 36 months", None, None, "missing_issue_d"),
    "no term": ("Current", "Jan-2016", "Jan-2016", "long", None, None, "missing_term"),
    "no end": ("Fully Paid", "Jan-2016", "?", " 36 months", None, None, "missing_end_date"),
}


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(k, *v[:4]) for k, v in CASES.items()], "scenario string, loan_status string, issue_d string, last_pymnt_d string, term string")


def test_every_labelling_branch(tiny):
    rows = {r.scenario: r for r in label.labelled(tiny).collect()}
    for name, (*_, duration, event, reason) in CASES.items():
        assert rows[name].reason == reason, name
        if reason is None:
            assert (rows[name].duration_months, rows[name].event) == (duration, event), name
    r = label.summary(label.labelled(tiny)).first()
    assert r.n_input == r.n_retained + r.n_dropped == len(CASES)


def test_label_switches(tiny):
    late = {r.scenario: r.event for r in label.survival_target(tiny, label.LabelRule(late_is_event=True, with_exceptions=True)).collect()}
    assert (late["two months late"], late["two weeks late"], late["outside the policy"]) == (1, 0, 0)
    lagged = {r.scenario: r.duration_months for r in label.survival_target(tiny, label.LabelRule(event_lag=2)).collect()}
    assert (lagged["loss"], lagged["paid off"]) == (19, 28)


def test_unknown_status_raises(spark):
    with pytest.raises(PySparkException, match="unknown loan status"):
        spark.createDataFrame([("Something new",)], "s string").select(parse.outcome(F.col("s"))).collect()


@pytest.mark.parametrize(("text", "value"), [("$1,200.5", 1200.5), ("13.5%", 13.5), (" 7 ", 7.0), ("1d", None), ("NaN", None), ("", None), ("n/a", None), ("1e3", 1000.0), (None, None), ("--1", None)])
def test_numbers(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(parse.number(F.col("t"))).first()[0] == value


@pytest.mark.parametrize(("text", "value"), [(" 36 months", 36), ("60mo.", 60), ("36.0", 36), ("36 m", 36), ("36 years", None), ("abc 36", None), ("1234", None), (None, None)])
def test_terms(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(parse.term_months(F.col("t"))).first()[0] == value


@pytest.mark.parametrize("text", ["Dec-2018", "2018-12-01", "Dec-18", "2018-12", "01-Dec-2018", "12/01/2018", "12/31/2018"])
def test_month_formats(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(parse.month(F.col("t"))).first()[0] == datetime.date(2018, 12, 1)


def test_two_digit_years(spark):
    assert spark.createDataFrame([("Jan-98",)], "t string").select(parse.month(F.col("t"))).first()[0] == datetime.date(1998, 1, 1)


def test_bands_and_lengths(spark):
    df = spark.createDataFrame([(-1.0, "< 1 year"), (0.0, "10+ years"), (30_000.0, "2 years"), (150_000.0, "?"), (None, None)], "i double, e string")
    rows = df.select(parse.income_band(F.col("i")), parse.employment_years(F.col("e"))).collect()
    assert [tuple(r) for r in rows] == [(None, 0.5), ("<30k", 10), ("30-50k", 2), ("150k+", None), (None, None)]


def test_leakage_guard(tiny):
    with pytest.raises(tables.LeakageError):
        tables.guard(tiny)


def test_dedupe_kinds(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "b", 1), (5, "a", 1)], "n int, k string, v int")
    kinds = [r.kind for r in clean.first_per_key(df, F.col("k"), F.col("n"), ["k", "v"]).orderBy("n").collect()]
    assert kinds == ["kept", "duplicate_row", "duplicate_key", "kept", "duplicate_row"]


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1)], "duration_months int, event int")
    rows = {r.duration_months: r.survival for r in survival.kaplan_meier(df).collect()}
    assert rows == {1: 0.75, 2: 0.75, 3: 0.0}


def test_person_period_of_three_loans(spark):
    df = spark.createDataFrame([(1, 3, 1), (2, 1, 0), (3, 5, 1)], "id long, duration_months int, event int")
    rows = survival.person_period(df).collect()
    assert len(rows) == 9 and sum(r.y for r in rows) == 2 and {(r.id, r.period) for r in rows if r.y} == {(1, 3), (3, 5)}
    cut = survival.person_period(df, horizon=2).collect()
    assert len(cut) == 5 and not sum(r.y for r in cut)
    assert survival.expansion(df).first()[0] == 9


@pytest.mark.parametrize(("sign", "c"), [(1, 1.0), (-1, 0.0), (0, 0.5)])
def test_concordance_extremes(spark, sign, c):
    df = spark.createDataFrame([(i, 1, float(-sign * i)) for i in range(1, 20)], "duration_months int, event int, risk double")
    assert evaluate.concordance(df).first().concordance == c


def test_concordance_equals_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(1, 8, 80), rng.integers(0, 2, 80), rng.integers(0, 5, 80))]
    num = den = 0.0
    for d, e, r in rows:
        for d2, e2, r2 in rows:
            if e and (d2 > d or d2 == d and not e2):
                den += 1
                num += 1.0 if r > r2 else 0.5 if r == r2 else 0.0
    got = evaluate.concordance(spark.createDataFrame(rows, "duration_months int, event int, risk double")).first()
    assert got.n_pairs == den and abs(got.concordance - num / den) < 1e-6


def test_brier_of_a_coin(spark):
    df = spark.createDataFrame([(i, int(i < 6)) for i in range(1, 11)], "duration_months int, event int").withColumn("hazard", F.lit(1 - 0.5 ** (1 / 5)))
    assert abs(evaluate.brier(df, [5]).first().brier - 0.25) < 1e-6


def test_drift_of_equal_and_shifted(spark):
    df = spark.range(4000).select((F.col("id") % 1000).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"), (F.col("id") >= 2000).alias("cur"))
    assert drift.psi(df, ["x"], F.col("cur")).first().score == 0 and drift.tvd(df, ["c"], F.col("cur")).first().score < 0.01
    moved = df.withColumn("x", F.when(F.col("cur"), F.col("x") + 900).otherwise(F.col("x")))
    rows = drift.compare(moved, ["x"], ["c"], F.col("cur")).collect()
    assert [(r.feature, r.status) for r in rows] == [("x", "large"), ("c", "stable")]
    assert {r.status for r in drift.compare(df.where("NOT cur"), ["x"], ["c"], F.col("cur")).collect()} == {"insufficient"}


def test_rank_auc_ignores_monotone_scales(spark):
    df = spark.range(500).select((F.rand(3) * 4).alias("x"), (F.col("id") % 3 == 0).alias("a"))
    df = spark.createDataFrame(df.collect(), df.schema).withColumn("y", F.exp("x"))
    rows = {r.feature: r.rank_auc for r in selection.rank_auc(df, ["x", "y"], F.col("a")).collect()}
    assert rows["x"] == rows["y"]


def test_samples_ignore_partitions(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("s"))
    for f in (lambda d: sampling.reservoir(d, "id", 50, 1), lambda d: sampling.stratified(d, "id", "s", 70, 1), lambda d: sampling.equal_pick(d, "id", "s", 5, 1)):
        a, b = ({r.id for r in f(d).collect()} for d in (df.repartition(1), df.repartition(7)))
        assert a == b
    assert sampling.stratified(df, "id", "s", 70, 1).count() == 70


def test_cox_recovers_its_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    t = rng.exponential(1 / (0.05 * np.exp(0.7 * x[:, 0] - 0.4 * x[:, 1])))
    rows = [(float(a), float(b), int(min(np.ceil(d), 60)), int(d < 60)) for (a, b), d in zip(x, t)]
    df = spark.createDataFrame(rows, "a double, b double, duration_months int, event int")
    model = cox.fit_cox(df, ["a", "b"])
    assert np.abs(model.beta - [0.7, -0.4]).max() < 0.08
    s = [r.survival for r in cox.cox_survival(df.limit(1), model, [1, 12, 36], []).orderBy("t").collect()]
    assert 1 >= s[0] >= s[1] >= s[2] >= 0


def exact_shapley(value, p):
    """Shapley values of a set function by its definition."""
    out = np.zeros(p)
    for j in range(p):
        others = [i for i in range(p) if i != j]
        for k in range(p):
            for s in combinations(others, k):
                out[j] += factorial(k) * factorial(p - k - 1) / factorial(p) * (value({*s, j}) - value(set(s)))
    return out


def curves(x):
    """A survival that is far from linear, at three times."""
    rate = np.exp(0.4 * x[:, 0] - 0.3 * x[:, 1] * x[:, 2] + 0.2 * np.maximum(x[:, 3], 0))
    return np.exp(-np.outer(rate, [0.1, 0.3, 0.6]))


def test_kernel_values_are_exact_with_all_coalitions():
    rng = np.random.default_rng(1)
    x, ground = rng.normal(size=(5, 4)), rng.normal(size=(7, 4))
    phi, base, prediction = shapley.kernel_values(x, ground, curves, *shapley.coalitions(4, 600, 1))
    for i in range(5):
        for t in range(3):
            value = lambda s, i=i, t=t: curves(np.where(np.isin(np.arange(4), list(s)), x[i], ground))[:, t].mean()
            assert np.abs(phi[i, :, t] - exact_shapley(value, 4)).max() < 1e-9
    assert np.abs(base + phi.sum(axis=1) - prediction).max() < 1e-12


def test_drawn_coalitions_keep_the_sum_and_come_near():
    rng = np.random.default_rng(2)
    x, ground = rng.normal(size=(20, 9)), rng.normal(size=(10, 9))
    z, w = shapley.coalitions(9, 100, 5)
    assert 80 <= len(z) <= 100 and {1, 8} <= set(z.sum(axis=1).tolist()) and (z.any(axis=1) & ~z.all(axis=1)).all() and (w > 0).all()
    few, base, prediction = shapley.kernel_values(x, ground, curves, z, w)
    every, *_ = shapley.kernel_values(x, ground, curves, *shapley.coalitions(9, 600, 5))
    assert np.abs(base + few.sum(axis=1) - prediction).max() < 1e-12
    assert np.corrcoef(few.ravel(), every.ravel())[0, 1] > 0.99 and np.abs(few[:, 4:]).max() < 0.02  # features without an effect
    assert len(shapley.coalitions(6, 1, 1)[0]) >= 12  # sizes 1 and p - 1 always
    assert shapley.kernel_values(x[:, :1], ground[:, :1], lambda v: v * 2, *shapley.coalitions(1, 10, 1))[0].shape == (20, 1, 1)


def test_kernel_rows_do_not_depend_on_partitions(spark):
    ship(spark)
    rows = spark.range(30).select(F.col("id").alias("row_id"), *[F.sin(F.col("id") * (i + 1)).alias(f"x{i}") for i in range(4)])
    ground = np.random.default_rng(3).normal(size=(5, 4))
    one, many = (sorted(map(tuple, shapley.kernel_shap(rows.repartition(n), ground, ["x0", "x1", "x2", "x3"], curves_of(), [1, 2, 3], samples=8).collect())) for n in (1, 6))
    assert [r[:3] for r in one] == [r[:3] for r in many] and np.allclose([r[3:] for r in one], [r[3:] for r in many])
    sums = {}
    for row, _, t, phi, base, prediction in one:
        sums.setdefault((row, t), [base - prediction]).append(phi)
    assert len(one) == 30 * 4 * 3 and max(abs(sum(v)) for v in sums.values()) < 1e-9


def curves_of():
    """The same survival as a closure, which workers get by value."""

    def predict(x):
        rate = np.exp(0.4 * x[:, 0] - 0.3 * x[:, 1] * x[:, 2] + 0.2 * np.maximum(x[:, 3], 0))
        return np.exp(-np.outer(rate, [0.1, 0.3, 0.6]))

    return predict


def test_noise_floor_of_equal_draws(spark):
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "feature string, importance double")
    assert explain.noise_floor(flat, flat).first().spearman == 1.0
    other = flat.withColumn("importance", F.lit(2.0))
    assert explain.noise_floor(flat, other).first()[0] == 0.0
    assert abs(explain.noise_floor(flat, other).first().mean_relative_gap - 2 / 3) < 1e-6


def test_bootstrap_sees_a_shift_and_no_shift(spark):
    rng = np.random.default_rng(6)
    rows = [(n, level, f, float(abs(rng.normal(m, 0.1)))) for n, level in enumerate(["t"] * 40 + ["r"] * 40 + ["s"] * 40) for f, m in (("up", 3.0 if level == "t" else 1.0), ("same", 2.0), ("low", 0.5))]
    got = {r.feature: r for r in explain.bootstrap_ranks(spark.createDataFrame(rows, "row_id long, level string, feature string, value double"), "level", "t", ["r", "s"], ["up", "same", "low"], rounds=300).collect()}
    up, low = got["up"], got["low"]
    assert (up.rank_target, up.rank_reference, up.rank_shift_high, up.outside_share, up.shift_excludes_zero, up.share_excludes_one) == (1, 2, -1, 1.0, True, True)
    assert (low.rank_shift, low.rank_shift_low, low.shift_excludes_zero, low.outside_share, low.reference_range) == (0, 0, False, 0.0, "3-3")
    mean = {k: np.mean([v for _, lv, f, v in rows if f == "up" and lv in k]) for k in ("t", "rs")}
    total = {k: sum(np.mean([v for _, lv, f, v in rows if f == g and lv in k]) for g in got) for k in mean}
    assert abs(up.share_ratio - (mean["t"] / total["t"]) / (mean["rs"] / total["rs"])) < 1e-6
    assert up.share_ratio_low < up.share_ratio < up.share_ratio_high


def test_background_keeps_gaps_and_takes_modes(spark):
    rows = [(float(i % 2 * 100 + i % 5), None if i % 2 else 7.0, "x" if i % 3 else "y") for i in range(60)]
    got = {r.a > 50: r for r in models.background(spark.createDataFrame(rows, "a double, b double, c string"), ["a", "b"], ["c"], 2).collect()}
    assert (got[True].b, got[False].b, got[True].c, got[True].n, got[False].a) == (None, 7.0, "x", 30, 2.0)


def test_cox_equals_newton_on_the_whole_table(spark):
    """Breslow and Efron agree without ties; the plain Newton fit below has every loan as a row."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 2))
    event = rng.integers(0, 2, 150)
    t = rng.permutation(150) + 1
    df = spark.createDataFrame([(float(a), float(b), int(d), int(e)) for (a, b), d, e in zip(x, t, event)], "a double, b double, duration_months int, event int")
    model = cox.fit_cox(df, ["a", "b"])
    beta = np.zeros(2)
    for _ in range(30):
        g, h = -0.05 * beta, 0.05 * np.eye(2)
        w = np.exp(x @ beta)
        for i in np.flatnonzero(event):
            risk = t >= t[i]
            m = (w[risk, None] * x[risk]).sum(axis=0) / w[risk].sum()
            g = g + x[i] - m
            h = h + (w[risk, None, None] * x[risk, :, None] * x[risk, None]).sum(axis=0) / w[risk].sum() - np.outer(m, m)
        beta = beta + np.linalg.solve(h, g)
    assert np.abs(model.beta - beta).max() < 1e-6


def test_weights_of_a_refit_count_as_rows(spark):
    rng = np.random.default_rng(10)
    rows = [(i, float(rng.normal()), int(rng.integers(1, 12)), int(rng.integers(0, 2)), float(1 + i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, duration_months int, event int, w double")
    twice = df.unionByName(df.where("w = 2"))
    one, two = models.fit_hazard(df, ["a"], weight="w"), models.fit_hazard(twice, ["a"])
    assert np.abs(one.model.coefficients.toArray() - two.model.coefficients.toArray()).max() < 1e-2
    s = one.survival([0, 3, 12])(np.array([[0.5]]))[0]
    assert s[0] == 1 and 1 > s[1] > s[2] > 0
    own = survival.survival_from_hazard(one.hazards(spark.createDataFrame([(1, 0.5)], "id long, a double"), 4, ["id"]), ["id"]).where("period = 4").first().survival
    assert abs(own - s[2]) < 1e-6


def test_reasons_directions_and_flags(spark):
    scores = spark.createDataFrame([(1, "a", -0.5, 9.0), (1, "b_missing", -0.4, 1.0), (1, "b", -0.3, 1.0), (1, "zip", -0.6, 1.0), (1, "c", -0.2, None), (1, "d", 0.9, 1.0), (2, "zip", -0.1, 1.0), (3, "d", 0.5, 1.0)], "row_id long, feature string, phi double, value double")
    templates = spark.createDataFrame([("a", "A", False), ("b", "B", True), ("c", "C", True)], "feature string, reason string, higher_is_adverse boolean")
    medians = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0)], "feature string, median double")
    got = {r.row_id: tuple(r)[1:] for r in explain.reasons(scores, templates, medians, ["zip"]).collect()}
    assert got == {1: ("A; B; C", "a; b_missing; c", 3, "a", "zip"), 2: ("", "", 0, "", "zip")}


def test_nine_checks(spark):
    schema = "id long, decision string, threshold double, pd_12m double, pd_h double, explained string, reasons array<string>, features array<string>, notice string"
    good = [(1, "approve", 0.5, 0.1, 0.2, None, [], [], None), (2, "reject", 0.5, 0.5, 0.6, "explained", ["A"], ["a"], "Declined: A"), (3, "reject", 0.5, 0.5, 0.5, "later", [], [], None)]
    run = lambda rows, **more: {r.check: r for r in scoring.run_checks(spark.createDataFrame(rows, schema), **{**dict(n_read=len(rows), threshold=0.5, published=0.5, horizon=24, barred=["zip"], wordings=["A"], pending=["later"], names=["loan_amnt"], approved=True, allow_unapproved=False), **more}).collect()}
    assert {r.status for r in run(good).values()} == {"PASS"} and len(run(good)) == 8
    bad = [(i, "reject", 0.5, 0.9, None if i == 4 else 0.6, "explained", ["B" if i % 2 else "A"], ["zip" if i == 6 else "grade_b" if i == 8 else "a"], "score 0.123456" if i == 5 else None) for i in range(1, 9)] + [(9, "maybe", 0.4, 0.1, 0.2, None, [], [], "Declined"), (10, "reject", 0.5, 0.5, 0.6, None, [], [], None)]
    got = run(bad, n_read=12, published=0.4, approved=False)
    assert {k: (r.status, r.violations) for k, r in got.items()} == {"counts_add_up": ("FAIL", 3), "decisions_match_threshold": ("FAIL", 2), "risk_12m_le_horizon": ("FAIL", 8), "rejected_have_reasons_or_pending": ("FAIL", 1), "no_nondisclosable_stated_reason": ("FAIL", 6), "applicant_notices_clean": ("FAIL", 9), "threshold_is_published": ("OVERRIDDEN", 0), "model_approved": ("FAIL", 1)}
    assert got["no_nondisclosable_stated_reason"].examples == "1, 3, 5, 6, 7"
    assert run(good, approved=False, allow_unapproved=True)["model_approved"].status == "OVERRIDDEN"


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(12)
    rows = [("x", float(v)) for v in np.append(rng.normal(size=500), 1e12)] + [("y", float(v)) for v in rng.integers(0, 4, 300)] + [("y", None), ("z", None)]
    at = [0.0, 0.005, 0.5, 0.77, 1.0]
    got = {r.k: r.q for r in ranks.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", at).collect()}
    assert set(got) == {"x", "y"}
    for k in got:
        assert np.allclose(got[k], np.quantile([v for n, v in rows if n == k and v is not None], at), rtol=1e-12)


def test_column_matching(spark):
    df = spark.createDataFrame([("1000", "50000", "x", "7")] * 4 + [("900", "40000", None, "7")], "LoanAmount string, `Yearly Income` string, other string, kind string")
    features = {"loan_amnt": matching.Content(500, 40_000), "annual_inc": matching.Content(0, 300_000), "purpose": matching.Content(levels=("x", "y")), "home": matching.Content()}
    rows = {r.column: r for r in matching.match(df, features, {"amount": ("loan_amnt",), "yearlyincome": ("annual_inc",), "kind": ("home",)}).collect()}
    assert (rows["LoanAmount"].feature, rows["LoanAmount"].confidence, rows["Yearly Income"].feature, rows["other"].feature, rows["other"].confidence) == ("loan_amnt", 0.99, "annual_inc", "purpose", 0.8)
    assert (rows["kind"].confidence, rows["kind"].preselected) == (0.225, False)  # numbers under a category's name
    assert [matching.normalised(x) for x in ("LoanAmount", "Open Credit Lines (count)", "inquiries_last_6m", "the loan", "FICOScore2High", "a1b", "", "Zip-Code 5")] == ["amount", "opencreditlines", "inquirieslast6m", "theloan", "ficoscore2high", "1b", "", "zipcode5"]


def test_propensity_coefficients_equal_newton(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 2)) * [3.0, 0.5] + [10.0, -2.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 * (x[:, 0] - 10) - 2.0 * (x[:, 1] + 2))))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), bool(v)) for (a, b), v in zip(x, y)], "a double, b double, y boolean")
    rows, got = models.fit_propensity(df, ["a", "b"], F.col("y"))
    z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0, ddof=1), np.ones(400)])
    beta, ridge = np.zeros(3), np.diag([1e-4, 1e-4, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta + np.linalg.solve((z.T * (p * (1 - p))) @ z / 400 + ridge, z.T @ (y - p) / 400 - ridge @ beta)
    assert [f for f, _ in got] == ["a", "b"] if abs(beta[0]) > abs(beta[1]) else ["b", "a"]
    assert np.allclose([dict(got)["a"], dict(got)["b"]], beta[:2], atol=1e-3)
    assert abs(rows.agg(F.avg("propensity")).first()[0] - y.mean()) < 1e-3


def test_curves_of_a_margin_are_the_hazards_product():
    """Survival by odds against the running product, at margins that overflow too; the kernel by margins against the one by mixed rows; a default is 1 - survival."""
    rng = np.random.default_rng(3)
    curve = shapley.Curve(np.array([0.7, -1.2, 0.4]), -2.0, np.exp(0.3 * np.log1p(np.arange(1, 13))), [2, 0, 12])
    x, ground = rng.normal(size=(40, 3)), rng.normal(size=(9, 3))
    hazard = 1 / (1 + 1 / (np.exp(-2.0 + x @ curve.weights)[:, None] * curve.odds))
    s = np.cumprod(1 - hazard, axis=1)
    assert np.abs(curve(x) - np.column_stack([s[:, 1], np.ones(40), s[:, 11]])).max() < 1e-14
    assert curve.of(np.array([-800.0, 800.0])).tolist() == [[1, 1, 1], [0, 1, 0]]
    z = shapley.coalitions(3, 600, 1)
    for one, two in zip(shapley.kernel_values(x, ground, curve, *z), shapley.kernel_values(x, ground, lambda v: curve(v), *z)):
        assert np.abs(one - two).max() < 1e-12
    other = shapley.Curve(curve.weights, curve.offset, curve.odds, curve.ends, default=True)
    assert np.abs(other(x) - (1 - curve(x))).max() < 1e-15


def test_areas_made_beside_the_kernel(spark):
    """kernel_areas against row_areas of kernel_shap, with times out of order, and without any span."""
    ship(spark)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(30)], "row_id long, a double, b double, c double")
    for ends in ([8, 2, 5], [4]):
        curve = shapley.Curve(np.array([0.7, -1.2, 0.4]), -2.0, np.ones(9), ends)
        args = (rows, rng.normal(size=(5, 3)), ["a", "b", "c"], curve, [3 * e for e in ends])
        want = {(r.row_id, r.feature): (r.area, r.signed) for r in explain.row_areas(shapley.kernel_shap(*args)).collect()}
        got = {(r.row_id, r.feature): (r.area, r.signed) for r in shapley.kernel_areas(*args).collect()}
        assert set(got) == set(want)
        assert all(g == w if None in w else np.allclose(g, w, atol=1e-12) for g, w in ((got[k], want[k]) for k in want))
