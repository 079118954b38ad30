"""Queries over attributions: of fitted and closed-form models, their comparison, stability, and the reasons they give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import cox, evaluate, explain, models, sampling, scoring, selection, shapley
from tidemark.plans.model_queries import boosted
from tidemark.plans.registry import query
from tidemark.plans.views import LOANS, PHI, TIMES, accepted, attributions, loans, risky
from tidemark.sources.shipping import ship
from tidemark.sources.store import spread, stored
from tidemark.sources.tables import guard, table

FEATURES = ["dti", "loan_amnt", "annual_inc", "mths_since_delinq", "term_months", "fico_midpoint"]
_AVG_RANK = "rank() OVER (PARTITION BY {g} ORDER BY {v} DESC) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2"
_CORNERS = """ar AS (SELECT row_id, feature, t, phi, lag(t) OVER w AS t0, lag(phi) OVER w AS p0 FROM phi WINDOW w AS (PARTITION BY row_id, feature ORDER BY t)),
ae AS (SELECT row_id, feature, sum((t - t0) * (abs(phi) + abs(p0)) / 2) / (max(t) - min(t)) AS a, sum((t - t0) * (-phi - p0) / 2) / (max(t) - min(t)) AS s FROM ar GROUP BY ALL)"""
_OVERLAP = "round(count_if({a} <= {k} AND {b} <= {k}) / count_if({a} <= {k} OR {b} <= {k}), 6)"


def design(spark, sf_dir):
    """Loans with complete, standardised features, stored: fits and explanations read them again and again."""
    df = loans(spark, sf_dir).withColumn("fico_midpoint", (602 + F.col("o_custkey") % 200).cast("double")).select("id", "duration_months", "event", "purpose", *[F.col(f).cast("double").alias(f) for f in FEATURES])
    guard(df.select(*FEATURES))
    return stored(models.standardised(df, FEATURES))


def _ground(df, n: int = 50) -> np.ndarray:
    return np.array(sampling.reservoir(df, "id", n, 2).select(*FEATURES).collect(), float)


def _kernel(df, predict, times, samples=600, seed=101):
    return shapley.kernel_shap(spread(df.withColumnRenamed("id", "row_id")), _ground(df), FEATURES, predict, times, samples=samples, seed=seed)


@query()
def survshap(spark, sf_dir):
    """SurvSHAP(t): attributions of S(t) at each t, of the fitted hazard, for every loan."""
    ship(spark)
    df = design(spark, sf_dir)
    return _kernel(df, models.fit_hazard(df, FEATURES).survival(TIMES), TIMES)


@query()
def naive_shap(spark, sf_dir):
    """KernelSHAP of one number, 1 - S(36), of the same model."""
    ship(spark)
    df = design(spark, sf_dir)
    return _kernel(df, models.fit_hazard(df, FEATURES).survival([36], default=True), [36])


@query()
def noise_floor(spark, sf_dir):
    """Two draws of 24 coalitions of the same loans: how far importance agrees with itself."""
    ship(spark)
    df = design(spark, sf_dir)
    predict = models.fit_hazard(df, FEATURES).survival(TIMES)
    rows, ground = spread(df.withColumnRenamed("id", "row_id")), _ground(df)
    draws = [explain.mean_areas(shapley.kernel_areas(rows, ground, FEATURES, predict, TIMES, samples=24, seed=seed)).select("feature", "importance") for seed in (101, 202)]
    return explain.noise_floor(*draws)


def _line(x: np.ndarray) -> np.ndarray:
    rate = x[:, 0] / 10 + x[:, 1] / 100_000 - x[:, 2] / 1_000_000
    return 1 - np.outer(rate, TIMES) / 1000


_SEED2 = "('0x' || substr(sha256('2:' || id), 1, 8))::BIGINT"


@query(f"""{LOANS}, x AS (SELECT id, unnest(['dti', 'loan_amnt', 'annual_inc']) AS feature, unnest([coalesce(dti, 5.0) / 10, loan_amnt / 100000.0, -annual_inc / 1000000.0]::DOUBLE[]) AS v FROM loans),
g AS (SELECT id FROM loans ORDER BY {_SEED2}, id LIMIT 50), m AS (SELECT feature, avg(v) AS m FROM x JOIN g USING (id) GROUP BY 1)
SELECT id AS row_id, feature, t, round(-t / 1000.0 * (v - m), 6) + 0.0 AS phi FROM x JOIN m USING (feature), (SELECT unnest({TIMES}) AS t)""")
def survshap_linear(spark, sf_dir):
    """The kernel's attributions of a survival that is linear in its features, which have a closed form."""
    ship(spark)
    features = ["dti", "loan_amnt", "annual_inc"]
    df = stored(loans(spark, sf_dir).select("id", F.coalesce("dti", F.lit(5.0)).alias("dti"), F.col("loan_amnt").cast("double").alias("loan_amnt"), F.col("annual_inc").cast("double").alias("annual_inc")))
    ground = np.array(sampling.reservoir(df, "id", 50, 2).select(*features).collect(), float)
    return shapley.kernel_shap(df.withColumnRenamed("id", "row_id"), ground, features, _line, TIMES).select("row_id", "feature", "t", (F.round("phi", 6) + 0.0).alias("phi"))


_W = {"dti": 0.1, "loan_amnt": 2e-6, "annual_inc": -4e-6}
_HZ = " + ".join(f"1 / (1 + exp(-(-3 + {k} * 0.05 + " + " + ".join(f"{f} * {w!r}::DOUBLE" for f, w in _W.items()) + ")))" for k in range(1, 5))


@query(f"""{LOANS}, x AS (SELECT id, coalesce(dti, 5.0)::DOUBLE AS dti, loan_amnt::DOUBLE AS loan_amnt, annual_inc::DOUBLE AS annual_inc FROM loans), m AS (SELECT avg(dti) AS m0, avg(loan_amnt) AS m1, avg(annual_inc) AS m2 FROM x),
h AS (SELECT *, {_HZ} AS h FROM x, m) SELECT id, unnest({list(_W)}) AS feature, round(unnest([-h * {_W["dti"]!r}::DOUBLE * (dti - m0), -h * {_W["loan_amnt"]!r}::DOUBLE * (loan_amnt - m1), -h * {_W["annual_inc"]!r}::DOUBLE * (annual_inc - m2)]), 8) + 0.0 AS phi FROM h""")
def hazard_linear_shap(spark, sf_dir):
    df = loans(spark, sf_dir).select("id", F.coalesce("dti", F.lit(5.0)).cast("double").alias("dti"), F.col("loan_amnt").cast("double").alias("loan_amnt"), F.col("annual_inc").cast("double").alias("annual_inc"))
    return shapley.hazard_linear_shap(df, _W, -3.0, lambda k: 0.05 * k, 4, ["id"]).select("id", "feature", (F.round("phi", 8) + 0.0).alias("phi"))


@query()
def tree_shap(spark, sf_dir):
    """Hazard-weighted attributions of the boosted trees up to 36 months, for every loan."""
    df, model = boosted(spark, sf_dir)
    return model.tree_shap(spread(df.withColumnRenamed("id", "row_id")), 12, ["row_id"])


@query()
def background_summary(spark, sf_dir):
    """50 stand-ins of the loans: each cluster's medians, gaps kept, and most frequent level."""
    df = loans(spark, sf_dir).select("purpose", *[F.col(f).cast("double").alias(f) for f in ("dti", "loan_amnt", "annual_inc", "mths_since_delinq")])
    return models.background(df, ["dti", "loan_amnt", "annual_inc", "mths_since_delinq"], ["purpose"], 50)


@query(f"""{PHI}, {_CORNERS}, x AS (SELECT feature, round(avg(a), 8) AS i, round(avg(s), 8) AS s FROM ae GROUP BY 1), y AS (SELECT feature, round(avg(abs(phi)), 8) AS i, round(avg(-phi), 8) AS s FROM phi WHERE t = 36 GROUP BY 1),
p AS (SELECT feature, x.i AS ia, x.s AS sa, y.i AS ib, y.s AS sb, {_AVG_RANK.format(g='1', v='x.i')} AS ra, {_AVG_RANK.format(g='1', v='y.i')} AS rb FROM x JOIN y USING (feature)),
q AS (SELECT *, abs(sa) > 1e-9 AND abs(sb) > 1e-9 AS two, abs(sa) > 1e-9 AND abs(sb) > 1e-9 AND sign(sa) <> sign(sb) AS against FROM p),
r AS (SELECT round(corr(ra, rb), 6) AS spearman, round(corr(ia, ib), 6) AS pearson, {_OVERLAP.format(a='ra', b='rb', k=5)} AS top5_overlap, {_OVERLAP.format(a='ra', b='rb', k=10)} AS top10_overlap, round(count_if(two AND NOT against) / count_if(two), 6) AS sign_agreement,
coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (against), '') AS sign_disagreements, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (against AND (ra <= 5 OR rb <= 5)), '') AS top5_sign_disagreements, max(abs(ra - rb)) AS largest_shift FROM q)
SELECT *, CASE WHEN top5_sign_disagreements <> '' THEN 'material disagreement' WHEN spearman < 0.8 OR top5_overlap < 0.6 THEN 'meaningful disagreement' ELSE 'broad agreement' END AS verdict FROM r""")
def method_compare(spark, sf_dir):
    """Importance over time against importance at 36 months alone."""
    phi = attributions(spark, sf_dir)
    scalar = phi.where(F.col("t") == 36).groupBy("feature").agg(F.round(F.avg(F.abs("phi")), 8).alias("importance"), F.round(F.avg(-F.col("phi")), 8).alias("signed"))
    return explain.compare_methods(explain.importances(phi), scalar)


_SHIFT = f"""{PHI}, {_CORNERS}, he AS (SELECT feature, round(avg(a), 8) AS v FROM ae WHERE row_id % 2 = 0 GROUP BY 1), ho AS (SELECT feature, round(avg(a), 8) AS v FROM ae WHERE row_id % 2 = 1 AND feature <> 'f7' GROUP BY 1),
br AS (SELECT *, {_AVG_RANK.format(g='1', v='v')} AS r FROM he), af AS (SELECT *, {_AVG_RANK.format(g='1', v='v')} AS r FROM ho), j AS (SELECT feature, coalesce(br.v, 0) AS before, coalesce(af.v, 0) AS after, br.r AS rank_before, af.r AS rank_after FROM br FULL JOIN af USING (feature))"""


def _halves(spark, sf_dir):
    each = explain.row_areas(attributions(spark, sf_dir))
    half = lambda k: each.where(F.col("row_id") % 2 == k).groupBy("feature").agg(F.round(F.avg("area"), 8).alias("importance"))
    return explain.explanation_shift(half(0), half(1).where("feature <> 'f7'"))


@query(f"{_SHIFT} SELECT *, round(after - before, 8) AS change, round(100 * (after - before) / nullif(before, 0), 4) AS percent FROM j")
def explanation_shift(spark, sf_dir):
    return _halves(spark, sf_dir)[0]


@query(f"{_SHIFT}, v AS (SELECT round(corr(rank_before, rank_after), 6) AS spearman, {_OVERLAP.format(a='rank_before', b='rank_after', k=5)} AS top5_overlap FROM j) SELECT *, CASE WHEN spearman < 0.9 OR top5_overlap < 0.6 THEN 'explanations shift' ELSE 'explanations hold' END AS verdict FROM v")
def explanation_shift_verdict(spark, sf_dir):
    return _halves(spark, sf_dir)[1]


@query()
def weighted_refit(spark, sf_dir):
    """The hazard fitted again with inverse propensity weights, and what that does to its linear attributions."""
    df = design(spark, sf_dir)
    population = accepted(spark, sf_dir).select("id", "accepted", "dti", "loan_amnt", "annual_inc")
    scores = models.propensity(population, ["dti", "loan_amnt", "annual_inc"], F.col("accepted"))
    weights = selection.inverse_weights(scores.where("accepted"), "propensity").select("id", F.col("weight").alias("ipw"))
    weighted = stored(df.join(weights, "id"))

    def importance(model):
        w = model.model.coefficients.toArray()
        own = dict(zip(FEATURES, map(float, w)))
        rows = shapley.hazard_linear_shap(weighted, own, float(model.model.intercept), lambda k: float(np.log1p(k) * w[-2] + k / 12 * w[-1]), 12, ["id"])
        return rows.groupBy("feature").agg(F.round(F.avg(F.abs("phi")), 8).alias("importance"))

    return explain.explanation_shift(importance(models.fit_hazard(weighted, FEATURES)), importance(models.fit_hazard(weighted, FEATURES, weight="ipw")))[0]


_GROUPS = {"(none)": [], "dti": ["dti"], "amounts": ["loan_amnt", "annual_inc"], "history": ["mths_since_delinq", "fico_midpoint"], "term": ["term_months"], "(all)": FEATURES}


@query()
def ablation(spark, sf_dir):
    """Concordance and AUC at 12 months with each group of features set to its mean, and the drop of both; one scoring pass over all variants."""
    df = design(spark, sf_dir)
    model = cox.fit_cox(df, FEATURES)
    risk = lambda gone: sum((F.col(f) * float(b) for f, b in zip(FEATURES, model.beta) if f not in gone), F.lit(0.0))
    variants = F.array(*[F.struct(F.lit(g).alias("dropped"), risk(fs).alias("r")) for g, fs in _GROUPS.items()])
    scored = stored(df.select("duration_months", "event", F.explode(variants).alias("v")).select("duration_months", "event", "v.dropped", F.round("v.r", 10).alias("risk")))
    both = evaluate.concordance(scored, ["dropped"]).join(evaluate.cumulative_auc(scored, [12], ["dropped"]).select("dropped", "auc"), "dropped")
    base = both.where("dropped = '(none)'").select(F.col("concordance").alias("_c"), F.col("auc").alias("_a"))
    return both.crossJoin(F.broadcast(base)).select("dropped", "concordance", "auc", F.round(F.col("_c") - F.col("concordance"), 6).alias("concordance_drop"), F.round(F.col("_a") - F.col("auc"), 6).alias("auc_drop"))  # one row


_ARRIVE = {"(none)": [], "loan_structure": ["loan_amnt", "term_months"], "income_and_burden": ["annual_inc", "dti"], "recency": ["mths_since_delinq"], "score": ["fico_midpoint"], "application": ["purpose"]}


@query()
def ablation_missing(spark, sf_dir):
    """The hazard trees without each group of columns that arrive together, missing as in a file that lacks them: concordance and AUC at 12 months, and the drop of both."""
    df, model = boosted(spark, sf_dir)
    groups = _ARRIVE | {"(all)": model.bins.features}
    cells = evaluate.cells_of(model.ablated(spread(df), groups, 4, ["duration_months", "event"]).withColumn("risk", F.round("risk", 6)), ["dropped"], "risk")
    both = evaluate.concordance(cells, ["dropped"], counted=True).join(evaluate.cumulative_auc(cells, [12], ["dropped"], counted=True).select("dropped", "auc"), "dropped")
    base = both.where("dropped = '(none)'").select(F.col("concordance").alias("_c"), F.col("auc").alias("_a"))
    return both.crossJoin(F.broadcast(base)).select("dropped", "concordance", "auc", F.round(F.col("_c") - F.col("concordance"), 6).alias("concordance_drop"), F.round(F.col("_a") - F.col("auc"), 6).alias("auc_drop"))  # one row


# -- stability over segments

_LEVELS = f"""{PHI}, {_CORNERS}, sg AS (SELECT o_orderpriority AS grade, ae.* FROM ae JOIN orders ON o_orderkey = row_id), sz AS (SELECT grade, count(DISTINCT row_id) AS n_rows FROM sg GROUP BY 1),
bl AS (SELECT grade, feature, round(avg(a), 8) AS i FROM sg GROUP BY ALL), wh AS (SELECT feature, round(avg(a), 8) AS i FROM ae GROUP BY 1),
rk AS (SELECT grade, feature, i, {_AVG_RANK.format(g='grade', v='i')} AS r FROM bl), rw AS (SELECT feature, {_AVG_RANK.format(g='1', v='i')} AS rg FROM wh),
lv AS (SELECT grade, max(n_rows) AS n_rows, round(corr(r, rg), 6) AS spearman, {_OVERLAP.format(a='r', b='rg', k=5)} AS topk_overlap FROM rk JOIN rw USING (feature) JOIN sz USING (grade) WHERE n_rows >= 30 GROUP BY 1),
cv AS (SELECT feature, round(coalesce(stddev_samp(i) / nullif(avg(i), 0), 0), 6) AS cv FROM bl JOIN sz USING (grade) WHERE n_rows >= 30 GROUP BY 1)"""


def _by_grade(spark, sf_dir):
    """(importance by grade, of all, rows of each grade), from areas stored once."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("grade"))
    each = stored(explain.row_areas(attributions(spark, sf_dir)).join(orders, "row_id"))
    mean = F.round(F.avg("area"), 8).alias("importance")
    return each.groupBy("grade", "feature").agg(mean), each.groupBy("feature").agg(mean), each.select("grade", "row_id").distinct().groupBy("grade").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"{_LEVELS} SELECT * FROM lv")
def segment_stability(spark, sf_dir):
    levels, whole, sizes = _by_grade(spark, sf_dir)
    return explain.segment_stability(levels, whole, "grade", sizes)


@query(f"{_LEVELS} SELECT * FROM cv")
def segment_variation(spark, sf_dir):
    levels, _, sizes = _by_grade(spark, sf_dir)
    return explain.segment_variation(levels, "grade", sizes)


@query(f"{_LEVELS}, v AS (SELECT count(*) AS n_levels, min(spearman) AS least_spearman, arg_min(grade, (spearman, grade)) AS worst_level, round(avg(topk_overlap), 6) AS mean_overlap, (SELECT count_if(cv > 0.5) FROM cv)::BIGINT AS n_unstable FROM lv) SELECT *, CASE WHEN n_levels = 0 THEN 'inconclusive' WHEN least_spearman < 0.85 OR mean_overlap < 0.7 THEN 'drifts' ELSE 'stable' END AS verdict FROM v")
def segment_verdict(spark, sf_dir):
    levels, whole, sizes = _by_grade(spark, sf_dir)
    return explain.stability_verdict(explain.segment_stability(levels, whole, "grade", sizes), explain.segment_variation(levels, "grade", sizes), "grade")


_ROUNDS, _TARGET, _REFERENCE = 2000, "1-URGENT", ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_WEIGHT = " + ".join(f"(u > {float(c)!r})::INT" for c in explain._POISSON)
_QUANTS = ", ".join(f"round({n}, 6)::DOUBLE AS {n}, round(q_{n}[1], 6) AS {n}_low, round(q_{n}[2], 6) AS {n}_high" for n in ("rank_target", "rank_reference", "rank_shift", "share_ratio"))
_BOOT = f"""{PHI}, {_CORNERS}, v AS (SELECT row_id, feature, round(a, 8) AS value, o_orderpriority AS grade, ('0x' || substr(sha256('21:' || row_id), 1, 8))::BIGINT AS s, ('0x' || substr(sha256('22:' || row_id), 1, 8))::BIGINT | 1 AS g FROM ae JOIN orders ON o_orderkey = row_id),
u AS (SELECT grade, feature, value, r, (((s + r * g) & 4294967295) + 0.5) / 4294967296.0::DOUBLE AS u FROM v, (SELECT unnest(range(1, {_ROUNDS + 1})) AS r)),
w AS (SELECT grade, feature, r, sum(w * value) AS s, sum(w) AS w FROM (SELECT grade, feature, r, value, {_WEIGHT} AS w FROM u) GROUP BY ALL UNION ALL SELECT grade, feature, 0, sum(value), count(*) FROM v GROUP BY ALL),
m AS (SELECT grade, r, feature, round(s / w, 8) AS m FROM (SELECT * FROM w UNION ALL SELECT '(pooled)', feature, r, sum(s), sum(w) FROM w WHERE grade <> '{_TARGET}' GROUP BY ALL)),
k AS (SELECT *, row_number() OVER (PARTITION BY grade, r ORDER BY m DESC, feature) AS rank, m / sum(m) OVER (PARTITION BY grade, r) AS share FROM m),
p AS (SELECT r, feature, max(rank) FILTER (grade = '{_TARGET}') AS rank_target, max(rank) FILTER (grade = '(pooled)') AS rank_reference, max(share) FILTER (grade = '{_TARGET}') / max(share) FILTER (grade = '(pooled)') AS share_ratio, min(rank) FILTER (grade NOT IN ('{_TARGET}', '(pooled)')) AS lo, max(rank) FILTER (grade NOT IN ('{_TARGET}', '(pooled)')) AS hi FROM k GROUP BY ALL),
q AS (SELECT *, rank_target - rank_reference AS rank_shift, (rank_target < lo OR rank_target > hi)::INT AS gone FROM p),
f AS (SELECT feature, {", ".join(f"max({n}) FILTER (r = 0) AS {n}, quantile_cont({n}, [0.025, 0.975]) FILTER (r > 0) AS q_{n}" for n in ("rank_target", "rank_reference", "rank_shift", "share_ratio"))}, max(lo) FILTER (r = 0) || '-' || max(hi) FILTER (r = 0) AS reference_range, round(avg(gone) FILTER (r > 0), 6) AS outside_share FROM q GROUP BY 1)
SELECT feature, {_QUANTS}, reference_range, outside_share, rank_shift_low > 0 OR rank_shift_high < 0 AS shift_excludes_zero, share_ratio_low > 1 OR share_ratio_high < 1 AS share_excludes_one FROM f"""


@query(_BOOT)
def bootstrap_ranks(spark, sf_dir):
    """2000 rounds: features' ranks among urgent orders against the other priorities."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("grade"))
    values = explain.row_areas(attributions(spark, sf_dir)).join(orders, "row_id").select("row_id", "grade", "feature", F.round("area", 8).alias("value"))
    return explain.bootstrap_ranks(values, "grade", _TARGET, _REFERENCE, [f"f{i}" for i in range(1, 8)], rounds=_ROUNDS)


# -- reasons, and what is made of them

TEMPLATES = [("f1", "high utilisation", True), ("f2", "short history", False), ("f4", "recent inquiries", True), ("f5", "income too low", False), ("f7", "amount requested", None)]
MEDIANS = [("f1", 3.0), ("f2", 2.0), ("f2_missing", None), ("f4", 4.0), ("f5", 3.0), ("f7", 1.0)]
BARRED = ["f6"]
_SQL = lambda v: "NULL" if v is None else repr(v)
REASONS = f"""tp(base, reason, higher) AS (VALUES {", ".join(f"({a!r}, {b!r}, {_SQL(c)})" for a, b, c in TEMPLATES)}), md(feature, median) AS (VALUES {", ".join(f"({a!r}, {_SQL(b)}::DOUBLE)" for a, b in MEDIANS)}),
ad AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY phi, feature) AS top FROM (SELECT row_id, CASE feature WHEN 'f3' THEN 'f2_missing' ELSE feature END AS feature, phi, (row_id % 7)::DOUBLE AS value FROM phi WHERE t = 12 AND phi < 0)),
na AS (SELECT ad.*, reason, higher, median, row_number() OVER (PARTITION BY row_id, reason ORDER BY phi, ad.feature) AS n FROM ad JOIN tp ON base = regexp_replace(ad.feature, '_missing$', '') LEFT JOIN md ON md.feature = ad.feature WHERE ad.feature <> 'f6'),
kk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY phi, feature) AS k, coalesce(CASE WHEN higher THEN value < median WHEN NOT higher THEN value > median END, false) AS wrong FROM na WHERE n = 1),
st AS (SELECT row_id, string_agg(reason, '; ' ORDER BY k) AS reasons, string_agg(feature, '; ' ORDER BY k) AS features, count(*) AS n_reasons, coalesce(string_agg(feature, '; ' ORDER BY k) FILTER (wrong), '') AS inconsistent FROM kk WHERE k <= 4 GROUP BY 1),
fl AS (SELECT row_id, string_agg(feature, '; ' ORDER BY top) AS flags FROM ad WHERE feature = 'f6' AND top <= 8 GROUP BY 1),
rs AS (SELECT row_id, coalesce(reasons, '') AS reasons, coalesce(features, '') AS features, coalesce(n_reasons, 0) AS n_reasons, coalesce(inconsistent, '') AS inconsistent, coalesce(flags, '') AS flags FROM st FULL JOIN fl USING (row_id))"""


def stated_reasons(spark, sf_dir):
    scores = attributions(spark, sf_dir).where(F.col("t") == 12).select("row_id", F.when(F.col("feature") == "f3", "f2_missing").otherwise(F.col("feature")).alias("feature"), "phi", (F.col("row_id") % 7).cast("double").alias("value"))
    return explain.reasons(scores, spark.createDataFrame(TEMPLATES, "feature string, reason string, higher_is_adverse boolean"), spark.createDataFrame(MEDIANS, "feature string, median double"), BARRED)


@query(f"{PHI}, {REASONS} SELECT * FROM rs")
def reason_selection(spark, sf_dir):
    return stated_reasons(spark, sf_dir)


@query(f"{PHI}, {REASONS}, x AS (SELECT unnest(string_split(reasons, '; ')) AS reason FROM rs) SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM rs), 6) AS share_of_rows FROM x WHERE reason <> '' GROUP BY 1")
def reason_counts(spark, sf_dir):
    return scoring.reason_shares(stated_reasons(spark, sf_dir))


_RUN = f"""{LOANS}, {PHI.removeprefix('WITH ')}, {REASONS}, sc AS (SELECT l.id, round_even(1 - pow(1 - risk / 2, 12), 4) AS pd_12m, round_even(1 - pow(1 - risk / 2, 24), 4) AS pd_h, string_split(reasons, '; ') AS reasons, string_split(features, '; ') AS features, coalesce(n_reasons, 0) AS n, l.purpose FROM loans l LEFT JOIN rs ON rs.row_id = l.id),
de AS (SELECT *, CASE WHEN pd_h >= 0.45 THEN 'reject' ELSE 'approve' END AS decision, CASE WHEN pd_h >= 0.45 THEN CASE WHEN n > 0 THEN 'explained' WHEN id % 2 = 0 THEN 'reasons pending' END END AS explained FROM sc)"""


def run_of(spark, sf_dir):
    """A scored run with its stated reasons and notices, from closed-form risks."""
    default = lambda months: F.bround(1 - F.pow(1 - F.col("hazard"), F.lit(months)), 4)
    rows = risky(spark, sf_dir).select("id", "purpose", default(12).alias("pd_12m"), default(24).alias("pd_h")).join(stated_reasons(spark, sf_dir).withColumnRenamed("row_id", "id"), "id", "left")
    rows = rows.withColumns({"threshold": F.lit(0.45), "decision": F.when(F.col("pd_h") >= 0.45, "reject").otherwise("approve"), "n_reasons": F.coalesce("n_reasons", F.lit(0))})
    split = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, "; "))
    explained = F.when(F.col("decision") == "reject", F.when(F.col("n_reasons") > 0, "explained").when(F.col("id") % 2 == 0, "reasons pending"))
    rows = rows.withColumn("explained", explained)
    return rows.withColumns({"notice": F.when(F.col("explained") == "explained", F.concat_ws(" ", F.lit("Applicant"), "id", F.lit("was declined:"), "reasons")), "reasons": split(F.col("reasons")), "features": split(F.col("features"))})


_CHECKS = {
    "counts_add_up": "decision NOT IN ('approve', 'reject')", "decisions_match_threshold": "pd_h IS NULL OR (pd_h >= 0.45) <> (decision = 'reject')", "risk_12m_le_horizon": "pd_12m > pd_h",
    "rejected_have_reasons_or_pending": "decision = 'reject' AND explained IS NULL", "no_nondisclosable_stated_reason": "list_has_any(coalesce(features, []), ['f4']) OR list_has_any(coalesce(reasons, []), ['amount requested'])",
    "applicant_notices_clean": "explained = 'explained' AND list_has_any(reasons, ['short history'])",
}


@query(f"""{_RUN}, x AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count_if({c})::BIGINT AS violations, coalesce((SELECT string_agg(id, ', ' ORDER BY id) FROM (SELECT id FROM de WHERE {c} ORDER BY id LIMIT 5)), '') AS examples FROM de" for k, c in _CHECKS.items()) + """)
SELECT "check", CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status, violations > 0 AS blocking, violations, examples FROM x UNION ALL SELECT 'threshold_is_published', 'OVERRIDDEN', false, 0, '' UNION ALL SELECT 'model_approved', 'OVERRIDDEN', false, 0, ''
UNION ALL SELECT 'input_quality', 'FAIL', true, 1, 'dti'""")
def run_checks(spark, sf_dir):
    """The nine checks; f4 is barred, 'amount requested' is no known wording, 'history' counts as an internal name, and one column is reported as missing too often."""
    rows = stored(run_of(spark, sf_dir))
    quality = spark.createDataFrame([("dti", True), ("term", False)], "column string, problem boolean")
    wordings = [r for _, r, _ in TEMPLATES if r != "amount requested"]
    return scoring.run_checks(rows, n_read=rows.count(), threshold=0.45, published=0.40, horizon=24, barred=["f4"], wordings=wordings, pending=["reasons pending"], names=["history"], approved=False, allow_unapproved=True, quality=quality)


@query(f"{_RUN} SELECT id AS row_id, pd_h, purpose FROM de WHERE explained = 'explained' ORDER BY pd_h DESC, id LIMIT 1")
def riskiest_explained(spark, sf_dir):
    return explain.riskiest(run_of(spark, sf_dir).where("explained = 'explained'").withColumnRenamed("id", "row_id"), "pd_h", ["purpose"])


@query(f"{_RUN} SELECT decision, count(*) AS rows, round(sum(pd_h), 4) AS total FROM de GROUP BY 1")
def decision_sinks(spark, sf_dir):
    """The run written a folder per decision, appended twice by halves, and read again."""
    from tidemark.sources.store import scratch

    rows, path = stored(run_of(spark, sf_dir).select("id", "pd_h", "decision")), scratch(spark)  # both halves read it
    for half in (0, 1):
        scoring.write_decisions(rows.where(F.col("id") % 2 == half), path)
    return spark.read.parquet(path).groupBy("decision").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("pd_h"), 4).alias("total"))


@query(f"{_RUN} SELECT id, pd_h, CASE WHEN explained = 'explained' AND id % 3 = 0 THEN array_to_string(reasons, '; ') ELSE 'waiting' END AS reasons FROM de WHERE decision = 'reject'")
def column_rewrite(spark, sf_dir):
    """Rejected rows get the reasons that a later phase found for a third of them; everything else stays."""
    run = stored(run_of(spark, sf_dir).where("decision = 'reject'").select("id", "pd_h", "explained", F.array_join("reasons", "; ").alias("reasons")))
    results = run.where("explained = 'explained' AND id % 3 = 0").select("id", "reasons")
    return scoring.filled_in(run.select("id", "pd_h", F.lit("waiting").alias("reasons")), results, "id", ["reasons"])


_BY_GRADE = f"""{LOANS}, c AS (SELECT grade, duration_months AS d, event AS e, risk AS r, count(*) AS n FROM loans GROUP BY ALL),
cg AS (SELECT a.grade, round(sum(a.n * b.n * CASE WHEN a.r > b.r THEN 1 WHEN a.r = b.r THEN 0.5 ELSE 0 END) / sum(a.n * b.n), 6)::DOUBLE AS concordance FROM c a JOIN c b ON a.grade = b.grade AND a.e = 1 AND (b.d > a.d OR (b.d = a.d AND b.e = 0)) GROUP BY 1)"""


@query(f"{_BY_GRADE} SELECT *, CASE WHEN grade = '2-HIGH' THEN 14.0 ELSE 3.1 END::DOUBLE AS largest_coefficient, CASE WHEN abs(concordance - 0.5) <= 0.02 THEN 'no_better_than_chance' WHEN grade = '2-HIGH' THEN 'runaway_coefficient' END AS problem FROM cg")
def fit_guard(spark, sf_dir):
    """A fit per grade: which ones rank no better than chance, or have run away."""
    fits = evaluate.concordance(risky(spark, sf_dir), ["grade"]).select("grade", "concordance", F.when(F.col("grade") == "2-HIGH", 14.0).otherwise(3.1).alias("largest_coefficient"))
    return models.fit_guard(fits)
