"""Queries over survival curves, person-period tables and measures of predicted survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluate, sampling, survival
from tidemark.plans.registry import query
from tidemark.plans.views import LOANS, TIMES, loans, risky

_KM = """c AS (SELECT {g} duration_months, count(*) AS n, sum({e})::BIGINT AS d FROM {src} GROUP BY ALL),
r AS (SELECT *, sum(n) OVER ({part} ORDER BY duration_months DESC)::BIGINT AS at_risk FROM c),
km AS (SELECT *, CASE WHEN max((d = at_risk)::INT) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER w) END AS s FROM r WINDOW w AS ({part} ORDER BY duration_months))"""


def _km(e: str = "event", g: str = "", src: str = "loans", name: str = "") -> str:
    sql = _KM.format(e=e, g=f"{g}," if g else "", part=f"PARTITION BY {g}" if g else "", src=src)
    return sql if not name else sql.replace("c AS", f"{name}c AS", 1).replace("FROM c)", f"FROM {name}c)").replace("r AS (SELECT *, sum", f"{name}r AS (SELECT *, sum").replace("FROM r WINDOW", f"FROM {name}r WINDOW").replace("km AS (", f"{name} AS (")


_G = _km("1 - event", name="g")
_GT = f"gt AS (SELECT t, greatest(coalesce((SELECT s FROM g WHERE duration_months <= t ORDER BY duration_months DESC LIMIT 1), 1.0), 0.001) AS gt FROM (SELECT unnest({TIMES}) AS t))"
_GD = "rows AS (SELECT l.*, greatest(g.s, 0.001) AS g, risk / 2 AS hazard FROM loans l JOIN g USING (duration_months))"


@query(f"{LOANS}, {_km()} SELECT duration_months, at_risk AS n_at_risk, d AS n_events, round(s, 8) AS survival FROM km")
def km_overall(spark, sf_dir):
    return survival.kaplan_meier(loans(spark, sf_dir))


@query(f"{LOANS}, {_km(g='purpose')} SELECT purpose, duration_months, at_risk AS n_at_risk, d AS n_events, round(s, 8) AS survival FROM km")
def km_by_group(spark, sf_dir):
    return survival.kaplan_meier(loans(spark, sf_dir), ["purpose"])


@query(f"{LOANS}, {_G}, {_GT} SELECT t, round(gt, 6) AS survival, gt <= 0.001 AS floor_binds FROM gt")
def censoring_g(spark, sf_dir):
    df = loans(spark, sf_dir)
    g = survival.at_times(evaluate.censoring(df), TIMES, floor=evaluate.G_FLOOR)
    return g.select("t", F.round("survival", 6).alias("survival"), "floor_binds")


_SEED = "('0x' || substr(sha256('{seed}:' || {key}), 1, 8))::BIGINT"
_PP = "p AS (SELECT id, unnest(range(1, n + 1))::INT AS period, n, e FROM (SELECT id, greatest(ceil(least(duration_months, {h}) / {m}.0), 1)::INT AS n, CASE WHEN duration_months > {h} THEN 0 ELSE event END AS e FROM loans))"


@query(f"{LOANS}, {_PP.format(h=1000, m=1)} SELECT period, count(*) AS rows, sum((period = n AND e = 1)::INT)::BIGINT AS y, sum(1.0::DOUBLE) AS weight FROM p GROUP BY 1")
def person_period(spark, sf_dir):
    return survival.person_period(loans(spark, sf_dir)).groupBy("period").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("y"), F.sum("weight").alias("weight"))


@query(f"{LOANS}, {_PP.format(h=24, m=3)} SELECT id, period, (period = n AND e = 1)::INT AS y FROM p")
def person_period_quarterly(spark, sf_dir):
    return survival.person_period(loans(spark, sf_dir), months=3, horizon=24).select("id", "period", "y")


@query(f"""{LOANS}, {_PP.format(h=1000, m=1)}, k AS (SELECT *, (period = n AND e = 1)::INT AS y FROM p)
SELECT id, period, y, CASE WHEN y = 1 THEN 1.0 ELSE 4.0 END::DOUBLE AS weight FROM k WHERE y = 1 OR {_SEED.format(seed=11, key="(id || ':' || period)")} < 1073741824""")
def person_period_subsample(spark, sf_dir):
    keep = sampling.row_seed(11, F.concat_ws(":", "id", "period")) < 2**30
    return survival.person_period(loans(spark, sf_dir), keep=keep, share=0.25).select("id", "period", "y", "weight")


@query(f"{LOANS} SELECT sum(greatest(ceil(duration_months / 3.0), 1))::BIGINT AS rows, max(greatest(ceil(duration_months / 3.0), 1))::BIGINT AS periods FROM loans")
def expansion_estimate(spark, sf_dir):
    return survival.expansion(loans(spark, sf_dir), 3)


@query(f"""{LOANS}, h AS (SELECT id, t AS period, risk / 2 * (1 + t / 24.0) AS hazard FROM loans, (SELECT unnest(range(1, 13))::INT AS t))
SELECT id, period, round(exp(sum(ln(1 - least(greatest(hazard, 1e-9), 1 - 1e-9))) OVER (PARTITION BY id ORDER BY period)), 8) AS survival FROM h""")
def survival_from_hazard(spark, sf_dir):
    rows = risky(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("period"), "hazard")
    return survival.survival_from_hazard(rows.withColumn("hazard", F.col("hazard") * (1 + F.col("period") / 24)), ["id"])


_NEAR = "(SELECT round(s, 8) FROM km ORDER BY abs(duration_months - ({x})), duration_months LIMIT 1)"


@query(f"{LOANS}, {_km()}, a AS (SELECT unnest(range(0, 31))::INT AS age) SELECT age, round(1 - {_NEAR.format(x='age + 12')} / {_NEAR.format(x='age')}, 6) AS probability FROM a")
def age_profile(spark, sf_dir):
    ages = spark.range(31).select(F.col("id").cast("int").alias("age"))
    return survival.conditional_default(survival.kaplan_meier(loans(spark, sf_dir)), ages, 12)


@query(f"""{LOANS}, {_km(g='grade')} SELECT grade, round(1 - arg_min(round(s, 8), (abs(duration_months - 24), duration_months)) / arg_min(round(s, 8), (abs(duration_months - 12), duration_months)), 6) AS probability FROM km GROUP BY 1""")
def conditional_default(spark, sf_dir):
    """By grade: default within 12 months, for loans that are 12 months old."""
    curve = survival.kaplan_meier(loans(spark, sf_dir), ["grade"])
    near = lambda x: F.min_by("survival", F.struct(F.abs(F.col("duration_months") - x), F.col("duration_months")))
    return curve.groupBy("grade").agg(F.round(1 - near(24) / near(12), 6).alias("probability"))


@query(f"""{LOANS}, {_G}, {_GT}, {_GD}, x AS (SELECT t, risk, sum(CASE WHEN duration_months <= t AND event = 1 THEN 1 / g ELSE 0 END) AS w, count_if(duration_months <= t AND event = 1) AS a, count_if(duration_months > t) AS b FROM rows, gt GROUP BY ALL),
y AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY t ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x)
SELECT t, round(sum(w * (below + b / 2)) / (sum(w) * sum(b)), 6) AS auc, sum(a)::BIGINT AS n_cases, sum(b)::BIGINT AS n_controls, any_value(gt) > 0.001 AS reliable, round(any_value(gt), 6) AS g_at_t FROM y JOIN gt USING (t) GROUP BY t""")
def td_auc(spark, sf_dir):
    return evaluate.cumulative_auc(risky(spark, sf_dir), TIMES)


_BRIER = f"""{LOANS}, {_G}, {_GT}, {_GD}, bs AS (SELECT t, round(sum(CASE WHEN duration_months <= t AND event = 1 THEN pow(1 - hazard, t) ** 2 / g WHEN duration_months > t THEN (1 - pow(1 - hazard, t)) ** 2 / gt ELSE 0 END) / count(*), 6) AS brier,
count_if((duration_months <= t AND event = 1) OR duration_months > t)::BIGINT AS n_contributing FROM rows, gt GROUP BY t)"""


@query(f"{_BRIER} SELECT * FROM bs")
def brier_ipcw(spark, sf_dir):
    return evaluate.brier(risky(spark, sf_dir), TIMES)


@query(f"{_BRIER}, p AS (SELECT t, brier, lag(t) OVER (ORDER BY t) AS t0, lag(brier) OVER (ORDER BY t) AS b0 FROM bs) SELECT round(sum((t - t0) * (brier + b0) / 2) / (max(t) - min(t)), 6) AS integrated FROM p")
def ibs(spark, sf_dir):
    return evaluate.integrated(evaluate.brier(risky(spark, sf_dir), TIMES), "brier")


@query(f"""{LOANS}, c AS (SELECT duration_months AS d, event AS e, risk AS r, count(*) AS n FROM loans GROUP BY ALL)
SELECT round(sum(a.n * b.n * CASE WHEN a.r > b.r THEN 1 WHEN a.r = b.r THEN 0.5 ELSE 0 END) / sum(a.n * b.n), 6)::DOUBLE AS concordance, sum(a.n * b.n)::BIGINT AS n_pairs FROM c a JOIN c b ON a.e = 1 AND (b.d > a.d OR (b.d = a.d AND b.e = 0))""")
def concordance(spark, sf_dir):
    return evaluate.concordance(risky(spark, sf_dir))


_CAL = f"""{LOANS}, s AS (SELECT id, duration_months, event, pow(1 - risk / 2, 12) AS s FROM loans), k AS (SELECT *, row_number() OVER (ORDER BY s, id) AS r, count(*) OVER () AS n FROM s),
b AS (SELECT *, greatest(((r - 1) * 10 + n - 2) // (n - 1) - 1, 0)::INT AS bin FROM k), {_km(g='bin', src='b')},
o AS (SELECT bin, coalesce(arg_max(round(s, 8), duration_months) FILTER (duration_months <= 12), 1.0) AS o FROM km GROUP BY 1), m AS (SELECT bin, count(*) AS n, round(avg(s), 6) AS p FROM b GROUP BY 1)
SELECT bin, n, p AS predicted_survival, round(o, 6) AS observed_survival, round(p - round(o, 6), 6) AS error FROM m JOIN o USING (bin) WHERE n >= 2"""


@query(_CAL)
def calibration_deciles(spark, sf_dir):
    df = risky(spark, sf_dir).withColumn("s", F.pow(1 - F.col("hazard"), F.lit(12)))
    return evaluate.calibration(df, 12)


_CALV = f"""{LOANS}, s AS (SELECT issue_year, id, duration_months, event, pow(1 - risk / 2, 12) AS s FROM loans), k AS (SELECT *, row_number() OVER (PARTITION BY issue_year ORDER BY s, id) AS r, count(*) OVER (PARTITION BY issue_year) AS n, max(duration_months) OVER (PARTITION BY issue_year) AS last FROM s),
b AS (SELECT *, issue_year * 100 + greatest(((r - 1) * 10 + n - 2) // (n - 1) - 1, 0)::INT AS g FROM k WHERE n > 1 AND last >= 12), {_km(g='g', src='b')},
o AS (SELECT g, coalesce(arg_max(round(s, 8), duration_months) FILTER (duration_months <= 12), 1.0) AS o FROM km GROUP BY 1), m AS (SELECT g, count(*) AS n, round(avg(s), 6) AS p FROM b GROUP BY 1)
SELECT (g // 100)::INT AS issue_year, (g % 100)::INT AS bin, n, p AS predicted_survival, round(o, 6) AS observed_survival, round(p - round(o, 6), 6) AS error FROM m JOIN o USING (g) WHERE n >= 2"""


@query(_CALV)
def calibration_by_vintage(spark, sf_dir):
    """Calibration at 12 months within each year of issue that was observed so long."""
    df = risky(spark, sf_dir).withColumn("s", F.pow(1 - F.col("hazard"), F.lit(12)))
    return evaluate.calibration(df, 12, by=["issue_year"])


@query(f"""{LOANS}, {_km('1 - event', g='issue_year', name='g')}, gt AS (SELECT issue_year, t, greatest(coalesce(arg_max(s, duration_months) FILTER (duration_months <= t), 1.0), 0.001) AS gt FROM g, (SELECT unnest([12, 24]) AS t) GROUP BY ALL),
rows AS (SELECT l.*, greatest(g.s, 0.001) AS g, risk / 2 AS hazard FROM loans l JOIN g USING (issue_year, duration_months))
SELECT issue_year, t, round(sum(CASE WHEN duration_months <= t AND event = 1 THEN pow(1 - hazard, t) ** 2 / g WHEN duration_months > t THEN (1 - pow(1 - hazard, t)) ** 2 / gt ELSE 0 END) / count(*), 6) AS brier,
count_if((duration_months <= t AND event = 1) OR duration_months > t)::BIGINT AS n_contributing FROM rows JOIN gt USING (issue_year) GROUP BY ALL""")
def eval_by_vintage(spark, sf_dir):
    return evaluate.brier(risky(spark, sf_dir), [12, 24], ["issue_year"])


_VT = f"""{LOANS}, {_km('1 - event', g='issue_year', name='g')}, gt AS (SELECT issue_year, t, greatest(coalesce(arg_max(s, duration_months) FILTER (duration_months <= t), 1.0), 0.001) AS gt FROM g, (SELECT unnest([12, 24]) AS t) GROUP BY ALL),
rows AS (SELECT l.*, greatest(g.s, 0.001) AS g FROM loans l JOIN g USING (issue_year, duration_months)),
x AS (SELECT issue_year, t, risk, sum(CASE WHEN duration_months <= t AND event = 1 THEN 1 / g ELSE 0 END) AS w, count_if(duration_months <= t AND event = 1) AS a, count_if(duration_months > t) AS b FROM rows JOIN gt USING (issue_year) GROUP BY ALL),
y AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY issue_year, t ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x),
au AS (SELECT issue_year, t, round(CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(w * (below + b / 2)) / (sum(w) * sum(b)) END, 6) AS auc, sum(a)::BIGINT AS n_cases, sum(b)::BIGINT AS n_controls FROM y GROUP BY ALL),
c AS (SELECT issue_year, duration_months AS d, event AS e, risk AS r, count(*) AS n FROM loans GROUP BY ALL),
cc AS (SELECT a.issue_year, round(sum(a.n * b.n * CASE WHEN a.r > b.r THEN 1 WHEN a.r = b.r THEN 0.5 ELSE 0 END) / sum(a.n * b.n), 6)::DOUBLE AS concordance FROM c a JOIN c b ON a.issue_year = b.issue_year AND a.e = 1 AND (b.d > a.d OR (b.d = a.d AND b.e = 0)) GROUP BY 1)"""


@query(f"{_VT} SELECT issue_year, t, auc, n_cases, n_controls, concordance FROM au LEFT JOIN cc USING (issue_year)")
def vintage_ranking(spark, sf_dir):
    """AUC and concordance of each year of issue."""
    df = risky(spark, sf_dir)
    auc = evaluate.cumulative_auc(df, [12, 24], ["issue_year"]).select("issue_year", "t", "auc", "n_cases", "n_controls")
    return auc.join(evaluate.concordance(df, ["issue_year"]).select("issue_year", "concordance"), "issue_year", "left")
