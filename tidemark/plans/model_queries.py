"""Queries that fit models or read files: checked by properties in the tests, and streams' batch forms by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import matching
from tidemark.operators import boosting, cox, design, evaluate, label, models, selection, survival
from tidemark.plans.registry import query
from tidemark.plans.views import LOANS, accepted, loans
from tidemark.sources.loans import raw_loans
from tidemark.sources import tables
from tidemark.sources.store import spread, stored
from tidemark.sources.tables import guard, table

FEATURES = ["dti", "loan_amnt", "annual_inc"]
BOOSTED = ["dti", "loan_amnt", "annual_inc", "mths_since_delinq", "term_months", "fico_midpoint"]


def _design(spark, sf_dir):
    df = loans(spark, sf_dir).select("id", "duration_months", "event", *FEATURES)
    guard(df.select(*FEATURES))
    return stored(models.standardised(df, FEATURES))  # fits read it again and again


@query()
def hazard_fit(spark, sf_dir):
    """Survival at 12 months by the fitted discrete hazard, and its mean by predicted decile."""
    df = _design(spark, sf_dir)
    model = models.fit_hazard(df, FEATURES)
    s = survival.survival_from_hazard(model.hazards(df, 4, ["id"]), ["id"]).where("period = 4").select("id", F.col("survival").alias("s"))
    return evaluate.calibration(df.join(s, "id"), 12)


_boosted: dict[tuple[str, str], tuple] = {}


def boosted(spark, sf_dir):
    """Loans, and hazard trees on their raw features with gaps and a category; a fifth of the loans only validates. Fitted once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _boosted:
        return _boosted[key]
    raw = raw_loans(spark, sf_dir).select("id", "o_custkey", "issue_d", "last_pymnt_d", "loan_status", "term", "loan_amnt", "annual_inc", "dti", "purpose", "mths_since_delinq")  # what is stored on the way
    df = label.survival_target(raw).withColumn("fico_midpoint", (602 + F.col("o_custkey") % 200).cast("double"))
    df = stored(df.select("id", "duration_months", "event", "purpose", *[F.col(f).cast("double").alias(f) for f in BOOSTED]))
    guard(df.select(*BOOSTED, "purpose"))
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    _boosted[key] = df, boosting.fit_boosting(df.where(~held), BOOSTED, ["purpose"], valid=df.where(held), months=3, horizon=36, trees=30, leaves=15, depth=4, rate=0.2, least=20, patience=4)
    return _boosted[key]


@query()
def hazard_boosting(spark, sf_dir):
    """Loss on training and validation loans by number of trees; kept: the trees that the model has."""
    _, model = boosted(spark, sf_dir)
    return spark.createDataFrame([(n, train, valid, n <= len(model.trees)) for n, train, valid in model.history], "trees int, train_loss double, valid_loss double, kept boolean")


@query()
def hazard_trees_importance(spark, sf_dir):
    _, model = boosted(spark, sf_dir)
    total = sum(g for _, g, _ in model.importance()) or 1.0
    return spark.createDataFrame([(f, g / total, n) for f, g, n in model.importance()], "feature string, gain double, splits int")


@query()
def hazard_trees_survival(spark, sf_dir):
    """Survival at 12 months by the hazard trees, and its mean by predicted decile."""
    df, model = boosted(spark, sf_dir)
    return evaluate.calibration(model.survived(spread(df), 4, ["id", "duration_months", "event"]).withColumn("s", F.round("survival", 8)), 12)


def _split(spark, sf_dir):
    """Loans with a constant, a column that another explains, gaps and a rare level; even ids train."""
    df = loans(spark, sf_dir).select("id", "event", "duration_months", F.col("dti").cast("double").alias("dti"), F.col("loan_amnt").cast("double").alias("loan_amnt"), F.col("mths_since_delinq").cast("double").alias("gap"), F.when(F.col("id") % 1999 == 0, "RARE").otherwise(F.col("purpose")).alias("purpose"))
    df = df.withColumns({"constant": F.lit(7.0), "twice": F.col("loan_amnt") * 2 + 3})
    numbers = ["dti", "loan_amnt", "gap", "constant", "twice", "nowhere"]
    train = df.where("id % 2 = 0")
    return df, design.fit_design(train, numbers, ["purpose"], ["gap"], least=5, total=20)


_SPLIT = f"""{LOANS}, l AS (SELECT id, event, dti::DOUBLE AS dti, loan_amnt::DOUBLE AS loan_amnt, mths_since_delinq::DOUBLE AS gap, CASE WHEN id % 1999 = 0 THEN 'RARE' ELSE purpose END AS purpose FROM loans), tr AS (SELECT * FROM l WHERE id % 2 = 0),
md AS (SELECT median(dti) AS d, median(loan_amnt) AS a, median(gap) AS g FROM tr), st AS (SELECT d, a, g, avg(coalesce(dti, d)) AS dm, stddev_samp(coalesce(dti, d)) AS ds, avg(loan_amnt) AS am, stddev_samp(loan_amnt) AS sa, avg(coalesce(gap, g)) AS gm, stddev_samp(coalesce(gap, g)) AS gs FROM tr, md GROUP BY d, a, g),
ev AS (SELECT purpose, sum(event) AS e, sum(sum(event)) OVER () AS all_e, row_number() OVER (ORDER BY purpose) AS k FROM tr WHERE purpose IS NOT NULL GROUP BY purpose)"""


@query(f"""{_SPLIT} SELECT unnest(['dti', 'loan_amnt', 'gap', 'constant', 'twice', 'nowhere', 'gap_missing']) AS "column", unnest([NULL, NULL, NULL, 'zero variance', 'explained by the columns before it', 'absent from input', NULL]) AS dropped, unnest([round(d, 6), round(a, 6), round(g, 6), 7, round(2 * a + 3, 6), NULL, NULL]) AS fill, unnest([round(dm, 6), round(am, 6), round(gm, 6), 7, round(2 * am + 3, 6), NULL, NULL]) AS mean, unnest([round(ds, 6), round(sa, 6), round(gs, 6), 1, round(2 * sa, 6), NULL, NULL]) AS deviation FROM st
UNION ALL SELECT 'purpose_' || purpose, CASE WHEN all_e >= 20 AND e < 5 THEN e || ' events in this level, fewer than 5; in the reference level' END, NULL, NULL, NULL FROM ev WHERE k > 1""")
def design_fit(spark, sf_dir):
    """What the encoding learned from the training split, and what it left out and why."""
    _, made = _split(spark, sf_dir)
    names = [*made.numbers, *(c for c in made.dropped if c not in made.numbers), *(c for c in made.columns if c not in made.numbers)]
    rows = [(c, made.dropped.get(c), *(round(x, 6) for x in made.numbers.get(c, ()))) if c in made.numbers else (c, made.dropped.get(c), None, None, None) for c in names]
    return spark.createDataFrame(rows, "column string, dropped string, fill double, mean double, deviation double")


@query(f"""{_SPLIT} SELECT id, round((coalesce(dti, d) - dm) / ds, 6) + 0.0 AS dti, round((coalesce(loan_amnt, a) - am) / sa, 6) + 0.0 AS loan_amnt, round((coalesce(gap, g) - gm) / gs, 6) + 0.0 AS gap, (gap IS NULL)::INT::DOUBLE AS gap_missing, (SELECT string_agg(p.purpose, ',') FROM ev p WHERE p.k > 1 AND NOT (p.all_e >= 20 AND p.e < 5) AND p.purpose = l.purpose) AS level FROM l, st WHERE id % 2 = 1""")
def design_encode(spark, sf_dir):
    """The other split by the training split's encoding; level: the one of its columns that is 1."""
    df, made = _split(spark, sf_dir)
    encoded = made.encode(df.where("id % 2 = 1"), ["id"])
    ones = F.array_compact(F.array(*[F.when(F.col(f"purpose_{v}") == 1, v) for v in made.levels["purpose"] if f"purpose_{v}" in made.columns]))
    return encoded.select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("dti", "loan_amnt", "gap")], "gap_missing", F.when(F.size(ones) > 0, F.array_join(ones, ",")).alias("level"))


@query()
def cox_fit(spark, sf_dir):
    return cox.cox_table(spark, cox.fit_cox(_design(spark, sf_dir), FEATURES))


@query()
def cox_survival(spark, sf_dir):
    df = _design(spark, sf_dir)
    rows = cox.cox_survival(df, cox.fit_cox(df, FEATURES), [6, 12, 24, 36], ["id"])
    return rows.groupBy("t").agg(F.round(F.avg("survival"), 6).alias("mean_survival"), F.round(F.min("survival"), 6).alias("least"), F.round(F.max("survival"), 6).alias("most"))


@query()
def cox_ph_test(spark, sf_dir):
    df = _design(spark, sf_dir)
    return cox.proportional(spark, cox.fit_cox(df, FEATURES))


@query()
def separability(spark, sf_dir):
    """Accepted against rejected: AUC of the fitted propensity and its common support."""
    df = stored(models.propensity(accepted(spark, sf_dir).select("id", "accepted", *FEATURES), FEATURES, F.col("accepted")).select("accepted", "propensity"))  # three measures read it
    return selection.rank_auc(df, ["propensity"], F.col("accepted")).crossJoin(selection.common_support(df, "propensity", F.col("accepted")))


@query()
def separability_coefficients(spark, sf_dir):
    """What sets accepted and rejected apart: the propensity's coefficients on standardised features, the largest first."""
    _, coefficients = models.fit_propensity(accepted(spark, sf_dir).select("id", "accepted", *FEATURES), FEATURES, F.col("accepted"))
    return spark.createDataFrame(coefficients, "feature string, coefficient double")


@query("""SELECT * FROM (VALUES ('dti', 'dti', 1.0, 'exact', false, true), ('Loan Amount', 'loan_amnt', 0.99, 'synonym', false, true), ('YearlyIncome', 'annual_inc', 0.49, 'synonym', true, false), ('gross income', 'annual_inc', 0.49, 'synonym', true, false),
('kind', 'purpose', 0.8, 'known levels', false, true), ('Term', 'term_months', 0.99, 'synonym', false, true), ('emp length', 'emp_length', 0.9775, 'same name', false, true), ('addr state', 'addr_state', 0.2125, 'same name', true, false), ('state code', 'addr_state', 0.36, 'synonym', true, false), ('loan_amnt_text', NULL, 0.0, NULL, false, false)) AS t("column", feature, confidence, how, contested, preselected)""")
def match_columns(spark, sf_dir):
    """A file whose columns have other names: two claim one feature, one holds other values than its name says, one is known by its levels."""
    raw = raw_loans(spark, sf_dir)
    upload = raw.select(
        F.col("dti").cast("string").alias("dti"), F.col("loan_amnt").cast("string").alias("Loan Amount"), F.col("annual_inc").cast("string").alias("YearlyIncome"), F.col("annual_inc").cast("string").alias("gross income"),
        F.col("purpose").alias("kind"), F.col("term").alias("Term"), F.col("emp_length").alias("emp length"), F.lit(None).cast("string").alias("loan_amnt_text"), F.col("addr_state").alias("state code"), F.col("dti").cast("string").alias("addr state"),
    )
    levels = tuple(r[0] for r in raw.select("purpose").distinct().orderBy("purpose").collect())
    features = {"dti": matching.Content(0, 200), "loan_amnt": matching.Content(500, 600_000), "annual_inc": matching.Content(0, 500_000), "term_months": matching.Content(6, 84), "purpose": matching.Content(levels=levels), "emp_length": matching.Content(pattern=r"\byears?\b"), "addr_state": matching.Content(pattern="^[A-Z][A-Z]$")}
    return matching.match(upload, features, {"amount": ("loan_amnt",), "yearlyincome": ("annual_inc",), "grossincome": ("annual_inc",), "term": ("term_months",), "statecode": ("addr_state",)})


@query("""SELECT 'o_orderkey' AS "column", count(*) AS rows, count(o_orderkey) AS filled, count(*) - count(o_orderkey) AS missing FROM orders UNION ALL SELECT 'o_totalprice', count(*), count(o_totalprice), count(*) - count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(o_orderstatus), count(*) - count(o_orderstatus) FROM orders""")
def footer_counts(spark, sf_dir):
    """Rows and gaps of the order table's columns, from the files' footers alone."""
    return tables.footer_counts(spark, f"{sf_dir}/orders.parquet").where(F.col("column").isin("o_orderkey", "o_totalprice", "o_orderstatus"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """The batch form of the streaming window, over the same expression."""
    from tidemark.streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    from tidemark.streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
