"""The views that queries and oracles start from: raw loans, labelled loans, risks, attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import label
from tidemark.sources.loans import RAW_SQL, months_sql, raw_loans
from tidemark.sources.tables import table

TIMES = [6, 12, 24, 36]


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.survival_target(raw_loans(spark, sf_dir))


def risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans with a closed-form risk and monthly hazard, so that measures can be checked in SQL."""
    return loans(spark, sf_dir).withColumn("risk", F.round(F.lit(0.01) + F.coalesce("dti", F.lit(5.0)) / 400 + F.col("loan_amnt") / 20_000_000, 3)).withColumn("hazard", F.col("risk") / 2)


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw loans with `accepted`: orders that are not open."""
    return raw_loans(spark, sf_dir).withColumn("accepted", F.col("population").isin("F", "P"))


#: Order lines of a task, each of which becomes a row per time in its sorts.
LINES = 250_000


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, feature, t, phi), closed form, one row per order, line number and t.

    Lines are dealt by order to tasks of about `LINES` once; what goes by row_id later needs no further shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES))
    base = lines.repartition(parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("row_id"), "l_linenumber").agg(F.round(F.avg("l_discount"), 6).alias("d"), F.round(F.avg("l_tax"), 6).alias("x"))
    phi = F.round((F.col("d") - 0.05) * F.col("t") * (1 + F.col("l_linenumber")) / 10 - F.col("x") * F.col("t") / (5 + F.col("l_linenumber")), 6)
    return base.withColumn("t", F.explode(F.array(*map(F.lit, TIMES)))).select("row_id", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"), "t", phi.alias("phi"))


def labelled_sql(late: bool = False, exceptions: bool = False) -> str:
    """The parts of a WITH up to `lab` (all rows, with reason) and `loans` (the kept ones)."""
    p = "does not meet the credit policy. status:"
    return rf"""{RAW_SQL},
l0 AS (SELECT *, lower(trim(regexp_replace(translate(loan_status, chr(160) || '–—', ' --'), '\s+', ' ', 'g'))) AS st, {months_sql('issue_d')} AS issue_month, {months_sql('last_pymnt_d')} AS last_pymnt_month,
  nullif(regexp_extract(term, '(\d+)', 1), '')::INT AS term_months FROM raw),
l1 AS (SELECT *, starts_with(st, '{p}') AS ex, CASE WHEN starts_with(st, '{p}') THEN trim(substr(st, {len(p) + 1})) ELSE st END AS plain FROM l0),
l2 AS (SELECT *, CASE WHEN loan_status IS NULL OR trim(loan_status) = '' {"" if exceptions else "OR ex"} THEN 'excluded' WHEN plain IN ('charged off', 'default') THEN 'event' WHEN plain = 'fully paid' THEN 'censored_payoff'
  WHEN plain IN ('current', 'issued') THEN 'censored_admin' WHEN plain IN ('in grace period', 'late (16-30 days)') THEN 'censored_delinquent' WHEN plain = 'late (31-120 days)' THEN '{"event" if late else "censored_delinquent"}' END AS outcome FROM l1),
cut AS (SELECT greatest(max(last_pymnt_month), max(issue_month)) AS cutoff FROM l2),
l3 AS (SELECT l2.*, outcome = 'event' AND last_pymnt_month IS NULL AS never_paid, (outcome = 'event')::INT AS event,
  CASE WHEN outcome = 'event' AND last_pymnt_month IS NULL THEN (issue_month + INTERVAL 1 MONTH)::DATE WHEN outcome = 'censored_admin' THEN cutoff ELSE last_pymnt_month END AS end_month FROM l2, cut),
l4 AS (SELECT *, ((year(end_month) - year(issue_month)) * 12 + month(end_month) - month(issue_month))::INT AS raw_months FROM l3),
l5 AS (SELECT *, CASE WHEN raw_months IS NOT NULL THEN greatest(raw_months, 1) END AS duration_months, coalesce(raw_months < 1, false) AS floored FROM l4),
lab AS (SELECT *, CASE WHEN outcome = 'excluded' THEN 'excluded_status' WHEN issue_month IS NULL THEN 'missing_issue_d' WHEN term_months IS NULL THEN 'missing_term' WHEN end_month IS NULL THEN 'missing_end_date'
  WHEN duration_months > term_months + 12 THEN 'term_overrun' END AS reason FROM l5),
loans AS (SELECT *, year(issue_month)::INT AS issue_year, round(0.01 + coalesce(dti, 5.0) / 400 + loan_amnt / 20000000, 3) AS risk FROM lab WHERE reason IS NULL)"""


LOANS = "WITH " + labelled_sql()
RAW = "WITH " + RAW_SQL
PHI = """WITH b AS (SELECT l_orderkey AS row_id, l_linenumber, round(avg(l_discount), 6) AS d, round(avg(l_tax), 6) AS x FROM lineitem GROUP BY ALL),
phi AS (SELECT row_id, 'f' || l_linenumber AS feature, t, round((d - 0.05) * t * (1 + l_linenumber) / 10 - x * t / (5 + l_linenumber), 6) AS phi FROM b, (SELECT unnest([6, 12, 24, 36]) AS t))"""
