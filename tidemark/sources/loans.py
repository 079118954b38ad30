"""Loan-shaped views of the order tables: one order is one loan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parse import EMPLOYMENT, MONTH_FORMATS
from tidemark.sources.tables import table

#: The statuses of open orders by priority.
_OPEN = ("Current", "Issued", "In Grace Period", "Late (16-30 days)", "Late (31-120 days)")


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns as a lender's file has them, with every status, format and gap."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("last_ship"), F.round(100 * F.avg(F.col("l_discount") + F.col("l_tax")), 4).alias("dti")
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("addr_state"))
    customers = table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment", "addr_state")
    o = table(spark, sf_dir, "orders").join(items, "o_orderkey", "left").join(customers, "o_custkey", "left")
    key = F.col("o_orderkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int"))
    issue = F.when(key % 211 == 0, "not-a-date").otherwise(reduce(lambda x, k: x.when(key % 6 == k, F.date_format("o_orderdate", MONTH_FORMATS[k])), range(1, 6), F.when(key % 6 == 0, F.date_format("o_orderdate", MONTH_FORMATS[0]))))
    closed = ("  charged off  ", "Default", "Charged Off", "Charged Off", "Charged Off")
    number = F.substring("o_orderpriority", 1, 1).cast("int") + F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 5).otherwise(10)
    state = pick((*closed, *["Fully Paid"] * 5, *_OPEN), number)
    whole = F.round("o_totalprice").cast("long")
    amount = F.when(key % 7 == 0, F.concat(F.lit("$"), whole.cast("string"))).when(key % 7 == 1, F.format_number(whole, 0)).when(key % 7 == 2, F.concat((whole % 100).cast("string"), F.lit("%")))
    amount = amount.when(key % 7 == 3, "").when(key % 7 == 4, "n/a").when(key % 7 == 5, F.concat(whole.cast("string"), F.lit("d"))).otherwise(whole.cast("string"))
    employment = pick((*EMPLOYMENT, None), F.col("o_custkey") % 12 + 1)
    return o.select(
        key.alias("id"), "o_custkey", "o_orderdate", issue.alias("issue_d"), F.date_format("last_ship", "MMM-yyyy").alias("last_pymnt_d"),
        F.concat(F.when(key % 97 == 0, "Does not meet the credit policy. Status:").otherwise(""), state).alias("loan_status"),
        F.when(key % 101 == 0, None).when(key % 2 == 0, " 36 months").otherwise(" 60 months").alias("term"),
        F.col("o_totalprice").alias("loan_amnt"), ((F.col("c_acctbal") + 1000) * 20).alias("annual_inc"), "dti", employment.alias("emp_length"),
        F.col("c_mktsegment").alias("purpose"), "addr_state", F.col("o_orderpriority").alias("grade"), F.col("o_orderstatus").alias("population"),
        amount.alias("amount_text"), F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 120).cast("int")).alias("mths_since_delinq"),
    )


#: The same view for DuckDB, as the first parts of a WITH.
RAW_SQL = r"""
items AS (SELECT l_orderkey, max(l_shipdate) AS last_ship, round(100 * avg(l_discount + l_tax), 4) AS dti FROM lineitem GROUP BY 1),
raw AS (
  SELECT o_orderkey AS id, o_custkey, o_orderdate,
    CASE WHEN o_orderkey % 211 = 0 THEN 'not-a-date' ELSE CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%b-%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%b-%y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%d-%b-%Y') ELSE strftime(o_orderdate, '%m/%d/%Y') END END AS issue_d,
    strftime(last_ship, '%b-%Y') AS last_pymnt_d,
    CASE WHEN o_orderkey % 97 = 0 THEN 'Does not meet the credit policy. Status:' ELSE '' END ||
    CASE o_orderstatus WHEN 'F' THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '  charged off  ' WHEN '2' THEN 'Default' ELSE 'Charged Off' END
      WHEN 'P' THEN 'Fully Paid'
      ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Current' WHEN '2' THEN 'Issued' WHEN '3' THEN 'In Grace Period' WHEN '4' THEN 'Late (16-30 days)' ELSE 'Late (31-120 days)' END END AS loan_status,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN ' 36 months' ELSE ' 60 months' END AS term,
    o_totalprice AS loan_amnt, (c_acctbal + 1000) * 20 AS annual_inc, dti,
    CASE WHEN o_custkey % 12 = 11 THEN NULL WHEN o_custkey % 12 = 0 THEN '< 1 year' WHEN o_custkey % 12 = 1 THEN '1 year' WHEN o_custkey % 12 = 10 THEN '10+ years' ELSE (o_custkey % 12) || ' years' END AS emp_length,
    c_mktsegment AS purpose, n_name AS addr_state, o_orderpriority AS grade, o_orderstatus AS population,
    CASE o_orderkey % 7 WHEN 0 THEN '$' || round(o_totalprice)::BIGINT WHEN 1 THEN format('{:,}', round(o_totalprice)::BIGINT) WHEN 2 THEN (round(o_totalprice)::BIGINT % 100) || '%' WHEN 3 THEN '' WHEN 4 THEN 'n/a' WHEN 5 THEN round(o_totalprice)::BIGINT || 'd' ELSE (round(o_totalprice)::BIGINT)::VARCHAR END AS amount_text,
    CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 120)::INT END AS mths_since_delinq
  FROM orders LEFT JOIN items ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""


def months_sql(c: str) -> str:
    """A text column as the first of its month, in DuckDB."""
    shapes = {r"^[A-Za-z]{3}-\d{4}$": "%b-%Y", r"^\d{4}-\d{2}-\d{2}$": "%Y-%m-%d", r"^[A-Za-z]{3}-\d{2}$": "%b-%y", r"^\d{4}-\d{2}$": "%Y-%m", r"^\d{2}-[A-Za-z]{3}-\d{4}$": "%d-%b-%Y", r"^\d{2}/\d{2}/\d{4}$": "%m/%d/%Y"}
    return "date_trunc('month', CASE " + " ".join(f"WHEN regexp_matches({c}, '{s}') THEN try_strptime({c}, '{f}')" for s, f in shapes.items()) + " END)::DATE"
