"""Queries over raw text, labels, profiles, cleaning and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import clean, label, profile, sampling
from tidemark.plans.registry import query
from tidemark.plans.views import LOANS, RAW, labelled_sql, loans
from tidemark.sources.loans import months_sql, raw_loans
from tidemark.sources.tables import table

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_STRIPPED = "regexp_replace(trim(amount_text), '[,%$]', '', 'g')"
_READ = f"CASE WHEN regexp_matches({_STRIPPED}, '{_NUMBER}') THEN {_STRIPPED}::DOUBLE END"
_DIRECT = f"CASE WHEN regexp_matches(trim(amount_text), '{_NUMBER}') THEN trim(amount_text)::DOUBLE END"
_MISSING = "('', 'n/a', 'N/A', 'NA', 'null', 'NULL', 'none', 'None')"
_TERM = r"^(\d{1,3})(?:\.0+)?\s*(?:-?\s*(?:months?|mos?\.?|mths?|m))?$"
NUMERIC = ["loan_amnt", "annual_inc", "dti", "duration_months"]
CATEGORICAL = ["purpose", "grade", "addr_state", "emp_length"]


def _union(columns: list[str], source: str, value: str = "{c}") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {value.format(c=c)} AS value FROM {source}" for c in columns)


# -- text


@query(f"{RAW} SELECT id, amount_text, {_READ} AS amount, {_DIRECT} IS NULL AND {_READ} IS NOT NULL AS rescued FROM raw")
def coerce_numeric_text(spark, sf_dir):
    c = F.col("amount_text")
    return raw_loans(spark, sf_dir).select("id", "amount_text", parse.number(c).alias("amount"), parse.rescued(c).alias("rescued"))


@query(rf"""{RAW}, v AS ({_union(["amount_text", "emp_length"], "raw")}), s AS (SELECT *, trim(value) AS t, regexp_replace(trim(value), '[,%$]', '', 'g') AS p FROM v),
r AS (SELECT *, regexp_matches(p, '{_NUMBER}') AS ok, regexp_matches(t, '{_NUMBER}') AS direct, t IN {_MISSING} OR t IS NULL AS gone FROM s)
SELECT "column", 'rescued' AS rule, count_if(ok AND NOT direct)::BIGINT AS count, '' AS detail FROM r GROUP BY 1
UNION ALL SELECT "column", 'unreadable', count_if(NOT gone AND NOT ok)::BIGINT, coalesce(array_to_string(list_sort(list_distinct(list(substr(t, 1, 40)) FILTER (NOT gone AND NOT ok)))[1:3], ', '), '') FROM r GROUP BY 1
UNION ALL SELECT "column", 'missing_after', count_if(ok IS NULL OR NOT ok)::BIGINT, '' FROM r GROUP BY 1""")
def coerce_report(spark, sf_dir):
    return clean.numeric_report(raw_loans(spark, sf_dir), ["amount_text", "emp_length"])


@query(rf"""{RAW}, t AS (SELECT id, term, CASE id % 5 WHEN 0 THEN trim(term) || '.' WHEN 1 THEN replace(term, ' months', '.0 mo') WHEN 2 THEN upper(term) WHEN 3 THEN replace(term, ' months', 'm') ELSE term END AS text FROM raw)
SELECT id, text, nullif(regexp_extract(lower(trim(text)), '{_TERM}', 1), '')::INT AS strict, nullif(regexp_extract(text, '(\d+)', 1), '')::INT AS loose FROM t""")
def parse_term(spark, sf_dir):
    term, key = F.col("term"), F.col("id") % 5
    text = F.when(key == 0, F.concat(F.trim(term), F.lit("."))).when(key == 1, F.replace(term, F.lit(" months"), F.lit(".0 mo"))).when(key == 2, F.upper(term)).when(key == 3, F.replace(term, F.lit(" months"), F.lit("m"))).otherwise(term)
    return raw_loans(spark, sf_dir).select("id", text.alias("text")).select("id", "text", parse.term_months(F.col("text")).alias("strict"), parse.first_digits(F.col("text")).alias("loose"))


@query(f"{RAW} SELECT id, issue_d, strftime({months_sql('issue_d')}, '%Y-%m-%d') AS issue_month, strftime({months_sql('last_pymnt_d')}, '%Y-%m-%d') AS last_month FROM raw")
def parse_month_formats(spark, sf_dir):
    return raw_loans(spark, sf_dir).select("id", "issue_d", F.date_format(parse.month(F.col("issue_d")), "yyyy-MM-dd").alias("issue_month"), F.date_format(parse.month(F.col("last_pymnt_d")), "yyyy-MM-dd").alias("last_month"))


@query(f"{LOANS} SELECT loan_status, st AS status, outcome, count(*) AS loans FROM l2 GROUP BY ALL")
def normalise_status(spark, sf_dir):
    c = F.col("loan_status")
    return raw_loans(spark, sf_dir).groupBy("loan_status").agg(F.count(F.lit(1)).alias("loans")).select("loan_status", parse.status(c).alias("status"), parse.outcome(c).alias("outcome"), "loans")


# -- scalar features


@query(f"""{RAW} SELECT id, CASE WHEN annual_inc <> 0 THEN round(loan_amnt / annual_inc, 8) END AS loan_to_income, round(ln(1 + greatest(annual_inc, 0)), 8) AS log_annual_inc,
round((600 + o_custkey % 200 + 604 + o_custkey % 200) / 2.0, 4)::DOUBLE AS fico_midpoint, (mths_since_delinq IS NULL)::INT AS mths_since_delinq_missing FROM raw""")
def derive_ratios(spark, sf_dir):
    low = 600 + F.col("o_custkey") % 200
    return raw_loans(spark, sf_dir).select("id", F.round(parse.ratio(F.col("loan_amnt"), F.col("annual_inc")), 8).alias("loan_to_income"), F.round(F.log1p(F.greatest("annual_inc", F.lit(0.0))), 8).alias("log_annual_inc"), F.round((low + low + 4) / 2, 4).alias("fico_midpoint"), F.col("mths_since_delinq").isNull().cast("int").alias("mths_since_delinq_missing"))


@query(f"""{RAW}, r AS (SELECT id, loan_amnt, (id % 4 * 5)::DOUBLE AS rate, CASE WHEN id % 2 = 0 THEN 36 ELSE 60 END AS n FROM raw)
SELECT id, round(CASE WHEN rate = 0 THEN loan_amnt / n ELSE loan_amnt * (rate / 1200) / (1 - pow(1 + rate / 1200, -n)) END, 6) AS installment FROM r""")
def derive_installment(spark, sf_dir):
    n = F.when(F.col("id") % 2 == 0, 36).otherwise(60)
    return raw_loans(spark, sf_dir).select("id", F.round(parse.instalment(F.col("loan_amnt"), (F.col("id") % 4 * 5).cast("double"), n), 6).alias("installment"))


@query(f"""{RAW} SELECT CASE WHEN annual_inc < 0 OR annual_inc IS NULL THEN NULL WHEN annual_inc < 30000 THEN '<30k' WHEN annual_inc < 50000 THEN '30-50k' WHEN annual_inc < 75000 THEN '50-75k' WHEN annual_inc < 100000 THEN '75-100k' WHEN annual_inc < 150000 THEN '100-150k' ELSE '150k+' END AS band,
CASE emp_length WHEN '< 1 year' THEN 0.5 WHEN '1 year' THEN 1 WHEN '10+ years' THEN 10 ELSE substr(emp_length, 1, 1)::INT END::DOUBLE AS years, count(*) AS loans FROM raw GROUP BY ALL""")
def income_band(spark, sf_dir):
    return raw_loans(spark, sf_dir).groupBy(parse.income_band(F.col("annual_inc")).alias("band"), parse.employment_years(F.col("emp_length")).alias("years")).agg(F.count(F.lit(1)).alias("loans"))


@query(f"{RAW}, q AS (SELECT quantile_cont(annual_inc, 0.01) AS lo, quantile_cont(annual_inc, 0.99) AS hi FROM raw) SELECT id, round(least(greatest(annual_inc, lo), hi), 6) AS annual_inc_clipped FROM raw, q")
def winsorise(spark, sf_dir):
    return clean.winsorised(raw_loans(spark, sf_dir).select("id", "annual_inc"), "annual_inc").select("id", F.round("annual_inc_clipped", 6).alias("annual_inc_clipped"))


@query(f"{RAW} SELECT " + ", ".join(f"count_if({c} IS NULL)::BIGINT AS {c}_missing" for c in ("term", "emp_length", "mths_since_delinq", "dti")) + " FROM raw")
def missing_indicators(spark, sf_dir):
    return raw_loans(spark, sf_dir).agg(*[F.sum(F.col(c).isNull().cast("int")).alias(f"{c}_missing") for c in ("term", "emp_length", "mths_since_delinq", "dti")])


# -- labels

_TARGET = "SELECT id, outcome, strftime(issue_month, '%Y-%m-%d') AS issue_month, strftime(end_month, '%Y-%m-%d') AS observation_end_month, term_months, never_paid, raw_months AS duration_raw_months, duration_months, floored AS duration_floored, event, issue_year FROM loans"


def _target(df):
    return df.select("id", "outcome", F.date_format("issue_month", "yyyy-MM-dd").alias("issue_month"), F.date_format("observation_end_month", "yyyy-MM-dd").alias("observation_end_month"), "term_months", "never_paid", "duration_raw_months", "duration_months", "duration_floored", "event", "issue_year")


@query(f"{LOANS} {_TARGET}")
def label_survival_target(spark, sf_dir):
    return _target(loans(spark, sf_dir))


@query(f"WITH {labelled_sql(late=True, exceptions=True)} {_TARGET}")
def label_sensitivity_late(spark, sf_dir):
    return _target(label.survival_target(raw_loans(spark, sf_dir), label.LabelRule(late_is_event=True, with_exceptions=True)))


@query(f"""{LOANS} SELECT 'drop' AS kind, coalesce(reason, '(kept)') AS value, count(*) AS rows FROM lab GROUP BY ALL UNION ALL SELECT 'outcome', outcome, count(*) FROM lab GROUP BY ALL UNION ALL SELECT 'status', coalesce(loan_status, '(missing)'), count(*) FROM lab GROUP BY ALL""")
def label_audit_drops(spark, sf_dir):
    return label.audit(label.labelled(raw_loans(spark, sf_dir)))


@query(f"""{LOANS} SELECT count(*) AS n_input, count_if(reason IS NULL)::BIGINT AS n_retained, count_if(reason IS NOT NULL)::BIGINT AS n_dropped, count_if(never_paid)::BIGINT AS n_never_paid, count_if(floored)::BIGINT AS n_floored,
round(avg(event) FILTER (reason IS NULL), 6) AS event_rate, quantile_cont(duration_months, 0.5) FILTER (reason IS NULL) AS duration_median, max(duration_months) FILTER (reason IS NULL) AS duration_max FROM lab""")
def label_summary(spark, sf_dir):
    return label.summary(label.labelled(raw_loans(spark, sf_dir)))


@query(f"{LOANS} SELECT outcome, term_months, issue_year, count(*) AS loans, sum(event)::BIGINT AS events FROM loans GROUP BY ALL")
def label_outcome_counts(spark, sf_dir):
    return loans(spark, sf_dir).groupBy("outcome", "term_months", "issue_year").agg(F.count(F.lit(1)).alias("loans"), F.sum("event").alias("events"))


# -- profiles


@query(f"""{LOANS} SELECT count(*) AS rows, count(id) - count(DISTINCT id) AS duplicate_ids, strftime(min(issue_month), '%Y-%m-%d') AS first_month, strftime(max(issue_month), '%Y-%m-%d') AS last_month,
round(avg(event), 4) AS event_rate, quantile_cont(duration_months, 0.5) AS median_duration FROM loans""")
def eda_overview(spark, sf_dir):
    return profile.overview(loans(spark, sf_dir))


_MISS = ["term", "emp_length", "mths_since_delinq", "dti", "purpose"]


@query(f"""{RAW}, v AS ({_union(_MISS, "raw", "{c}::VARCHAR")}) SELECT "column", count_if(value IS NULL)::BIGINT AS missing, round(avg((value IS NULL)::INT), 4) AS missing_share, count(DISTINCT value) AS "distinct" FROM v GROUP BY 1""")
def eda_missing(spark, sf_dir):
    return profile.missing(raw_loans(spark, sf_dir), _MISS)


@query(f"""{LOANS}, v AS ({_union(NUMERIC, "loans", "{c}::DOUBLE")}) SELECT "column", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.25), 6) AS p25,
round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, round(skewness(value), 6) AS skew FROM v GROUP BY 1""")
def eda_numeric_summary(spark, sf_dir):
    return profile.numeric_summary(loans(spark, sf_dir), NUMERIC)


@query(f"""{RAW}, v AS ({_union(CATEGORICAL, "raw")}), c AS (SELECT "column", coalesce(trim(value), '(missing)') AS level, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS r, sum(n) OVER (PARTITION BY "column") AS total FROM c)
SELECT "column", level, n::BIGINT AS count, round(n / total, 4) AS share FROM r WHERE r <= 15
UNION ALL SELECT "column", '(other ' || count(*) || ' levels)', sum(n)::BIGINT, round(sum(n) / max(total), 4) FROM r WHERE r > 15 GROUP BY 1""")
def eda_categories_topn(spark, sf_dir):
    return profile.frequencies(raw_loans(spark, sf_dir), CATEGORICAL)


@query(f"""{LOANS}, v AS ({_union(NUMERIC, "loans", "{c}::DOUBLE")}), q AS (SELECT "column", quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.995) AS z FROM v GROUP BY 1)
SELECT "column", count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::BIGINT AS iqr_outliers, round(count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*), 4) AS iqr_share,
count_if(value < a OR value > z)::BIGINT AS beyond_tails, round(max(value) / max(CASE WHEN z > 0 THEN z END), 2) AS max_over_tail FROM v JOIN q USING ("column") GROUP BY 1""")
def eda_outliers(spark, sf_dir):
    return profile.outliers(loans(spark, sf_dir), NUMERIC)


_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) AS correlation FROM loans" for a, b in _PAIRS)


@query(f"{LOANS} {_CORR}")
def eda_correlation(spark, sf_dir):
    return profile.correlations(loans(spark, sf_dir), NUMERIC)


@query("""WITH l AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
c AS (SELECT 'quantity' AS feature_a, 'price' AS feature_b, round(corr(quantity, price), 4) AS correlation FROM l UNION ALL SELECT 'quantity', 'discount', round(corr(quantity, discount), 4) FROM l UNION ALL SELECT 'quantity', 'net', round(corr(quantity, net), 4) FROM l
UNION ALL SELECT 'price', 'discount', round(corr(price, discount), 4) FROM l UNION ALL SELECT 'price', 'net', round(corr(price, net), 4) FROM l UNION ALL SELECT 'discount', 'net', round(corr(discount, net), 4) FROM l) SELECT * FROM c WHERE abs(correlation) >= 0.8""")
def eda_high_corr(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return profile.correlations(df, ["quantity", "price", "discount", "net"], 0.8)


def _rates(by: str, least: int = 50) -> str:
    return f"{LOANS} SELECT coalesce({by}::VARCHAR, '(missing)') AS {by}, count(*) AS loans, sum(event)::BIGINT AS events, round(sum(event) / count(*), 4) AS default_rate, quantile_cont(duration_months, 0.5) AS median_duration, count(*) < {least} AS small_segment FROM loans GROUP BY 1"


@query(_rates("purpose"))
def eda_target_rate(spark, sf_dir):
    return profile.target_rates(loans(spark, sf_dir), "purpose")


@query(_rates("emp_length"))
def eda_target_rate_employment(spark, sf_dir):
    return profile.target_rates(loans(spark, sf_dir), "emp_length")


@query(_rates("issue_year"))
def eda_vintage(spark, sf_dir):
    return profile.target_rates(loans(spark, sf_dir), "issue_year")


@query(f"{LOANS} SELECT issue_year, round((avg((emp_length IS NULL)::INT) + avg((dti IS NULL)::INT)) / 2, 6) AS applicant, round(avg((mths_since_delinq IS NULL)::INT), 6) AS history FROM loans GROUP BY 1")
def eda_missing_by_year(spark, sf_dir):
    return profile.missing_by_year(loans(spark, sf_dir), {"applicant": ["emp_length", "dti"], "history": ["mths_since_delinq"]})


@query(f"""{LOANS}, v AS (SELECT 'outcome' AS dimension, outcome AS level, event, outcome, duration_months FROM loans UNION ALL SELECT 'term_months', term_months::VARCHAR, event, outcome, duration_months FROM loans UNION ALL SELECT 'grade', grade, event, outcome, duration_months FROM loans)
SELECT dimension, coalesce(level, '(missing)') AS level, count(*) AS loans, round(avg(event), 6) AS event_rate, quantile_cont(duration_months, 0.5) AS median_duration, round(avg((outcome = 'censored_admin')::INT), 6) AS admin_share FROM v GROUP BY ALL""")
def eda_breakdowns(spark, sf_dir):
    return profile.breakdowns(loans(spark, sf_dir), ["outcome", "term_months", "grade"])


# -- cleaning

_ITEM = ["l_quantity", "l_extendedprice", "l_discount"]


@query(f"""WITH v AS ({_union(_ITEM, "lineitem")}) SELECT "column", round(quantile_cont(value, 0.005), 6) AS low, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.995), 6) AS high FROM v GROUP BY 1""")
def clean_fit_values(spark, sf_dir):
    return clean.fit_numeric(table(spark, sf_dir, "lineitem"), _ITEM)


_LEVELS = """WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part WHERE p_size <= 40 UNION ALL SELECT 'p_type', p_type FROM part WHERE p_size <= 40), c AS (SELECT "column", trim(value) AS level, count(*) AS n FROM v GROUP BY ALL),
lv AS (SELECT "column", level, n::BIGINT AS count, (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level))::INT AS rank, n < {rare} AS rare FROM c)"""


@query(_LEVELS.format(rare=60) + " SELECT * FROM lv")
def clean_fit_levels(spark, sf_dir):
    return clean.fit_levels(table(spark, sf_dir, "part").where("p_size <= 40"), ["p_brand", "p_type"], 60)


@query(_LEVELS.format(rare=60) + """ SELECT p_partkey, CASE WHEN b.level IS NULL THEN NULL WHEN b.rare THEN 'other' ELSE b.level END AS p_brand_aligned
FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'Brand#new' ELSE p_brand END AS p_brand FROM part) LEFT JOIN (SELECT * FROM lv WHERE "column" = 'p_brand') b ON trim(p_brand) = b.level""")
def clean_align_categories(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    levels = clean.fit_levels(part.where("p_size <= 40"), ["p_brand", "p_type"], 60)
    new = part.select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, "Brand#new").otherwise(F.col("p_brand")).alias("p_brand"))
    return clean.align(new, "p_brand", levels).select("p_partkey", "p_brand_aligned")


@query(f"""{RAW}, f AS (SELECT id, list_filter([CASE WHEN annual_inc > 150000 THEN 'annual_inc' END, CASE WHEN coalesce(dti, 99) > 12 THEN 'dti' END, CASE WHEN {_READ} IS NULL THEN 'amount_text' END, CASE WHEN emp_length IS NULL THEN 'emp_length' END], lambda x: x IS NOT NULL) AS l FROM raw)
SELECT id, array_to_string(l[1:2], ', ') AS fields, len(l)::BIGINT AS n FROM f""")
def clean_row_flags(spark, sf_dir):
    names, n = clean.flags({"annual_inc": F.col("annual_inc") > 150_000, "dti": F.coalesce("dti", F.lit(99.0)) > 12, "amount_text": parse.number(F.col("amount_text")).isNull(), "emp_length": F.col("emp_length").isNull()}, 2)
    return raw_loans(spark, sf_dir).select("id", names.alias("fields"), n.alias("n"))


@query("""WITH k AS (SELECT doc_id, text, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r, first_value(source) OVER (PARTITION BY text ORDER BY doc_id) AS s FROM documents)
SELECT doc_id, CASE WHEN r = 1 THEN 'kept' WHEN source = s THEN 'duplicate_row' ELSE 'duplicate_key' END AS kind FROM k""")
def dedupe_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("same"))
    return clean.first_per_key(docs, F.col("same"), F.col("doc_id"), ["same", "source"]).select("doc_id", "kind")


# -- samples and splits

_SEED = "('0x' || substr(sha256('{seed}:' || o_orderkey), 1, 8))::BIGINT"


@query(f"SELECT o_orderkey, {_SEED.format(seed=7)} AS seed FROM orders")
def row_seed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sampling.row_seed(7, F.col("o_orderkey")).alias("seed"))


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_SEED.format(seed=7)}, o_orderkey LIMIT 200")
def reservoir_k(spark, sf_dir):
    return sampling.reservoir(table(spark, sf_dir, "orders"), "o_orderkey", 200, 7).select("o_orderkey", "o_totalprice")


@query(f"""WITH c AS (SELECT o_orderpriority AS s, count(*) AS c FROM orders GROUP BY 1), q AS (SELECT s, c, least(greatest(floor(500 * c / sum(c) OVER ()), 1), c) AS q, row_number() OVER (ORDER BY c DESC, s) AS p FROM c),
f AS (SELECT s, q + CASE WHEN p = 1 THEN greatest(500 - sum(q) OVER (), 0) ELSE 0 END AS q FROM q),
r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_SEED.format(seed=3)}, o_orderkey) AS r FROM orders)
SELECT o_orderkey, o_orderpriority FROM r JOIN f ON s = o_orderpriority WHERE r <= q""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", 500, 3).select("o_orderkey", "o_orderpriority")


@query(f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_SEED.format(seed=5)}, o_orderkey) AS r FROM orders) WHERE r <= 20")
def equal_allocation(spark, sf_dir):
    return sampling.equal_pick(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", 20, 5).select("o_orderkey", "o_orderpriority")


@query(f"SELECT CASE WHEN {_SEED.format(seed=9)} < floor(4294967296 * 0.2) THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def train_test_split(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "orders"), "o_orderkey", 0.2, 9).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"{LOANS} SELECT CASE WHEN issue_year >= 1999 THEN 'test' ELSE 'train' END AS part, count(*) AS n, min(issue_year) AS first_year, max(issue_year) AS last_year FROM loans GROUP BY 1")
def out_of_time_split(spark, sf_dir):
    return loans(spark, sf_dir).groupBy(F.when(F.col("issue_year") >= 1999, "test").otherwise("train").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("issue_year").alias("first_year"), F.max("issue_year").alias("last_year"))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_split(spark, sf_dir):
    """A pushed-down range and a semi-join."""
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")))
    return o.join(ids, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_todo(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")
