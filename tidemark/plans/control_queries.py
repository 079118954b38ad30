"""Queries over derived features, design matrices, targets, states and approvals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import design, governance
from tidemark.plans.explain_queries import REASONS, stated_reasons
from tidemark.plans.registry import query
from tidemark.plans.views import LOANS, PHI, RAW, loans
from tidemark.sources.loans import raw_loans
from tidemark.sources.tables import table

_SEED = "('0x' || substr(sha256('4:' || o_orderkey), 1, 8))::BIGINT"


@query(f"""{RAW}, d AS (SELECT id, loan_amnt, annual_inc, emp_length, (id % 4 * 5)::DOUBLE AS int_rate, 600 + o_custkey % 200 AS low, CASE WHEN term IS NOT NULL THEN regexp_extract(trim(term), '^(\\d+)', 1)::INT END AS n FROM raw),
i AS (SELECT *, CASE WHEN n IS NULL THEN NULL WHEN int_rate = 0 THEN loan_amnt / n ELSE loan_amnt * (int_rate / 1200) / (1 - pow(1 + int_rate / 1200, -n)) END AS p FROM d)
SELECT id, n AS term_months, low + 4 AS fico_range_high, round((low + low + 4) / 2, 4) AS fico_midpoint, round(p, 6) AS installment, round(CASE WHEN annual_inc <> 0 THEN p / (annual_inc / 12) END, 6) AS installment_to_income, round(CASE WHEN annual_inc <> 0 THEN loan_amnt / annual_inc END, 6) AS loan_to_income FROM i""".replace("\\\\", "\\"))
def derive_features(spark, sf_dir):
    """The derivation rules over a frame that has only their ends; two of them need a derived one."""
    base = raw_loans(spark, sf_dir).select("id", "loan_amnt", "annual_inc", "emp_length", "term", (F.col("id") % 4 * 5).cast("double").alias("int_rate"), (600 + F.col("o_custkey") % 200).alias("fico_range_low"))
    df, lacking = design.derive(base)
    if lacking:
        raise ValueError(lacking)
    return df.select("id", "term_months", "fico_range_high", F.round("fico_midpoint", 4).alias("fico_midpoint"), *[F.round(c, 6).alias(c) for c in ("installment", "installment_to_income", "loan_to_income")])


@query(f"""{RAW}, n AS (SELECT 'dti' AS "column", dti::DOUBLE AS v FROM raw UNION ALL SELECT 'mths_since_delinq', mths_since_delinq::DOUBLE FROM raw), c AS (SELECT 'emp_length' AS "column", emp_length AS v FROM raw UNION ALL SELECT 'purpose', purpose FROM raw),
k AS (SELECT "column", v, count(*) AS n FROM c GROUP BY ALL)
SELECT "column", round(avg((v IS NULL)::INT), 6) AS missing_rate, printf('%.4f', quantile_cont(v, 0.5)) AS stand_in FROM n GROUP BY 1
UNION ALL SELECT "column", round(sum(CASE WHEN v IS NULL THEN n ELSE 0 END) / sum(n), 6), arg_min(v, (-n, v)) FILTER (v IS NOT NULL) FROM k GROUP BY 1""")
def training_stand_ins(spark, sf_dir):
    return design.stand_ins(raw_loans(spark, sf_dir), ["dti", "mths_since_delinq"], ["emp_length", "purpose"])


@query(f"""{LOANS}, g AS (SELECT coalesce(addr_state, '(missing)') AS level, sum(event)::BIGINT AS events FROM loans GROUP BY 1) SELECT level, events, (SELECT sum(events) FROM g) >= 500 AND events < 60 AS pooled FROM g""")
def level_pooling(spark, sf_dir):
    return design.pooled_levels(loans(spark, sf_dir), "addr_state", least=60, total=500)


@query(f"{RAW} SELECT id, " + ", ".join(f"coalesce((purpose = '{v}')::INT, 0) AS \"purpose_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD")) + " FROM raw")
def design_one_hot(spark, sf_dir):
    return design.one_hot(raw_loans(spark, sf_dir), "purpose", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"], ["id"])


_COSTS = "c AS (SELECT p_brand AS feature, CASE WHEN min(p_size) > 1 THEN NULL ELSE round(avg(p_size) % 1 / 40, 6) END AS drop, round(count_if(p_size > 45) / count(*), 6) AS train_missing FROM part GROUP BY 1)"


@query(f"WITH {_COSTS} SELECT feature, drop, train_missing, CASE WHEN drop IS NULL THEN 'unmeasured' WHEN drop >= 0.01 THEN 'required' WHEN train_missing < 0.01 AND feature <> 'Brand#11' THEN 'unlearned' WHEN drop >= 0.002 THEN 'costed' ELSE 'free' END AS tier FROM c")
def feature_tiers(spark, sf_dir):
    costs = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.when(F.min("p_size") <= 1, F.round(F.avg("p_size") % 1 / 40, 6)).alias("drop"), F.round(F.count_if(F.col("p_size") > 45) / F.count(F.lit(1)), 6).alias("train_missing"))
    return design.cost_tiers(costs, ["Brand#11"])


@query(f"""{RAW} SELECT id, coalesce(nullif(trim(CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN ' A' || id END), ''), 'APP-' || lpad((row_number() OVER (ORDER BY id))::VARCHAR, 6, '0')) AS applicant_id FROM raw""")
def applicant_ids(spark, sf_dir):
    given = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.concat(F.lit(" A"), F.col("id").cast("string")))
    return governance.with_applicant_ids(raw_loans(spark, sf_dir).select("id", given.alias("given")), "given", "id").select("id", "applicant_id")


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 5 = 0 AS done, row_number() OVER (ORDER BY {_SEED}, o_orderkey) AS r FROM orders) SELECT CASE WHEN done THEN 'explained' WHEN r <= 1000 THEN 'pending' ELSE 'outside sample' END AS mark, count(*) AS n FROM o GROUP BY 1""")
def target_marks(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 == 0).alias("done"))
    return governance.targets(df, "o_orderkey", "sample", 1000, 4).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


_RUNS = "r AS (SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'not started' WHEN 2 THEN 'completed' WHEN 3 THEN 'stopped' ELSE 'skipped' END AS state, count(*) AS n_rejected, CASE WHEN user_id % 2 = 0 THEN count(*) // 2 ELSE 0 END AS target, count_if(event_type = 'view')::BIGINT AS done, count_if(value > 90)::BIGINT AS pending FROM events GROUP BY 1)"


@query(f"WITH {_RUNS}, t AS (SELECT *, CASE WHEN target > 0 THEN target ELSE n_rejected END AS tt FROM r), p AS (SELECT *, CASE WHEN state = 'running' THEN greatest(tt - done, 0) WHEN state = 'not started' THEN greatest(pending, n_rejected - done) ELSE pending END AS pending_now FROM t) SELECT user_id, state, pending_now, n_rejected > 0 AND (state IN ('running', 'not started', 'stopped') OR pending_now > 0) AS partial FROM p")
def phase_snapshot(spark, sf_dir):
    states = F.element_at(F.array(*map(F.lit, ("running", "not started", "completed", "stopped", "skipped"))), (F.col("user_id") % 5 + 1).cast("int"))
    n = F.count(F.lit(1))
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("n_rejected"), F.count_if(F.col("event_type") == "view").alias("done"), F.count_if(F.col("value") > 90).alias("pending"))
    runs = runs.withColumns({"state": states, "target": F.when(F.col("user_id") % 2 == 0, F.floor(F.col("n_rejected") / 2)).otherwise(0)})
    return governance.snapshot(runs).select("user_id", "state", "pending_now", "partial")


@query(f"{PHI}, {REASONS}, p AS (SELECT row_id, string_split(reasons, '; ') AS l FROM rs) SELECT row_id, " + ", ".join(f"coalesce(l[{i}], '') AS reason_{i}" for i in range(1, 5)) + " FROM p")
def reason_columns(spark, sf_dir):
    return governance.reason_columns(stated_reasons(spark, sf_dir), "reasons", 4).select("row_id", *[f"reason_{i}" for i in range(1, 5)])


@query(f"""{PHI}, r AS (SELECT t, row_id, feature, row_number() OVER (PARTITION BY t, row_id ORDER BY phi, feature) AS k FROM phi WHERE phi < 0 AND t IN (12, 36)), l AS (SELECT t, row_id, list(feature ORDER BY k) FILTER (k <= 4) AS x FROM r GROUP BY ALL),
j AS (SELECT a.x, b.x AS y FROM l a JOIN l b ON a.row_id = b.row_id AND a.t = 12 AND b.t = 36)
SELECT count(*) AS n, round(avg((x[1] = y[1])::INT), 6) AS top1, round(avg(len(list_intersect(x, y)) / greatest(len(x), len(y), 1)), 6) AS overlap, round(avg((x = y)::INT), 6) AS identical FROM j""")
def reason_agreement(spark, sf_dir):
    from tidemark.plans.views import attributions

    phi = attributions(spark, sf_dir).where("phi < 0")
    lists = lambda t: phi.where(F.col("t") == t).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("phi", "feature"))), lambda x: x["feature"]).alias("reasons"))  # noqa: E731  a row has a few features
    return governance.agreement(lists(12), lists(36), "row_id")


@query("SELECT p_partkey, regexp_replace(lower(trim(p_name || ' ' || p_brand)), '[^a-z0-9]+', '-', 'g') AS slug, CASE WHEN p_partkey % 3 = 0 THEN '2024-0' || (1 + p_partkey % 9) || '-15' END AS day FROM part")
def file_names(spark, sf_dir):
    run = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("20240"), (1 + F.col("p_partkey") % 9).cast("string"), F.lit("15_101112_x"))).otherwise(F.lit("scratch"))
    return table(spark, sf_dir, "part").select("p_partkey", governance.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), governance.run_day(run).alias("day"))


_SCALAR = "CASE c_custkey % 5 WHEN 0 THEN ' True ' WHEN 1 THEN round(c_acctbal)::BIGINT::VARCHAR WHEN 2 THEN '' WHEN 3 THEN c_mktsegment END"


@query(f"WITH s AS (SELECT c_custkey, trim({_SCALAR}) AS t FROM customer) SELECT c_custkey, CASE WHEN t IS NULL OR t = '' THEN 'missing' WHEN lower(t) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(t, '^-?[0-9]+$') THEN 'number' ELSE 'text' END AS kind, CASE WHEN regexp_matches(t, '^-?[0-9]+$') THEN t::DOUBLE END AS number FROM s")
def typed_scalars(spark, sf_dir):
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, " True ").when(k == 1, F.round("c_acctbal").cast("long").cast("string")).when(k == 2, "").when(k == 3, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", governance.typed(text).alias("x")).select("c_custkey", "x.kind", "x.number")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '2016,2017,2018' WHEN 1 THEN '2015' WHEN 2 THEN NULL ELSE NULL END AS years FROM supplier")
def year_ranges(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, "2016 - 2018").when(k == 1, "2015").when(k == 2, "2018-2016").otherwise("a year")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(governance.years(text).cast("array<string>"), ",").alias("years"))


@query("""WITH d AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents) SELECT path, CASE WHEN path::BIGINT % 7 = 0 THEN 'was_missing' WHEN path::BIGINT % 7 = 1 THEN 'missing' WHEN path::BIGINT % 7 = 2 THEN 'changed' ELSE 'ok' END AS verdict FROM d""")
def provenance_verify(spark, sf_dir):
    """Recorded hashes of contents against those of now: documents stand for files."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 7).alias("k"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    recorded = docs.withColumn("sha256", F.when(F.col("k") == 0, None).when(F.col("k") == 2, "0").otherwise(F.col("sha256")))
    return governance.verify(recorded, docs.where("k <> 1"))


@query("""WITH m AS (SELECT s_suppkey::VARCHAR AS tag, s_acctbal > 0 AS a1, s_nationkey < 20 AS a3, CASE WHEN s_suppkey % 3 > 0 THEN true END AS a5 FROM supplier)
SELECT tag, array_to_string(list_filter([CASE WHEN NOT a1 THEN 'A1_model_file' END, CASE WHEN NOT a3 THEN 'A3_no_blocking_defect' END, CASE WHEN a5 IS NULL THEN 'A5_ablation' END], lambda x: x IS NOT NULL), ',') AS failed, a1 AND a3 AND a5 IS NOT NULL AS approved FROM m""")
def registry_rules(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return governance.approval(s.select(F.col("s_suppkey").cast("string").alias("tag"), (F.col("s_acctbal") > 0).alias("A1_model_file"), (F.col("s_nationkey") < 20).alias("A3_no_blocking_defect"), F.when(F.col("s_suppkey") % 3 > 0, True).alias("A5_ablation")))
