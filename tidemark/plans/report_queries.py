"""Queries that report on runs, files, models and cleaning: what the records say, and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean, evaluate, governance, scoring, uploads
from tidemark.plans.analysis_queries import _PD, _scored
from tidemark.plans.registry import query
from tidemark.plans.survival_queries import _BRIER, _G, _GD, _GT
from tidemark.plans.views import LOANS, RAW, TIMES, loans, risky
from tidemark.sources.loans import raw_loans
from tidemark.sources.shipping import ship
from tidemark.sources.store import scratch, stored
from tidemark.sources.tables import table

# -- files


def _region_files(spark, sf_dir) -> str:
    """A folder with a folder for each region, which holds a file of its nations' names in order."""
    ship(spark)
    base = scratch(spark)
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    for r in range(5):  # a file a region: the given table has five
        rows.where(F.col("n_regionkey") == r).coalesce(1).sortWithinPartitions("value").select("value").write.mode("overwrite").text(f"{base}/region={r}")
    return base


def _prints(spark, base):
    found = governance.fingerprints(spark, base).where(~F.col("path").endswith("_SUCCESS"))
    return found.select(F.regexp_extract("path", r"(region=\d+)", 1).alias("path"), "size", "sha256")


_TEXT = """f AS (SELECT 'region=' || n_regionkey AS path, string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey || ',' || n_name) AS body FROM nation GROUP BY n_regionkey)"""


@query(f"WITH {_TEXT} SELECT path, octet_length(encode(body))::BIGINT AS size, sha256(body) AS sha256 FROM f")
def file_fingerprints(spark, sf_dir):
    """Size and SHA-256 of written files, read in chunks by the tasks."""
    return _prints(spark, _region_files(spark, sf_dir))


@query("""SELECT 'region=' || r_regionkey AS path, CASE r_regionkey WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' WHEN 3 THEN 'was_missing' ELSE 'ok' END AS verdict FROM region""")
def file_verdicts(spark, sf_dir):
    """Recorded fingerprints of files against those of now: one file is written anew, one is gone, one was not there before."""
    base = _region_files(spark, sf_dir)
    before = stored(_prints(spark, base))
    recorded = before.select("path", F.when(F.col("path") != "region=3", F.col("sha256")).alias("sha256"))
    spark.range(3).select(F.col("id").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(f"{base}/region=1")
    spark.range(0).select(F.col("id").cast("string").alias("value")).write.mode("overwrite").parquet(f"{base}/other")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/region=2")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return governance.verify(recorded, _prints(spark, base))


@query("""WITH e AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size <= 25), a AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_retailprice > 1000)
SELECT name, 'missing' AS status FROM e WHERE name NOT IN (SELECT name FROM a) UNION ALL SELECT name, 'extra' FROM a WHERE name NOT IN (SELECT name FROM e)""")
def file_sets(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "name")
    return governance.file_sets(part.where("p_size <= 25"), part.where("p_retailprice > 1000"), "name")


# -- models

_SAMPLES, _GROUND = 600, 100


@query("""WITH s AS (SELECT s_suppkey AS k, s_acctbal AS b, s_nationkey AS n FROM supplier),
r AS (SELECT k::VARCHAR AS tag, b > 0 AS A1_model_file, k % 4 <> 3 AS A2_features, n < 20 AS A3_no_blocking_defect, k % 5 <> 4 AND n % 2 = 0 AS A4_cleaning_values, k % 3 > 0 AS A5_ablation, k % 2 = 0 AND b > -500 AS A6_explainer_validation,
(k % 2 = 0 AND CASE WHEN b > -500 THEN k % 6 <> 2 ELSE false END) OR k % 7 = 0 AS A7_explain_settings FROM s WHERE k % 11 <> 10)
SELECT *, A1_model_file AND A2_features AND A3_no_blocking_defect AND A4_cleaning_values AND A5_ablation AND A6_explainer_validation AND A7_explain_settings AS approved FROM r""")
def approval_rules(spark, sf_dir):
    """The seven rules of a model a supplier, computed from records in JSON; some records are no JSON."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("tag"), F.col("s_acctbal").alias("b"), F.col("s_nationkey").alias("n"))
    sha, other = F.sha2("tag", 256), F.sha2(F.concat("tag", F.lit("old")), 256)
    text = lambda *fields: F.to_json(F.struct(*fields))
    features = lambda *names: F.struct(F.array(*map(F.lit, names)).alias("numeric"), F.array(F.lit("purpose")).alias("categorical")).alias("features")
    defects = F.array(F.struct(F.lit("D1").alias("id"), F.lit(False).alias("blocking")), F.struct(F.lit("D2").alias("id"), (F.col("n") >= 20).alias("blocking"))).alias("defects")
    records = s.select(F.when(F.col("k") % 11 == 10, "no record").otherwise(text("tag", sha.alias("model_sha256"), features("dti", "loan_amnt"), defects, F.struct(F.lit(1000).alias("n_train")).alias("training"))).alias("record"))
    files = s.select(F.concat(F.lit("models/"), "tag").alias("path"), F.when(F.col("b") > 0, sha).otherwise(other).alias("sha256"))
    of = lambda h: F.struct(F.struct(F.struct(h.alias("sha256")).alias("model")).alias("inputs")).alias("provenance")
    tag = F.col("tag").alias("model_tag")

    def finding(folder: str, body, keep=F.lit(True)):
        return s.where(keep).select(F.concat(F.lit(f"{folder}/"), "tag").alias("path"), body.alias("body"))

    ceiling = lambda top: F.struct(F.lit(top).alias("top1_agreement"), F.lit(0.9).alias("mean_top4_overlap")).alias("reference_ceiling")
    sizes = lambda cond: (F.when(cond, 300).otherwise(_SAMPLES).alias("nsamples"), F.lit(_GROUND).alias("n_background"))
    evidence = [
        finding("metrics", F.when(F.col("k") % 4 == 3, text(tag, features("dti", "income"))).otherwise(text(tag, features("loan_amnt", "dti")))),
        finding("cleaning", text(tag, of(sha), F.when(F.col("n") % 2 == 0, 1000).otherwise(999).alias("fitted_rows")), F.col("k") % 5 != 4),
        finding("ablation", text(tag, of(sha), F.array(F.lit("dti")).alias("features")), F.col("k") % 3 > 0),
        finding("ablation/old", text(tag, of(other), F.array(F.lit("dti")).alias("features"))),
        finding("validation/a", text(tag, of(sha), ceiling(0.95), *sizes(F.col("k") % 6 == 2)), F.col("k") % 2 == 0),
        finding("validation/b", text(tag, of(sha), ceiling(0.5), F.lit(300).alias("nsamples"), F.lit(_GROUND).alias("n_background")), (F.col("k") % 2 == 0) & (F.col("b") <= -500)),
        finding("settings", text(tag, of(sha), F.array(F.struct(F.lit(_SAMPLES).alias("nsamples"), F.lit(_GROUND).alias("n_background"), F.when(F.col("k") % 7 == 0, "PASS").otherwise("FAIL").alias("verdict"))).alias("candidates"))),
        finding("metrics/odd", F.lit("{ not closed")),
    ]
    every = evidence[0]
    for e in evidence[1:]:
        every = every.unionByName(e)
    return governance.approval_rules(records, every, files, _SAMPLES, _GROUND)


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[' || event_id || ', 2]' WHEN 2 THEN '{"a": {"b": [1, ' || event_id || ']}}' WHEN 3 THEN '{broken' || event_id ELSE event_id::VARCHAR END AS text FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'object' WHEN 3 THEN 'text' ELSE 'number' END AS kind, CASE WHEN event_id % 5 = 4 THEN event_id::DOUBLE END AS number,
CASE event_id % 5 WHEN 0 THEN json_extract(text, '$.k')::BIGINT WHEN 1 THEN json_extract(text, '$[0]')::BIGINT WHEN 2 THEN json_extract(text, '$.a.b[1]')::BIGINT END AS inside FROM t""")
def typed_texts(spark, sf_dir):
    """Dictionaries and lists in text, told apart and reached into, over every event."""
    k, key = F.col("event_id") % 5, F.col("event_id").cast("string")
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), key, F.lit(", 2]"))).when(k == 2, F.concat(F.lit('{"a": {"b": [1, '), key, F.lit("]}}"))).when(k == 3, F.concat(F.lit("{broken"), key)).otherwise(key)
    rows = table(spark, sf_dir, "events").select("event_id", governance.typed(text).alias("x"))
    inside = F.coalesce(*[F.try_variant_get(F.col("x.value"), p, "long") for p in ("$.k", "$[0]", "$.a.b[1]")])
    return rows.select("event_id", "x.kind", "x.number", inside.alias("inside"))


_EV = f"""{_BRIER}, x AS (SELECT t, risk, sum(CASE WHEN duration_months <= t AND event = 1 THEN 1 / g ELSE 0 END) AS w, count_if(duration_months > t) AS b FROM rows, gt GROUP BY ALL),
y AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY t ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x), au AS (SELECT t, round(sum(w * (below + b / 2)) / (sum(w) * sum(b)), 6) AS auc FROM y GROUP BY t),
ca AS (SELECT duration_months AS d, event AS e, risk AS r, count(*) AS n FROM loans GROUP BY ALL), cc AS (SELECT round(sum(a.n * b.n * CASE WHEN a.r > b.r THEN 1 WHEN a.r = b.r THEN 0.5 ELSE 0 END) / sum(a.n * b.n), 6)::DOUBLE AS concordance FROM ca a JOIN ca b ON a.e = 1 AND (b.d > a.d OR (b.d = a.d AND b.e = 0))),
p AS (SELECT t, brier, lag(t) OVER (ORDER BY t) AS t0, lag(brier) OVER (ORDER BY t) AS b0 FROM bs WHERE t <= (SELECT max(duration_months) FROM loans)), ib AS (SELECT round(sum((t - t0) * (brier + b0) / 2) / (max(t) - min(t)), 6) AS ibs FROM p)"""


@query(f"""{_EV}, l AS (SELECT count(*) AS n, round(avg(event), 6) AS event_rate, max(duration_months) AS last FROM loans)
SELECT n, event_rate, concordance, ibs, {", ".join(f"(SELECT auc FROM au WHERE t = {t} AND t <= last) AS auc_{t}m" for t in TIMES)},
(SELECT coalesce(string_agg(t::VARCHAR, ',' ORDER BY t) FILTER (gt <= 0.001), '') FROM gt WHERE t <= last) AS unreliable_horizons, (SELECT coalesce(string_agg(t::VARCHAR, ',' ORDER BY t) FILTER (round(gt, 6) < 0.05), '') FROM gt WHERE t <= last) AS high_variance_horizons,
(SELECT string_agg(t::VARCHAR, ',' ORDER BY t) FROM gt WHERE t <= last) AS horizons FROM l, cc, ib""")
def eval_summary(spark, sf_dir):
    """All measures of one model in a row, with the horizons that are not to be trusted."""
    return evaluate.summary(risky(spark, sf_dir), TIMES)


@query(f"""{LOANS}, m AS (SELECT CASE WHEN id % 2 = 0 THEN 'flat' ELSE 'risk' END AS side, * FROM loans),
v AS (SELECT 'risk' AS model, CASE WHEN issue_year >= 1999 THEN 'test' ELSE 'train' END AS split, duration_months AS d, event AS e, risk AS r FROM loans UNION ALL SELECT 'income', CASE WHEN issue_year >= 1999 THEN 'test' ELSE 'train' END, duration_months, event, round(1 / (1 + greatest(annual_inc, 0) / 10000), 3) FROM loans),
c AS (SELECT model, split, d, e, r, count(*) AS n FROM v GROUP BY ALL), z AS (SELECT model, split, count(*) AS n, round(avg(e), 6) AS event_rate FROM v GROUP BY ALL)
SELECT model, split, z.n, event_rate, concordance FROM z JOIN (SELECT a.model, a.split, round(sum(a.n * b.n * CASE WHEN a.r > b.r THEN 1 WHEN a.r = b.r THEN 0.5 ELSE 0 END) / sum(a.n * b.n), 6)::DOUBLE AS concordance FROM c a JOIN c b ON a.model = b.model AND a.split = b.split AND a.e = 1 AND (b.d > a.d OR (b.d = a.d AND b.e = 0)) GROUP BY ALL) USING (model, split)""")
def model_table(spark, sf_dir):
    """Two risk scores on two splits: a row for each."""
    df = risky(spark, sf_dir).withColumns({"split": F.when(F.col("issue_year") >= 1999, "test").otherwise("train"), "income": F.round(1 / (1 + F.greatest(F.col("annual_inc"), F.lit(0.0)) / 10000), 3)})
    scores = F.explode(F.array(F.struct(F.lit("risk").alias("model"), F.col("risk")), F.struct(F.lit("income").alias("model"), F.col("income").alias("risk"))))
    long = stored(df.select("split", "duration_months", "event", scores.alias("s")).select("split", "duration_months", "event", "s.model", "s.risk"))
    size = long.groupBy("model", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("event"), 6).alias("event_rate"))
    return size.join(evaluate.concordance(long, ["model", "split"]).drop("n_pairs"), ["model", "split"])


# -- runs

_SEEN = "d AS (SELECT DISTINCT ts::DATE AS day FROM events), u AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events)"


@query(f"WITH {_SEEN} SELECT strftime(day, '%Y-%m-%d') AS day, " + ", ".join(f"(SELECT count(DISTINCT user_id) FROM u WHERE u.day BETWEEN d.day - {k - 1} AND d.day) AS distinct_{k}" for k in (7, 30)) + " FROM d")
def distinct_trailing(spark, sf_dir):
    """How many users each trailing week and month has seen."""
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    return scoring.distinct_trailing(days, "user_id", "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "distinct_7", "distinct_30")


@query("""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, count_if(o_orderstatus <> 'O') AS approved, count(*) AS applicants FROM orders GROUP BY 1), l AS (SELECT * FROM r ORDER BY run DESC LIMIT 15),
s AS (SELECT *, approved / applicants AS s, lag(approved / applicants) OVER (ORDER BY run) AS p, avg(approved / applicants) OVER (ORDER BY run ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM l)
SELECT run, approved, applicants, round(s, 6) AS approval_share, round(s - p, 6) AS change, round(m, 6) AS trend FROM s ORDER BY run DESC LIMIT 12""")
def newest_runs(spark, sf_dir):
    """Approval shares of the twelve newest months and their trend."""
    runs = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(F.count_if(F.col("o_orderstatus") != "O").alias("approved"), F.count(F.lit(1)).alias("applicants"))
    return scoring.newest_runs(runs, "run", 12)


_RANGES = {"dti": (2.0, 12.0), "loan_amnt": (50_000.0, 400_000.0), "annual_inc": (0.0, 200_000.0)}
_OUT = " + ".join(f"coalesce(({c} < {lo} OR {c} > {hi})::INT, 0)" for c, (lo, hi) in _RANGES.items())


@query(f"{_PD}, o AS (SELECT *, {_OUT} AS k FROM de) SELECT count(*) AS rows, count_if(decision = 'approve') AS approved, count_if(decision = 'reject') AS rejected, round(sum(coalesce(pd, 0)) / count(*), 6) AS mean_risk, count_if(k > 0) AS rows_out_of_range, max(k)::BIGINT AS most_out_of_range FROM o")
def score_overview(spark, sf_dir):
    return scoring.overview(_scored(spark, sf_dir), _RANGES, 0.3)


@query(f"{_PD} SELECT b.bin::INT AS bin, round(b.bin / 40, 4) AS low, round((b.bin + 1) / 40, 4) AS high, count(de.id) AS applicants, CASE WHEN (b.bin + 0.5) / 40 >= 0.3 THEN 'reject' ELSE 'approve' END AS decision FROM (SELECT unnest(range(0, 40)) AS bin) b LEFT JOIN de ON least(floor(pd * 40), 39) = b.bin GROUP BY b.bin")
def risk_bins(spark, sf_dir):
    return scoring.risk_bins(_scored(spark, sf_dir), 0.3)


# -- cleaning

_IS = r"regexp_matches(x, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
_CLEANED = f"""{RAW}, v AS (SELECT id, trim(amount_text) AS t, regexp_replace(trim(amount_text), '[,%$]', '', 'g') AS x FROM raw), n AS (SELECT *, CASE WHEN {_IS} THEN x::DOUBLE END AS num, CASE WHEN {_IS.replace("(x", "(t")} THEN t::DOUBLE END AS plain, t IN ('', 'n/a') OR t IS NULL AS blank FROM v),
f AS (SELECT round(quantile_cont(num, 0.005), 6) AS lo, round(quantile_cont(num, 0.01), 6) AS p1, round(quantile_cont(num, 0.99), 6) AS p99, round(quantile_cont(num, 0.995), 6) AS hi FROM n WHERE id % 2 = 0),
c AS (SELECT * FROM n, f WHERE id % 2 = 1), ex AS (SELECT string_agg(t, ', ' ORDER BY t) AS e FROM (SELECT DISTINCT t FROM c WHERE num IS NULL AND NOT blank ORDER BY t LIMIT 3)),
tl AS (SELECT addr_state AS level, count(*) < 250 AS rare FROM raw WHERE id % 2 = 0 AND addr_state < 'NATION_22' GROUP BY 1), cl AS (SELECT addr_state AS level, count(*) AS n, any_value(rare) AS rare FROM raw LEFT JOIN tl ON level = addr_state WHERE id % 2 = 1 GROUP BY 1)
SELECT 'amount_text' AS "column", unnest(['rescued', 'unreadable', 'missing_after', 'clipped', 'out_of_range']) AS rule, unnest(['', coalesce((SELECT e FROM ex), ''), '', '', '']) AS detail,
unnest([count_if(plain IS NULL AND num IS NOT NULL), count_if(num IS NULL AND NOT blank), count_if(num IS NULL), count_if(num < p1 OR num > p99), count_if(num < lo OR num > hi)]) AS count FROM c
UNION ALL SELECT 'addr_state', 'pooled', '', coalesce(sum(n) FILTER (rare), 0)::BIGINT FROM cl UNION ALL SELECT 'addr_state', 'missing_after', '', coalesce(sum(n) FILTER (rare IS NULL), 0)::BIGINT FROM cl
UNION ALL (SELECT 'addr_state', 'unseen', level, n FROM cl WHERE level IS NOT NULL AND rare IS NULL ORDER BY n DESC, level LIMIT 10)"""


def _fitted(spark, sf_dir):
    from tidemark.functions import parse

    raw = raw_loans(spark, sf_dir).select("id", "amount_text", "addr_state")
    train = raw.where("id % 2 = 0")
    numbers = stored(clean.fit_numeric(train.select(parse.number(F.col("amount_text")).alias("amount_text")), ["amount_text"]))
    levels = stored(clean.fit_levels(train.where("addr_state < 'NATION_22'"), ["addr_state"], 250))
    return raw.where("id % 2 = 1"), numbers, levels


@query(_CLEANED)
def cleaning_report(spark, sf_dir):
    """What cleaning one half of the loans with values learned on the other did."""
    new, numbers, levels = _fitted(spark, sf_dir)
    return clean.full_report(new, numbers, levels, ["amount_text"], ["addr_state"])


@query(_CLEANED)
def cleaning_report_of_blocks(spark, sf_dir):
    """The same from the reports of four blocks, added up."""
    new, numbers, levels = _fitted(spark, sf_dir)
    parts = [clean.full_report(new.where(F.pmod(F.hash("id"), F.lit(4)) == k), numbers, levels, ["amount_text"], ["addr_state"], unseen=1000) for k in range(4)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return clean.merged_report(every)


# -- uploads

_READ = f"CASE WHEN {_IS} THEN x::DOUBLE END"


@query(rf"""{RAW}, tr AS (SELECT * FROM raw WHERE id % 2 = 0), md AS (SELECT median(coalesce(dti, 5.0)) AS dti FROM tr), up AS (SELECT *, regexp_replace(trim(amount_text), '[,%$]', '', 'g') AS x FROM raw WHERE id % 2 = 1)
SELECT id, {_READ} AS loan_amnt, round(annual_inc::DOUBLE, 4) AS annual_inc, CASE WHEN annual_inc <> 0 THEN round({_READ} / annual_inc, 6) END AS loan_to_income, printf('%.4f', md.dti)::DOUBLE AS dti, NULL::DOUBLE AS mths_since_delinq, 1 AS mths_since_delinq_missing, CASE WHEN id % 10 <> 3 THEN purpose END AS purpose,
(nullif(nullif(trim(amount_text), ''), 'n/a') IS NOT NULL AND ({_READ}) IS NULL)::INT::BIGINT AS unreadable, (id % 10 = 3)::INT::BIGINT AS unseen FROM up, md""")
def scoring_inputs(spark, sf_dir):
    """An upload with other names, a ratio to derive, a column training never lacked, one it did, and levels it never saw, made ready by the saved specification."""
    raw = raw_loans(spark, sf_dir)
    train = stored(raw.where("id % 2 = 0").select("loan_amnt", "annual_inc", F.coalesce("dti", F.lit(5.0)).alias("dti"), "mths_since_delinq", "purpose", (F.col("loan_amnt") / F.nullif("annual_inc", F.lit(0.0))).alias("loan_to_income")))
    numbers = ["loan_amnt", "annual_inc", "loan_to_income", "dti", "mths_since_delinq"]
    path = scratch(spark)
    uploads.fit_specification(train, numbers, ["purpose"], {"loan_amnt": 0.02, "annual_inc": 0.01, "loan_to_income": 0.0, "dti": 0.001, "mths_since_delinq": 0.0, "purpose": 0.0}, ["mths_since_delinq"]).save(spark, path)
    spec = uploads.Specification.load(spark, path)
    upload = raw.where("id % 2 = 1").select("id", F.col("amount_text").alias("Amount wanted"), F.col("annual_inc").cast("string").alias("annual_inc"), F.when(F.col("id") % 10 == 3, "Yacht").otherwise(F.col("purpose")).alias("purpose"), "addr_state")
    made = uploads.plan(upload.columns, spec, {"Amount wanted": "loan_amnt"}, id_column="id")
    rows = uploads.prepared(upload, made, spec, ["id"])
    return rows.withColumns({"annual_inc": F.round("annual_inc", 4), "loan_to_income": F.round("loan_to_income", 6)})
