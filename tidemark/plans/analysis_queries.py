"""Queries over drift, selection effects, attributions, scoring runs and histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import drift, explain, scoring, selection
from tidemark.operators.profile import unpivoted
from tidemark.plans.registry import query
from tidemark.plans.views import LOANS, PHI, RAW, accepted, attributions, risky
from tidemark.sources.loans import raw_loans
from tidemark.sources.tables import table

# -- drift: orders before 1999 are the reference

_NUM, _CAT = ["loan_amnt", "annual_inc", "dti", "mths_since_delinq"], ["purpose", "grade", "addr_state"]


def _populations(spark, sf_dir):
    return raw_loans(spark, sf_dir).withColumn("current", F.year("o_orderdate") >= 1999)


def _values(columns, kind):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::{kind} AS value, year(o_orderdate) >= 1999 AS cur FROM raw" for c in columns)


_PSI = f"""nv AS ({_values(_NUM, "DOUBLE")}), e AS (SELECT feature, list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS q FROM nv WHERE NOT cur GROUP BY 1),
i AS (SELECT feature, list_sort(q)[2:len(q) - 1] AS inner_edges FROM e WHERE len(q) >= 2), b AS (SELECT feature, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(inner_edges, lambda x: x <= value)) END AS bin, any_value(len(inner_edges)) + 1 AS bins, count_if(NOT cur) AS r, count_if(cur) AS c FROM nv JOIN i USING (feature) GROUP BY ALL),
s AS (SELECT feature, bins, greatest(r / sum(r) OVER w, 1e-6) AS p, greatest(c / sum(c) OVER w, 1e-6) AS q FROM b WINDOW w AS (PARTITION BY feature)),
psi AS (SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS score, max(bins)::BIGINT AS bins FROM s GROUP BY 1)"""
_TVD = f"""cv AS ({_values(_CAT, "VARCHAR")}), cc AS (SELECT feature, coalesce(trim(value), '(missing)') AS level, count_if(NOT cur) AS r, count_if(cur) AS c FROM cv GROUP BY ALL),
cs AS (SELECT feature, level, r / sum(r) OVER (PARTITION BY feature) AS p, c / sum(c) OVER (PARTITION BY feature) AS q FROM cc),
cr AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(round(q - p, 4)) DESC, level) AS rn FROM cs),
tvd AS (SELECT feature, round(sum(abs(p - q)) / 2, 6) AS score, round(sum(CASE WHEN p = 0 THEN q ELSE 0 END), 6)::DOUBLE AS unseen, string_agg(level || ' ' || printf('%.4f', round(q - p, 4)), '; ' ORDER BY rn) FILTER (rn <= 3) AS moves FROM cr GROUP BY 1)"""


@query(f"{RAW}, {_PSI} SELECT * FROM psi")
def drift_psi(spark, sf_dir):
    return drift.psi(_populations(spark, sf_dir), _NUM, F.col("current"))


@query(f"{RAW}, {_TVD} SELECT * FROM tvd")
def drift_tvd(spark, sf_dir):
    return drift.tvd(_populations(spark, sf_dir), _CAT, F.col("current"))


_BAND = "CASE WHEN score < 0.1 THEN 'stable' WHEN score < 0.25 THEN 'moderate' ELSE 'large' END"


@query(f"{RAW}, {_PSI}, {_TVD}, n AS (SELECT count_if(year(o_orderdate) >= 1999) < 500 AS few FROM raw), u AS (SELECT feature, 'numeric' AS kind, 'PSI' AS measure, round(score, 4) AS score FROM psi UNION ALL SELECT feature, 'categorical', 'TVD', round(score, 4) FROM tvd) SELECT feature, kind, measure, CASE WHEN NOT few THEN score END AS score, CASE WHEN few THEN 'insufficient' ELSE {_BAND} END AS status FROM u, n")
def drift_compare(spark, sf_dir):
    return drift.compare(_populations(spark, sf_dir), _NUM, _CAT, F.col("current"))


@query(f"""{RAW}, {_PSI}, {_TVD}, n AS (SELECT count_if(year(o_orderdate) >= 1999) < 500 AS few FROM raw), u AS (SELECT round(score, 4) AS score FROM psi UNION ALL SELECT round(score, 4) FROM tvd), hc AS (SELECT CASE WHEN few THEN 'insufficient' ELSE {_BAND} END AS status FROM u, n),
hr AS (SELECT count_if(status = 'large')::BIGINT AS n_large, count_if(status = 'moderate')::BIGINT AS n_moderate, count_if(status = 'unknown')::BIGINT AS n_unknown, count_if(status = 'insufficient')::BIGINT AS n_few FROM hc), hs AS (SELECT *, CASE WHEN n_few > 0 THEN 'insufficient' WHEN n_large > 0 THEN 'large' WHEN n_moderate + n_unknown > 0 THEN 'moderate' ELSE 'stable' END AS status FROM hr)
SELECT status, CASE status WHEN 'insufficient' THEN 'grey' WHEN 'large' THEN 'red' WHEN 'moderate' THEN 'amber' ELSE 'green' END AS colour, n_large, n_moderate, n_unknown,
CASE status WHEN 'insufficient' THEN 'under 500 rows: too few to compare' WHEN 'large' THEN n_large || ' feature(s) moved far from training: read decisions with care' WHEN 'moderate' THEN n_moderate || ' feature(s) moved, ' || n_unknown || ' had nothing to compare with' ELSE 'all features lie close to training' END AS headline FROM hs""")
def drift_headline(spark, sf_dir):
    return drift.headline(drift.compare(_populations(spark, sf_dir), _NUM, _CAT, F.col("current")))


# -- selection: open orders are the rejected

_SEL = ["loan_amnt", "annual_inc", "dti", "mths_since_delinq"]
_SV = "sv AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, population IN ('F', 'P') AS a FROM raw WHERE {c} IS NOT NULL" for c in _SEL) + ")"
_SMD = "smd AS (SELECT feature, round(CASE WHEN sqrt((var_samp(value) FILTER (a) + var_samp(value) FILTER (NOT a)) / 2) > 1e-12 THEN (avg(value) FILTER (a) - avg(value) FILTER (NOT a)) / sqrt((var_samp(value) FILTER (a) + var_samp(value) FILTER (NOT a)) / 2) END, 6) AS smd FROM sv GROUP BY 1)"
_LADDER = """lc AS (SELECT feature, value, count_if(a) AS a, count_if(NOT a) AS b FROM sv GROUP BY ALL), ll AS (SELECT *, coalesce(sum(a) OVER w, 0) AS below_a, coalesce(sum(b) OVER w, 0) AS below_b, sum(a) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb FROM lc WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
auc AS (SELECT feature, round(sum(a * (below_b + b / 2)) / (max(na) * max(nb)), 6) AS rank_auc, round(max(abs((below_a + a) / na - (below_b + b) / nb)), 6) AS ks FROM ll GROUP BY 1)"""


@query(f"{RAW}, {_SV}, {_SMD} SELECT * FROM smd")
def smd(spark, sf_dir):
    return selection.smd(accepted(spark, sf_dir), _SEL, F.col("accepted"))


@query(f"{RAW}, {_SV}, {_LADDER} SELECT feature, rank_auc FROM auc")
def rank_auc(spark, sf_dir):
    return selection.rank_auc(accepted(spark, sf_dir), _SEL, F.col("accepted"))


_X = "sqrt(max(na) * max(nb) / (max(na) + max(nb))) * max(abs((below_a + a) / na - (below_b + b) / nb))"


@query(f"""{RAW}, {_SV}, {_LADDER}, x AS (SELECT feature, {_X} AS x FROM ll GROUP BY 1), p AS (SELECT feature, CASE WHEN x <= 1e-9 THEN 1 WHEN x < 1 THEN least(1 - sqrt(2 * pi()) / x * list_sum(list_transform(range(1, 6), lambda k: exp(-pow(2 * k - 1, 2) * pi() * pi() / (8 * x * x)))), 1)
ELSE greatest(list_sum(list_transform(range(1, 9), lambda k: 2 * pow(-1, k - 1) * exp(-2.0 * k * k * x * x))), 0) END AS p FROM x) SELECT feature, ks, round(p, 6) AS p FROM auc JOIN p USING (feature)""")
def ks_stat(spark, sf_dir):
    return selection.ks(accepted(spark, sf_dir), _SEL, F.col("accepted"))


def _propensity(df):
    """A closed-form propensity, so that support, weights and the gate can be checked in SQL."""
    return df.withColumn("propensity", F.round(1 / (1 + F.exp(-(F.col("loan_amnt") / 200_000 - F.coalesce("dti", F.lit(9.0)) / 10 + 0.5))), 6))


_PROP = "pr AS (SELECT *, population IN ('F', 'P') AS a, round(1 / (1 + exp(-(loan_amnt / 200000 - coalesce(dti, 9.0) / 10 + 0.5))), 6) AS propensity FROM raw)"
_SUPPORT = "sq AS (SELECT quantile_cont(propensity, 0.01) AS lo, quantile_cont(propensity, 0.99) AS hi FROM pr WHERE a), su AS (SELECT round(lo, 4) AS low, round(hi, 4) AS high, round(avg((propensity BETWEEN lo AND hi)::INT), 6) AS share_in_support FROM pr, sq WHERE NOT a GROUP BY ALL)"


@query(f"{RAW}, {_PROP}, {_SUPPORT} SELECT * FROM su")
def common_support(spark, sf_dir):
    return selection.common_support(_propensity(accepted(spark, sf_dir)), "propensity", F.col("accepted"))


_GRADE = "CASE WHEN feature IN ('loan_amnt', 'dti') THEN 'good' ELSE 'partial' END"
_VERDICT = f"vd AS (SELECT feature, {_GRADE} AS comparability, smd, rank_auc, ks, CASE WHEN {_GRADE} = 'good' THEN CASE WHEN abs(smd) >= 0.25 THEN 'substantial' WHEN abs(smd) >= 0.1 THEN 'notable' ELSE 'negligible' END ELSE CASE WHEN abs(rank_auc - 0.5) + 0.5 >= 0.65 THEN 'substantial' WHEN abs(rank_auc - 0.5) + 0.5 >= 0.55 THEN 'notable' ELSE 'negligible' END END AS verdict FROM smd JOIN auc USING (feature))"


@query(f"{RAW}, {_SV}, {_SMD}, {_LADDER}, {_VERDICT} SELECT * FROM vd")
def selection_verdicts(spark, sf_dir):
    return selection.verdicts(accepted(spark, sf_dir), ["loan_amnt", "dti"], ["annual_inc", "mths_since_delinq"], F.col("accepted"))


@query(f"""{RAW}, {_SV}, {_SMD}, {_LADDER}, {_VERDICT}, {_PROP}, {_SUPPORT}, pc AS (SELECT propensity, count_if(a) AS a, count_if(NOT a) AS b FROM pr GROUP BY 1), pl AS (SELECT *, coalesce(sum(b) OVER (ORDER BY propensity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pc),
pa AS (SELECT round(sum(a * (below + b / 2)) / (sum(a) * sum(b)), 6) AS separability_auc FROM pl), g AS (SELECT (SELECT count_if(verdict = 'substantial')::BIGINT FROM vd) AS n_substantial, separability_auc, share_in_support FROM pa, su)
SELECT *, CASE WHEN n_substantial = 0 AND separability_auc < 0.75 THEN 'no_correction_needed' WHEN share_in_support >= 0.05 THEN 'apply_correction' ELSE 'correction_unjustified' END AS decision FROM g""")
def selection_gate(spark, sf_dir):
    df = _propensity(accepted(spark, sf_dir))
    features = selection.verdicts(df, ["loan_amnt", "dti"], ["annual_inc", "mths_since_delinq"], F.col("accepted"))
    return selection.gate(features, selection.rank_auc(df, ["propensity"], F.col("accepted")), selection.common_support(df, "propensity", F.col("accepted")))


_IPW = f"{_PROP}, w0 AS (SELECT *, 1 / propensity AS w FROM pr WHERE a), wq AS (SELECT quantile_cont(w, 0.01) AS lo, quantile_cont(w, 0.99) AS hi FROM w0), w1 AS (SELECT w0.* EXCLUDE (w), least(greatest(w, lo), hi) AS w FROM w0, wq), w2 AS (SELECT *, w / (SELECT avg(w) FROM w1) AS weight FROM w1)"


@query(f"{RAW}, {_IPW} SELECT id, round(weight, 6) AS weight FROM w2")
def ipw_weights(spark, sf_dir):
    return selection.inverse_weights(_propensity(accepted(spark, sf_dir)).where("accepted"), "propensity").select("id", F.round("weight", 6).alias("weight"))


@query(f"{RAW}, {_IPW} SELECT purpose, count(weight) AS n, round(sum(weight) ** 2 / sum(weight * weight), 4) AS ess FROM w2 GROUP BY 1")
def kish_ess(spark, sf_dir):
    return selection.kish(selection.inverse_weights(_propensity(accepted(spark, sf_dir)).where("accepted"), "propensity"), F.col("weight"), ["purpose"])


# -- attributions

_AREA = """ar AS (SELECT {g} row_id, feature, t, {v} AS v, lag(t) OVER w AS t0, lag({v}) OVER w AS v0 FROM {src} WINDOW w AS (PARTITION BY {g} row_id, feature ORDER BY t)),
ae AS (SELECT {g} row_id, feature, sum((t - t0) * (v + v0) / 2) / (max(t) - min(t)) AS a FROM ar GROUP BY ALL), ai AS (SELECT {g} feature, round(avg(a), 8) AS importance FROM ae GROUP BY ALL)"""
_AVG_RANK = "rank() OVER (PARTITION BY {g} ORDER BY {v} DESC) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2"


@query(f"{PHI}, {_AREA.format(g='', v='abs(phi)', src='phi')} SELECT * FROM ai")
def importance_area(spark, sf_dir):
    return explain.area(attributions(spark, sf_dir))


@query(f"{PHI}, {_AREA.format(g='', v='phi', src='phi')} SELECT * FROM ai")
def importance_signed(spark, sf_dir):
    return explain.area(attributions(spark, sf_dir), signed=True)


def _segmented(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("grade"))
    return attributions(spark, sf_dir).join(orders, "row_id")


_SEG = f"{PHI}, sp AS (SELECT o_orderpriority AS grade, phi.* FROM phi JOIN orders ON o_orderkey = row_id), {_AREA.format(g='grade,', v='abs(phi)', src='sp')}"


@query(f"{_SEG} SELECT * FROM ai")
def segment_importance(spark, sf_dir):
    return explain.area(_segmented(spark, sf_dir), by=["grade"])


@query(f"{PHI}, m AS (SELECT feature, phi, abs(phi - avg(phi) OVER (PARTITION BY row_id, feature)) AS d FROM phi) SELECT feature, round(avg(d) / nullif(avg(abs(phi)), 0), 6) AS variation FROM m GROUP BY 1")
def time_variation(spark, sf_dir):
    return explain.time_variation(attributions(spark, sf_dir))


@query(f"""{PHI}, s AS (SELECT row_id, t, sum(phi) AS s FROM phi GROUP BY ALL), g AS (SELECT t, abs(round(0.9 - t / 200.0 + (row_id % 10) / 1000.0, 6) - (0.9 - t / 200.0) - s) AS gap FROM s) SELECT t, round(max(gap), 6) AS max_residual, round(avg(gap), 6) AS mean_residual FROM g GROUP BY 1""")
def efficiency_residual(spark, sf_dir):
    phi = attributions(spark, sf_dir)
    base = 0.9 - F.col("t") / 200.0
    totals = phi.select("row_id", "t").distinct().select("row_id", "t", base.alias("base"), F.round(base + (F.col("row_id") % 10) / 1000.0, 6).alias("prediction"))
    return explain.efficiency_residual(phi, totals)


# -- scoring

_PD = f"{LOANS}, sc AS (SELECT *, round_even(1 - pow(1 - risk / 2, 12), 4) AS pd FROM loans), de AS (SELECT *, CASE WHEN pd >= 0.3 THEN 'reject' ELSE 'approve' END AS decision FROM sc)"


def _scored(spark, sf_dir):
    return scoring.decided(risky(spark, sf_dir), 1 - F.pow(1 - F.col("hazard"), F.lit(12)), 0.3)


@query(f"{_PD} SELECT id, pd, decision FROM de")
def score_decide(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "pd", "decision")


@query(f"{_PD} SELECT b.bin::INT AS bin, round(b.bin / 40, 4) AS low, round((b.bin + 1) / 40, 4) AS high, count(de.id) AS applicants FROM (SELECT unnest(range(0, 40)) AS bin) b LEFT JOIN de ON least(floor(pd * 40), 39) = b.bin GROUP BY b.bin")
def score_histogram(spark, sf_dir):
    return scoring.histogram(_scored(spark, sf_dir))


@query(f"{_PD}, v AS (SELECT 'purpose' AS segment, purpose AS level, decision FROM de UNION ALL SELECT 'addr_state', addr_state, decision FROM de UNION ALL SELECT 'emp_length', emp_length, decision FROM de), c AS (SELECT segment, coalesce(level, '(missing)') AS level, decision, count(*) AS applicants FROM v GROUP BY ALL) SELECT *, round(applicants / sum(applicants) OVER (PARTITION BY segment, level), 6) AS share FROM c")
def score_segments(spark, sf_dir):
    return scoring.segments(_scored(spark, sf_dir), ["purpose", "addr_state", "emp_length"])


_QC = ["emp_length", "term", "mths_since_delinq", "dti"]


@query(f"{RAW}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} IS NULL AS gone, population IN ('F', 'P') AS a FROM raw" for c in _QC) + """), r AS (SELECT "column", round(avg(gone::INT) FILTER (NOT a), 6) AS missing, round(avg(gone::INT) FILTER (a), 6) AS train_missing FROM v GROUP BY 1) SELECT *, "column" <> 'mths_since_delinq' AND missing - train_missing > 0.05 AS problem FROM r""")
def input_quality(spark, sf_dir):
    df = accepted(spark, sf_dir)
    return scoring.input_quality(df.where("NOT accepted"), df.where("accepted"), _QC, ["mths_since_delinq"])


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '\b' || conv_id || '\b', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(lower(t), '\b(model|score|threshold|probability|shap)\b') THEN 'internal_word' END, CASE WHEN regexp_matches(lower(t), 'the|and') THEN 'feature_name' END, CASE WHEN regexp_matches(t, '\d+\.\d{3,}') THEN 'long_decimal' END, CASE WHEN regexp_matches(t, '\d+(\.\d+)?\s*%') THEN 'percentage' END], lambda x: x IS NOT NULL), ',') AS problems FROM t""")
def content_screen(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scoring.content_problems(F.col("text"), F.col("conv_id"), ["the", "and"]).alias("problems"))


# -- histories and ledgers


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_row(spark, sf_dir):
    return scoring.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


_DAYS = "d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)"


@query(f"WITH {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, n, (SELECT sum(n) FROM d x WHERE x.day BETWEEN d.day - 6 AND d.day)::BIGINT AS last_7, (SELECT sum(n) FROM d x WHERE x.day BETWEEN d.day - 29 AND d.day)::BIGINT AS last_30 FROM d")
def processing_history(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.processing_history(days).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "last_7", "last_30")


_RUNS = "r AS (SELECT user_id AS run_id, count_if(event_type = 'error')::BIGINT AS failed_checks, max(value) > 99 AS explaining, min(value) < 0.001 AS stopped, count_if(event_type = 'click')::BIGINT % 3 AS pending, count(*) % 2 = 0 AS finished, true AS running FROM events GROUP BY 1)"
_STATE = "CASE WHEN failed_checks > 0 THEN 'failed_checks' WHEN explaining THEN 'explaining' WHEN stopped THEN 'stopped' WHEN pending > 0 THEN 'reasons_pending' WHEN finished THEN 'finished' WHEN running THEN 'running' ELSE 'interrupted' END"


@query(f"WITH {_RUNS} SELECT {_STATE} AS state, count(*) AS runs FROM r GROUP BY 1")
def run_states(spark, sf_dir):
    kind = F.col("event_type")
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count_if(kind == "error").alias("failed_checks"), (F.max("value") > 99).alias("explaining"), (F.min("value") < 0.001).alias("stopped"), (F.count_if(kind == "click") % 3).alias("pending"), (F.count(F.lit(1)) % 2 == 0).alias("finished"), F.lit(True).alias("running"))
    return scoring.run_state(runs).groupBy("state").agg(F.count(F.lit(1)).alias("runs"))


@query("WITH c AS (SELECT c_mktsegment AS segment, o_orderstatus AS level, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY segment), 6) AS share FROM c")
def share_of_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    counts = rows.groupBy("segment", F.col("o_orderstatus").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("segment")), 6))


@query("SELECT n_name AS state, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY n DESC, state LIMIT 12")
def top_states(spark, sf_dir):
    return raw_loans(spark, sf_dir).groupBy(F.col("addr_state").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loan_amnt"), 2).alias("total")).orderBy(F.desc("n"), "state").limit(12)


@query("WITH a AS (SELECT l_returnflag AS name, 'item' AS side FROM lineitem UNION SELECT o_orderstatus, 'order' FROM orders) SELECT name, count_if(side = 'item') > 0 AS in_items, count_if(side = 'order') > 0 AS in_orders FROM a GROUP BY 1")
def level_sets(spark, sf_dir):
    """Union, intersection and differences of two level sets, as a full outer join."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name")).distinct().withColumn("a", F.lit(True))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("name")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "name", "full_outer").select("name", F.coalesce("a", F.lit(False)).alias("in_items"), F.coalesce("b", F.lit(False)).alias("in_orders"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, try_cast(event_type AS DOUBLE) AS as_number FROM events")
def json_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").try_cast("double").alias("as_number"))


@query("SELECT lang, count(*) AS rows, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY 1")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.sha2(F.col("text").cast("binary"), 256)).alias("contents"))


@query("WITH v AS (SELECT doc_id, quality, toxic FROM labels) SELECT 'quality' AS \"column\", sum(quality)::DOUBLE AS total, count(*) AS n FROM v UNION ALL SELECT 'toxic', sum(toxic)::DOUBLE, count(*) FROM v")
def unpivot_totals(spark, sf_dir):
    return unpivoted(table(spark, sf_dir, "labels"), ["quality", "toxic"], "double").groupBy("column").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
