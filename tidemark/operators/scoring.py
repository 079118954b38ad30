"""Batch scoring: decisions, monitoring aggregates, post-run checks, input quality, histories, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.profile import unpivoted
from tidemark.sources.store import stored


def decided(df: DataFrame, pd: Column, threshold: float) -> DataFrame:
    """Adds pd and decision: the written value, rounded half-even to four places, decides."""
    return df.withColumn("pd", F.bround(pd, 4)).withColumn("decision", F.when(F.col("pd") >= threshold, "reject").otherwise("approve"))


def histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    """(bin, low, high, applicants): every bin, also empty ones."""
    counts = df.groupBy(F.least(F.floor(F.col("pd") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("applicants"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.round(F.col("bin") / bins, 4).alias("low"), F.round((F.col("bin") + 1) / bins, 4).alias("high"), F.coalesce("applicants", F.lit(0)).alias("applicants"))


def segments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(segment, level, decision, applicants, share): counts per level and decision of several segments in one pass."""
    counts = unpivoted(df, columns, "string", ["decision"]).groupBy(F.col("column").alias("segment"), F.coalesce("value", F.lit("(missing)")).alias("level"), "decision").agg(F.count(F.lit(1)).alias("applicants"))
    return counts.withColumn("share", F.round(F.col("applicants") / F.sum("applicants").over(Window.partitionBy("segment", "level")), 6))


def run_checks(df: DataFrame, *, n_read: int, threshold: float, published: float, horizon: int, barred: list[str], wordings: list[str], pending: list[str], names: list[str], approved: bool, allow_unapproved: bool, quality: DataFrame | None = None) -> DataFrame:
    """(check, status, blocking, violations, examples): the nine checks of a scored run, in one pass over its rows.

    df: id, decision, threshold, pd_12m, pd_h, explained, reasons and features (arrays of what is stated),
    notice (text, or null). examples: the five smallest ids of a check's violations. quality: what
    input_quality gives; without it that check is left out. A threshold other than the published one, or
    an unapproved model that is allowed, is OVERRIDDEN.
    """
    reject, has_reason = F.col("decision") == "reject", F.size(F.filter("reasons", lambda x: ~F.trim(x).isin("", "nan"))) > 0
    finite = F.col("pd_h").isNotNull() & ~F.isnan("pd_h")
    waits = F.coalesce(F.col("explained").isin(*pending), F.lit(False))
    explained = (F.coalesce("explained", F.lit("")) == "explained") & has_reason
    rules = {
        "counts_add_up": ~F.coalesce(F.col("decision").isin("approve", "reject"), F.lit(False)),
        "decisions_match_threshold": ~finite | (F.abs(F.col("threshold") - threshold) > 1e-12) | ((F.col("pd_h") >= threshold) != reject),
        "risk_12m_le_horizon": (F.col("pd_12m") > F.col("pd_h")) if horizon >= 12 else F.lit(False),
        "rejected_have_reasons_or_pending": reject & ~explained & ~waits,
        "no_nondisclosable_stated_reason": F.exists("features", lambda x: x.isin(*barred) | x.startswith("grade")) | F.exists("reasons", lambda x: (x != "") & ~x.isin(*wordings)),
        "applicant_notices_clean": (F.col("notice").isNotNull() != (reject & explained)) | (F.coalesce(content_problems(F.col("notice"), F.col("id"), names), F.lit("")) != ""),
    }
    held = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in rules.items()]), lambda x: x.isNotNull())
    marked = stored(df.select("id", held.alias("held")))
    n = marked.count()
    broken = marked.select("id", F.explode("held").alias("check"))
    few = broken.withColumn("_n", F.row_number().over(Window.partitionBy("check").orderBy("id"))).where("_n <= 5").groupBy("check").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ", ").alias("examples"))
    counts = broken.groupBy("check").agg(F.count(F.lit(1)).alias("violations")).join(few, "check")
    every = df.sparkSession.createDataFrame([(k,) for k in rules], "check string").join(counts, "check", "left")
    missing = F.when(F.col("check") == "counts_add_up", F.lit(abs(n - n_read))).otherwise(0)
    rows = every.select("check", (F.coalesce("violations", F.lit(0)) + missing).cast("long").alias("violations"), F.coalesce("examples", F.lit("")).alias("examples")).withColumn("status", F.when(F.col("violations") > 0, "FAIL").otherwise("PASS"))
    facts = [("threshold_is_published", "PASS" if abs(threshold - published) <= 1e-12 else "OVERRIDDEN"), ("model_approved", "PASS" if approved else "OVERRIDDEN" if allow_unapproved else "FAIL")]
    rows = rows.unionByName(df.sparkSession.createDataFrame([(k, 0 if v != "FAIL" else 1, "", v) for k, v in facts], "check string, violations long, examples string, status string"))
    if quality is not None:
        bad = quality.where("problem").agg(F.count(F.lit(1)).alias("violations"), F.array_join(F.slice(F.array_sort(F.collect_list("column")), 1, 5), ", ").alias("examples"))  # a row per column
        rows = rows.unionByName(bad.select(F.lit("input_quality").alias("check"), "violations", "examples", F.when(F.col("violations") > 0, "FAIL").otherwise("PASS").alias("status")))
    return rows.select("check", "status", (F.col("status") == "FAIL").alias("blocking"), "violations", "examples")


def write_decisions(df: DataFrame, path: str) -> None:
    """The scored rows, a folder per decision; more rows are appended."""
    df.write.mode("append").partitionBy("decision").parquet(path)


def filled_in(rows: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows with the columns of `results` in place of their own where there is a result; row order, other columns and rows without one stay."""
    found = results.select(F.col(key), F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(found, key, "left")
    return joined.select(*[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def input_quality(current: DataFrame, training: DataFrame, columns: list[str], structural: list[str], limit: float = 0.05) -> DataFrame:
    """(column, missing, train_missing, problem): missing more often than in training by over `limit`; structural gaps are exempt."""
    rate = lambda df, name: unpivoted(df, columns, "string").groupBy("column").agg(F.round(F.avg(F.col("value").isNull().cast("int")), 6).alias(name))
    rows = rate(current, "missing").join(rate(training, "train_missing"), "column")
    return rows.withColumn("problem", ~F.col("column").isin(*structural) & (F.col("missing") - F.col("train_missing") > limit))


def content_problems(text: Column, own_id: Column, names: list[str]) -> Column:
    """Comma-joined problems of a notice: internal words, feature names, long decimals, percentages; the applicant's own id is taken out first."""
    t = F.regexp_replace(text, F.concat(F.lit(r"\b"), own_id.cast("string"), F.lit(r"\b")), "")
    found = F.array(
        F.when(F.lower(t).rlike(r"\b(model|score|threshold|probability|shap)\b"), "internal_word"), F.when(F.lower(t).rlike("|".join(names)), "feature_name"),
        F.when(t.rlike(r"\d+\.\d{3,}"), "long_decimal"), F.when(t.rlike(r"\d+(\.\d+)?\s*%"), "percentage"),
    )
    return F.array_join(F.array_compact(found), ",")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key, as a partial aggregate."""
    last = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_last"))
    return last.select("_last.*")


def run_state(df: DataFrame) -> DataFrame:
    """Adds state: the first that holds, from flags of a run."""
    state = F.when(F.col("failed_checks") > 0, "failed_checks").when(F.col("explaining"), "explaining").when(F.col("stopped"), "stopped").when(F.col("pending") > 0, "reasons_pending").when(F.col("finished"), "finished").when(F.col("running"), "running").otherwise("interrupted")
    return df.withColumn("state", state)


def processing_history(days: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(day, n, last_7, last_30): trailing sums over calendar days."""
    x = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    sums = {f"last_{k}": F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(x).rangeBetween(-(k - 1), 0)) for k in windows}  # one row per day
    return days.withColumns(sums)


def distinct_trailing(df: DataFrame, key: str, day: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(day, distinct_7, distinct_30): how many keys each trailing window of days holds.

    A key counts from a day on which it is seen until the window has passed or it is seen again; these
    spans don't overlap, so their begins and ends are counted by day and summed. A key that many rows
    have is one row a day; the last sum runs over days alone. Days are those of the table.
    """
    seen = df.where(F.col(day).isNotNull() & F.col(key).isNotNull()).select(key, F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).alias("x")).distinct()
    following = F.lead("x").over(Window.partitionBy(key).orderBy("x"))
    out = df.where(F.col(day).isNotNull()).select(F.col(day).alias("day"), F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).alias("x")).distinct()
    for k in windows:
        spans = seen.withColumn("end", F.least(F.col("x") + k, F.coalesce(following, F.col("x") + k)))
        steps = spans.select(F.explode(F.array(F.struct(F.col("x").alias("x"), F.lit(1).alias("n")), F.struct(F.col("end").alias("x"), F.lit(-1).alias("n")))).alias("s")).groupBy("s.x").agg(F.sum("s.n").alias("n"))
        both = out.select("x", F.lit(0).cast("long").alias("n")).unionByName(steps).groupBy("x").agg(F.sum("n").alias("n"))
        running = both.select("x", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("x")).alias(f"distinct_{k}"))  # a row per day
        out = out.join(running, "x")
    return out.drop("x")


def newest_runs(runs: DataFrame, order: str, newest: int) -> DataFrame:
    """The newest runs with approval_share, its change from the run before and the mean of the last three. runs: order (unique), approved, applicants."""
    last = runs.orderBy(F.desc(order)).limit(newest + 3)  # a report; three more for the trend
    w = Window.partitionBy(F.lit(1)).orderBy(order)  # at most newest + 3 rows
    share = F.col("approved") / F.nullif(F.col("applicants"), F.lit(0))
    rows = last.withColumn("_s", share)
    rows = rows.withColumns({"approval_share": F.round("_s", 6), "change": F.round(F.col("_s") - F.lag("_s").over(w), 6), "trend": F.round(F.avg("_s").over(w.rowsBetween(-2, 0)), 6)}).drop("_s")
    return rows.orderBy(F.desc(order)).limit(newest)


def overview(df: DataFrame, ranges: dict[str, tuple[float, float]], threshold: float) -> DataFrame:
    """One row of a scored table: rows, approved, rejected, mean_risk, rows_out_of_range, most_out_of_range; df: pd, decision and the columns of ranges."""
    outside = sum((F.coalesce(((F.col(c) < lo) | (F.col(c) > hi)).cast("int"), F.lit(0)) for c, (lo, hi) in ranges.items()), F.lit(0))
    n = F.count_if
    return df.agg(
        F.count(F.lit(1)).alias("rows"), n(F.col("decision") == "approve").alias("approved"), n(F.col("decision") == "reject").alias("rejected"),
        F.round(F.sum(F.coalesce(F.nanvl("pd", F.lit(0.0)), F.lit(0.0))) / F.count(F.lit(1)), 6).alias("mean_risk"), n(outside > 0).alias("rows_out_of_range"), F.coalesce(F.max(outside), F.lit(0)).cast("long").alias("most_out_of_range"),
    )


def risk_bins(df: DataFrame, threshold: float, bins: int = 40) -> DataFrame:
    """The histogram with the decision that most of a bin's applicants get: that of the bin's middle."""
    middle = (F.col("bin") + 0.5) / bins
    return histogram(df, bins).withColumn("decision", F.when(middle >= threshold, "reject").otherwise("approve"))


def reason_shares(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """(reason, n, share_of_rows)."""
    rows = F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))  # one row
    counts = df.select(F.explode(F.split(F.col(reasons), "; ")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(rows).select("reason", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share_of_rows"))
