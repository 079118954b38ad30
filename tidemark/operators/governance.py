"""Runs, targets, files and models under control: states, marks, hashes and approval rules as tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranks import row_ranks
from tidemark.operators.sampling import row_seed


def with_applicant_ids(df: DataFrame, given: str, order: str, name: str = "applicant_id") -> DataFrame:
    """Adds the given id, or APP- and the row's number in file order, six digits at least; order: unique."""
    ranked = row_ranks(df, order, [])
    number = F.col("r").cast("string")
    return ranked.withColumn(name, F.coalesce(F.nullif(F.trim(given), F.lit("")), F.concat(F.lit("APP-"), F.lpad(number, F.greatest(F.length(number), F.lit(6)), "0")))).drop("r")


def targets(df: DataFrame, key: str, mode: str, n: int = 0, seed: int = 1) -> DataFrame:
    """Adds mark: explained or pending for targeted rows, else why not. df: key, done. mode: all, sample, first, skip."""
    if mode == "sample":
        chosen = df.orderBy(row_seed(seed, F.col(key)), key).limit(n).select(key, F.lit(True).alias("_t"))
    elif mode == "first":
        chosen = df.orderBy(key).limit(n).select(key, F.lit(True).alias("_t"))
    else:
        chosen = df.select(key, F.lit(mode == "all").alias("_t"))
    outside = {"sample": "outside sample", "first": "beyond cap"}.get(mode, "skipped")
    mark = F.when(F.col("done"), "explained").when(F.coalesce("_t", F.lit(False)), "pending").otherwise(outside)
    return df.join(chosen, key, "left").withColumn("mark", mark).drop("_t")


#: States in which a run's files are a partial snapshot.
UNFINISHED = ("running", "not started", "awaiting choice", "stopped", "failed", "finishing")


def snapshot(runs: DataFrame) -> DataFrame:
    """runs: state, n_rejected, target (0: all rejected), done, pending. Adds what is pending now and whether files are partial."""
    target = F.when(F.col("target") > 0, F.col("target")).otherwise(F.col("n_rejected"))
    pending = F.when(F.col("state") == "running", F.greatest(target - F.col("done"), F.lit(0))).when(F.col("state").isin("not started", "awaiting choice"), F.greatest(F.col("pending"), F.col("n_rejected") - F.col("done"))).otherwise(F.col("pending"))
    return runs.withColumns({"pending_now": pending, "partial": (F.col("n_rejected") > 0) & (F.col("state").isin(*UNFINISHED) | (pending > 0))})


def reason_columns(df: DataFrame, reasons: str, most: int) -> DataFrame:
    """A text list as columns reason_1 .. reason_most, empty where there are fewer."""
    parts = F.split(F.coalesce(F.col(reasons), F.lit("")), "; ")
    return df.withColumns({f"reason_{i}": F.coalesce(F.get(parts, F.lit(i - 1)), F.lit("")) for i in range(1, most + 1)})


def agreement(a: DataFrame, b: DataFrame, key: str, k: int = 4) -> DataFrame:
    """One row for two tables of (key, reasons list): share with the same first, mean overlap of the first k, share identical."""
    j = a.select(key, F.slice("reasons", 1, k).alias("x")).join(b.select(key, F.slice("reasons", 1, k).alias("y")), key)
    overlap = F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.size("y"), F.lit(1))
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.get("x", F.lit(0)) == F.get("y", F.lit(0))).cast("int")), 6).alias("top1"), F.round(F.avg(overlap), 6).alias("overlap"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("identical"))


def fingerprints(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """(path, size, modified, sha256) of the files below a path, hidden ones left out.

    Files are rows, dealt evenly, and read in the tasks by chunks through the interface of their own file
    system, so a file of any size takes a chunk of memory. Where the workers have no such interface, Spark
    reads the whole file, of 2 GB at most, and leaves out empty ones. The driver lists the names.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if path.split(":", 1)[0] in ("viewfs", "abfs", "wasb"):
        return listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    names = [(unquote(n),) for n in listed.inputFiles()]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            found = []
            for uri in part["path"]:
                scheme, rest = uri.split(":", 1)
                system, name = fs.FileSystem.from_uri(f"{scheme}:{quote(rest if rest.startswith('//') else '//' + rest)}")
                info, h = system.get_file_info(name), hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while block := stream.read(chunk):
                        h.update(block)
                found.append((uri, info.size, info.mtime, h.hexdigest()))
            yield pd.DataFrame(found, columns=["path", "size", "modified", "sha256"])

    files = spark.createDataFrame(names, "path string")
    return files.repartition(max(1, min(200, len(names)))).mapInPandas(read, "path string, size long, modified timestamp, sha256 string")


def file_sets(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, status): missing and extra of a set of files against the expected one."""
    both = expected.select(key, F.lit(True).alias("_e")).distinct().join(actual.select(key, F.lit(True).alias("_a")).distinct(), key, "full")
    return both.where("_e IS NULL OR _a IS NULL").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("status"))


def verify(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(path, verdict): ok, changed, missing, or was_missing for a file that was recorded as absent."""
    j = recorded.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "left")
    return j.select("path", F.when(F.col("was").isNull(), "was_missing").when(F.col("is").isNull(), "missing").when(F.col("was") == F.col("is"), "ok").otherwise("changed").alias("verdict"))


#: How far an explainer must agree with itself.
LEAST_TOP1, LEAST_OVERLAP = 0.90, 0.85


def approval_rules(records: DataFrame, evidence: DataFrame, files: DataFrame, samples: int, background: int) -> DataFrame:
    """(tag, A1_model_file .. A7_explain_settings, approved): the rules computed from records in text.

    records: (record), a model each: tag, model_sha256, features, defects, training. evidence: (path,
    body): findings about a model, of the kind that the path's folder names: metrics, cleaning, ablation,
    validation, settings. files: (path, sha256) of the model files, `models/<tag>`. Texts that are no
    JSON count for nothing; a rule whose evidence is lacking fails. All validations of a model file
    count, not the best.
    """
    get = lambda c, path, kind: F.try_variant_get(F.col(c), path, kind)
    names = lambda c: F.array_sort(F.coalesce(c, F.array().cast("array<string>")))
    m = records.select(F.try_parse_json("record").alias("v")).where("v IS NOT NULL")
    m = m.select(
        get("v", "$.tag", "string").alias("tag"), get("v", "$.model_sha256", "string").alias("sha"), names(get("v", "$.features.numeric", "array<string>")).alias("numeric"), names(get("v", "$.features.categorical", "array<string>")).alias("categorical"),
        get("v", "$.training.n_train", "long").alias("n_train"), F.coalesce(F.exists(get("v", "$.defects", "array<struct<id string, blocking boolean>>"), lambda d: F.coalesce(d["blocking"], F.lit(False))), F.lit(False)).alias("blocked"),
    ).where("tag IS NOT NULL")
    e = evidence.select("path", F.element_at(F.split("path", "/"), 1).alias("kind"), F.try_parse_json("body").alias("v")).where("v IS NOT NULL")
    e = e.select("path", "kind", "v", get("v", "$.model_tag", "string").alias("tag"), get("v", "$.provenance.inputs.model.sha256", "string").alias("of")).where("tag IS NOT NULL")
    e = e.join(m.select("tag", "sha", "numeric", "categorical", "n_train"), "tag")
    same, is_ = F.col("of") == F.col("sha"), lambda k: F.col("kind") == k
    holds = lambda c: F.coalesce(c, F.lit(False))
    good = holds((get("v", "$.reference_ceiling.top1_agreement", "double") >= LEAST_TOP1) & (get("v", "$.reference_ceiling.mean_top4_overlap", "double") >= LEAST_OVERLAP))
    settings = F.struct(get("v", "$.nsamples", "long").alias("nsamples"), get("v", "$.n_background", "long").alias("n_background"))
    tried = F.filter(get("v", "$.candidates", "array<struct<nsamples bigint, n_background bigint, verdict string>>"), lambda c: c["verdict"] == "PASS")
    passed = F.transform(tried, lambda c: F.struct(c["nsamples"].alias("nsamples"), c["n_background"].alias("n_background")))
    validation = is_("validation") & holds(same)
    found = e.groupBy("tag").agg(
        F.bool_or(is_("metrics") & (names(get("v", "$.features.numeric", "array<string>")) == F.col("numeric")) & (names(get("v", "$.features.categorical", "array<string>")) == F.col("categorical"))).alias("A2_features"),
        F.bool_or(is_("cleaning") & holds(same) & (F.col("n_train").isNull() | holds(get("v", "$.fitted_rows", "long") == F.col("n_train")))).alias("A4_cleaning_values"),
        F.bool_or(is_("ablation") & holds(same) & (F.size(get("v", "$.features", "array<string>")) > 0)).alias("A5_ablation"),
        F.bool_and(F.when(validation, good)).alias("A6_explainer_validation"),
        F.coalesce(F.min_by(settings, F.when(validation & ~good, F.col("path"))), F.max_by(settings, F.when(validation, F.col("path")))).alias("measured"),  # the first that fails, else the last
        F.flatten(F.collect_list(F.when(is_("settings") & holds(same), passed))).alias("tried"),
    )
    wanted = F.struct(F.lit(samples).cast("long").alias("nsamples"), F.lit(background).cast("long").alias("n_background"))
    there = files.select(F.regexp_replace("path", "^models/", "").alias("tag"), F.col("sha256").alias("actual"))
    rows = m.join(there, "tag", "left").join(found, "tag", "left")
    rows = rows.withColumns({"A1_model_file": F.col("actual") == F.col("sha"), "A3_no_blocking_defect": ~F.col("blocked"), "A7_explain_settings": (F.col("measured") == wanted) | F.array_contains("tried", wanted)})
    # fixed values: the rules' names
    rules = ["A1_model_file", "A2_features", "A3_no_blocking_defect", "A4_cleaning_values", "A5_ablation", "A6_explainer_validation", "A7_explain_settings"]
    return rows.select("tag", *[holds(F.col(r)).alias(r) for r in rules], reduce(lambda x, y: x & y, [holds(F.col(r)) for r in rules]).alias("approved"))


def approval(models: DataFrame) -> DataFrame:
    """(tag, failed, approved) of models with a flag per rule, named A1_... and so on, as approval_rules gives them; a null flag fails."""
    rules = sorted(c for c in models.columns if c[:1] == "A" and c[1:2].isdigit())
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), c) for c in rules]))
    return models.select("tag", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("approved"))


def slug(name: Column) -> Column:
    """A file name's safe form."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")


def run_day(run_id: Column) -> Column:
    """YYYY-MM-DD of a run id that begins YYYYMMDD_HHMMSS."""
    return F.when(run_id.rlike(r"^\d{8}_\d{6}"), F.concat_ws("-", F.substring(run_id, 1, 4), F.substring(run_id, 5, 2), F.substring(run_id, 7, 2)))


def typed(text: Column) -> Column:
    """(kind, number, value) of a text: missing, boolean, number, object, array or text; value: what a dictionary or list in the text holds, null for others."""
    t = F.trim(text)
    n = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    v = F.when(F.substring(t, 1, 1).isin("{", "["), F.try_parse_json(t))
    nested = F.when(v.isNotNull() & t.startswith("{"), "object").when(v.isNotNull(), "array").otherwise("text")
    kind = F.when(text.isNull() | (t == ""), "missing").when(F.lower(t).isin("true", "false"), "boolean").when(n.isNotNull(), "number").otherwise(nested)
    return F.struct(kind.alias("kind"), n.alias("number"), v.alias("value"))


def years(text: Column) -> Column:
    """`2016-2018` or `2016` as an array of years; null where it is neither."""
    low, high = F.regexp_extract(text, r"^\s*(\d{4})", 1), F.regexp_extract(text, r"-\s*(\d{4})\s*$", 1)
    whole = text.rlike(r"^\s*\d{4}\s*(-\s*\d{4}\s*)?$")
    a, z = F.when(whole, low.try_cast("int")), F.when(whole, F.when(high != "", high.try_cast("int")).otherwise(low.try_cast("int")))
    return F.when(a <= z, F.sequence(a, z))
