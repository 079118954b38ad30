"""Fingerprints, rules from records, trailing distinct counts and reports that add up."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, evaluate, governance, scoring
from tidemark.sources.shipping import ship


def test_large_file_is_hashed_by_chunks(spark, tmp_path):
    ship(spark)
    (tmp_path / "d").mkdir()
    block, h = bytes(range(256)) * 4096, hashlib.sha256()
    with (tmp_path / "d" / "large file.bin").open("wb") as f:
        for _ in range(64):  # 64 MB, read a MB at a time
            f.write(block)
            h.update(block)
    (tmp_path / "d" / "empty").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r for r in governance.fingerprints(spark, str(tmp_path / "d")).collect()}
    assert got["large file.bin" if "large file.bin" in got else "large%20file.bin"].sha256 == h.hexdigest()
    assert got["empty"].sha256 == hashlib.sha256(b"").hexdigest() and got["empty"].size == 0


def test_verdicts_of_files(spark):
    was = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "path string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("e", "5")], "path string, sha256 string")
    assert {r.path: r.verdict for r in governance.verify(was, now).collect()} == {"a": "ok", "b": "changed", "c": "missing", "d": "was_missing"}
    assert {r.path: r.status for r in governance.file_sets(was, now, "path").collect()} == {"c": "missing", "e": "extra"}


BASE = {"tag": "m", "model_sha256": "s", "features": {"numeric": ["a", "b"], "categorical": ["c"]}, "defects": [{"id": "x", "blocking": False}], "training": {"n_train": 10}}
OF = {"model_tag": "m", "provenance": {"inputs": {"model": {"sha256": "s"}}}}
CEILING = {"reference_ceiling": {"top1_agreement": 0.9, "mean_top4_overlap": 0.85}, "nsamples": 600, "n_background": 100}
GOOD = {
    "metrics/m": {"model_tag": "m", "features": {"numeric": ["b", "a"], "categorical": ["c"]}}, "cleaning/m": {**OF, "fitted_rows": 10},
    "ablation/m": {**OF, "features": ["a"]}, "validation/1": {**OF, **CEILING},
}
SETTINGS = {"settings/m": {**OF, "candidates": [{"nsamples": 600, "n_background": 100, "verdict": "PASS"}]}}
LOW = {**OF, **CEILING, "reference_ceiling": {"top1_agreement": 0.89, "mean_top4_overlap": 0.9}}


@pytest.mark.parametrize(
    "record, evidence, sha, failed",
    [
        (BASE, GOOD, "s", ""),
        (BASE, GOOD, "other", "A1"),
        (BASE, GOOD, None, "A1"),
        ({**BASE, "features": {"numeric": ["a"], "categorical": ["c"]}}, GOOD, "s", "A2"),
        ({**BASE, "defects": [{"id": "x", "blocking": True}]}, GOOD, "s", "A3"),
        ({k: v for k, v in BASE.items() if k != "defects"}, GOOD, "s", ""),
        (BASE, {**GOOD, "cleaning/m": {**OF, "fitted_rows": 9}}, "s", "A4"),
        ({**BASE, "training": {}}, {**GOOD, "cleaning/m": {**OF, "fitted_rows": 9}}, "s", ""),
        (BASE, {**GOOD, "ablation/m": {**OF, "features": []}}, "s", "A5"),
        (BASE, {**GOOD, "validation/2": LOW}, "s", "A6"),  # a failing validation is not cancelled
        (BASE, {**GOOD, "validation/0": {**LOW, "nsamples": 300}}, "s", "A6,A7"),
        (BASE, {**GOOD, "validation/1": {**OF, **CEILING, "nsamples": 300}}, "s", "A7"),
        (BASE, {**GOOD, "validation/1": {**OF, **CEILING, "nsamples": 300}, **SETTINGS}, "s", ""),
        ({**BASE, "model_sha256": "t"}, GOOD, "t", "A4,A5,A6,A7"),  # findings of another model file
        (BASE, {}, "s", "A2,A4,A5,A6,A7"),
    ],
)
def test_approval_rules(spark, record, evidence, sha, failed):
    records = spark.createDataFrame([(json.dumps(record),), ("no json",), (None,)], "record string")
    found = spark.createDataFrame([(k, json.dumps(v)) for k, v in evidence.items()] + [("metrics/x", "{"), ("metrics/y", None)], "path string, body string")
    files = spark.createDataFrame([("models/m", sha)] if sha else [], "path string, sha256 string")
    rows = governance.approval_rules(records, found, files, 600, 100).collect()
    assert len(rows) == 1 and ",".join(c[:2] for c in rows[0].asDict() if c[:1] == "A" and not rows[0][c]) == failed and rows[0].approved == (not failed)


def test_trailing_distinct_counts(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    rows = [("a", day(0)), ("a", day(0)), ("a", day(3)), ("b", day(3)), ("a", day(11)), ("c", day(40)), ("b", day(41)), (None, day(41)), ("d", None)] + [("hot", day(k)) for k in range(0, 60, 2) for _ in range(20)]
    df = spark.createDataFrame(rows, "k string, day date")
    got = {r.day: (r.distinct_7, r.distinct_30) for r in scoring.distinct_trailing(df, "k", "day").collect()}
    days = sorted({d for _, d in rows if d})
    want = {d: tuple(len({k for k, x in rows if k and x and 0 <= (d - x).days < w}) for w in (7, 30)) for d in days}
    assert got == want


def test_newest_runs_and_their_trend(spark):
    df = spark.createDataFrame([(k, k, 10) for k in range(8)] + [(8, 0, 0)], "run int, approved int, applicants int")
    got = scoring.newest_runs(df, "run", 3).collect()
    assert [(r.run, r.approval_share, r.change) for r in got] == [(8, None, None), (7, 0.7, 0.1), (6, 0.6, 0.1)] and [r.trend for r in got] == [0.65, 0.6, 0.5]


def test_reports_of_blocks_add_up(spark):
    train = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(100)] + [(50.0, "rare")], "x double, s string")
    numbers, levels = clean.fit_numeric(train.select("x"), ["x"]), clean.fit_levels(train, ["s"], 5)
    new = spark.createDataFrame([("$5", "a", 0), ("words", "new", 0), ("", "rare", 1), ("-7", "new", 1), ("99.9", None, 1), ("more", "n/a", 0), ("worse", "newer", 1)], "x string, s string, k int")
    whole = sorted(map(tuple, clean.full_report(new, numbers, levels, ["x"], ["s"]).collect()))
    assert whole == sorted([
        ("x", "rescued", "", 1), ("x", "unreadable", "more, words, worse", 3), ("x", "missing_after", "", 4), ("x", "clipped", "", 2), ("x", "out_of_range", "", 2),
        ("s", "pooled", "", 1), ("s", "missing_after", "", 5), ("s", "unseen", "new", 2), ("s", "unseen", "newer", 1),
    ])
    parts = clean.full_report(new.where("k = 0"), numbers, levels, ["x"], ["s"]).unionByName(clean.full_report(new.where("k = 1"), numbers, levels, ["x"], ["s"]))
    assert sorted((r["column"], r.rule, r.detail, r["count"]) for r in clean.merged_report(parts).collect()) == whole


def test_summary_leaves_out_horizons_that_were_not_reached(spark):
    rows = [(d, e, 0.1 * d % 0.7, 0.05) for d in range(1, 15) for e in (0, 1) for _ in range(3)] + [(14, 0, 0.3, 0.05)]
    df = spark.createDataFrame(rows, "duration_months int, event int, risk double, hazard double")
    got = evaluate.summary(df, [6, 12, 24]).first()
    assert got.horizons == "6,12" and got.auc_24m is None and got.auc_6m is not None and got.n == len(rows)
    assert evaluate.summary(df.withColumn("v", F.lit("x")), [6, 12, 24], ["v"]).first().ibs == got.ibs
