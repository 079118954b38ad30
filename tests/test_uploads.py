"""An upload's plan, and its rows made ready for a trained model."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import uploads

NUMBERS, KINDS = ["loan_amnt", "annual_inc", "loan_to_income", "dti", "fico_midpoint", "mths_since_delinq", "term_months"], ["purpose"]
DROPS = {"loan_amnt": 0.02, "annual_inc": 0.01, "loan_to_income": 0.003, "dti": 0.0, "fico_midpoint": 0.0, "mths_since_delinq": 0.0, "term_months": 0.001, "purpose": 0.0}


@pytest.fixture(scope="module")
def spec(spark):
    rows = [(1000.0 * i, 100.0 * i + 1, 10.0 - i / 10, float(i), 700.0, None if i % 3 else float(i), 36 if i % 2 else 60, "car" if i % 2 else "home") for i in range(1, 100)]
    train = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in NUMBERS[:6]) + ", term_months int, purpose string")
    return uploads.fit_specification(train, NUMBERS, KINDS, DROPS, ["mths_since_delinq"])


def test_specification(spark, spec, tmp_path):
    assert spec.tiers["loan_amnt"] == spec.tiers["annual_inc"] == "required" and spec.tiers["dti"] == "unlearned" and spec.tiers["mths_since_delinq"] == "free"
    assert spec.levels == {"purpose": ["car", "home"]} and float(spec.stand_ins["dti"]) == 50.0
    spec.save(spark, str(tmp_path / "s"))
    assert uploads.Specification.load(spark, str(tmp_path / "s")) == spec


def test_plan(spark, spec):
    made = uploads.plan(["id", "Amount", "annual_inc", "term", "fico_range_low", "colour"], spec, {"Amount": "loan_amnt", "colour": "dti2"}, id_column="id")
    assert made.renamed["Amount"] == "loan_amnt"
    assert made.derived == {"loan_to_income": ["loan_amnt", "annual_inc"], "fico_midpoint": ["fico_range_low", "fico_range_high"], "term_months": ["term"]}
    assert set(made.missing) == {"dti", "mths_since_delinq", "purpose"} and made.missing["dti"] == "not in file"
    assert made.filled == {"dti": spec.stand_ins["dti"], "purpose": "car"} and made.refused == []
    assert made.ignored["term"] == "used for term_months" and made.ignored["fico_range_low"] == "used for fico_midpoint, fico_range_high" and "id" not in made.ignored
    got = {r.feature: r.status for r in made.table(spark, spec).collect()}
    assert (got["loan_amnt"], got["annual_inc"], got["loan_to_income"], got["dti"], got["mths_since_delinq"], got["term"]) == ("renamed", "read", "derived", "filled", "missing", "ignored")
    assert any("dti is not in the file" in w for w in made.warnings)


def test_missing_features_that_block(spark, spec):
    made = uploads.plan(["annual_inc"], spec)
    assert made.refused == ["loan_amnt"] and made.missing["loan_to_income"] == "needs loan_amnt"
    with pytest.raises(uploads.UploadRefused):
        uploads.prepared(spark.createDataFrame([(1.0,)], "annual_inc double"), made, spec, [])
    strict = uploads.plan(["loan_amnt", "annual_inc"], spec, fill=False)
    assert set(strict.refused) == {"dti", "fico_midpoint", "term_months", "purpose"} and strict.filled == {}


def test_rows_get_the_trained_columns(spark, spec):
    rows = [(1, "$5,000", "100", " 36 months", "700", "car"), (2, "words", "0", "n/a", None, "yacht"), (3, None, "", "60", "650", "n/a")]
    upload = spark.createDataFrame(rows, "id int, Amount string, annual_inc string, term string, fico_range_low string, purpose string")
    made = uploads.plan(upload.columns, spec, {"Amount": "loan_amnt"}, id_column="id")
    got = uploads.prepared(upload, made, spec, ["id"])
    assert got.columns == ["id", *spec.features, "mths_since_delinq_missing", "unreadable", "unseen"]
    assert sorted(map(tuple, got.collect())) == [
        (1, 5000.0, 100.0, 50.0, 50.0, 702.0, None, 36.0, "car", 1, 0, 0),
        (2, None, 0.0, None, 50.0, None, None, None, None, 1, 1, 1),
        (3, None, None, None, 50.0, 652.0, None, 60.0, None, 1, 0, 0),
    ]
    again = uploads.prepared(upload.repartition(3).withColumn("extra", F.lit(1)), uploads.plan([*upload.columns, "extra"], spec, {"Amount": "loan_amnt"}, id_column="id"), spec, ["id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
