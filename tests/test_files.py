"""Text files: headers, ingest with its audit, uploads and their problems, blocks with state."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ingest
from tidemark.streaming import blocks

MESSY = 'Notes offered by prospectus\n\nid,loan_amnt,int_rate,annual_inc,purpose,dti\n1,"5,000",13.5%,"60,000",car , n/a\n\n2,6000,7%,x,"home, improvement",1\n3,7000,7,,\n4,1,1,1,1,1,1,1\nTotal amount funded in policy code 1: 18000,,,,,\n'


@pytest.fixture
def messy(tmp_path):
    (tmp_path / "in.csv").write_text(MESSY)
    return str(tmp_path / "in.csv")


WANTED, NUMERIC = ["id", "loan_amnt", "int_rate", "annual_inc", "purpose", "num_sats"], ["loan_amnt", "int_rate", "annual_inc", "num_sats"]


def test_row_budget_types_and_absent_columns(spark, messy, tmp_path):
    audit = ingest.ingest_csv(spark, messy, str(tmp_path / "out"), WANTED, NUMERIC, "id")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert (audit.rows_read, audit.rows_written, audit.junk_rows_dropped, audit.ragged_rows_dropped, audit.header_row) == (5, 3, 1, 1, 2)
    assert audit.rows_read == audit.rows_written + audit.junk_rows_dropped + audit.ragged_rows_dropped
    assert audit.columns_absent == ["num_sats"] and audit.columns_written == WANTED[:-1] and audit.unreadable == {"loan_amnt": 0, "int_rate": 0, "annual_inc": 1}
    assert [t for _, t in got.dtypes] == ["string", "float", "float", "float", "string"]
    assert sorted(map(tuple, got.collect())) == [("1", 5000.0, 13.5, 60000.0, "car"), ("2", 6000.0, 7.0, None, "home, improvement"), ("3", 7000.0, 7.0, None, None)]


def test_renames_and_rows_without_an_id_column(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Amount Requested,Application Date,Risk_Score,Debt\n1000,2016-01-02,momentum,1200%\n, ,,\n2000,2017-05-06,700,5%\n")
    audit = ingest.ingest_csv(spark, str(tmp_path / "r.csv"), str(tmp_path / "out"), ["Amount Requested", "Application Date", "Risk_Score", "Debt"], ["Amount Requested", "Risk_Score"], None, {"Amount Requested": "loan_amnt", "Application Date": "application_d", "Risk_Score": "risk_score", "Debt": "dti_raw"})
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1000.0, "2016-01-02", None, "1200%"), (2000.0, "2017-05-06", 700.0, "5%")]
    assert (audit.rows_read, audit.junk_rows_dropped, audit.unreadable) == (3, 1, {"loan_amnt": 0, "risk_score": 1})


def test_files_with_columns_in_another_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x\nid,a,b\n1,10,p\n2,20,q\n")
    (tmp_path / "in" / "b.csv").write_text('"b","id","extra","a"\nr,3,?,30\n')
    audit = ingest.ingest_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["id", "a", "b"], ["a"], "id")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("1", 10.0, "p"), ("2", 20.0, "q"), ("3", 30.0, "r")]
    assert (audit.rows_read, audit.rows_written) == (3, 3)


def test_row_limit_and_files_without_rows(spark, messy, tmp_path):
    assert ingest.ingest_csv(spark, messy, str(tmp_path / "out"), WANTED, NUMERIC, "id", row_limit=1).rows_written == 1
    (tmp_path / "none.csv").write_text("id,loan_amnt\nTotal,\n")
    with pytest.raises(ValueError, match="no usable rows"):
        ingest.ingest_csv(spark, str(tmp_path / "none.csv"), str(tmp_path / "o"), WANTED, NUMERIC, "id")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="none of the requested"):
        ingest.ingest_csv(spark, str(tmp_path / "other.csv"), str(tmp_path / "o"), WANTED, NUMERIC, "id")


@pytest.mark.parametrize(
    "name, content, kind",
    [("a.xlsx", b"a,b\n1,2\n", "suffix"), ("a.csv", b"", "empty"), ("b.csv", b" \n\n", "empty"), ("c.csv", b"a,b\n", "header_only"), ("d.csv", b"a,b\n1,2\n1,2,3\n", "ragged"), ("e.csv", b"a,b\n1,\xe9t\xe9\n", "not_text"), ("missing.csv", None, "missing")],
)
def test_upload_problems(spark, tmp_path, name, content, kind):
    if content is not None:
        (tmp_path / name).write_bytes(content)
    with pytest.raises(ingest.UploadError) as e:
        ingest.read_upload(spark, str(tmp_path / name))
    assert e.value.kind == kind


def test_upload_keeps_short_rows_and_quotes(spark, tmp_path):
    (tmp_path / "u.csv").write_text('a,b,c\n1,"x, ""y""",3\n2\n\n')
    assert sorted(map(tuple, ingest.read_upload(spark, str(tmp_path / "u.csv")).collect())) == [("1", 'x, "y"', "3"), ("2", None, None)]


def test_sample_of_years_names_foreign_years(spark):
    df = spark.createDataFrame([(i, f"{2015 + i % 4}-03-{1 + i % 28:02d}") for i in range(200)] + [(500, None), (501, "soon")], "id long, day string")
    sample, available = ingest.year_sample(df, "day", [2016, 2017], 30, 5)
    rows = sample.collect()
    assert available == 100 and len(rows) == 30 and {r.day[:4] for r in rows} == {"2016", "2017"}
    assert {r.id for r in rows} != {r.id for r in ingest.year_sample(df, "day", [2016, 2017], 30, 6)[0].collect()}
    with pytest.raises(ingest.ForeignYears):
        ingest.year_sample(df, "day", [2015, 2018], 30, 5)
    plan = sample._jdf.queryExecution().toString()
    assert "2016-01-01" in plan


def plain_kinds(rows):
    """(position -> kind) by walking over the rows in order."""
    first, out = {}, {}
    for at, ident, *rest in rows:
        key = ("id", ident.strip()) if ident and ident.strip() else ("row", ident, *rest)
        same = (ident, *rest)
        out[at] = "kept" if key not in first else "duplicate_row" if first[key] == same else "duplicate_id"
        first.setdefault(key, same)
    return out


ROWS = [(i, None if i % 9 == 0 else f"a{i * 7 % 23}", f"v{i % 3}", None if i % 5 else "w") for i in range(90)]


@pytest.mark.parametrize("block", [7, 30, 90])
def test_blocks_find_what_the_whole_finds(spark, tmp_path, block):
    schema = "at long, member string, v string, w string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    parts = [ROWS[i : i + block] for i in range(0, len(ROWS), block)]

    def run():
        return blocks.run_blocks(blocks.first_occurrences(stream, "at", "member"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))

    half = len(parts) // 2
    for p in parts[:half]:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = run() if half else []
    for p in parts[half:]:  # the rest comes after the run has ended
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen += run()
    got = {r["at"]: r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain_kinds(ROWS) and len({s["block"] for s in seen if s["rows"]}) == len(parts)


def test_upload_comes_in_blocks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text("id,v\n" + "".join(f"{k * 10 + i},x\n" for i in range(10)))
    upload = ingest.check_upload(spark, str(tmp_path / "in" / "0.csv"))
    blocks.run_blocks(ingest.upload_blocks(spark, str(tmp_path / "in"), upload), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(int(r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(30))
    assert spark.read.parquet(str(tmp_path / "out")).select(F.max("v")).first()[0] == "x"
