"""Queries over text files: written from the order tables as a lender's files look, then read back."""

from __future__ import annotations

import numpy as np
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sampling, shapley
from tidemark.plans.registry import query
from tidemark.plans.views import LOANS, RAW, TIMES, loans
from tidemark.sources import ingest
from tidemark.sources.loans import raw_loans
from tidemark.sources.shipping import ship
from tidemark.sources.store import scratch, stored
from tidemark.sources.tables import table
from tidemark.streaming import blocks, explaining

FILES = 4
WANTED = ["id", "loan_amnt", "annual_inc", "amount_text", "issue_d", "purpose", "num_sats"]
NUMERIC = ["id", "loan_amnt", "annual_inc", "amount_text"]
#: What stands before the header and after the rows of each file.
BEFORE, AFTER = ["Notes offered by prospectus", ""], ["", "Total amount funded: 100", '"Loans that do not meet the credit policy",,,,']


def lender_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of CSV files with lines before the header, a footer, quotes, blank lines and some rows that are too long."""
    ship(spark)
    df = raw_loans(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("loan_amnt").cast("string").alias("loan_amnt"), F.col("annual_inc").cast("string").alias("annual_inc"), "amount_text", "purpose", F.date_format("o_orderdate", "yyyy-MM-dd").alias("issue_d"))
    line = F.concat(F.to_csv(F.struct(*df.columns), {"quoteAll": "true", "nullValue": "n/a"}), F.when(df["id"].cast("long") % 151 == 0, ",more").otherwise(""))
    header, before, after = ",".join(df.columns), BEFORE, AFTER

    def framed(parts):
        import pandas as pd

        yield pd.DataFrame({"value": [*before, header]})
        yield from parts
        yield pd.DataFrame({"value": after})

    folder = scratch(spark)
    df.select(line.alias("value")).repartition(FILES).mapInPandas(framed, "value string").write.text(folder)
    return folder


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ingest.Audit]:
    out = scratch(spark)
    audit = ingest.ingest_csv(spark, lender_files(spark, sf_dir), out, WANTED, NUMERIC, "member", {"id": "member", "amount_text": "amount"})
    return spark.read.parquet(out), audit


@query(f"""SELECT {len(BEFORE)}::BIGINT AS line_no, 6::BIGINT AS hits, {FILES}::BIGINT AS files, count(*) AS rows_below FROM orders""")
def header_row(spark, sf_dir):
    """Where the header of each written file stands, and the rows below the headers."""
    folder = lender_files(spark, sf_dir)
    found = ingest.find_headers(spark, folder, WANTED)
    below = spark.read.text(folder).where(~F.col("value").isin("", *BEFORE, *AFTER) & ~F.col("value").startswith("id,"))
    return found.groupBy("line_no", "hits").agg(F.count(F.lit(1)).alias("files")).crossJoin(F.broadcast(below.agg(F.count(F.lit(1)).alias("rows_below"))))  # one row


_CLEAN = "nullif(nullif(trim(amount_text), ''), 'n/a')"
_NUM = "try_cast(regexp_replace({c}, '[,%$]', '', 'g') AS DOUBLE)"
_IS = r"regexp_matches(regexp_replace({c}, '[,%$]', '', 'g'), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
_USABLE = "FROM raw WHERE id % 151 <> 0"


@query(f"""{RAW}, n AS (SELECT count(*) AS n, count_if(id % 151 = 0) AS long, count_if(id % 151 <> 0 AND {_CLEAN} IS NOT NULL AND NOT {_IS.format(c="trim(amount_text)")}) AS bad FROM raw)
SELECT unnest(['header_row', 'rows_read', 'rows_written', 'junk_rows_dropped', 'ragged_rows_dropped', 'columns_written', 'columns_absent', 'unreadable amount', 'unreadable annual_inc', 'unreadable loan_amnt', 'unreadable member']) AS item,
unnest(['{len(BEFORE)}', (n + {2 * FILES})::VARCHAR, (n - long)::VARCHAR, '{2 * FILES}', long::VARCHAR, 'member,loan_amnt,annual_inc,amount,issue_d,purpose', 'num_sats', bad::VARCHAR, '0', '0', '0']) AS value FROM n""")
def ingest_audit(spark, sf_dir):
    """Lender's files to Parquet: what the writing job counted."""
    return _ingested(spark, sf_dir)[1].frame(spark)


@query(f"""{RAW} SELECT id, round(loan_amnt::FLOAT::DOUBLE, 2) AS loan_amnt, CASE WHEN {_IS.format(c="trim(amount_text)")} THEN {_NUM.format(c="trim(amount_text)")}::FLOAT::DOUBLE END AS amount, strftime(o_orderdate, '%Y-%m-%d') AS issue_d, purpose {_USABLE}""")
def ingest_rows(spark, sf_dir):
    """The rows of the Parquet that ingest wrote."""
    df, _ = _ingested(spark, sf_dir)
    return df.select(F.col("member").cast("long").alias("id"), F.round(F.col("loan_amnt").cast("double"), 2).alias("loan_amnt"), F.col("amount").cast("double").alias("amount"), "issue_d", "purpose")


@query(f"""{RAW}, s AS (SELECT count(*) AS available, least(count(*), 500) AS n FROM raw WHERE id % 151 <> 0 AND year(o_orderdate) IN (1996, 1997)) SELECT available, n AS taken, true AS inside, true AS again FROM s""")
def sample_of_years(spark, sf_dir):
    """500 rows of two years, whose range of dates is pushed into the scan of the ingested file, and how many there are."""
    df, _ = _ingested(spark, sf_dir)
    sample, available = ingest.year_sample(df, "issue_d", [1996, 1997], 500, 7)
    once, twice = (F.array_sort(F.collect_list("member")) for _ in range(2))
    again = ingest.year_sample(df, "issue_d", [1996, 1997], 500, 7)[0].agg(twice.alias("b"))
    found = sample.agg(F.count(F.lit(1)).alias("taken"), F.min(F.substring("issue_d", 1, 4).isin("1996", "1997")).alias("inside"), once.alias("a")).crossJoin(again)  # one row each
    return found.select(F.lit(available).cast("long").alias("available"), "taken", "inside", (F.col("a") == F.col("b")).alias("again"))


@query("""SELECT unnest(['customers.csv', 'customers.xlsx', 'empty.csv', 'header.csv', 'nowhere.csv', 'ragged.csv', 'latin.csv']) AS file, unnest(['read', 'suffix', 'empty', 'header_only', 'missing', 'ragged', 'not_text']) AS outcome, unnest([(SELECT count(*) FROM customer), 0, 0, 0, 0, 0, 0])::BIGINT AS rows""")
def upload_problems(spark, sf_dir):
    """Customers as an upload, and files that can't be read, each told apart."""
    base = scratch(spark)
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    header = spark.createDataFrame([(0, ",".join(own.columns))], "at int, value string")
    rows = own.select(F.lit(1).alias("at"), F.to_csv(F.struct(*own.columns)).alias("value"), "c_custkey")
    whole = header.unionByName(rows.drop("c_custkey")).repartition(1).sortWithinPartitions("at").select("value")  # one small file: the upload
    whole.write.text(f"{base}/customers.csv")
    whole.limit(5).write.text(f"{base}/customers.xlsx")
    header.select("value").write.text(f"{base}/header.csv")
    header.select(F.lit("  ").alias("value")).write.text(f"{base}/empty.csv")
    header.unionByName(rows.where("c_custkey % 3 = 0").select("at", F.concat("value", F.lit(",1,2")).alias("value"))).repartition(1).sortWithinPartitions("at").select("value").write.text(f"{base}/ragged.csv")
    header.unionByName(rows.select("at", F.concat("value", F.unhex(F.lit("E9")).cast("string")).alias("value"))).repartition(1).sortWithinPartitions("at").select("value").write.text(f"{base}/latin.csv")
    found = []
    for name in ("customers.csv", "customers.xlsx", "empty.csv", "header.csv", "nowhere.csv", "ragged.csv", "latin.csv"):
        try:
            found.append((name, "read", ingest.read_upload(spark, f"{base}/{name}").count()))
        except ingest.UploadError as e:
            found.append((name, e.kind, 0))
    return spark.createDataFrame(found, "file string, outcome string, rows long")


@query("""WITH k AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r, first_value(source) OVER (PARTITION BY text ORDER BY doc_id) AS s FROM documents)
SELECT doc_id, CASE WHEN r = 1 THEN 'kept' WHEN source = s THEN 'duplicate_row' ELSE 'duplicate_id' END AS kind FROM k""")
def stream_dedupe_first(spark, sf_dir):
    """First occurrences over four blocks that come one after the other, by state: the same as over the whole table."""
    ship(spark)
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("same_text")))
    base = scratch(spark)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    block = F.floor((F.col("doc_id") - low) * 4 / (high - low + 1))
    for k in range(4):  # a block is written when it comes, by any number of tasks, and is one micro-batch
        docs.where(block == k).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{base}/in")
        blocks.run_blocks(blocks.first_occurrences(stream, "doc_id", "same_text", ["same_text", "source"]), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("doc_id", "kind")


# -- explanations that go on where they were stopped


def _line(x):
    """A survival that is linear in its features, so attributions have a closed form."""
    return 1 - np.outer(x[:, 0] / 10 + x[:, 1] / 100_000 - x[:, 2] / 1_000_000, TIMES) / 1000


def _resumed(spark, sf_dir):
    """Every third loan explained in four blocks that come one after the other; the run is killed in its third block and started again. Returns the run, its targets and what stood when it was killed."""
    ship(spark)
    features = ["dti", "loan_amnt", "annual_inc"]
    df = stored(loans(spark, sf_dir).select(F.col("id").alias("row_id"), F.coalesce("dti", F.lit(5.0)).alias("dti"), F.col("loan_amnt").cast("double").alias("loan_amnt"), F.col("annual_inc").cast("double").alias("annual_inc")))
    ground = np.array(sampling.reservoir(df, "row_id", 50, 2).select(*features).collect(), float)
    wanted = df.where("row_id % 3 = 0")
    run = explaining.Explanations(scratch(spark))
    low, high = wanted.agg(F.min("row_id"), F.max("row_id")).first()
    blocks_seen = []

    def explain(rows):
        blocks_seen.append(1)
        if len(blocks_seen) == 3:
            raise RuntimeError("killed")
        return shapley.kernel_shap(rows, ground, features, _line, TIMES)

    killed, block = None, F.floor((F.col("row_id") - low) * 4 / (high - low + 1))
    for k in range(4):  # a block is written when it comes, by any number of tasks, and is one micro-batch
        wanted.where(block == k).write.mode("append").parquet(f"{run.folder}/targets")
        try:
            run.run(spark.readStream.schema(wanted.schema).parquet(f"{run.folder}/targets"), explain)
        except StreamingQueryException:
            killed = stored(run.snapshot(spark, wanted))  # the next start takes the third block up again, then the fourth
    return run, wanted, killed


_SEED2 = "('0x' || substr(sha256('2:' || id), 1, 8))::BIGINT"
_TARGETS = f"""{LOANS}, x AS (SELECT id, unnest(['dti', 'loan_amnt', 'annual_inc']) AS feature, unnest([coalesce(dti, 5.0) / 10, loan_amnt / 100000.0, -annual_inc / 1000000.0]::DOUBLE[]) AS v FROM loans),
g AS (SELECT id FROM loans ORDER BY {_SEED2}, id LIMIT 50), m AS (SELECT feature, avg(v) AS m FROM x JOIN g USING (id) GROUP BY 1), w AS (SELECT id FROM loans WHERE id % 3 = 0), b AS (SELECT min(id) AS lo, max(id) AS hi FROM w)"""


@query(f"""{_TARGETS} SELECT id AS row_id, floor((id - lo) * 4 / (hi - lo + 1))::INT AS batch, feature, t, round(-t / 1000.0 * (v - m), 6) + 0.0 AS phi FROM x JOIN m USING (feature) JOIN w USING (id), b, (SELECT unnest({TIMES}) AS t)""")
def explanations_resumed(spark, sf_dir):
    """After the restart each target has one result."""
    run, _, _ = _resumed(spark, sf_dir)
    return run.results(spark).select("row_id", F.col("batch").cast("int").alias("batch"), "feature", "t", (F.round("phi", 6) + 0.0).alias("phi"))


@query(f"""{_TARGETS}, k AS (SELECT count(*) AS n, count_if(floor((id - lo) * 4 / (hi - lo + 1)) < 2) AS half FROM w, b)
SELECT 'killed' AS "when", n AS target, half AS done, n - half AS pending, half > 0 AND half < n AS partial FROM k UNION ALL SELECT 'finished', n, n, 0, false FROM k""")
def explanation_progress(spark, sf_dir):
    """Targets, done and pending when the run was killed and when it had finished."""
    run, wanted, killed = _resumed(spark, sf_dir)
    return killed.select(F.lit("killed").alias("when"), "*").unionByName(run.snapshot(spark, wanted).select(F.lit("finished").alias("when"), "*"))


@query(f"""{_TARGETS} SELECT id AS row_id, floor((id - lo) * 4 / (hi - lo + 1))::INT AS batch FROM w, b ORDER BY batch DESC, row_id DESC LIMIT 10""")
def last_results(spark, sf_dir):
    """The ten results that came last."""
    run, _, _ = _resumed(spark, sf_dir)
    return run.last(spark, 10)


@query(f"""{LOANS} SELECT id, (id % 8)::INT AS block, CASE WHEN id % 8 IN (2, 5) AND id % 3 = 0 THEN 'explained' ELSE 'waiting' END AS state FROM loans""")
def fill_gained_blocks(spark, sf_dir):
    """A table in eight parts, two of which gain results and are rewritten."""
    rows = loans(spark, sf_dir).select("id", (F.col("id") % 8).cast("int").alias("block"), F.lit("waiting").alias("state"))
    path = scratch(spark)
    rows.repartition("block").write.partitionBy("block").parquet(path)
    gained = rows.where("block IN (2, 5) AND id % 3 = 0").withColumn("state", F.lit("explained"))
    explaining.fill_blocks(spark, path, gained, "id", ["state"])
    return spark.read.parquet(path).select("id", F.col("block").cast("int").alias("block"), "state")
