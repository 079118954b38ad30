"""Text files as tables: header search, ingest to Parquet with an audit, uploads with typed problems.

Files are read as lines, which Spark splits, and parsed by `from_csv`, so a file of any size is work for
many tasks; a quoted field cannot hold a line break. What stands before the header is found in each
file's first block. The audit comes from the job that writes: rows are counted as they pass.
"""

from __future__ import annotations

import csv
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import parse


class UploadError(ValueError):
    """A file that can't be read as a table; kind: suffix, missing, empty, header_only, ragged or not_text."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): the lines that aren't blank, with their file and whether they are of its first block."""
    text = spark.read.text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first_block")).where(F.trim("value") != "")


def n_fields(value: Column) -> Column:
    """How many fields a line has: commas outside quotes, and one."""
    return F.length(F.regexp_replace(F.regexp_replace(value, r'"([^"]|"")*"', ""), "[^,]", "")) + 1


def find_headers(spark: SparkSession, path: str, expected: list[str], scan: int = 10) -> DataFrame:
    """(file, line_no, hits, header, before): of each file's first `scan` lines that with most expected names, the first of equals, and the lines before it. Files without a hit are left out."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first_block"), F.monotonically_increasing_id().alias("at"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    top = text.where("first_block").withColumn("line_no", (number - 1).cast("long")).where(F.col("line_no") < scan)
    names = F.transform(F.split("value", ","), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    hits = F.size(F.array_intersect(names, F.array(*map(F.lit, expected)))).cast("long")
    found = top.withColumn("hits", hits).groupBy("file").agg(F.max_by(F.struct("line_no", "hits", F.col("value").alias("header")), F.struct("hits", -F.col("line_no"))).alias("h"), F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("top"))
    before = F.transform(F.filter("top", lambda x: x["line_no"] < F.col("h.line_no")), lambda x: x["value"])
    return found.where("h.hits > 0").select("file", "h.line_no", "h.hits", "h.header", before.alias("before"))


def header_names(line: str) -> list[str]:
    return [n.strip() for n in next(csv.reader([line]))]


def _fields(value: Column, names: list[str]) -> dict[str, Column]:
    """Each field of a line by its column's name, as text; of columns of one name the first."""
    record = F.from_csv(value, ", ".join(f"c{i} string" for i in range(len(names))), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return {n: record[f"c{i}"] for i, n in reversed(list(enumerate(names)))}


class Audit(NamedTuple):
    source: str
    output: str
    header_row: int
    rows_read: int
    rows_written: int
    junk_rows_dropped: int
    ragged_rows_dropped: int
    columns_written: list[str]
    columns_absent: list[str]
    #: Of each number column: texts that are no number.
    unreadable: dict[str, int]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(item, value): the counts and lists as text, without paths."""
        rows = [(n, str(getattr(self, n))) for n in ("header_row", "rows_read", "rows_written", "junk_rows_dropped", "ragged_rows_dropped")]
        rows += [(n, ",".join(getattr(self, n))) for n in ("columns_written", "columns_absent")] + [(f"unreadable {c}", str(n)) for c, n in sorted(self.unreadable.items())]
        return spark.createDataFrame(rows, "item string, value string")


def ingest_csv(spark: SparkSession, path: str, out: str, wanted: list[str], numeric: list[str], id_column: str | None = None, rename: dict[str, str] | None = None, *, row_limit: int | None = None) -> Audit:
    """Writes the wanted columns of CSV files as Parquet, numbers as float, and says what became of the rows.

    Rows whose id is no number are junk, or, without an id column, rows without any value; lines with
    more fields than the header are dropped apart. wanted, numeric: names in the file; id_column: the
    name in the output. Files may differ in the order of their columns and in what stands before.
    """
    rename = rename or {}
    spark = spark.newSession()  # a session that has observed something can't be part of a task any more, as some models have it
    named = find_headers(spark, path, wanted)
    layouts = named.groupBy("header", "before").agg(F.min("line_no").alias("line_no")).orderBy("header", "before").collect()  # a row a layout
    if not layouts:
        raise ValueError(f"none of the requested columns exists in {path}")
    present = [c for c in wanted if any(c in header_names(r.header) for r in layouts)]
    rows = lines(spark, path)
    if len(layouts) > 1:
        rows = rows.join(named.select("file", "header", "before"), "file")
        kinds = [(F.col("header") == r.header) & (F.col("before") == F.array(*map(F.lit, r.before)).cast("array<string>")) for r in layouts]
    else:
        kinds = [F.lit(True)]
    skipped = [F.col("first_block") & F.col("value").isin(r.header, *r.before) for r in layouts]

    def by_layout(parts: list[Column]) -> Column:
        out = F.when(kinds[0], parts[0])
        for k, p in zip(kinds[1:], parts[1:]):
            out = out.when(k, p)
        return out

    rows = rows.where(~by_layout(skipped)).withColumn("ragged", by_layout([n_fields(F.col("value")) > len(header_names(r.header)) for r in layouts]))
    rows = rows.limit(row_limit) if row_limit is not None else rows
    passed, kept = Observation(), Observation()
    rows = rows.observe(passed, F.count(F.lit(1)).alias("read"), F.count_if("ragged").alias("ragged")).where(~F.col("ragged"))
    records = [_fields(F.col("value"), header_names(r.header)) for r in layouts]
    text = rows.select(*[by_layout([r.get(c, F.lit(None).cast("string")) for r in records]).alias(rename.get(c, c)) for c in present])
    numbers = {rename.get(c, c) for c in numeric}
    usable = parse.number(F.col(id_column)).isNotNull() if id_column in text.columns else F.coalesce(*[parse.present(F.col(c)) for c in text.columns]).isNotNull()
    wrong = [F.count_if(parse.present(F.col(c)).isNotNull() & parse.number(F.col(c)).isNull()).alias(c) for c in text.columns if c in numbers]
    text = text.where(usable).observe(kept, F.count(F.lit(1)).alias("written"), *wrong)
    text.select(*[(parse.number(F.col(c)).cast("float") if c in numbers else parse.present(F.col(c))).alias(c) for c in text.columns]).write.mode("overwrite").parquet(out)
    read, written = passed.get, kept.get
    if not written["written"]:
        raise ValueError(f"no usable rows in {path}")
    return Audit(path, out, min(r.line_no for r in layouts), read["read"], written["written"], read["read"] - read["ragged"] - written["written"], read["ragged"], text.columns, [c for c in wanted if c not in present], {c: n for c, n in written.items() if c != "written"})


class Upload(NamedTuple):
    names: list[str]
    header: str
    rows: int


def check_upload(spark: SparkSession, path: str) -> Upload:
    """The file's columns and rows, or an UploadError; one pass over the lines. The header is the first line that isn't blank; shorter rows are filled, longer ones are a problem."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if not name.lower().endswith((".csv", ".txt")):
        raise UploadError("suffix", f"{name}: only .csv and .txt files are read")
    try:
        text = lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    except AnalysisException as e:
        raise UploadError("missing", f"{name}: no such file ({e.getCondition()})") from e
    found = text.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.is_valid_utf8("value")).alias("bad"), F.max(n_fields(F.col("value"))).alias("widest"), F.min_by("value", F.struct(~F.col("first_block"), "at")).alias("header")).first()
    if not found.n:
        raise UploadError("empty", f"{name} holds no line")
    if found.bad:
        raise UploadError("not_text", f"{name}: {found.bad} lines are no UTF-8")
    names = header_names(found.header)
    if found.n == 1:
        raise UploadError("header_only", f"{name} ends after its header")
    if found.widest > len(names):
        raise UploadError("ragged", f"{name}: a row has {found.widest} fields, the header {len(names)}")
    return Upload(names, found.header, found.n - 1)


def _records(text: DataFrame, upload: Upload) -> DataFrame:
    fields = _fields(F.col("value"), upload.names)
    return text.where(F.col("value") != upload.header).select(*[fields[c].alias(c) for c in dict.fromkeys(upload.names)])


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a checked file, every column as text."""
    upload = check_upload(spark, path)
    return _records(lines(spark, path), upload)


def upload_blocks(spark: SparkSession, folder: str, upload: Upload, files: int = 1) -> DataFrame:
    """The rows of the files in a folder as a stream, `files` of them a block; new files are read when they come."""
    text = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    return _records(text.where(F.trim("value") != ""), upload)


class ForeignYears(ValueError):
    """A date range that let in other years: the dates aren't year first."""


def year_sample(df: DataFrame, date: str, years: list[int], n: int, seed: int) -> tuple[DataFrame, int]:
    """(n rows of the given years by the order of a seeded hash of the row, how many there are). date: ISO text, whose range is pushed into the scan."""
    inside = df.where((F.col(date) >= f"{min(years)}-01-01") & (F.col(date) < f"{max(years) + 1}-01-01"))
    year = F.substring(date, 1, 4).try_cast("int")
    available, foreign = inside.agg(F.count(F.lit(1)), F.count_if(year.isNotNull() & ~year.isin(*years))).first()
    if foreign:
        raise ForeignYears(f"{foreign} of {available} rows in the range of {date} are of other years than {years}")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*inside.columns))), 256)
    return inside.orderBy(place).limit(n), available
