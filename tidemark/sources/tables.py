"""Tables and text files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class LeakageError(ValueError):
    """A column that is known only after the outcome was asked for."""


#: Columns that tell the outcome.
LEAKAGE = ("loan_status", "last_pymnt_d", "last_pymnt_amnt", "total_pymnt", "total_rec_prncp", "total_rec_int", "recoveries", "collection_recovery_fee", "out_prncp", "duration_months", "event", "outcome", "observation_end_month")


def guard(df: DataFrame, blocked: tuple[str, ...] = LEAKAGE) -> DataFrame:
    """The frame itself, unless it holds a blocked column."""
    if bad := sorted(set(df.columns) & set(blocked)):
        raise LeakageError(f"columns known only after the outcome: {', '.join(bad)}")
    return df


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """(column, rows, filled, missing) of a Parquet table, answered from its files' footers: counts are pushed into the scan, so no data page is read. Flat columns only."""
    own = spark.newSession()  # its settings are nobody else's
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = own.read.parquet(path)
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(flat)]).first()
    return spark.createDataFrame([(c, row["rows"], row[f"c{i}"], row["rows"] - row[f"c{i}"]) for i, c in enumerate(flat)], "column string, rows long, filled long, missing long")
