"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import scratch, stored  # noqa: F401  used by this subpackage's modules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def looked_up(rows: DataFrame, other: DataFrame, key: str, value: str, hot: DataFrame, spread_by: Column) -> DataFrame:
    """rows with the value that `other` (a row a key) has for their key, or null.

    hot: keys that many rows have, each 1/10,000 of all rows or more, so at most 10,000 keys; these are
    broadcast, and their rows are dealt by `spread_by` (of the key's type), so that no task gets a key's rows.
    """
    few = hot.select(key).join(other.select(key, value), key, "left").select(F.col(key), F.lit(True).alias("_hot"), F.col(value).alias("_value"))
    marked = rows.join(F.broadcast(few), key, "left").withColumn("_key", F.when(F.col("_hot"), spread_by).otherwise(F.col(key)))
    found = marked.join(other.select(F.col(key).alias("_key"), F.col(value).alias("_other")), "_key", "left")
    return found.select(*rows.columns, F.when(F.col("_hot"), F.col("_value")).otherwise(F.col("_other")).alias(value))


class Volume(NamedTuple):
    rows: int
    bytes: int


def volume(docs: DataFrame, text: str = "text") -> Volume:
    """Rows and bytes of text, over the whole table: two numbers."""
    r = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(f"`{text}`")))).first()
    return Volume(r[0], r[1] or 0)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def plain_columns(docs: DataFrame, *named: str) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    return docs.select(*[F.col(f"`{c}`") for c in named])
