"""Samples and splits that don't depend on partitions: rows are ordered by a hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_seed(seed: int, key: Column) -> Column:
    """The first four bytes of sha256('seed:key') as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def reservoir(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """The k rows with the smallest seeds (ties by key): a top-k, no full sort."""
    return df.orderBy(row_seed(seed, F.col(key)), key).limit(k)


def stratified(df: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """Proportional: each stratum's floor of n * share, one at least; what is left over goes to the largest. Ranks are taken per stratum."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.withColumn("_t", F.sum("_c").over(Window.partitionBy(F.lit(1))))
    quota = total.withColumn("_q", F.least(F.greatest(F.floor(F.lit(n) * F.col("_c") / F.col("_t")), F.lit(1)), F.col("_c")))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_c"), stratum))
    left = F.lit(n) - F.sum("_q").over(Window.partitionBy(F.lit(1)))
    quota = quota.withColumn("_q", F.col("_q") + F.when(place == 1, F.greatest(left, F.lit(0))).otherwise(0))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(row_seed(seed, F.col(key)), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).join(F.broadcast(quota.select(stratum, "_q")), stratum).where("_r <= _q").drop("_r", "_q")  # a row per stratum


def equal_pick(df: DataFrame, key: str, stratum: str, per: int, seed: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(row_seed(seed, F.col(key)), key))).where(F.col("_r") <= per).drop("_r")


def split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds part: `test` for about `share` of the keys by seed, else `train`; every copy of a key lies on one side."""
    return df.withColumn("part", F.when(row_seed(seed, F.col(key)) < int(2**32 * share), "test").otherwise("train"))
