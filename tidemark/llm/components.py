"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step replaces links by links to the smallest neighbour; a hub's links are joined by its key with
the hub's smallest neighbour, a row a key that is stored first: both sides of the join are then plain
shuffles, so adaptive execution splits a hub's links. Steps are written to the shared folder, so the plan stays short
and a lost executor costs one step at most. Only two numbers per step reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(stored(_least(both)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (u, v), any direction, repeats and loops allowed. Returns (id, component_id) of every linked id but a component's smallest."""
    now = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == sign or not seen[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        sign = seen
        now = stored(_small(_large(now)))
