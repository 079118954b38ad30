"""Cleaning with values learned on training rows only: quantiles, medians, levels; applied and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators.profile import unpivoted
from tidemark.operators.ranks import quantiles, row_ranks


def fit_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, p1, median, p99, high): bounds are the 0.5 and 99.5 percentiles."""
    q = quantiles(unpivoted(df, columns, "double"), ["column"], "value", [0.005, 0.01, 0.5, 0.99, 0.995])
    return q.select("column", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "p1", "median", "p99", "high"))])


def fit_levels(df: DataFrame, columns: list[str], rare_below: int) -> DataFrame:
    """(column, level, count, rank, rare): levels by frequency, ties by level."""
    counts = unpivoted(df, columns, "string").where("value IS NOT NULL").groupBy("column", F.trim("value").alias("level")).count()
    ranked = row_ranks(counts.withColumn("less", -F.col("count")), "less", ["level"], ["column"])
    return ranked.select("column", "level", "count", F.col("r").cast("int").alias("rank"), (F.col("count") < rare_below).alias("rare"))


def align(df: DataFrame, column: str, levels: DataFrame, other: str = "other") -> DataFrame:
    """Unseen levels become null, rare ones `other`. levels: of this column, from fit_levels; as many as the training rows had."""
    own = levels.where(F.col("column") == column).select(F.col("level").alias("_level"), F.col("rare").alias("_rare"))
    joined = df.join(own, F.trim(F.col(column)) == F.col("_level"), "left")
    aligned = F.when(F.col("_level").isNull(), None).when(F.col("_rare"), other).otherwise(F.col("_level"))
    return joined.withColumn(f"{column}_aligned", aligned).drop("_level", "_rare")


def winsorised(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The column clipped to its own quantiles."""
    q = quantiles(df, [], column, [low, high]).withColumnRenamed("q", "_q")
    clipped = F.least(F.greatest(F.col(column), F.col("_q")[0]), F.col("_q")[1])
    return df.crossJoin(F.broadcast(q)).withColumn(f"{column}_clipped", F.when(F.col(column).isNotNull(), clipped)).drop("_q")  # one row, or none without a value


def flags(checks: dict[str, Column], most: int = 5) -> tuple[Column, Column]:
    """(names of the fields whose check holds, at most `most` of them; how many hold)."""
    held = F.filter(F.array(*[F.when(c, name) for name, c in checks.items()]), lambda x: x.isNotNull())
    return F.array_join(F.slice(held, 1, most), ", "), F.size(held).cast("long")


def numeric_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rule, count, detail) for text columns read as numbers: rescued, unreadable with three examples, missing."""
    long = unpivoted(df, columns, "string")
    text = F.col("value")
    example = F.substring(F.trim(text), 1, 40)
    unreadable = parse.present(text).isNotNull() & parse.number(text).isNull()
    found = long.where(unreadable).groupBy("column", example.alias("e")).agg(F.count(F.lit(1)).alias("c"))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("e"))).where("r <= 3")
    three = ranked.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("e")), ", ").alias("examples"))
    agg = long.groupBy("column").agg(
        F.count_if(parse.rescued(text)).alias("rescued"), F.count_if(unreadable).alias("unreadable"), F.count_if(parse.number(text).isNull()).alias("missing_after"),
    ).join(three, "column", "left").withColumn("examples", F.coalesce("examples", F.lit("")))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("count"), (F.col("examples") if r == "unreadable" else F.lit("")).alias("detail")) for r in ("rescued", "unreadable", "missing_after")])
    return agg.select("column", F.explode(rules).alias("x")).select("column", "x.rule", "x.count", "x.detail")


def full_report(df: DataFrame, numbers: DataFrame, levels: DataFrame, numeric: list[str], categorical: list[str], unseen: int = 10) -> DataFrame:
    """(column, rule, detail, count) of text columns cleaned with fitted values: what numeric_report has, clipped and out_of_range of numbers, and pooled, missing_after and the most frequent unseen levels of categories.

    numbers: fit_numeric's rows (p1 and p99 clip, low and high are the range); levels: fit_levels' rows.
    Reports of blocks add up: sum the counts by column, rule and detail.
    """
    long = unpivoted(df, numeric, "string").join(F.broadcast(numbers), "column")  # a row per column
    x = parse.number(F.col("value"))
    bounds = long.groupBy("column").agg(F.count_if((x < F.col("p1")) | (x > F.col("p99"))).alias("clipped"), F.count_if((x < F.col("low")) | (x > F.col("high"))).alias("out_of_range"))
    counts = unpivoted(df, categorical, "string").groupBy("column", parse.present(F.col("value")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(levels.select("column", "level", "rare"), ["column", "level"], "left")
    is_unseen = F.col("level").isNotNull() & F.col("rare").isNull()
    pooled = known.groupBy("column").agg(F.sum(F.when(F.col("rare"), F.col("n")).otherwise(0)).alias("pooled"), F.sum(F.when(F.col("rare").isNull(), F.col("n")).otherwise(0)).alias("missing_after"))
    top = known.where(is_unseen).withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "level"))).where(F.col("r") <= unseen)  # a limit a group, applied before the exchange

    def rules(rows: DataFrame, names: list[str]) -> DataFrame:
        return rows.select("column", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit("").alias("detail"), F.col(r).cast("long").alias("count")) for r in names])).alias("x")).select("column", "x.*")

    every = numeric_report(df, numeric).select("column", "rule", "detail", "count").unionByName(rules(bounds, ["clipped", "out_of_range"]))
    return every.unionByName(rules(pooled, ["pooled", "missing_after"])).unionByName(top.select("column", F.lit("unseen").alias("rule"), F.col("level").alias("detail"), F.col("n").alias("count")))


def merged_report(reports: DataFrame, examples: int = 3, unseen: int = 10) -> DataFrame:
    """The report of a file from those of its blocks: counts add up, examples are the first ones, unseen levels the most frequent ones (of the levels that blocks named)."""
    plain = reports.where("rule <> 'unseen'").groupBy("column", "rule").agg(F.sum("count").alias("count"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("detail") != "", F.split("detail", ", "))))).alias("e"))
    plain = plain.select("column", "rule", F.array_join(F.slice(F.array_sort("e"), 1, examples), ", ").alias("detail"), "count")
    levels = reports.where("rule = 'unseen'").groupBy("column", "rule", "detail").agg(F.sum("count").alias("count"))
    levels = levels.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "detail"))).where(F.col("r") <= unseen).drop("r")
    return plain.unionByName(levels)


def first_per_key(df: DataFrame, key: Column, order: Column, compared: list[str]) -> DataFrame:
    """Every row with its kind: kept (the first in order), duplicate_row (equal to the kept row) or duplicate_key.

    The first row of a key is a partial aggregate, joined back by key: a key that a third of all rows
    share is split by adaptive execution. Orders are unique within a key.
    """
    rows = df.withColumns({"_key": key, "_order": order, "_same": F.struct(*compared)})
    first = rows.groupBy("_key").agg(F.min("_order").alias("_least"), F.min_by("_same", "_order").alias("_first"))
    marked = rows.join(first.withColumnRenamed("_key", "_key2"), F.col("_key").eqNullSafe(F.col("_key2")))
    kind = F.when(F.col("_order") == F.col("_least"), "kept").when(F.col("_same") == F.col("_first"), "duplicate_row").otherwise("duplicate_key")
    return marked.withColumn("kind", kind).drop("_key", "_key2", "_order", "_same", "_least", "_first")
