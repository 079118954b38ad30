"""Drift of a current population against a reference one: PSI for numbers, total variation for levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.profile import unpivoted
from tidemark.operators.ranks import quantiles

#: Bands of drift, the floor of a share, rows needed.
MODERATE, LARGE, FLOOR, LEAST_ROWS = 0.10, 0.25, 1e-6, 500


def _sides(df: DataFrame, columns: list[str], kind: str, current: Column) -> DataFrame:
    return unpivoted(df.withColumn("_cur", current.cast("int")), columns, kind, ["_cur"])


def psi(df: DataFrame, columns: list[str], current: Column, bins: int = 10) -> DataFrame:
    """(feature, score, bins). Edges are the reference's quantiles, the outer ones open; missing values are a bin of their own."""
    long = _sides(df, columns, "double", current)
    edges = quantiles(long.where("_cur = 0"), ["column"], "value", [i / bins for i in range(bins + 1)]).select("column", F.array_distinct("q").alias("e"))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    bin_ = F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter("inner", lambda x: x <= F.col("value"))))
    counts = long.join(F.broadcast(edges.where(F.size("e") >= 2).select("column", inner.alias("inner"))), "column").groupBy("column", bin_.alias("bin"), F.size("inner").alias("cuts")).agg(F.count_if(F.col("_cur") == 0).alias("r"), F.count_if(F.col("_cur") == 1).alias("c"))
    w = Window.partitionBy("column")
    shares = counts.select("column", "cuts", F.greatest(F.col("r") / F.greatest(F.sum("r").over(w), F.lit(1)), F.lit(FLOOR)).alias("p"), F.greatest(F.col("c") / F.greatest(F.sum("c").over(w), F.lit(1)), F.lit(FLOOR)).alias("q"))
    # a bin that neither side has adds nothing: both shares are the floor
    return shares.groupBy(F.col("column").alias("feature")).agg(F.round(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))), 6).alias("score"), (F.max("cuts") + 1).cast("long").alias("bins"))


def level_shares(df: DataFrame, columns: list[str], current: Column) -> DataFrame:
    """(column, level, p, q): each level's share of the reference and of the current rows."""
    long = _sides(df, columns, "string", current)
    counts = long.groupBy("column", F.coalesce(F.trim("value"), F.lit("(missing)")).alias("level")).agg(F.count_if(F.col("_cur") == 0).alias("r"), F.count_if(F.col("_cur") == 1).alias("c"))
    sums = F.broadcast(counts.groupBy("column").agg(F.greatest(F.sum("r"), F.lit(1)).alias("all_r"), F.greatest(F.sum("c"), F.lit(1)).alias("all_c")))  # a row per column
    return counts.join(sums, "column").select("column", "level", (F.col("r") / F.col("all_r")).alias("p"), (F.col("c") / F.col("all_c")).alias("q"))


def tvd(df: DataFrame, columns: list[str], current: Column) -> DataFrame:
    """(feature, score, unseen, moves): total variation distance, share of unseen levels, the three largest moves."""
    shares = level_shares(df, columns, current)
    move = F.round(F.col("q") - F.col("p"), 4)
    largest = shares.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc(F.abs(move)), "level"))).where("r <= 3")  # a limit a group, applied before the exchange
    moves = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.col("level"), F.lit(" "), F.format_string("%.4f", move)).alias("t")))), lambda x: x["t"]), "; ")
    score = shares.groupBy("column").agg(F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 6).alias("score"), F.round(F.sum(F.when(F.col("p") == 0, F.col("q")).otherwise(0.0)), 6).alias("unseen"))
    return score.join(F.broadcast(largest.groupBy("column").agg(moves.alias("moves"))), "column").withColumnRenamed("column", "feature")  # a row per column


def band(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score), "unknown").when(score < MODERATE, "stable").when(score < LARGE, "moderate").otherwise("large")


def compare(df: DataFrame, numeric: list[str], categorical: list[str], current: Column) -> DataFrame:
    """(feature, kind, measure, score, status), the worst first; `insufficient` throughout for a small current population."""
    n = F.broadcast(df.agg(F.count_if(current).alias("n")))  # one row
    both = psi(df, numeric, current).select("feature", F.lit("numeric").alias("kind"), F.lit("PSI").alias("measure"), F.round("score", 4).alias("score"))
    both = both.unionByName(tvd(df, categorical, current).select("feature", F.lit("categorical").alias("kind"), F.lit("TVD").alias("measure"), F.round("score", 4).alias("score")))
    small = F.col("n") < LEAST_ROWS
    rank = F.array_position(F.array(*map(F.lit, ("large", "moderate", "unknown", "stable"))), F.col("status"))
    rows = both.crossJoin(n).select("feature", "kind", "measure", F.when(~small, F.col("score")).alias("score"), F.when(small, "insufficient").otherwise(band(F.col("score"))).alias("status"))
    return rows.orderBy(rank, F.desc("score"), "feature")


#: The colour of each status.
COLOURS = {"stable": "green", "moderate": "amber", "large": "red", "unknown": "amber", "insufficient": "grey"}


def headline(table: DataFrame) -> DataFrame:
    """One row for a table of compare: status, colour, how many features are in each band, and a sentence."""
    n = lambda s: F.count_if(F.col("status") == s)
    row = table.agg(n("large").alias("n_large"), n("moderate").alias("n_moderate"), n("unknown").alias("n_unknown"), n("insufficient").alias("_few"))
    status = F.when(F.col("_few") > 0, "insufficient").when(F.col("n_large") > 0, "large").when(F.col("n_moderate") + F.col("n_unknown") > 0, "moderate").otherwise("stable")
    text = F.when(F.col("status") == "insufficient", f"under {LEAST_ROWS} rows: too few to compare")
    text = text.when(F.col("status") == "large", F.format_string("%d feature(s) moved far from training: read decisions with care", "n_large"))
    text = text.when(F.col("status") == "moderate", F.format_string("%d feature(s) moved, %d had nothing to compare with", "n_moderate", "n_unknown")).otherwise("all features lie close to training")
    colour = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return row.withColumn("status", status).select("status", F.element_at(colour, F.col("status")).alias("colour"), "n_large", "n_moderate", "n_unknown", text.alias("headline"))
