"""Running counts and exact quantiles over ordered values, so that no group's values meet in one task.

Rows are dealt by ranges of (group, value), whose edges Spark samples, and stored with the number of
their range: outliers and skewed values don't matter. Sums over ranges are as many rows as there are
partitions; the order inside a range is that range's own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.store import stored

#: Rows of a range that a task holds in memory.
RANGE = 250_000


def dealt(df: DataFrame, by: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """The rows with _b, the number of their range: equal rows of `by` and `order` share one, larger ones never have a smaller one.

    rows: how many there are; there is a range for each `RANGE` of them then, for tasks that hold a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(max(parts, -(-(rows or 0) // RANGE)), *by, *order).withColumn("_b", F.spark_partition_id()))


def sums_below(cells: DataFrame, by: list[str], value: str, sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """cells: one row per group and value. Adds, for each name: column of `sums`, the column's sum over smaller values of the group, and for each of `totals` its sum over the whole group."""
    rows, totals = dealt(cells, by, [value]), totals or {}
    parts = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in (sums | totals).items()])
    group = Window.partitionBy(*(by or [F.lit(1)]))  # over sums: a row per partition that the group reaches
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_t_{name}") for name in sums], *[F.sum(f"_t_{name}").over(group).alias(f"_t_{name}") for name in totals])
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(parts, [*by, "_b"])  # a row per group and partition: small, but no bound is proven
    found = {name: F.col(f"_t_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()} | {name: F.col(f"_t_{name}") for name in totals}
    return joined.withColumns(found).drop("_b", *[f"_t_{name}" for name in sums | totals])


def row_ranks(df: DataFrame, value: str, ties: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds r: the row's rank from 1, in its group if `by` is given, by the value and then by `ties`."""
    by = by or []
    rows = dealt(df, by, [value, *ties])
    parts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*by, "_b", before.alias("_before"))
    joined = rows.join(parts, [*by, "_b"]) if by else rows.join(F.broadcast(parts), "_b")  # without groups: a row per partition
    return joined.withColumn("r", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy(value, *ties))).drop("_b", "_before")


def _nearby(probabilities: list[float], first: Column, last: Column, n: Column) -> Column:
    """The probabilities (i, p) whose ranks among n values may lie next to the ranks first to last: looked up on a grid, so that a value meets a few of them and not all."""
    order = sorted(enumerate(probabilities), key=lambda x: x[1])
    grid = max(64, 4 * len(order))
    counts = [*(sum(p < k / grid for _, p in order) for k in range(grid + 1)), len(order)]
    below, pairs = F.expr(f"array({', '.join(map(str, counts))})"), F.expr(f"array({', '.join(f'struct({i} AS i, {float(p)!r}D AS p)' for i, p in order)})")
    cell = lambda rank, more: F.least(F.greatest(F.floor(rank / F.greatest(n - 1, F.lit(1)) * grid).cast("int") + more, F.lit(0)), F.lit(grid + 1))
    a, z = F.get(below, cell(first - 1, -1)), F.get(below, cell(last + 1, 2))  # a cell more on either side, as quotients are rounded
    return F.slice(pairs, a + 1, z - a)


def quantiles(long: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(by..., q): exact quantiles, linear between ranks, of each group's values that are not null; groups without a value are left out.

    Values are counted first; then only the values next to each wanted rank are kept.
    """
    cells = long.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = sums_below(cells, by, "_v", {"_below": "_c"}, {"_n": "_c"})
    last = F.col("_below") + F.col("_c") - 1
    each = placed.select(*by, "_v", "_n", "_below", last.alias("_last"), F.explode(_nearby(probabilities, F.col("_below"), last, F.col("_n"))).alias("p"))
    near = each.select(*by, "_v", "_below", "_last", F.struct("p.i", ((F.col("_n") - 1) * F.col("p.p")).alias("h")).alias("w")).where((F.floor("w.h") <= F.col("_last")) & (F.ceil("w.h") >= F.col("_below")))
    low = F.max(F.when(F.floor("w.h").between(F.col("_below"), F.col("_last")), F.col("_v")))
    high = F.max(F.when(F.ceil("w.h").between(F.col("_below"), F.col("_last")), F.col("_v")))
    share = F.max(F.col("w.h") - F.floor("w.h"))
    each = near.groupBy(*by, "w.i").agg(low.alias("lo"), high.alias("hi"), share.alias("s"))
    found = F.array_sort(F.collect_list(F.struct("i", ((1 - F.col("s")) * F.col("lo") + F.col("s") * F.col("hi")).alias("q"))))
    return each.groupBy(*by).agg(F.transform(found, lambda x: x["q"]).alias("q"))
