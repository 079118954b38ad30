"""Measures of predicted survival under censoring: AUC, Brier, concordance, calibration.

Rows are counted once into stored cells of duration, event and risk (or hazard), from which everything
else is derived: the input is read once. With real scores a cell is a row; what is compared then still
splits by ranges of the risk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ranks import dealt, row_ranks, sums_below
from tidemark.operators.survival import at_times, kaplan_meier
from tidemark.sources.store import stored

G_FLOOR = 1e-3


def cells_of(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., duration_months, event, value, n), stored."""
    return stored(df.groupBy(*by, "duration_months", "event", value).agg(F.count(F.lit(1)).alias("n")))


def censoring(df: DataFrame, by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """P(not censored by t): the curve with events and censorings swapped."""
    return kaplan_meier(df, by, 1 - F.col("event"), F.col(count) if count else None)


def _with_g(cells: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The cells with g, the floored censoring curve at the cell's own duration, which is a month of the curve; and the curve."""
    curve = censoring(cells, by, "n")
    return cells.join(curve.select(*by, "duration_months", F.greatest("survival", F.lit(G_FLOOR)).alias("g")), [*by, "duration_months"]), curve


def _each(times: list[int]):
    return F.explode(F.array(*map(F.lit, times)))


def cumulative_auc(df: DataFrame, times: list[int], by: list[str] | None = None, counted: bool = False) -> DataFrame:
    """df: duration_months, event, risk; counted: it is what `cells_of` made. (by..., t, auc, n_cases, n_controls, reliable, g_at_t): cases are weighted by 1 / G(duration)."""
    by = by or []
    cells, curve = _with_g(df if counted else cells_of(df, by, "risk"), by)
    case, control = (F.col("duration_months") <= F.col("t")) & (F.col("event") == 1), F.col("duration_months") > F.col("t")
    per = cells.withColumn("t", _each(times)).groupBy(*by, "t", "risk").agg(F.sum(F.when(case, F.col("n") / F.col("g")).otherwise(0.0)).alias("w"), F.sum(F.when(case, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(control, F.col("n")).otherwise(0)).alias("b"))
    total = sums_below(per, [*by, "t"], "risk", {"below": "b"}).groupBy(*by, "t").agg(F.sum(F.col("w") * (F.col("below") + F.col("b") / 2)).alias("num"), F.sum("w").alias("w"), F.sum("a").alias("n_cases"), F.sum("b").alias("n_controls"))
    g = at_times(curve, times, by, G_FLOOR)
    some = (F.col("n_cases") > 0) & (F.col("n_controls") > 0)
    return total.join(g, [*by, "t"]).select(*by, "t", F.round(F.when(some, F.col("num") / (F.col("w") * F.col("n_controls"))), 6).alias("auc"), "n_cases", "n_controls", (some & ~F.col("floor_binds")).alias("reliable"), F.round("survival", 6).alias("g_at_t"))


def brier(df: DataFrame, times: list[int], by: list[str] | None = None) -> DataFrame:
    """df: duration_months, event, hazard (constant per month). (by..., t, brier, n_contributing)."""
    by = by or []
    cells, curve = _with_g(cells_of(df, by, "hazard"), by)
    g = at_times(curve, times, by, G_FLOOR).select(*by, "t", F.col("survival").alias("gt"))
    rows = cells.withColumn("t", _each(times)).join(g, [*by, "t"])
    s = F.pow(1 - F.col("hazard"), F.col("t"))
    had, alive = (F.col("duration_months") <= F.col("t")) & (F.col("event") == 1), F.col("duration_months") > F.col("t")
    part = F.when(had, s * s / F.col("g")).when(alive, (1 - s) * (1 - s) / F.col("gt")).otherwise(0.0)
    return rows.groupBy(*by, "t").agg(F.round(F.sum(F.col("n") * part) / F.sum("n"), 6).alias("brier"), F.sum(F.when(had | alive, F.col("n")).otherwise(0)).alias("n_contributing"))


def integrated(curve: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., integrated): the trapezoid rule over t, divided by its span; null with fewer than two times."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("t") if by else Window.partitionBy(F.lit(1)).orderBy("t")
    rows = curve.where(F.col(value).isNotNull()).withColumns({"t0": F.lag("t").over(w), "v0": F.lag(value).over(w)})
    return rows.groupBy(*by).agg(F.round(F.sum((F.col("t") - F.col("t0")) * (F.col(value) + F.col("v0")) / 2) / F.nullif(F.max("t") - F.min("t"), F.lit(0)), 6).alias("integrated"))


def concordance(df: DataFrame, by: list[str] | None = None, counted: bool = False) -> DataFrame:
    """(by..., concordance, n_pairs). Harrell's C: of the pairs whose shorter time is an event, the share where that one has the higher risk; ties of risk count half.

    counted: df is what `cells_of` made. At equal times an event is comparable with a censored row only. Cells are dealt by ranges of the
    risk, as many as their number asks for. Pairs of two ranges are counted from one number per month and range; pairs inside a range by
    that range's task, month by month.
    """
    by = by or []
    cells = df if counted else cells_of(df, by, "risk")
    cells = dealt(cells, by, ["risk"], cells.count())
    n = F.col("n")
    counts = cells.groupBy(*by, "_b", "duration_months").agg(F.sum(n).alias("all"), F.sum(F.when(F.col("event") == 0, n).otherwise(0)).alias("gone"), F.sum(F.when(F.col("event") == 1, n).otherwise(0)).alias("had"))
    span = counts.groupBy(*by, F.lit(1).alias("_one")).agg(F.min("duration_months").alias("lo"), F.max("duration_months").alias("hi"))
    grid = counts.select(*by, "_b").distinct().withColumn("_one", F.lit(1)).join(span, [*by, "_one"]).select(*by, "_b", F.explode(F.sequence("lo", "hi")).alias("duration_months"))  # ranges by months
    zero = lambda c: F.coalesce(c, F.lit(0))
    full = grid.join(counts, [*by, "_b", "duration_months"], "left").select(*by, "_b", "duration_months", *[zero(c).alias(c) for c in ("all", "gone", "had")])
    after = Window.partitionBy(*by, "_b").orderBy(F.desc("duration_months")).rowsBetween(Window.unboundedPreceding, -1)
    month = Window.partitionBy(*by, "duration_months")
    later = full.withColumn("later", zero(F.sum("all").over(after)) + F.col("gone"))
    later = later.withColumns({"lower": zero(F.sum("later").over(month.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))), "every": F.sum("later").over(month)})
    between = later.groupBy(*by).agg(F.sum(F.col("had") * F.col("lower")).alias("between"), F.sum(F.col("had") * F.col("every")).alias("n_pairs"))

    fields = [*[cells.schema[c] for c in by], T.StructField("inside", T.DoubleType())]

    def count(key, t):
        risk, d, event, n = (t[c].to_numpy() for c in ("risk", "duration_months", "event", "n"))
        order = np.argsort(risk, kind="stable")
        risk, d, event, n = risk[order], d[order], event[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], risk[1:] != risk[:-1]]))
        level = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(risk))))
        total = 0.0
        for month in np.unique(d[event == 1]):
            open_ = np.add.reduceat(np.where((d > month) | ((d == month) & (event == 0)), n, 0), starts).astype(float)
            own = (d == month) & (event == 1)
            total += float((n[own] * (np.cumsum(open_) - open_ / 2)[level[own]]).sum())
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key[: len(by)]], pa.array([total])], names=[f.name for f in fields])

    inside = cells.groupBy(*by, "_b").applyInArrow(count, T.StructType(fields)).groupBy(*by).agg(F.sum("inside").alias("inside"))
    both = between.join(inside, by) if by else between.crossJoin(F.broadcast(inside))  # one row
    return both.select(*by, F.round((F.col("between") + F.col("inside")) / F.nullif("n_pairs", F.lit(0)), 6).alias("concordance"), "n_pairs")


def calibration(df: DataFrame, t: int, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """df: id, duration_months, event, s (predicted survival at t). Bins of equal rank (ties by id), within each group of `by`; observed is each bin's own survival curve at t. Groups that were not observed up to t, or of one row, are left out."""
    by = by or []
    ranked = row_ranks(df.select(*by, "id", "duration_months", "event", "s"), "s", ["id"], by)
    sizes = ranked.groupBy(*by).agg(F.max("r").alias("n"), F.max("duration_months").alias("_last"))
    sized = ranked.join(sizes.where((F.col("n") > 1) & (F.col("_last") >= t)), by) if by else ranked.crossJoin(F.broadcast(sizes))  # one row
    place = F.greatest(F.floor(((F.col("r") - 1) * bins + F.col("n") - 2) / (F.col("n") - 1)) - 1, F.lit(0)).cast("int")
    cells = stored(sized.groupBy(*by, place.alias("bin"), "duration_months", "event").agg(F.count(F.lit(1)).alias("c"), F.sum("s").alias("s")))
    observed = at_times(kaplan_meier(cells, [*by, "bin"], count=F.col("c")), [t], [*by, "bin"]).select(*by, "bin", F.col("survival").alias("observed_survival"))
    mean = cells.groupBy(*by, "bin").agg(F.sum("c").alias("n"), F.round(F.sum("s") / F.sum("c"), 6).alias("predicted_survival"))
    return mean.where("n >= 2").join(observed, [*by, "bin"]).select(*by, "bin", "n", "predicted_survival", F.round("observed_survival", 6).alias("observed_survival"), F.round(F.col("predicted_survival") - F.round("observed_survival", 6), 6).alias("error"))


#: Fixed value: below this share under observation an estimate has a high variance.
HIGH_VARIANCE_G = 0.05


def summary(df: DataFrame, times: list[int], by: list[str] | None = None) -> DataFrame:
    """One row, or one for each of `by`: n, event_rate, concordance, integrated Brier score, AUC by time, and the horizons that are unreliable or of high variance.

    df: duration_months, event, risk and hazard. Horizons later than a group's last month are left out
    of its lists and its integral.
    """
    by = by or []
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("event"), 6).alias("event_rate"), F.max("duration_months").alias("_last"))
    c = concordance(df, by).drop("n_pairs")
    auc, score = cumulative_auc(df, times, by), brier(df, times, by)
    join = lambda x, y: x.join(y, by) if by else x.crossJoin(F.broadcast(y))  # noqa: E731  one row each
    within = lambda x: join(x, size.select(*by, "_last")).where(F.col("t") <= F.col("_last")).drop("_last")
    listed = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("t")))).cast("array<string>"), ",")
    a = within(auc).groupBy(*by).agg(*[F.max(F.when(F.col("t") == t, F.col("auc"))).alias(f"auc_{t}m") for t in times], listed(~F.col("reliable")).alias("unreliable_horizons"), listed(F.col("g_at_t") < HIGH_VARIANCE_G).alias("high_variance_horizons"), F.array_join(F.array_sort(F.collect_list("t")).cast("array<string>"), ",").alias("horizons"))
    ibs = integrated(within(score), "brier", by).withColumnRenamed("integrated", "ibs")
    return join(join(join(size, c), ibs), a).drop("_last")
