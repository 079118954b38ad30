"""Survival curves and person-period tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kaplan_meier(df: DataFrame, by: list[str] | None = None, event: Column | None = None, count: Column | None = None) -> DataFrame:
    """(by..., duration_months, n_at_risk, n_events, survival). Rows are counted per month first; the windows run over months only. count: how many loans a row stands for."""
    by = by or []
    event, count = F.col("event") if event is None else event, F.lit(1) if count is None else count
    cells = df.groupBy(*by, "duration_months").agg(F.sum(count).alias("n"), F.sum(event.cast("int") * count).alias("d"))
    down = Window.partitionBy(*by).orderBy(F.desc("duration_months")) if by else Window.partitionBy(F.lit(1)).orderBy(F.desc("duration_months"))
    up = Window.partitionBy(*by).orderBy("duration_months") if by else Window.partitionBy(F.lit(1)).orderBy("duration_months")
    risk = cells.withColumn("r", F.sum("n").over(down))
    ended = F.max((F.col("d") == F.col("r")).cast("int")).over(up)  # all at risk had the event: the curve is 0 from here on
    log = F.sum(F.when(F.col("d") < F.col("r"), F.log1p(-F.col("d") / F.col("r"))).otherwise(0.0)).over(up)
    return risk.withColumns({"s": F.when(ended == 1, 0.0).otherwise(F.exp(log))}).select(*by, "duration_months", F.col("r").alias("n_at_risk"), F.col("d").alias("n_events"), F.round("s", 8).alias("survival"))


def at_times(curve: DataFrame, times: list[int], by: list[str] | None = None, floor: float | None = None) -> DataFrame:
    """The step function at each t of `times`: the value at the last month up to t, 1 before the first. curve: one row per month."""
    by = by or []
    up_to = F.col("duration_months") <= F.col("t")
    found = curve.withColumn("t", F.explode(F.array(*map(F.lit, times)))).groupBy(*by, "t").agg(F.max_by(F.when(up_to, F.col("survival")), F.when(up_to, F.col("duration_months"))).alias("s"))
    value = F.coalesce("s", F.lit(1.0))
    if floor is None:
        return found.select(*by, "t", value.alias("survival"))
    return found.select(*by, "t", F.greatest(value, F.lit(floor)).alias("survival"), (value <= floor).alias("floor_binds"))


def person_period(df: DataFrame, *, months: int = 1, horizon: int | None = None, keep: Column | None = None, share: float = 1.0, columns: list[str] | None = None) -> DataFrame:
    """A row per loan and period under observation: y is 1 in the last period of an event only.

    Beyond the horizon a loan counts as censored. With share < 1 only the negatives for which keep holds
    stay, each with the weight 1 / share.
    """
    d = F.col("duration_months").cast("double")
    cut = F.least(d, F.lit(float(horizon))) if horizon else d
    event = F.when(d > horizon, 0).otherwise(F.col("event")) if horizon else F.col("event")
    rows = df.withColumns({"_n": F.greatest(F.ceil(cut / months), F.lit(1)).cast("int"), "_e": event})
    rows = rows.select(*(columns or ["id"]), "_n", "_e", F.explode(F.sequence(F.lit(1), "_n")).alias("period"))
    rows = rows.withColumn("y", ((F.col("period") == F.col("_n")) & (F.col("_e") == 1)).cast("int"))
    if keep is not None and share < 1:
        rows = rows.where((F.col("y") == 1) | keep).withColumn("weight", F.when(F.col("y") == 1, 1.0).otherwise(1.0 / share))
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    return rows.drop("_n", "_e")


def expansion(df: DataFrame, months: int = 1) -> DataFrame:
    """How many rows person_period makes."""
    return df.agg(F.sum(F.greatest(F.ceil(F.col("duration_months") / months), F.lit(1))).alias("rows"), F.max(F.greatest(F.ceil(F.col("duration_months") / months), F.lit(1))).alias("periods"))


def survival_from_hazard(df: DataFrame, key: list[str]) -> DataFrame:
    """df: key..., period, hazard. Running product of 1 - hazard."""
    w = Window.partitionBy(*key).orderBy("period")
    return df.select(*key, "period", F.round(F.exp(F.sum(F.log1p(-F.least(F.greatest("hazard", F.lit(1e-9)), F.lit(1 - 1e-9)))).over(w)), 8).alias("survival"))


def conditional_default(curve: DataFrame, ages: DataFrame, horizon: int) -> DataFrame:
    """(age, probability): 1 - S(age + horizon) / S(age); each S is taken at the nearest month of the curve."""
    grid = ages.select("age", F.explode(F.array(F.lit(0), F.lit(horizon))).alias("h")).withColumn("x", F.col("age") + F.col("h"))
    near = grid.crossJoin(F.broadcast(curve.select("duration_months", "survival"))).groupBy("age", "h").agg(F.min_by("survival", F.struct(F.abs(F.col("duration_months") - F.col("x")), F.col("duration_months"))).alias("s"))
    return near.groupBy("age").agg(F.round(1 - F.max(F.when(F.col("h") == horizon, F.col("s"))) / F.nullif(F.max(F.when(F.col("h") == 0, F.col("s"))), F.lit(0.0)), 6).alias("probability"))
