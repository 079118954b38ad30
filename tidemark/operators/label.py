"""Survival targets from loan histories: months observed, event or not, and why a row was left out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.sources.store import stored


class LabelRule(NamedTuple):
    late_is_event: bool = False
    with_exceptions: bool = False
    least_months: int = 1
    overrun_grace: int = 12
    event_lag: int = 0


def labelled(df: DataFrame, rule: LabelRule = LabelRule(), cutoff: str | None = None) -> DataFrame:
    """Every input row with its target and `reason` (null: kept). The cutoff is the latest payment or issue month, unless given.

    The parsed rows are stored: the cutoff needs all of them first, the source is read once, and filters
    on the target are not spelled out down to the texts.
    """
    df = stored(df.withColumns({"outcome": parse.outcome(F.col("loan_status"), rule.late_is_event, rule.with_exceptions), "issue_month": parse.month(F.col("issue_d")), "last_pymnt_month": parse.month(F.col("last_pymnt_d")), "term_months": parse.first_digits(F.col("term"))}))
    if cutoff:
        df = df.withColumn("cutoff", F.lit(cutoff).cast("date"))
    else:
        df = df.crossJoin(F.broadcast(df.agg(F.greatest(F.max("last_pymnt_month"), F.max("issue_month")).alias("cutoff"))))  # one row
    event = F.col("outcome") == "event"
    end = F.when(F.col("outcome") == "censored_admin", F.col("cutoff")).otherwise(F.col("last_pymnt_month"))
    never_paid = event & end.isNull()
    end = F.when(never_paid, F.add_months("issue_month", rule.least_months)).otherwise(end)
    if rule.event_lag:
        end = F.when(event, F.add_months(end, rule.event_lag)).otherwise(end)
    df = df.withColumns({"observation_end_month": end, "never_paid": never_paid, "event": event.cast("int")})
    df = df.withColumn("duration_raw_months", parse.months_between(F.col("issue_month"), F.col("observation_end_month")))
    df = df.withColumns({"duration_months": F.greatest(F.col("duration_raw_months"), F.lit(rule.least_months) + F.col("duration_raw_months") * 0), "duration_floored": F.coalesce(F.col("duration_raw_months") < rule.least_months, F.lit(False))})
    return df.withColumn("reason", _reason(rule))


def _reason(rule: LabelRule) -> Column:
    """The first exclusion that holds, in this order."""
    return (
        F.when(F.col("outcome") == "excluded", "excluded_status")
        .when(F.col("issue_month").isNull(), "missing_issue_d")
        .when(F.col("term_months").isNull(), "missing_term")
        .when(F.col("observation_end_month").isNull(), "missing_end_date")
        .when(F.col("duration_months") > F.col("term_months") + rule.overrun_grace, "term_overrun")
    )


def survival_target(df: DataFrame, rule: LabelRule = LabelRule(), cutoff: str | None = None) -> DataFrame:
    """The kept rows."""
    return labelled(df, rule, cutoff).where("reason IS NULL").drop("reason", "cutoff").withColumn("issue_year", F.year("issue_month"))


def audit(rows: DataFrame) -> DataFrame:
    """(kind, value, rows): drop reasons, outcomes and statuses in one pass over the labelled rows."""
    long = rows.select(F.explode(F.array(
        F.struct(F.lit("drop").alias("kind"), F.coalesce("reason", F.lit("(kept)")).alias("value")),
        F.struct(F.lit("outcome").alias("kind"), F.col("outcome").alias("value")),
        F.struct(F.lit("status").alias("kind"), F.coalesce("loan_status", F.lit("(missing)")).alias("value")),
    )).alias("x"))
    return long.groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("rows"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: the row budget, event rate and durations of the labelled rows."""
    kept = F.col("reason").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n_input"), F.count_if(kept).alias("n_retained"), F.count_if(~kept).alias("n_dropped"),
        F.count_if("never_paid").alias("n_never_paid"), F.count_if("duration_floored").alias("n_floored"),
        F.round(F.avg(F.when(kept, F.col("event"))), 6).alias("event_rate"),
        F.expr("percentile(CASE WHEN reason IS NULL THEN duration_months END, 0.5)").alias("duration_median"),
        F.max(F.when(kept, F.col("duration_months"))).alias("duration_max"),
    )
