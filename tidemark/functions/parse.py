"""Column builders that read messy text: numbers, terms, months, statuses. No Python runs per row."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean a missing value.
MISSING = ("", "n/a", "N/A", "NA", "null", "NULL", "none", "None")
#: Month formats, tried in this order.
MONTH_FORMATS = ("MMM-yyyy", "yyyy-MM-dd", "MMM-yy", "yyyy-MM", "dd-MMM-yyyy", "MM/dd/yyyy")
#: The texts that each format may read: Spark's parser is laxer than the formats say.
_MONTH_SHAPES = (r"^[A-Za-z]{3}-\d{4}$", r"^\d{4}-\d{2}-\d{2}$", r"^[A-Za-z]{3}-\d{2}$", r"^\d{4}-\d{2}$", r"^\d{2}-[A-Za-z]{3}-\d{4}$", r"^\d{2}/\d{2}/\d{4}$")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Employment lengths in order, and their years.
EMPLOYMENT = ("< 1 year", "1 year", "2 years", "3 years", "4 years", "5 years", "6 years", "7 years", "8 years", "9 years", "10+ years")
EMPLOYMENT_YEARS = (0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0)
#: Income bands, left-closed, and their lower edges.
INCOME_EDGES = (0, 30_000, 50_000, 75_000, 100_000, 150_000)
INCOME_BANDS = ("<30k", "30-50k", "50-75k", "75-100k", "100-150k", "150k+")
POLICY_PREFIX = "does not meet the credit policy. status:"


def present(c: Column) -> Column:
    """The trimmed text, or null for a missing token."""
    t = F.trim(c)
    return F.when(~t.isin(*MISSING), t)


def plain_number(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def number(c: Column) -> Column:
    """Numbers with `, % $` stripped; anything else is null."""
    return plain_number(F.regexp_replace(F.trim(c), "[,%$]", ""))


def rescued(c: Column) -> Column:
    """Whether only stripping made the text a number."""
    return plain_number(c).isNull() & number(c).isNotNull()


def term_months(c: Column) -> Column:
    """`36 months`, `36 mo`, `36.0`, `36m`: the whole text must be a term."""
    digits = F.regexp_extract(F.lower(F.trim(c)), r"^(\d{1,3})(?:\.0+)?\s*(?:-?\s*(?:months?|mos?\.?|mths?|m))?$", 1)
    return F.when(digits != "", digits.cast("int"))


def first_digits(c: Column) -> Column:
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(digits != "", digits.cast("int"))


def month(c: Column) -> Column:
    """The first day of the month that the text names in one of the formats; two-digit years are 1969 to 2068."""
    t = F.trim(c)
    read = [(t.rlike(shape), F.try_to_timestamp(t, F.lit(form)).cast("date")) for shape, form in zip(_MONTH_SHAPES, MONTH_FORMATS)]  # a format that is a literal is compiled once
    first = F.trunc(reduce(lambda x, y: x.when(*y), read[1:], F.when(*read[0])), "MM")
    return F.add_months(first, F.when(t.rlike(_MONTH_SHAPES[2]) & (F.substring(t, -2, 2) >= "69"), -1200).otherwise(0))


def months_between(start: Column, end: Column) -> Column:
    """Whole calendar months, whatever the days."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def status(c: Column) -> Column:
    """Lower case, plain spaces and dashes, single spaces."""
    t = F.translate(c, " –—", " --")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def outcome(c: Column, late_is_event: bool = False, with_exceptions: bool = False) -> Column:
    """event, censored_payoff, censored_admin, censored_delinquent or excluded; raises on an unknown status."""
    # fixed values: what each status means
    plain = dict.fromkeys(("charged off", "default"), "event") | {"fully paid": "censored_payoff"} | dict.fromkeys(("current", "issued"), "censored_admin")
    plain |= {"in grace period": "censored_delinquent", "late (16-30 days)": "censored_delinquent", "late (31-120 days)": "event" if late_is_event else "censored_delinquent"}
    every = plain | {POLICY_PREFIX + k: v if with_exceptions else "excluded" for k, v in plain.items()}
    table = F.create_map(*[F.lit(x) for pair in every.items() for x in pair])
    t = F.regexp_replace(status(c), f"^({re.escape(POLICY_PREFIX)}) +", "$1")
    known = F.coalesce(F.try_element_at(table, t), F.raise_error(F.concat(F.lit("unknown loan status: "), c)).cast("string"))
    return F.when(c.isNull() | (F.trim(c) == ""), "excluded").otherwise(known)


def employment_years(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in zip(EMPLOYMENT, EMPLOYMENT_YEARS) for x in pair])
    return F.try_element_at(table, F.trim(c))


def income_band(c: Column) -> Column:
    band = F.when(c.isNull() | (c < 0), None)
    for edge, name in zip(INCOME_EDGES[1:], INCOME_BANDS):
        band = band.when(c < edge, name)
    return band.otherwise(INCOME_BANDS[-1])


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def instalment(amount: Column, annual_rate: Column, months: Column) -> Column:
    """The level monthly payment; without interest the amount is split evenly."""
    i = annual_rate / 1200
    return F.when(i == 0, amount / months).otherwise(amount * i / (1 - F.pow(1 + i, -months)))
