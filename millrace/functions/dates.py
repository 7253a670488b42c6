"""Date and time functions, and recurring-date calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def expand_date(text: Column) -> Column:
    """``dMMyy``, ``ddMMyy`` or ``ddMMyyyy`` digits -> date in this century; anything else NULL."""
    size = F.length(text)
    full = (
        F.when(size == 5, F.concat(F.lit("0"), F.substring(text, 1, 3), F.lit("20"), F.substring(text, 4, 2)))
        .when(size == 6, F.concat(F.substring(text, 1, 4), F.lit("20"), F.substring(text, 5, 2)))
        .when(size == 8, text)
    )
    digits = F.when(full.rlike(r"^\d{8}$"), full)
    return F.try_to_timestamp(digits, F.lit("ddMMyyyy")).cast("date")


def parse_time(text: Column) -> Column:
    """``HHmmss`` -> ``HH:mm:ss``; an impossible time gives NULL."""
    good = text.rlike(r"^([01]\d|2[0-3])[0-5]\d[0-5]\d$")
    return F.when(good, F.regexp_replace(text, r"^(\d\d)(\d\d)(\d\d)$", "$1:$2:$3"))


def day_rule(day: Column, rule: str) -> Column:
    """Does a date belong to a recurring rule?"""
    weekday = F.dayofweek(day)  # Sunday is 1
    rules = {
        "every_day": F.lit(True),
        "every_monday": weekday == 2,
        "monday_wednesday_friday": weekday.isin(2, 4, 6),
        "week_days": weekday.between(2, 6),
        "weekend": weekday.isin(1, 7),
        "first_of_month": F.dayofmonth(day) == 1,
        "last_of_month": day == F.last_day(day),
        "new_year": (F.dayofmonth(day) == 1) & (F.month(day) == 1),
    }
    if rule not in rules:
        raise ValueError(f"unknown rule {rule}; one of {sorted(rules)}")
    return rules[rule]


def days_between(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Every day from ``first`` to ``last`` of a one-row table."""
    days = F.sequence(F.col(first).cast("date"), F.col(last).cast("date"))
    return bounds.select(F.explode(days).alias("day"))


def calendar_days(
    spark: SparkSession, start: str, end: str, rule: str,
    holidays: DataFrame | None = None, extras: DataFrame | None = None,
) -> DataFrame:
    """Days of a rule from start to end, less the holidays, plus the extra days (both tables of ``day``)."""
    bounds = spark.range(1).select(F.lit(start).alias("a"), F.lit(end).alias("b"))
    return apply_calendar(days_between(bounds, "a", "b"), rule, holidays, extras)


def apply_calendar(
    days: DataFrame, rule: str, holidays: DataFrame | None = None, extras: DataFrame | None = None
) -> DataFrame:
    out = days.where(day_rule(F.col("day"), rule))
    if holidays is not None:
        out = out.join(holidays.select("day").distinct(), "day", "left_anti")
    if extras is not None:
        out = out.unionByName(extras.select("day")).distinct()
    return out
