"""Dense calendars and month bit sets.

A month of one student-subject row fits a 31-bit set (bit 0 = day 1). Schedules, holidays
and each status become such sets, so that percentages and grids are bit operations on a
row and need no row per day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.common import col
from rollbook.functions.dates import in_month_days, month_bounds, weekday_name, weekday_of
from rollbook.functions.predicates import in_month


def with_day_columns(days: DataFrame) -> DataFrame:
    """Day number, weekday and weekend flag of each ``date``."""
    return days.select(
        "date",
        F.dayofmonth("date").alias("day"),
        weekday_of("date").alias("weekday"),
        weekday_name("date").alias("weekday_name"),
        weekday_of("date").isin(0, 6).alias("is_weekend"),
    )


def calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day of an inclusive range."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    return with_day_columns(days)


def month_calendar(spark: SparkSession, year: int, month: int) -> DataFrame:
    return calendar(spark, *month_bounds(year, month))


def day_flags(
    days: DataFrame, holidays: DataFrame, today: dt.date, start: dt.date | None, end: dt.date | None
) -> DataFrame:
    """Calendar with ``is_today``, ``is_holiday`` and ``in_range``; one end alone is a single day."""
    if start is None:
        in_range = F.lit(False)
    else:
        in_range = F.col("date").between(F.lit(start), F.lit(end or start))
    marks = holidays.select("date").distinct().withColumn("_holiday", F.lit(True))
    return days.join(marks, "date", "left").select(
        *days.columns,
        (F.col("date") == F.lit(today)).alias("is_today"),
        F.col("_holiday").isNotNull().alias("is_holiday"),
        in_range.alias("in_range"),
    )


def day_bit(date="date") -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth(col(date)) - 1)


def day_set(condition: Column, date="date") -> Column:
    """Aggregate: the days of the month on which a condition holds."""
    return F.coalesce(F.bit_or(F.when(condition, day_bit(date))), F.lit(0).cast("long"))


def holiday_set(holidays: DataFrame, year: int, month: int) -> Column:
    """The holidays of a month as one scalar subquery."""
    return holidays.filter(in_month(year, month)).agg(day_set(F.lit(True))).scalar()


def schedule_set(mask: str, year: int, month: int) -> Column:
    """Days of the month that fall on the weekdays of a mask (a column or SQL text)."""
    parts = [
        f"IF(({mask}) & {1 << weekday} != 0, {bits}L, 0L)"
        for weekday, bits in enumerate(in_month_days(year, month))
    ]
    return F.expr(" | ".join(parts))


def without(days: Column, removed: Column) -> Column:
    return days.bitwiseAND(F.bitwise_not(removed))


def size_of(days: Column) -> Column:
    return F.bit_count(days).cast("long")


def calendar_of(rows: DataFrame, date: str = "date") -> DataFrame:
    """Dense calendar over the whole months a table covers."""
    span = rows.agg(F.min(date).alias("first"), F.max(date).alias("last"))
    days = span.select(
        F.explode(F.sequence(F.trunc("first", "month"), F.last_day("last"))).alias("date")
    )
    return with_day_columns(days)


def weekly_dates(rows: DataFrame, weekday: str, start: dt.date, end: dt.date) -> DataFrame:
    """Each row once per date of the range on its weekday, as ``date``.

    The dates are counted up in steps of seven from the first one, so no calendar is joined.
    """
    from_start = F.pmod(F.col(weekday) - F.lit((start.weekday() + 1) % 7), F.lit(7)).cast("int")
    first = rows.withColumn("_first", F.date_add(F.lit(start), from_start)).filter(F.col("_first") <= F.lit(end))
    every = F.sequence(F.col("_first"), F.lit(end), F.expr("INTERVAL 7 DAYS"))
    return first.withColumn("date", F.explode(every)).drop("_first")
