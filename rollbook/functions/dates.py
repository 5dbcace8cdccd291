"""Calendar and clock expressions."""

from __future__ import annotations

import datetime as dt
from calendar import monthrange

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.common import col
from rollbook.functions.names import zero_to_null
from rollbook.schema import WEEKDAYS


def month_bounds(year: int, month: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, month, 1), dt.date(year, month, monthrange(year, month)[1])


def time12(minutes) -> Column:
    """Minutes of the day as ``HH:MI AM``."""
    m = col(minutes)
    hour = F.floor(m / 60)
    return F.concat(
        F.lpad(((hour + 11) % 12 + 1).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((m % 60).cast("string"), 2, "0"),
        F.when(hour % 24 < 12, F.lit(" AM")).otherwise(F.lit(" PM")),
    )


def time_range(start, end) -> Column:
    """``start - end``; NULL if either is missing."""
    return F.concat(col(start), F.lit(" - "), col(end))


def date_iso(date="date") -> Column:
    return F.date_format(col(date), "yyyy-MM-dd")


def weekday_name(date="date") -> Column:
    return F.date_format(col(date), "EEEE")


def weekday_of(date="date") -> Column:
    """0 for Sunday up to 6 for Saturday."""
    return F.dayofweek(col(date)) - 1


def weekday_num(name) -> Column:
    """Weekday name to 0..6; anything else is NULL."""
    result = F.lit(None).cast("int")
    for number, label in enumerate(WEEKDAYS):
        result = F.when(col(name) == label, F.lit(number)).otherwise(result)
    return result


def month_ordinal(year="year", month="month") -> Column:
    return col(year) * 12 + col(month)


def year_of(date="date") -> Column:
    return F.year(col(date))


def range_start(first, second) -> Column:
    return F.least(col(first), col(second))


def range_end(first, second) -> Column:
    return F.greatest(col(first), col(second))


def hidden_from_text(year="hidden_from_year", month="hidden_from_month") -> Column:
    """``January 2024``, or ``(All months)`` without a start."""
    text = F.date_format(F.make_date(zero_to_null(year), zero_to_null(month), F.lit(1)), "MMMM yyyy")
    return F.coalesce(text, F.lit("(All months)"))


def in_month_days(year: int, month: int) -> list[int]:
    """Per weekday (0 = Sunday) the bit set of its days in the month (bit 0 = day 1)."""
    first, last = month_bounds(year, month)
    sets = [0] * 7
    for day in range(1, last.day + 1):
        weekday = (first.replace(day=day).weekday() + 1) % 7
        sets[weekday] |= 1 << (day - 1)
    return sets
