"""Row filters as boolean columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.common import col
from rollbook.functions.dates import month_bounds, month_ordinal
from rollbook.functions.days import WORKDAY_MASK, mask_has


def in_dates(start: dt.date, end: dt.date, date="date") -> Column:
    return col(date).between(F.lit(start), F.lit(end))


def in_month(year: int, month: int, date="date") -> Column:
    return in_dates(*month_bounds(year, month), date=date)


def not_deleted(flag="is_deleted") -> Column:
    return ~F.coalesce(col(flag), F.lit(False))


def active(*flags) -> Column:
    result = col(flags[0])
    for flag in flags[1:]:
        result = result & col(flag)
    return result


def status_in(statuses: Iterable[str], status="status") -> Column:
    return col(status).isin(*statuses)


def same(left, right) -> Column:
    """Equality in which NULL equals NULL."""
    return col(left).eqNullSafe(col(right))


def nonblank(value) -> Column:
    return col(value).isNotNull() & (col(value) != "")


def recent(as_of, minutes: int = 30, at="deleted_at") -> Column:
    """At or after ``as_of`` minus some minutes; ``as_of`` is always given, never the clock."""
    return col(at) >= as_of - F.make_dt_interval(mins=F.lit(minutes))


def hidden_as_of(
    year: int | None, month: int | None, from_year="hidden_from_year", from_month="hidden_from_month"
) -> Column:
    """Hidden in the viewed month; without a month every hidden row counts."""
    if not year or not month:
        return F.lit(True)
    always = col(from_year).isNull() & col(from_month).isNull()
    return always | (month_ordinal(from_year, from_month) <= year * 12 + month)


def scheduled_on(mask, weekday) -> Column:
    """The weekday is in the schedule; rows without one count Monday to Friday."""
    effective = F.when(col(mask) != 0, col(mask)).otherwise(F.lit(WORKDAY_MASK))
    return mask_has(effective, weekday)
