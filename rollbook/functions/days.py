"""Weekday sets.

A set of weekdays is carried as a 7-bit mask (bit 0 = Sunday): masks union with
``bit_or`` inside a hash aggregate and compare as integers. Arrays and text such as
``MWF`` are made from it at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.common import col
from rollbook.schema import DAY_CODES

WORKDAY_MASK = 0b0111110


def mask_of(weekday) -> Column:
    """Mask with the one bit of a weekday number; NULL stays NULL."""
    return F.call_function("shiftleft", F.lit(1), col(weekday).cast("int"))


def mask_union(weekday) -> Column:
    """Aggregate: the set of all weekday numbers of a group."""
    return F.coalesce(F.bit_or(mask_of(weekday)), F.lit(0))


def mask_has(mask, weekday) -> Column:
    return col(mask).bitwiseAND(mask_of(weekday)) != 0


def mask_days(mask) -> Column:
    """Mask to an ordered array of weekday numbers."""
    return F.filter(
        F.array(*[F.lit(d) for d in range(7)]), lambda d: col(mask).bitwiseAND(mask_of(d)) != 0
    )


def mask_text(mask: str) -> Column:
    """Mask to text such as ``MWF``, looked up among the 128 sets."""
    texts = ["".join(code for i, code in enumerate(DAY_CODES) if bits >> i & 1) for bits in range(128)]
    return F.get(F.lit(texts), F.col(mask))


def days_text(days) -> Column:
    """Array of weekday numbers to text, in the array's order."""
    codes = F.array(*[F.lit(code) for code in DAY_CODES])
    return F.array_join(F.transform(col(days), lambda d: F.get(codes, d)), "")


def days_parse(text) -> Column:
    """Text such as ``MTWThF`` to weekday numbers; unknown letters are skipped."""
    codes = F.array(*[F.lit(code) for code in DAY_CODES])
    found = F.regexp_extract_all(col(text), F.lit("(Su|Th|Sa|M|T|W|F)"), F.lit(1))
    parsed = F.transform(found, lambda code: (F.array_position(codes, code) - 1).cast("int"))
    return F.coalesce(parsed, F.array().cast("array<int>"))


def days_union(schedules, single) -> Column:
    """Distinct days over all schedules of a row; the single text when there is none."""
    each = F.transform(col(schedules), lambda s: days_parse(s["days"]))
    return F.when(F.size(col(schedules)) > 0, F.array_distinct(F.flatten(each))).otherwise(
        days_parse(single)
    )
