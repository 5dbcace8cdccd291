"""Merging of consecutive time slots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.dates import time12


def merge_slots(
    slots: DataFrame,
    keys: Sequence[str],
    carry: Mapping[str, Column] | None = None,
    legacy_text_order: bool = False,
) -> DataFrame:
    """Join slots with equal days whose end is the next one's start.

    ``slots`` has the keys, ``days``, ``start_min``, ``end_min`` and ``copies``, one row per
    distinct slot. The result has a row per merged slot. ``carry`` names further aggregates to
    keep, taken over all slots of equal keys and days.
    """
    group = [*keys, "days"]
    merged, _ = with_merged(slots, keys, legacy_text_order)
    whole = Window.partitionBy(*group)
    carried = {name: column.over(whole) for name, column in (carry or {}).items()}
    merged = merged.withColumns(carried) if carried else merged
    return merged.select(*group, *carried, F.explode("merged").alias("_slot")).select(
        *group, "_slot.start_min", "_slot.end_min", "_slot.copies", *carried
    )


def with_merged(
    slots: DataFrame, keys: Sequence[str], legacy_text_order: bool = False
) -> tuple[DataFrame, list[str]]:
    """Adds ``merged``: the merged slots that end with this one, as structs of ``start_min``, ``end_min`` and ``copies``;
    and the columns that, after keys and days, the rows are sorted by.

    A slot occurs ``copies`` times (once per teacher). In the sorted list copies of one slot
    stand next to each other and do not touch (unless it has no length: then they are one), so
    only the first can join what comes before and only the last what comes after; those in
    between stay alone and are kept as one with a count. So no copy becomes a row, a window
    group holds one row per distinct slot, and all windows share one sort of them.

    With ``legacy_text_order`` slots are sorted by their 12-hour text ("01:00 PM" before
    "09:00 AM").
    """
    by_time = ["start_min", "end_min"]
    if legacy_text_order:
        slots = slots.withColumns({"_start_text": time12("start_min"), "_end_text": time12("end_min")})
        by_time = ["_start_text", "_end_text"]
    start, end = F.col("start_min"), F.col("end_min")
    copies = F.when(start == end, F.lit(1)).otherwise(F.col("copies")).cast("long")
    ordered = Window.partitionBy(*keys, "days").orderBy(*by_time)
    no = F.lit(False)
    near = slots.withColumns({
        "_before": F.coalesce(F.lag("end_min").over(ordered) == start, no),
        "_after": F.coalesce(F.lead("start_min").over(ordered) == end, no),
    })
    # where the merged slot begins that the last copy of a slot belongs to
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.when(~F.col("_before") | (copies > 1), F.struct("start_min"))
    begun = near.withColumn("_begin", F.last(begins, ignorenulls=True).over(running))
    begun = begun.withColumn("_begin_before", F.lag("_begin").over(ordered))

    def slot(condition: Column, first, count) -> Column:
        return F.when(
            condition, F.struct(first.alias("start_min"), end.alias("end_min"), count.cast("long").alias("copies"))
        )

    joined = F.when(F.col("_before"), F.col("_begin_before.start_min")).otherwise(start)
    ending = F.array(
        slot(copies > 1, joined, F.lit(1)),
        slot(copies > 2, start, copies - 2),
        slot(~F.col("_after"), F.col("_begin.start_min"), F.lit(1)),
    )
    merged = begun.withColumn("merged", F.filter(ending, lambda s: s.isNotNull()))
    return merged.drop("_before", "_after", "_begin", "_begin_before"), ["days", *by_time]
