"""Positions inside large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.operators.joins import null_safe_join


def row_index(
    rows: DataFrame, keys: Sequence[str], value: str, unique: str, width: int = 100_000, ties: Sequence[str] = ()
) -> DataFrame:
    """Adds ``position``: the place of each row in its group by ``value`` (NULL first), then ``unique``, then ``ties``.

    Rows that share ``unique`` are told apart by ``ties`` (NULL first). A value of a group is cut into ranges of
    ``width`` unique numbers. Rows are numbered inside a range and shifted by the sizes of the ranges before it, which
    are summed per value, and of the values before, so a group of any size is numbered by many tasks. One window per
    group holds a row per distinct value: meant for percentages and counts, not for amounts.
    """
    cut = rows.withColumn("_range", F.floor(F.col(unique) / width))
    part = [*keys, value, "_range"]
    sizes = cut.groupBy(*part).agg(F.count(F.lit(1)).alias("_size"))
    values = sizes.groupBy(*keys, value).agg(F.sum("_size").alias("_size"))
    lower = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.select(*keys, value, F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_below"))
    before = Window.partitionBy(*keys, value).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*part, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_ahead"))
    shifts = null_safe_join(shifts, values, [*keys, value], "inner").withColumn("_shift", F.col("_below") + F.col("_ahead"))
    shifts = shifts.select(*part, "_shift")
    numbered = cut.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(unique, *[F.col(c).asc_nulls_first() for c in ties])))
    placed = null_safe_join(numbered, shifts, part, "inner")
    return placed.withColumn("position", F.col("_shift") + F.col("_n")).select(*rows.columns, "position")
