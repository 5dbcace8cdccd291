"""Sorted output: one order over all rows, made by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.session import run_dir

_ROWS = 33  # bits of a row's number inside its task, as Spark deals them out


def sorted_rows(rows: DataFrame, order: Sequence[Column], tasks: int | None = None) -> DataFrame:
    """The rows dealt by ranges of ``order`` and sorted inside each, with ``_at``: the number of the range and of the row.

    Written out, the files lie in the order of their names. ``order`` should end in something unique, so that rows that
    are otherwise equal can be cut into several ranges.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.withColumn("_at", F.monotonically_increasing_id())


def positions(written: DataFrame) -> DataFrame:
    """Rows that ``sorted_rows`` made, once written and read back, with ``position`` (from 1) in place of ``_at``.

    A range holds as many rows as its last number says; only these sizes, one a task, reach the driver.
    """
    part = F.shiftright("_at", _ROWS)
    number = F.col("_at").bitwiseAND((1 << _ROWS) - 1)
    sizes = written.groupBy(part.alias("part")).agg(F.max(number).alias("last")).collect()
    ahead, before = [], 0
    for part_size in sorted(sizes, key=lambda r: r["part"]):
        ahead.append((part_size["part"], before))
        before += part_size["last"] + 1
    shifts = written.sparkSession.createDataFrame(ahead, "_part long, _ahead long")
    placed = written.withColumn("_part", part.cast("long")).join(F.broadcast(shifts), "_part")  # a row a task
    return placed.withColumn("position", F.col("_ahead") + number + 1).drop("_part", "_ahead", "_at")


def with_position(rows: DataFrame, order: Sequence[Column], tasks: int | None = None) -> DataFrame:
    """Adds ``position``, the place of each row in the order of all. The sorted rows are written once to the shared
    folder: ranges come from samples, and must not be drawn twice."""
    path = run_dir(rows.sparkSession, "sorted")
    made = sorted_rows(rows, order, tasks)
    made.write.parquet(path)
    return positions(rows.sparkSession.read.schema(made.schema).parquet(path))
