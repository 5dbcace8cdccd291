"""How many tasks a step over large tables is dealt to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tasks_for(spark: SparkSession, rows: int, width: int = 500_000) -> int | None:
    """Tasks of about ``width`` rows each; none while the session's shuffle partitions hold no more than that."""
    tasks = -(-rows // width)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` to ``tasks`` tasks, which a join or aggregate on these keys then keeps; unchanged
    without a number. So what a task sorts does not grow with the table."""
    return rows.repartition(tasks, *keys) if tasks else rows


def join_dealt(rows: DataFrame, other: DataFrame, tasks: int | None, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` with ``other`` dealt to ``tasks`` tasks. Both are sorted then: a table whose files are far smaller
    than its rows would be broadcast, and each task would hold all of it."""
    return rows.join(spread(other, tasks, key).hint("merge") if tasks else other, key, how)


def join_few(rows: DataFrame, few: DataFrame, tasks: int | None, key: str, unique: str) -> DataFrame:
    """Inner join with a table whose ``key`` takes few values, so that dealing by it would bring all rows to as few tasks.

    With ``tasks`` rows of one value are told apart by a number below that, taken from ``unique``, and ``few`` holds
    each of its rows once for every number.
    """
    if not tasks:
        return rows.join(few, key)
    numbered = rows.withColumn("_lot", F.pmod(F.xxhash64(unique), F.lit(tasks)).cast("int"))
    copied = few.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return spread(numbered, tasks, key, "_lot").join(spread(copied, tasks, key, "_lot"), [key, "_lot"]).drop("_lot")
