"""Table scans, slices and column contracts on read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.dates import month_bounds
from rollbook.functions.names import blank_to_null
from rollbook.functions.predicates import in_dates
from rollbook.schema import DEFAULTS


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options
) -> DataFrame:
    """Scan of a live database, split into ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper,
        numPartitions=parts, fetchsize=10000,
    )
    return reader.options(**options).load()


def date_range(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of an inclusive date range; ``year``/``month`` partitions are pruned if present."""
    sliced = df.filter(in_dates(start, end))
    if {"year", "month"} <= set(df.columns):
        ordinal = F.col("year") * 12 + F.col("month")
        sliced = sliced.filter(
            F.col("year").between(start.year, end.year)
            & ordinal.between(start.year * 12 + start.month, end.year * 12 + end.month)
        )
    return sliced


def month_slice(df: DataFrame, year: int, month: int) -> DataFrame:
    return date_range(df, *month_bounds(year, month))


def clean_entries(entries: DataFrame) -> DataFrame:
    """Batch of (student_id, subject) entries; a blank subject is none."""
    return entries.select("student_id", blank_to_null("subject").alias("subject")).distinct()


def with_defaults(df: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Fill missing values, and add missing columns, with the column defaults."""
    wanted = DEFAULTS if defaults is None else defaults
    for name, default in wanted.items():
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
        elif defaults is not None:
            df = df.withColumn(name, F.lit(default))
    return df


def rename_and_add(df: DataFrame, renames: dict[str, str], added: dict[str, object]) -> DataFrame:
    """Bring an old column layout up to date; running it again changes nothing."""
    for old, new in renames.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    for name, default in added.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    return df


def read_evolved(spark: SparkSession, path: str, renames: dict[str, str], added: dict[str, object]) -> DataFrame:
    """A folder of files of both ages in the new layout: per row a renamed column is taken from where it stands, and an
    added one gets its default in rows of the old layout only. A row is old if it holds a value under an old name."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    old = F.lit(False)
    for before, after in renames.items():
        if before in rows.columns:
            now = F.col(after).isNotNull() if after in rows.columns else F.lit(False)
            old = old | (F.col(before).isNotNull() & ~now)
    rows = rows.withColumn("_old", old)
    for before, after in renames.items():
        if before in rows.columns:
            kind = rows.schema[after].dataType if after in rows.columns else rows.schema[before].dataType
            both = [F.col(c).cast(kind) for c in (after, before) if c in rows.columns]
            rows = rows.withColumn(after, F.coalesce(*both)).drop(before)
    for name, default in added.items():
        held = F.col(name) if name in rows.columns else F.lit(None)
        rows = rows.withColumn(name, F.when(F.col("_old"), F.coalesce(held, F.lit(default))).otherwise(held))
    return rows.drop("_old")


def backfill_hidden(hidden: DataFrame) -> DataFrame:
    """Rows without a start year take year and month from the time they were hidden."""
    missing = F.col("hidden_from_year").isNull()
    return hidden.withColumns(
        {
            "hidden_from_year": F.when(missing, F.year("hidden_at")).otherwise(F.col("hidden_from_year")),
            "hidden_from_month": F.when(missing, F.month("hidden_at")).otherwise(
                F.col("hidden_from_month")
            ),
        }
    )
