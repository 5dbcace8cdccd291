"""Lists and membership questions over the small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.predicates import in_month, nonblank
from rollbook.operators.aggregates import nested_groups
from rollbook.operators.joins import null_safe_join


def holidays_of_month(holidays: DataFrame, year: int, month: int) -> DataFrame:
    return holidays.filter(in_month(year, month))


def are_holidays(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """Every asked date with ``is_holiday``."""
    marks = holidays.select("date").distinct().withColumn("_hit", F.lit(True))
    return dates.select("date").distinct().join(marks, "date", "left").select(
        "date", F.col("_hit").isNotNull().alias("is_holiday")
    )


def holidays_by_year(holidays: DataFrame) -> DataFrame:
    """Holidays nested per year; a year holds at most 366 dates."""
    dated = holidays.withColumn("year", F.year("date"))
    return nested_groups(dated, ["year"], [], "holidays", ["date", "name"])


def active_teachers(teachers: DataFrame) -> DataFrame:
    """One row per teacher name with the lowest id."""
    return teachers.filter("is_active").groupBy("name").agg(F.min("id").alias("id"))


def subjects(assignments: DataFrame) -> DataFrame:
    return assignments.filter(nonblank("subject")).select("subject").distinct()


def hidden_rows(hidden: DataFrame, students: DataFrame) -> DataFrame:
    people = students.select(
        F.col("id").alias("student_id"), F.col("name").alias("student_name"), "korean_name", "english_name"
    )
    return hidden.join(people, "student_id", "left")


def are_hidden(probes: DataFrame, hidden: DataFrame) -> DataFrame:
    """Every asked (student_id, subject) with ``is_hidden``, NULL subjects matching."""
    keys = ["student_id", "subject"]
    marks = hidden.select(*keys).distinct().withColumn("_hit", F.lit(True))
    asked = probes.select(*keys).distinct()
    return null_safe_join(asked, marks, keys, "left").select(
        *keys, F.col("_hit").isNotNull().alias("is_hidden")
    )
