"""Weekly assignments expanded over dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.dates import time12, weekday_num
from rollbook.functions.predicates import not_deleted
from rollbook.operators.aggregates import tally_with_unmarked
from rollbook.operators.spread import join_dealt, join_few, spread
from rollbook.sources.calendar import weekly_dates
from rollbook.sources.readers import date_range


def teacher_schedule(
    start: dt.date,
    end: dt.date,
    students: DataFrame,
    teachers: DataFrame,
    time_slots: DataFrame,
    assignments: DataFrame,
    assignment_students: DataFrame,
    assignment_teachers: DataFrame,
    attendance: DataFrame,
    teacher: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Students by slot for each date of a range with their status.

    One teacher's name, or every teacher. A subject of NULL never finds a record. ``tasks``
    deals the joins to that many tasks.
    """
    named = teachers if teacher is None else teachers.filter(F.col("name") == teacher)
    live = assignments.filter("is_active").select(
        F.col("id").alias("assignment_id"), weekday_num("date").alias("weekday"), "subject", "time_slot_id"
    )
    known = named.select(F.col("id").alias("teacher_id"), F.col("name").alias("teacher_name"))
    people = students.select(F.col("id").alias("student_id"), "name", "korean_name")
    slots = time_slots.select(F.col("id").alias("time_slot_id"), "start_min", "end_min")
    taught = join_few(live, slots, tasks, "time_slot_id", "assignment_id").join(assignment_teachers, "assignment_id")
    taught = taught.join(spread(known, tasks, "teacher_id"), "teacher_id")
    weekly = join_dealt(taught, assignment_students, tasks, "assignment_id")
    weekly = weekly.join(spread(people, tasks, "student_id"), "student_id")
    marks = date_range(attendance, start, end).filter(not_deleted()).select(
        "student_id", "date", "subject", F.col("status").alias("attendance_status")
    )
    cell = ["student_id", "date", "subject"]
    return weekly_dates(weekly, "weekday", start, end).join(spread(marks, tasks, *cell), cell, "left").select(
        "teacher_name", "date", "start_min",
        time12("start_min").alias("start_time"), time12("end_min").alias("end_time"),
        "student_id", "name", "korean_name", "subject", "attendance_status",
    )


def schedule_tally(schedule: DataFrame) -> DataFrame:
    """Per teacher, date and slot, and per teacher and date (``is_total``), the status counts."""
    keys = ["teacher_name", "date", "start_time", "end_time"]
    return schedule.groupingSets([keys, keys[:2]], *keys).agg(
        (F.grouping("start_time") == 1).alias("is_total"),
        *tally_with_unmarked("attendance_status"),
    )


def teachers_by_date(
    start: dt.date,
    end: dt.date,
    assignments: DataFrame,
    assignment_students: DataFrame,
    assignment_teachers: DataFrame,
    teachers: DataFrame,
) -> DataFrame:
    """Student and date to the names of the teachers, comma separated in order.

    Names are listed once per weekday and only then spread over the dates.
    """
    live = assignments.filter("is_active").select(
        F.col("id").alias("assignment_id"), weekday_num("date").alias("weekday")
    )
    names = teachers.select(F.col("id").alias("teacher_id"), "name")
    weekly = (
        live.join(assignment_teachers, "assignment_id")
        .join(names, "teacher_id")
        .join(assignment_students, "assignment_id")
        .select("student_id", "weekday", "name")
        .distinct()
    )
    listed = weekly.groupBy("student_id", "weekday").agg(
        F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("teachers")
    )
    return weekly_dates(listed, "weekday", start, end).select("student_id", "date", "teachers")
