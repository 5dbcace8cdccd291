"""Presence records: slices, cells, month sets and the tallies made from them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.days import WORKDAY_MASK
from rollbook.functions.names import blank_to_null, clean_name
from rollbook.functions.predicates import not_deleted, recent, status_in
from rollbook.functions.values import STATUS_CODES, percentage
from rollbook.operators.aggregates import tally
from rollbook.operators.identity import apply_remap
from rollbook.operators.joins import null_safe_join
from rollbook.operators.ordering import with_position
from rollbook.schema import STATUSES
from rollbook.sources.calendar import day_set, holiday_set, schedule_set, size_of, without
from rollbook.sources.readers import date_range, month_slice

Month = tuple[int, int]


def _live(attendance: DataFrame, month: Month | None) -> DataFrame:
    sliced = attendance if month is None else month_slice(attendance, *month)
    return sliced.filter(not_deleted())


def _with_period(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"year": F.year("date"), "month": F.month("date")})


def month_records(attendance: DataFrame, remap: DataFrame, year: int, month: int) -> DataFrame:
    """Live records of a month under canonical ids."""
    rows = _live(attendance, (year, month)).select("id", "student_id", "date", "status", "notes", "subject")
    return apply_remap(rows, remap)


def cells(records: DataFrame) -> DataFrame:
    """One status per (student, subject, day): the highest original id wins, then the highest id."""
    subject = records.withColumn("subject", blank_to_null("subject"))
    picked = subject.groupBy("student_id", "subject", "date").agg(
        F.max(F.struct("original_id", "id", "status")).alias("_last")
    )
    return picked.select("student_id", "subject", "date", F.col("_last.status").alias("status"))


def month_sets(month_cells: DataFrame) -> DataFrame:
    """Per (student, subject) the days of the month on which each status holds."""
    return month_cells.groupBy("student_id", "subject").agg(
        *[day_set(F.col("status") == s).alias(f"{s}_days") for s in STATUSES]
    )


def roster_month(roster: DataFrame, month_cells: DataFrame, tasks: int | None = None) -> DataFrame:
    """Roster rows with their month sets; empty sets where nothing is recorded. ``tasks`` deals the join to that many."""
    sets = month_sets(month_cells).withColumnRenamed("student_id", "id")
    joined = null_safe_join(roster, sets, ["id", "subject"], "left", tasks)
    empty = {f"{s}_days": F.coalesce(f"{s}_days", F.lit(0).cast("long")) for s in STATUSES}
    return joined.withColumns(empty)


def row_tally(marked: DataFrame) -> DataFrame:
    """P, A, TA and N per roster row over all days of the month."""
    return marked.select(
        "id", "subject", *[size_of(F.col(f"{s}_days")).alias(f"{s}_count") for s in STATUSES]
    )


def pct_marked(marked: DataFrame, holidays: DataFrame, year: int, month: int) -> DataFrame:
    """present / (marked - ta) over scheduled days that carry a status and are no holiday."""
    open_days = without(schedule_set("days_mask", year, month), F.col("_holidays"))
    any_status = F.col("present_days")
    for s in STATUSES[1:]:
        any_status = any_status.bitwiseOR(F.col(f"{s}_days"))
    rows = marked.withColumn("_holidays", holiday_set(holidays, year, month)).withColumn("_open", open_days)
    present = size_of(F.col("present_days").bitwiseAND(F.col("_open")))
    counted = size_of(any_status.bitwiseAND(F.col("_open"))) - size_of(
        F.col("ta_days").bitwiseAND(F.col("_open"))
    )
    return rows.select("id", "subject", percentage(present, counted).alias("pct"))


def scheduled_summary(marked: DataFrame, holidays: DataFrame, year: int, month: int) -> DataFrame:
    """Scheduled days, counts and present / (scheduled - ta) per roster row, holidays left out.

    Rows without a schedule count Monday to Friday.
    """
    workdays = f"IF(days_mask != 0, days_mask, {WORKDAY_MASK})"
    rows = marked.withColumn("_holidays", holiday_set(holidays, year, month)).withColumn(
        "_open", without(schedule_set(workdays, year, month), F.col("_holidays"))
    )
    counts = [
        size_of(F.col(f"{s}_days").bitwiseAND(F.col("_open"))).alias(f"{s}_count") for s in STATUSES
    ]
    counted = rows.select(
        "id", "name", "korean_name", "subject", "teacher_name",
        size_of(F.col("_open")).alias("total_scheduled"), *counts,
    )
    return counted.withColumn(
        "percentage", percentage("present_count", F.col("total_scheduled") - F.col("ta_count"))
    )


def summary_totals(summary: DataFrame) -> DataFrame:
    """The totals row of the scheduled summary."""
    names = ["total_scheduled", *[f"{s}_count" for s in STATUSES]]
    totals = summary.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in names],
    )
    return totals.withColumn(
        "percentage", percentage("present_count", F.col("total_scheduled") - F.col("ta_count"))
    )


def lowest_first(summary: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every row with its ``position`` by percentage, rows without one first, then by id and subject. ``tasks`` sort."""
    order = [F.col("percentage").asc_nulls_first(), F.col("id").asc(), F.col("subject").asc_nulls_first()]
    return with_position(summary, order, tasks)


def month_grid(marked: DataFrame, holidays: DataFrame, year: int, month: int) -> DataFrame:
    """Wide month: one column per day with H on holidays, else P, A, TA, N or blank.

    Columns past the end of a short month stay blank.
    """
    rows = marked.withColumn("_holidays", holiday_set(holidays, year, month))

    def cell(day: int):
        # one SQL text per day: building 31 nested conditions call by call takes seconds
        bit = f"{1 << (day - 1)}L"
        marks = " ".join(f"WHEN {s}_days & {bit} != 0 THEN '{code}'" for s, code in STATUS_CODES.items())
        return F.expr(f"CASE WHEN _holidays & {bit} != 0 THEN 'H' {marks} ELSE '' END").alias(f"d{day:02d}")

    return rows.select(
        "id", "name", "korean_name", "subject", "teacher_name", *[cell(day) for day in range(1, 32)]
    )


def month_totals(attendance: DataFrame, month: Month | None) -> DataFrame:
    """Present, absent and ta per month over all students."""
    return (
        _with_period(_live(attendance, month))
        .groupBy("year", "month")
        .agg(*tally(("present", "absent", "ta")))
    )


def student_month(attendance: DataFrame, ids: DataFrame, year: int, month: int) -> DataFrame:
    """Live records of a month of the given students."""
    wanted = ids.select("student_id").distinct()
    return _live(attendance, (year, month)).join(wanted, "student_id", "left_semi")


def student_summary(attendance: DataFrame, month: Month | None = None) -> DataFrame:
    """Present, absent and all records per student and month; every month when none is given."""
    return (
        _with_period(_live(attendance, month))
        .groupBy("student_id", "year", "month")
        .agg(*tally(("present", "absent")), F.count(F.lit(1)).alias("total_records"))
    )


def month_summary(attendance: DataFrame, students: DataFrame, month: Month | None = None) -> DataFrame:
    """Present and absent per student and month with names.

    Records are counted before they meet the students, so the join sees one row per
    student and month however skewed the records are.
    """
    counted = (
        _with_period(_live(attendance, month))
        .groupBy("student_id", "year", "month")
        .agg(*tally(("present", "absent")))
    )
    people = students.select(F.col("id").alias("student_id"), "name", "english_name")
    return counted.join(people, "student_id").select(
        "student_id", "name", "english_name", "year", "month", "present_count", "absent_count"
    )


def class_counts(
    attendance: DataFrame,
    primary: DataFrame,
    people: DataFrame,
    start: dt.date,
    end: dt.date,
    statuses: Sequence[str] = ("present",),
    teacher_id: int | None = None,
    teacher_name: str | None = None,
    remap: DataFrame | None = None,
) -> DataFrame:
    """Classes per teacher, student and subject in a date range, with totals.

    ``level`` is 0 for a student row, 1 for a teacher's total and 2 for the grand total.
    A teacher filter removes the other teachers' records before they are counted.
    ``remap`` counts under canonical ids.
    """
    rows = date_range(attendance, start, end).filter(not_deleted() & status_in(statuses))
    rows = rows.select("student_id", "subject")
    if remap is not None:
        rows = apply_remap(rows, remap)
    teachers = primary.select("student_id", "teacher_id", "teacher_name")
    filtered = teacher_id is not None or teacher_name is not None
    if teacher_id is not None:
        teachers = teachers.filter(F.col("teacher_id") == teacher_id)
    if teacher_name is not None:
        teachers = teachers.filter(F.col("teacher_name") == teacher_name)
    if filtered:
        rows = rows.join(teachers.select("student_id"), "student_id", "left_semi")
    counted = rows.groupBy("student_id", "subject").agg(F.count(F.lit(1)).alias("class_count"))
    info = people.select(F.col("id").alias("student_id"), "name", "korean_name")
    known = teachers.withColumn("_known", F.lit(True))
    named = (
        counted.join(known, "student_id", "left")
        .join(info, "student_id", "left")
        .select(
            "teacher_id",
            F.when(F.col("_known"), F.col("teacher_name"))
            .otherwise(F.lit("Unknown Teacher"))
            .alias("teacher_name"),
            "student_id",
            F.coalesce(
                clean_name("name"), F.concat(F.lit("Student "), F.col("student_id").cast("string"))
            ).alias("student_name"),
            "korean_name", "subject", "class_count",
        )
    )
    # rows without a teacher, known or not, share one group and its name
    shared = F.col("teacher_id").isNull()
    label = F.when(shared, F.lit("Unknown Teacher")).otherwise(F.col("teacher_name"))
    student = ["teacher_id", "teacher_name", "student_id", "student_name", "korean_name", "subject"]
    return (
        named.withColumn("teacher_name", label)
        .groupingSets([student, student[:2], []], *student)
        .agg(
            (F.grouping("teacher_id") + F.grouping("student_id")).cast("int").alias("level"),
            F.sum("class_count").cast("long").alias("class_count"),
        )
    )


def recent_deletes(attendance: DataFrame, students: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    """Records deleted within the last minutes, with names where the student is known."""
    gone = attendance.filter(F.col("is_deleted") & recent(as_of, minutes))
    people = students.select(
        F.col("id").alias("student_id"), F.col("name").alias("student_name"), "korean_name"
    )
    return gone.join(people, "student_id", "left").select(
        "id", "student_id", "date", "status", "subject", "deleted_at", "student_name", "korean_name"
    )


def month_notes(notes: DataFrame, remap: DataFrame, year: int, month: int) -> DataFrame:
    """Notes of a month under canonical ids."""
    rows = notes.filter((F.col("year") == year) & (F.col("month") == month))
    return apply_remap(rows.select("student_id", "notes", "subject"), remap)


def class_report(counts: DataFrame) -> tuple[DataFrame, list]:
    """The lines of the nested report of class counts, and their order: per teacher one line with totals, then one line
    per student with the classes of each subject.

    A line holds one student's subjects, never a teacher's students, so a teacher of any size is many short lines.
    """
    rows = counts.filter("level = 0")
    who = ["teacher_id", "teacher_name"]
    student = ["student_id", "student_name", "korean_name"]
    subjects = F.array_sort(F.collect_list(F.struct("subject", "class_count"))).alias("subjects")
    total = F.sum("class_count").cast("long").alias("total_classes")
    students = rows.groupBy(*who, *student).agg(subjects, total).withColumn("kind", F.lit("student"))
    teachers = students.groupBy(*who).agg(
        F.count_distinct("student_id").alias("n_students"), F.sum("total_classes").alias("total_classes")
    ).withColumn("kind", F.lit("teacher"))
    lines = teachers.unionByName(students, allowMissingColumns=True)
    order = [
        F.col("teacher_name").asc_nulls_first(), F.col("teacher_id").asc_nulls_last(), F.col("kind").desc(),
        F.col("student_name").asc_nulls_first(), F.col("student_id").asc_nulls_first(),
    ]
    return lines, order
