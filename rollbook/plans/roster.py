"""The roster: one row per student and subject with teacher and merged schedules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.dates import time12, time_range, weekday_num, weekday_of
from rollbook.functions.days import mask_has, mask_text, mask_union
from rollbook.functions.names import blank_to_null, row_key
from rollbook.functions.predicates import hidden_as_of
from rollbook.operators.compaction import nulls_last
from rollbook.operators.joins import null_safe_join
from rollbook.operators.slots import with_merged
from rollbook.operators.spread import join_dealt, join_few, spread


def schedule_slots(
    students: DataFrame,
    teachers: DataFrame,
    time_slots: DataFrame,
    assignments: DataFrame,
    assignment_students: DataFrame,
    assignment_teachers: DataFrame,
    canonical: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Active assignments per person, subject, teacher and slot with the set of weekdays.

    Students of equal name and Korean name count as one (``name_id``, their lowest id), as
    do teachers of equal name (``teacher_ref``); the lowest student id of a row stands for
    it. Names stay out: rows are grouped and sorted on numbers and meet the names last.
    ``canonical`` (``id``, ``canonical_id``) replaces the student id. ``tasks`` deals the joins
    and the grouping to that many tasks, the session's number without it.
    """
    live = assignments.filter("is_active").select(
        F.col("id").alias("assignment_id"), "subject", "time_slot_id",
        weekday_num("date").alias("weekday"),
    )
    active = students.filter("is_active")
    alike = active.groupBy("name", "korean_name").agg(F.min("id").alias("name_id"))
    people = null_safe_join(active, alike, ["name", "korean_name"], "inner").select(
        F.col("id").alias("student_id"), "name_id", "english_name", "color_keyword",
        F.col("student_id").alias("external_id"),
    )
    slots = time_slots.select(F.col("id").alias("time_slot_id"), "start_min", "end_min")
    # teachers are resolved on their own narrow rows, not once per student
    refs = spread(teacher_refs(teachers), tasks, "teacher_id")
    taught = assignment_teachers.join(refs, "teacher_id", "left").select("assignment_id", "teacher_ref")
    timed = join_few(live, slots, tasks, "time_slot_id", "assignment_id")
    weekly = join_dealt(timed, assignment_students, tasks, "assignment_id")
    weekly = weekly.join(spread(people, tasks, "student_id"), "student_id")
    joined = join_dealt(weekly, taught, tasks, "assignment_id", "left")
    keys = ["name_id", "subject", "teacher_ref", "start_min", "end_min"]
    grouped = spread(joined, tasks, *keys).groupBy(*keys).agg(
        F.min("student_id").alias("student_id"),
        F.max("external_id").alias("external_id"),
        F.max("english_name").alias("english_name"),
        F.max("color_keyword").alias("color_keyword"),
        mask_union("weekday").alias("days"),
    )
    grouped = grouped.withColumn("subject", blank_to_null("subject"))
    if canonical is None:
        return grouped
    ids = canonical.select(F.col("id").alias("student_id"), "canonical_id")
    return grouped.join(ids, "student_id", "left").withColumn(
        "student_id", F.coalesce("canonical_id", "student_id")
    ).drop("canonical_id")


def teacher_refs(teachers: DataFrame) -> DataFrame:
    """``teacher_id -> teacher_ref``: the lowest id of the teachers of that name."""
    refs = teachers.groupBy("name").agg(F.min("id").alias("teacher_ref"))
    return null_safe_join(teachers, refs, ["name"], "inner").select(
        F.col("id").alias("teacher_id"), "teacher_ref"
    )


def _schedule_text(entry):
    return F.array_repeat(F.concat(entry["days"], F.lit(" "), entry["time"]), entry["copies"].cast("int"))


def schedules_text(schedules="schedules"):
    """All schedules of a row in one text, copies repeated."""
    each = F.flatten(F.transform(F.col(schedules), _schedule_text))
    return F.array_join(each, "; ")


def build_roster(
    slots: DataFrame,
    students: DataFrame,
    teachers: DataFrame,
    tuition: DataFrame,
    hidden: DataFrame,
    year: int | None = None,
    month: int | None = None,
    legacy_text_order: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Roster rows from the schedule slots.

    Subjects that occur only in the tuition table are added for students who have an
    assignment; rows hidden as of the month (hidden at any time without one) are left out. ``tasks`` as
    for ``schedule_slots``.
    """
    unseen = hidden.filter(hidden_as_of(year, month))
    names = students.select(F.col("id").alias("name_id"), "name", "korean_name")
    teacher_names = teachers.select(F.col("id").alias("teacher_ref"), F.col("name").alias("teacher_name"))
    return (
        _student_subjects(slots, tuition, unseen, legacy_text_order, tasks)
        .join(spread(names, tasks, "name_id"), "name_id")
        .join(spread(teacher_names, tasks, "teacher_ref"), "teacher_ref", "left")
        .select(
            F.col("student_id").alias("id"), "external_id", "name", "korean_name", "english_name",
            "color_keyword", "teacher_name",
            F.get("schedules.time", F.lit(0)).alias("schedule_time"),
            F.get("schedules.days", F.lit(0)).alias("schedule_days"),
            "schedules", "days_mask", "subject",
            row_key("student_id", "subject").alias("row_key"),
        )
    )


def _student_subjects(
    slots: DataFrame, tuition: DataFrame, hidden: DataFrame, legacy_text_order: bool, tasks: int | None
) -> DataFrame:
    """One row per student and subject: first teacher, merged schedules, the student's info.

    Tuition subjects and hidden rows travel with the slots as flagged rows of the same
    keys, which takes the place of a join with each. A student's rows are brought together
    once and sorted once: counting the copies of a slot, merging, nesting and the choice of
    the student's first row all go through them in that order. The windows see them after
    copies are counted, when a student has a bounded number (subjects x sets of weekdays x slots).
    """
    keys = ["student_id", "subject"]
    shown = ["name_id", "external_id", "english_name", "color_keyword"]
    pair = ["student_id", blank_to_null("subject").alias("subject"), F.lit(0).alias("days")]
    yes, no = F.lit(True), F.lit(False)
    known = F.col("student_id").isNotNull()  # without a student there is no slot, so no row
    taught = slots.select(
        *keys, "days", "start_min", "end_min", "teacher_ref", *shown,
        yes.alias("assigned"), yes.alias("listed"), no.alias("hidden"),
    )
    priced = tuition.filter(known).select(*pair, no.alias("assigned"), yes.alias("listed"), no.alias("hidden"))
    unseen = hidden.filter(known).select(*pair, no.alias("assigned"), no.alias("listed"), yes.alias("hidden"))
    teacher = F.struct((~F.col("assigned")).alias("o"), *nulls_last("teacher_ref"), *shown)
    together = taught.unionByName(priced, allowMissingColumns=True).unionByName(unseen, allowMissingColumns=True)
    dealt = spread(together, tasks, "student_id") if tasks else together.repartition("student_id")
    per_slot = (
        dealt.groupBy(*keys, "days", "start_min", "end_min")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(teacher).alias("teacher"),
            F.max("listed").alias("listed"),
            F.max("hidden").alias("hidden"),
        )
    )
    merged, order = with_merged(per_slot, keys, legacy_text_order)
    text = mask_text("days")
    timed = F.filter("merged", lambda s: s["start_min"].isNotNull() & s["end_min"].isNotNull() & (F.col("days") != 0))

    def entry(slot):
        times = [time12(slot["start_min"]), time12(slot["end_min"])]
        o1, o2 = times if legacy_text_order else (slot["start_min"], slot["end_min"])
        return F.struct(
            F.lower(text).alias("o0"), o1.alias("o1"), o2.alias("o2"),
            time_range(*times).alias("time"), text.alias("days"), slot["copies"].alias("copies"),
        )

    rows = merged.withColumn("timed", timed)
    first = F.struct(
        F.col("teacher.o").alias("o"), *nulls_last("start_min"), *nulls_last("end_min"),
        *[F.col("teacher")[c].alias(c) for c in ("_teacher_ref_null", "teacher_ref", *shown)],
    )
    by_row = Window.partitionBy(*keys)
    nested = rows.select(
        *keys,
        F.row_number().over(by_row.orderBy(*order)).alias("n"),
        F.min(first).over(by_row).alias("first"),
        F.max("listed").over(by_row).alias("listed"),
        F.max("hidden").over(by_row).alias("hidden"),
        F.collect_list(F.transform("timed", entry)).over(by_row).alias("entries"),
        F.coalesce(F.bit_or(F.when(F.size("timed") > 0, F.col("days"))).over(by_row), F.lit(0)).alias("days_mask"),
    ).filter("n = 1")
    by_student = Window.partitionBy("student_id")
    info = F.min(F.struct(F.col("first.o"), *nulls_last("subject"), "first")).over(by_student)
    chosen = nested.withColumn("info", info["first"]).filter(
        ~F.col("info.o") & F.col("listed") & ~F.col("hidden")
    ).withColumn("entries", F.sort_array(F.flatten("entries")))
    return chosen.select(
        *keys, F.col("first.teacher_ref").alias("teacher_ref"), *[F.col("info")[c].alias(c) for c in shown],
        F.arrays_zip(*[F.col("entries")[c].alias(c) for c in ("time", "days", "copies")]).alias("schedules"),
        "days_mask",
    )


def teacher_filter_list(roster: DataFrame) -> DataFrame:
    """Distinct teacher names with the number of their rows, and the number of all rows.

    The row with a NULL name is the unfiltered total.
    """
    counted = roster.groupingSets([["teacher_name"], []], "teacher_name").agg(
        F.grouping("teacher_name").alias("_all"), F.count(F.lit(1)).alias("n_rows")
    )
    return counted.filter((F.col("_all") == 1) | (F.col("teacher_name") != "")).drop("_all")


def bulk_candidates(roster: DataFrame, date: dt.date) -> DataFrame:
    """Rows scheduled on the weekday of a date; rows without a schedule never are."""
    return roster.filter(mask_has("days_mask", weekday_of(F.lit(date)))).select(
        F.col("id").alias("student_id"), "subject"
    )
