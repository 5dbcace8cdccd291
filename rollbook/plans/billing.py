"""Commissions and tuition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.names import composite_id
from rollbook.functions.predicates import not_deleted
from rollbook.functions.values import amount
from rollbook.operators.aggregates import currency_summary
from rollbook.operators.compaction import nulls_last
from rollbook.operators.joins import lookup
from rollbook.operators.spread import spread
from rollbook.schema import DEFAULT_CURRENCY
from rollbook.sources.readers import month_slice

def _zero():
    return F.lit(0).cast("decimal(10,2)")


def primary_teacher(
    students: DataFrame,
    teachers: DataFrame,
    assignments: DataFrame,
    assignment_students: DataFrame,
    assignment_teachers: DataFrame,
    require_teacher: bool = True,
) -> DataFrame:
    """The teacher with most active assignments per active student; ties go to the lowest id.

    Without ``require_teacher`` assignments that have no teacher count as a candidate of
    their own, last among equals.
    """
    how = "inner" if require_teacher else "left"
    live = assignments.filter("is_active").select(F.col("id").alias("assignment_id"))
    people = students.filter("is_active").select(F.col("id").alias("student_id"))
    known = teachers.select(F.col("id").alias("teacher_id"), F.col("name").alias("teacher_name"))
    pairs = (
        assignment_students.join(live, "assignment_id")
        .join(people, "student_id", "left_semi")
        .join(assignment_teachers, "assignment_id", how)
        .groupBy("student_id", F.col("teacher_id").alias("_ref"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(known, F.col("_ref") == F.col("teacher_id"), how)
    )
    if not require_teacher:
        # references to no teacher and missing references are the same candidate
        pairs = pairs.groupBy("student_id", "teacher_id", "teacher_name").agg(F.sum("n").alias("n"))
    best = pairs.groupBy("student_id").agg(
        F.min(F.struct((-F.col("n")).alias("rank"), *nulls_last("teacher_id"), "teacher_name")).alias("_best")
    )
    return best.select(
        "student_id", F.col("_best.teacher_id").alias("teacher_id"),
        F.col("_best.teacher_name").alias("teacher_name"),
        (-F.col("_best.rank")).alias("n_assignments"),
    )


def present_counts(attendance: DataFrame, year: int, month: int) -> DataFrame:
    live = month_slice(attendance, year, month).filter(not_deleted() & (F.col("status") == "present"))
    return live.groupBy("student_id").agg(F.count(F.lit(1)).alias("class_count"))


def _of_month(payments: DataFrame, year: int, month: int) -> DataFrame:
    return payments.filter((F.col("year") == year) & (F.col("month") == month)).drop("year", "month")


def commissions(
    primary: DataFrame,
    students: DataFrame,
    rates: DataFrame,
    payments: DataFrame,
    attendance: DataFrame,
    year: int,
    month: int,
) -> DataFrame:
    """Primary teacher x present classes x rate per student, with the payment state."""
    people = students.select(
        F.col("id").alias("student_id"), F.col("name").alias("student_name"), "korean_name", "english_name"
    )
    pair = ["teacher_id", "student_id"]
    rate = rates.select(*pair, "commission_per_class", "currency")
    paid = _of_month(payments, year, month).select(*pair, "paid", "payment_date", "notes")
    joined = (
        primary.select("student_id", "teacher_id", "teacher_name")
        .join(people, "student_id")
        .join(present_counts(attendance, year, month), "student_id", "left")
        .join(rate, pair, "left")
        .join(paid, pair, "left")
    )
    price = F.coalesce("commission_per_class", _zero())
    count = F.coalesce("class_count", F.lit(0))
    return joined.select(
        composite_id("teacher_id", "student_id").alias("id"),
        "student_id", "student_name", "korean_name", "english_name", "teacher_id", "teacher_name",
        price.alias("commission_per_class"),
        F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
        count.alias("class_count"),
        amount(price, count).alias("total_commission"),
        F.coalesce("paid", F.lit(False)).alias("paid"),
        "payment_date",
        F.nullif(F.col("notes"), F.lit("")).alias("payment_notes"),
    )


def commission_summary(rows: DataFrame) -> DataFrame:
    return currency_summary(rows, "total_commission", "class_count")


def tuition(
    roster: DataFrame,
    rates: DataFrame,
    payments: DataFrame,
    attendance: DataFrame,
    year: int,
    month: int,
    tasks: int | None = None,
) -> DataFrame:
    """Amounts per student and subject: roster subjects and the student's priced subjects.

    The present count covers all subjects of a student. A student's priced subjects are
    due once here; a per-row report repeats them on each of the student's roster rows,
    and ``copies`` is how often, so such totals need no repeated rows. ``tasks`` deals the
    students to that many tasks.
    """
    known = ["name", "korean_name", "english_name"]
    listed = roster.select(
        F.col("id").alias("student_id"), "subject", "teacher_name", *known, F.lit(True).alias("on_roster")
    )
    priced = rates.select(
        "student_id", "subject", F.col("price_per_class").alias("price"),
        F.col("currency").alias("price_currency"), F.lit(True).alias("is_priced"),
    )
    # a student has one row per subject on either side, so a window over a student is small
    by_student = Window.partitionBy("student_id")
    first = F.struct(F.coalesce("subject", F.lit("")).alias("o"), "teacher_name", *known)
    both = spread(listed.unionByName(priced, allowMissingColumns=True), tasks, "student_id").select(
        "*",
        F.count("on_roster").over(by_student).alias("n_rows"),
        F.max("is_priced").over(by_student).alias("has_price"),
        F.min(F.when(F.col("on_roster"), first)).over(by_student).alias("first"),
    )
    due = both.filter(
        F.col("first").isNotNull()
        & (F.col("is_priced") | F.col("subject").isNotNull() | F.col("has_price").isNull())
    )
    subjects = (
        due.withColumn("subject", F.coalesce("subject", F.lit("(No Subject)")))
        .groupBy("student_id", "subject")
        .agg(
            F.max("price").alias("price"),
            F.max("price_currency").alias("price_currency"),
            F.max("is_priced").alias("is_priced"),
            F.max("on_roster").alias("on_roster"),
            F.max(F.when(F.col("on_roster"), F.col("teacher_name"))).alias("row_teacher"),
            F.max("n_rows").alias("n_rows"),
            F.min("first").alias("first"),
        )
    )
    paid = _of_month(payments, year, month).select("student_id", "subject", "paid", "payment_date", "notes")
    joined = subjects.join(present_counts(attendance, year, month), "student_id", "left").join(
        spread(paid, tasks, "student_id", "subject"), ["student_id", "subject"], "left"
    )
    price = F.coalesce("price", _zero())
    count = F.coalesce("class_count", F.lit(0))
    return joined.select(
        composite_id("student_id", "subject").alias("id"),
        "student_id",
        *[F.col("first")[name].alias(name) for name in known],
        F.when(F.col("on_roster"), F.col("row_teacher"))
        .otherwise(F.col("first.teacher_name"))
        .alias("teacher_name"),
        "subject",
        price.alias("price_per_class"),
        F.coalesce("price_currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
        count.alias("present_count"),
        amount(price, count).alias("total_tuition"),
        F.coalesce("paid", F.lit(False)).alias("paid"),
        "payment_date",
        F.nullif(F.col("notes"), F.lit("")).alias("payment_notes"),
        F.when(F.col("is_priced"), F.col("n_rows")).otherwise(F.lit(1)).alias("copies"),
    )


def tuition_summary(rows: DataFrame, fanout: bool = False) -> DataFrame:
    """Totals per currency; ``fanout`` counts every repetition of the per-row report."""
    return currency_summary(rows, "total_tuition", "present_count", "copies" if fanout else None)


def multi_subject_students(rows: DataFrame) -> DataFrame:
    """Tuition rows of students that have more than one, the ones that may be deleted."""
    several = F.count(F.lit(1)).over(Window.partitionBy("student_id"))
    return rows.withColumn("_n", several).filter("_n > 1").drop("_n")


def teacher_rates(teachers: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate per teacher, 0 PHP without one."""
    asked = teachers.select(F.col("id").alias("teacher_id"))
    return lookup(
        asked, rates, "teacher_id", "teacher_id",
        {"commission_per_class": _zero(), "currency": DEFAULT_CURRENCY},
    )


def teacher_payment_state(teachers: DataFrame, payments: DataFrame, year: int, month: int) -> DataFrame:
    """Payment state per teacher for a month, unpaid without one."""
    asked = teachers.select(
        F.col("id").alias("teacher_id"), F.lit(year).alias("year"), F.lit(month).alias("month")
    )
    paid = _of_month(payments, year, month).select("teacher_id", "paid", "payment_date", "notes")
    return asked.join(paid, "teacher_id", "left").withColumn("paid", F.coalesce("paid", F.lit(False)))
