"""Several student ids can belong to one person; these operators resolve them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.names import identity_key
from rollbook.operators.compaction import first_per_key
from rollbook.operators.spread import join_dealt, spread


def with_identity(students: DataFrame) -> DataFrame:
    return students.select("id", identity_key().alias("identity_key"))


def identity_members(students: DataFrame, ids: DataFrame) -> DataFrame:
    """Every id of the persons behind ``ids`` (one column ``student_id``).

    Members are listed once per person, not once per asking id, so a person with very
    many ids stays linear.
    """
    keyed = with_identity(students)
    asked = keyed.join(ids.select(F.col("student_id").alias("id")).distinct(), "id", "left_semi")
    wanted = asked.select("identity_key").distinct()
    return keyed.join(wanted, "identity_key", "left_semi").select("identity_key", "id")


def person_ids(students: DataFrame) -> DataFrame:
    """``id -> person_id``: the lowest id of the person; an unknown identity stays alone."""
    keyed = with_identity(students)
    lowest = keyed.groupBy("identity_key").agg(F.min("id").alias("person_id"))
    joined = keyed.join(lowest, "identity_key", "left")
    return joined.select("id", F.coalesce("person_id", "id").alias("person_id"))


def assigned_ids(assignments: DataFrame, assignment_students: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct students with an active assignment; ``tasks`` deals the assignments to that many tasks."""
    live = assignments.filter("is_active").select(F.col("id").alias("assignment_id"))
    dealt = spread(assignment_students, tasks, "assignment_id")
    return join_dealt(dealt, live, tasks, "assignment_id", "left_semi").select("student_id").distinct()


def canonical_ids(
    students: DataFrame, assignments: DataFrame, assignment_students: DataFrame, tasks: int | None = None
) -> DataFrame:
    """``identity_key -> canonical_id``; ``tasks`` as for ``assigned_ids``.

    The lowest id that has an active assignment, active students first; then the lowest
    active id; then the lowest id. Four filtered minimums combine on the map side.
    """
    assigned = assigned_ids(assignments, assignment_students, tasks).withColumnRenamed("student_id", "id")
    flagged = students.select(
        "id", identity_key().alias("identity_key"), F.coalesce("is_active", F.lit(False)).alias("live")
    ).join(assigned.withColumn("has_class", F.lit(True)), "id", "left")
    has_class, live = F.coalesce("has_class", F.lit(False)), F.col("live")
    lowest = flagged.groupBy("identity_key").agg(
        F.coalesce(
            F.min(F.when(has_class & live, F.col("id"))),
            F.min(F.when(has_class, F.col("id"))),
            F.min(F.when(live, F.col("id"))),
            F.min("id"),
        ).alias("canonical_id")
    )
    return lowest.filter(F.col("identity_key").isNotNull())


def id_remap(
    students: DataFrame, assignments: DataFrame, assignment_students: DataFrame, tasks: int | None = None
) -> DataFrame:
    """``old_id -> canonical_id`` wherever the two differ; ``tasks`` as for ``assigned_ids``."""
    canonical = canonical_ids(students, assignments, assignment_students, tasks)
    return (
        with_identity(students)
        .join(canonical, "identity_key")
        .filter(F.col("id") != F.col("canonical_id"))
        .select(F.col("id").alias("old_id"), "canonical_id")
    )


def apply_remap(rows: DataFrame, remap: DataFrame, column: str = "student_id") -> DataFrame:
    """Replace ids by canonical ones; the stored id is kept as ``original_id``."""
    side = remap.select(F.col("old_id").alias("original_id"), "canonical_id")
    joined = rows.withColumnRenamed(column, "original_id").join(side, "original_id", "left")
    kept = [c for c in rows.columns if c != column]
    return joined.select(
        F.coalesce("canonical_id", "original_id").alias(column), "original_id", *kept
    )


def active_people(students: DataFrame) -> DataFrame:
    """One active student per person: with a first start date if possible, then the lowest id."""
    live = students.filter("is_active").select(
        identity_key().alias("identity_key"), "id", "name", "korean_name", "english_name",
        "first_start_date",
    )
    order = [F.col("first_start_date").isNull(), F.col("id")]
    return first_per_key(live, ["identity_key"], order)
