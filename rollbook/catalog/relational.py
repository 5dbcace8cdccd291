"""Joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.catalog.registry import MONTH, YEAR, query
from rollbook.catalog.views import clock
from rollbook.functions import dates, predicates, values
from rollbook.functions.days import mask_text
from rollbook.operators import aggregates, identity, joins
from rollbook.operators.compaction import first_per_key, latest_per_key, nulls_last
from rollbook.operators.ordering import with_position
from rollbook.operators.ranking import row_index
from rollbook.operators.slots import merge_slots
from rollbook.operators.spread import join_few
from rollbook.plans import billing, directory, records, schedule

# ---- joins ---------------------------------------------------------------------------------


@query(
    "j_inner_equi",
    """SELECT x.student_id, a.id AS assignment_id, s.name, a.subject, ts.start_min FROM assignment_students x JOIN students s ON s.id = x.student_id
JOIN assignments a ON a.id = x.assignment_id JOIN time_slots ts ON ts.id = a.time_slot_id""",
)
def _(t):
    slots = t.time_slots.withColumnRenamed("id", "time_slot_id")
    classes = t.assignments.select(F.col("id").alias("assignment_id"), "subject", "time_slot_id")
    return (
        join_few(classes, slots, t.tasks, "time_slot_id", "assignment_id")
        .join(t.assignment_students, "assignment_id")
        .join(t.students.select(F.col("id").alias("student_id"), "name"), "student_id")
        .select("student_id", "assignment_id", "name", "subject", "start_min")
    )


@query(
    "j_left_equi",
    """SELECT a.id AS assignment_id, t.name AS teacher_name FROM assignments a LEFT JOIN assignment_teachers y ON y.assignment_id = a.id LEFT JOIN teachers t ON t.id = y.teacher_id AND t.is_active""",
)
def _(t):
    live = t.teachers.filter("is_active").select(F.col("id").alias("teacher_id"), F.col("name").alias("teacher_name"))
    return (
        t.assignments.select(F.col("id").alias("assignment_id"))
        .join(t.assignment_teachers, "assignment_id", "left")
        .join(live, "teacher_id", "left")
        .select("assignment_id", "teacher_name")
    )


@query(
    "j_left_compound",
    """SELECT c.teacher_id, c.student_id, p.paid FROM teacher_student_commission c LEFT JOIN teacher_student_payments p ON p.teacher_id = c.teacher_id AND p.student_id = c.student_id AND p.year = 2024 AND p.month = 1""",
)
def _(t):
    paid = t.teacher_student_payments.filter((F.col("year") == 2024) & (F.col("month") == 1))
    keys = ["teacher_id", "student_id"]
    return t.teacher_student_commission.join(paid.select(*keys, "paid"), keys, "left").select(*keys, "paid")


@query(
    "j_cross_target",
    """SELECT k.identity_key, k.id FROM o_identity k WHERE k.identity_key IN (SELECT k2.identity_key FROM o_identity k2 WHERE k2.id IN (SELECT student_id FROM student_notes))""",
)
def _(t):
    return identity.identity_members(t.students, t.student_notes.select("student_id"))


@query(
    "j_derived",
    """SELECT s.id, c.student_id IS NOT NULL AS has_class FROM students s LEFT JOIN (SELECT DISTINCT x.student_id FROM assignment_students x JOIN assignments a ON a.id = x.assignment_id AND a.is_active) c ON c.student_id = s.id""",
)
def _(t):
    assigned = identity.assigned_ids(t.assignments, t.assignment_students, t.tasks)
    return t.students.join(assigned, F.col("id") == assigned["student_id"], "left").select(
        "id", assigned["student_id"].isNotNull().alias("has_class")
    )


@query(
    "j_anti_hidden",
    """SELECT a.id, a.student_id, a.subject FROM attendance a WHERE NOT EXISTS (SELECT 1 FROM hidden_attendance_rows h WHERE h.student_id = a.student_id AND h.subject IS NOT DISTINCT FROM a.subject)""",
)
def _(t):
    left = joins.drop_known(t.attendance, t.hidden_attendance_rows, ["student_id", "subject"])
    return left.select("id", "student_id", "subject")


@query(
    "j_semi_known",
    "SELECT student_id, subject FROM student_subject_tuition WHERE student_id IN (SELECT x.student_id FROM assignment_students x JOIN assignments a ON a.id = x.assignment_id AND a.is_active)",
)
def _(t):
    assigned = identity.assigned_ids(t.assignments, t.assignment_students, t.tasks)
    return joins.keep_known(t.student_subject_tuition, assigned, "student_id").select("student_id", "subject")


@query(
    "j_anti_missing",
    """SELECT student_id, subject FROM student_subject_tuition u WHERE NOT EXISTS (SELECT 1 FROM o_slots s WHERE s.student_id = u.student_id AND s.subject IS NOT DISTINCT FROM u.subject)""",
)
def _(t):
    return joins.drop_known(
        t.student_subject_tuition.select("student_id", "subject"), t.slots, ["student_id", "subject"]
    )


@query(
    "j_lookup_default",
    """SELECT a.id, coalesce(s.name, 'Student ' || CAST(a.student_id AS VARCHAR)) AS name FROM attendance a LEFT JOIN (SELECT id, name FROM students WHERE is_active) s ON s.id = a.student_id""",
)
def _(t):
    fallback = F.concat(F.lit("Student "), F.col("student_id").cast("string"))
    named = joins.lookup(
        t.attendance.select("id", "student_id"),
        t.students.filter("is_active").select(F.col("id").alias("sid"), "name"),
        "student_id", "sid", {"name": fallback},
    )
    return named.select("id", "name")


@query(
    "j_cell",
    """SELECT r.id, r.subject, c.day, k.status FROM o_roster r CROSS JOIN o_calendar c LEFT JOIN o_cells k ON k.student_id = r.id AND k.subject IS NOT DISTINCT FROM r.subject AND k.date = c.date""",
)
def _(t):
    # the days come out of the row itself, so there is no cross join and no join per cell
    def status_on(day):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), day - 1)
        result = F.lit(None).cast("string")
        for s in values.STATUS_CODES:
            result = F.when(F.col(f"{s}_days").bitwiseAND(bit) != 0, F.lit(s)).otherwise(result)
        return result

    last = dates.month_bounds(YEAR, MONTH)[1].day
    spread = t.marked.withColumn("day", F.explode(F.array(*[F.lit(d) for d in range(1, last + 1)])))
    return spread.select("id", "subject", "day", status_on(F.col("day")).alias("status"))


# ---- aggregates ----------------------------------------------------------------------------


@query("a_count_group", "SELECT student_id, subject, count(*) AS n FROM attendance_hist GROUP BY student_id, subject")
def _(t):
    return t.attendance_hist.groupBy("student_id", "subject").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a_count_filter",
    "SELECT student_id, count(*) FILTER (status = 'present') AS present_count, count(*) FILTER (status = 'absent') AS absent_count FROM attendance_hist GROUP BY student_id",
)
def _(t):
    return t.attendance_hist.groupBy("student_id").agg(*aggregates.tally(("present", "absent")))


@query(
    "a_min_max",
    "SELECT name, korean_name, min(id) AS id, max(english_name) AS english_name, max(student_id) AS student_id FROM students GROUP BY name, korean_name",
)
def _(t):
    return t.students.groupBy("name", "korean_name").agg(
        F.min("id").alias("id"), F.max("english_name").alias("english_name"), F.max("student_id").alias("student_id")
    )


@query(
    "a_array_distinct",
    """SELECT x.student_id, a.subject, array_to_string(list_sort(list(DISTINCT list_position(['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'], a.date) - 1)), ',') AS days
FROM assignment_students x JOIN assignments a ON a.id = x.assignment_id GROUP BY x.student_id, a.subject""",
)
def _(t):
    weekdays = t.assignments.select(
        F.col("id").alias("assignment_id"), "subject", dates.weekday_num("date").alias("weekday")
    )
    # a set of weekdays has at most seven members
    listed = t.assignment_students.join(weekdays, "assignment_id").groupBy("student_id", "subject").agg(
        F.sort_array(F.collect_set("weekday")).alias("days")
    )
    return listed.withColumn("days", F.array_join(F.transform("days", lambda d: d.cast("string")), ","))


@query(
    "a_string_distinct",
    """SELECT x.student_id, string_agg(DISTINCT t.name, ', ' ORDER BY t.name) AS teachers FROM assignment_students x JOIN assignment_teachers y ON y.assignment_id = x.assignment_id JOIN teachers t ON t.id = y.teacher_id GROUP BY x.student_id""",
)
def _(t):
    teachers = t.teachers.select(F.col("id").alias("teacher_id"), "name")
    pairs = t.assignment_students.join(t.assignment_teachers, "assignment_id").join(teachers, "teacher_id")
    distinct = pairs.select("student_id", "name").distinct()
    return distinct.groupBy("student_id").agg(
        F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("teachers")
    )


@query("a_distinct", "SELECT DISTINCT student_id, subject, status FROM attendance_hist")
def _(t):
    return t.attendance_hist.select("student_id", "subject", "status").distinct()


@query(
    "a_first_by",
    "SELECT student_id, subject, date, status FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY date, subject NULLS LAST, id) AS rn FROM attendance) x WHERE rn = 1",
)
def _(t):
    rows = t.attendance.select("id", "student_id", "subject", "date", "status")
    picked = first_per_key(rows, ["student_id"], [F.col("date"), *nulls_last("subject"), F.col("id")])
    return picked.select("student_id", "subject", "date", "status")


@query(
    "a_distinct_js",
    "SELECT student_id, arg_max(status, updated_at) AS last_status FROM attendance_log GROUP BY student_id",
)
def _(t):
    rows = t.attendance_log.select("student_id", "updated_at", "id", F.col("status").alias("last_status"))
    return latest_per_key(rows, ["student_id"], ["updated_at", "id"]).select("student_id", "last_status")


@query(
    "a_status_tally",
    """SELECT subject, count(*) FILTER (status = 'present') AS present_count, count(*) FILTER (status = 'absent') AS absent_count, count(*) FILTER (status = 'ta') AS ta_count,
 count(*) FILTER (status = 'noshow') AS noshow_count, count(*) FILTER (status IS NULL) AS unmarked_count, count(*) AS total_count
FROM (SELECT subject, CASE WHEN is_deleted THEN NULL ELSE status END AS status FROM attendance_hist) x GROUP BY subject""",
)
def _(t):
    shown = t.attendance_hist.select("subject", F.when(~F.col("is_deleted"), F.col("status")).alias("status"))
    return shown.groupBy("subject").agg(*aggregates.tally_with_unmarked())


def _currency_sql(source: str, amount: str, classes: str) -> str:
    return f"""SELECT currency, FALSE AS is_total, count(*) AS n_rows, CAST(sum({classes}) AS BIGINT) AS n_classes, round(sum({amount}), 2) AS total, round(coalesce(sum({amount}) FILTER (paid), 0), 2) AS paid,
 round(coalesce(sum({amount}) FILTER (NOT paid AND {amount} > 0), 0), 2) AS unpaid, count(*) FILTER (paid) AS paid_count, count(*) FILTER (NOT paid AND {amount} > 0) AS unpaid_count FROM {source} GROUP BY currency
UNION ALL SELECT NULL, TRUE, count(*), CAST(sum({classes}) AS BIGINT), NULL, NULL, NULL, count(*) FILTER (paid), count(*) FILTER (NOT paid AND {amount} > 0) FROM {source}"""


@query(
    "a_currency_summary",
    _currency_sql(
        "(SELECT currency, CAST(price_per_class AS DOUBLE) AS amount, 1 AS classes, student_id % 3 = 0 AS paid FROM student_subject_tuition) z",
        "amount", "classes",
    ),
)
def _(t):
    rows = t.student_subject_tuition.select(
        "currency", F.col("price_per_class").alias("amount"), F.lit(1).alias("classes"),
        (F.col("student_id") % 3 == 0).alias("paid"),
    )
    return aggregates.currency_summary(rows, "amount", "classes")


@query(
    "a_grand_total",
    """SELECT subject, status, CAST(grouping(subject) + grouping(status) AS INT) AS level, count(*) AS n FROM attendance_hist GROUP BY ROLLUP (subject, status)""",
)
def _(t):
    return t.attendance_hist.rollup("subject", "status").agg(
        (F.grouping("subject") + F.grouping("status")).cast("int").alias("level"), F.count(F.lit(1)).alias("n")
    )


@query(
    "a_nested_group",
    """SELECT teacher_name, date, start_time, CAST(floor((k - 1) / 5) AS INT) AS chunk, n_items, string_agg(CAST(student_id AS VARCHAR), ',' ORDER BY k) AS ids FROM (
 SELECT *, row_number() OVER (PARTITION BY teacher_name, date, start_time ORDER BY student_id, subject NULLS FIRST, name NULLS FIRST) AS k,
  count(*) OVER (PARTITION BY teacher_name, date, start_time) AS n_items FROM o_schedule) s GROUP BY teacher_name, date, start_time, floor((k - 1) / 5), n_items""",
)
def _(t):
    nested = aggregates.chunked_groups(
        _schedule(t), ["teacher_name", "date", "start_time"], "students", ["student_id", "subject", "name"], length=5,
        tasks=t.tasks,
    )
    ids = F.transform("students", lambda s: s["student_id"].cast("string"))
    return nested.select("teacher_name", "date", "start_time", "chunk", "n_items", F.array_join(ids, ",").alias("ids"))


def _schedule(t):
    return schedule.teacher_schedule(
        *dates.month_bounds(YEAR, MONTH), t.students, t.teachers, t.time_slots, t.assignments,
        t.assignment_students, t.assignment_teachers, t.attendance, tasks=t.tasks,
    )


@query(
    "a_pivot_days",
    "SELECT student_id, subject, " + ", ".join(f"max(CASE WHEN day(date) = {d} THEN status END) AS d{d:02d}" for d in range(1, 32))
    + " FROM o_cells GROUP BY student_id, subject",
)
def _(t):
    cells = t.cells.withColumn("day", F.dayofmonth("date"))
    return aggregates.pivot_days(cells, ["student_id", "subject"], "status")


# ---- windows, sorts, sets ------------------------------------------------------------------


@query(
    "w_count_over",
    """SELECT DISTINCT x.student_id, y.teacher_id, count(*) OVER (PARTITION BY x.student_id, y.teacher_id) AS n FROM assignment_students x JOIN assignment_teachers y ON y.assignment_id = x.assignment_id""",
)
def _(t):
    pairs = t.assignment_students.join(t.assignment_teachers, "assignment_id")
    return pairs.groupBy("student_id", "teacher_id").agg(F.count(F.lit(1)).alias("n"))


@query("w_first_rank", "SELECT identity_key, canonical_id FROM o_canonical")
def _(t):
    return identity.canonical_ids(t.students, t.assignments, t.assignment_students, t.tasks)


@query(
    "w_merge_slots",
    f"SELECT student_id, subject, days, {clock('start_min')} AS start_time, {clock('end_min')} AS end_time, count(*) AS copies FROM o_merged GROUP BY ALL",
)
def _(t):
    keys = ["student_id", "subject"]
    per_slot = t.slots.groupBy(*keys, "days", "start_min", "end_min").agg(F.count(F.lit(1)).alias("copies"))
    merged = merge_slots(per_slot, keys).groupBy(*keys, "days", "start_min", "end_min").agg(
        F.sum("copies").alias("copies")
    )
    return merged.select(
        *keys, mask_text("days").alias("days"), dates.time12("start_min").alias("start_time"),
        dates.time12("end_min").alias("end_time"), "copies",
    )


@query("w_first_teacher", "SELECT student_id, subject, teacher_name FROM o_rows")
def _(t):
    rows = t.slots.select("student_id", "subject", "start_min", "end_min", "teacher_ref")
    order = [F.col("start_min"), F.col("end_min"), *nulls_last("teacher_ref")]
    first = first_per_key(rows, ["student_id", "subject"], order)
    names = t.teachers.select(F.col("id").alias("teacher_ref"), F.col("name").alias("teacher_name"))
    return first.join(names, "teacher_ref", "left").select("student_id", "subject", "teacher_name")


@query(
    "w_row_index",
    """SELECT id, name, subject, teacher_name, total_scheduled, present_count, percentage, row_number() OVER (ORDER BY percentage NULLS FIRST, id, subject NULLS FIRST) AS position FROM o_summary""",
)
def _(t):
    rows = records.scheduled_summary(t.marked, t.holidays, YEAR, MONTH)
    columns = ["id", "name", "subject", "teacher_name", "total_scheduled", "present_count", "percentage", "position"]
    return records.lowest_first(rows, t.tasks).select(*columns)


@query(
    "o_sort",
    """SELECT student_id, subject, hidden_from_year, hidden_from_month, row_number() OVER (
 ORDER BY hidden_from_year DESC NULLS FIRST, hidden_from_month ASC NULLS LAST, hidden_at DESC NULLS FIRST, subject ASC NULLS FIRST, student_id) AS position FROM hidden_attendance_rows""",
)
def _(t):
    placed = with_position(t.hidden_attendance_rows, [
        F.col("hidden_from_year").desc_nulls_first(), F.col("hidden_from_month").asc_nulls_last(),
        F.col("hidden_at").desc_nulls_first(), F.col("subject").asc_nulls_first(), F.col("student_id").asc(),
    ])
    return placed.select("student_id", "subject", "hidden_from_year", "hidden_from_month", "position")


@query(
    "o_limit_one",
    "SELECT DISTINCT e.student_id, nullif(e.subject, '') AS subject, EXISTS (SELECT 1 FROM hidden_attendance_rows h WHERE h.student_id = e.student_id AND h.subject IS NOT DISTINCT FROM nullif(e.subject, '')) AS is_hidden FROM bulk_entries e",
)
def _(t):
    from rollbook.sources.readers import clean_entries

    return directory.are_hidden(clean_entries(t.bulk_entries), t.hidden_attendance_rows)


@query(
    "o_topk_lowest",
    "SELECT id, subject, percentage, row_number() OVER (ORDER BY percentage NULLS FIRST, id, subject NULLS FIRST) AS position FROM o_summary",
)
def _(t):
    rows = records.scheduled_summary(t.marked, t.holidays, YEAR, MONTH)
    return records.lowest_first(rows, t.tasks).select("id", "subject", "percentage", "position")


@query(
    "u_union_subjects",
    """SELECT DISTINCT student_id, subject, TRUE AS assigned FROM o_slots UNION ALL
SELECT student_id, subject, FALSE FROM student_subject_tuition u WHERE NOT EXISTS (SELECT 1 FROM o_slots s WHERE s.student_id = u.student_id AND s.subject = u.subject)""",
)
def _(t):
    keys = ["student_id", "subject"]
    assigned = t.slots.select(*keys, F.lit(True).alias("assigned"))
    extra = t.student_subject_tuition.select(*keys, F.lit(False).alias("assigned"))
    return assigned.unionByName(extra).groupBy(*keys).agg(F.max("assigned").alias("assigned"))
