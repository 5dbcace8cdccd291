"""The analytical reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rollbook.catalog.registry import MONTH, YEAR, query
from rollbook.catalog.relational import _currency_sql, _schedule
from rollbook.functions.dates import month_bounds
from rollbook.operators import identity
from rollbook.plans import billing, directory, records, roster, schedule
from rollbook.schema import STATUSES
from rollbook.sources.readers import clean_entries

# ---- identity and roster -------------------------------------------------------------------


@query(
    "q_identity_members",
    """SELECT k.identity_key, k.id FROM o_identity k WHERE k.identity_key IN (SELECT k2.identity_key FROM o_identity k2 WHERE k2.id IN (SELECT student_id FROM attendance_log))""",
)
def _(t):
    return identity.identity_members(t.students, t.attendance_log.select("student_id"))


@query("q_id_remap", "SELECT old_id, canonical_id FROM o_remap")
def _(t):
    return t.remap


_ROSTER_COLUMNS = (
    "id, external_id, name, korean_name, english_name, color_keyword, teacher_name, schedule_time, schedule_days, subject, row_key"
)


@query("q_roster", f"SELECT {_ROSTER_COLUMNS}, n_schedules, coalesce(schedules, '') AS schedules FROM o_roster")
def _(t):
    copies = F.aggregate("schedules", F.lit(0).cast("long"), lambda acc, s: acc + s["copies"])
    return t.roster.select(
        *_ROSTER_COLUMNS.split(", "), copies.alias("n_schedules"), roster.schedules_text().alias("schedules")
    )


@query("q_month_records", "SELECT id, student_id, date, status, notes, subject FROM o_records")
def _(t):
    return t.records.drop("original_id")


@query(
    "q_active_people",
    "SELECT identity_key, id, name, korean_name, english_name FROM o_people",
)
def _(t):
    return identity.active_people(t.students).drop("first_start_date")


# ---- counts over records -------------------------------------------------------------------

_COUNTED = "teacher_id, teacher_name, student_id, student_name, korean_name, subject"


@query(
    "q_class_counts",
    f"""SELECT {_COUNTED}, 0 AS level, class_count FROM o_class_counts
UNION ALL SELECT teacher_id, teacher_name, NULL, NULL, NULL, NULL, 1, CAST(sum(class_count) AS BIGINT) FROM o_class_counts GROUP BY teacher_id, teacher_name
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 2, CAST(sum(class_count) AS BIGINT) FROM o_class_counts""",
)
def _(t):
    return _class_counts(t)


def _class_counts(t):
    primary = billing.primary_teacher(
        t.students, t.teachers, t.assignments, t.assignment_students, t.assignment_teachers, require_teacher=False
    )
    return records.class_counts(
        t.attendance, primary, identity.active_people(t.students), dt.date(2024, 1, 1), dt.date(2024, 1, 31),
        ("present", "ta"),
    )


@query(
    "q_student_month",
    "SELECT id, student_id, date, status, notes FROM attendance WHERE NOT is_deleted AND date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND student_id IN (SELECT id FROM students WHERE is_active)",
)
def _(t):
    ids = t.students.filter("is_active").select(F.col("id").alias("student_id"))
    rows = records.student_month(t.attendance, ids, YEAR, MONTH)
    return rows.select("id", "student_id", "date", "status", "notes")


@query(
    "q_student_summary",
    """SELECT student_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, count(*) FILTER (status = 'present') AS present_count, count(*) FILTER (status = 'absent') AS absent_count, count(*) AS total_records
FROM attendance_hist WHERE NOT is_deleted GROUP BY 1, 2, 3""",
)
def _(t):
    return records.student_summary(t.attendance_hist)


@query(
    "q_month_summary",
    """SELECT a.student_id, s.name, s.english_name, CAST(year(a.date) AS INT) AS year, CAST(month(a.date) AS INT) AS month, count(*) FILTER (a.status = 'present') AS present_count, count(*) FILTER (a.status = 'absent') AS absent_count
FROM attendance_hist a JOIN students s ON s.id = a.student_id WHERE NOT a.is_deleted GROUP BY 1, 2, 3, 4, 5""",
)
def _(t):
    return records.month_summary(t.attendance_hist, t.students)


@query(
    "q_month_totals",
    """SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, count(*) FILTER (status = 'present') AS present_count, count(*) FILTER (status = 'absent') AS absent_count, count(*) FILTER (status = 'ta') AS ta_count
FROM attendance_hist WHERE NOT is_deleted GROUP BY 1, 2""",
)
def _(t):
    return records.month_totals(t.attendance_hist, None)


@query(
    "q_row_tally",
    "SELECT r.id, r.subject, "
    + ", ".join(f"count(*) FILTER (k.status = '{s}') AS {s}_count" for s in STATUSES)
    + " FROM o_roster r LEFT JOIN o_cells k ON k.student_id = r.id AND k.subject IS NOT DISTINCT FROM r.subject GROUP BY r.id, r.subject",
)
def _(t):
    return records.row_tally(t.marked)


@query(
    "q_pct_marked",
    """SELECT r.id, r.subject, CASE WHEN x.marked - x.ta > 0 THEN CAST(floor(CAST(x.present AS DOUBLE) / (x.marked - x.ta) * 100 + 0.5) AS BIGINT) END AS pct FROM o_roster r
LEFT JOIN (SELECT id, subject, count(status) AS marked, count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'ta') AS ta FROM o_scheduled WHERE has_schedule GROUP BY id, subject) x
 ON x.id = r.id AND x.subject IS NOT DISTINCT FROM r.subject""",
)
def _(t):
    return records.pct_marked(t.marked, t.holidays, YEAR, MONTH)


@query(
    "q_scheduled_summary",
    "SELECT id, name, korean_name, subject, teacher_name, total_scheduled, present_count, absent_count, ta_count, noshow_count, percentage FROM o_summary",
)
def _(t):
    return records.scheduled_summary(t.marked, t.holidays, YEAR, MONTH)


@query(
    "q_scheduled_totals",
    """SELECT count(*) AS n_rows, CAST(sum(total_scheduled) AS BIGINT) AS total_scheduled, CAST(sum(present_count) AS BIGINT) AS present_count, CAST(sum(absent_count) AS BIGINT) AS absent_count, CAST(sum(ta_count) AS BIGINT) AS ta_count,
 CAST(sum(noshow_count) AS BIGINT) AS noshow_count, CAST(floor(CAST(sum(present_count) AS DOUBLE) / (sum(total_scheduled) - sum(ta_count)) * 100 + 0.5) AS BIGINT) AS percentage FROM o_summary""",
)
def _(t):
    return records.summary_totals(records.scheduled_summary(t.marked, t.holidays, YEAR, MONTH))


_GRID_DAYS = ", ".join(
    f"CASE WHEN EXISTS (SELECT 1 FROM holidays h WHERE h.date = DATE '2024-01-{d:02d}') THEN 'H' "
    f"ELSE coalesce(max(CASE WHEN day(k.date) = {d} THEN CASE k.status WHEN 'present' THEN 'P' WHEN 'absent' THEN 'A' WHEN 'ta' THEN 'TA' WHEN 'noshow' THEN 'N' END END), '') END AS d{d:02d}"
    for d in range(1, 32)
)
_GRID_SQL = f"""SELECT r.id, r.name, r.korean_name, r.subject, r.teacher_name, {_GRID_DAYS} FROM o_roster r
LEFT JOIN o_cells k ON k.student_id = r.id AND k.subject IS NOT DISTINCT FROM r.subject GROUP BY r.id, r.name, r.korean_name, r.subject, r.teacher_name"""


@query("q_month_grid", _GRID_SQL)
def _(t):
    return records.month_grid(t.marked, t.holidays, YEAR, MONTH)


@query(
    "q_bulk_candidates",
    """SELECT r.id AS student_id, r.subject FROM o_roster r WHERE list_contains(regexp_extract_all(r.mask, '(Su|Th|Sa|M|T|W|F)'), 'W')""",
)
def _(t):
    return roster.bulk_candidates(t.roster, dt.date(2024, 1, 17))


@query(
    "q_recent_deletes",
    """SELECT a.id, a.student_id, a.date, a.status, a.subject, strftime(a.deleted_at, '%Y-%m-%d %H:%M:%S') AS deleted_at, s.name AS student_name, s.korean_name
FROM attendance a LEFT JOIN students s ON s.id = a.student_id WHERE a.is_deleted AND a.deleted_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1440 MINUTE""",
)
def _(t):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return records.recent_deletes(t.attendance, t.students, as_of, 1440)


@query(
    "q_month_notes",
    "SELECT coalesce(m.canonical_id, n.student_id) AS student_id, n.notes, n.subject FROM student_notes n LEFT JOIN o_remap m ON m.old_id = n.student_id WHERE n.year = 2024 AND n.month = 1",
)
def _(t):
    return records.month_notes(t.student_notes, t.remap, YEAR, MONTH).drop("original_id")


# ---- schedules -----------------------------------------------------------------------------


@query(
    "q_teacher_by_date",
    """SELECT x.student_id, c.date, string_agg(DISTINCT t.name, ', ' ORDER BY t.name) AS teachers FROM assignments a JOIN assignment_students x ON x.assignment_id = a.id
JOIN assignment_teachers y ON y.assignment_id = a.id JOIN teachers t ON t.id = y.teacher_id JOIN o_calendar c ON c.weekday_name = a.date WHERE a.is_active GROUP BY x.student_id, c.date""",
)
def _(t):
    return schedule.teachers_by_date(
        *month_bounds(YEAR, MONTH), t.assignments, t.assignment_students, t.assignment_teachers,
        t.teachers,
    )


@query(
    "q_teacher_schedule",
    "SELECT teacher_name, date, start_time, end_time, student_id, name, korean_name, subject, attendance_status FROM o_schedule",
)
def _(t):
    return _schedule(t).drop("start_min")


@query(
    "q_schedule_tally",
    "SELECT teacher_name, date, start_time, end_time, grouping(start_time) = 1 AS is_total, "
    + ", ".join(f"count(*) FILTER (attendance_status = '{s}') AS {s}_count" for s in STATUSES)
    + ", count(*) FILTER (attendance_status IS NULL) AS unmarked_count, count(*) AS total_count"
    + " FROM o_schedule GROUP BY GROUPING SETS ((teacher_name, date, start_time, end_time), (teacher_name, date))",
)
def _(t):
    return schedule.schedule_tally(_schedule(t))


# ---- lists ---------------------------------------------------------------------------------


@query("q_holidays", "SELECT id, date, name FROM holidays")
def _(t):
    return t.holidays


@query("q_holidays_month", "SELECT id, date, name FROM holidays WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'")
def _(t):
    return directory.holidays_of_month(t.holidays, YEAR, MONTH)


@query("q_is_holiday", "SELECT DISTINCT date, date IN (SELECT date FROM holidays) AS is_holiday FROM attendance_log")
def _(t):
    return directory.are_holidays(t.attendance_log, t.holidays)


@query(
    "q_holidays_by_year",
    "SELECT CAST(year(date) AS INT) AS year, count(*) AS n_items, string_agg(strftime(date, '%Y-%m-%d') || ' ' || name, '; ' ORDER BY date) AS holidays FROM holidays GROUP BY 1",
)
def _(t):
    text = F.transform("holidays", lambda h: F.concat(F.date_format(h["date"], "yyyy-MM-dd"), F.lit(" "), h["name"]))
    return directory.holidays_by_year(t.holidays).select(
        "year", "n_items", F.array_join(text, "; ").alias("holidays")
    )


@query("q_teachers", "SELECT name, min(id) AS id FROM teachers WHERE is_active GROUP BY name")
def _(t):
    return directory.active_teachers(t.teachers)


@query(
    "q_teacher_filter_list",
    "SELECT teacher_name, count(*) AS n_rows FROM o_roster WHERE coalesce(teacher_name, '') <> '' GROUP BY teacher_name UNION ALL SELECT NULL, count(*) FROM o_roster",
)
def _(t):
    return roster.teacher_filter_list(t.roster)


@query("q_subjects", "SELECT DISTINCT subject FROM assignments WHERE subject IS NOT NULL AND subject <> ''")
def _(t):
    return directory.subjects(t.assignments)


@query(
    "q_hidden_rows",
    """SELECT h.student_id, s.name AS student_name, s.korean_name, s.english_name, h.subject, strftime(h.hidden_at, '%Y-%m-%d %H:%M:%S') AS hidden_at, h.hidden_from_year, h.hidden_from_month
FROM hidden_attendance_rows h LEFT JOIN students s ON s.id = h.student_id""",
)
def _(t):
    return directory.hidden_rows(t.hidden_attendance_rows, t.students)


@query(
    "q_is_hidden",
    "SELECT DISTINCT a.student_id, a.subject, EXISTS (SELECT 1 FROM hidden_attendance_rows h WHERE h.student_id = a.student_id AND h.subject IS NOT DISTINCT FROM a.subject) AS is_hidden FROM attendance a",
)
def _(t):
    return directory.are_hidden(t.attendance, t.hidden_attendance_rows)


# ---- money ---------------------------------------------------------------------------------


@query(
    "q_teacher_commission",
    "SELECT t.id AS teacher_id, CAST(coalesce(c.commission_per_class, 0) AS DOUBLE) AS commission_per_class, coalesce(c.currency, 'PHP') AS currency FROM teachers t LEFT JOIN teacher_commission c ON c.teacher_id = t.id",
)
def _(t):
    return billing.teacher_rates(t.teachers, t.teacher_commission)


@query(
    "q_teacher_payment",
    "SELECT t.id AS teacher_id, 2024 AS year, 1 AS month, coalesce(p.paid, FALSE) AS paid, p.payment_date, p.notes FROM teachers t LEFT JOIN teacher_payments p ON p.teacher_id = t.id AND p.year = 2024 AND p.month = 1",
)
def _(t):
    return billing.teacher_payment_state(t.teachers, t.teacher_payments, YEAR, MONTH)


def _primary(t):
    return billing.primary_teacher(
        t.students, t.teachers, t.assignments, t.assignment_students, t.assignment_teachers
    )


@query("q_primary_teacher", "SELECT student_id, teacher_id, teacher_name, n AS n_assignments FROM o_primary")
def _(t):
    return _primary(t)


def _commissions(t):
    return billing.commissions(
        _primary(t), t.students, t.teacher_student_commission, t.teacher_student_payments, t.attendance, YEAR, MONTH
    )


@query("q_commissions", "SELECT * FROM o_commissions")
def _(t):
    return _commissions(t)


@query("q_commission_summary", _currency_sql("o_commissions", "total_commission", "class_count"))
def _(t):
    return billing.commission_summary(_commissions(t))


def _tuition(t):
    return billing.tuition(
        t.roster_all, t.student_subject_tuition, t.subject_tuition_payments, t.attendance, YEAR, MONTH, tasks=t.tasks
    )


@query("q_tuition", "SELECT * FROM o_tuition")
def _(t):
    return _tuition(t)


@query("q_tuition_summary", _currency_sql("o_tuition", "total_tuition", "present_count"))
def _(t):
    return billing.tuition_summary(_tuition(t))


@query(
    "q_tuition_summary_per_row",
    _currency_sql(
        "(SELECT q.subject, o.currency, o.total_tuition, o.present_count, o.paid FROM o_tuition_rows q JOIN o_tuition o ON o.student_id = q.student_id AND o.subject = q.subject) z",
        "total_tuition", "present_count",
    ),
)
def _(t):
    return billing.tuition_summary(_tuition(t), fanout=True)


@query(
    "q_multi_subject_students",
    "SELECT student_id, subject FROM o_tuition WHERE student_id IN (SELECT student_id FROM o_tuition GROUP BY student_id HAVING count(*) > 1)",
)
def _(t):
    return billing.multi_subject_students(_tuition(t)).select("student_id", "subject")


@query(
    "q_bulk_set_count",
    """SELECT count(*) AS n_entries FROM (SELECT DISTINCT student_id, nullif(subject, '') AS subject FROM bulk_entries) e""",
)
def _(t):
    return clean_entries(t.bulk_entries).agg(F.count(F.lit(1)).alias("n_entries"))
