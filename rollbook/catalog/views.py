"""The analytics tables, derived from the given ones.

``TABLES`` holds one SQL text per table that Spark and DuckDB both run; only
``attendance`` is made by the compaction operator in Spark. ``CHECKS`` holds
further views that only the DuckDB statements use.
"""

from __future__ import annotations

import re

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TABLES: dict[str, str] = {
    "students": """
SELECT CAST(c_custkey AS INT) AS id,
 CASE WHEN CAST(floor(c_custkey / 2) AS INT) % 5 = 0 THEN NULL ELSE 'np-' || CAST(CAST(floor(c_custkey / 3) AS INT) AS VARCHAR(20)) END AS notion_page_id,
 CASE WHEN c_custkey % 2 = 0 THEN 'Student ' || CAST(c_custkey AS VARCHAR(20)) ELSE 'STUDENT ' || CAST(c_custkey - 1 AS VARCHAR(20)) END AS name,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'K' || CAST(CAST(floor(c_custkey / 4) AS INT) AS VARCHAR(20)) END AS korean_name,
 c_name AS english_name, c_mktsegment AS color_keyword, 'S' || CAST(c_custkey AS VARCHAR(20)) AS student_id,
 c_acctbal >= 0 AS is_active,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '2023-01-01' + CAST(c_custkey % 300 AS INT) END AS first_start_date
FROM customer""",
    "teachers": """
SELECT CAST(s_suppkey AS INT) AS id, 'Teacher ' || CAST(CAST(floor(s_suppkey / 2) AS INT) AS VARCHAR(20)) AS name, s_acctbal >= 0 AS is_active FROM supplier""",
    "time_slots": """
SELECT DISTINCT CAST(o_orderkey % 12 AS INT) AS id, CAST(540 + 30 * (o_orderkey % 12) AS INT) AS start_min, CAST(570 + 30 * (o_orderkey % 12) AS INT) AS end_min FROM orders""",
    "assignments": """
SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' ELSE 'Saturday' END AS date,
 CASE (o_custkey + CAST(floor(o_orderkey / 12) AS INT) % 2) % 6 WHEN 0 THEN 'English' WHEN 1 THEN 'Math' WHEN 2 THEN 'Science' WHEN 3 THEN 'Korean' WHEN 4 THEN 'Art' ELSE NULL END AS subject, CAST(o_orderkey % 12 AS INT) AS time_slot_id, o_orderstatus <> 'F' AS is_active FROM orders""",
    "assignment_students": """
SELECT o_orderkey AS assignment_id, CAST(o_custkey AS INT) AS student_id FROM orders""",
    "assignment_teachers": """
SELECT DISTINCT l_orderkey AS assignment_id, CAST(l_suppkey AS INT) AS teacher_id FROM lineitem""",
    "attendance_log": """
SELECT event_id AS id, CAST(user_id AS INT) AS student_id, CAST(ts AS DATE) AS date,
 CASE CAST(substr(props, 7, length(props) - 7) AS INT) % 6 WHEN 0 THEN 'English' WHEN 1 THEN 'Math' WHEN 2 THEN 'Science' WHEN 3 THEN 'Korean' WHEN 4 THEN 'Art' ELSE NULL END AS subject,
 CASE event_type WHEN 'error' THEN 'absent' WHEN 'purchase' THEN 'ta' WHEN 'signup' THEN 'noshow' ELSE 'present' END AS status,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'note ' || CAST(event_id AS VARCHAR(20)) END AS notes,
 value > 60 AS is_delete, ts AS updated_at FROM events""",
    "attendance": """
SELECT id, student_id, date, subject, status, notes, is_delete AS is_deleted, CASE WHEN is_delete THEN updated_at END AS deleted_at, updated_at FROM (
 SELECT *, row_number() OVER (PARTITION BY student_id, date, subject ORDER BY updated_at DESC, id DESC) AS rn FROM attendance_log) t WHERE rn = 1""",
    "attendance_hist": """
SELECT CAST(o_custkey AS INT) AS student_id, CAST(l_shipdate AS DATE) AS date, o_orderpriority AS subject,
 CASE WHEN l_returnflag = 'N' THEN 'present' WHEN l_returnflag = 'R' AND l_linestatus='F' THEN 'present' WHEN l_returnflag = 'R' THEN 'absent' WHEN l_linestatus = 'O' THEN 'ta' ELSE 'noshow' END AS status, l_quantity > 48 AS is_deleted FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "holidays": """
SELECT DISTINCT CAST(year(CAST(ts AS DATE)) * 10000 + month(CAST(ts AS DATE)) * 100 + day(CAST(ts AS DATE)) AS INT) AS id, CAST(ts AS DATE) AS date, 'Holiday ' || CAST(day(CAST(ts AS DATE)) AS VARCHAR(20)) AS name FROM events WHERE day(CAST(ts AS DATE)) % 10 = 5""",
    "student_notes": """
SELECT CAST(doc_id AS INT) AS student_id, CAST(2024 AS INT) AS year, CAST(doc_id % 12 + 1 AS INT) AS month, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Math' END AS subject, text AS notes FROM documents""",
    # one subject per part, and a second one for every third
    "student_subject_tuition": """
SELECT CAST(p_partkey AS INT) AS student_id,
 CASE p_type WHEN 'MEDIUM' THEN 'Math' WHEN 'LARGE' THEN 'English' WHEN 'SMALL' THEN 'Science' WHEN 'PROMO' THEN 'Korean' WHEN 'ECONOMY' THEN 'Art' ELSE 'Music' END AS subject,
 CAST(p_retailprice AS DECIMAL(10,2)) AS price_per_class, CASE WHEN p_size % 2 = 0 THEN 'PHP' ELSE 'KRW' END AS currency FROM part
UNION ALL SELECT CAST(p_partkey AS INT), 'Drama', CAST(floor(p_retailprice / 3) AS DECIMAL(10,2)), CASE WHEN p_size % 3 = 0 THEN 'PHP' ELSE 'KRW' END FROM part WHERE p_partkey % 3 = 0""",
    "subject_tuition_payments": """
SELECT student_id, subject, CAST(2024 AS INT) AS year, CAST(1 AS INT) AS month, student_id % 3 = 0 AS paid, CASE WHEN student_id % 3 = 0 THEN DATE '2024-01-31' ELSE NULL END AS payment_date, CASE WHEN student_id % 4 = 0 THEN '' ELSE 'by ' || subject END AS notes FROM student_subject_tuition WHERE student_id % 2 = 0 OR student_id % 3 = 0""",
    "teacher_student_commission": """
SELECT CAST(l_suppkey AS INT) AS teacher_id, CAST(o_custkey AS INT) AS student_id, CAST(min(l_quantity) AS DECIMAL(10,2)) AS commission_per_class, CASE WHEN min(l_linenumber) % 2 = 0 THEN 'KRW' ELSE 'PHP' END AS currency FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "teacher_student_payments": """
SELECT teacher_id, student_id, CAST(2024 AS INT) AS year, CAST(1 AS INT) AS month, student_id % 2 = 0 AS paid, CASE WHEN student_id % 2 = 0 THEN DATE '2024-01-31' ELSE NULL END AS payment_date, CASE WHEN student_id % 5 = 0 THEN 'late' ELSE NULL END AS notes FROM teacher_student_commission WHERE teacher_id % 2 = 0""",
    "teacher_commission": """
SELECT teacher_id, min(commission_per_class) AS commission_per_class, min(currency) AS currency FROM teacher_student_commission WHERE student_id > teacher_id GROUP BY teacher_id""",
    "teacher_payments": """
SELECT teacher_id, year, month, min(CASE WHEN paid THEN 1 ELSE 0 END) = 1 AS paid, min(payment_date) AS payment_date, min(notes) AS notes FROM teacher_student_payments GROUP BY teacher_id, year, month""",
    "hidden_attendance_rows": """
SELECT CAST(c_custkey AS INT) AS student_id, CASE c_custkey % 6 WHEN 0 THEN 'English' WHEN 1 THEN 'Math' WHEN 2 THEN 'Science' WHEN 3 THEN 'Korean' WHEN 4 THEN 'Art' ELSE NULL END AS subject,
 CAST(CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 2024 END AS INT) AS hidden_from_year, CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE CAST(c_custkey % 3 + 1 AS INT) END AS hidden_from_month,
 CAST(DATE '2023-11-01' + CAST(c_custkey % 90 AS INT) AS TIMESTAMP) AS hidden_at FROM customer WHERE c_custkey % 10 = 0""",
    # names as people type them, with the Korean name in brackets
    "full_names": """
SELECT id, CASE WHEN korean_name IS NULL THEN name || ' ' ELSE name || ' (' || english_name || ') [' || korean_name || ']' END AS full_name FROM students""",
    # rows as they arrive, before any check
    "incoming": """
SELECT event_id AS id, CAST(user_id AS INT) AS student_id, CASE WHEN value > 200 THEN NULL ELSE CAST(ts AS DATE) END AS date,
 CASE WHEN user_id % 4 = 0 THEN '' ELSE event_type END AS subject,
 CASE WHEN value < 5 THEN '' WHEN value < 10 THEN NULL WHEN event_type = 'view' THEN 'present' WHEN event_type = 'error' THEN 'absent' WHEN event_type = 'purchase' THEN 'ta' WHEN event_type = 'signup' THEN 'noshow' ELSE event_type END AS status,
 CASE WHEN user_id % 3 = 0 THEN 'PHP' WHEN user_id % 3 = 1 THEN 'KRW' ELSE 'USD' END AS currency,
 CAST(day(CAST(ts AS DATE)) % 14 AS INT) AS month FROM events""",
    "bulk_entries": """
SELECT student_id, coalesce(subject, '') AS subject FROM attendance_log""",
    # writes that come after the log: half to the same day, half to the next
    "change_log": """
SELECT id AS seq, student_id, date + CAST(id % 2 AS INT) AS date, coalesce(subject, '') AS subject, status, 'new ' || CAST(id AS VARCHAR(20)) AS notes, updated_at + INTERVAL 31 DAY AS changed_at FROM attendance_log""",
    "rate_changes": """
SELECT p_partkey AS seq, CAST(floor(p_partkey / 2) AS INT) AS student_id,
 CASE p_type WHEN 'MEDIUM' THEN 'Math' WHEN 'LARGE' THEN 'English' ELSE 'Drama' END AS subject,
 CAST(floor(p_retailprice / 2) AS DECIMAL(10,2)) AS price_per_class, CASE p_size % 3 WHEN 0 THEN 'PHP' WHEN 1 THEN 'KRW' ELSE 'USD' END AS currency,
 CAST(DATE '2024-02-01' + CAST(p_size % 20 AS INT) AS TIMESTAMP) AS changed_at FROM part""",
    "sparse_rates": """
SELECT student_id, subject, CASE WHEN student_id % 4 = 0 THEN NULL ELSE price_per_class END AS price_per_class, CASE WHEN student_id % 5 = 0 THEN NULL ELSE currency END AS currency FROM student_subject_tuition""",
}

_DOW = (
    "CASE a.date WHEN 'Sunday' THEN 0 WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3 "
    "WHEN 'Thursday' THEN 4 WHEN 'Friday' THEN 5 WHEN 'Saturday' THEN 6 END"
)
_DAY_TEXT = (
    "array_to_string(list_transform(list_sort(list(DISTINCT {dow})), "
    "lambda x: ['Su','M','T','W','Th','F','Sa'][x + 1]), '')"
)


def clock(minutes: str) -> str:
    """12-hour text of minutes of the day, in SQL."""
    return (
        f"(lpad(CAST((CAST(floor({minutes} / 60) AS INT) + 11) % 12 + 1 AS VARCHAR), 2, '0') || ':' || "
        f"lpad(CAST({minutes} % 60 AS VARCHAR), 2, '0') || CASE WHEN {minutes} < 720 THEN ' AM' ELSE ' PM' END)"
    )


_JAN = "date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"


def _roster(hidden: str) -> str:
    return f"""
SELECT r.student_id AS id, i.external_id, i.name, i.korean_name, i.english_name, i.color_keyword, r.teacher_name,
 s.schedule_time, s.schedule_days, s.schedules, coalesce(s.mask, '') AS mask, coalesce(s.n_schedules, 0) AS n_schedules, r.subject,
 CAST(r.student_id AS VARCHAR) || '-' || coalesce(r.subject, 'default') AS row_key
FROM (SELECT student_id, subject, teacher_name FROM o_rows
      UNION ALL
      SELECT DISTINCT u.student_id, u.subject, NULL FROM student_subject_tuition u
      WHERE u.student_id IN (SELECT student_id FROM o_rows)
        AND NOT EXISTS (SELECT 1 FROM o_rows x WHERE x.student_id = u.student_id AND x.subject = u.subject)) r
JOIN o_info i ON i.student_id = r.student_id
LEFT JOIN o_schedules s ON s.student_id = r.student_id AND s.subject IS NOT DISTINCT FROM r.subject
WHERE NOT EXISTS (SELECT 1 FROM hidden_attendance_rows h WHERE h.student_id = r.student_id
   AND h.subject IS NOT DISTINCT FROM r.subject AND ({hidden}))"""


CHECKS: dict[str, str] = {
    "o_identity": """
SELECT id, coalesce(notion_page_id, lower(name) || '::' || coalesce(korean_name, '')) AS identity_key FROM students""",
    "o_canonical": """
SELECT identity_key, id AS canonical_id FROM (
 SELECT s.id, k.identity_key, row_number() OVER (PARTITION BY k.identity_key ORDER BY CASE WHEN c.student_id IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN s.is_active THEN 0 ELSE 1 END, s.id) AS rn
 FROM students s JOIN o_identity k ON k.id = s.id
 LEFT JOIN (SELECT DISTINCT x.student_id FROM assignment_students x JOIN assignments a ON a.id = x.assignment_id AND a.is_active) c ON c.student_id = s.id) t WHERE rn = 1""",
    "o_remap": """
SELECT k.id AS old_id, c.canonical_id FROM o_identity k JOIN o_canonical c ON c.identity_key = k.identity_key WHERE k.id <> c.canonical_id""",
    "o_person": """
SELECT id, min(id) OVER (PARTITION BY identity_key) AS person_id FROM o_identity""",
    "o_records": f"""
SELECT a.id, coalesce(m.canonical_id, a.student_id) AS student_id, a.student_id AS original_id, a.date, a.status, a.notes, a.subject
FROM attendance a LEFT JOIN o_remap m ON m.old_id = a.student_id WHERE a.{_JAN} AND NOT a.is_deleted""",
    "o_cells": """
SELECT student_id, subject, date, status FROM (
 SELECT *, row_number() OVER (PARTITION BY student_id, subject, date ORDER BY original_id DESC, id DESC) AS rn FROM o_records) t WHERE rn = 1""",
    "o_slots": f"""
SELECT min(s.id) AS student_id, max(s.student_id) AS external_id, s.name, s.korean_name, max(s.english_name) AS english_name, max(s.color_keyword) AS color_keyword,
 a.subject, t.name AS teacher_name, min(r.ref) AS teacher_ref, ts.start_min, ts.end_min, {_DAY_TEXT.format(dow=_DOW)} AS days
FROM assignment_students x JOIN students s ON s.id = x.student_id JOIN assignments a ON a.id = x.assignment_id
JOIN time_slots ts ON ts.id = a.time_slot_id LEFT JOIN assignment_teachers y ON y.assignment_id = a.id LEFT JOIN teachers t ON t.id = y.teacher_id
LEFT JOIN (SELECT name, min(id) AS ref FROM teachers GROUP BY name) r ON r.name = t.name
WHERE a.is_active AND s.is_active GROUP BY s.name, s.korean_name, a.subject, t.name, ts.start_min, ts.end_min""",
    "o_rows": """
SELECT student_id, subject, teacher_name FROM (
 SELECT *, row_number() OVER (PARTITION BY student_id, subject ORDER BY start_min, end_min, teacher_ref NULLS LAST) AS rn FROM o_slots) t WHERE rn = 1""",
    "o_info": """
SELECT student_id, external_id, name, korean_name, english_name, color_keyword FROM (
 SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY subject NULLS LAST, start_min, end_min, teacher_ref NULLS LAST) AS rn FROM o_slots) t WHERE rn = 1""",
    "o_merged": """
SELECT student_id, subject, days, min(start_min) AS start_min, arg_max(end_min, seq) AS end_min FROM (
 SELECT *, sum(CASE WHEN prev_end = start_min THEN 0 ELSE 1 END) OVER (PARTITION BY student_id, subject, days ORDER BY seq) AS island FROM (
  SELECT *, lag(end_min) OVER w AS prev_end, row_number() OVER w AS seq FROM o_slots
  WINDOW w AS (PARTITION BY student_id, subject, days ORDER BY start_min, end_min, teacher_ref NULLS LAST)) p) q
GROUP BY student_id, subject, days, island""",
    "o_schedules": f"""
SELECT student_id, subject, count(*) AS n_schedules,
 string_agg(days || ' ' || {clock('start_min')} || ' - ' || {clock('end_min')}, '; ' ORDER BY lower(days), start_min, end_min) AS schedules,
 string_agg(days, ',' ORDER BY days) AS mask,
 arg_min({clock('start_min')} || ' - ' || {clock('end_min')}, lower(days) || '/' || lpad(CAST(start_min AS VARCHAR), 4, '0') || '/' || lpad(CAST(end_min AS VARCHAR), 4, '0')) AS schedule_time,
 arg_min(days, lower(days)) AS schedule_days
FROM o_merged GROUP BY student_id, subject""",
    "o_roster": _roster(
        "(h.hidden_from_year IS NULL AND h.hidden_from_month IS NULL) OR h.hidden_from_year * 12 + h.hidden_from_month <= 2024 * 12 + 1"
    ),
    "o_roster_all": _roster("TRUE"),
    # scheduled days of a roster row over the calendar of January 2024, holidays removed
    "o_calendar": """
SELECT CAST(d AS DATE) AS date, CAST(dayofweek(d) AS INT) AS dow, CAST(day(d) AS INT) AS day, dayname(d) AS weekday_name
FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) g(d)""",
    "o_dow": """
SELECT r.id, r.subject, c.dow, r.mask <> '' AS has_schedule FROM o_roster r JOIN (SELECT DISTINCT dow FROM o_calendar) c
 ON CASE WHEN r.mask = '' THEN c.dow BETWEEN 1 AND 5
    ELSE list_contains(regexp_extract_all(r.mask, '(Su|Th|Sa|M|T|W|F)'), ['Su','M','T','W','Th','F','Sa'][c.dow + 1]) END""",
    "o_scheduled": """
SELECT s.id, s.subject, s.has_schedule, c.date, k.status FROM o_dow s JOIN o_calendar c ON c.dow = s.dow
LEFT JOIN o_cells k ON k.student_id = s.id AND k.subject IS NOT DISTINCT FROM s.subject AND k.date = c.date
WHERE c.date NOT IN (SELECT date FROM holidays)""",
    "o_summary": """
SELECT r.id, r.name, r.korean_name, r.subject, r.teacher_name, coalesce(x.total_scheduled, 0) AS total_scheduled, coalesce(x.present_count, 0) AS present_count,
 coalesce(x.absent_count, 0) AS absent_count, coalesce(x.ta_count, 0) AS ta_count, coalesce(x.noshow_count, 0) AS noshow_count,
 CASE WHEN x.total_scheduled - x.ta_count > 0 THEN CAST(floor(CAST(x.present_count AS DOUBLE) / (x.total_scheduled - x.ta_count) * 100 + 0.5) AS BIGINT) END AS percentage
FROM o_roster r LEFT JOIN (SELECT id, subject, count(*) AS total_scheduled, count(*) FILTER (status = 'present') AS present_count, count(*) FILTER (status = 'absent') AS absent_count,
  count(*) FILTER (status = 'ta') AS ta_count, count(*) FILTER (status = 'noshow') AS noshow_count FROM o_scheduled GROUP BY id, subject) x
 ON x.id = r.id AND x.subject IS NOT DISTINCT FROM r.subject""",
    "o_primary": """
SELECT student_id, teacher_id, teacher_name, n FROM (
 SELECT x.student_id, t.id AS teacher_id, t.name AS teacher_name, count(*) AS n, row_number() OVER (PARTITION BY x.student_id ORDER BY count(*) DESC, t.id) AS rn
 FROM assignment_students x JOIN assignments a ON a.id = x.assignment_id JOIN assignment_teachers y ON y.assignment_id = a.id
 JOIN students s ON s.id = x.student_id JOIN teachers t ON t.id = y.teacher_id WHERE a.is_active AND s.is_active GROUP BY x.student_id, t.id, t.name) p WHERE rn = 1""",
    "o_primary_left": """
SELECT student_id, teacher_id, teacher_name, n FROM (
 SELECT x.student_id, t.id AS teacher_id, t.name AS teacher_name, count(*) AS n, row_number() OVER (PARTITION BY x.student_id ORDER BY count(*) DESC, t.id NULLS LAST) AS rn
 FROM assignment_students x JOIN assignments a ON a.id = x.assignment_id JOIN students s ON s.id = x.student_id
 LEFT JOIN assignment_teachers y ON y.assignment_id = a.id LEFT JOIN teachers t ON t.id = y.teacher_id WHERE a.is_active AND s.is_active GROUP BY x.student_id, t.id, t.name) p WHERE rn = 1""",
    "o_people": """
SELECT id, name, korean_name, english_name, identity_key FROM (
 SELECT s.id, s.name, s.korean_name, s.english_name, k.identity_key, row_number() OVER (PARTITION BY k.identity_key ORDER BY CASE WHEN s.first_start_date IS NOT NULL THEN 0 ELSE 1 END, s.id) AS rn
 FROM students s JOIN o_identity k ON k.id = s.id WHERE s.is_active) t WHERE rn = 1""",
    "o_present": f"""
SELECT student_id, count(*) AS n FROM attendance WHERE {_JAN} AND status = 'present' AND NOT is_deleted GROUP BY student_id""",
    "o_commissions": """
SELECT CAST(p.teacher_id AS VARCHAR) || '-' || CAST(p.student_id AS VARCHAR) AS id, p.student_id, s.name AS student_name, s.korean_name, s.english_name, p.teacher_id, p.teacher_name,
 CAST(coalesce(c.commission_per_class, 0) AS DOUBLE) AS commission_per_class, coalesce(c.currency, 'PHP') AS currency, coalesce(n.n, 0) AS class_count,
 CAST(coalesce(c.commission_per_class, 0) AS DOUBLE) * coalesce(n.n, 0) AS total_commission, coalesce(y.paid, FALSE) AS paid, y.payment_date, nullif(y.notes, '') AS payment_notes
FROM o_primary p JOIN students s ON s.id = p.student_id
LEFT JOIN teacher_student_commission c ON c.teacher_id = p.teacher_id AND c.student_id = p.student_id
LEFT JOIN teacher_student_payments y ON y.teacher_id = p.teacher_id AND y.student_id = p.student_id AND y.year = 2024 AND y.month = 1
LEFT JOIN o_present n ON n.student_id = p.student_id""",
    # one row per roster row and subject, as the per-row report lists them
    "o_tuition_rows": """
SELECT r.id AS student_id, r.subject AS row_subject, r.teacher_name, u.subject FROM o_roster_all r JOIN student_subject_tuition u ON u.student_id = r.id
UNION ALL
SELECT r.id, r.subject, r.teacher_name, coalesce(r.subject, '(No Subject)') FROM o_roster_all r
WHERE CASE WHEN r.subject IS NULL THEN r.id NOT IN (SELECT student_id FROM student_subject_tuition)
      ELSE NOT EXISTS (SELECT 1 FROM student_subject_tuition u WHERE u.student_id = r.id AND u.subject = r.subject) END""",
    "o_tuition": """
SELECT CAST(q.student_id AS VARCHAR) || '-' || q.subject AS id, q.student_id, i.name, i.korean_name, i.english_name, q.teacher_name, q.subject,
 CAST(coalesce(u.price_per_class, 0) AS DOUBLE) AS price_per_class, coalesce(u.currency, 'PHP') AS currency, coalesce(n.n, 0) AS present_count,
 CAST(coalesce(u.price_per_class, 0) AS DOUBLE) * coalesce(n.n, 0) AS total_tuition, coalesce(y.paid, FALSE) AS paid, y.payment_date, nullif(y.notes, '') AS payment_notes, q.copies
FROM (SELECT *, count(*) OVER (PARTITION BY student_id, subject) AS copies,
   row_number() OVER (PARTITION BY student_id, subject ORDER BY CASE WHEN subject IS NOT DISTINCT FROM row_subject THEN 0 ELSE 1 END, coalesce(row_subject, '')) AS rn FROM o_tuition_rows) q
JOIN o_info i ON i.student_id = q.student_id
LEFT JOIN student_subject_tuition u ON u.student_id = q.student_id AND u.subject = q.subject
LEFT JOIN subject_tuition_payments y ON y.student_id = q.student_id AND y.subject = q.subject AND y.year = 2024 AND y.month = 1
LEFT JOIN o_present n ON n.student_id = q.student_id WHERE q.rn = 1""",
    "o_schedule": f"""
SELECT t.name AS teacher_name, c.date, {clock('ts.start_min')} AS start_time, {clock('ts.end_min')} AS end_time, s.id AS student_id, s.name, s.korean_name, a.subject, k.status AS attendance_status
FROM assignment_students x JOIN students s ON s.id = x.student_id JOIN assignments a ON a.id = x.assignment_id JOIN time_slots ts ON ts.id = a.time_slot_id
JOIN assignment_teachers y ON y.assignment_id = a.id JOIN teachers t ON t.id = y.teacher_id JOIN o_calendar c ON c.weekday_name = a.date
LEFT JOIN attendance k ON k.student_id = s.id AND k.date = c.date AND k.subject = a.subject AND NOT k.is_deleted WHERE a.is_active""",
    "o_class_counts": """
SELECT l.teacher_id, coalesce(l.teacher_name, 'Unknown Teacher') AS teacher_name, n.student_id, coalesce(trim(regexp_replace(p.name, '\\s*\\[[^\\]]+\\]\\s*$', '')), 'Student ' || CAST(n.student_id AS VARCHAR)) AS student_name, p.korean_name, n.subject, n.class_count
FROM (SELECT student_id, subject, count(*) AS class_count FROM attendance WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND status IN ('present', 'ta') AND NOT is_deleted GROUP BY student_id, subject) n
LEFT JOIN o_primary_left l ON l.student_id = n.student_id LEFT JOIN o_people p ON p.id = n.student_id""",
}


def _needs(sql: str, known: dict[str, str]) -> list[str]:
    words = set(re.findall(r"[A-Za-z_]+", sql))
    return [name for name in known if name in words]


def order_of(sql: str, known: dict[str, str]) -> list[str]:
    """The views a statement needs, each after those it is made of."""
    placed: list[str] = []

    def place(name: str) -> None:
        if name in placed:
            return
        for other in _needs(known[name], known):
            if other != name:
                place(other)
        placed.append(name)

    for name in _needs(sql, known):
        place(name)
    return placed


def as_statement(sql: str) -> str:
    """The SQL with every view it needs in front."""
    known = {**TABLES, **CHECKS}
    views = order_of(sql, known)
    if not views:
        return sql.strip()
    return "WITH " + ",\n".join(f"{v} AS ({known[v].strip()})" for v in views) + "\n" + sql.strip()
