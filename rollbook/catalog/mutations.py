"""Change batches applied to tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rollbook.catalog.registry import query
from rollbook.operators import changes
from rollbook.schema import KEYS
from rollbook.session import run_dir
from rollbook.sinks.writers import write_counted
from rollbook.sources.readers import clean_entries

_CELL = ["student_id", "date", "subject"]
_OUT = ["id", *_CELL, "status", "notes", "is_deleted", "deleted_at", "updated_at"]
_TEXT = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {1}"


def _ts(column: str, name: str | None = None) -> str:
    return _TEXT.format(column, name or column)


# the last change per key, in SQL
_LAST = """(SELECT * FROM (SELECT seq, student_id, date, nullif(subject, '') AS subject, status, notes, changed_at,
 row_number() OVER (PARTITION BY student_id, date, nullif(subject, '') ORDER BY changed_at DESC, seq DESC) AS rn FROM change_log) x WHERE rn = 1)"""


def _set_sql(notes: str) -> str:
    return f"""SELECT coalesce(a.id, (SELECT max(id) FROM attendance) + c.seq) AS id, c.student_id, c.date, c.subject, c.status, {notes} AS notes, FALSE AS is_deleted, CAST(NULL AS VARCHAR) AS deleted_at, {_ts('c.changed_at', 'updated_at')}
FROM {_LAST} c LEFT JOIN attendance a ON a.student_id = c.student_id AND a.date = c.date AND a.subject IS NOT DISTINCT FROM c.subject
UNION ALL SELECT a.id, a.student_id, a.date, a.subject, a.status, a.notes, a.is_deleted, {_ts('a.deleted_at', 'deleted_at')}, {_ts('a.updated_at', 'updated_at')} FROM attendance a
WHERE NOT EXISTS (SELECT 1 FROM change_log c WHERE c.student_id = a.student_id AND c.date = a.date AND nullif(c.subject, '') IS NOT DISTINCT FROM a.subject)"""


@query("m_set", _set_sql("c.notes"))
def _(t):
    return changes.set_records(t.attendance, t.change_log).select(*_OUT)


@query("m_bulk_set", _set_sql("a.notes"))
def _(t):
    return changes.bulk_set_records(t.attendance, t.change_log).select(*_OUT)


@query(
    "m_set_distinct_nulls",
    """SELECT student_id, date, subject, CAST(NULL AS VARCHAR) AS own_status FROM attendance WHERE subject IS NOT NULL
UNION SELECT student_id, date, subject, NULL FROM change_log WHERE subject <> ''
UNION ALL SELECT student_id, date, NULL, status FROM attendance WHERE subject IS NULL
UNION ALL SELECT student_id, date, NULL, status FROM change_log WHERE subject = ''""",
)
def _(t):
    state = changes.set_records(t.attendance, t.change_log, null_subject_mode="distinct")
    own = F.when(F.col("subject").isNull(), F.col("status")).alias("own_status")
    return state.select("student_id", "date", "subject", own)


_STEP = """(SELECT p.person_id AS owner, c.date, nullif(c.subject, '') AS subject, count(*) AS n, max(c.changed_at) AS last_at, arg_max(c.student_id, (c.changed_at, c.seq)) AS home, arg_max(c.seq, (c.changed_at, c.seq)) AS last_seq
 FROM change_log c JOIN o_person p ON p.id = c.student_id GROUP BY 1, 2, 3)"""
_CURRENT = """(SELECT * FROM (SELECT p.person_id AS owner, a.*, row_number() OVER (PARTITION BY p.person_id, a.date, a.subject ORDER BY a.student_id DESC, a.id DESC) AS rn
 FROM attendance a JOIN o_person p ON p.id = a.student_id WHERE NOT a.is_deleted) x WHERE rn = 1)"""
_TOGGLED = f"""(SELECT s.*, k.id AS cur_id, k.notes AS cur_notes, coalesce(list_position(['present', 'absent', 'ta', 'noshow'], k.status), 0) + s.n AS total
 FROM {_STEP} s LEFT JOIN {_CURRENT} k ON k.owner = s.owner AND k.date = s.date AND k.subject IS NOT DISTINCT FROM s.subject)"""


@query(
    "m_toggle",
    f"""SELECT coalesce(cur_id, (SELECT max(id) FROM attendance) + last_seq) AS id, home AS student_id, date, subject, ['noshow', 'present', 'absent', 'ta', 'noshow'][total % 5 + 1] AS status, CASE WHEN n = 1 AND total % 5 = 0 THEN cur_notes END AS notes, total % 5 = 0 AS is_deleted,
 CASE WHEN total % 5 = 0 THEN strftime(last_at, '%Y-%m-%d %H:%M:%S') END AS deleted_at, {_ts('last_at', 'updated_at')} FROM {_TOGGLED} g
UNION ALL SELECT a.id, a.student_id, a.date, a.subject, a.status, a.notes, a.is_deleted OR coalesce(g.total > 4, FALSE), {_ts('CASE WHEN NOT a.is_deleted AND g.total > 4 THEN g.last_at ELSE a.deleted_at END', 'deleted_at')}, {_ts('a.updated_at', 'updated_at')}
FROM attendance a JOIN o_person p ON p.id = a.student_id LEFT JOIN {_TOGGLED} g ON g.owner = p.person_id AND g.date = a.date AND g.subject IS NOT DISTINCT FROM a.subject
WHERE g.owner IS NULL OR (a.student_id <> g.home AND a.id IS DISTINCT FROM g.cur_id)""",
)
def _(t):
    return changes.toggle_records(t.attendance, t.change_log, t.persons).select(*_OUT)


_ASKED = """(SELECT p.person_id AS owner, c.date, nullif(c.subject, '') AS subject, min(c.changed_at) AS at FROM change_log c JOIN o_person p ON p.id = c.student_id GROUP BY 1, 2, 3)"""


@query(
    "m_soft_delete",
    f"""SELECT a.id, a.student_id, a.date, a.subject, a.is_deleted OR g.at IS NOT NULL AS is_deleted, {_ts('CASE WHEN NOT a.is_deleted AND g.at IS NOT NULL THEN g.at ELSE a.deleted_at END', 'deleted_at')}
FROM attendance a JOIN o_person p ON p.id = a.student_id LEFT JOIN {_ASKED} g ON g.owner = p.person_id AND g.date = a.date AND g.subject IS NOT DISTINCT FROM a.subject""",
)
def _(t):
    state = changes.soft_delete(t.attendance, t.change_log, t.persons)
    return state.select("id", *_CELL, "is_deleted", "deleted_at")


@query(
    "m_undo_delete",
    f"""SELECT a.id, a.student_id, a.date, a.subject, a.is_deleted AND g.at IS NULL AS is_deleted, {_ts('CASE WHEN a.is_deleted AND g.at IS NOT NULL THEN NULL ELSE a.deleted_at END', 'deleted_at')}
FROM attendance a JOIN o_person p ON p.id = a.student_id LEFT JOIN {_ASKED} g ON g.owner = p.person_id AND g.date = a.date AND g.subject IS NOT DISTINCT FROM a.subject""",
)
def _(t):
    state = changes.undo_delete(t.attendance, t.change_log, t.persons)
    return state.select("id", *_CELL, "is_deleted", "deleted_at")


_HIT = "EXISTS (SELECT 1 FROM bulk_entries e WHERE e.student_id = a.student_id AND nullif(e.subject, '') IS NOT DISTINCT FROM a.subject) AND a.date = DATE '2024-01-10'"
_DAY = dt.date(2024, 1, 10)


def _at():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


@query(
    "m_bulk_delete",
    f"SELECT a.id, a.student_id, a.date, a.subject, a.is_deleted OR ({_HIT}) AS is_deleted, {_ts(f'CASE WHEN NOT a.is_deleted AND {_HIT} THEN TIMESTAMP {chr(39)}2024-02-01 00:00:00{chr(39)} ELSE a.deleted_at END', 'deleted_at')} FROM attendance a",
)
def _(t):
    state = changes.bulk_delete(t.attendance, t.bulk_entries, _DAY, _at())
    return state.select("id", *_CELL, "is_deleted", "deleted_at")


@query(
    "m_bulk_undo",
    f"SELECT a.id, a.student_id, a.date, a.subject, a.is_deleted AND NOT ({_HIT}) AS is_deleted, {_ts(f'CASE WHEN a.is_deleted AND {_HIT} THEN NULL ELSE a.deleted_at END', 'deleted_at')} FROM attendance a",
)
def _(t):
    state = changes.bulk_undo(t.attendance, t.bulk_entries, _DAY, _at())
    return state.select("id", *_CELL, "is_deleted", "deleted_at")


@query(
    "m_rehome_ids",
    """SELECT id, student_id, date, subject, status, is_deleted FROM (SELECT a.id, coalesce(m.canonical_id, a.student_id) AS student_id, a.date, a.subject, a.status, a.is_deleted,
 row_number() OVER (PARTITION BY coalesce(m.canonical_id, a.student_id), a.date, a.subject ORDER BY a.is_deleted, a.student_id DESC, a.id DESC) AS rn
 FROM attendance a LEFT JOIN o_remap m ON m.old_id = a.student_id) x WHERE rn = 1""",
)
def _(t):
    return changes.rehome(t.attendance, t.remap).select("id", *_CELL, "status", "is_deleted")


def _note_changes(t):
    return t.change_log.select(
        "student_id", F.year("date").alias("year"), F.month("date").alias("month"), "subject", "notes", "changed_at", "seq"
    )


_NOTE_LAST = """(SELECT * FROM (SELECT student_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, nullif(subject, '') AS subject, notes,
 row_number() OVER (PARTITION BY student_id, year(date), month(date), nullif(subject, '') ORDER BY changed_at DESC, seq DESC) AS rn FROM change_log) x WHERE rn = 1)"""


@query(
    "m_note_set",
    f"""SELECT student_id, year, month, subject, notes FROM {_NOTE_LAST} c
UNION ALL SELECT n.student_id, n.year, n.month, n.subject, n.notes FROM student_notes n
WHERE NOT EXISTS (SELECT 1 FROM {_NOTE_LAST} c WHERE c.student_id = n.student_id AND c.year = n.year AND c.month = n.month AND c.subject IS NOT DISTINCT FROM n.subject)""",
)
def _(t):
    return changes.set_notes(t.student_notes, _note_changes(t)).select("student_id", "year", "month", "subject", "notes")


@query(
    "m_holiday_set",
    """SELECT coalesce(h.id, (SELECT max(id) FROM holidays) + c.seq) AS id, c.date, c.name FROM (SELECT date, arg_max(notes, (changed_at, seq)) AS name, arg_max(seq, (changed_at, seq)) AS seq FROM change_log GROUP BY date) c
LEFT JOIN holidays h ON h.date = c.date
UNION ALL SELECT h.id, h.date, h.name FROM holidays h WHERE h.date NOT IN (SELECT date FROM change_log)""",
)
def _(t):
    asked = t.change_log.select("date", F.col("notes").alias("name"), "changed_at", "seq")
    return changes.set_holidays(t.holidays, asked).select("id", "date", "name")


@query(
    "m_holiday_delete",
    "SELECT id, date, name FROM holidays WHERE date NOT IN (SELECT date FROM attendance_log WHERE dayofweek(date) IN (0, 6))",
)
def _(t):
    # the holidays on weekend days that have records
    weekend = t.attendance_log.filter(F.dayofweek("date").isin(1, 7)).select("date").distinct()
    ids = t.holidays.join(weekend, "date", "left_semi").select("id")
    return changes.delete_holidays(t.holidays, ids)


_RATE_LAST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id, subject ORDER BY changed_at DESC, seq DESC) AS rn FROM rate_changes) x WHERE rn = 1)"""
_RATE_SQL = f"""SELECT student_id, subject, CAST(price_per_class AS DOUBLE) AS price_per_class, CASE WHEN currency IN ('PHP', 'KRW') THEN currency ELSE 'PHP' END AS currency FROM {_RATE_LAST} c
UNION ALL SELECT u.student_id, u.subject, CAST(u.price_per_class AS DOUBLE), u.currency FROM student_subject_tuition u WHERE NOT EXISTS (SELECT 1 FROM rate_changes c WHERE c.student_id = u.student_id AND c.subject = u.subject)"""


def _rates_after(t):
    return changes.set_rates(
        t.student_subject_tuition, t.rate_changes, KEYS["student_subject_tuition"], "price_per_class"
    )


@query("m_rate_set", _RATE_SQL)
def _(t):
    return _rates_after(t)


_PAY_KEYS = list(KEYS["subject_tuition_payments"])


def _pay_changes(t):
    return t.rate_changes.select(
        "seq", "student_id", "subject", F.lit(2024).alias("year"), F.lit(1).alias("month"),
        (F.col("currency") != "USD").alias("paid"), F.to_date("changed_at").alias("payment_date"),
        F.lit("set").alias("notes"), "changed_at",
    )


@query(
    "m_payment_set",
    f"""SELECT student_id, subject, 2024 AS year, 1 AS month, currency <> 'USD' AS paid, CAST(changed_at AS DATE) AS payment_date, 'set' AS notes FROM {_RATE_LAST} c
UNION ALL SELECT p.student_id, p.subject, p.year, p.month, p.paid, p.payment_date, p.notes FROM subject_tuition_payments p WHERE NOT EXISTS (SELECT 1 FROM rate_changes c WHERE c.student_id = p.student_id AND c.subject = p.subject)""",
)
def _(t):
    return changes.set_payments(t.subject_tuition_payments, _pay_changes(t), _PAY_KEYS)


@query(
    "m_payment_toggle",
    """SELECT student_id, subject, year, month, paid, CASE WHEN n IS NULL THEN payment_date WHEN paid THEN day END AS payment_date, notes FROM (
 SELECT coalesce(p.student_id, c.student_id) AS student_id, coalesce(p.subject, c.subject) AS subject, 2024 AS year, 1 AS month, coalesce(p.paid, FALSE) <> (coalesce(c.n, 0) % 2 = 1) AS paid, p.payment_date, c.n, c.day, p.notes
 FROM subject_tuition_payments p FULL JOIN (SELECT student_id, subject, count(*) AS n, max(CAST(changed_at AS DATE)) AS day FROM rate_changes GROUP BY student_id, subject) c ON c.student_id = p.student_id AND c.subject = p.subject) x""",
)
def _(t):
    return changes.toggle_payments(t.subject_tuition_payments, _pay_changes(t), _PAY_KEYS)


@query(
    "m_subject_add",
    """SELECT student_id, subject, CAST(price_per_class AS DOUBLE) AS price_per_class, currency FROM student_subject_tuition
UNION ALL SELECT DISTINCT c.student_id, c.subject, CAST(0 AS DOUBLE), 'PHP' FROM rate_changes c WHERE NOT EXISTS (SELECT 1 FROM student_subject_tuition u WHERE u.student_id = c.student_id AND u.subject = c.subject)""",
)
def _(t):
    return changes.add_subjects(t.student_subject_tuition, t.rate_changes)


@query(
    "m_subject_delete",
    """SELECT 'rate' AS kind, student_id, subject FROM student_subject_tuition u WHERE NOT EXISTS (SELECT 1 FROM rate_changes c WHERE c.student_id = u.student_id AND c.subject = u.subject)
UNION ALL SELECT 'payment', student_id, subject FROM subject_tuition_payments u WHERE NOT EXISTS (SELECT 1 FROM rate_changes c WHERE c.student_id = u.student_id AND c.subject = u.subject)""",
)
def _(t):
    rates, payments = changes.delete_subjects(t.student_subject_tuition, t.subject_tuition_payments, t.rate_changes)
    keys = ["student_id", "subject"]
    return rates.select(F.lit("rate").alias("kind"), *keys).unionByName(
        payments.select(F.lit("payment").alias("kind"), *keys)
    )


@query(
    "m_skip_unchanged",
    """SELECT c.seq, c.student_id, c.subject, CAST(c.price_per_class AS DOUBLE) AS price_per_class, c.currency FROM rate_changes c LEFT JOIN student_subject_tuition u ON u.student_id = c.student_id AND u.subject = c.subject
WHERE u.student_id IS NULL OR u.price_per_class IS DISTINCT FROM c.price_per_class OR u.currency IS DISTINCT FROM c.currency""",
)
def _(t):
    return changes.skip_unchanged(
        t.rate_changes, t.student_subject_tuition, ["student_id", "subject"], ["price_per_class", "currency"]
    ).drop("changed_at")


# what is asked for, and what is stored asked for once more
_ASKED_RATES = """(SELECT seq, student_id, subject, price_per_class, currency FROM rate_changes
 UNION ALL SELECT CAST(-student_id AS BIGINT), student_id, subject, price_per_class, currency FROM student_subject_tuition)"""


@query(
    "m_skip_unchanged_rate",
    f"""SELECT c.seq, c.student_id, c.subject, CAST(c.price_per_class AS DOUBLE) AS price_per_class, c.currency FROM {_ASKED_RATES} c LEFT JOIN student_subject_tuition u ON u.student_id = c.student_id AND u.subject = c.subject
WHERE u.student_id IS NULL OR u.price_per_class IS DISTINCT FROM c.price_per_class OR u.currency IS DISTINCT FROM c.currency""",
)
def _(t):
    rates, columns = t.student_subject_tuition, ["student_id", "subject", "price_per_class", "currency"]
    again = rates.select((-F.col("student_id")).cast("long").alias("seq"), *columns)
    asked = t.rate_changes.select("seq", *columns).unionByName(again)
    return changes.skip_unchanged(asked, rates, ["student_id", "subject"], ["price_per_class", "currency"])


@query(
    "m_skip_unchanged_commission",
    """SELECT c.teacher_id, c.student_id, CAST(c.asked AS DOUBLE) AS commission_per_class, c.currency
FROM (SELECT teacher_id, student_id, commission_per_class + CASE WHEN student_id % 3 = 0 THEN 1 ELSE 0 END AS asked, CASE WHEN student_id % 5 = 0 THEN 'USD' ELSE currency END AS currency FROM teacher_student_commission) c
JOIN teacher_student_commission u ON u.teacher_id = c.teacher_id AND u.student_id = c.student_id WHERE u.commission_per_class IS DISTINCT FROM c.asked OR u.currency IS DISTINCT FROM c.currency""",
)
def _(t):
    stored = t.teacher_student_commission
    # another rate for every third student, another currency for every fifth
    asked = stored.withColumns({
        "commission_per_class": F.col("commission_per_class") + F.when(F.col("student_id") % 3 == 0, 1).otherwise(0),
        "currency": F.when(F.col("student_id") % 5 == 0, "USD").otherwise(F.col("currency")),
    })
    keys = list(KEYS["teacher_student_commission"])
    return changes.skip_unchanged(asked, stored, keys, ["commission_per_class", "currency"])


_ASKED_NOTES = """(SELECT student_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, nullif(subject, '') AS subject, notes FROM change_log
 UNION ALL SELECT student_id, year, month, subject, notes FROM student_notes)"""


@query(
    "m_skip_unchanged_note",
    f"""SELECT c.student_id, c.year, c.month, c.subject, c.notes FROM {_ASKED_NOTES} c
LEFT JOIN student_notes n ON n.student_id = c.student_id AND n.year = c.year AND n.month = c.month AND n.subject IS NOT DISTINCT FROM c.subject
WHERE n.student_id IS NULL OR n.notes IS DISTINCT FROM c.notes""",
)
def _(t):
    columns = ["student_id", "year", "month", "subject", "notes"]
    asked = _note_changes(t).withColumn("subject", F.expr("nullif(subject, '')")).select(*columns)
    return changes.skip_unchanged(asked.unionByName(t.student_notes.select(*columns)), t.student_notes, columns[:4], ["notes"])


@query(
    "m_affected",
    f"""SELECT n.student_id, n.subject, CASE WHEN u.student_id IS NULL THEN 'inserted' ELSE 'updated' END AS change, n.price_per_class, n.currency FROM ({_RATE_SQL}) n
LEFT JOIN student_subject_tuition u ON u.student_id = n.student_id AND u.subject = n.subject
WHERE u.student_id IS NULL OR CAST(u.price_per_class AS DOUBLE) <> n.price_per_class OR u.currency <> n.currency""",
)
def _(t):
    return changes.affected(t.student_subject_tuition, _rates_after(t), ["student_id", "subject"])


_SET_ON = f"""(SELECT coalesce(a.id, (SELECT max(id) FROM attendance) + c.seq) AS id, CASE WHEN a.id IS NULL THEN 'inserted' ELSE 'updated' END AS change
 FROM {_LAST} c LEFT JOIN attendance a ON a.student_id = c.student_id AND a.date = c.date AND a.subject IS NOT DISTINCT FROM c.subject)"""


@query(
    "m_affected_counts",
    f"""SELECT action, change, count(*) AS n_rows, CAST(sum(id) AS BIGINT) AS id_sum, CAST(bit_xor(id) AS BIGINT) AS id_xor FROM (
 SELECT 'bulk_set' AS action, change, CAST(id AS BIGINT) AS id FROM {_SET_ON} s
 UNION ALL SELECT 'bulk_delete', 'deleted', CAST(a.id AS BIGINT) FROM attendance a WHERE NOT a.is_deleted AND {_HIT}
 UNION ALL SELECT 'bulk_undo', 'restored', CAST(a.id AS BIGINT) FROM attendance a WHERE a.is_deleted AND {_HIT}) x GROUP BY action, change""",
)
def _(t):
    after = {
        "bulk_set": changes.bulk_set_records(t.attendance, t.change_log, mark="change"),
        "bulk_delete": changes.bulk_delete(t.attendance, t.bulk_entries, _DAY, _at(), mark="change"),
        "bulk_undo": changes.bulk_undo(t.attendance, t.bulk_entries, _DAY, _at(), mark="change"),
    }
    counted = [
        (action, kind, n["rows"], n["sum"], n["xor"])
        for action, state in after.items()
        for kind, n in write_counted(state, run_dir(t.spark, action)).items() if n["rows"]
    ]
    return t.spark.createDataFrame(counted, "action string, change string, n_rows long, id_sum long, id_xor long")


_HIDE_LAST = """(SELECT * FROM (SELECT student_id, nullif(subject, '') AS subject, id, changed_at, row_number() OVER (PARTITION BY student_id, nullif(subject, '') ORDER BY changed_at DESC, seq DESC) AS rn
 FROM (SELECT seq AS id, * FROM change_log) y) x WHERE rn = 1)"""


@query(
    "m_hide",
    f"""SELECT student_id, subject, CASE WHEN id % 2 = 0 THEN 2025 ELSE 2024 END AS hidden_from_year, CASE WHEN id % 2 = 0 THEN CAST(id % 12 + 1 AS INT) ELSE 3 END AS hidden_from_month, {_ts('changed_at', 'hidden_at')} FROM {_HIDE_LAST} c
UNION ALL SELECT h.student_id, h.subject, h.hidden_from_year, h.hidden_from_month, {_ts('h.hidden_at', 'hidden_at')} FROM hidden_attendance_rows h
WHERE NOT EXISTS (SELECT 1 FROM change_log c WHERE c.student_id = h.student_id AND nullif(c.subject, '') IS NOT DISTINCT FROM h.subject)""",
)
def _(t):
    given = F.col("seq") % 2 == 0
    asked = t.change_log.select(
        "student_id", "subject", "seq", "changed_at",
        F.when(given, F.lit(2025)).alias("hidden_from_year"),
        F.when(given, (F.col("seq") % 12 + 1).cast("int")).alias("hidden_from_month"),
    )
    state = t.hidden_attendance_rows.withColumn("hidden_at", F.col("hidden_at").cast("timestamp_ntz"))
    return changes.hide_rows(state, asked, dt.date(2024, 3, 9))


@query(
    "m_unhide",
    """SELECT student_id, subject, hidden_from_year, hidden_from_month FROM hidden_attendance_rows h WHERE NOT EXISTS (SELECT 1 FROM bulk_entries e WHERE e.student_id = h.student_id AND nullif(e.subject, '') IS NOT DISTINCT FROM h.subject)""",
)
def _(t):
    return changes.unhide_rows(t.hidden_attendance_rows, clean_entries(t.bulk_entries)).drop("hidden_at")
