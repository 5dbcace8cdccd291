"""Table schemas, unique keys, domains and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the data model.
STATUSES = ("present", "absent", "ta", "noshow")
CURRENCIES = ("PHP", "KRW")
DEFAULT_CURRENCY = "PHP"
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
DAY_CODES = ("Su", "M", "T", "W", "Th", "F", "Sa")

MONEY = T.DecimalType(10, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_INT, _LONG, _STR, _BOOL = T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType()
_DATE, _TS = T.DateType(), T.TimestampNTZType()

SCHEMAS: dict[str, T.StructType] = {
    "students": _struct(
        id=_INT, notion_page_id=_STR, name=_STR, korean_name=_STR, english_name=_STR,
        color_keyword=_STR, student_id=_STR, is_active=_BOOL, first_start_date=_DATE,
    ),
    "teachers": _struct(id=_INT, name=_STR, is_active=_BOOL),
    "time_slots": _struct(id=_INT, start_min=_INT, end_min=_INT),
    "assignments": _struct(id=_LONG, date=_STR, subject=_STR, time_slot_id=_INT, is_active=_BOOL),
    "assignment_students": _struct(assignment_id=_LONG, student_id=_INT),
    "assignment_teachers": _struct(assignment_id=_LONG, teacher_id=_INT),
    "attendance": _struct(
        id=_LONG, student_id=_INT, date=_DATE, subject=_STR, status=_STR, notes=_STR,
        is_deleted=_BOOL, deleted_at=_TS, updated_at=_TS,
    ),
    "attendance_log": _struct(
        id=_LONG, student_id=_INT, date=_DATE, subject=_STR, status=_STR, notes=_STR,
        is_delete=_BOOL, updated_at=_TS,
    ),
    "holidays": _struct(id=_INT, date=_DATE, name=_STR),
    "student_notes": _struct(student_id=_INT, year=_INT, month=_INT, subject=_STR, notes=_STR),
    "student_subject_tuition": _struct(
        student_id=_INT, subject=_STR, price_per_class=MONEY, currency=_STR
    ),
    "subject_tuition_payments": _struct(
        student_id=_INT, subject=_STR, year=_INT, month=_INT, paid=_BOOL, payment_date=_DATE, notes=_STR
    ),
    "teacher_commission": _struct(teacher_id=_INT, commission_per_class=MONEY, currency=_STR),
    "teacher_payments": _struct(
        teacher_id=_INT, year=_INT, month=_INT, paid=_BOOL, payment_date=_DATE, notes=_STR
    ),
    "teacher_student_commission": _struct(
        teacher_id=_INT, student_id=_INT, commission_per_class=MONEY, currency=_STR
    ),
    "teacher_student_payments": _struct(
        teacher_id=_INT, student_id=_INT, year=_INT, month=_INT, paid=_BOOL, payment_date=_DATE, notes=_STR
    ),
    "hidden_attendance_rows": _struct(
        student_id=_INT, subject=_STR, hidden_from_year=_INT, hidden_from_month=_INT, hidden_at=_TS
    ),
}

KEYS: dict[str, tuple[str, ...]] = {
    "students": ("id",),
    "teachers": ("id",),
    "attendance": ("student_id", "date", "subject"),
    "holidays": ("date",),
    "student_notes": ("student_id", "year", "month", "subject"),
    "student_subject_tuition": ("student_id", "subject"),
    "subject_tuition_payments": ("student_id", "subject", "year", "month"),
    "teacher_commission": ("teacher_id",),
    "teacher_payments": ("teacher_id", "year", "month"),
    "teacher_student_commission": ("teacher_id", "student_id"),
    "teacher_student_payments": ("teacher_id", "student_id", "year", "month"),
    "hidden_attendance_rows": ("student_id", "subject"),
}

# What a column holds when a row arrives without it.
DEFAULTS: dict[str, object] = {
    "price_per_class": 0,
    "commission_per_class": 0,
    "currency": DEFAULT_CURRENCY,
    "paid": False,
    "is_deleted": False,
}

# Which columns point at which parent; deleting the parent deletes the row.
FOREIGN_KEYS: dict[str, dict[str, str]] = {
    "attendance": {"student_id": "students"},
    "student_notes": {"student_id": "students"},
    "student_subject_tuition": {"student_id": "students"},
    "subject_tuition_payments": {"student_id": "students"},
    "hidden_attendance_rows": {"student_id": "students"},
    "teacher_commission": {"teacher_id": "teachers"},
    "teacher_payments": {"teacher_id": "teachers"},
    "teacher_student_commission": {"teacher_id": "teachers", "student_id": "students"},
    "teacher_student_payments": {"teacher_id": "teachers", "student_id": "students"},
}
