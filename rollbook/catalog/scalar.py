"""Sources, contracts, scalar functions and predicates."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollbook.catalog.registry import MONTH, YEAR, query
from rollbook.catalog.views import clock
from rollbook.functions import dates, days, names, predicates, values
from rollbook.functions import sql as sql_functions
from rollbook.operators.identity import with_identity
from rollbook.operators.joins import keep_known, null_safe_join
from rollbook.operators.spread import join_few
from rollbook.schema import FOREIGN_KEYS, KEYS
from rollbook.session import run_dir
from rollbook.sinks import writers
from rollbook.sources import calendar, contracts, readers

# ---- sources and contracts -------------------------------------------------------------


@query("src_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "src_month_slice",
    "SELECT id, student_id, date, subject, status FROM attendance WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'",
)
def _(t):
    return readers.month_slice(t.attendance, YEAR, MONTH).select("id", "student_id", "date", "subject", "status")


@query(
    "src_date_range",
    "SELECT student_id, date, subject, status FROM attendance_hist WHERE date BETWEEN DATE '1996-03-15' AND DATE '1999-02-10'",
)
def _(t):
    sliced = readers.date_range(t.attendance_hist, dt.date(1996, 3, 15), dt.date(1999, 2, 10))
    return sliced.select("student_id", "date", "subject", "status")


@query(
    "src_calendar",
    """SELECT CAST(d AS DATE) AS date, CAST(day(d) AS INT) AS day, CAST(dayofweek(d) AS INT) AS weekday, dayname(d) AS weekday_name,
 dayofweek(d) IN (0, 6) AS is_weekend, coalesce(h.n_records, 0) AS n_records
FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), last_day(max(date)), INTERVAL 1 DAY)) AS d FROM attendance_hist) g
LEFT JOIN (SELECT date, count(*) AS n_records FROM attendance_hist GROUP BY date) h ON h.date = CAST(g.d AS DATE)""",
)
def _(t):
    counted = t.attendance_hist.groupBy("date").agg(F.count(F.lit(1)).alias("n_records"))
    dense = calendar.calendar_of(t.attendance_hist).join(counted, "date", "left")
    return dense.withColumn("n_records", F.coalesce("n_records", F.lit(0)))


@query("src_values", "SELECT DISTINCT student_id, nullif(subject, '') AS subject FROM bulk_entries")
def _(t):
    return readers.clean_entries(t.bulk_entries)


def _halves(t, checked, reason):
    """Both halves of a split, each read back from its own files."""
    path = run_dir(t.spark, "split")
    writers.write_split(checked.select("id", reason), reason, path)
    schema = checked.select("id", reason).schema
    halves = [writers.read_verdict(t.spark, path, StructType(schema.fields), v) for v in ("passed", "quarantined")]
    return halves[0].unionByName(halves[1]).select("id", "verdict", reason)


@query(
    "chk_domain",
    """SELECT id, CASE WHEN violations = '' THEN 'passed' ELSE 'quarantined' END AS verdict, violations FROM (
 SELECT id, array_to_string(list_filter([CASE WHEN status NOT IN ('present', 'absent', 'ta', 'noshow') THEN 'status' END,
 CASE WHEN currency NOT IN ('PHP', 'KRW') THEN 'currency' END, CASE WHEN month NOT BETWEEN 1 AND 12 THEN 'month' END], lambda x: x IS NOT NULL), ',') AS violations
 FROM incoming) v""",
)
def _(t):
    return _halves(t, contracts.check_domain(t.incoming), "violations")


@query(
    "chk_unique",
    "SELECT student_id, date, subject, count(*) AS n_rows FROM attendance_log WHERE subject IS NOT NULL GROUP BY student_id, date, subject HAVING count(*) > 1",
)
def _(t):
    return contracts.duplicate_keys(t.attendance_log, KEYS["attendance"])


@query(
    "chk_required",
    """SELECT id, CASE WHEN missing = '' THEN 'passed' ELSE 'quarantined' END AS verdict, missing FROM (
 SELECT id, array_to_string(list_filter([CASE WHEN coalesce(student_id, 0) = 0 THEN 'student_id' END, CASE WHEN date IS NULL THEN 'date' END,
 CASE WHEN coalesce(status, '') = '' THEN 'status' END], lambda x: x IS NOT NULL), ',') AS missing FROM incoming) v""",
)
def _(t):
    return _halves(t, contracts.check_required(t.incoming, ["student_id", "date", "status"]), "missing")


@query(
    "chk_orphans",
    "SELECT id, student_id FROM attendance a WHERE NOT EXISTS (SELECT 1 FROM students s WHERE s.is_active AND s.id = a.student_id)",
)
def _(t):
    return contracts.orphans(t.attendance, t.students.filter("is_active"), "student_id").select("id", "student_id")


_REFERENCES = [(child, column, parent) for child, found in FOREIGN_KEYS.items() for column, parent in found.items()]


@query(
    "chk_orphans_all",
    " UNION ALL ".join(
        f"SELECT '{child}' AS child, '{column}' AS reference, CAST({column} AS BIGINT) AS value, count(*) AS n_rows FROM {child}"
        f" WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {parent} WHERE is_active) GROUP BY {column}"
        for child, column, parent in _REFERENCES
    ),
)
def _(t):
    tables = {child: getattr(t, child) for child in FOREIGN_KEYS}
    return contracts.orphan_counts(tables | {p: getattr(t, p).filter("is_active") for p in ("students", "teachers")})


def _surviving(child: str) -> str:
    return " AND ".join(
        f"NOT EXISTS (SELECT 1 FROM {parent} p WHERE NOT p.is_active AND p.id = c.{column})" for column, parent in FOREIGN_KEYS[child].items()
    )


@query(
    "del_cascade",
    " UNION ALL ".join(
        f"SELECT '{child}' AS child, CAST({'c.student_id' if 'student_id' in found else 'NULL'} AS INT) AS student_id,"
        f" CAST({'c.teacher_id' if 'teacher_id' in found else 'NULL'} AS INT) AS teacher_id, count(*) AS n_rows"
        f" FROM {child} c WHERE {_surviving(child)} GROUP BY ALL"
        for child, found in FOREIGN_KEYS.items()
    ),
)
def _(t):
    tables = {child: getattr(t, child) for child in FOREIGN_KEYS}
    left = contracts.cascade(tables, {p: getattr(t, p).filter("NOT is_active") for p in ("students", "teachers")})
    counted = []
    for child, found in FOREIGN_KEYS.items():
        rows = left[child].groupBy(*found).agg(F.count(F.lit(1)).alias("n_rows"))
        both = [(F.col(c) if c in found else F.lit(None)).cast("int").alias(c) for c in ("student_id", "teacher_id")]
        counted.append(rows.select(F.lit(child).alias("child"), *both, "n_rows"))
    return reduce(DataFrame.unionByName, counted)


@query(
    "evo_backfill_hidden",
    """SELECT student_id, subject, coalesce(hidden_from_year, CAST(year(hidden_at) AS INT)) AS hidden_from_year,
 CASE WHEN hidden_from_year IS NULL THEN CAST(month(hidden_at) AS INT) ELSE hidden_from_month END AS hidden_from_month FROM hidden_attendance_rows""",
)
def _(t):
    return readers.backfill_hidden(t.hidden_attendance_rows).drop("hidden_at")


@query(
    "evo_columns",
    """SELECT student_id, subject, CAST(price_per_class AS DOUBLE) AS price_per_class,
 CASE WHEN student_id % 2 = 0 THEN 'PHP' WHEN student_id % 5 <> 0 THEN currency END AS currency FROM student_subject_tuition""",
)
def _(t):
    # one folder: files from before the columns were renamed and added, and files from after
    path, rates = run_dir(t.spark, "evolved"), t.student_subject_tuition
    rates.filter("student_id % 2 = 0").select("student_id", "subject", F.col("price_per_class").alias("amount")).write.parquet(path)
    newer = rates.filter("student_id % 2 <> 0").withColumn("currency", F.when(F.col("student_id") % 5 != 0, F.col("currency")))
    newer.write.mode("append").parquet(path)
    evolved = readers.read_evolved(t.spark, path, {"amount": "price_per_class"}, {"currency": "PHP"})
    return evolved.select("student_id", "subject", "price_per_class", "currency")


@query(
    "src_defaults",
    "SELECT student_id, subject, CAST(coalesce(price_per_class, 0) AS DOUBLE) AS price_per_class, coalesce(currency, 'PHP') AS currency FROM sparse_rates",
)
def _(t):
    return readers.with_defaults(t.sparse_rates)


# ---- scalar functions --------------------------------------------------------------------


@query("f_identity_key", "SELECT id, identity_key FROM o_identity")
def _(t):
    return with_identity(t.students)


@query("f_identity_key_sql", "SELECT id, identity_key FROM o_identity")
def _(t):
    sql_functions.register(t.spark)
    return t.spark.sql("SELECT id, identity_key(notion_page_id, name, korean_name) AS identity_key FROM {s}", s=t.students)


@query(
    "f_days_parse_sql",
    """SELECT id, array_to_string([CAST(list_position(['Su','M','T','W','Th','F','Sa'], x) - 1 AS VARCHAR) FOR x IN regexp_extract_all(name, '(Su|Th|Sa|M|T|W|F)')], ',') AS days FROM students""",
)
def _(t):
    sql_functions.register(t.spark)
    return t.spark.sql("SELECT id, array_join(days_parse(name), ',') AS days FROM {s}", s=t.students)


@query("f_bracket_name", r"SELECT id, nullif(regexp_extract(full_name, '\[([^\]]+)\]', 1), '') AS bracket FROM full_names")
def _(t):
    return t.full_names.select("id", names.bracket_name("full_name").alias("bracket"))


@query("f_clean_name", r"SELECT id, trim(regexp_replace(full_name, '\s*\[[^\]]+\]\s*$', '')) AS clean FROM full_names")
def _(t):
    return t.full_names.select("id", names.clean_name("full_name").alias("clean"))


@query(
    "f_time12",
    f"SELECT o_orderkey, {clock('m')} AS text FROM (SELECT o_orderkey, CAST(o_orderkey % 1440 AS INT) AS m FROM orders) x",
)
def _(t):
    return t.orders.select("o_orderkey", dates.time12((F.col("o_orderkey") % 1440).cast("int")).alias("text"))


@query("f_date_iso", "SELECT id, strftime(date, '%Y-%m-%d') AS text FROM attendance_log")
def _(t):
    return t.attendance_log.select("id", dates.date_iso().alias("text"))


@query("f_weekday_name", "SELECT id, dayname(date) AS weekday FROM attendance_log")
def _(t):
    return t.attendance_log.select("id", dates.weekday_name().alias("weekday"))


@query(
    "f_weekday_num",
    "SELECT id, CAST(list_position(['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'], date) - 1 AS INT) AS weekday FROM assignments",
)
def _(t):
    return t.assignments.select("id", dates.weekday_num("date").alias("weekday"))


_STUDENT_DAYS = """SELECT x.student_id, list_sort(list(DISTINCT list_position(['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'], a.date) - 1)) AS days
FROM assignment_students x JOIN assignments a ON a.id = x.assignment_id GROUP BY x.student_id"""


def _student_days(t):
    weekdays = t.assignments.select(F.col("id").alias("assignment_id"), dates.weekday_num("date").alias("weekday"))
    joined = t.assignment_students.join(weekdays, "assignment_id")
    return joined.groupBy("student_id").agg(days.mask_union("weekday").alias("mask"))


@query(
    "f_days_text",
    f"SELECT student_id, array_to_string(list_transform(days, lambda d: ['Su','M','T','W','Th','F','Sa'][d + 1]), '') AS text FROM ({_STUDENT_DAYS}) q",
)
def _(t):
    return _student_days(t).select("student_id", days.days_text(days.mask_days("mask")).alias("text"))


@query(
    "f_days_parse",
    """SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(Su|Th|Sa|M|T|W|F)'),
 lambda c: list_position(['Su','M','T','W','Th','F','Sa'], c) - 1), ',') AS days FROM documents""",
)
def _(t):
    parsed = F.transform(days.days_parse("text"), lambda d: d.cast("string"))
    return t.documents.select("doc_id", F.array_join(parsed, ",").alias("days"))


@query(
    "f_days_union",
    """SELECT student_id, array_to_string(list_sort(list_distinct(regexp_extract_all(string_agg(days, ','), '(Su|Th|Sa|M|T|W|F)'))), ',') AS days FROM o_slots GROUP BY student_id""",
)
def _(t):
    # one entry per set of weekdays: at most 127 for a student
    sets = t.slots.select("student_id", days.mask_text("days").alias("days")).distinct()
    rows = sets.groupBy("student_id").agg(F.collect_list(F.struct("days")).alias("schedules"))
    union = days.days_union("schedules", F.lit(None).cast("string"))
    codes = F.transform(union, lambda d: days.days_text(F.array(d)))
    return rows.select("student_id", F.array_join(F.sort_array(codes), ",").alias("days"))


@query(
    "f_time_range",
    f"""SELECT a.id, {clock('s.start_min')} || ' - ' || CASE WHEN a.is_active THEN {clock('s.end_min')} END AS text FROM assignments a JOIN time_slots s ON s.id = a.time_slot_id""",
)
def _(t):
    slots = t.time_slots.withColumnRenamed("id", "time_slot_id")
    end = F.when(F.col("is_active"), dates.time12("end_min"))
    joined = join_few(t.assignments, slots, t.tasks, "time_slot_id", "id")
    return joined.select("id", dates.time_range(dates.time12("start_min"), end).alias("text"))


@query("f_row_key", "SELECT id, CAST(student_id AS VARCHAR) || '-' || coalesce(subject, 'default') AS row_key FROM attendance_log")
def _(t):
    return t.attendance_log.select("id", names.row_key("student_id", "subject").alias("row_key"))


@query(
    "f_composite_id",
    "SELECT CAST(teacher_id AS VARCHAR) || '-' || CAST(student_id AS VARCHAR) AS id, currency FROM teacher_student_commission",
)
def _(t):
    return t.teacher_student_commission.select(names.composite_id("teacher_id", "student_id").alias("id"), "currency")


@query("f_month_ordinal", "SELECT student_id, subject, year * 12 + month AS ordinal FROM student_notes")
def _(t):
    return t.student_notes.select("student_id", "subject", dates.month_ordinal().alias("ordinal"))


@query("f_year_of", "SELECT student_id, subject, CAST(year(date) AS INT) AS year, count(*) AS n FROM attendance_hist GROUP BY 1, 2, 3")
def _(t):
    return t.attendance_hist.groupBy("student_id", "subject", dates.year_of().alias("year")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "f_status_code",
    """SELECT id, CASE shown WHEN 'present' THEN 'P' WHEN 'absent' THEN 'A' WHEN 'ta' THEN 'TA' WHEN 'noshow' THEN 'N' ELSE '' END AS code
FROM (SELECT id, CASE WHEN is_delete THEN NULL ELSE status END AS shown FROM attendance_log) x""",
)
def _(t):
    shown = F.when(~F.col("is_delete"), F.col("status"))
    return t.attendance_log.select("id", values.status_code(shown).alias("code"))


@query(
    "f_status_label",
    """SELECT id, CASE shown WHEN 'present' THEN 'Present' WHEN 'absent' THEN 'Absent' WHEN 'ta' THEN 'TA' WHEN 'noshow' THEN 'No Show' ELSE 'Not marked' END AS label
FROM (SELECT id, CASE WHEN is_delete THEN NULL ELSE status END AS shown FROM attendance_log) x""",
)
def _(t):
    shown = F.when(~F.col("is_delete"), F.col("status"))
    return t.attendance_log.select("id", values.status_label(shown).alias("label"))


@query(
    "f_default_num",
    r"""SELECT event_id, coalesce(TRY_CAST(regexp_extract(substr(props, 7), '^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS parsed, CAST(0 AS DOUBLE) AS unparsed,
coalesce(CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE), 0) AS parsed_float FROM events""",
)
def _(t):
    return t.events.select(
        "event_id",
        values.int_or_zero(F.expr("substr(props, 7)")).alias("parsed"),
        values.float_or_zero("props").alias("unparsed"),
        values.float_or_zero(F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" a class"))).alias("parsed_float"),
    )


@query("f_currency_default", "SELECT id, CASE WHEN currency IN ('PHP', 'KRW') THEN currency ELSE 'PHP' END AS currency FROM incoming")
def _(t):
    return t.incoming.select("id", values.currency_or_default().alias("currency"))


@query(
    "f_money_text",
    r"""SELECT student_id, subject, CASE WHEN coalesce(price_per_class, 0) = 0 THEN '-' ELSE (CASE WHEN currency = 'KRW' THEN '₩' ELSE '₱' END)
 || regexp_replace(format('{:,.2f}', CAST(price_per_class AS DOUBLE)), '\.?0+$', '') END AS text FROM sparse_rates""",
)
def _(t):
    return t.sparse_rates.select("student_id", "subject", values.money_text("price_per_class").alias("text"))


@query(
    "f_ext_label",
    "SELECT id, CASE WHEN is_active THEN 'EXT-' || student_id ELSE 'ID: ' || CAST(id AS VARCHAR) END AS label FROM students",
)
def _(t):
    external = F.when(F.col("is_active"), F.col("student_id"))
    return t.students.select("id", names.external_label(external, "id", "EXT-").alias("label"))


@query(
    "f_pct_band",
    """SELECT id, subject, CASE WHEN percentage IS NULL THEN 'none' WHEN percentage >= 90 THEN 'high' WHEN percentage >= 70 THEN 'middle' ELSE 'low' END AS summary_band,
 CASE WHEN percentage IS NULL THEN 'none' WHEN percentage >= 90 THEN 'high' WHEN percentage >= 75 THEN 'middle' ELSE 'low' END AS grid_band FROM o_summary""",
)
def _(t):
    from rollbook.plans.records import scheduled_summary

    rows = scheduled_summary(t.marked, t.holidays, YEAR, MONTH)
    return rows.select(
        "id", "subject",
        values.pct_band("percentage", 90, 70).alias("summary_band"),
        values.pct_band("percentage", 90, 75).alias("grid_band"),
    )


@query(
    "f_range_norm",
    """SELECT l_orderkey, l_linenumber, least(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS range_start, greatest(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS range_end
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def _(t):
    a, b = F.to_date("l_shipdate"), F.to_date("o_orderdate")
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber",
        dates.range_start(a, b).alias("range_start"), dates.range_end(a, b).alias("range_end"),
    )


@query(
    "f_day_flags",
    """SELECT CAST(d AS DATE) AS date, dayofweek(d) IN (0, 6) AS is_weekend, CAST(d AS DATE) = DATE '2024-01-17' AS is_today,
 CAST(d AS DATE) IN (SELECT date FROM holidays) AS is_holiday, CAST(d AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-19' AS in_range
FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), last_day(max(date)), INTERVAL 1 DAY)) AS d FROM attendance) g""",
)
def _(t):
    flagged = calendar.day_flags(
        calendar.calendar_of(t.attendance), t.holidays, dt.date(2024, 1, 17), dt.date(2024, 1, 8), dt.date(2024, 1, 19)
    )
    return flagged.select("date", "is_weekend", "is_today", "is_holiday", "in_range")


@query(
    "f_hidden_from_text",
    """SELECT student_id, subject, CASE WHEN hidden_from_year IS NULL OR hidden_from_month IS NULL THEN '(All months)'
 ELSE monthname(make_date(hidden_from_year, hidden_from_month, 1)) || ' ' || CAST(hidden_from_year AS VARCHAR) END AS text FROM hidden_attendance_rows""",
)
def _(t):
    return t.hidden_attendance_rows.select("student_id", "subject", dates.hidden_from_text().alias("text"))


@query("f_round_half_up", "SELECT event_id, CAST(floor(value + 0.5) AS BIGINT) AS rounded FROM events")
def _(t):
    return t.events.select("event_id", values.round_half_up("value").alias("rounded"))


@query(
    "f_amount",
    """SELECT c.teacher_id, c.student_id, CAST(c.commission_per_class AS DOUBLE) * n.n AS amount FROM teacher_student_commission c
JOIN (SELECT student_id, count(*) AS n FROM attendance GROUP BY student_id) n ON n.student_id = c.student_id""",
)
def _(t):
    counted = t.attendance.groupBy("student_id").agg(F.count(F.lit(1)).alias("n"))
    joined = t.teacher_student_commission.join(counted, "student_id")
    return joined.select("teacher_id", "student_id", values.amount("commission_per_class", "n").alias("amount"))


@query(
    "f_zero_blank",
    "SELECT id, nullif(subject, '') AS subject, nullif(student_id, 0) AS student_id, nullif(month, 0) AS month FROM incoming",
)
def _(t):
    return t.incoming.select(
        "id", names.blank_to_null("subject").alias("subject"),
        names.zero_to_null("student_id").alias("student_id"), names.zero_to_null("month").alias("month"),
    )


@query("f_status_list", "SELECT status, count(*) AS n FROM attendance_hist WHERE status IN ('present', 'ta') GROUP BY status")
def _(t):
    wanted = values.parse_status_list("present,, ,ta")
    return t.attendance_hist.filter(predicates.status_in(wanted)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- predicates --------------------------------------------------------------------------


@query("p_not_deleted", "SELECT id, student_id, date FROM attendance WHERE NOT coalesce(is_deleted, FALSE)")
def _(t):
    return t.attendance.filter(predicates.not_deleted()).select("id", "student_id", "date")


@query(
    "p_active",
    """SELECT x.assignment_id, x.student_id FROM assignment_students x JOIN assignments a ON a.id = x.assignment_id JOIN students s ON s.id = x.student_id WHERE a.is_active AND s.is_active""",
)
def _(t):
    joined = t.assignment_students.join(
        t.assignments.select(F.col("id").alias("assignment_id"), F.col("is_active").alias("a_live")), "assignment_id"
    ).join(t.students.select(F.col("id").alias("student_id"), F.col("is_active").alias("s_live")), "student_id")
    return joined.filter(predicates.active("a_live", "s_live")).select("assignment_id", "student_id")


@query("p_status_in", "SELECT id, status FROM attendance WHERE status IN ('absent', 'noshow')")
def _(t):
    return t.attendance.filter(predicates.status_in(["absent", "noshow"])).select("id", "status")


@query(
    "p_null_safe_eq",
    """SELECT a.id FROM attendance a JOIN hidden_attendance_rows h ON h.student_id = a.student_id AND h.subject IS NOT DISTINCT FROM a.subject""",
)
def _(t):
    hidden = t.hidden_attendance_rows.select(F.col("student_id").alias("hid"), F.col("subject").alias("hsub"))
    matched = (F.col("student_id") == F.col("hid")) & predicates.same("subject", "hsub")
    return t.attendance.join(hidden, matched).select("id")


@query(
    "p_any_of",
    """SELECT id, student_id FROM attendance WHERE student_id IN (SELECT k.id FROM o_identity k WHERE k.identity_key IN (SELECT k2.identity_key FROM o_identity k2 JOIN hidden_attendance_rows h ON h.student_id = k2.id))""",
)
def _(t):
    from rollbook.operators.identity import identity_members

    members = identity_members(t.students, t.hidden_attendance_rows.select("student_id"))
    return keep_known(t.attendance, members, "student_id", "id").select("id", "student_id")


@query(
    "p_key_disjunction",
    """SELECT a.id FROM attendance a WHERE a.date = DATE '2024-01-08' AND EXISTS (SELECT 1 FROM bulk_entries e WHERE e.student_id = a.student_id AND nullif(e.subject, '') IS NOT DISTINCT FROM a.subject)""",
)
def _(t):
    on_day = t.attendance.filter(F.col("date") == F.lit(dt.date(2024, 1, 8)))
    entries = readers.clean_entries(t.bulk_entries)
    return null_safe_join(on_day, entries, ["student_id", "subject"], "left_semi").select("id")


@query("p_nonblank", "SELECT id, subject FROM incoming WHERE subject IS NOT NULL AND subject <> ''")
def _(t):
    return t.incoming.filter(predicates.nonblank("subject")).select("id", "subject")


@query(
    "p_recent",
    "SELECT id FROM attendance WHERE deleted_at >= (SELECT max(updated_at) FROM attendance_log) - INTERVAL 2880 MINUTE",
)
def _(t):
    as_of = t.attendance_log.agg(F.max("updated_at")).scalar()
    return t.attendance.filter(predicates.recent(as_of, 2880)).select("id")


@query(
    "p_hidden_as_of",
    """SELECT student_id, subject FROM hidden_attendance_rows WHERE (hidden_from_year IS NULL AND hidden_from_month IS NULL) OR hidden_from_year * 12 + hidden_from_month <= 24290""",
)
def _(t):
    return t.hidden_attendance_rows.filter(predicates.hidden_as_of(2024, 2)).select("student_id", "subject")


@query(
    "p_teacher",
    """SELECT x.assignment_id, x.student_id FROM assignment_students x WHERE EXISTS (SELECT 1 FROM assignment_teachers y JOIN teachers t ON t.id = y.teacher_id WHERE y.assignment_id = x.assignment_id AND t.name = 'Teacher 7')""",
)
def _(t):
    one = t.teachers.filter(F.col("name") == "Teacher 7")
    theirs = keep_known(t.assignment_teachers, one, "teacher_id", "id").select("assignment_id")
    return t.assignment_students.join(theirs, "assignment_id", "left_semi")


@query(
    "p_scheduled_day",
    """SELECT r.id, r.subject, count(*) AS n_days FROM o_dow r JOIN o_calendar c ON c.dow = r.dow WHERE c.date NOT IN (SELECT date FROM holidays) GROUP BY r.id, r.subject""",
)
def _(t):
    open_days = calendar.month_calendar(t.spark, YEAR, MONTH).join(t.holidays, "date", "left_anti")
    per_weekday = open_days.groupBy("weekday").agg(F.count(F.lit(1)).alias("n"))
    mask = F.when(F.col("days_mask") != 0, F.col("days_mask")).otherwise(F.lit(days.WORKDAY_MASK))
    spread = t.roster.select("id", "subject", F.explode(days.mask_days(mask)).alias("weekday"))
    # seven rows, one per weekday
    return spread.join(F.broadcast(per_weekday), "weekday").groupBy("id", "subject").agg(F.sum("n").alias("n_days"))


@query(
    "p_marked",
    "SELECT id, subject, count(*) AS n_marked FROM o_scheduled WHERE has_schedule AND status IS NOT NULL GROUP BY id, subject",
)
def _(t):
    mask = t.roster.select(F.col("id").alias("student_id"), "subject", "days_mask").filter("days_mask <> 0")
    joined = null_safe_join(t.cells, mask, ["student_id", "subject"], "inner", t.tasks)
    hits = joined.filter(predicates.scheduled_on("days_mask", dates.weekday_of("date"))).join(
        t.holidays.select("date"), "date", "left_anti"
    )
    return hits.groupBy(F.col("student_id").alias("id"), "subject").agg(F.count(F.lit(1)).alias("n_marked"))
