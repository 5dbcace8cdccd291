"""Sinks and streams, run to the end and read back."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollbook.catalog.registry import MONTH, YEAR, query
from rollbook.catalog.reports import _GRID_SQL, _class_counts
from rollbook.plans import records
from rollbook.plans.records import month_grid
from rollbook.session import run_dir
from rollbook.sinks import writers
from rollbook.streaming import jobs, undo



@query(
    "sink_csv_grid",
    "SELECT name AS \"Student Name\", korean_name AS \"Korean Name\", subject AS \"Subject\", teacher_name AS \"Teacher\", "
    + ", ".join(f"nullif(d{d:02d}, '') AS \"{d}\"" for d in range(1, 32))
    + f" FROM ({_GRID_SQL}) g",
)
def _(t):
    grid = writers.grid_columns(month_grid(t.marked, t.holidays, YEAR, MONTH), 31)
    path = f"{run_dir(t.spark, 'grid')}/{writers.csv_name(YEAR, MONTH)}"
    writers.write_csv(grid, path)
    return writers.read_csv(t.spark, path, grid.schema)


@query("sink_json_rows", "SELECT id, student_id, date, subject, status, notes FROM attendance WHERE NOT is_deleted")
def _(t):
    rows = t.attendance.filter("NOT is_deleted").select("id", "student_id", "date", "subject", "status", "notes")
    path = run_dir(t.spark, "json")
    writers.write_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query(
    "sink_json",
    """SELECT position, kind, teacher_id, teacher_name, n_students, total_classes, student_id, student_name, korean_name, subjects FROM (
 SELECT *, row_number() OVER (ORDER BY teacher_name, teacher_id NULLS LAST, kind DESC, student_name NULLS FIRST, student_id NULLS FIRST) AS position FROM (
  SELECT 'teacher' AS kind, teacher_id, teacher_name, count(DISTINCT student_id) AS n_students, CAST(sum(class_count) AS BIGINT) AS total_classes,
   CAST(NULL AS INT) AS student_id, CAST(NULL AS VARCHAR) AS student_name, CAST(NULL AS VARCHAR) AS korean_name, CAST(NULL AS VARCHAR) AS subjects FROM o_class_counts GROUP BY teacher_id, teacher_name
  UNION ALL SELECT 'student', teacher_id, teacher_name, NULL, CAST(sum(class_count) AS BIGINT), student_id, student_name, korean_name,
   string_agg(coalesce(subject, '-') || '=' || class_count, ',' ORDER BY subject NULLS FIRST) FROM o_class_counts GROUP BY teacher_id, teacher_name, student_id, student_name, korean_name) l) p""",
)
def _(t):
    lines, order = records.class_report(_class_counts(t))
    path = run_dir(t.spark, "report")
    writers.write_report(lines, order, path)
    back = writers.read_report(t.spark, path, StructType(lines.schema.fields))
    each = F.transform("subjects", lambda s: F.concat(F.coalesce(s["subject"], F.lit("-")), F.lit("="), s["class_count"].cast("string")))
    return back.select(
        "position", "kind", "teacher_id", "teacher_name", "n_students", "total_classes", "student_id", "student_name",
        "korean_name", F.array_join(each, ",").alias("subjects"),
    )


@query(
    "sink_upsert",
    """SELECT student_id, date, subject, status, notes FROM (SELECT *, row_number() OVER (PARTITION BY student_id, date, subject ORDER BY changed DESC, id DESC) AS rn FROM (
 SELECT id, student_id, date, subject, status, notes, updated_at AS changed FROM attendance UNION ALL SELECT seq, student_id, date, nullif(subject, ''), status, notes, changed_at FROM change_log) u) x WHERE rn = 1""",
)
def _(t):
    columns = ["id", "student_id", "date", "subject", "status", "notes", "updated_at"]
    path = run_dir(t.spark, "state")
    writers.write_month_partitions(t.attendance.select(*columns), path)
    changes = t.change_log.select(
        F.col("seq").alias("id"), "student_id", "date", F.nullif(F.col("subject"), F.lit("")).alias("subject"),
        "status", "notes", F.col("changed_at").alias("updated_at"),
    )
    writers.upsert_months(
        t.spark, path, changes, ["student_id", "date", "subject"], ["updated_at", "id"], "first"
    )
    return t.spark.read.parquet(path).select("student_id", "date", "subject", "status", "notes")


def _change_stream(t):
    """The change log as a stream over the event files."""
    raw = jobs.read_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema)
    return _as_changes(raw)


def _as_changes(raw):
    number = F.expr("CAST(substr(props, 7, length(props) - 7) AS INT) % 6")
    subjects = F.array(*[F.lit(s) for s in ("English", "Math", "Science", "Korean", "Art")])
    status = (
        F.when(F.col("event_type") == "error", "absent")
        .when(F.col("event_type") == "purchase", "ta")
        .when(F.col("event_type") == "signup", "noshow")
        .otherwise("present")
    )
    return raw.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("int").alias("student_id"),
        F.col("ts").cast("date").alias("date"), F.get(subjects, number).alias("subject"),
        status.alias("status"), (F.col("value") > 60).alias("is_delete"), F.col("ts").alias("updated_at"),
    )


def _applied(t):
    base = run_dir(t.spark, "changes")
    jobs.apply_changes(_change_stream(t), f"{base}/table", f"{base}/progress")
    return t.spark.read.parquet(f"{base}/table")


@query("st_apply_changes", "SELECT id, student_id, date, subject, status, is_deleted FROM attendance")
def _(t):
    return _applied(t).select("id", "student_id", "date", "subject", "status", F.col("is_delete").alias("is_deleted"))


@query("st_dedup", "SELECT id, student_id, date, subject, status FROM attendance_log")
def _(t):
    # every change arrives twice: the second stream is the retry of the first
    once, retry = _event_time(_change_stream(t)), _event_time(_change_stream(t))
    both = once.withColumn("copy", F.lit(0)).unionByName(retry.withColumn("copy", F.lit(1)))
    kept = jobs.drop_repeats(both, "id", "event_time", "1 hour", spread=F.col("copy"))
    base = run_dir(t.spark, "dedup")
    jobs.append_to(kept.select("id", "student_id", "date", "subject", "status"), f"{base}/out", f"{base}/progress")
    return t.spark.read.parquet(f"{base}/out")


def _event_time(changes):
    return changes.withColumn("event_time", F.col("updated_at").cast("timestamp"))


@query(
    "st_daily_status",
    """SELECT CAST(updated_at AS DATE) AS day, status, count(*) AS n FROM attendance_log WHERE CAST(updated_at AS DATE) + INTERVAL 1 DAY <= (SELECT max(updated_at) - INTERVAL 1 HOUR FROM attendance_log) GROUP BY 1, 2""",
)
def _(t):
    base = run_dir(t.spark, "daily")
    daily = jobs.daily_status(_event_time(_change_stream(t)), "event_time", "1 hour")
    jobs.append_to(daily, f"{base}/out", f"{base}/progress")
    return t.spark.read.parquet(f"{base}/out")


@query(
    "st_undo_window",
    """SELECT id, student_id, date, subject, event, strftime(deleted_at, '%Y-%m-%d %H:%M:%S') AS deleted_at, strftime(happened_at, '%Y-%m-%d %H:%M:%S') AS happened_at FROM (
 SELECT id, student_id, date, subject, deleted_at, unnest(['undoable', CASE WHEN written <= ends THEN 'undone' ELSE 'expired' END]) AS event,
  unnest([deleted_at, CASE WHEN written <= ends THEN written ELSE ends END]) AS happened_at FROM (
  SELECT id, student_id, date, subject, updated_at AS deleted_at, updated_at + INTERVAL 720 MINUTE AS ends, written FROM (
   SELECT *, coalesce(lag(is_delete) OVER k, FALSE) AS gone, min(CASE WHEN NOT is_delete THEN updated_at END) OVER (PARTITION BY student_id, date, subject ORDER BY updated_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS written
   FROM attendance_log WINDOW k AS (PARTITION BY student_id, date, subject ORDER BY updated_at, id)) w WHERE is_delete AND NOT gone) d) e
WHERE happened_at <= (SELECT max(updated_at) - INTERVAL 1 HOUR FROM attendance_log)""",
)
def _(t):
    base = run_dir(t.spark, "undo")
    events = undo.undo_events(
        _event_time(_change_stream(t)), keys=["student_id", "date", "subject"], event_time="event_time", minutes=720
    )
    undo.append_events(events, f"{base}/out", f"{base}/progress")
    return t.spark.read.parquet(f"{base}/out").select("id", "student_id", "date", "subject", "event", "deleted_at", "happened_at")


@query(
    "st_undo_recent",
    "SELECT id, student_id, date, subject, status FROM attendance WHERE is_deleted AND updated_at >= (SELECT max(updated_at) FROM attendance_log) - INTERVAL 720 MINUTE",
)
def _(t):
    table = _applied(t)
    newest = t.events.agg(F.max("ts")).scalar()
    return jobs.undoable(table, newest, 720).select("id", "student_id", "date", "subject", "status")
