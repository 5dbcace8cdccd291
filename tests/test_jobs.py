"""Streams, sinks, contracts and the shape of plans."""

import datetime as dt
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rollbook.catalog import views
from rollbook.catalog.outputs import _as_changes
from rollbook.catalog.registry import QUERIES, SQL, Tables
from rollbook.operators.compaction import latest_per_key
from rollbook.plans import records
from rollbook.session import run_dir, shared_dir
from rollbook.sinks import writers
from rollbook.sources import contracts, readers
from rollbook.streaming import jobs
from tests.parity import DATA, entry

SF = f"{DATA}/sf0.001"
CELL = ["student_id", "date", "subject"]


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def rows_of(df):
    return sorted(map(str, df.collect()))


def split_log(t, parts, order):
    """The event log written as several files, to be read in as many batches."""
    folder = run_dir(t.spark, "log")
    for n in order:
        t.events.filter(F.col("event_id") % parts == n).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_stream_equals_batch(spark, t, order):
    folder = split_log(t, 3, order)
    stream = _as_changes(jobs.read_stream(spark, folder, t.events.schema, files_per_batch=1))
    base = run_dir(spark, "applied")
    query = jobs.apply_changes(stream, f"{base}/table", f"{base}/progress")
    assert query.lastProgress["batchId"] >= 2
    got = spark.read.parquet(f"{base}/table").select(*CELL, "id", "status", "is_delete", "updated_at")
    want = latest_per_key(_as_changes(t.events), CELL, ["updated_at", "id"]).select(*got.columns)
    assert rows_of(got) == rows_of(want)
    # starting again finds nothing new and leaves the table alone
    jobs.apply_changes(stream, f"{base}/table", f"{base}/progress")
    assert rows_of(spark.read.parquet(f"{base}/table").select(*got.columns)) == rows_of(want)


def test_streams_read_a_table_as_a_file_or_a_folder(spark, t):
    single, folder = f"{run_dir(spark, 'file')}/events.parquet", f"{run_dir(spark, 'folder')}/events.parquet"
    t.events.repartition(3).write.parquet(folder)
    assert len(spark.read.parquet(folder).inputFiles()) == 3
    for name in ("st_apply_changes", "st_dedup", "st_daily_status", "st_undo_window", "st_undo_recent"):
        other = Tables(spark, folder.rpartition("/")[0])
        assert rows_of(QUERIES[name](other)) == rows_of(QUERIES[name](t)) != [], name
    for path in (single, run_dir(spark, "none")):
        spark.createDataFrame([(1,)], "x int").write.format("json").save(f"{path}.d/x.json")
        with pytest.raises(FileNotFoundError):
            jobs.read_stream(spark, f"{path}.d", t.events.schema)


@pytest.mark.parametrize("name", ["m_set", "m_bulk_set", "m_toggle", "m_holiday_set"])
def test_ids_stay_unique(t, name):
    ids = QUERIES[name](t).select("id")
    assert ids.distinct().count() == ids.count() and ids.where("id IS NULL").count() == 0


def test_derived_tables_grow_with_their_sources(spark, t):
    larger = Tables(spark, "/root/testdata/sf0.01")
    for name, source in (("student_notes", "documents"), ("student_subject_tuition", "part"), ("rate_changes", "part"), ("sparse_rates", "part"), ("teachers", "supplier")):
        small, large = (getattr(x, name) for x in (t, larger))
        keys = "name" if name == "teachers" else "student_id"
        times = getattr(larger, source).count() / getattr(t, source).count()
        assert large.count() / small.count() == pytest.approx(times, rel=0.05), name
        assert large.select(keys).distinct().count() / small.select(keys).distinct().count() == pytest.approx(times, rel=0.1), name


def test_second_stream_into_one_table(spark, t):
    base = run_dir(spark, "two")
    for n in (0, 1):
        folder = split_log(t, 2, [n])
        stream = _as_changes(jobs.read_stream(spark, folder, t.events.schema))
        jobs.apply_changes(stream, f"{base}/table", f"{base}/progress{n}")
    got = spark.read.parquet(f"{base}/table").select(*CELL, "id", "status", "is_delete", "updated_at")
    assert rows_of(got) == rows_of(latest_per_key(_as_changes(t.events), CELL, ["updated_at", "id"]).select(*got.columns))


def test_upsert_repeats_a_swap(spark, t):
    path = run_dir(spark, "upsert")
    old = t.attendance.select("id", *CELL, "status", "updated_at")
    writers.write_month_partitions(old, path)
    change = old.withColumn("status", F.lit("ta")).withColumn("updated_at", F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz"))
    writers.upsert_months(spark, path, change, CELL, ["updated_at", "id"], "b1")
    once = rows_of(spark.read.parquet(path))
    # the same batch again, as after a lost driver, takes the finished copy
    writers.upsert_months(spark, path, change.withColumn("status", F.lit("absent")), CELL, ["updated_at", "id"], "b1")
    assert rows_of(spark.read.parquet(path)) == once
    assert spark.read.parquet(path).filter("status <> 'ta'").count() == 0


def test_upsert_leaves_other_months(spark):
    path = run_dir(spark, "months")
    rows = [(1, 1, dt.date(2024, 1, 5), None, "present", 1), (2, 1, dt.date(2024, 2, 5), None, "present", 1)]
    schema = "id long, student_id int, date date, subject string, status string, at int"
    writers.write_month_partitions(spark.createDataFrame(rows, schema), path)
    before = {f for f in spark.read.parquet(path).inputFiles() if "month=1/" in f}
    change = spark.createDataFrame([(3, 1, dt.date(2024, 2, 5), None, "ta", 2), (4, 1, dt.date(2024, 3, 5), "x", "ta", 2)], schema)
    writers.upsert_months(spark, path, change, CELL, ["at", "id"], "b")
    table = spark.read.parquet(path)
    assert sorted((r["month"], r["status"]) for r in table.collect()) == [(1, "present"), (2, "ta"), (3, "ta")]
    assert before == {f for f in table.inputFiles() if "month=1/" in f}


def test_month_slice_prunes_partitions(spark):
    path = run_dir(spark, "pruned")
    rows = [(1, 1, dt.date(2024, m, 5)) for m in range(1, 7)]
    writers.write_month_partitions(spark.createDataFrame(rows, "id long, student_id int, date date"), path)
    plan = readers.month_slice(spark.read.parquet(path), 2024, 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*year.*month", plan) and "PushedFilters: [IsNotNull(date)" in plan


def test_daily_status_drops_late_rows(spark):
    folder = run_dir(spark, "late")
    schema = "updated_at timestamp, status string"
    batches = [
        [(dt.datetime(2024, 1, 1, 9), "present"), (dt.datetime(2024, 1, 1, 10), "present")],
        [(dt.datetime(2024, 1, 3, 9), "absent")],
        [(dt.datetime(2024, 1, 3, 10), "absent")],
        [(dt.datetime(2024, 1, 1, 11), "present"), (dt.datetime(2024, 1, 5), "ta")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    base = run_dir(spark, "daily")
    jobs.append_to(jobs.daily_status(stream), f"{base}/out", f"{base}/progress")
    got = {(str(r["day"]), r["status"]): r["n"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {("2024-01-01", "present"): 2, ("2024-01-03", "absent"): 2}


def test_repeats_are_dropped(spark):
    folder = run_dir(spark, "repeats")
    rows = [(i % 5, dt.datetime(2024, 1, 1, 0, i), i % 3) for i in range(30)]
    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, "id int, ts timestamp, copy int").coalesce(1).write.mode("append").parquet(folder)
    for spread in (None, F.col("copy")):
        stream = jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
        base = run_dir(spark, "dedup")
        jobs.append_to(jobs.drop_repeats(stream, "id", "ts", "2 hours", spread).select("id"), f"{base}/out", f"{base}/progress")
        assert sorted(r["id"] for r in spark.read.parquet(f"{base}/out").collect()) == [0, 1, 2, 3, 4]


def test_csv_quoting(spark):
    path = run_dir(spark, "csv")
    rows = [('a,"b"', "", " x ", None), ("plain", "two\nlines", 'say "hi"', "z")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").coalesce(1)
    writers.write_csv(df, path)
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    assert '"a,""b""",, x ,\n' in text and 'plain,"two\nlines","say ""hi""",z' in text
    back = [tuple(r) for r in writers.read_csv(spark, path, df.schema).collect()]
    assert back == [('a,"b"', None, " x ", None), ("plain", "two\nlines", 'say "hi"', "z")]
    assert writers.csv_name(2024, 3).endswith("_2024_03.csv")


def test_short_month_export_has_its_days(spark, t):
    grid = records.month_grid(t.marked, t.holidays, 2024, 1)
    assert len(writers.grid_columns(grid, 29).columns) == 33


def test_contracts_split_and_keep_all(spark, t):
    checked = contracts.check_domain(t.incoming)
    assert contracts.passed(checked, "violations").count() + contracts.quarantined(checked, "violations").count() == t.incoming.count()
    needed = contracts.check_required(t.incoming, ["student_id", "status"])
    assert contracts.passed(needed, "missing").filter("student_id = 0 OR status IS NULL OR status = ''").count() == 0


def test_columns_evolve_once(spark):
    old = spark.createDataFrame([(1, 5)], "student_id int, amount int")
    new = readers.rename_and_add(old, {"amount": "price_per_class"}, {"currency": "PHP"})
    assert new.columns == ["student_id", "price_per_class", "currency"]
    assert readers.rename_and_add(new, {"amount": "price_per_class"}, {"currency": "PHP"}).columns == new.columns


def test_shared_folder_follows_the_session(spark):
    assert run_dir(spark, "x").startswith(shared_dir(spark))

    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, key, default):
            return self.folder if key == "spark.checkpoint.dir" else default

    class Session:
        def __init__(self, folder):
            self.conf, self.sparkContext = Conf(folder), self
            self.master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    assert shared_dir(Session("hdfs://shared/folder/")) == "hdfs://shared/folder"
    with pytest.raises(RuntimeError):
        shared_dir(Session(None))


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("st_", "sink_"))])
def test_plans(spark, name):
    """No nested loops, no Python rows, no window without a partition, even without broadcasts."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    for bad in ("NestedLoop", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan
    # positions over all rows: one window over the sizes of the 102 percentages
    if name not in ("w_row_index", "o_topk_lowest"):
        assert not re.search(r"Window \[.*\n.*\n.*SinglePartition", plan)


def test_statements_name_only_known_tables():
    for name, sql in SQL.items():
        assert "{" not in sql.replace("{0}", "") or "{:" in sql, name
    assert set(views.BASE).isdisjoint(views.TABLES)


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "zstandard", "corpus_pipeline", "rollbook.llm"])
def test_entry_without_what_training_data_needs(missing):
    """Whatever the optional operators miss, the other queries are there."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    assert ran.stdout.split() == [str(len(QUERIES)), str(len(SQL))]
