"""Sinks that write once, order, split and count; contracts over a graph of references."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollbook.functions import days, names
from rollbook.functions import sql as sql_functions
from rollbook.operators import aggregates, changes, ordering
from rollbook.session import run_dir
from rollbook.sinks import writers
from rollbook.sources import contracts, readers

CELL = ["student_id", "date", "subject"]
STATE = "id long, student_id int, date date, subject string, status string, at int"


def rows_of(df):
    return sorted(map(str, df.collect()))


def months(spark, path):
    return {(r["year"], r["month"], r["id"], r["status"]) for r in spark.read.parquet(path).collect()}


def stored(spark, path):
    old = [(n, 1, dt.date(2024, m, 5), None, "present", 1) for n, m in enumerate((1, 2, 3, 4), 1)]
    writers.write_month_partitions(spark.createDataFrame(old, STATE), path)
    new = [(9, 1, dt.date(2024, 2, 5), None, "ta", 2), (8, 2, dt.date(2024, 3, 6), "x", "ta", 2), (7, 1, dt.date(2024, 7, 5), "x", "absent", 2)]
    return spark.createDataFrame(new, STATE)


WANT = {(2024, 1, 1, "present"), (2024, 2, 9, "ta"), (2024, 3, 3, "present"), (2024, 3, 8, "ta"), (2024, 4, 4, "present"), (2024, 7, 7, "absent")}


def test_upsert_writes_merged_months_once(spark, monkeypatch):
    path = run_dir(spark, "once")
    change = stored(spark, path)
    kept = {f for f in spark.read.parquet(path).inputFiles() if "month=1/" in f or "month=4/" in f}
    written, write = [], writers.write_month_partitions
    monkeypatch.setattr(writers, "write_month_partitions", lambda df, to: (written.append(to), write(df, to)))
    swap, staged = writers.swap_months, []

    def look(spark, made, to):
        files = spark.read.parquet(made).inputFiles()
        staged.extend(f.rpartition("/")[2] for f in files)
        swap(spark, made, to)

    monkeypatch.setattr(writers, "swap_months", look)
    writers.upsert_months(spark, path, change, CELL, ["at", "id"], "b")
    assert months(spark, path) == WANT
    assert written == [f"{path}.staging/b"]
    # the table's files are the staged ones themselves, and those of the other months
    assert sorted(f.rpartition("/")[2] for f in spark.read.parquet(path).inputFiles()) == sorted([*staged, *(f.rpartition("/")[2] for f in kept)])


def test_a_swap_killed_at_every_step(spark, monkeypatch):
    steps = ("_rename", "_touch", "remove_path")
    real = {name: getattr(writers, name) for name in steps}
    for n in range(30):
        path, calls = run_dir(spark, "killed"), 0
        change = stored(spark, path)

        def dying(name, n=n):
            def call(*args):
                nonlocal calls
                calls += 1
                if calls == n + 1:
                    raise RuntimeError("killed")
                return real[name](*args)

            return call

        for name in steps:
            monkeypatch.setattr(writers, name, dying(name))
        try:
            writers.upsert_months(spark, path, change, CELL, ["at", "id"], "b")
            ended = True
        except RuntimeError:
            ended = False
        for name in steps:
            monkeypatch.setattr(writers, name, real[name])
        # again; with other rows under the batch's name where a finished copy is there, which then counts
        if writers.path_exists(spark, f"{path}.staging/b/_STAGED"):
            change = change.withColumn("status", F.lit("noshow"))
        writers.upsert_months(spark, path, change, CELL, ["at", "id"], "b")
        assert months(spark, path) == WANT, n
        if ended:
            break
    assert ended and n >= 6


def test_positions_of_a_hot_value(spark):
    r = random.Random(1)
    data = [(r.choice([None, 1, 1, 1, 1, 2]), r.choice(["a", None, "b"]), i) for i in range(3000)]
    rows = spark.createDataFrame(data, "k int, s string, id int").repartition(6)
    order = [F.col("k").desc_nulls_last(), F.col("s").asc_nulls_first(), F.col("id").asc()]
    placed = ordering.with_position(rows, order, tasks=16)
    assert placed.columns == ["k", "s", "id", "position"]
    got = [tuple(x) for x in placed.orderBy("position").collect()]
    want = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, x[1] or "", x[2]))
    assert got == [(*x, n) for n, x in enumerate(want, 1)]
    path = run_dir(spark, "sorted")
    ordering.sorted_rows(rows, order, 16).write.parquet(path)
    sizes = [x["n"] for x in spark.read.parquet(path).groupBy(F.shiftright("_at", 33)).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 900  # the hot value is cut
    assert ordering.with_position(rows.limit(0), order).count() == 0


def test_chunks_of_a_hot_group(spark):
    data = [("hot", i, None if i % 7 else "x") for i in range(2500)] + [(None, i, "y") for i in range(12)] + [("one", 5, "z")]
    rows = spark.createDataFrame(data, "k string, id int, s string").repartition(5)
    got = aggregates.chunked_groups(rows, ["k"], "items", ["id", "s"], length=100).collect()
    assert {r["k"]: r["n_items"] for r in got} == {"hot": 2500, None: 12, "one": 1}
    for k in ("hot", None, "one"):
        chunks = sorted((r for r in got if r["k"] == k), key=lambda r: r["chunk"])
        assert [r["chunk"] for r in chunks] == list(range(len(chunks)))
        assert all(len(r["items"]) == 100 for r in chunks[:-1])
        assert [tuple(x) for r in chunks for x in r["items"]] == sorted((x[1:] for x in data if x[0] == k), key=lambda x: x[0])


@pytest.mark.parametrize("alike", [False, True])
def test_only_large_groups_are_sorted_as_a_whole(spark, monkeypatch, alike):
    seen = []

    def spy(rows, order, tasks=None):
        seen.append((rows.count(), rows.select(order[0]).dtypes[0][1], tasks))
        return ordering.with_position(rows, order, tasks)

    monkeypatch.setattr(aggregates, "with_position", spy)
    if alike:  # every key has the same hash
        monkeypatch.setattr(aggregates.F, "xxhash64", lambda *keys: F.lit(1).cast("long"))
    data = [(f"Teacher {i % 9}", None if i % 2 else i % 4, None if i % 50 == 3 else i // 3) for i in range(300)] + [("Teacher 0", 0, i) for i in range(90)]
    rows = spark.createDataFrame(data, "k string, d int, id int").repartition(5)
    for hot in (1000, 50):
        got = aggregates.chunked_groups(rows, ["k", "d"], "items", ["id"], length=4, tasks=5, hot=hot).collect()
        for k, d in {x[:2] for x in data}:
            chunks = sorted((r for r in got if (r["k"], r["d"]) == (k, d)), key=lambda r: r["chunk"])
            ids = sorted((x[2] for x in data if x[:2] == (k, d)), key=lambda i: (i is not None, i))
            assert [r["chunk"] for r in chunks] == list(range(len(chunks))) and {r["n_items"] for r in chunks} == {len(ids)}
            assert all(len(r["items"]) == 4 for r in chunks[:-1]) and [x["id"] for r in chunks for x in r["items"]] == ids
    assert seen == [(390 if alike else sum(x[:2] == ("Teacher 0", 0) for x in data), "bigint", 5)]


def test_report_lines_stand_in_order(spark):
    rows = spark.createDataFrame([(i % 50, i, [str(i)] * (i % 3)) for i in range(400)], "a int, b int, c array<string>")
    path = run_dir(spark, "lines")
    writers.write_report(rows, [F.col("a").desc(), F.col("b")], path)
    files = sorted(spark.read.json(path).inputFiles())
    texts = [x for f in files for x in [r["b"] for r in spark.read.json(f).coalesce(1).collect()]]
    want = [i for _, i in sorted((-(i % 50), i) for i in range(400))]
    assert texts == want
    back = writers.read_report(spark, path, StructType(rows.schema.fields)).orderBy("position").collect()
    assert [r["b"] for r in back] == want and [r["position"] for r in back] == list(range(1, 401))


def test_counts_of_a_write(spark):
    """Counted while written: the input is read once, and the marks are not stored."""
    rows = [(1, "deleted"), (2, None), (3, "deleted"), (6, "inserted")]
    path = run_dir(spark, "counted")
    got = writers.write_counted(spark.createDataFrame(rows, "id long, change string"), path)
    none = {"rows": 0, "sum": 0, "xor": 0}
    assert got == {"inserted": {"rows": 1, "sum": 6, "xor": 6}, "updated": none, "deleted": {"rows": 2, "sum": 4, "xor": 2}, "restored": none}
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 6]
    assert spark.read.parquet(path).columns == ["id"]
    table = run_dir(spark, "state")
    state = spark.createDataFrame(
        [(1, 1, dt.date(2024, 1, 10), None, "ta", None, False, None, None)],
        "id long, student_id int, date date, subject string, status string, notes string, is_deleted boolean, deleted_at timestamp_ntz, updated_at timestamp_ntz",
    )
    state.write.parquet(table)
    entries = spark.createDataFrame([(1, "")], "student_id int, subject string")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    after = changes.bulk_delete(spark.read.parquet(table), entries, dt.date(2024, 1, 10), at, mark="change")
    assert after._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert writers.write_counted(after, run_dir(spark, "after"))["deleted"] == {"rows": 1, "sum": 1, "xor": 1}


def test_cascade_walks_the_graph(spark):
    """Parents first; children of two parents; children of children; null and unknown references stay."""
    frame = spark.createDataFrame
    tables = {
        "leaf": frame([(1, 10), (2, 11), (3, 12), (4, None)], "id int, mid_id int"),
        "mid": frame([(10, 1, 7), (11, 2, 7), (12, 2, 8), (13, None, 8), (14, 99, 8)], "id int, a_id int, b_id int"),
        "a": frame([(1,), (2,)], "id int"), "b": frame([(7,), (8,)], "id int"),
    }
    graph = {"leaf": {"mid_id": "mid"}, "mid": {"a_id": "a", "b_id": "b"}}
    left = contracts.cascade(tables, {"a": tables["a"].where("id = 1"), "b": tables["b"].where("id = 7")}, graph)
    got = {name: sorted(r["id"] for r in df.collect()) for name, df in left.items()}
    assert got == {"a": [2], "b": [8], "mid": [12, 13, 14], "leaf": [3, 4]}
    untouched = contracts.cascade(tables, {}, graph)
    assert {name: df.count() for name, df in untouched.items()} == {"leaf": 4, "mid": 5, "a": 2, "b": 2}
    lost = contracts.orphan_counts(tables, graph).collect()
    assert [tuple(r) for r in lost] == [("mid", "a_id", 99, 1)]


def test_files_of_both_ages(spark):
    path = run_dir(spark, "ages")
    spark.createDataFrame([(1, 5)], "id int, amount int").write.parquet(path)
    spark.createDataFrame([(2, 7.5, "KRW"), (3, 8.0, None)], "id int, price double, currency string").write.mode("append").parquet(path)
    got = readers.read_evolved(spark, path, {"amount": "price"}, {"currency": "PHP"})
    assert sorted(tuple(r) for r in got.select("id", "price", "currency").collect()) == [(1, 5.0, "PHP"), (2, 7.5, "KRW"), (3, 8.0, None)]
    for lone, want in (([(1, 5)], "PHP"),):  # files of one age alone
        only = run_dir(spark, "old")
        spark.createDataFrame(lone, "id int, amount int").write.parquet(only)
        assert [tuple(r) for r in readers.read_evolved(spark, only, {"amount": "price"}, {"currency": "PHP"}).select("id", "price", "currency").collect()] == [(1, 5, want)]


def test_split_reads_one_half(spark):
    path = run_dir(spark, "split")
    checked = spark.createDataFrame([(1, ""), (2, "status"), (3, None)], "id int, violations string")
    writers.write_split(checked, "violations", path)
    halves = {v: writers.read_verdict(spark, path, StructType(checked.schema.fields), v) for v in ("passed", "quarantined")}
    assert {v: sorted(r["id"] for r in df.collect()) for v, df in halves.items()} == {"passed": [1, 3], "quarantined": [2]}
    plan = halves["passed"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(verdict" in plan
    assert Counter("verdict=passed" in f for f in halves["passed"].select("id").inputFiles())[True] >= 1


@pytest.mark.parametrize(("call", "column"), [
    ("identity_key(a, b, c)", lambda: names.identity_key("a", "b", "c")), ("days_parse(d)", lambda: days.days_parse("d")),
])
def test_sql_functions_are_their_bodies(spark, call, column):
    sql_functions.register(spark)
    sql_functions.register(spark)
    rows = spark.createDataFrame(
        [("p", "Ann", "k", "MTWThF"), (None, "Ann", None, "SuXSa"), (None, "BO", "보", ""), (None, None, "x", None)], "a string, b string, c string, d string"
    )
    by_name, inlined = spark.sql(f"SELECT a, {call} AS x FROM {{rows}}", rows=rows), rows.select("a", column().alias("x"))
    assert rows_of(by_name) == rows_of(inlined)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (by_name, inlined)]
    assert [p.count("Join") + p.count("Aggregate") for p in plans] == [0, 0]
    assert plans[0].split("LogicalRDD")[0].count("Project") == plans[1].split("LogicalRDD")[0].count("Project")
