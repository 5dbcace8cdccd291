"""Hand-computed and brute-force cases of the operators and reports."""

import datetime as dt
import itertools
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rollbook.functions.dates import time12
from rollbook.catalog.registry import Tables
from rollbook.operators import aggregates, identity
from rollbook.operators.compaction import latest_per_key
from rollbook.operators.joins import null_safe_join
from rollbook.operators.ranking import row_index
from rollbook.operators.slots import merge_slots
from rollbook.operators.spread import join_few, spread, tasks_for
from rollbook.plans import billing, records, roster, schedule
from rollbook.schema import SCHEMAS, STATUSES
from rollbook.sources.calendar import calendar, weekly_dates


def table(spark, name, rows):
    """Rows given as dicts; missing columns are NULL."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def student(id, name="S", **more):
    return {"id": id, "name": f"{name}{id}" if name == "S" else name, "is_active": True, **more}


def school(spark, students, classes, teachers=("T1",), attendance=(), tuition=(), hidden=()):
    """classes: (weekday, subject, start, end, student ids, teacher ids)."""
    times = sorted({(c[2], c[3]) for c in classes})
    t = {
        "students": table(spark, "students", students),
        "teachers": table(spark, "teachers", [{"id": i + 1, "name": n, "is_active": True} for i, n in enumerate(teachers)]),
        "time_slots": table(
            spark, "time_slots", [{"id": i, "start_min": a, "end_min": b} for i, (a, b) in enumerate(times)]
        ),
        "assignments": table(
            spark, "assignments",
            [
                {"id": i, "date": c[0], "subject": c[1], "time_slot_id": times.index((c[2], c[3])), "is_active": True}
                for i, c in enumerate(classes)
            ],
        ),
        "assignment_students": table(
            spark, "assignment_students", [{"assignment_id": i, "student_id": s} for i, c in enumerate(classes) for s in c[4]]
        ),
        "assignment_teachers": table(
            spark, "assignment_teachers", [{"assignment_id": i, "teacher_id": x} for i, c in enumerate(classes) for x in c[5]]
        ),
        "attendance": table(spark, "attendance", list(attendance)),
        "tuition": table(spark, "student_subject_tuition", list(tuition)),
        "hidden": table(spark, "hidden_attendance_rows", list(hidden)),
    }
    t["slots"] = roster.schedule_slots(
        t["students"], t["teachers"], t["time_slots"], t["assignments"], t["assignment_students"], t["assignment_teachers"]
    )
    return t


def build(t, *month, **more):
    return roster.build_roster(t["slots"], t["students"], t["teachers"], t["tuition"], t["hidden"], *month, **more)


def no_remap(spark):
    return spark.createDataFrame([], "old_id int, canonical_id int")


# ---- slots ---------------------------------------------------------------------------------


def sequential_merge(slots, by_text):
    """The rule stated step by step on a sorted list of (start, end)."""
    def text(m):
        return f"{(m // 60 + 11) % 12 + 1:02d}:{m % 60:02d} {'AM' if m < 720 else 'PM'}"

    ordered = sorted(slots, key=(lambda s: (text(s[0]), text(s[1]))) if by_text else None)
    merged = [list(ordered[0])]
    for start, end in ordered[1:]:
        if merged[-1][1] == start:
            merged[-1][1] = end
        else:
            merged.append([start, end])
    return sorted(map(tuple, merged))


@pytest.mark.parametrize("by_text", [False, True])
def test_merge_slots_against_sequential(spark, by_text):
    rng = random.Random(3)
    groups = {}
    for g in range(60):
        pool = [(540 + 30 * i, 570 + 30 * i) for i in range(14)] + [(600, 660), (720, 720), (690, 750)]
        groups[g] = [rng.choice(pool) for _ in range(rng.randint(1, 12))]
    rows = [(g, 2, a, b) for g, slots in groups.items() for a, b in slots]
    df = spark.createDataFrame(rows, "g int, days int, start_min int, end_min int")
    counted = df.groupBy("g", "days", "start_min", "end_min").agg(F.count(F.lit(1)).alias("copies"))
    got = {}
    for r in merge_slots(counted, ["g"], legacy_text_order=by_text).collect():
        got.setdefault(r["g"], []).extend([(r["start_min"], r["end_min"])] * r["copies"])
    for g, slots in groups.items():
        assert sorted(got[g]) == sequential_merge(slots, by_text), (g, sorted(slots))


def test_merge_over_one_pm(spark):
    df = spark.createDataFrame([(1, 2, 750, 780, 1), (1, 2, 780, 810, 1)], "g int, days int, start_min int, end_min int, copies long")
    assert merge_slots(df, ["g"]).count() == 1
    assert merge_slots(df, ["g"], legacy_text_order=True).count() == 2


# ---- roster --------------------------------------------------------------------------------


def test_roster_rows(spark):
    t = school(
        spark,
        [student(1, "Ann", student_id="x1"), student(2, "Bo"), student(3, "Cy", is_active=False)],
        [
            ("Monday", "Math", 540, 570, [1], [2]),
            ("Wednesday", "Math", 540, 570, [1], [2]),
            ("Monday", "Math", 570, 600, [1], [1]),
            ("Wednesday", "Math", 570, 600, [1], [1]),
            ("Friday", None, 660, 690, [1, 3], []),
            ("Tuesday", "Art", 540, 570, [2], [1, 2]),
        ],
        teachers=("Zed", "Amy"),
        tuition=[{"student_id": 1, "subject": "Music"}, {"student_id": 1, "subject": "Math"}, {"student_id": 3, "subject": "Art"}],
        hidden=[{"student_id": 2, "subject": "Art", "hidden_from_year": 2024, "hidden_from_month": 2}],
    )
    rows = {(r["id"], r["subject"]): r for r in build(t, 2024, 1).collect()}
    assert set(rows) == {(1, "Math"), (1, None), (1, "Music"), (2, "Art")}
    math = rows[1, "Math"]
    assert math["teacher_name"] == "Amy" and math["schedule_time"] == "09:00 AM - 10:00 AM" and math["schedule_days"] == "MW"
    assert [(s["days"], s["time"], s["copies"]) for s in math["schedules"]] == [("MW", "09:00 AM - 10:00 AM", 1)]
    assert math["external_id"] == "x1" and math["row_key"] == "1-Math" and math["days_mask"] == 0b1010
    assert rows[1, None]["teacher_name"] is None and rows[1, None]["row_key"] == "1-default"
    assert rows[1, "Music"]["schedules"] == [] and rows[1, "Music"]["schedule_time"] is None
    # two teachers on one slot stay two schedules
    assert [(s["days"], s["copies"]) for s in rows[2, "Art"]["schedules"]] in ([("T", 2)], [("T", 1), ("T", 1)])
    assert {(r["id"], r["subject"]) for r in build(t, 2024, 2).collect()} == {(1, "Math"), (1, None), (1, "Music")}
    assert (2, "Art") not in {(r["id"], r["subject"]) for r in build(t).collect()}


def test_roster_hides_rows_without_subject(spark):
    t = school(spark, [student(1)], [("Monday", None, 540, 570, [1], [1])], hidden=[{"student_id": 1}])
    assert build(t, 2024, 1).count() == 0


def test_same_name_takes_lowest_id_per_slot(spark):
    t = school(
        spark,
        [student(4, "Dan", english_name="A"), student(7, "Dan", english_name="B")],
        [("Monday", "Math", 540, 570, [4, 7], [1]), ("Tuesday", "Art", 600, 630, [7], [1])],
    )
    rows = {r["subject"]: (r["id"], r["english_name"]) for r in build(t, 2024, 1).collect()}
    assert rows == {"Math": (4, "B"), "Art": (7, "B")}


def test_roster_canonical_option(spark):
    t = school(spark, [student(4, "Dan"), student(7, "Dan")], [("Tuesday", "Art", 600, 630, [7], [1])])
    slots = roster.schedule_slots(
        t["students"], t["teachers"], t["time_slots"], t["assignments"], t["assignment_students"],
        t["assignment_teachers"], canonical=spark.createDataFrame([(7, 4)], "id int, canonical_id int"),
    )
    t["slots"] = slots
    assert [r["id"] for r in build(t, 2024, 1).collect()] == [4]


def test_roster_sorts_a_students_rows_once(spark):
    """Counting copies, merging, nesting and the first row share one sort: each further one holds all rows again."""
    t = school(spark, [student(1)], [("Monday", "Math", 540, 570, [1], [1])])
    t["slots"] = t["slots"].localCheckpoint()
    plan = build(t, 2024, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [student_id") == 1 and "Generate" not in plan


def test_merged_slots_without_times(spark):
    """A missing start is kept by the slot that it begins; missing ends touch nothing; copies between stay alone."""
    rows = [(1, None, 540, 1), (1, 540, 570, 1), (1, 570, None, 1), (1, None, None, 2), (2, 540, 570, 4), (2, 570, 600, 1), (3, 600, 600, 5)]
    df = spark.createDataFrame(rows, "g int, start_min int, end_min int, copies long").withColumn("days", F.lit(2))
    got = sorted(map(repr, ((r["g"], r["start_min"], r["end_min"], r["copies"]) for r in merge_slots(df, ["g"]).collect())))
    want = [(1, None, None, 1), (1, None, None, 1), (1, None, None, 1), (2, 540, 570, 1), (2, 540, 570, 2), (2, 540, 600, 1), (3, 600, 600, 1)]
    assert got == sorted(map(repr, want))


# ---- identity ------------------------------------------------------------------------------


def remap_of(spark, students, with_class):
    classes = [("Monday", "Math", 540, 570, list(with_class), [1])]
    t = school(spark, students, classes)
    rows = identity.id_remap(t["students"], t["assignments"], t["assignment_students"]).collect()
    return {r["old_id"]: r["canonical_id"] for r in rows}


def test_canonical_id(spark):
    same = {"notion_page_id": "p"}
    people = [student(1, is_active=False, **same), student(5, **same), student(9, **same)]
    assert remap_of(spark, people, [9]) == {1: 9, 5: 9}
    assert remap_of(spark, people, []) == {1: 5, 9: 5}
    assert remap_of(spark, people, [1, 9]) == {1: 9, 5: 9}
    assert remap_of(spark, people, [1]) == {5: 1, 9: 1}


def test_remap_is_idempotent(spark):
    people = [student(i, "Same" if i % 3 else "Other") for i in range(1, 12)]
    remap = remap_of(spark, people, [4, 6])
    assert remap and not set(remap.values()) & set(remap)


def test_members_and_persons(spark):
    rows = table(spark, "students", [student(1, "A", notion_page_id="p"), student(2, "B", notion_page_id="p"),
                                     student(3, "C"), {"id": 4}, {"id": 5}])
    ids = spark.createDataFrame([(1,), (1,), (3,)], "student_id int")
    assert sorted(r["id"] for r in identity.identity_members(rows, ids).collect()) == [1, 2, 3]
    persons = {r["id"]: r["person_id"] for r in identity.person_ids(rows).collect()}
    assert persons == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_active_people_prefers_start_date(spark):
    rows = table(spark, "students", [student(1, "A", notion_page_id="p"),
                                     student(2, "B", notion_page_id="p", first_start_date=dt.date(2024, 1, 1)),
                                     student(3, "C", notion_page_id="p", first_start_date=dt.date(2020, 1, 1)),
                                     student(4, "D", is_active=False)])
    assert [r["id"] for r in identity.active_people(rows).collect()] == [2]


# ---- cells, percentages, grid --------------------------------------------------------------


def marks(student_id, subject, by_day, first_id=0):
    return [
        {"id": first_id + i, "student_id": student_id, "date": dt.date(2024, 1, d), "subject": subject, "status": s, "is_deleted": False}
        for i, (d, s) in enumerate(by_day.items())
    ]


def marked(spark, t, year=2024, month=1):
    month_records = records.month_records(t["attendance"], no_remap(spark), year, month)
    return records.roster_month(build(t, year, month), records.cells(month_records))


def holidays(spark, *days):
    return table(spark, "holidays", [{"id": d, "date": dt.date(2024, 1, d), "name": "H"} for d in days])


def test_percentage_of_marked_days(spark):
    # Mondays 1, 8, 15, 22, 29; the 29th is a holiday
    t = school(spark, [student(1)], [("Monday", "Math", 540, 570, [1], [1])],
               attendance=marks(1, "Math", {1: "present", 8: "present", 15: "absent", 22: "ta", 2: "absent", 29: "absent"}))
    got = records.pct_marked(marked(spark, t), holidays(spark, 29), 2024, 1).collect()
    assert [(r["subject"], r["pct"]) for r in got] == [("Math", 67)]


def test_percentage_of_scheduled_days(spark):
    t = school(spark, [student(1), student(2)], [("Monday", "Math", 540, 570, [1, 2], [1])],
               attendance=marks(1, "Math", {1: "present", 8: "absent", 15: "ta"}) + marks(2, "Math", {1: "ta", 8: "ta"}, 10))
    got = {r["id"]: r for r in records.scheduled_summary(marked(spark, t), holidays(spark, 29), 2024, 1).collect()}
    assert (got[1]["total_scheduled"], got[1]["percentage"]) == (4, 33)
    got = {r["id"]: r for r in records.scheduled_summary(marked(spark, t), holidays(spark, 15, 22, 29), 2024, 1).collect()}
    assert (got[2]["total_scheduled"], got[2]["ta_count"], got[2]["percentage"]) == (2, 2, None)


def test_no_schedule_counts_weekdays(spark):
    t = school(spark, [student(1)], [("Monday", "Math", 540, 570, [1], [1])],
               tuition=[{"student_id": 1, "subject": "Music"}])
    rows = {r["subject"]: r for r in records.scheduled_summary(marked(spark, t), holidays(spark), 2024, 1).collect()}
    assert rows["Music"]["total_scheduled"] == 23 and rows["Music"]["percentage"] == 0
    pct = {r["subject"]: r["pct"] for r in records.pct_marked(marked(spark, t), holidays(spark), 2024, 1).collect()}
    assert pct["Music"] is None


def test_summary_and_grid_against_loops(spark):
    rng = random.Random(11)
    names = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
    classes, plan = [], {}
    for s in range(1, 9):
        for subject in ("Math", None):
            chosen = rng.sample(names, rng.randint(1, 4))
            plan[s, subject] = {names.index(n) for n in chosen}
            classes += [(n, subject, 540, 570, [s], [1]) for n in chosen]
    attendance, i = [], 0
    for (s, subject), d in itertools.product(plan, range(1, 32)):
        if rng.random() < 0.5:
            i += 1
            attendance.append({"id": i, "student_id": s, "date": dt.date(2024, 1, d), "subject": subject,
                               "status": rng.choice(STATUSES), "is_deleted": rng.random() < 0.2})
    t = school(spark, [student(s) for s in range(1, 9)], classes, attendance=attendance)
    free = {5, 15, 25}
    live = {(a["student_id"], a["subject"], a["date"].day): a["status"] for a in attendance if not a["is_deleted"]}
    month = marked(spark, t)
    summary = {(r["id"], r["subject"]): r for r in records.scheduled_summary(month, holidays(spark, *free), 2024, 1).collect()}
    pct = {(r["id"], r["subject"]): r["pct"] for r in records.pct_marked(month, holidays(spark, *free), 2024, 1).collect()}
    grid = {(r["id"], r["subject"]): r for r in records.month_grid(month, holidays(spark, *free), 2024, 1).collect()}
    tally = {(r["id"], r["subject"]): r for r in records.row_tally(month).collect()}
    codes = {"present": "P", "absent": "A", "ta": "TA", "noshow": "N", None: ""}
    for key, weekdays in plan.items():
        counts, total, seen = dict.fromkeys(STATUSES, 0), 0, 0
        for d in range(1, 32):
            status = live.get((*key, d))
            assert grid[key][f"d{d:02d}"] == ("H" if d in free else codes[status])
            if d in free or (dt.date(2024, 1, d).weekday() + 1) % 7 not in weekdays:
                continue
            total += 1
            if status:
                counts[status] += 1
                seen += 1
        row = summary[key]
        assert row["total_scheduled"] == total and all(row[f"{s}_count"] == counts[s] for s in STATUSES)
        for whole, got in ((total - counts["ta"], row["percentage"]), (seen - counts["ta"], pct[key])):
            assert got == (int(counts["present"] / whole * 100 + 0.5) if whole > 0 else None)
            assert got is None or 0 <= got <= 100
        for s in STATUSES:
            assert tally[key][f"{s}_count"] == sum(1 for k, v in live.items() if k[:2] == key and v == s)


def test_cells_last_original_id_wins(spark):
    rows = spark.createDataFrame(
        [(1, 9, 2, "present"), (2, 9, 5, "absent"), (3, 9, 5, "ta"), (4, 9, 1, "noshow")],
        "id long, student_id int, original_id int, status string",
    ).withColumns({"date": F.lit(dt.date(2024, 1, 2)), "subject": F.lit(None).cast("string")})
    assert [r["status"] for r in records.cells(rows).collect()] == ["ta"]


def test_lowest_first_puts_null_first(spark):
    rows = spark.createDataFrame([(1, "a", 50), (2, "a", None), (3, "a", 20)], "id int, subject string, percentage long")
    got = {r["id"]: r["position"] for r in records.lowest_first(rows).collect()}
    assert len(got) == rows.count() and (got[2], got[3]) == (1, 2)


def test_month_slice_keeps_last_day(spark):
    rows = marks(1, "Math", {1: "present", 31: "absent"})
    got = records.student_summary(table(spark, "attendance", rows), (2024, 1)).collect()
    assert [(r["present_count"], r["absent_count"], r["total_records"]) for r in got] == [(1, 1, 2)]


# ---- counts --------------------------------------------------------------------------------


def test_class_counts_levels_and_filter(spark):
    t = school(spark, [student(1, "Ann [앤]"), student(2, "Bo")],
               [("Monday", "Math", 540, 570, [1], [1]), ("Monday", "Art", 600, 630, [2], [2])], teachers=("Amy", "Zed"),
               attendance=marks(1, "Math", {1: "present", 8: "ta"}) + marks(2, "Art", {1: "present"}, 5) + marks(99, None, {3: "present"}, 9))
    primary = billing.primary_teacher(t["students"], t["teachers"], t["assignments"], t["assignment_students"],
                                      t["assignment_teachers"], require_teacher=False)
    people = identity.active_people(t["students"])
    span = (dt.date(2024, 1, 1), dt.date(2024, 1, 31), ("present", "ta"))
    rows = records.class_counts(t["attendance"], primary, people, *span).collect()
    assert {(r["teacher_name"], r["class_count"]) for r in rows if r["level"] == 1} == {("Amy", 2), ("Zed", 1), ("Unknown Teacher", 1)}
    assert [r["class_count"] for r in rows if r["level"] == 2] == [4]
    assert {r["student_name"] for r in rows if r["level"] == 0} == {"Ann", "Bo", "Student 99"}
    for more in ({"teacher_id": 1}, {"teacher_name": "Amy"}):
        one = records.class_counts(t["attendance"], primary, people, *span, **more).collect()
        assert [r["class_count"] for r in one if r["level"] == 2] == [2]
        assert {r["student_id"] for r in one if r["level"] == 0} == {1}


def test_primary_teacher_ties(spark):
    t = school(spark, [student(1), student(2)],
               [("Monday", "Math", 540, 570, [1], [2, 1]), ("Tuesday", "Math", 540, 570, [2], []), ("Friday", "Math", 540, 570, [2], [3])],
               teachers=("A", "B", "C"))
    args = (t["students"], t["teachers"], t["assignments"], t["assignment_students"], t["assignment_teachers"])
    assert {r["student_id"]: r["teacher_id"] for r in billing.primary_teacher(*args).collect()} == {1: 1, 2: 3}
    loose = {r["student_id"]: r["teacher_id"] for r in billing.primary_teacher(*args, require_teacher=False).collect()}
    assert loose == {1: 1, 2: 3}


def test_schedule_matches_subject_plainly(spark):
    t = school(spark, [student(1)], [("Monday", "Math", 540, 570, [1], [1]), ("Monday", None, 600, 630, [1], [1])],
               attendance=marks(1, "Math", {8: "present"}) + marks(1, None, {8: "absent"}, 5))
    rows = schedule.teacher_schedule(dt.date(2024, 1, 8), dt.date(2024, 1, 14), t["students"], t["teachers"], t["time_slots"], t["assignments"],
                                     t["assignment_students"], t["assignment_teachers"], t["attendance"], teacher="T1")
    assert {(r["subject"], r["attendance_status"]) for r in rows.collect()} == {("Math", "present"), (None, None)}
    tally = schedule.schedule_tally(rows).filter("is_total").first()
    assert (tally["present_count"], tally["unmarked_count"], tally["total_count"]) == (1, 1, 2)
    assert sum(tally[f"{s}_count"] for s in STATUSES) + tally["unmarked_count"] == tally["total_count"]


# ---- money ---------------------------------------------------------------------------------


def test_tuition_against_per_row_loop(spark):
    t = school(spark, [student(i) for i in range(1, 6)],
               [("Monday", "Math", 540, 570, [1, 2], [1]), ("Tuesday", "Art", 540, 570, [1, 3], [2]),
                ("Friday", None, 540, 570, [3, 4, 5], [1])], teachers=("A", "B"),
               attendance=marks(1, "Math", {1: "present", 8: "present"}) + marks(3, "Art", {2: "present"}, 9),
               tuition=[{"student_id": 1, "subject": "Math", "price_per_class": Decimal(10), "currency": "KRW"},
                        {"student_id": 1, "subject": "Music", "price_per_class": Decimal(3), "currency": "PHP"},
                        {"student_id": 4, "subject": "Math", "price_per_class": Decimal(7), "currency": "PHP"},
                        {"student_id": 77, "subject": "Math", "price_per_class": Decimal(7), "currency": "PHP"}],
               hidden=[{"student_id": 1, "subject": "Music", "hidden_from_year": 2030, "hidden_from_month": 1}])
    pays = table(spark, "subject_tuition_payments",
                 [{"student_id": 1, "subject": "Math", "year": 2024, "month": 1, "paid": True}])
    listed = build(t)
    prices = {(r["student_id"], r["subject"]): (r["price_per_class"], r["currency"]) for r in t["tuition"].collect()}
    present = {1: 2, 3: 1}
    expected = {}
    for row in listed.collect():
        subjects = [s for (sid, s) in prices if sid == row["id"]]
        if row["subject"] and row["subject"] not in subjects:
            subjects.insert(0, row["subject"])
        for s in subjects or ["(No Subject)"]:
            expected.setdefault((row["id"], s), 0)
            expected[row["id"], s] += 1
    rows = billing.tuition(listed, t["tuition"], pays, t["attendance"], 2024, 1)
    got = {(r["student_id"], r["subject"]): r for r in rows.collect()}
    assert {k: r["copies"] for k, r in got.items()} == expected
    for (sid, s), r in got.items():
        price, currency = prices.get((sid, s), (Decimal(0), "PHP"))
        assert r["total_tuition"] == price * present.get(sid, 0) and r["currency"] == currency
        assert r["paid"] == ((sid, s) == (1, "Math"))
    summary = {r["currency"]: r for r in billing.tuition_summary(rows, fanout=True).collect()}
    assert summary["KRW"]["paid_count"] == expected[1, "Math"] and summary["KRW"]["total"] == 20.0 * expected[1, "Math"]
    assert summary[None]["n_rows"] == sum(expected.values())
    several = {r["student_id"] for r in billing.multi_subject_students(rows).collect()}
    assert several == {sid for sid in {k[0] for k in got} if sum(k[0] == sid for k in got) > 1}


def test_currency_summary(spark):
    rows = spark.createDataFrame(
        [("PHP", 10, 1, True), ("PHP", 0, 0, False), ("PHP", 5, 1, False), ("KRW", 7, 2, False)],
        "currency string, amount int, n int, paid boolean",
    )
    got = {r["currency"]: r for r in aggregates.currency_summary(rows, "amount", "n").collect()}
    assert (got["PHP"]["total"], got["PHP"]["paid"], got["PHP"]["unpaid"], got["PHP"]["unpaid_count"]) == (15.0, 10.0, 5.0, 1)
    for name in ("n_rows", "n_classes", "paid_count", "unpaid_count"):
        assert got[None][name] == got["PHP"][name] + got["KRW"][name]
    assert got[None]["is_total"] and got[None]["total"] is None


# ---- ranking, compaction -------------------------------------------------------------------


@pytest.mark.parametrize("width", [3, 1000])
def test_row_index(spark, width):
    rng = random.Random(5)
    rows = [(m, None if rng.random() < 0.2 else rng.randint(0, 4), i) for m in (1, 2) for i in rng.sample(range(100), 40)]
    df = spark.createDataFrame(rows, "m int, v int, id int")
    got = {(r["m"], r["id"]): r["position"] for r in row_index(df, ["m"], "v", "id", width).collect()}
    for m in (1, 2):
        ordered = sorted((r for r in rows if r[0] == m), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[m, r[2]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_latest_is_order_independent(spark):
    rows = [(k % 3 or None, t, f"v{t}") for t, k in enumerate(range(30))]
    a = spark.createDataFrame(rows, "k int, t int, v string")
    b = spark.createDataFrame(rows[::-1], "k int, t int, v string").repartition(7)
    first = sorted(map(tuple, latest_per_key(a, ["k"], ["t"]).collect()), key=str)
    assert first == sorted(map(tuple, latest_per_key(b, ["k"], ["t"]).collect()), key=str) and len(first) == 3


def test_nested_groups_stay_split(spark):
    df = spark.range(10).select(F.lit("t").alias("k"), (F.col("id") % 3).alias("b"), "id")
    rows = aggregates.nested_groups(df, ["k"], ["b"], "items", ["id"]).collect()
    assert len(rows) == 3 and sum(r["n_items"] for r in rows) == 10


def test_time_text_sorts_like_legacy(spark):
    df = spark.createDataFrame([(540,), (780,)], "m int").orderBy(time12("m"))
    assert [r["m"] for r in df.collect()] == [780, 540]


@pytest.mark.parametrize("start, end", [((2024, 1, 1), (2024, 1, 31)), ((2024, 2, 28), (2024, 3, 2)), ((2024, 5, 5), (2024, 5, 5))])
def test_weekly_dates(spark, start, end):
    span = dt.date(*start), dt.date(*end)
    weekdays = spark.range(7).select(F.col("id").cast("int").alias("weekday")).unionByName(
        spark.sql("SELECT CAST(NULL AS INT) AS weekday")
    )
    got = sorted(map(tuple, weekly_dates(weekdays, "weekday", *span).select("date", "weekday").collect()))
    assert got == sorted(map(tuple, calendar(spark, *span).select("date", "weekday").collect()))


def test_large_tables_are_dealt_to_more_tasks(spark):
    students = [student(i, korean_name="K" if i % 3 else None, english_name=f"E{i}") for i in range(1, 60)]
    classes = [(day, s, 600 + 30 * (i % 4), 630 + 30 * (i % 4), [1 + i % 59, 1 + i % 7], [1 + i % 3] * (i % 4 > 0))
               for i, (day, s) in enumerate(itertools.product(("Monday", "Friday"), ("Math", "Art", None, "") * 8))]
    prices = [{"student_id": i, "subject": s, "price_per_class": Decimal(i), "currency": "KRW"} for i in range(1, 70) for s in ("Math", "Drama")]
    marks = [{"id": i, "student_id": i % 60, "date": dt.date(2024, 1, 8), "subject": "Math", "status": "present", "is_deleted": False} for i in range(90)]
    t = school(spark, students, classes, ("T1", "T2", "T1"), marks, prices, [{"student_id": 3, "subject": "Math"}])
    pays = table(spark, "subject_tuition_payments", [{"student_id": 2, "subject": "Math", "year": 2024, "month": 1, "paid": True}])
    tables = [t[x] for x in ("students", "teachers", "time_slots", "assignments", "assignment_students", "assignment_teachers")]
    seen = []
    for tasks in (None, 37):
        t["slots"] = roster.schedule_slots(*tables, tasks=tasks)
        rows = build(t, 2024, 1, tasks=tasks)
        due = billing.tuition(rows, t["tuition"], pays, t["attendance"], 2024, 1, tasks=tasks)
        weekly = schedule.teacher_schedule(dt.date(2024, 1, 8), dt.date(2024, 1, 21), *tables, t["attendance"], tasks=tasks)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (t["slots"], rows, due, weekly)]
        assert [", 37), REPARTITION_BY_NUM" in p for p in plans] == [tasks is not None] * 4
        seen.append([sorted(map(repr, x.collect())) for x in (t["slots"], rows, due, weekly)])
    assert seen[0] == seen[1] and all(seen[0])


def test_identity_and_month_joins_are_dealt(spark):
    people = [student(i, "Same" if i % 4 == 0 else f"N{i}", korean_name="K" if i % 3 else None) for i in range(1, 40)]
    classes = [("Monday", s, 600, 660, [1 + i % 39, 1 + i % 5], [1]) for i, s in enumerate(("Math", "Art", None) * 9)]
    made = [m for i in range(1, 40) for m in marks(i, ("Math", None, "Art")[i % 3], {8: "present", 15: "ta"}, 10 * i)]
    t = school(spark, people, classes, ("T1",), made)
    links = [t[x] for x in ("students", "assignments", "assignment_students")]
    found, seen = build(t, 2024, 1), []
    for tasks in (None, 37):
        remap = identity.id_remap(*links, tasks)
        cells = records.cells(records.month_records(t["attendance"], remap, 2024, 1))
        month = records.roster_month(found, cells, tasks)
        marked_cells = null_safe_join(cells, found.select(F.col("id").alias("student_id"), "subject", "days_mask"), ["student_id", "subject"], "inner", tasks)
        frames = [remap, month, marked_cells]
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in frames]
        assert [", 37), REPARTITION_BY_NUM" in p for p in plans] == [tasks is not None] * 3
        assert [x.columns for x in frames] == [x.columns for x in (seen[-1][1] if seen else frames)]
        seen.append(([sorted(map(repr, x.collect())) for x in frames], frames))
    assert seen[0][0] == seen[1][0] and all(seen[0][0])
    assert any("subject=None" in r and "present_days=128" in r for r in seen[1][0][1])  # NULL meets NULL


def test_slots_join_is_not_dealt_by_the_slot_alone(spark):
    people = [student(i) for i in range(1, 20)]
    classes = [("Monday", s, 600, 660, [1 + i % 19], [1]) for i, s in enumerate(("Math", "Art", None) * 9)]
    t = school(spark, people, classes, ("T1",))
    tables = [t[x] for x in ("students", "teachers", "time_slots", "assignments", "assignment_students", "assignment_teachers")]
    weekly = schedule.teacher_schedule(dt.date(2024, 1, 8), dt.date(2024, 1, 21), *tables, t["attendance"], tasks=37)
    for made in (roster.schedule_slots(*tables, tasks=37), weekly):
        dealt = re.findall(r"hashpartitioning\((time_slot_id[^)]*)\)", made._jdf.queryExecution().executedPlan().toString())
        assert dealt and all("_lot" in d and d.endswith(", 37") for d in dealt)


def test_few_keys_are_joined_by_many_tasks(spark):
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else i % 3) for i in range(900)] + [(None, 1), (7, 1), (7, 1)], "id long, slot int")
    few = spark.createDataFrame([(0, "a"), (1, "b"), (1, "b"), (1, "c"), (None, "d"), (9, "e")], "slot int, name string")
    plain, dealt = (join_few(rows, few, tasks, "slot", "id") for tasks in (None, 16))
    assert plain.columns == dealt.columns
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, dealt.collect())) and plain.count() > 900
    one = rows.filter("slot = 1 AND id IS NOT NULL")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = join_few(one, few.hint("merge"), 16, "slot", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(held) > 4


def test_tasks_follow_the_rows(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 10 * few, width=10) is None and tasks_for(spark, 10 * few + 1, width=10) == few + 1
    assert tasks_for(spark, 0) is None and spread(spark.range(3), None, "id").columns == ["id"]
    assert tasks_for(spark, 216_000_000) == 432


def test_repeated_rows_are_removed_where_they_are_dealt(spark, tmp_path):
    spark.range(300).selectExpr("id % 40 AS l_orderkey", "id % 6 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    t.__dict__["tasks"] = 21
    plan = t.assignment_teachers._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and ", 21), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, t.assignment_teachers.collect())) == sorted({(i % 40, i % 6) for i in range(300)})
