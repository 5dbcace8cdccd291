"""Change batches against step-by-step application."""

import datetime as dt
import random

from pyspark.sql import functions as F

from rollbook.catalog import mutations  # noqa: F401  (registers)
from rollbook.catalog.registry import Tables, run
from rollbook.operators import changes
from rollbook.schema import KEYS, SCHEMAS, STATUSES
from tests.test_reports import table

DAY = dt.date(2024, 1, 8)


def at(minute):
    return dt.datetime(2024, 2, 1) + dt.timedelta(minutes=minute)


def record(id, student_id=1, subject="Math", status="present", deleted=False, **more):
    base = {"id": id, "student_id": student_id, "date": DAY, "subject": subject, "status": status, "notes": f"n{id}",
            "is_deleted": deleted, "deleted_at": at(-99) if deleted else None, "updated_at": at(-100)}
    return {**base, **more}


def batch(spark, rows):
    """(seq, student_id, subject[, status]) in time order."""
    full = [(r[0], r[1], DAY, r[2], r[3] if len(r) > 3 else "present", f"c{r[0]}", at(r[0])) for r in rows]
    return spark.createDataFrame(
        full, "seq long, student_id int, date date, subject string, status string, notes string, changed_at timestamp_ntz"
    )


def persons(spark, groups):
    return spark.createDataFrame([(i, g) for i, g in groups.items()], "id int, person_id int")


def by_cell(df):
    return {(r["student_id"], r["subject"]): r for r in df.collect()}


def test_set_updates_revives_and_inserts(spark):
    state = table(spark, "attendance", [record(1, status="absent", deleted=True), record(2, subject="Art"), record(3, subject=None)])
    new = changes.set_records(state, batch(spark, [(10, 1, "Math", "ta"), (11, 1, "Math", "noshow"), (12, 2, "", "ta"), (13, 1, None, "ta")]))
    got = by_cell(new)
    assert len(got) == 4 == new.count()
    math = got[1, "Math"]
    assert (math["id"], math["status"], math["notes"], math["is_deleted"], math["deleted_at"]) == (1, "noshow", "c11", False, None)
    assert got[1, "Art"]["notes"] == "n2" and got[2, None]["id"] == 15 and got[1, None]["id"] == 3
    assert new.schema.names == state.schema.names


def test_bulk_set_keeps_notes(spark):
    state = table(spark, "attendance", [record(1)])
    got = by_cell(changes.bulk_set_records(state, batch(spark, [(5, 1, "Math", "ta"), (6, 3, "Math", "ta")])))
    assert (got[1, "Math"]["status"], got[1, "Math"]["notes"], got[3, "Math"]["notes"]) == ("ta", "n1", None)


def test_null_subject_modes(spark):
    empty = table(spark, "attendance", [])
    twice = batch(spark, [(1, 1, None), (2, 1, None)])
    assert changes.set_records(empty, twice).count() == 1
    assert changes.set_records(empty, twice, null_subject_mode="distinct").count() == 2
    state = table(spark, "attendance", [record(7, subject=None)])
    assert changes.set_records(state, twice, null_subject_mode="distinct").count() == 3


def test_set_is_order_independent_and_replayable(spark):
    state = table(spark, "attendance", [record(i, student_id=i % 4) for i in range(1, 4)])
    rows = [(i, i % 4, random.Random(i).choice(["Math", "Art", None]), random.Random(i).choice(STATUSES)) for i in range(1, 40)]
    log = batch(spark, rows)
    whole = changes.set_records(state, log)
    halves = changes.set_records(changes.set_records(state, log.filter("seq % 2 = 0")), log.filter("seq % 2 = 1"))
    again = changes.set_records(whole, log)
    columns = ["student_id", "subject", "status", "notes", "is_deleted", "updated_at"]
    want = sorted(map(str, whole.select(*columns).collect()))
    assert sorted(map(str, halves.select(*columns).collect())) == want
    assert sorted(map(str, again.select(*columns).collect())) == want


def simulate_toggles(rows, toggles, person):
    """One toggle after another on a list of record dicts."""
    rows = [dict(r) for r in rows]
    for seq, student_id, subject in toggles:
        ids = {s for s, p in person.items() if p == person.get(student_id, student_id)} | {student_id}
        mine = [r for r in rows if r["student_id"] in ids and r["subject"] == subject]
        live = [r for r in mine if not r["is_deleted"]]
        if not live:
            target = next((r for r in mine if r["student_id"] == student_id), None)
            if target is None:
                target = {"id": seq, "student_id": student_id, "subject": subject}
                rows.append(target)
            target.update(status="present", is_deleted=False)
            continue
        current = max(live, key=lambda r: (r["student_id"], r["id"]))
        if current["student_id"] != student_id:
            rows = [r for r in rows if not (r is not current and r["student_id"] == student_id and r["subject"] == subject)]
            current["student_id"] = student_id
        if current["status"] == "noshow":
            for r in live:
                if r in rows:
                    r["is_deleted"] = True
        else:
            current["status"] = STATUSES[STATUSES.index(current["status"]) + 1]
    return {(r["student_id"], r["subject"], r["status"], r["is_deleted"]) for r in rows}


def test_toggle_cycle(spark):
    empty, nobody = table(spark, "attendance", []), persons(spark, {})
    for n, status in enumerate([*STATUSES, None], 1):
        got = changes.toggle_records(empty, batch(spark, [(i, 1, "Math") for i in range(n)]), nobody).collect()
        assert len(got) == 1 and (None if got[0]["is_deleted"] else got[0]["status"]) == status


def test_five_toggles_change_nothing_visible(spark):
    state = table(spark, "attendance", [record(1, status="ta"), record(2, student_id=2, subject=None, status="absent")])
    five = batch(spark, [(i, 1, "Math") for i in range(5)] + [(9 + i, 2, None) for i in range(5)])
    got = by_cell(changes.toggle_records(state, five, persons(spark, {})))
    assert {k: (r["status"], r["is_deleted"]) for k, r in got.items()} == {(1, "Math"): ("ta", False), (2, None): ("absent", False)}


def test_toggles_against_simulation(spark):
    rng = random.Random(8)
    person = {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    for _ in range(4):
        rows, i = [], 0
        for s in person:
            for subject in ("Math", None):
                if rng.random() < 0.5:
                    i += 1
                    rows.append(record(i, s, subject, rng.choice(STATUSES), rng.random() < 0.3))
        # one id per person and cell, as a user of one page sends them
        home = {(p, subject): rng.choice([s for s in person if person[s] == p]) for p in set(person.values()) for subject in ("Math", None)}
        toggles, seq = [], 100
        for _ in range(rng.randint(1, 14)):
            seq += 1
            (_, subject), s = rng.choice(sorted(home.items(), key=str))
            toggles.append((seq, s, subject))
        got = changes.toggle_records(table(spark, "attendance", rows), batch(spark, toggles), persons(spark, person))
        got = {(r["student_id"], r["subject"], r["status"], r["is_deleted"]) for r in got.collect()}
        assert got == simulate_toggles(rows, toggles, person), (rows, toggles)


def test_delete_then_undo_is_identity(spark):
    rows = [record(1), record(2, student_id=2), record(3, subject=None), record(4, student_id=3)]
    state, who = table(spark, "attendance", rows), persons(spark, {1: 1, 2: 1, 3: 3})
    asked = batch(spark, [(5, 1, "Math"), (6, 1, "Math"), (7, 1, "")])
    gone = changes.soft_delete(state, asked, who)
    flags = {r["id"]: (r["is_deleted"], r["deleted_at"]) for r in gone.collect()}
    assert flags == {1: (True, at(5)), 2: (True, at(5)), 3: (True, at(7)), 4: (False, None)}
    assert sorted(map(str, changes.undo_delete(gone, asked, who).collect())) == sorted(map(str, state.collect()))
    # without persons only the given id
    assert {r["id"] for r in changes.soft_delete(state, asked).collect() if r["is_deleted"]} == {1, 3}


def test_deleting_again_keeps_the_first_time(spark):
    state = table(spark, "attendance", [record(1, deleted=True)])
    assert changes.soft_delete(state, batch(spark, [(5, 1, "Math")])).first()["deleted_at"] == at(-99)


def test_bulk_delete_and_count(spark):
    state = table(spark, "attendance", [record(1), record(2, student_id=2, subject=None), record(3, subject="Art"), record(4, student_id=4, date=dt.date(2024, 1, 9))])
    entries = spark.createDataFrame([(1, "Math"), (2, ""), (4, "Math")], "student_id int, subject string")
    new = changes.bulk_delete(state, entries, DAY, F.lit(at(1)).cast("timestamp_ntz"))
    assert {r["id"] for r in new.collect() if r["is_deleted"]} == {1, 2}
    assert changes.affected(state, new, ["id"]).count() == 2
    assert changes.bulk_undo(new, entries, DAY, F.lit(at(2)).cast("timestamp_ntz")).filter("is_deleted").count() == 0


def test_rehome_prefers_live_then_highest_id(spark):
    state = table(spark, "attendance", [record(1, student_id=1), record(2, student_id=2, status="ta"), record(3, student_id=3, deleted=True)])
    remap = spark.createDataFrame([(2, 1), (3, 1)], "old_id int, canonical_id int")
    got = changes.rehome(state, remap).collect()
    assert [(r["student_id"], r["id"], r["status"]) for r in got] == [(1, 2, "ta")]


def payments(spark, rows):
    return spark.createDataFrame(rows, SCHEMAS["subject_tuition_payments"])


def test_payment_toggle(spark):
    keys = list(KEYS["subject_tuition_payments"])
    day = dt.datetime(2024, 1, 31, 9)
    state = payments(spark, [(1, "Math", 2024, 1, False, None, "x"), (2, "Math", 2024, 1, True, dt.date(2024, 1, 2), None), (4, "Math", 2024, 1, True, dt.date(2024, 1, 2), "k")])
    flips = spark.createDataFrame(
        [(s, "Math", 2024, 1, day) for s in (1, 2, 3, 3, 5)],
        "student_id int, subject string, year int, month int, changed_at timestamp_ntz",
    )
    got = {r["student_id"]: (r["paid"], r["payment_date"], r["notes"]) for r in changes.toggle_payments(state, flips, keys).collect()}
    assert got == {1: (True, day.date(), "x"), 2: (False, None, None), 3: (False, None, None),
                   4: (True, dt.date(2024, 1, 2), "k"), 5: (True, day.date(), None)}


def test_rates_subjects_and_unchanged(spark):
    rates = spark.createDataFrame([(1, "Math", 5, "KRW")], "student_id int, subject string, p int, currency string").selectExpr(
        "student_id", "subject", "CAST(p AS DECIMAL(10,2)) price_per_class", "currency")
    asked = spark.createDataFrame(
        [(1, "Math", 7.0, "USD", 1), (2, "Art", 2.5, None, 2)], "student_id int, subject string, price_per_class double, currency string, seq long"
    ).withColumn("changed_at", F.lit(at(1)))
    keys = KEYS["student_subject_tuition"]
    got = {r["student_id"]: (float(r["price_per_class"]), r["currency"]) for r in changes.set_rates(rates, asked, keys, "price_per_class").collect()}
    assert got == {1: (7.0, "PHP"), 2: (2.5, "PHP")}
    more = changes.add_subjects(rates, asked)
    assert {(r["student_id"], float(r["price_per_class"])) for r in more.collect()} == {(1, 5.0), (2, 0.0)}
    left, paid = changes.delete_subjects(more, payments(spark, [(1, "Math", 2024, 1, True, None, None)]), asked.filter("student_id = 1"))
    assert left.count() == 1 and paid.count() == 0
    same = asked.withColumn("currency", F.lit("KRW"))
    assert [r["student_id"] for r in changes.skip_unchanged(same, rates, keys, ["currency"]).collect()] == [2]


def test_a_change_of_price_alone_is_kept(spark):
    sf = "/root/testdata/sf0.01"
    stored = Tables(spark, sf).student_subject_tuition
    keys = ["student_id", "subject"]
    same_currency = Tables(spark, sf).rate_changes.join(stored.select(*keys, "currency"), [*keys, "currency"], "left_semi").select("seq")
    kept = {r["seq"] for r in run("m_skip_unchanged_rate", spark, sf).collect()}
    asked = {r["seq"] for r in same_currency.collect()}
    assert asked and asked <= kept
    # what is stored already is dropped
    assert stored.count() and not any(seq < 0 for seq in kept)


def test_notes_holidays_and_hiding(spark):
    notes = table(spark, "student_notes", [{"student_id": 1, "year": 2024, "month": 1, "subject": None, "notes": "old"}])
    asked = spark.createDataFrame(
        [(1, 2024, 1, "", "a", 1), (1, 2024, 1, None, None, 2), (1, 2024, 2, "Math", "b", 3)],
        "student_id int, year int, month int, subject string, notes string, seq long",
    ).withColumn("changed_at", F.lit(at(1)))
    got = {(r["month"], r["subject"]): r["notes"] for r in changes.set_notes(notes, asked).collect()}
    assert got == {(1, None): "", (2, "Math"): "b"}
    free = table(spark, "holidays", [{"id": 1, "date": DAY, "name": "old"}])
    named = spark.createDataFrame([(DAY, "new", 5), (dt.date(2024, 5, 1), None, 6)], "date date, name string, seq long").withColumn("changed_at", F.lit(at(1)))
    after = changes.set_holidays(free, named)
    assert {(r["id"], r["name"]) for r in after.collect()} == {(1, "new"), (7, "")}
    assert changes.delete_holidays(after, spark.createDataFrame([(7,)], "id int")).count() == 1
    hidden = table(spark, "hidden_attendance_rows", [{"student_id": 1, "subject": None, "hidden_from_year": 2023, "hidden_from_month": 5}])
    rows = spark.createDataFrame(
        [(1, "", None, None, 1), (2, "Art", 2025, 2, 2)], "student_id int, subject string, hidden_from_year int, hidden_from_month int, seq long"
    ).withColumn("changed_at", F.lit(at(1)).cast("timestamp_ntz"))
    now = changes.hide_rows(hidden, rows, dt.date(2024, 3, 9))
    assert {(r["student_id"], r["hidden_from_year"], r["hidden_from_month"]) for r in now.collect()} == {(1, 2024, 3), (2, 2025, 2)}
    shown = changes.unhide_rows(now, spark.createDataFrame([(1, "")], "student_id int, subject string"))
    assert [r["student_id"] for r in shown.collect()] == [2]
