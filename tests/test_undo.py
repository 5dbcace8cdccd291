"""The undo window over several micro-batches against a replay of all writes."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rollbook.session import run_dir
from rollbook.streaming import jobs, undo

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "cell int, subject string, id long, at timestamp, is_delete boolean"
MINUTES, DELAY = 30, 60


def replay(writes, watermark):
    """Events up to the watermark, one cell after the other."""
    out = []
    for key in {w[:2] for w in writes}:
        held = None
        for _, _, number, at, gone in sorted((w for w in writes if w[:2] == key), key=lambda w: (w[3], w[2])):
            if held and not gone:
                out.append((*key, "undone", *held, at) if at <= held[1] + MINUTES else (*key, "expired", *held, held[1] + MINUTES))
                held = None
            elif gone and not held:
                held = (number, at)
                out.append((*key, "undoable", *held, at))
        if held:
            out.append((*key, "expired", *held, held[1] + MINUTES))
    return sorted((e for e in out if e[-1] <= watermark), key=str)


def minutes(time):
    return int((time.replace(tzinfo=dt.timezone.utc) - START).total_seconds() // 60)


@pytest.mark.parametrize("seed", [1, 2])
def test_events_at_every_watermark(spark, seed):
    r = random.Random(seed)
    writes = [(r.randint(0, 7), r.choice(["Math", None]), n, 7 * n + r.randint(0, 40), r.random() < 0.6) for n in range(160)]
    writes += [(1, "Math", 900, 400, True), (1, "Math", 901, 400, False), (1, "Math", 901, 400, False)]  # one time; a retry
    writes.sort(key=lambda w: w[3] + r.randint(-50, 50))  # out of order, within the delay
    parts = [writes[i * 33 : (i + 1) * 33] for i in range(5)]
    parts[3].append((0, "Math", 1000, 5, True))  # long behind the watermark
    base, seen, newest, batches = run_dir(spark, "undo"), [], -1, 0
    for n, part in enumerate(parts):
        limit = newest - DELAY
        seen += [w for w in part if w[3] > limit]
        rows = [(c, s, i, START + dt.timedelta(minutes=at), gone) for c, s, i, at, gone in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = jobs.read_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
        events = undo.undo_events(stream, keys=["cell", "subject"], event_time="at", minutes=MINUTES, delay=f"{DELAY} minutes")
        # each run starts again from the checkpoint of the one before
        query = undo.append_events(events, f"{base}/out", f"{base}/progress")
        batches = query.lastProgress["batchId"]
        newest = max(newest, *(w[3] for w in part))
        got = [
            (e["cell"], e["subject"], e["event"], e["id"], minutes(e["deleted_at"]), minutes(e["happened_at"]))
            for e in spark.read.parquet(f"{base}/out").collect()
        ]
        assert sorted(got, key=str) == replay(seen, newest - DELAY), n
    assert batches >= 5 and {e[2] for e in got} == {"undoable", "undone", "expired"}
    # the files again, to a new checkpoint, three in one batch: the same events, but for the late row, which is in time here
    again = run_dir(spark, "undo")
    stream = jobs.read_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, files_per_batch=100)
    events = undo.undo_events(stream, keys=["cell", "subject"], event_time="at", minutes=MINUTES, delay=f"{DELAY} minutes")
    undo.append_events(events, f"{again}/out", f"{again}/progress")
    whole = [(e["cell"], e["subject"], e["event"], e["id"], minutes(e["deleted_at"]), minutes(e["happened_at"])) for e in spark.read.parquet(f"{again}/out").collect()]
    assert sorted(whole, key=str) == replay([w for p in parts for w in p], newest - DELAY)


def test_other_streams_keep_their_state_store(spark):
    before = spark.conf.get(undo._PROVIDER)
    with pytest.raises(Exception):  # noqa: B017  (not a stream)
        undo.append_events(spark.range(1).withColumn("at", F.current_timestamp()), "x", "y")
    assert spark.conf.get(undo._PROVIDER) == before


def test_a_write_to_a_cell_that_is_not_deleted_asks_the_state_once():
    """Every call to the state is a round trip: one read of each state, one clear of the writes that are judged."""
    calls = []

    class State:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def __getattr__(self, call):
            return lambda *a: calls.append(f"{self.name}.{call}") or self.value

    window = undo.UndoWindow(["k"], 30)
    window.waiting, window.deleted = State("waiting", [(1000, 1, False)]), State("deleted", None)
    assert list(window.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 5), None)) == []
    assert calls == ["waiting.get", "waiting.clear", "deleted.get"]


def test_calls_to_the_state_follow_the_groups():
    """The cells of a group share their state: one value for the writes of a batch, one for the deletes, one timer."""
    calls, kept = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def f(*a):
                calls.append(f"{self.name}.{call}")
                if call in ("put", "update", "appendValue"):
                    kept[self.name] = {"put": list, "update": tuple, "appendValue": lambda x: [x]}[call](*a)
                return kept.pop(self.name, None) if call == "clear" else kept.get(self.name, [] if self.name == "waiting" else None)

            return f

    window = undo.UndoWindow(["k", "s"], 30)
    window.waiting, window.deleted, window.handle = State("waiting"), State("deleted"), State("handle")
    minute = 60_000_000
    rows = [{"k": i, "s": None, "micros": minute * (i % 3 + 1), "number": i, "gone": i % 2 == 0} for i in range(100)]
    rows += [{"k": 0, "s": None, "micros": 500 * minute, "number": 100, "gone": False}]
    at = lambda minutes: SimpleNamespace(getCurrentWatermarkInMs=lambda: minutes * 60_000)
    assert list(window.handleInputRows((7,), iter(rows), at(0))) == []
    assert calls == ["waiting.appendValue", "handle.registerTimer"]
    calls.clear()
    events = [tuple(e) for e in window.handleExpiredTimer((7,), at(10), None)]
    assert sorted(events) == sorted((i, None, "undoable", i, minute * (i % 3 + 1), minute * (i % 3 + 1)) for i in range(0, 100, 2))
    assert calls == ["waiting.get", "waiting.put", "deleted.get", "deleted.update", "handle.registerTimer"]
    calls.clear()
    events = [tuple(e)[:4] for e in window.handleExpiredTimer((7,), at(600), None)]
    assert sorted(events) == [(i, None, "expired", i) for i in range(0, 100, 2)]
    assert calls == ["waiting.get", "waiting.clear", "deleted.get", "deleted.update"]
