"""The undo window as a stream: keyed state with event-time timers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import islice, repeat

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from rollbook.streaming import jobs

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timer(micros: int) -> int:
    """The millisecond that is not before this microsecond."""
    return -(-micros // 1000)


class UndoWindow(StatefulProcessor):
    """For the cells of a group: the writes that the watermark has not passed yet, and the deletes that hold.

    A write is judged when the watermark passes its time, so arrival order does not matter. One timer waits for the first
    time at which there is something to judge. Times are microseconds, so no time zone matters. Each call to the state is
    a round trip, so the writes of a batch are one value in columns, and so are the group's deletes.
    """

    def __init__(self, keys: Sequence[str], minutes: int):
        self.keys, self.window = list(keys), minutes * 60_000_000
        self.event = Row(*self.keys, "event", "id", "deleted_at", "happened_at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros array<long>, number array<long>, gone array<boolean>, cells binary")
        self.deleted = handle.getValueState("deleted", "held binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        writes = (
            (row["micros"], row["number"], row["gone"], tuple(row[k] for k in self.keys)) for row in rows if _timer(row["micros"]) > passed
        )  # else its time is judged already
        while some := list(islice(writes, _MOST)):
            self.waiting.appendValue(_columns(some))
            least = min(x[0] for x in some)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(_timer(first))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        # all that the watermark has passed: a timer set from here would wait for the next batch
        now = timerValues.getCurrentWatermarkInMs()
        due: dict[tuple, list[tuple]] = {}
        later = []
        for micros, number, gone, *cells in self.waiting.get():
            # without cells the group is one
            cells = pickle.loads(cells[0]) if cells else repeat(())
            for write in zip(*(x if isinstance(x, list) else [x] for x in (micros, number, gone)), cells):
                if _timer(write[0]) <= now:
                    due.setdefault(write[3], []).append(write[:3])
                else:
                    later.append(write)
        if due:
            if later:
                self.waiting.put([_columns(later[i : i + _MOST]) for i in range(0, len(later), _MOST)])
            else:
                self.waiting.clear()
        packed = self.deleted.get()
        deleted = pickle.loads(packed[0]) if packed else {}
        changed = False
        ends = [cell for cell, held in deleted.items() if held[2] and _timer(held[0] + self.window) <= now and cell not in due]
        for cell in (*due, *ends):
            held = before = deleted.get(cell)
            for micros, number, gone in sorted(due.get(cell, ())):
                if held and held[2] and micros > held[0] + self.window:
                    yield self._event(cell, "expired", held, held[0] + self.window)
                    held = (*held[:2], False)
                if not gone:
                    if held and held[2]:
                        yield self._event(cell, "undone", held, micros)
                    held = None
                elif held is None:
                    held = (micros, number, True)
                    yield self._event(cell, "undoable", held, micros)
            if held and held[2] and _timer(held[0] + self.window) <= now:
                yield self._event(cell, "expired", held, held[0] + self.window)
                held = (*held[:2], False)
            if held != before:
                changed = True
                if held is None:
                    del deleted[cell]
                else:
                    deleted[cell] = held
        if changed:
            if deleted:
                self.deleted.update((pickle.dumps(deleted, pickle.HIGHEST_PROTOCOL),))
            else:
                self.deleted.clear()
        next_ones = [x[0] for x in later] + [held[0] + self.window for held in deleted.values() if held[2]]
        if next_ones:
            self.handle.registerTimer(_timer(min(next_ones)))

    def _event(self, cell: tuple, event: str, held: tuple, at: int) -> Row:
        return self.event(*cell, event, held[1], held[0], at)


#: Writes of one value of the state.
_MOST = 10_000


def _columns(writes: list[tuple]) -> tuple[list, list, list, bytes]:
    micros, number, gone, cells = (list(x) for x in zip(*writes, strict=True))
    return micros, number, gone, pickle.dumps(cells, pickle.HIGHEST_PROTOCOL)


def undo_events(
    changes: DataFrame, *, keys: Sequence[str], event_time: str, number: str = "id", delete_flag: str = "is_delete",
    minutes: int = 30, delay: str = "1 hour", groups: int = 4096,
) -> DataFrame:
    """What happens to the deletes of a change stream: ``undoable`` when a cell is deleted, ``undone`` when it is written
    again within ``minutes``, ``expired`` when nothing was, each once, with the number and time of the delete.

    A delete of a deleted cell changes nothing. Writes of one time are taken by number. An event is emitted when the
    watermark, ``delay`` behind the newest write, has passed it, so late and reordered writes give the same events; a write
    behind the watermark is dropped. The state is the writes of the last ``delay`` and one entry per deleted cell, kept
    for ``groups`` of cells, by a hash of their keys: calls to the state follow the groups, not the writes. A batch writes
    the deletes of the groups that it changes, so many small batches over very many deleted cells ask for more groups; a
    checkpoint keeps its number.
    """
    micros = F.unix_micros(F.col(event_time).cast("timestamp"))
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("_cells_group")
    marked = changes.withWatermark(event_time, delay).select(
        group, *keys, micros.alias("micros"), F.col(number).cast("long").alias("number"), F.col(delete_flag).alias("gone")
    )
    fields = [*(T.StructField(f.name, f.dataType) for f in marked.select(*keys).schema.fields), T.StructField("event", T.StringType())]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in ("id", "deleted_at", "happened_at"))])
    events = marked.groupBy("_cells_group").transformWithState(UndoWindow(keys, minutes), schema, "Append", "EventTime")
    return events.withColumns({c: F.timestamp_micros(c) for c in ("deleted_at", "happened_at")})


def append_events(events: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append the events to a Parquet folder. Timers need the RocksDB state store; other streams keep theirs."""
    conf = events.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        return jobs.append_to(events, path, checkpoint, interval)
    finally:
        conf.set(_PROVIDER, before)
