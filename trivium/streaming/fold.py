"""The ticket log as a stream: last writers and conflicts of each field, however late an event comes.

State is held by ticket: for each field its changes in the order of the log,
in chunks, with an index of the chunks' first positions.  An event that comes
in order touches the last chunk; a late one the chunk that it belongs in.
Putting an event in changes two verdicts, its own and that of the event after
it, and the field's value if it is the last; these are what a batch gives out.
Events come in any order and more than once: position and identifier tell them
apart, so merging the logs of two branches is reading both.

Needs the RocksDB state store (``stateful`` sets it).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNK = 256
POSITION = "ms bigint, at bigint, id string"
OUTPUT = f"ticket string, field string, kind string, {POSITION}, value string, found string, conflict boolean"


def stateful(spark: SparkSession) -> None:
    """Have the session keep streaming state in RocksDB, which state of this kind needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Log:
    """The changes ``(ms, at, id, old, new)`` of one field, loaded chunk by chunk."""

    def __init__(self, field: str, index, chunks, size: int):
        self.field, self._index, self._chunks, self.size = field, index, chunks, size
        self.firsts = [tuple(x) for x in index.getValue((field,))[0]] if index.containsKey((field,)) else []
        self.loaded: dict[int, list[tuple]] = {}
        self.dirty: set[int] = set()

    def chunk(self, i: int) -> list[tuple]:
        name = self.firsts[i][3]
        if name not in self.loaded:
            self.loaded[name] = [tuple(x) for x in self._chunks.getValue((self.field, name))[0]]
        return self.loaded[name]

    def _new_chunk(self, at: int, events: list[tuple]) -> None:
        name = 1 + max((x[3] for x in self.firsts), default=-1)
        self.firsts.insert(at, (*events[0][:3], name))
        self.loaded[name] = events
        self.dirty.add(name)

    def place(self, position: tuple) -> tuple[int, int]:
        i = max(0, bisect_right([x[:3] for x in self.firsts], position) - 1)
        return i, bisect_left([x[:3] for x in self.chunk(i)], position)

    def insert(self, event: tuple) -> bool:
        """Put an event in its place; False if it is there already."""
        if not self.firsts:
            self._new_chunk(0, [event])
            return True
        i, j = self.place(event[:3])
        events = self.chunk(i)
        if j < len(events) and events[j][:3] == event[:3]:
            return False
        events.insert(j, event)
        name = self.firsts[i][3]
        self.dirty.add(name)
        self.firsts[i] = (*events[0][:3], name)
        if len(events) > 2 * self.size:
            self.loaded[name], rest = events[: self.size], events[self.size :]
            self._new_chunk(i + 1, rest)
        return True

    def around(self, position: tuple) -> tuple[tuple | None, tuple, tuple | None]:
        """The events before, at and after a position that is there."""
        i, j = self.place(position)
        events = self.chunk(i)
        before = events[j - 1] if j else self.chunk(i - 1)[-1] if i else None
        after = events[j + 1] if j + 1 < len(events) else self.chunk(i + 1)[0] if i + 1 < len(self.firsts) else None
        return before, events[j], after

    def last(self) -> tuple:
        return self.chunk(len(self.firsts) - 1)[-1]

    def save(self) -> None:
        for name in self.dirty:
            self._chunks.updateValue((self.field, name), (self.loaded[name],))
        self._index.updateValue((self.field,), (self.firsts,))


class FoldLog(StatefulProcessor):
    """Folds ``field, ms, at, id, old, new`` of one ticket; ``first`` holds what fields are before any event."""

    def __init__(self, first: dict[str, str] | None = None, chunk: int = CHUNK):
        self.first, self.size = first or {}, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "field string, chunk int", f"events array<struct<{POSITION.replace(' ', ':').replace(',:', ', ')}, old:string, new:string>>")
        self.index = handle.getMapState("index", "field string", f"firsts array<struct<{POSITION.replace(' ', ':').replace(',:', ', ')}, chunk:int>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ticket = key[0]
        fresh: dict[str, list[tuple]] = {}
        for r in rows:
            fresh.setdefault(r["field"], []).append((r["ms"], r["at"], r["id"], r["old"], r["new"]))
        for field, events in fresh.items():
            log = _Log(field, self.index, self.chunks, self.size)
            touched: set[tuple] = set()
            for e in sorted(events, key=lambda e: e[:3]):
                if log.insert(e):
                    touched.add(e[:3])
                    after = log.around(e[:3])[2]
                    if after is not None:
                        touched.add(after[:3])
            if not touched:
                continue
            for position in sorted(touched):
                before, e, _ = log.around(position)
                found = before[4] if before is not None else self.first.get(field)
                yield Row(ticket=ticket, field=field, kind="event", ms=e[0], at=e[1], id=e[2], value=e[4], found=found, conflict=e[3] != found)
            e = log.last()
            yield Row(ticket=ticket, field=field, kind="field", ms=e[0], at=e[1], id=e[2], value=e[4], found=None, conflict=None)
            log.save()

    def close(self) -> None:
        pass


def fold_log(changes: DataFrame, first: dict[str, str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Verdicts on the changes ``ticket, field, ms, at, id, old, new`` of a stream, to be written in update mode.

    A row of kind ``event`` replaces what was said of that event: what the
    field held before it (``found``) and whether it says otherwise
    (``conflict``); one of kind ``field`` replaces the field's ``value``.
    """
    rows = changes.select("ticket", "field", F.coalesce(F.col("ms").cast("long"), F.lit(-1)).alias("ms"), F.coalesce(F.unix_micros("at"), F.lit(-1)).alias("at"), "id", "old", "new")
    return rows.groupBy("ticket").transformWithState(FoldLog(first, chunk), OUTPUT, "Update", "None")


def settle(written: DataFrame, batch: str = "batch") -> tuple[DataFrame, DataFrame]:
    """The last word of all batches: fields ``ticket, field, value`` and conflicts ``ticket, field, id, found``."""
    last = written.groupBy("ticket", "field", "kind", F.when(F.col("kind") == "event", F.struct("ms", "at", "id")).alias("place")).agg(F.max_by(F.struct("id", "value", "found", "conflict"), batch).alias("l"))
    fields = last.filter("kind = 'field'").select("ticket", "field", "l.value")
    return fields, last.filter("kind = 'event' and l.conflict").select("ticket", "field", "l.id", "l.found")
