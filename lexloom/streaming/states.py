"""The state of sessions over a stream of updates: reducers by field, pauses with their answers, and a time to live.

Updates may come in any order and in any batches: what is given out depends on them alone. A session
keeps a row for each field, for each pause and for the newest entries of each list, so its state
doesn't grow with its length, and a batch writes only the rows that it touches and the ``TOGETHER``
newest pauses, which are read and written in one call. Whole lists are the
input itself. A stream with repeats passes ``dropDuplicatesWithinWatermark`` first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What an update does: the newest value of a field, a sum, an entry of a list, an end to the entries so
#: far, a question that waits, and its answer.
OPS = ["set", "add", "append", "clear", "pause", "resume"]
#: So many pauses of a session lie together; where there are more, each gets an entry of its own.
TOGETHER = 64
COLUMNS = ["kind", "field", "slot", "turn", "value"]
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _order(value: tuple) -> tuple:
    """Tuples with nulls, which come first."""
    return tuple((v is not None, v) if v is not None else (False,) for v in value)


class Session(StatefulProcessor):
    """One session's rows: see :func:`states`."""

    def __init__(self, window: int, live_ms: int) -> None:
        self.window, self.live_ms = window, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getMapState("newest", "field string", "turn long, value string")
        self.sums = handle.getMapState("sums", "field string", "total long")
        self.floors = handle.getMapState("floors", "field string", "turn long")
        self.pauses = handle.getMapState("pauses", "id string", "asked long, resumed long, value string, resumes long")
        self.latest = handle.getListState("latest", "id string, asked long, resumed long, value string, resumes long")
        self.entries = handle.getListState("entries", "field string, turn long, part long, value string")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, newest, sums, floors, entries, asked, resumed, resumes = 0, {}, {}, {}, {}, {}, {}, {}
        for chunk in rows:
            if chunk.empty:
                continue
            last = max(last, int(chunk["ms"].max()))
            for op, field, turn, part, value in zip(chunk["op"], chunk["field"], chunk["turn"].tolist(), chunk["part"].tolist(), chunk["value"]):
                if op == "set":
                    newest[field] = max(newest.get(field, (turn, value)), (turn, value), key=_order)
                elif op == "add":
                    sums[field] = sums.get(field, 0) + int(value or 0)
                elif op == "append":
                    entries.setdefault(field, []).append((turn, part, value))
                    if len(entries[field]) > 64 * self.window:
                        entries[field] = self._newest(entries[field])
                elif op == "clear":
                    floors[field] = max(floors.get(field, turn), turn)
                elif op == "pause":
                    asked[field] = min(asked.get(field, turn), turn)
                elif op == "resume":
                    resumes[field] = resumes.get(field, 0) + 1
                    resumed[field] = min(resumed.get(field, (turn, value)), (turn, value), key=_order)
        due = self.due.get()
        known = due is not None  # of a new session nothing is asked: each call to the store takes its time
        out = [*self._fields(newest, sums, known), *self._lists(entries, floors, known), *self._questions(asked, resumed, resumes, known)]
        self._postpone(last, due)
        yield self._frame(key, out)

    def _newest(self, entries: list[tuple]) -> list[tuple]:
        return sorted(entries, key=_order, reverse=True)[: self.window]

    def _fields(self, newest: dict, sums: dict, known: bool) -> Iterator[tuple]:
        for field, found in newest.items():
            held = self.newest.getValue((field,)) if known else None
            if held is None or _order(tuple(held)) < _order(found):
                self.newest.updateValue((field,), found)
                yield "last", field, "", *found
        for field, more in sums.items():
            held = self.sums.getValue((field,)) if known else None
            total = more + (held[0] if held is not None else 0)
            self.sums.updateValue((field,), (total,))
            yield "sum", field, "", None, str(total)

    def _lists(self, entries: dict, floors: dict, known: bool) -> Iterator[tuple]:
        if not entries and not floors:
            return
        held: dict[str, list[tuple]] = {}
        for field, *entry in self.entries.get() if known else []:
            held.setdefault(field, []).append(tuple(entry))
        for field in {*entries, *floors}:
            floor = [floors[field]] if field in floors else []
            before = self.floors.getValue((field,)) if known else None
            if before is not None:
                floor.append(before[0])
            if field in floors:
                self.floors.updateValue((field,), (max(floor),))
            kept = [e for e in (*held.get(field, []), *entries.get(field, [])) if not floor or e[0] > max(floor)]
            held[field] = self._newest(kept)
            for n in range(self.window):  # an empty place says what is no longer there
                turn, _, value = held[field][n] if n < len(held[field]) else (None, None, None)
                yield "window", field, str(n + 1), turn, value
        flat = [(f, *e) for f, some in held.items() for e in some]
        if flat or known:
            self.entries.put(flat) if flat else self.entries.clear()

    def _questions(self, asked: dict, resumed: dict, resumes: dict, known: bool) -> Iterator[tuple]:
        if not asked and not resumed:
            return
        latest = {q: tuple(row) for q, *row in self.latest.get()} if known else {}
        older = known and self.pauses.exists()
        for q in {*asked, *resumed}:
            held = latest.get(q) or (self.pauses.getValue((q,)) if older else None)
            a, r, value, n = held if held is not None else (None, None, None, 0)
            a = min((x for x in (a, asked.get(q)) if x is not None), default=None)
            answers = [x for x in ((r, value), resumed.get(q)) if x is not None and x[0] is not None]
            r, value = min(answers, key=_order, default=(None, None))
            n += resumes.get(q, 0)
            latest[q] = a, r, value, n
            status = "open" if r is None else "unasked" if a is None else "answered" if r > a else "conflict"
            yield "pause", q, status, r if r is not None else a, value
            yield "refused", q, "", None, str(n - (status == "answered"))
        if len(latest) <= TOGETHER:
            self.latest.put([(q, *row) for q, row in latest.items()])
            return
        for q, row in latest.items():
            self.pauses.updateValue((q,), row)
        if known:
            self.latest.clear()

    def _postpone(self, last: int, due: tuple | None) -> None:
        after = last + self.live_ms
        if due is None or after > due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(after)
            self.due.update((after,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.newest, self.sums, self.floors, self.pauses, self.latest, self.entries, self.due):
            state.clear()
        yield self._frame(key, [("expired", "", "", None, None)])

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        columns = dict(zip(COLUMNS, map(list, zip(*rows)))) if rows else {c: [] for c in COLUMNS}
        return pd.DataFrame({"session": [key[0]] * len(rows)} | columns | {"turn": pd.array(columns["turn"], "Int64")})

    def close(self) -> None:
        pass


def states(updates: DataFrame, session: str, ts: str, window: int = 5, live: str = "30 days") -> DataFrame:
    """(session, kind, field, slot, turn, value) of a stream of updates, for output in ``update`` mode.

    ``updates(session, ts, op, field, turn, value)``, optionally ``part`` (an order within a turn).
    ``set`` keeps the value of the largest turn (``last``), ``add`` a sum of whole numbers (``sum``),
    ``append`` the ``window`` newest entries after the last ``clear`` (``window``, newest first;
    an empty place has no turn). ``pause`` asks a question named by ``field``, ``resume``
    answers it: ``pause`` rows say ``open``, ``answered``, ``conflict`` (the first answer isn't after
    the question) or ``unasked``; ``refused`` counts the answers that weren't taken. ``expired``
    ends a session whose last update is ``live`` behind the watermark. Updates without a session,
    field, turn or time and those of other kinds are left out; a null value counts as the least, and as 0 in a sum.
    """
    part = F.coalesce(F.col("part").cast("long"), F.lit(0)) if "part" in updates.columns else F.lit(0)
    time = F.col(ts).cast("timestamp")
    rows = updates.select(F.col(session).alias("session"), time.alias("at"), F.unix_millis(time).alias("ms"), "op", F.col("field").cast("string").alias("field"), F.col("turn").cast("long").alias("turn"), part.cast("long").alias("part"), F.col("value").cast("string").alias("value"))
    rows = rows.where(F.col("session").isNotNull() & F.col("at").isNotNull() & F.col("field").isNotNull() & F.col("turn").isNotNull() & F.col("op").isin(OPS))
    kind = updates.select(session).schema[0].dataType.simpleString()
    made = Session(window, int(pd.Timedelta(live).total_seconds() * 1000))
    # Names without a leading underscore: the rows come as named tuples.
    out = rows.withWatermark("at", live).groupBy("session").transformWithStateInPandas(made, f"session {kind}, kind string, field string, slot string, turn long, value string", "Update", "eventTime")
    return out.withColumnRenamed("session", session)


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state of several kinds needs, for streams that begin inside."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def held(out: DataFrame, session: str) -> DataFrame:
    """The valid rows of what was given out, with its ``__batch``: those after a session's last end."""
    asks = F.col("kind") == "pause"  # its status changes, and is no part of its key
    one = out.withColumns({"status": F.when(asks, F.col("slot")), "slot": F.when(asks, "").otherwise(F.col("slot"))})
    valid = one.groupBy(session, "kind", "field", "slot").agg(F.max_by(F.struct("turn", "value", "status"), "__batch").alias("x"), F.max("__batch").alias("__batch"))
    ends = valid.where("kind = 'expired'").select(session, F.col("__batch").alias("__end"))
    kept = valid.where("kind <> 'expired'").join(ends, session, "left").where("__end is null or __batch > __end")
    return kept.select(session, "kind", "field", F.coalesce("x.status", "slot").alias("slot"), "x.turn", "x.value").where("kind <> 'window' or turn is not null")
