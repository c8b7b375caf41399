"""Topics of sessions over a stream of turns, with keyed state.

A session's turns are folded in the order of their numbers, whatever order they come in: a turn
that comes late changes the topics of those after it, and only turns whose result is new or
changed are given out. A session's state is one conversation; it goes when the watermark passes
its last turn by the time to live, and a turn that comes later than that is dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators.rewrite import similarity

NOISE = re.compile(r"[\W_]+")
#: A new topic that says what the open one says, in this many characters or more, is none;
#: topics that a session keeps in view, and characters of a topic's note.
ALIKE, LEAST_LENGTH, MOST_TOPICS, NOTE_LENGTH = 0.75, 8, 11, 60
FIELDS = ["turn", "label", "wanted", "question", "summary"]


def restated(head: str, question: str) -> bool:
    core = NOISE.sub("", head)
    return len(core) >= LEAST_LENGTH and similarity(core, NOISE.sub("", question)) >= ALIKE


def fold(turns: list[list]) -> list[list]:
    """[turn, topic, label taken, the topic's note] of ``FIELDS`` in the order of turns.

    ``new`` opens ``t{turn}`` unless it restates the open topic's note or first question;
    ``resume`` goes to one of the topics in view; all else stays. ``summary`` is a note on the
    topic that a turn leaves.
    """
    active, heads, notes, view, out = "", {}, {}, [], []
    for turn, label, wanted, question, summary in turns:
        if label == "new" and active and question and restated((notes.get(active) or "").strip() or heads[active], question):
            label = "continue"
        if label == "resume" and wanted in view:
            topic = wanted
        elif label == "new" or not active:
            topic = f"t{turn}"
        else:
            topic = active
        if active and topic != active and (summary or "").strip():
            notes = {k: v for k, v in (notes | {active: summary.strip()[:NOTE_LENGTH]}).items() if k in view}
        heads.setdefault(topic, question or "")
        view = [*(t for t in view if t != topic), topic][-MOST_TOPICS:]
        active = topic
        out.append([turn, topic, label, notes.get(topic)])
    return out


def topics(turns: DataFrame, session: str, ts: str, live: str = "30 days", columns: dict[str, Column] | None = None) -> DataFrame:
    """(session, turn, topic, label, note) of a stream of turns, for output in ``update`` mode.

    ``columns`` gives those of ``FIELDS`` that ``turns`` doesn't have. Rows without a session, a
    turn or a time are left out; of rows with one number the smallest counts, so that a turn that
    is sent twice counts once. The last row given out for a turn is the valid one.
    """
    given = {c: (columns or {}).get(c, F.col(c) if c in turns.columns else F.lit(None)) for c in FIELDS}
    typed = [given["turn"].cast("long").alias("turn"), *(given[c].cast("string").alias(c) for c in FIELDS[1:])]
    rows = turns.select(F.col(session), F.col(ts).cast("timestamp").alias("__ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("__ms"), *typed).where(F.col(session).isNotNull() & F.col("turn").isNotNull() & F.col("__ts").isNotNull())
    lasting = int(pd.Timedelta(live).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, given_out, last = json.loads(state.get[0]) if state.exists else [[], [], 0]
        if held and last + lasting <= state.getCurrentWatermarkMs():
            held, given_out = [], []
        by_turn = {row[0]: row for row in held}
        for batch in batches:
            last = max(last, int(batch["__ms"].max()))
            for row in batch[FIELDS].astype(object).where(batch[FIELDS].notna(), None).values.tolist():
                row[0] = int(row[0])
                by_turn[row[0]] = min(by_turn.get(row[0], row), row, key=lambda r: [(x is None, x or "") for x in r[1:]])
        held = [by_turn[t] for t in sorted(by_turn)]
        found, before = fold(held), {row[0]: row for row in given_out}
        state.update((json.dumps([held, found, last]),))
        state.setTimeoutTimestamp(last + lasting)
        changed = [row for row in found if before.get(row[0]) != row]
        yield pd.DataFrame([(key[0], *row) for row in changed], columns=[session, "turn", "topic", "label", "note"])

    kind = turns.select(session).schema[0].dataType.simpleString()
    return (
        rows.withWatermark("__ts", live).groupBy(session)
        .applyInPandasWithState(step, f"`{session}` {kind}, turn long, topic string, label string, note string", "held string", "update", GroupStateTimeout.EventTimeTimeout)
    )
