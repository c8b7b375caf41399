"""States of sessions: batches in any order give what one plain pass over all updates gives."""

import datetime
import random

import pytest

from lexloom.streaming import limits, states

SCHEMA = "s string, ts timestamp, op string, field string, turn long, part int, value string"


def at(days):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=days)


def plain(rows, window):
    least = lambda v: (v is not None, v or "")
    out = set()
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        for field in {r[3] for r in mine}:
            by = {op: sorted(((r[4], r[5], r[6]) for r in mine if r[3] == field and r[2] == op), key=lambda x: (x[0], x[1], least(x[2]))) for op in states.OPS}
            if by["set"]:
                turn, _, value = max(by["set"], key=lambda x: (x[0], least(x[2])))
                out.add((s, "last", field, "", turn, value))
            if by["add"]:
                out.add((s, "sum", field, "", None, str(sum(int(v or 0) for *_, v in by["add"]))))
            floor = max((t for t, *_ in by["clear"]), default=-1)
            for n, (turn, _, value) in enumerate([e for e in reversed(by["append"]) if e[0] > floor][:window]):
                out.add((s, "window", field, str(n + 1), turn, value))
            if by["pause"] or by["resume"]:
                asked = min((t for t, *_ in by["pause"]), default=None)
                first = min(((t, v) for t, _, v in by["resume"]), key=lambda x: (x[0], least(x[1])), default=None)
                status = "open" if first is None else "unasked" if asked is None else "answered" if first[0] > asked else "conflict"
                out.add((s, "pause", field, status, *(first or (asked, None))))
                out.add((s, "refused", field, "", None, str(len(by["resume"]) - (status == "answered"))))
    return out


@pytest.fixture
def sent(spark, tmp_path):
    def run(batches, **more):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with states.store(spark):
            return limits.drained(states.states(stream, "s", "ts", **more), "update")

    return run


def test_batches_out_of_order(sent):
    dice = random.Random(8)
    rows = []
    for s in "abc":
        for turn in range(1, 25):
            op = dice.choice([*states.OPS, "append", "append"])
            field = dice.choice(["f", "g"]) if op in ("set", "add", "append", "clear") else dice.choice(["q1", "q2", "q3"])
            value = dice.choice([None, "1", "2", "30"])
            rows.append((s, at(turn / 100), op, field, turn, dice.randint(0, 2), value))
    mixed = dice.sample(rows, len(rows))
    odd = [(None, at(0), "set", "f", 1, 0, "x"), ("a", None, "set", "f", 99, 0, "x"), ("a", at(0), "other", "f", 99, 0, "x"), ("a", at(0), "set", None, 99, 0, "x"), ("a", at(0), "set", "f", None, 0, "x")]
    out = sent([mixed[:9], mixed[9:11] + odd, mixed[11:50], mixed[50:]], window=3)
    assert {tuple(r) for r in states.held(out, "s").collect()} == plain(rows, 3)


def test_a_session_ends_and_begins_anew(sent):
    first = [("a", at(0), "add", "n", 1, 0, "5"), ("a", at(0), "append", "l", 1, 0, "x"), ("b", at(0), "add", "n", 1, 0, "1")]
    out = sent([first, [("b", at(90), "add", "n", 2, 0, "2")], [("b", at(91), "add", "n", 3, 0, "4")], [("a", at(92), "add", "n", 9, 0, "7")]])
    got = {tuple(r) for r in states.held(out, "s").collect()}
    assert ("a", "sum", "n", "", None, "7") in got and not [g for g in got if g[1] == "window"]
    assert out.where("kind = 'expired' and s = 'a'").count() == 1


def test_many_pauses(sent):
    """Some lie together, then each has an entry of its own, and some come again."""
    draw = random.Random(9)
    rows = [("a", at(i / 100), draw.choice(["pause", "resume"]), f"q{draw.randrange(150)}", i, 0, str(i)) for i in range(1, 500)]
    mixed = draw.sample(rows, len(rows))
    out = sent([mixed[:40], mixed[40:90], mixed[90:300], mixed[300:310], mixed[310:]])
    assert {tuple(r) for r in states.held(out, "s").collect()} == plain(rows, 5)


class Store:
    """A handle that counts the calls to its state."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        def call(*args):
            if name.startswith("get") and name.endswith("State"):
                return self
            self.calls.append(name)
            return False if name in ("exists", "containsKey") else None

        return call


def test_a_new_session_takes_few_calls_to_the_store():
    handle, session = Store(), states.Session(5, 1000)
    session.init(handle)
    rows = [("set", "f", 1, 0, "x"), ("add", "n", 1, 0, "3"), ("append", "l", 1, 0, "x"), ("clear", "l", 0, 0, None)]
    rows += [(op, f"day {i}", i, 0, "x") for i in range(60) for op in ("pause", "resume")]
    frame = states.pd.DataFrame([(5, *r) for r in rows], columns=["ms", "op", "field", "turn", "part", "value"])
    (given,) = session.handleInputRows(("a",), iter([frame]), None)
    assert len(given) == 2 + 5 + 2 * 60 and len(handle.calls) <= 10
