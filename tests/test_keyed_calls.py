"""Calls to the state store from Python's keyed state follow keys and blocks, not rows."""

from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import Row

from factloom.streaming import keyed


class Held:
    """A state of any kind that counts its calls."""

    def __init__(self, calls):
        self.calls, self.entries = calls, []

    def get(self):
        self.calls.append("get")
        return iter(list(self.entries))

    def put(self, entries):
        self.calls.append("put")
        self.entries = list(entries)

    def appendValue(self, entry):
        self.calls.append("appendValue")
        self.entries.append(entry)

    def clear(self):
        self.calls.append("clear")
        self.entries = []


class Handle:
    def __init__(self):
        self.calls, self.timers, self.kept = [], [], {}

    def getListState(self, name, schema, ttl=None):
        return self.kept.setdefault(name, Held(self.calls))

    def listTimers(self):
        self.calls.append("listTimers")
        return iter(list(self.timers))

    def registerTimer(self, t):
        self.calls.append("registerTimer")
        self.timers.append(t)

    def deleteTimer(self, t):
        self.calls.append("deleteTimer")
        self.timers.remove(t)


def at_watermark(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def test_spans_are_read_and_written_at_once():
    memory, handle = started(keyed.SpanMemory(50, None, False))
    seen = []
    for batch in range(3):
        rows = [Row(seq=k, role="user", text=str(k % 120), hash=str(k % 120), at=k) for k in range(batch * 1_000, batch * 1_000 + 1_000)]
        seen += [r.seq for r in memory.handleInputRows(("g", "s"), iter(rows), None)]
        assert len(handle.calls) <= 2 * (batch + 1)
    assert seen == list(range(3_000))  # 50 are remembered, so none of 120 in turn is known when it comes again
    assert sum(len(e[0]) for e in handle.kept["spans"].entries) <= 100


@pytest.mark.parametrize("most_pairs", [1_000_000, 7])
def test_facts_of_many_keys_share_calls(monkeypatch, most_pairs):
    monkeypatch.setattr(keyed, "MOST_PAIRS", most_pairs)
    known, handle = started(keyed.KnownFacts())
    rows = [(f"k{i % 50}", i, f"o{i // 50 % 3}", keyed._OPEN if i % 2 else 10, 5 if i % 5 else 20) for i in range(600)]
    frame = pd.DataFrame(rows, columns=["key", "fact_id", "object", "ends", "begins"]).assign(own=True)
    known.handleInitialState((0, 0), frame[:200].drop(columns=["begins", "own"]), None)
    found = {}
    for a, b in ((200, 400), (400, 600)):
        for part in known.handleInputRows((0, 0), iter([frame[a : b - 50], frame[b - 50 : b]]), None):
            found |= {r.fact_id: [int(i) for i in r.conflicts] for r in part.itertuples()}
    want = {r[1]: [f[1] for f in rows[: r[1]] if f[0] == r[0] and f[2] != r[2] and (f[3] == keyed._OPEN or f[3] > r[4])] for r in rows[200:]}
    assert found == {i: c for i, c in want.items() if c} and len(handle.calls) <= 5


def test_changes_of_many_facts_share_calls():
    folded, handle = started(keyed.FoldedFacts())
    folded.handleInitialState((0,), Row(fact_id=list(range(500)), confidence=[0.5] * 500, pinned=[None] * 500, ends=[None] * 500), None)
    change = lambda m, f, a: Row(fact_id=f, mutation_id=m, action=a, at=m, reason="r", actor="u")
    out = []
    for batch, action in enumerate(("confirmed", "delete", "invalidate", "confirmed")):
        out += folded.handleInputRows((0,), iter([change(batch * 1_000 + f, f, action) for f in range(batch % 2, 502, 1 + batch % 2)]), None)
    last = {}
    for r in out:
        if r.kind == "fact":
            assert r.version == (last[r.fact_id].version if r.fact_id in last else 0) + 1
            last[r.fact_id] = r
    assert {i for i, r in last.items() if r.deleted} == set(range(1, 500, 2))
    assert all((round(last[i].confidence, 6), last[i].pinned, last[i].ends) == (0.7, True, 2_000 + i) for i in range(0, 500, 2))
    assert sum(r.kind == "unknown" for r in out) == 2 + 1 + 252 + 251
    assert len(handle.calls) <= 1 + 2 * 4


def test_windows_of_many_sessions_share_calls():
    windows, handle = started(keyed.SessionWindows(10, 5))
    row = lambda s, t, n: Row(session_id=s, at=t, outbound_tokens=n, original_tokens=n)
    names = [None, *(f"s{i}" for i in range(99))]
    rows = [row(s, t, t) for t in (30, 0, 9, 18) for s in names]
    out = list(windows.handleInputRows((0,), iter(rows), at_watermark(0)))
    out += windows.handleInputRows((0,), iter([row(s, t, 1) for s in names for t in (38, 3)]), at_watermark(28))
    assert sorted(((r.kind, r.session_id or "", r.begins, r.ends, r.turns, r.turns_over) for r in out)) == sorted(
        w for s in names for w in (("session", s or "", 0, 28, 3, 2), ("late", s or "", 3, None, None, None))
    )
    out = list(windows.handleExpiredTimer((0,), at_watermark(48), None))
    assert [(r.begins, r.ends, r.turns) for r in out] == [(30, 48, 2)] * 100 and not handle.timers
    assert len(handle.calls) <= 5 * 3
