"""Streams with keyed state over several arrivals, each a restart from the checkpoint."""

import datetime as dt
from collections import OrderedDict

import pytest

from factloom.functions.storage import new_folder
from factloom.streaming import keyed

MESSAGES = "group_id string, session_id string, seq long, role string, text string, event_time timestamp"
FACT = "fact_id long, group_id string, subject string, predicate string, object string, valid_at timestamp, invalid_at timestamp, confidence double, pinned boolean"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def through(spark, arrivals, make, by=()):
    out, state = new_folder(spark, "out"), new_folder(spark, "state")
    keyed.feed(arrivals, new_folder(spark, "in"), lambda s: keyed.run_to(make(s), out, state, by))
    return spark.read.parquet(out)


def said(spark, texts, start=0, session="s"):
    return spark.createDataFrame([("g", session, start + k, "user", None if t is None else f"this is the whole span {t}", at(start + k)) for k, t in enumerate(texts)], MESSAGES)


@pytest.mark.parametrize("renew", [False, True])
def test_memory_of_spans(spark, renew):
    parts = ["abcab", "adbea", [None, "c", "a", "a"]]
    starts = [0, 5, 10]
    got = through(spark, [said(spark, p, s) for p, s in zip(parts, starts, strict=True)], lambda s: keyed.first_sights(s, most=3, renew=renew))
    held, want = OrderedDict(), []
    for k, t in enumerate(x for p in parts for x in p):
        if t is None:
            continue
        if t in held:
            if renew:
                held.move_to_end(t)
            continue
        want.append(k)
        held[t] = None
        if len(held) > 3:
            held.popitem(last=False)
    assert sorted(r.seq for r in got.collect()) == want and len(want) > 6


def test_memory_by_age(spark):
    arrivals = [said(spark, "ab", 0), said(spark, "a", 30), said(spark, "ab", 200), said(spark, "z", 5_000, "other"), said(spark, "a", 10_000)]
    got = through(spark, arrivals, lambda s: keyed.first_sights(s, ttl="1 hour", late="1 minute"))
    assert sorted(r.seq for r in got.collect()) == [0, 1, 200, 201, 5_000, 10_000]


@pytest.mark.parametrize("salts", [1, 3])
def test_conflicts_of_arrivals(spark, salts):
    f = lambda i, o, b, e=None, s="a": (i, "g", s, "p", o, at(b), None if e is None else at(e), 0.9, False)
    known = spark.createDataFrame([f(1, "x", 0), f(2, "y", 0, 5), f(3, None, 0), f(4, "x", 0, s=None)], FACT)
    arrivals = [[f(5, "y", 3), f(6, "x", 6)], [f(7, "z", 7, 8), f(8, "z", 7), f(9, "y", 9, s=None)], [f(10, "x", 20)]]
    got = through(spark, [spark.createDataFrame(a, FACT) for a in arrivals], lambda s: keyed.conflicts_of_stream(s, known, salts))
    found = {r.fact_id: r.conflicts for r in keyed.merged_conflicts(got).collect()}
    assert found == {5: [1], 6: [5], 7: [1, 5, 6], 8: [1, 5, 6], 10: [5, 8]}


def test_a_hot_key_is_dealt_over_salts(spark):
    f = [(i, "g", "hot", "p", str(i), at(0), None, 0.9, False) for i in range(200)]
    got = through(spark, [spark.createDataFrame(f[:150], FACT), spark.createDataFrame(f[150:], FACT)], lambda s: keyed.conflicts_of_stream(s, None, 4))
    assert got.select("salt").distinct().count() == 4
    assert {r.fact_id: len(r.conflicts) for r in keyed.merged_conflicts(got).collect()} == {i: i for i in range(1, 200)}


def test_folded_changes(spark):
    facts = spark.createDataFrame([(i, "g", "a", "p", "x", at(0), at(50) if i == 2 else None, 0.9, False) for i in (1, 2, 3)], FACT)
    m = "mutation_id long, fact_id long, action string, ts timestamp, reason string, actor string"
    arrivals = [
        [(1, 1, "confirmed", at(1), "", "u"), (2, 1, "corrected", at(2), "", "v"), (3, 2, "invalidate", at(9), "why", "w"), (4, 77, "confirmed", at(1), "", "u")],
        [(5, 1, "confirmed", at(3), "", "x"), (6, 3, "delete", at(4), "", "x"), (7, 3, "confirmed", at(5), "", "x"), (8, None, "confirmed", at(5), "", "x")],
        [(9, 3, "corrected", at(6), "", "x"), (10, 1, "invalidate", at(60), "late", "y"), (11, 1, "else", at(61), "", "y")],
    ]
    out = through(spark, [spark.createDataFrame(a, m) for a in arrivals], lambda s: keyed.changes_of_stream(s, facts), ("kind",))
    assert sorted(r.mutation_id for r in out.filter("kind = 'unknown'").collect()) == [4, 7, 9]
    now = {r.fact_id: r for r in keyed.folded_facts(facts, out.filter("kind = 'fact'")).collect()}
    assert set(now) == {1, 2}
    assert (round(now[1].confidence, 6), now[1].pinned, now[1].last_attested_at, now[1].last_attested_by) == (0.8, True, at(3), "x")
    assert (now[1].invalid_at, now[1].invalidate_reason, now[2].invalid_at, now[2].invalidate_reason, now[2].confidence) == (at(60), "late", at(50), "why", 0.9)


def test_sessions_and_late_rows(spark):
    s = "session_id string, t timestamp, original_tokens long, outbound_tokens long"
    arrivals = [[("a", at(0), 10, 5), ("a", at(8), 20, 15), ("b", at(3), 1, 1)], [("a", at(15), 30, 7), ("a", at(1), 9, 9), ("b", at(60), 2, 2)], [("b", at(5), 7, 7), ("a", at(58), 1, 1), (None, None, 1, 1)]]
    frames = [spark.createDataFrame(a, s) for a in arrivals] + [keyed.far_record(spark)]
    out = through(spark, frames, lambda x: keyed.monitor_sessions(x, 10, 10 * 60_000, "5 minutes"), ("kind",))
    zero = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    m = lambda ms: (ms - zero) / 60_000
    assert sorted((r.session_id, m(r.begins), m(r.ends), r.turns, r.max_outbound, r.max_original, r.turns_over) for r in out.filter("kind = 'session'").collect()) == [
        ("a", 0, 25, 3, 15, 30, 1), ("a", 58, 68, 1, 1, 1, 0), ("b", 3, 13, 1, 1, 1, 0), ("b", 60, 70, 1, 2, 2, 0)]
    assert sorted((r.session_id, m(r.begins), r.outbound_tokens) for r in out.filter("kind = 'late'").collect()) == [("a", 1, 9), ("b", 5, 7)]


def test_batches_go_to_a_function(spark, tmp_path):
    """Messages to whatever ingests them, such as a commit of episodes; a restart hands on nothing twice."""
    from factloom.sources import commits
    from factloom.streaming import ingest

    root = new_folder(spark, "episodes")
    said(spark, "abc").write.parquet(str(tmp_path / "in"))
    taken = []
    for _ in range(2):
        stream = spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in"))
        ingest.ingest_to(stream, lambda b: taken.append(commits.commit(root, len(taken), {"episodes": b.select("seq", "text")})), str(tmp_path / "cp")).awaitTermination()
    assert taken == [True] and commits.read_table(spark, root, "episodes", "seq long, text string").count() == 3
