import datetime as dt
import os
import random
from collections import defaultdict

import numpy as np
import pytest

from factloom.operators import graph, inference, quality, temporal, vectors
from factloom.plans import fixtures, memory
from pyspark.sql import functions as F

FACT = "fact_id long, group_id string, subject string, predicate string, object string, valid_at timestamp, invalid_at timestamp, tier string, confidence double, pinned boolean, source_episode_id long"
D = lambda n: dt.datetime(2026, 1, 15) + dt.timedelta(days=n)
ANCHOR = "2026-12-31 00:00:00"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        (1, "g", "alice", "lives_in", "boston", D(0), None, "T1", 0.9, False, 100),
        (2, "g", "alice", "lives_in", "seattle", D(90), None, "T2", 0.9, False, 101),
        (3, "g", "alice", "works_at", "acme", D(5), D(20), "T1", 0.8, False, 100),
        (4, "g", "bob", "knows", "alice", D(7), None, "T1", 0.8, False, 102),
        (5, "h", "alice", "lives_in", "paris", D(1), None, "T1", 0.8, False, 103),
        (6, "g", "carol", "knows", "bob", D(8), None, "T4", 0.8, False, 102),
    ]
    return spark.createDataFrame(rows, FACT)


def ids(df, c="fact_id"):
    return sorted(r[c] for r in df.collect())


def test_point_in_time(facts):
    at = lambda n, **k: ids(temporal.as_of(facts, str(D(n)), **k))
    assert at(5) == [1, 3, 5]
    assert at(20) == [1, 4, 5, 6]  # an interval excludes its end
    assert at(20, include_invalidated=True) == [1, 3, 4, 5, 6]
    assert ids(temporal.tier_filter(facts)) == [1, 2, 3, 4, 5]
    assert ids(temporal.scope_filter(facts, "*")) == [1, 2, 3, 4, 5, 6] and ids(temporal.scope_filter(facts, "h")) == [5]


def test_conflicts(facts):
    assert [(r.fact_id, r.conflicts) for r in temporal.conflicts_on_insert(facts, facts).collect()] == [(2, [1])]
    assert [(r.e1, r.e2) for r in temporal.conflict_pairs(facts).collect()] == [(1, 2)]
    assert temporal.conflict_pairs(facts, str(D(30))).count() == 0
    s = {r.fact_id: r.siblings for r in temporal.siblings(facts.withColumn("query_id", F.lit(0)), facts, ANCHOR).collect()}
    assert s[1] == [2] and s[2] == [1] and s[4] == [] and len(s) == 6


def test_terms_are_exact_and_capped(spark, facts):
    t = spark.createDataFrame([("alice",), ("lives_in",), ("ali",)], "term string")
    got = defaultdict(list)
    for r in sorted(temporal.facts_by_term(facts, t, cap=3).collect(), key=lambda r: (r.term, r["rank"])):
        got[r.term].append(r.fact_id)
    assert dict(got) == {"alice": [2, 4, 3], "lives_in": [2, 5, 1]}


def test_supersession(facts):
    assert [(r.winner, r.loser) for r in temporal.supersessions(facts, ANCHOR).collect()] == [(2, 1)]
    assert [r.losers for r in temporal.merges(facts, ANCHOR).collect()] == [[1]]
    assert temporal.supersessions(facts, ANCHOR, start=str(D(80))).count() == 0


def test_changes_fold_in_time_order(spark, facts):
    m = "mutation_id long, fact_id long, action string, ts timestamp, reason string, actor string"
    rows = [(3, 1, "confirmed", D(3), "", "u"), (1, 1, "confirmed", D(1), "", "u"), (2, 1, "corrected", D(2), "", "v"), (4, 4, "invalidate", D(9), "a", "u"), (5, 4, "invalidate", D(12), "b", "v"), (6, 2, "a note", D(1), "", "u"), (7, 99, "delete", D(1), "", "u"), (8, 3, "delete", D(1), "", "u")]
    log = spark.createDataFrame(rows, m)
    a = {r.fact_id: r for r in temporal.apply_attestations(facts, log).collect()}
    assert abs(a[1].confidence - 0.8) < 1e-9 and a[1].pinned and a[2].confidence == 0.9  # 0.9 to 1.0, to 0.6, to 0.8
    i = {r.fact_id: r for r in temporal.apply_invalidations(facts, log).collect()}
    assert i[4].invalid_at == D(9) and i[4].invalidate_reason == "b" and i[3].invalid_at == D(20) and i[1].invalid_at is None
    assert ids(temporal.unknown_ids(facts, log)) == [99]
    assert ids(temporal.delete_facts(facts, log.filter("action = 'delete'"))) == [1, 2, 4, 5, 6]


def test_cascade(spark, facts):
    e = spark.createDataFrame([(100,), (102,), (104,)], "episode_id long")
    left, kept, removed = temporal.delete_episodes(e, facts, e.filter("episode_id <> 102"))
    assert ids(left, "episode_id") == [102] and ids(kept) == [2, 4, 5, 6]
    assert {r.episode_id: r.removed for r in removed.collect()} == {100: [1, 3], 104: []}
    assert temporal.delete_episodes(e, facts, e, cascade=False)[1].count() == 6


def test_scale_facts_and_bulk_load(spark, tmp_path):
    f = temporal.make_scale_facts(spark, 200)
    assert f.count() == 200 and temporal.conflict_pairs(f.filter("subject = 'alice'")).count() == 10
    temporal.bulk_load_facts(f.drop("tier", "confidence", "invalid_at"), str(tmp_path / "facts"))
    r = spark.read.parquet(str(tmp_path / "facts"))
    assert r.count() == 200 and r.filter("tier = 'T2' and confidence = 0.9 and invalid_at is null and not pinned").count() == 200


def test_knn_against_numpy_and_lsh_recall(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 32)).astype(np.float32)
    v[300:] = v[:300] + 0.3 * rng.normal(size=(300, 32))
    items = spark.createDataFrame([(i, "g" if i % 3 else "h", "T1" if i % 5 else "T4", v[i].tolist()) for i in range(600)], "fact_id long, group_id string, tier string, embedding array<float>")
    queries = spark.createDataFrame([(i, v[i].tolist(), "g" if i % 2 else "*") for i in range(0, 60)], "query_id long, q array<float>, scope string")
    got = defaultdict(dict)
    for r in vectors.knn(queries, items, 5, block=7).collect():
        got[r.query_id][r["rank"]] = r.fact_id
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for i in range(60):
        s = np.round(unit[i] @ unit.T, 6)
        want = sorted((k for k in range(600) if k % 5 and (i % 2 == 0 or k % 3)), key=lambda k: (-s[k], k))[:5]
        assert [got[i][r] for r in range(1, 6)] == want
    near = vectors.knn(queries.filter("scope = 'g'"), items, 1)
    found = vectors.knn_approx(queries.filter("scope = 'g'"), items, 1)
    assert found.join(near, ["query_id", "fact_id"]).count() / near.count() >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_lsh_recall_as_registered(spark):
    """The registered k on given rows, and queries over all tenants."""
    d = "/root/testdata/sf0.01"
    near, found = memory.knn_exact(spark, d), memory.knn_lsh(spark, d)
    assert found.join(near, ["query_id", "fact_id"]).count() / near.count() >= 0.9
    q, items = fixtures.queries(spark, d).limit(5).withColumn("scope", F.lit("*")), memory._items(spark, d)
    near, found = vectors.knn(q, items, 16), vectors.knn_approx(q, items, 16)
    assert near.count() == 80 and found.join(near, ["query_id", "fact_id"]).count() / 80 >= 0.9


def test_knn_brings_no_rows_to_the_driver(spark, monkeypatch):
    """Blocks of queries and items meet in Spark, several of each."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8))
    items = spark.createDataFrame([(i, "gh"[i % 2], v[i].tolist()) for i in range(90)], "fact_id long, group_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, v[i].tolist(), "gh*"[i % 3]) for i in range(30)], "query_id long, q array<double>, scope string")
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 10, raising=False)
    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toLocalIterator"):
            m.setattr(type(queries), name, lambda *_: pytest.fail("rows in the driver"))
        near = vectors.knn(queries, items, 4, tiers=None, block=3)
    got = {(r.query_id, r["rank"]): r.fact_id for r in near.collect()}
    s = np.round((v / np.linalg.norm(v, axis=1, keepdims=True))[:30] @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
    for i in range(30):
        may = [j for j in range(90) if "gh*"[i % 3] in ("gh"[j % 2], "*")]
        assert [got[i, r] for r in range(1, 5)] == sorted(may, key=lambda j: (-s[i][j], j))[:4]


def test_gap_prune(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.85), (1, 3, 0.5), (1, 4, 0.15), (2, 1, 0.9), (2, 2, 0.88), (3, 1, 0.4), (4, 1, 0.0), (4, 2, 0.0)]
    kept = vectors.gap_prune(spark.createDataFrame(rows, "query_id long, rank int, score double"))
    assert sorted((r.query_id, r["rank"]) for r in kept.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (4, 2)]


def test_budget_is_a_strict_prefix(spark):
    rows = [(1, 1, 5), (1, 2, 9), (1, 3, 1), (2, 1, 50), (2, 2, 1)]
    df = spark.createDataFrame(rows, "query_id long, rank int, c long")
    pick = lambda **k: sorted((r.query_id, r["rank"]) for r in vectors.take_budget(df, 10, F.col("c"), ["query_id"], **k).collect())
    assert pick() == [(1, 1)] and pick(always_first=True) == [(1, 1), (2, 1)]


def test_embed(spark):
    df = spark.createDataFrame([("a b",), ("b a",), ("",)], "t string")
    r = [x.embedding for x in vectors.embed(df, "t", 16).collect()]
    assert r[0] == r[1] and len(r[0]) == 16 and not any(r[2])
    with pytest.raises(Exception, match="dimension"):
        vectors.embed(df, "t", 8, fn=lambda texts: np.zeros((len(texts), 3))).collect()


def test_inference_modes(spark, facts):
    v = {1: [1.0, 0.0], 2: [0.99, 0.1], 3: [0.0, 1.0], 4: [0.1, 1.0], 6: [1.0, 0.0]}
    items = facts.join(spark.createDataFrame([(k, x) for k, x in v.items()], "fact_id long, embedding array<double>"), "fact_id")
    q = spark.createDataFrame([(7, [1.0, 0.0], "g")], "query_id long, q array<double>, scope string")
    e = spark.createDataFrame([(100, "was in boston", D(0)), (101, "x" * 400, D(90))], "episode_id long, text string, event_time timestamp")
    run = lambda mode, **k: ids(inference.infer(q, items, facts, e, ANCHOR, mode, **k))
    assert run("all") == [1, 2]
    assert run("consistent") == []
    assert run("conflict_set") == [2]
    older = lambda asked: asked.select("query_id", F.lit('{"resolution":"e1_correct","reason":"r","confidence":0.5}').alias("response"))
    broken = lambda asked: asked.select("query_id", F.lit("no").alias("response"))
    assert run("conflict_set", judge=older) == [1] and run("conflict_set", judge=broken) == [1, 2]
    hits, seeds = inference.seeds(q, items, facts, ANCHOR)
    ordered = inference.order_pairs(vectors.score_pairs(inference.seed_pairs(seeds, facts, ANCHOR), hits), facts)
    snippets = inference.evidence(ordered, e)
    assert sorted(len(r.snippet) for r in snippets.collect()) == [len("[2026-01-15] was in boston"), 13 + 300]
    asked = inference.verdict_requests(ordered, snippets)
    assert asked.count() == 1 and quality.verdict_budget(asked).count() == 0
    assert "e1 (older): (alice, lives_in, boston)" in asked.first().reasons[0]


def test_extract_facts(spark):
    e = spark.createDataFrame([(1, "hello\nFACT: bob | likes | tea\nFACT: broken", D(1)), (2, None, D(2))], "episode_id long, text string, event_time timestamp")
    assert [(r.subject, r.predicate, r.object, r.valid_at) for r in inference.extract_facts(e).collect()] == [("bob", "likes", "tea", D(1))]
    fn = lambda d: d.select("episode_id", F.when(F.col("episode_id") == 1, '{"facts":[{"s":"a","p":"b","o":"c","confidence":0.7},{"s":"x"}]}').otherwise("junk").alias("response"))
    assert [(r.subject, r.confidence) for r in inference.extract_facts(e, fn).collect()] == [("a", 0.7)]


def test_walks_against_a_plain_search(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)}
    edges = spark.createDataFrame([(0, a, b) for a, b in pairs] + [(1, "n1", "n2")], "gid long, src string, dst string")
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    starts = [f"n{k}" for k in range(0, 60, 7)]

    def frontier(s, depth):
        seen, now = {s}, {s}
        for _ in range(depth):
            now = {y for x in now for y in out[x]} - seen
            seen |= now
        return now

    s = spark.createDataFrame([(0, x) for x in starts], "gid long, start string")
    for depth in (0, 1, 3):
        got = defaultdict(set)
        for r in graph.bfs_frontier(edges, s, depth).collect():
            got[r.start].add(r.node)
        assert {x: got[x] for x in starts} == {x: frontier(x, depth) if depth else set() for x in starts}
    tasks = spark.createDataFrame([(1, 0, "bfs", "n0", 2), (2, 0, "parents", "n7", None), (3, 1, "bfs", "zz", 1), (4, 0, "bfs", "n7", 0)], "task_id int, gid long, op string, start string, depth int")
    pred = {r.task_id: r.pred for r in graph.run_graph_tasks(tasks, edges).collect()}
    assert pred == {1: sorted(frontier("n0", 2)), 2: sorted(a for a, b in pairs if b == "n7" and a != "n7"), 3: [], 4: []}


def test_neighbors(spark, facts):
    s = spark.createDataFrame([("g", "carol"), ("g", "alice")], "group_id string, start string")
    near = lambda depth: {(r.start, r.fact_id) for r in graph.neighbors(facts, s, depth, ANCHOR, tiers=("T1", "T2", "T4")).collect()}
    assert near(1) == {("carol", 6), ("alice", 1), ("alice", 2), ("alice", 4)}
    assert near(3) == {("carol", 6), ("carol", 4), ("carol", 1), ("carol", 2), ("alice", 1), ("alice", 2), ("alice", 4), ("alice", 6)}


def test_add_episodes(spark, facts):
    e = spark.createDataFrame([(1, "g", "s", "FACT: alice | lives_in | oslo", D(200)), (2, "g", "s", "FACT: x | y | z" + " " * 30_000, D(201)), (3, "g", "s", "FACT: not | read | here", D(202))], "episode_id long, group_id string, session_id string, text string, event_time timestamp")
    asserted = spark.createDataFrame([(3, "bob", "knows", "carol", 1.0)], "episode_id long, subject string, predicate string, object string, confidence double")
    new, pairs = inference.add_episodes(e, facts, asserted)
    rows = {r.source_episode_id: r for r in new.collect()}
    assert {k: (r.subject, r.object, r.valid_at) for k, r in rows.items()} == {1: ("alice", "oslo", D(200)), 3: ("bob", "carol", D(202))}
    assert {r.fact_id: r.conflicts for r in pairs.collect()} == {rows[1].fact_id: [1, 2], rows[3].fact_id: [4]}
    small, large = inference.large_payload_split(e)
    assert small.count() == 2 and large.count() == 1
    q = spark.createDataFrame([("ask",)], "query string")
    assert inference.reformulated(q, F.lit(" ")).first().retrieval_query == "ask" and inference.reformulated(q, F.lit("better")).first().retrieval_query == "better"
