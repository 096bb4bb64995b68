"""Ways that only large keys take, against plain ones; commits; the trained index; vectors that are null or short."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions.storage import new_folder
from factloom.functions.text import strip
from factloom.operators import coarse, context, evaluation as ev, inference, intervals, temporal, vectors
from factloom.sources import commits

FACT = "fact_id long, group_id string, subject string, predicate string, object string, valid_at timestamp, invalid_at timestamp, confidence double, pinned boolean"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        b = rng.randrange(60)
        e = rng.choice([None, b, b - 3, b + 1, b + rng.randrange(30)])
        rows.append((i, rng.choice(["g", "h", None]), rng.choice("aab"), "p", rng.choice(["x", "y", "z", None]), at(b) if i % 50 else None, None if e is None else at(e), 0.5, False))
    return spark.createDataFrame(rows, FACT)


@pytest.mark.parametrize("few", [1_000, 3])
def test_pairs_of_large_keys(facts, few):
    rows = facts.collect()
    end = lambda r: r.invalid_at or dt.datetime(9999, 12, 31, 23, 59, 59)
    want = set()
    for a in rows:
        for b in rows:
            known = None not in (a.group_id, b.group_id, a.object, b.object, a.valid_at, b.valid_at)
            if known and a.fact_id < b.fact_id and (a.group_id, a.subject) == (b.group_id, b.subject) and a.object != b.object and a.valid_at < end(b) and b.valid_at < end(a):
                want.add((a.fact_id, b.fact_id))
    got = [(r.e1, r.e2) for r in temporal.conflict_pairs(facts, few=few).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400


def test_a_large_key_whose_facts_never_meet(spark):
    """100,000 facts of one key, each over before the next begins: nothing meets, not even to be dropped."""
    start = F.timestamp_add("SECOND", (F.col("id") * 2).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = spark.range(100_000).select(F.col("id").alias("fact_id"), F.lit("g").alias("group_id"), F.lit("a").alias("subject"), F.lit("p").alias("predicate"), F.col("id").cast("string").alias("object"), start.alias("valid_at"), (start + F.expr("interval 1 second")).alias("invalid_at"))
    assert temporal.conflict_pairs(rows).count() == 0
    spans = rows.select(*temporal.KEY, F.col("fact_id").alias("row"), F.col("valid_at").alias("begins"), F.col("invalid_at").alias("ends"))
    met = intervals.points_in_intervals(spans, spans.select(*temporal.KEY, "row", F.col("begins").alias("t")), temporal.KEY)
    assert met.filter("interval = point").count() == met.count() == 100_000  # each holds its own beginning


@pytest.mark.parametrize("few", [10_000, 2])
def test_snapshots_at_many_times(spark, facts, few, monkeypatch):
    monkeypatch.setattr(temporal, "FEW_ANCHORS", few)
    times = [0, 1, 7, 7, 30, 59, 300]
    anchors = spark.createDataFrame([(g, at(t)) for g in ("g", "h", None) for t in times], "group_id string, anchor timestamp")
    got = sorted((r.fact_id, r.anchor) for r in temporal.as_of_many(facts, anchors).collect())
    want = sorted((r.fact_id, at(t)) for r in facts.collect() for t in set(times) if r.group_id and r.valid_at and r.valid_at <= at(t) and (r.invalid_at is None or r.invalid_at > at(t)))
    assert got == want and len(want) > 100


def test_folds_in_parts(spark, facts):
    rng = random.Random(2)
    acts = [(k, rng.choice([1, 2, 3, 777]), rng.choice(["confirmed", "corrected", "invalidate"]), at(rng.randrange(500)), "", f"u{k}") for k in range(300)]
    m = spark.createDataFrame(acts, "mutation_id long, fact_id long, action string, ts timestamp, reason string, actor string")
    want = {}
    for r in facts.collect():
        c, pinned, by = r.confidence, r.pinned, None
        for _, _, action, actor in sorted((a[3], a[0], a[2], a[5]) for a in acts if a[1] == r.fact_id):
            if action != "invalidate":
                c, pinned, by = (min(1.0, c + 0.2), True, actor) if action == "confirmed" else (max(0.0, c - 0.4), False, actor)
        want[r.fact_id] = (round(c, 6), pinned, by)
    for few in (1_000, 5):
        got = {r.fact_id: (round(r.confidence, 6), r.pinned, r.last_attested_by) for r in temporal.apply_attestations(facts, m, few).collect()}
        assert got == want


def test_samples_take_no_whole_bucket(spark):
    rows = spark.range(3_000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 1 == 0, "S").otherwise("M").alias("bucket"), F.element_at(F.array(*map(F.lit, (2, 4, 8, 16))), (F.col("id") % 4 + 1).cast("int")).alias("n_needles"), (F.col("id") % 3).alias("c"))
    for picked in (ev.sample_needles(rows, 10, 1), ev.quota_sample(rows, 7, 1), ev.diverse_pick(rows, 10, "c", "row_idx")):
        assert "WindowGroupLimit" in picked._jdf.queryExecution().executedPlan().toString()
    got = [r.n_needles for r in ev.sample_needles(rows, 10, 1).collect()]
    assert len(got) == 10 and all(got.count(k) >= 2 for k in (2, 4, 8))
    few = rows.filter("row_idx < 6")
    assert ev.sample_needles(few, 10, 1).count() == 6


def test_one_commit_for_several_tables(spark):
    root = new_folder(spark, "commits")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert commits.read_table(spark, root, "a", "id long").count() == 0
    assert commits.commit(root, 0, {"a": rows(1, 2), "b": rows(3)})
    broken = rows(8).select(F.when(F.col("id") > 0, F.raise_error(F.lit("stop"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        commits.commit(root, 1, {"a": rows(9), "b": broken})
    ids = lambda name: sorted(r.id for r in commits.read_table(spark, root, name, "id long").collect())
    assert (ids("a"), ids("b")) == ([1, 2], [3])  # the half that was written is not there
    assert commits.commit(root, 1, {"a": rows(9), "b": rows(10)})
    assert not commits.commit(root, 1, {"a": rows(9), "b": rows(10)})
    assert (ids("a"), ids("b")) == ([1, 2, 9], [3, 10])


def test_streamed_commits(spark, tmp_path):
    root = new_folder(spark, "commits")
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        commits.commit_stream(s, root, lambda b: {"all": b, "odd": b.filter("id % 2 = 1")}, str(tmp_path / "cp")).awaitTermination()
    assert commits.read_table(spark, root, "all", "id long").count() == 5 and commits.read_table(spark, root, "odd", "id long").count() == 2


def test_extraction_by_a_table_function(spark):
    text = "x\nFACT: a | b | c\nFACT: broken | line\nFACT:  d |e|  f \nno FACT: g | h | i"
    e = spark.createDataFrame([(1, text, at(0)), (2, None, at(0)), (3, "", at(0))], "episode_id long, text string, event_time timestamp")
    got = sorted((r.episode_id, r.subject, r.predicate, r.object) for r in inference.extract_lateral(e).collect())
    assert got == sorted((r.episode_id, r.subject, r.predicate, r.object) for r in inference.extract_facts(e).collect()) == [(1, "a", "b", "c"), (1, "d", "e", "f")]
    inference.register_extractor(spark)
    e.createOrReplaceTempView("told")
    assert spark.sql("select f.* from told, lateral extract_facts(text) f where f.subject = 'd'").collect() == [("d", "e", "f")]


VECTOR = "fact_id long, group_id string, tier string, embedding array<float>"


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"g{i % 2}", "T1", [float(x) for x in rng.normal(size=16)]) for i in range(1_500)]
    rows += [(5_000, "g0", "T1", None), (5_001, "g0", "T1", [1.0, 2.0]), (5_002, "g1", "T1", [0.0] * 16), (5_003, "g1", "T4", rows[0][3])]
    return spark.createDataFrame(rows, VECTOR)


@pytest.fixture(scope="module")
def asked(spark, items):
    rows = [(r.fact_id, r.embedding, ["g0", "g1", "*"][r.fact_id % 3]) for r in items.filter("fact_id % 50 = 0 and fact_id < 1500").collect()]
    return spark.createDataFrame([*rows, (9_000, None, "g0"), (9_001, [1.0], "*")], "query_id long, q array<float>, scope string")


def test_null_and_short_vectors(spark, items, asked):
    got = vectors.knn(asked, items, 3).collect()
    by = {q: [(r.fact_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 9_000, 9_001)}
    assert by[0][0] == (0, 1.0) and [s for _, s in by[9_000]] == [s for _, s in by[9_001]] == [0.0, 0.0, 0.0]
    assert vectors.knn_approx(asked, items.limit(0), 3).count() == 0
    assert {r.query_id for r in vectors.knn_approx(asked, items, 3).collect()} >= {0, 50}


def test_trained_index(spark, items, asked):
    exact = vectors.knn(asked.filter("q is not null and size(q) = 16"), items, 8)
    index = coarse.fit_index(items, 16, cells=8)
    assert index.items.count() == items.filter("tier = 'T1'").count()
    good = asked.filter("q is not null and size(q) = 16")
    whole = coarse.search_index(index, good, 8, 8, 10_000)
    assert sorted(whole.collect()) == sorted(exact.select(*whole.columns).collect())
    probes, depth = coarse.reach(index, asked, 8)
    r = vectors.recall_at(coarse.search_index(index, good, 8, probes, depth), exact, good)
    assert all(x.recall >= 0.9 for x in r.collect()) and depth < 400
    none = coarse.fit_index(items.limit(0), 16)
    assert coarse.search_index(none, asked, 8, 1, 10).count() == 0


def test_strip_as_white_space_goes(spark):
    texts = ["\n a b \t", "  x\x1c", "", " \n", "a\nb", "x\n\n", None]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t")).alias("s")).collect()]
    assert got == [t if t is None else t.strip() for t in texts]


def test_recall_by_functions(spark):
    """Recall and ranking as functions that a caller plugs in."""
    m = [("c", k, "user" if k % 2 == 0 else "assistant", f"turn {k} " + "word " * 60, False) for k in range(8)]
    messages = spark.createDataFrame(m, "conv_id string, msg_idx long, role string, text string, pure_tool_result boolean")
    seen = []

    def recall(q):
        seen.append(sorted(q.columns))
        return q.select("conv_id", F.concat(F.lit("\n knows "), F.left("query", F.lit(6)), F.lit("\n")).alias("recall_text"))

    near = lambda groups: groups.select("conv_id", "group_no", F.array(F.col("group_no").cast("double"), F.lit(1.0)).alias("embedding"), F.array(F.lit(0.0), F.lit(1.0)).alias("q"))
    system = spark.createDataFrame([("c", "be kind", 7)], "conv_id string, system string, tools_tokens long")
    r = context.report(context.virtualize(messages, 400, 0, 1, near, recall, requests=system, recall_k=1)).first()
    v = context.virtualize(messages, 400, 0, 1, near, recall, requests=system, recall_k=1).first()
    assert seen[0] == ["conv_id", "query", "recall_budget"] and "knows turn 6\n</rec" in v.recap and "[turn 0.0 user]" in v.recap and v.system == "be kind" + v.recap
    assert r.outbound_tokens == r.kept_tokens + r.post_system_tokens + 7 and r.original_total_tokens == r.original_tokens + 1 + 7
