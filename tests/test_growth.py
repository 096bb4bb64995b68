"""Work that must not grow with what many rows share, or with pairs that come to nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import coarse, evaluation, inference, vectors


@pytest.fixture(scope="module")
def shared(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(120)]
    rows[7] = (7, rows[3][1])  # two vectors of one content
    return spark.createDataFrame([*rows, (120, None), (121, [1.0])], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def sharing(spark):
    """Forty facts to a vector and more, of two tenants and none."""
    f = spark.range(5_000).select(F.col("id").alias("fact_id"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("g"), (F.col("id") % 2).cast("string"))).alias("group_id"), F.concat(F.lit("T"), (1 + F.col("id") % 3).cast("string")).alias("tier"))
    return f.withColumn("vec_id", F.pmod(F.xxhash64("fact_id"), F.lit(122)))


@pytest.fixture(scope="module")
def asking(shared):
    q = shared.filter("vec_id % 10 = 0 or vec_id = 121")
    return q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.expr("element_at(array('g0', 'g1', '*'), cast(vec_id % 3 as int) + 1)").alias("scope"))


@pytest.mark.parametrize("k", [5, 100])
def test_a_vector_is_compared_once(spark, shared, sharing, asking, k, monkeypatch):
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 30)
    monkeypatch.setattr(vectors, "AT_ONCE", 2)
    got = vectors.knn(asking, sharing, k, block=4, shared=shared).collect()
    v = {r.vec_id: r.embedding for r in shared.collect()}

    def cos(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        return round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 6)

    facts = [r for r in sharing.collect() if r.tier in ("T1", "T2")]
    for q in asking.collect():
        scores = {i: cos(q.q, x) for i, x in v.items()}
        want = sorted((-scores[f.vec_id], f.fact_id) for f in facts if q.scope in (f.group_id, "*"))[:k]
        assert [(-r.score, r.fact_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q.query_id] == want
    ids, held = vectors.scoped(sharing, "fact_id", ("T1", "T2"), shared)
    assert held.count() == ids.select("scope", "item").distinct().count() <= 3 * 122 < ids.count() / 10


def test_candidates_are_ranked_where_they_meet(spark, shared, sharing, asking, monkeypatch):
    """Buckets that hold most items: no pair of a query and a candidate leaves its task but the best."""
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 30)
    every = sharing.join(shared, "vec_id")
    found = vectors.knn_approx(asking, sharing, 5, tables=6, bits=3, shared=shared)
    apart = vectors.knn_approx(asking, every, 5, tables=6, bits=3)
    rows = lambda df: sorted((r.query_id, r["rank"], r.fact_id, r.score) for r in df.collect())
    assert rows(found) == rows(apart) and len(rows(found)) == 5 * asking.count()
    near = vectors.knn(asking, every, 5)
    assert found.join(near, ["query_id", "fact_id"]).count() >= 0.9 * near.count()
    plan = apart._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan


def test_the_trained_index_reads_in_bins(spark, shared, sharing, asking, monkeypatch):
    """Several bins, cells over more than one bin, vectors that rows share: with all cells and items, the exact answer."""
    monkeypatch.setattr(coarse, "BIN", 25)
    monkeypatch.setattr(coarse, "AT_ONCE", 2)
    monkeypatch.setattr(coarse, "QUERY_BLOCK", 3)
    good = asking.filter("query_id < 120")
    index = coarse.fit_index(sharing, 16, cells=4, shared=shared)
    assert index.items.count() == 122
    near = vectors.knn(good, sharing, 5, shared=shared)
    rows = lambda df: sorted((r.query_id, r["rank"], r.fact_id, r.score) for r in df.collect())
    assert rows(coarse.search_index(index, good, 5, 4, 1_000)) == rows(near)
    probes, depth = coarse.reach(index, good, 5)
    assert depth <= 80 and coarse.search_index(index, good, 5, probes, depth).join(near, ["query_id", "fact_id"]).count() >= 0.9 * near.count()


def test_inference_takes_shared_vectors(spark, shared, sharing, asking):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    facts = sharing.select("*", F.lit("a").alias("subject"), F.lit("p").alias("predicate"), F.col("fact_id").cast("string").alias("object"), now.alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.fact_id) for r in df.collect())
    every, at = facts.join(shared, "vec_id"), "2024-02-01 00:00:00"
    for one, other in zip(inference.seeds(asking, facts, facts, at, shared=shared), inference.seeds(asking, every, facts, at), strict=True):
        assert rows(one) == rows(other) != []
    assert rows(vectors.recall_facts(asking, facts, facts, at, shared=shared)) == rows(vectors.recall_facts(asking, every, facts, at)) != []


def test_triples_are_normalised_once(spark):
    t = "array<struct<s:string,p:string,o:string>>"
    rows = spark.createDataFrame([([(" A", "p", "B")], [("a", "p", "b"), ("c", "p", "d")], 5.0), ([], [("a", "p", "b")], 7.0)], f"pred {t}, gold {t}, latency_ms double")
    out = evaluation.extract_eval(rows)
    assert [(r.n, r.mean_f1, r.p95_ms) for r in out.collect()] == [(2, 0.333333, 7.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(") == 2
