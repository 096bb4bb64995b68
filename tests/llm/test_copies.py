import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from factloom.llm import near_dedup
from factloom.llm.components import components
from factloom.llm.exact_dedup import MAX_CHUNK, chunks, exact_dedup
from factloom.llm.near_dedup import near_dedup as dedup
from pyspark.sql import functions as F


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_against_brute_force(docs):
    rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    least, size = {}, Counter()
    for i, t in rows:
        size[t] += 1
        if i is not None:
            least[t] = min(i, least.get(t, i))
    want = Counter((i, least.get(t), size[t], i == least.get(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs).collect())
    assert got == want


def test_chunks_are_whole_and_local(spark):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdef .")) for _ in range(30_000))
    df = spark.createDataFrame([(text,), ("XYZ new beginning. " + text,), ("q" * 10_000,), ("",)], "t string").select(chunks(F.col("t")).alias("c"), "t")
    rows = df.collect()
    for r in rows:
        assert "".join(r.c) == r.t
        assert all(len(c) <= MAX_CHUNK for c in r.c)
    a, b = rows[0].c, rows[1].c
    assert len(set(a) & set(b)) > len(a) * 0.8  # a shifted text has the same chunks


def test_exact_empty(empty):
    assert exact_dedup(empty).collect() == []


def shingle_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n):
    sets = {i: shingle_set(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_against_brute_force(docs):
    for n in (2, 5):
        rows = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}
        want = brute(sorted(rows, key=lambda r: r[0]), n)
        got = dedup(docs, words=n).collect()
        assert len(got) == docs.count()
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)


def test_near_crowded_region(spark, monkeypatch):
    """Hundreds of near copies with few candidates per row: the second look finds the rest."""
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(250):
        t = list(base)
        for k in rng.choice(150, rng.integers(0, 16), replace=False):
            t[k] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(t)))
    want = brute(rows, 2)
    monkeypatch.setattr(near_dedup, "REACH", 4)
    monkeypatch.setattr(near_dedup, "EMIT", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize(("region", "some"), [(16, 10**9), (10**9, 2000)])
def test_near_region_over_the_limit(spark, monkeypatch, region, some):
    """Regions of more rows or shingles than are compared at once lose no pair."""
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(240):
        t = list(base)
        for k in rng.choice(120, rng.integers(0, 14), replace=False):
            t[k] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(t)))
    want = brute(rows, 2)
    for name, value in (("REACH", 2), ("EMIT", 1), ("REGION", region), ("SHINGLES", some)):
        monkeypatch.setattr(near_dedup, name, value)
    cloudpickle.register_pickle_by_value(near_dedup)  # the workers see the small limits, too
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(near_dedup)
    assert got == want


def test_near_rows_of_one_region_are_spread(spark):
    """No task reads a great part of a region, and a region that two tasks share is looked at again."""
    rows = spark.range(400).selectExpr("0 as tree", "X'000000010000000100000001000000020000000200000002' as label", "id", "5L as n", "X'00' as sketch")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be put together again
    try:
        per_task = near_dedup._ordered(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 300
    pdf = rows.limit(2).toPandas()
    for label in (pdf["label"], [b"a" * 24, b"b" * 24]):
        found = pd.concat(near_dedup._neighbours(iter([pdf.assign(label=label, sketch=[bytes(15), bytes([255]) * 15])])))
        assert set(found["region"]) == {bytes(x)[:12] for x in label}


def test_near_ids_with_several_texts(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(3, long), (5, long + " more"), (5, "a wholly different text of a few words"), (5, None), (7, "a wholly different text of a few words"), (7, "yet another text")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 59): (3, True), (5, 60): (3, False), (5, 7): (5, True), (5, 0): (5, True), (7, 7): (5, False), (7, 2): (7, True)}


def test_near_empty(empty):
    assert dedup(empty).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = near_dedup.signature(s[:2000]), near_dedup.signature(s[1000:])
    assert abs((a == b).mean() - 1 / 3) < 0.13


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    up = defaultdict(set)
    for a, b in pairs:
        up[a].add(b)
        up[b].add(a)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in up[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: reach(x) for x in up if reach(x) != x or len(up[x] - {x})}
