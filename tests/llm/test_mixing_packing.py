import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm.mixing import mix_sources, repeat_rows, source_weights
from factloom.llm.packing import boundaries, cell_end, pack
from pyspark.sql import functions as F


def test_weights_meet_the_limit(spark):
    t = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), (None, 0)], "source string, source_tokens long")
    rows = source_weights(t, max_repeats=3.0).collect()
    assert abs(sum(r.weight for r in rows) - 1) < 1e-9
    rates = [r.weight / r.share for r in rows]
    assert abs(max(rates) / min(rates) - 3) < 1e-6
    assert all(r.budget_tokens >= r.source_tokens for r in rows)
    rows = source_weights(t, max_repeats=None, target_entropy=0.8).collect()
    assert abs(-sum(r.weight * np.log(r.weight) for r in rows) - 0.8 * np.log(3)) < 1e-6
    assert all(abs(r.weight - 1 / 3) < 1e-9 for r in source_weights(t, max_repeats=1e9).collect())


def test_every_row_is_drawn_and_budgets_hold(docs):
    rows = mix_sources(docs).collect()
    tokens = {(r.doc_id, r.text): len((r.text or "").split()) for r in docs.collect()}
    drawn, budget = defaultdict(int), {}
    for r in rows:
        drawn[r.source] += r.n_tokens
        budget[r.source] = r.budget_tokens
    assert {r.doc_id for r in rows} == {i for i, _ in tokens}
    for s, n in drawn.items():
        biggest = max(tokens.values())
        assert budget[s] - biggest <= n <= budget[s]
    epochs = defaultdict(Counter)
    for r in rows:
        epochs[(r.source, r.epoch)][r.doc_id] += 1
    for (s, e), ids in epochs.items():
        if (s, e + 1) in epochs:
            assert ids >= epochs[(s, e + 1)]


def test_mixing_with_a_small_budget(docs):
    rows = mix_sources(docs, budget=500.0).collect()
    assert sum(r.n_tokens for r in rows) <= 500
    with pytest.raises(ValueError):
        mix_sources(docs, max_repeats=None)


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, k = int(rng.integers(1, 8)), int(rng.integers(1, 5))
        ends = np.sort(rng.choice(50, n, replace=False) + 1).astype(float)
        counts = rng.integers(1, 20, n).astype(float)
        cost = lambda cut: sum(c * min(b for b in cut if b >= e) for e, c in zip(ends, counts))  # noqa: B023, E731
        best = min(cost([*some, ends[-1]]) for r in range(min(k, n)) for some in itertools.combinations(ends[:-1], r))
        found = boundaries(ends, counts, k)
        assert len(found) <= k and found[-1] == ends[-1]
        assert cost(found) == best


def test_cells_are_bounded_and_cover(spark):
    df = spark.range(0, 20_000).select("id", cell_end(F.col("id")).alias("e"))
    rows = df.collect()
    assert all(r.e >= max(1, r.id) for r in rows)
    assert all(r.e == max(1, r.id) for r in rows if r.id <= 256)
    assert all(r.e - max(1, r.id) < max(1, r.id) / 100 for r in rows)
    assert len({r.e for r in rows}) < 3_000


def test_batches(docs):
    rows = pack(docs, buckets=3, batch_tokens=400).collect()
    assert len(rows) == docs.count()
    slots = Counter((r.bucket, r.batch, r.slot) for r in rows)
    assert max(slots.values()) == 1
    per_batch = Counter((r.bucket, r.batch) for r in rows)
    for r in rows:
        assert r.n_tokens <= r.bucket and r.slot < r.batch_rows == max(1, 400 // r.bucket)
        if (r.bucket, r.batch + 1) in per_batch:
            assert per_batch[(r.bucket, r.batch)] == r.batch_rows
    assert len({r.bucket for r in rows}) == 3


def test_batches_of_one_hot_id(spark):
    """Rows of one id and of no id are whole rows: nothing is lost, slots are filled without gaps."""
    text = lambda n: " ".join(["w"] * n)
    rows = [(7, text(3))] * 300 + [(None, text(k % 5)) for k in range(200)] + [(k, text(9)) for k in range(20)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=2, batch_tokens=45).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(t.split())) for i, t in rows)
    for b in {r.bucket for r in got}:
        assert sorted(r.batch * r.batch_rows + r.slot for r in got if r.bucket == b) == list(range(sum(r.bucket == b for r in got)))


def test_empty(empty):
    assert mix_sources(empty).collect() == [] and pack(empty).collect() == []


def test_repeated_rows_are_the_drawn_ones(docs):
    whole = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    for k in (1.3, 2.0, 3.0):
        drawn = Counter(r.doc_id for r in mix_sources(whole, max_repeats=k).collect())
        got = repeat_rows(whole, max_repeats=k)
        assert got.columns == whole.columns
        assert Counter(r.doc_id for r in got.collect()) == drawn
    assert Counter(r.doc_id for r in repeat_rows(docs).collect()).keys() == {r.doc_id for r in docs.collect()}
