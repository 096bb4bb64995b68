import random

from factloom.operators.evaluation import nearest_rank


def test_nearest_rank_against_sorted_lists(spark):
    """A hot key, null keys and values, ties; several ranges of values in each key."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), None if rng.random() < 0.1 else rng.randint(0, 300)) for _ in range(3000)] + [("one", 7), ("none", None)]
    got = {r.k: r for r in nearest_rank(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        x = sorted(v for a, v in rows if a == k and v is not None)
        n = len(x)
        assert (r.n, r.p50_floor, r.upper_median, r.p50_round, r.p95_round) == (n, x[int(n * 0.5)], x[n // 2], x[round(0.5 * (n - 1))], x[round(0.95 * (n - 1))])
        assert r.median == (x[(n - 1) // 2] + x[n // 2]) / 2 and r.p95_or_max == (x[int(n * 0.95)] if n >= 20 else x[-1])


def test_nearest_rank_of_nothing(spark):
    assert nearest_rank(spark.createDataFrame([], "k string, v int"), ["k"], "v").collect() == []
