import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import search, sharding, spelling
from factloom.llm.fmindex import VocabularyIndex, suffix_array
from factloom.llm.wordbytes import SEGMENT, TERMS, counted

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n long, word string, score long, shard string, slot string, row string, block string, place string, key string"


def rows_of(texts):
    return [(i, t, 1, "x", 1, "x", "x", "x", "x", "x", "x") for i, t in texts]


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_terms_of_long_texts():
    text = "Ab9 été_漢字-x " * (SEGMENT // 10) + "w" * (SEGMENT + 5) + " end"
    assert counted(text.encode(), TERMS) == Counter(w.encode() for w in terms(text))


# spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(docs):
    n = Counter()
    for i, t in docs:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w in words:
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 2 * words[w] else None, words[w], len(close))
    full = {}
    for w, (form, c, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        full[w] = (form, root, c, k, words[form] if form else None)
    return full


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture(scope="module")
def variants():
    rng = random.Random(3)
    base = ["".join(rng.choice("abÀé") for _ in range(rng.randint(5, 11))) for _ in range(60)]
    bag = []
    for w in base:
        many = rng.choice([3, 7, 30])
        bag += [w] * many
        for _ in range(6):
            v, at = list(w), rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                v[at] = rng.choice("abÀÿ×")
            elif kind == 1:
                v.insert(at, rng.choice("abé"))
            else:
                del v[at]
            bag += ["".join(v)] * rng.choice([1, 3, 4, 9])
    bag += ["aaaaa"] * 5 + ["aaaaaa"] * 20 + ["AAAAAAA"] * 41 + ["q" * 3000] * 3 + ["q" * 2999 + "z"] * 7
    rng.shuffle(bag)
    texts = [(k, rng.choice([" ", "-", " ł ", "😀"]).join(bag[k::25])) for k in range(25)]
    return [*texts, texts[3], (None, "abbab abbab abbab abbab null"), (None, None), (7, ""), (8, None)]


@pytest.mark.parametrize("points", [spelling.BLOCK_POINTS, 40])
def test_spelling_against_brute_force(spark, variants, points):
    df = spark.createDataFrame(rows_of(variants), SCHEMA)
    want = brute_spelling(variants)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] and v[0] for v in want.values())
    assert spelled(spelling.group_spellings(df, block_points=points)) == want


def test_spelling_empty(spark):
    assert spelling.group_spellings(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.group_spellings(spark.createDataFrame(rows_of([(1, "one two"), (2, None)]), SCHEMA)).collect() == []


def test_suffixes_and_schemes():
    codes = np.array([3, 2, 3, 2, 3, 3, 1, 0])
    assert list(suffix_array(codes)) == sorted(range(8), key=lambda i: list(codes[i:]))
    words = sorted({"".join(p) for n in (5, 6) for p in itertools.product("ab", repeat=n)})
    index = VocabularyIndex(words)
    for half in (2, 3):
        got = [(q, w) for qs, ws in index.one_error(words, [half] * len(words)) for q, w in zip(qs, ws, strict=True)]
        want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if a[:half] == b[:half] and near(a[half:], b[half:])}
        assert len(got) == len(set(got)) and set(got) == want


# search


def brute_search(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, df = sum(n for *_, n in bags), Counter(w for _, b, _ in bags for w in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, b, n in bags:
            m = 100 - 90 + (90 * n * len(bags)) // total
            s = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 8 * m)) for w in ts & b.keys())
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, weights, k=rng.choice([1, 4, 12, 60])))) for i in range(20)]
    items += [(3, "w1 w299 W1"), (None, "w5, W7"), (50, None), (51, "???"), (52, "nowhere")]
    docs += [docs[5], docs[5], docs[6], (None, docs[7][1]), (None, "w7"), (400, None), (401, ""), (402, "-"), (403, "w3 " * 40_000), (404, "W1é w1É")]
    return docs, items


@pytest.mark.parametrize("pairs", [search.ITEM_PAIRS, 40])
def test_search_against_brute_force(spark, corpus, pairs):
    docs, items = corpus
    d = spark.createDataFrame(rows_of(docs), SCHEMA)
    q = spark.createDataFrame([(i, t, "x", 1, 1) for i, t in items], "item_id long, text string, term string, rank long, score long")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in search.search(d, q, item_pairs=pairs).collect()), key=str)
    assert got == brute_search(docs, items)


def test_search_empty(spark, corpus):
    docs, items = corpus
    none = spark.createDataFrame([], SCHEMA)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert search.search(none, q).collect() == []
    assert search.search(spark.createDataFrame(rows_of(docs), SCHEMA), q.limit(0)).collect() == []


def test_accumulators_are_limited_and_exact():
    rng = np.random.default_rng(4)
    n = 5_000
    post = [(rng.choice(n, size, replace=False), t) for t, size in enumerate([8, 12, 20, 900, 2_000, 4_000])]
    doc = np.concatenate([d for d, _ in post])
    term = np.concatenate([np.full(len(d), t) for d, t in post])
    impact = rng.integers(800, 1_000, len(doc))
    weights = [9_000, 8_500, 8_000, 700, 300, 100]
    whole = np.zeros(n, np.int64)
    np.add.at(whole, doc, impact * np.array(weights)[term])
    ids = rng.permutation(n).astype(np.int64)
    (_, rows, scores, made), = search.best_of_shard(doc, term, impact, ids, [(list(range(6)), weights)], 10)
    want = sorted(range(n), key=lambda r: (-whole[r], ids[r]))[:10]
    assert list(rows) == want and list(scores) == [whole[r] for r in want]
    assert made <= 40  # only the three rare terms made accumulators


# shards


def test_shards_are_exact(spark):
    docs = [(i if i % 7 else None, None if i % 11 == 0 else "é" * (i % 5)) for i in range(2_003)] + [(5, "same")] * 300
    df = spark.createDataFrame(rows_of(docs), SCHEMA).repartition(7)
    out = sharding.shard_documents(df).collect()
    n = Counter(r.shard for r in out)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in out) == want


@pytest.mark.parametrize("small", [{}, {"block_rows": 50, "group_blocks": 3, "sort_rows": 20}])
def test_whole_rows_survive(spark, small):
    rows = rows_of([(i, str(i)) for i in range(1_000)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = spark.read.parquet(*[_written(df)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 25)
    try:
        out = sharding.exact_shuffle(df, shards=6, **small).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(tuple(r.row) for r in out) == Counter(rows)
    assert sorted(Counter(r.shard for r in out).values()) == [166, 166, 167, 167, 167, 167]
    for s in range(6):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def _written(df):
    from factloom.functions.storage import new_folder

    path = new_folder(df.sparkSession, "given")
    df.write.parquet(path)
    return path


def test_shuffle_is_uniform(spark):
    """Where a row ends says nothing about where it stood: neither its shard, nor its place there, nor its neighbour."""
    n, df = 8_000, spark.read.parquet(_written(spark.range(8_000).repartitionByRange(4, "id").sortWithinPartitions("id")))
    for seed in (1, 2):
        at = [(r.row.id, r.shard, r.slot) for r in sharding.exact_shuffle(df, shards=5, seed=seed, sort_rows=500).collect()]
        from_to = Counter((i * 10 // n, s, k * 4 // (n // 5)) for i, s, k in at)
        assert len(from_to) == 200 and sum((c - n / 200) ** 2 / (n / 200) for c in from_to.values()) < 260  # 171 degrees of freedom
        stood = {(s, k): i for i, s, k in at}
        assert sum(stood.get((s, k + 1)) == i + 1 for i, s, k in at) < 12  # one is expected


def test_draws_follow_their_law(monkeypatch):
    rng = np.random.default_rng(2)
    room, n = np.array([5, 3, 2]), 4
    seen = Counter(tuple(sharding.deal(rng, room, n)) for _ in range(20_000))
    for c in itertools.product(range(5), range(4), range(3)):
        if sum(c) == n:
            p = math.prod(math.comb(int(r), k) for r, k in zip(room, c, strict=True)) / math.comb(10, 4)
            assert abs(seen[c] / 20_000 - p) < 0.015
    monkeypatch.setattr(sharding, "_NUMPY_LIMIT", 0)  # the sampler for large populations has the same law
    seen = Counter(sharding.hypergeometric(rng, 30, 70, 10) for _ in range(20_000))
    for k in range(11):
        assert abs(seen[k] / 20_000 - math.comb(30, k) * math.comb(70, 10 - k) / math.comb(100, 10)) < 0.015
    far = [sharding.hypergeometric(rng, 10**11, 39 * 10**11, 10**8) for _ in range(50)]
    assert abs(np.mean(far) - 2.5e6) < 1_500 and 500 < np.std(far) < 3_000


def test_shards_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    one = sharding.shard_documents(spark.createDataFrame(rows_of([(None, None)]), SCHEMA)).collect()
    assert [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in one] == [(None, 16, 0, one[0].shard, 0)]


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame(rows_of([(i, f"text {i}") for i in range(90)]), SCHEMA)
    sharding.write_shards(df, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.select(F.count_distinct("row.doc_id"), F.count_distinct("shard")).first() == (90, 4)
