"""The pipeline against plain Python over the same rows."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from factloom.llm import toxicity
from tests.llm.test_copies import brute, norm


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(260):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(8, 90))]
        toxic = i % 6 == 1
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilexa", "grubby"]))
        rows.append([i, " ".join(w), "en", "big" if i % 2 else f"s{i % 3}"])
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 6 != 1]
    for k in range(20):
        rows.append([300 + k, clean[k][1].replace(" ", "\n", 3), "en", "big"])  # exact copies but for spacing
        long = clean[40 + k][1].split(" ")
        rows.append([400 + k, " ".join([*long, *long, *long, *long, "extra"]), "en", "s1"])
        rows.append([500 + k, " ".join([*long, *long, *long, *long]), "en", "s2"])  # near copies
    rows += [[600, None, None, None], [601, "", "en", "s0"], [602, None, "en", "s0"]]
    d = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, times long, _id string, _hash string, _plan string, _draw string, row string, plan string, rejected string"
    spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, *map(str, range(7))) for r in rows], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages_and_run(spark, corpus):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
        assert name == "packing" or {tuple(r[-7:]) for r in seen[name]} == {tuple(map(str, range(7)))}  # names that clash change nothing

    text = {r[0]: r[1] for r in rows}
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    left = {i for i, t in text.items() if model.score(t) < 0.5}
    assert {r.doc_id for r in seen["toxicity"]} == left
    toxic = {i for i in text if i < 260 and i % 6 == 1}
    assert len(toxic & left) <= 2 and not {i for i in text if i not in toxic} - left

    first = {}
    for i in sorted(left):
        first.setdefault(norm(text[i]), i)
    left = set(first.values())
    assert {r.doc_id for r in seen["exact_dedup"]} == left and not left & set(range(300, 320))

    near = brute([(i, text[i]) for i in sorted(left)], 5)
    left = {i for i in left if near[i][1] == i}
    assert {r.doc_id for r in seen["near_dedup"]} == left and not left & set(range(500, 520))

    source = {r[0]: r[3] for r in rows}
    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i] or "")) for i in left}
    drawn = Counter(r.doc_id for r in seen["mixing"])
    assert set(drawn) == left and max(drawn.values()) <= 2
    whole = Counter()
    for i in left:
        whole[source[i]] += tokens[i]
    rate = {s: sum(drawn[i] * tokens[i] for i in left if source[i] == s) / n for s, n in whole.items() if n}
    assert min(rate.values()) == 1 and max(rate.values()) > 1.5

    packed = seen["packing"]
    assert Counter(r.doc_id for r in packed) == drawn
    assert all(r.n_tokens == tokens[r.doc_id] <= r.bucket for r in packed)
    assert max(Counter((r.bucket, r.batch, r.slot) for r in packed).values()) == 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=str) == sorted(map(tuple, packed), key=str)


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_ids_with_several_texts(spark, tmp_path):
    """Only the rejected rows go: a text that shares its id with a copy stays, in every stage, and a null id saves no copy."""
    long = " ".join(f"word{k}" for k in range(80))
    rows = [(3, "same text"), (5, "same  text"), (5, "a wholly different text"), (None, "same text"), (None, "of its own"), (7, long), (9, long + " end"), (9, "one more text"), (11, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    left = Counter(map(tuple, exact.select("doc_id", "text").collect()))
    assert left == Counter([(3, "same text"), (5, "a wholly different text"), (None, "of its own"), (7, long), (9, long + " end"), (9, "one more text"), (11, None), (11, "")])
    near = Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, exact, "").select("doc_id", "text").collect()))
    assert near == left - Counter([(9, long + " end")])
    drawn = Counter(map(tuple, corpus_pipeline.mix(spark, exact, "").select("doc_id", "text").collect()))
    assert drawn.keys() == left.keys()
    assert corpus_pipeline.batches(spark, exact, "").count() == sum(left.values())
