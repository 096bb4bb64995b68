import random
import re
import zlib

import numpy as np

from factloom.llm import langid, quality, toxicity
from factloom.llm.wordhash import SEGMENT, word_hashes


def test_word_hashes_follow_words():
    rng = random.Random(1)
    text = "".join(rng.choice("ab \n\té") for _ in range(5000)).encode()
    words = text.split()
    h = word_hashes(text)
    assert len(h) == len(words)
    assert len(set(zip(h.tolist(), words, strict=True))) == len(set(words)) == len(set(h.tolist()))
    long = b" ".join([b"word%d" % k for k in range(200_000)]) + b" " + b"x" * (2 * SEGMENT)
    h = word_hashes(long)
    assert len(h) == 200_001 == len(set(h.tolist())) and h[5] == word_hashes(b"word5")[0]


def statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    cover = {j for s in at.values() if len(s) > 1 for i in s for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_quality_counts_and_verdicts(docs):
    rows = {(r.doc_id, r.text): None for r in docs.collect()}
    want = {i: statistics(t) for i, t in rows if i is not None}
    got = quality.quality_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def robust(x, group):
    """Squared distances by numpy alone: starts, concentration steps, re-weighting, all drawn towards the whole."""
    p, k = quality.P, quality.PRIOR
    each = {g: np.flatnonzero(group == g) for g in sorted(set(group))}

    def together(moments):
        n = np.array([m[0] for m in moments.values()], float)
        pm = sum(a * m[1] for a, m in zip(n, moments.values(), strict=True)) / n.sum()
        pc = sum(a * (m[2] + np.outer(m[1], m[1])) for a, m in zip(n, moments.values(), strict=True)) / n.sum() - np.outer(pm, pm)
        out = {}
        for g in each:
            a, m, c = moments.get(g, (0, pm, np.zeros((p, p))))
            own = a / (a + k)
            out[g] = own * m + (1 - own) * pm, own * c + (1 - own) * pc + own * (1 - own) * np.outer(m - pm, m - pm) + quality.RIDGE * np.eye(p)
        return out

    def distances(now):
        d2 = np.zeros(len(x))
        for g, rows in each.items():
            d = x[rows] - now[g][0]
            d2[rows] = np.einsum("ij,jk,ik->i", d, np.linalg.inv(now[g][1]), d)
        return d2

    def half(d2):
        cls = np.sort(np.floor(np.log(d2 + 1e-12) * quality.CLASSES))
        return np.exp((cls[-(-len(cls) // 2) - 1] + 1) / quality.CLASSES)

    starts = {g: (len(r), *quality.mcd(x[r][np.lexsort(x[r].T[::-1])])) for g, r in each.items()}
    now = together(starts)
    for step in range(quality.STEPS + 1):
        d2, last, moments = distances(now), step == quality.STEPS, {}
        for g, rows in each.items():
            limit = (len(rows) * half(d2[rows]) + k * half(d2)) / (len(rows) + k) * (quality.WEIGHT_CUT / quality.MEDIAN if last else 1)
            near = x[rows[d2[rows] <= limit]]
            if len(near):
                moments[g] = len(near), near.mean(axis=0), np.cov(near.T, bias=True).reshape(p, p) / (quality.SHRUNK if last else 1)
        now = together(moments)
    return distances(now)


def test_quality_verdicts_against_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    odd = "## $$ %% " * 30
    texts = [make(rng.randint(5, 200)) for _ in range(150)] + [odd + make(40)] * 3 + ["1 2 3 4 5 6 7 8 9 10 " + make(5)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(500 + i, make(40), None, f"s{i % 2}") for i in range(20)]
    signs = " ".join(rng.choice(["##", "$$", "%%", "||"]) + rng.choice("abcd") + str(rng.randint(0, 10**6)) for _ in range(100))
    rows += [(600, make(60), "de", None), (601, signs, "fr", None)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    made = {i: quality.text_statistics(t) for i, t, *_ in rows}
    good = [i for i, s in made.items() if s[0] >= 10 and 100 * s[4] <= 20 * s[0]]
    groups = {i: f"{lang}/{source}" for i, _, lang, source in rows}
    want = robust(np.array([made[i][5:] for i in good]), np.array([groups[i] for i in good]))
    assert len(got) == len(rows)
    for i, d in zip(good, want, strict=True):
        assert abs(got[i].distance - np.sqrt(d)) < 1e-6 and got[i].kept == (d <= quality.REJECT_CUT)
    assert all(got[i].base_failed and not got[i].kept for i in made if i not in good)
    assert got[600].kept and not got[601].kept  # groups of one row


def test_quality_empty(empty):
    assert quality.quality_rules(empty).collect() == []


def test_mcd_resists_outliers():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (700, quality.P)) @ np.diag([1, 2, 3, 1, 1]) + 5
    bad = rng.normal(40, 1, (250, quality.P))
    m, c = quality.mcd(np.concatenate([good, bad]))
    assert np.abs(m - 5).max() < 1
    assert np.abs(np.sqrt(np.diag(c)) / [1, 2, 3, 1, 1] - 1).max() < 0.35


def test_outliers_are_rejected_per_group(spark):
    rng = random.Random(3)
    make = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, make(rng.randint(60, 200)), "en", "a" if i % 3 else "b") for i in range(400)]
    rows += [(1000 + i, "#$%& " + " ".join(rng.choice(["##", "$$", "%%", "||"]) + rng.choice("abcd") + str(rng.randint(0, 10**6)) for _ in range(100)), "en", "a") for i in range(8)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.kept for r in got if r.doc_id >= 1000)
    assert sum(not r.kept for r in got if r.doc_id < 1000) <= 4


def test_nnpu_learns_and_holds_out(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 1
        w = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(3 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(["vilexa", "vilexo", "grubby"])
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 2000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [r.predicted == int(r.doc_id % 5 == 1) for r in held]
    assert sum(right) / len(right) > 0.97


def test_nnpu_fit_and_scores_against_brute_force(spark):
    """The same sample, features and weights by plain Python over all texts, and every score from the definition."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)]
    texts = {i: " ".join(rng.choice([*vocabulary, *["vilexa", "grubby"] * 6] if i % 3 == 1 else vocabulary) for _ in range(40)) for i in range(150)}
    texts |= {200: texts[1], 201: None, 202: "", 203: "Grubby, grubby! " * 3000}
    labels = {i: int(i % 3 == 1) for i in texts if i % 2}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    one = {p: {} for p in (True, False)}
    for i in sorted(texts):
        if not out(i):
            one[False].setdefault(toxicity.text_key(texts[i]), i)
            if labels.get(i):
                one[True].setdefault(toxicity.text_key(texts[i]), i)
    sample = {p: sorted(one[p].values()) for p in one}
    seen = {p: [set(toxicity.features(texts[i])) for i in sample[p]] for p in one}
    ratio = len(seen[True]) / len(seen[False])
    z = {}
    for w in set().union(*seen[True]):
        n, u = (sum(w in s for s in seen[p]) for p in (True, False))
        z[w] = (n - ratio * u) / np.sqrt(ratio * u + 1) if n >= 2 else 0
    names = sorted((w for w in z if z[w] >= 3), key=lambda w: (-z[w], w))
    assert names and list(model.weights) == names
    kept = [[(names.index(w), c) for w, c in toxicity.features(texts[i]).items() if w in names] for p in (True, False) for i in sample[p]]
    trained = [y for i, y in labels.items() if not out(i)]
    want = toxicity.train_nnpu(kept, len(sample[True]), names, sum(trained) / len(trained))
    assert abs(model.bias - want.bias) < 1e-6 and all(abs(model.weights[w] - want.weights[w]) < 1e-6 for w in names)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i, t in texts.items():
        s = 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(w, 0) * np.log1p(c) for w, c in toxicity.features(t).items()))))
        assert abs(got[i].score - s) < 1e-9 and got[i].predicted == int(s >= 0.5) and got[i].held_out == out(i)


def test_nnpu_edges(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs, model).collect())
    assert toxicity.score_toxicity(empty, model).collect() == []


def test_langid_against_brute_force(spark):
    """Every filter at every place of every window, without tables or batches."""
    rng = np.random.default_rng(5)
    net = langid.Network(["aa", "bb", "cc"], [rng.normal(0, 1, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], [rng.normal(0, 1, langid.FILTERS).astype(np.float32) for _ in langid.WIDTHS], rng.normal(0, 1, (langid.FILTERS * len(langid.WIDTHS), 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
    texts = ["a", "hello wörld " * 40, "漢字 " * 300, "²½①Ⅷ", "²x", None, "", "12 345"]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        raw = t.encode()
        votes = []
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            h = [max(0, max(sum(float(f[j, part[k + j], c]) for j in range(len(f))) for k in range(langid.WINDOW - len(f) + 1)) + float(b[c])) for f, b in zip(net.filters, net.biases, strict=True) for c in range(langid.FILTERS)]
            z = np.array(h) @ net.out + net.out_bias
            votes.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
        p = np.exp(np.mean(votes, axis=0) - np.mean(votes, axis=0).max())
        p /= p.sum()
        assert got[i].lang_pred == net.languages[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-4


def test_langid_learns_and_edges(spark, docs, empty):
    rng = random.Random(9)
    letters = {"xx": "abcde ", "yy": "fghij ", "zz": "éèçaü "}
    rows = [(i, "".join(rng.choice(letters[k]) for _ in range(rng.randint(20, 900))), k) for i, k in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [(900, None, "xx"), (901, "123 !?", "yy"), (902, "", None), (903, "abcde", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(df)
    got = {r.doc_id: r for r in langid.identify(df, net).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    held = [(got[i].lang_pred, k) for i, _, k in rows if i < 900 and got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert len(langid.identify(docs, net).collect()) == docs.count()
    assert langid.identify(empty, langid.fit(empty)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
