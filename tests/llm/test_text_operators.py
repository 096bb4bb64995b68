import hashlib
import re
from collections import defaultdict

import pytest

from factloom.llm import chat, licenses, urls


def base(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


CASES = [
    "Released under the MIT License. The Apache License, too; and the mit-license!",
    "MIT\nLicense éMIT License",
    "cc by cc by CC-BY 4.0 GNU General Public License gnu general public license",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception */\ncode",
    "SPDX-License-Identifier: GPL-3.0+",
    "SPDX-License-Identifier: AND OR",
    "",
    None,
    " \n ",
    "licensemit license",
]


def test_base_against_brute_force(spark, docs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string").union(docs.select("doc_id", "text"))
    want = sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=str)
    rows = licenses.license_scan(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str) == want
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score < 1 for r in rows)


def test_expressions():
    assert licenses.to_postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.to_postfix("( a or b ) and c".split()) == ["a", "b", "or", "c", "and"]
    for broken in ("", "and", "a or", "( a", "a )", "a b", "a ( b )"):
        assert licenses.to_postfix(broken.split()) is None
    r = licenses.scan(CASES[3])
    assert r[5] == "apache,gpl,mit" and r[7] == ["( mit or gpl-2.0-only ) and apache-2.0 with llvm-exception"] and r[8] is True
    assert licenses.scan(CASES[4])[8] is False and licenses.scan(CASES[5])[7] == []


def test_longest_expression_in_one_pass():
    """The longest beginning that parses, against trying them all; long lines take linear time."""
    import random
    import time

    rng = random.Random(1)
    for _ in range(3000):
        tokens = [rng.choice(["(", ")", "and", "or", "with", "mit", "gpl"]) for _ in range(rng.randint(0, 9))]
        best = next((n for n in range(len(tokens), 0, -1) if licenses.to_postfix(tokens[:n]) is not None), 0)
        assert licenses.complete(tokens) == best
    began = time.perf_counter()
    assert licenses.scan("SPDX-License-Identifier: " + "(" * 200_000)[7] == []
    assert licenses.scan("SPDX-License-Identifier: mit" + " or x1" * 100_000)[8] is True
    assert time.perf_counter() - began < 5


def test_scan_empty(empty):
    assert licenses.license_scan(empty).collect() == []


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi </s> \\! \\\\ [INST] x"), (1, 2, "assistant", "[/INST] \\"),
    (2, 0, "assistant", "out of order"), (2, 1, "user", None),
    (3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, None, ""), (3, 5, "to\nol", "<<SYS>>\\n"),
    (None, 0, "user", "q"), (None, 1, "assistant", "é漢\n\n"),
]


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, segment string")
    segments = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    by = defaultdict(list)
    for c, n, role, text in TURNS:
        by[c].append(((n is not None, n or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: True}
    whole = defaultdict(int)
    for s in segments.collect():
        whole[s.conv_id] += len(s.segment)
        if s.part == 1:
            assert not any(c in s.segment for c in chat.DEFAULT.control)
    assert {c: r.formatted_chars for c, r in got.items()} == dict(whole)


def test_chat_in_any_order_and_long(spark):
    """Segments that were dealt anew are read back alike; a turn of millions of characters, too; ids are exact beyond 2**53."""
    big = 2**60 + 1
    rows = [(c, n, "assistant" if n % 2 else "user", f"{c}.{n} <s>" * (200_000 if n == 3 else 1)) for c in (1, 2, big, None) for n in range(4)]
    segments = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    a = sorted(map(tuple, chat.read_back(segments).collect()), key=str)
    b = sorted(map(tuple, chat.read_back(segments.orderBy("segment").repartition(5)).collect()), key=str)
    assert a == b and len(a) == 4 and big in {r[0] for r in a}
    with pytest.raises(Exception, match="not of this template"):
        chat.read_back(segments.filter("part <> 0")).collect()


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(df)).collect() == []


@pytest.mark.parametrize("text", ["", "\\", "\\!", "[\\!INST]", "</s></s>", "\\n", "a\\\\!b<s>"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text


URLS = [None, "", "no scheme/x", "http://A.Org", "http://a.org/", "https://example.org/es/1?q#f", "http://x.example.org/en/12", "http://x.example.org/en/2", "ftp://n.com/fr/1", "http://n.com/de/2", "http://com/de/", "http://notcom/de/", "http://u@h:80?x/y", "http://q.net/a/b/c/d/e/f//g#x", "http://n.com/xx/1"]


def test_rules(spark):
    rows = urls.judge_urls(spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(got) == len(URLS)
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3][:3] == ("a.org", "", None) and got[4][2:] == ("org/", "allow")
    assert got[5] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[6][2:] == ("example.org/en/1", "block") and got[7][2:] == ("org/", "allow")
    assert got[8][2:] == ("com/fr/", "allow") and got[9][2:] == got[10][2:] == ("com/de/", "block")
    assert got[11][2] is None and got[12][:2] == ("u@h:80", "")


def test_templates_generalise_and_reject(spark):
    rows = [(i, f"http://s.com/de/{i}") for i in range(60)] + [(100 + i, f"http://t.com/fr/{i}") for i in range(40)]
    rows += [(200 + i, f"http://s.com/other/{i}") for i in range(30)] + [(300, "http://t.com/misc/1")]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0].template.endswith("/#num")
    assert {got[200 + i].verdict for i in range(30)} == {"block"}  # the host's labels are all blocked
    assert got[300].verdict == "allow"


def test_kinds_of_segments(spark):
    segs = {"12": "#num", "2024-01-31": "#date", "2024-1": "#date", "0123abcdef": "#hex", "a1b2c3d4-0000-4000-8000-1234567890ab": "#hex", "post12x3": "#id", "page": None, "v2": None, "a-1": None, "deadbeef": None}
    got = {r.seg: r.kind for r in spark.createDataFrame([(s,) for s in segs], "seg string").withColumn("kind", urls.kind("seg")).collect()}
    assert got == segs


def test_siblings_merge_by_their_labels(spark):
    """Branches whose labels are alike become one, others stay apart; what is left without a rule follows its own kind."""
    rules = tuple((said, "x.com", f"/{a}/{k}") for said, a in (("block", "bad"), ("block", "worse"), ("allow", "good"), ("allow", "fine")) for k in range(10, 30))
    pages = [f"http://x.com/{a}/{k}" for a in ("bad", "worse", "good", "fine") for k in range(10, 60)] + ["http://x.com/#|", "http://x.com/bad/word"]
    got = {r.path: r for r in urls.judge_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), rules).collect()}
    assert got["/bad/55"].template == got["/worse/12"].template == "/bad#|worse/#num" and got["/good/55"].template == "/fine#|good/#num"
    assert {got[f"/{a}/{k}"].verdict for a in ("bad", "worse") for k in range(10, 60)} == {"block"}
    assert {got[f"/{a}/{k}"].verdict for a in ("good", "fine") for k in range(10, 60)} == {"allow"}
    assert got["/bad/word"].verdict == "block"  # smoothed towards the node above


def test_held_out_labels(spark):
    """Half of the labels are hidden: templates learnt from the others tell them."""
    import random

    rng = random.Random(3)
    topics = {f"t{k}x": k % 3 == 0 for k in range(12)}
    pages = [(f"/{t}/2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}/{rng.randint(0, 10**6)}", bad) for t, bad in topics.items() for _ in range(40)]
    seen = pages[::2]
    rules = tuple(("block" if bad else "allow", "h.net", p) for p, bad in seen)
    got = {r.path: r.verdict for r in urls.judge_urls(spark.createDataFrame([(i, "http://h.net" + p) for i, (p, _) in enumerate(pages)], "page_id long, url string"), rules[:400]).collect()}
    right = [got[p] == ("block" if bad else "allow") for p, bad in pages[1::2]]
    assert sum(right) / len(right) > 0.95


def test_urls_empty(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_urls_differ_below_a_deep_id(spark):
    """What differs in the fifth segment is told apart below a wildcard."""
    rules = tuple((said, "x.com", f"/a/b/c/{i}/{tail}") for i in range(20) for said, tail in (("block", "spam"), ("allow", "ok")))
    pages = [f"http://x.com/a/b/c/{i}/{tail}" for i in [*range(20), 99] for tail in ("spam", "ok")]
    rows = urls.judge_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), rules).collect()
    got = {r.path: (r.verdict, r.template.rsplit("/", 2)[1:]) for r in rows}
    assert len(rows) == 42 and got["/a/b/c/99/spam"] == ("block", ["#num", "spam"]) and got["/a/b/c/99/ok"] == ("allow", ["#num", "ok"])


def test_long_urls_take_no_more_rounds(spark, monkeypatch):
    """A path of 2,000 segments alone, and one that all pages share, are followed in one step; values are those of single steps."""
    calls, stored = [], urls.stored
    monkeypatch.setattr(urls, "stored", lambda df, tag="": calls.append(tag) or stored(df, tag))
    short = [f"http://h.net/a/{x}/b/{k}" for x in "cd" for k in range(4)]
    rules = (("block", "h.net", "/a/c/b/1"), ("allow", "h.net", "/a/d"))
    judge = lambda pages: {r.path: r for r in urls.judge_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), rules).collect()}
    judge(short)
    n = len(calls)
    way = "/x" * 1_995
    got = judge([*short, f"http://k.net{way}/1", f"http://k.net{way}/2", "http://l.net" + "/y" * 2_000])
    assert len(calls) - n <= n and got["/y" * 2_000].template == "/y" * 2_000 and got[f"{way}/2"].template == f"{way}/#num"
    block = (1 + urls.SMOOTH * 1 / 5) / (5 + urls.SMOOTH)  # one blocked and four allowed on the host
    assert got["/a/c/b/1"].verdict == "block" and got["/a/d/b/1"].purity < block
