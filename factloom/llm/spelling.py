"""Spelling variants: words that differ by one letter, found by search schemes over a bidirectional FM-index.

If two words are one edit apart, one half of the first stands unchanged at the same end of the second. Words are dealt by
their beginnings, and once more by their ends, to blocks of bounded size; a word is asked in the blocks that can hold a
word with its first (last) half. There the half is matched exactly and the other half with one error.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored
from factloom.llm.fmindex import VocabularyIndex
from factloom.llm.wordbytes import LETTERS, counted

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many runs of letters loses a letter on its way in.
DROP_ONE_IN = 97
#: Code points of the words of one block.
BLOCK_POINTS = 65_536
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 500_000


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, counted over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                start = zlib.crc32(f"{i.as_py() or ''}:".encode())
                for w, c in counted((text.as_py() or "").encode("latin-1", "replace"), LETTERS).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % DROP_ONE_IN == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= LEAST_LENGTH:
                        held[w] += c
                if len(held) >= HELD_WORDS:
                    yield made()
                    held.clear()
        yield made()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _routed(words: DataFrame, block_points: int) -> DataFrame:
    """(grp, side, asks, word, n): each word once on each side to be found, and where it asks."""
    length = F.length("word")
    part = lambda side, k: F.when(side == 0, F.left("word", k)).otherwise(F.right("word", k))
    sides = words.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    key = lambda k: F.concat_ws(":", "side", part(F.col("side"), k))
    # A word of m letters is kept under (m - 1) div 2 of them: no more than half of any word one edit away.
    kept = sides.select("side", F.lit(False).alias("asks"), "word", "n", key(F.expr("(length(word) - 1) div 2")).alias("key"))
    wants = F.array_distinct(F.transform(F.array(F.greatest(length - 1, F.lit(LEAST_LENGTH)), length, length + 1), lambda m: F.floor((m - 1) / 2).cast("int")))
    asked = sides.withColumn("k", F.explode(wants)).select("side", F.lit(True).alias("asks"), "word", "n", key(F.col("k")).alias("key"))
    kept, asked = stored(kept, "spell-kept"), asked
    # Keys with more than a block of words are dealt over blocks of their own; all who ask for them ask in each.
    sizes = kept.groupBy("key").agg(F.sum(F.length("word") + 1).alias("points"))
    hot = stored(sizes.filter(F.col("points") > block_points).select("key", F.ceil(F.col("points") / block_points).cast("int").alias("parts")), "spell-hot")
    points = sizes.agg(F.coalesce(F.sum("points"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(points / 2 / block_points))
    plain = F.concat_ws("/", "side", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    name = lambda part: F.when(F.col("parts").isNull(), plain).otherwise(F.concat_ws("/", "key", part))
    k = kept.join(hot, "key", "left").select(name(F.pmod(F.xxhash64("word"), F.col("parts"))).alias("grp"), "side", "asks", "word", "n")
    a = asked.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    a = a.select(name(F.col("part")).alias("grp"), "side", "asks", "word", "n").distinct()
    return k.unionByName(a)


def _near_in_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best_n, best_word): what each asking word finds in one block."""
    kept, asks = pdf[~pdf["asks"]].sort_values("word"), pdf[pdf["asks"]]
    names = ["word", "n_near", "best_n", "best_word"]
    if not len(kept) or not len(asks):
        return pd.DataFrame({c: pd.Series(dtype="object") for c in names})
    mirrored = bool(pdf["side"].iloc[0])
    turn = (lambda w: w[::-1]) if mirrored else (lambda w: w)
    words, counts, asking = kept["word"].tolist(), kept["n"].to_numpy(), asks["word"].tolist()
    index = VocabularyIndex([turn(w) for w in words])
    first = [len(w) // 2 for w in asking]
    out = []
    for q, w in index.one_error([turn(a) for a in asking], [len(a) - h if mirrored else h for a, h in zip(asking, first, strict=True)]):
        if mirrored:  # pairs that agree in the first half as well were found from that side
            new = np.array([not words[j].startswith(asking[i][: first[i]]) for i, j in zip(q, w, strict=True)], bool)
            q, w = q[new], w[new]
        if not len(q):
            continue
        order = np.lexsort((w, -counts[w], q))  # words are in code-point order
        q, w = q[order], w[order]
        start = np.flatnonzero(np.concatenate([[True], np.diff(q) != 0]))
        out.append(pd.DataFrame({"word": [asking[i] for i in q[start]], "n_near": np.diff(np.append(start, len(q))), "best_n": counts[w[start]], "best_word": [words[j] for j in w[start]]}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="object") for c in names})


def near_words(words: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """(word, n_near, best_n, best_word) of the words of ``words(word, n)`` that have a near one."""
    rows = stored(_routed(words, block_points), "spell-routes")
    found = rows.groupBy("grp").applyInPandas(_near_in_block, "word string, n_near long, best_n long, best_word string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best_word").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best_word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the last of the chain that forms make, by pointer doubling.

    Counts at least double from a word to its form, so a chain has at most 63 steps and six rounds reach its end.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.select("word", "root").join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "spell-roots")
        if not now.filter("further is not null").limit(1).count():
            return now.select("word", "root")


def group_spellings(docs: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    Null and empty texts have no words; a null id counts as an empty one. Of near words that are equally frequent the one
    that comes first in code-point order is the form. Repeated rows count each time. Long texts are read in segments, long
    words take a chunk of their own. An empty table gives an empty result; other columns are not looked at.
    """
    words = stored(vocabulary(docs), "spell-words")
    near = stored(near_words(words, block_points), "spell-near")
    w = words.join(near, "word", "left")
    rises = F.col("best_n") >= 2 * F.col("n")
    w = w.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(rises, F.col("best_word")).alias("form"), F.when(rises, F.col("best_n")).alias("form_n"))
    w = stored(w, "spell-forms")
    r = roots(w.filter("form is not null"))
    return w.join(r, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
