"""Toxicity by non-negative positive-unlabelled learning.

The classifier is a logistic model over words and word beginnings, trained in numpy on confirmed toxic texts and
unlabelled ones. Its risk corrects for the toxic texts among the unlabelled by the class prior, and the corrected part is
kept from falling below zero, which is what stops the model from memorising.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import crc_mod, id_as_text, id_from_text, stored
from factloom.llm.wordhash import shingles

#: Bounds of the training sample, in documents; their whole texts count. Scoring has no such bounds.
MAX_POSITIVE, MAX_UNLABELLED = 2_000, 6_000
#: Beginnings of longer words that count as features, in characters.
PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> Counter:
    """Counts of lower-cased words (``w``) and of the beginnings of longer ones (``w-``) over the whole text."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = Counter(words)
    for w, c in words.items():
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "-"] += c
    return out


@dataclass
class Model:
    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        """The same sum over features as in training, without building those that have no weight."""
        weights, counts = self.weights, Counter()
        for w, c in Counter(_WORD.findall((text or "").lower())).items():
            if w in weights:
                counts[w] += c
            n = len(w)
            for k in PREFIXES:
                if n <= k:
                    break
                p = w[:k] + "-"
                if p in weights:
                    counts[p] += c
        z = self.bias + sum(weights[w] * np.log1p(c) for w, c in sorted(counts.items()))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))))


def text_key(text: str | None) -> bytes:
    """A digest of all of a text's word runs: of texts that have the same ones one is trained on, since copies would make rare
    words look like evidence."""
    return hashlib.blake2b(shingles(text, 3).tobytes(), digest_size=16).digest()


def train_nnpu(kept: list[list[tuple[int, float]]], positives: int, names: list[str], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss.

    ``kept`` has (feature, count) pairs of each text, features as places in ``names``, the positive texts first.
    """
    n, p = len(kept), positives
    if not p or n == p or prior <= 0:
        return Model()
    row = np.repeat(np.arange(n), [len(x) for x in kept])
    col = np.array([k for x in kept for k, _ in x], dtype=np.int64)
    val = np.log1p(np.array([c for x in kept for _, c in x], dtype=np.float64))
    w, b = np.zeros(len(names)), np.log(prior / (1 - prior)) if prior < 1 else 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[col] * val, minlength=n)
        s = 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
        # d/dz of -log s is s - 1, of -log(1 - s) is s
        negative_part = np.logaddexp(0, z[p:]).mean() - prior * np.logaddexp(0, z[:p]).mean()
        g = np.zeros(n)
        if negative_part >= 0:
            g[:p] = prior * (s[:p] - 1) / p - prior * s[:p] / p
            g[p:] = s[p:] / (n - p)
        else:  # step back up until the corrected risk is not negative
            g[:p] = prior * s[:p] / p
            g[p:] = -s[p:] / (n - p)
        grad = np.append(np.bincount(col, weights=g[row] * val, minlength=len(names)) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(float(b), dict(zip(names, map(float, w), strict=True)))


def _counted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(p, doc_id, digest, key, words, counts) of the texts of ``wanted(doc_id, p)``, one text of an id and one of a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, p, t in zip(pdf["doc_id"], pdf["p"], pdf["text"], strict=True):
                f = features(t)
                digest = hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
                yield pd.DataFrame({"p": [p], "doc_id": [i], "digest": [digest], "key": [text_key(t)], "words": [list(f)], "counts": [list(f.values())]})

    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "p", "text")  # at most 8,000 ids
    rows = stored(rows.mapInPandas(run, "p boolean, doc_id long, digest binary, key binary, words array<string>, counts array<int>"), "train-texts")
    one = rows.groupBy("p", "doc_id").agg(F.min(F.struct("digest", "key")).alias("t"))
    one = one.groupBy("p", "t.key").agg(F.min(F.struct("doc_id", "t.digest")).alias("c")).select("p", "c.*")
    return rows.join(F.broadcast(stored(one, "train-ids")), ["p", "doc_id", "digest"]).dropDuplicates(["p", "doc_id", "digest"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample, chosen by a hash of the id, of rows outside the held-out fifth.

    Positives: labelled toxic. Unlabelled: any documents. Prior: the toxic part of the labels, over all of them. Features
    are those that stand in more positive texts than the unlabelled ones let expect, all of them. Texts stay with the
    executors: the driver sees those features and their counts in the sample, which is what bounds them.
    """
    train = labels.filter((crc_mod("doc_id", 5) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    prior = float(train.agg(F.avg("toxic").alias("prior")).first()["prior"] or 0.0)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = lambda d, n: d.select("doc_id", order.alias("o")).orderBy("o", "doc_id").limit(n).select("doc_id").distinct()
    usable = docs.filter((crc_mod("doc_id", 5) != 0) & F.col("doc_id").isNotNull())
    wanted = ids(train.filter("toxic = 1"), MAX_POSITIVE).withColumn("p", F.lit(True)).union(ids(usable, MAX_UNLABELLED).withColumn("p", F.lit(False)))
    texts = stored(_counted(usable, stored(wanted, "train-wanted")), "train-counts")
    sizes = {r["p"]: r["count"] for r in texts.groupBy("p").count().collect()}
    ratio = sizes.get(True, 0) / max(1, sizes.get(False, 0))
    each = texts.select("p", "doc_id", F.explode(F.arrays_zip("words", "counts")).alias("f")).select("p", "doc_id", "f.words", "f.counts")
    seen = each.groupBy("words").agg(F.count_if("p").alias("n"), F.count_if(~F.col("p")).alias("u")).filter("n >= 2")
    z = (F.col("n") - ratio * F.col("u")) / F.sqrt(ratio * F.col("u") + 1.0)
    found = seen.withColumn("z", z).filter("z >= 3.0").orderBy(F.desc("z"), "words").select("words")
    names = [r["words"] for r in found.collect()]
    at = docs.sparkSession.createDataFrame(list(enumerate(names)), "k int, words string")
    used = each.join(at.hint("merge"), "words").groupBy("p", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "counts"))).alias("f"))
    rows = texts.select("p", "doc_id").join(used.hint("merge"), ["p", "doc_id"], "left").collect()
    rows.sort(key=lambda r: (not r["p"], r["doc_id"]))
    return train_nnpu([[(f["k"], f["counts"]) for f in r["f"] or []] for r in rows], sizes.get(True, 0), names, prior)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null and empty texts get the score of a text without evidence. Ids may be null or repeat; a null id counts as the
    empty text in the fold. Repeated rows and long texts are scored like others, whole. Without confirmed toxic rows the model has no features and scores 0. Extra columns are
    ignored, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "held_out"]].assign(score=[model.score(t) for t in pdf["text"]])

    rows = docs.select(id_as_text(), (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    made = id_from_text(rows.mapInPandas(run, "doc_id string, held_out boolean, score double"))
    return made.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def toxic(text: str, model: Model) -> Column:
    """A condition on a text column: predicted toxic. For filters that keep whole rows without a join."""

    @F.pandas_udf("boolean")
    def over(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) >= 0.5 for t in texts], dtype=bool)

    return over(F.col(text))
