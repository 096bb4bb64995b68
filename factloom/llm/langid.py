"""Language identification by a small convolutional network over bytes.

Filters of several widths slide over fixed-length windows of the UTF-8 bytes; the largest response of each filter feeds a
softmax over the languages. The network is trained in numpy. A text's windows, all of them, vote by their log
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import crc_mod, id_as_text, id_from_text, text_hash

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Bounds of the training sample: labelled documents, and windows of all of them. Documents are taken whole or not at all.
MAX_DOCS, MAX_WINDOWS = 3_000, 16_000
#: Windows that go through the network at once.
BATCH = 256
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def windows(text: str) -> np.ndarray:
    """All windows of a text, the last one filled up with zero bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    rows = -(-len(raw) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(rows, WINDOW)


@dataclass
class Network:
    languages: list[str]
    #: By width: a table of responses for each offset and byte, (width, 256, FILTERS), and a bias.
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each window, and where it is."""
        values, places = [], []
        for table, bias in zip(self.filters, self.biases, strict=True):
            w = len(table)
            n = WINDOW - w + 1
            z = np.take(table[0], x[:, :n], axis=0)
            for j in range(1, w):
                z += np.take(table[j], x[:, j : j + n], axis=0)
            at = z.argmax(axis=1) if self.training else None
            values.append(z.max(axis=1) + bias)
            places.append(at)
        return np.concatenate(values, axis=1), places

    training = False

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self.pooled(x)[0], 0)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 4, rate: float = 0.02, seed: int = 3) -> Network:
    """Adam on the cross-entropy. Gradients pass max pooling at one place per filter, so updates are sparse sums."""
    rng = np.random.default_rng(seed)
    net = Network(
        languages,
        [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    net.training = True
    params = [*net.filters, *net.biases, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t, size = 0, 128
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            rows = order[at : at + size]
            xb, t = x[rows], t + 1
            pooled, places = net.pooled(xb)
            h = np.maximum(pooled, 0)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            gh = (p @ net.out.T) * (pooled > 0)
            gf = []
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(net.filters[k])
                part = gh[:, k * FILTERS : (k + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), part.shape)
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, places[k] + j, axis=1), f), part)
                gf.append(g)
            grads = [*gf, *[gh[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))], h.T @ p, p.sum(axis=0)]
            for i, (param, g) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                param -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    net.training = False
    return net


def fit(docs: DataFrame) -> Network | None:
    """Train on a bounded sample of labelled documents; None without any.

    Documents come in the order of a hash of their id, MAX_DOCS at most, as long as all windows of a document fit within
    MAX_WINDOWS; one that does not fit is passed over. Of the documents that are taken every window is trained on. The
    driver sees their ids and sizes, and then those windows.
    """
    usable = docs.filter((crc_mod("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") > 0))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    rows = usable.select("doc_id", "lang", text_hash(), F.octet_length("text").alias("size"), order.alias("o")).orderBy("o", "doc_id", "text_hash", "lang").limit(MAX_DOCS).collect()
    taken, left = {}, MAX_WINDOWS
    for r in rows:
        key, n = (r["doc_id"], r["lang"], r["text_hash"]), -(-r["size"] // WINDOW)
        if key not in taken and n <= left:
            taken[key], left = True, left - n

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, lang, w.tobytes()) for i, lang, t in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True) if has_letter(t) for w in windows(t)]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "window"])

    keys = docs.sparkSession.createDataFrame(list(taken), "doc_id long, lang string, text_hash long")
    some = usable.select("doc_id", "lang", "text", text_hash()).join(F.broadcast(keys), ["doc_id", "lang", "text_hash"])  # at most MAX_DOCS
    # Rows that repeat an id and its text add nothing.
    some = some.select("doc_id", "lang", "text").mapInPandas(cut, "doc_id long, lang string, window binary").distinct()
    rows = sorted((r["doc_id"], r["lang"], bytes(r["window"])) for r in some.collect())
    if not rows:
        return None
    languages = sorted({r[1] for r in rows})
    x = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([languages.index(r[1]) for r in rows]), languages)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if there was nothing to learn from.
    Ids may be null or repeat; of languages that are equally likely the first in order is taken. Long texts vote with all
    their windows. Extra columns are ignored; an empty table gives an empty result.
    """

    def votes(texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        have = [k for k, t in enumerate(texts) if net is not None and has_letter(t)]
        total = np.zeros((len(texts), len(net.languages) if net else 0))
        n = np.zeros(len(texts))
        held, owner, rows = [], [], 0

        def flush() -> None:
            nonlocal held, owner, rows
            if held:
                logp = net.log_probabilities(np.concatenate(held))
                at = np.concatenate(owner)
                np.add.at(total, at, logp)
                np.add.at(n, at, 1)
            held, owner, rows = [], [], 0

        for k in have:
            w = windows(texts[k])
            for at in range(0, len(w), BATCH):
                part = w[at : at + BATCH]
                held.append(part)
                owner.append(np.full(len(part), k))
                rows += len(part)
                if rows >= BATCH:
                    flush()
        flush()
        for k in have:
            p = np.exp(total[k] / n[k] - (total[k] / n[k]).max())
            p /= p.sum()
            out[k] = (net.languages[int(p.argmax())], float(p.max()))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pd.DataFrame(votes(list(pdf["text"])), columns=["lang_pred", "score"])
            yield pd.concat([pdf[["doc_id", "held_out"]].reset_index(drop=True), made], axis=1)

    rows = docs.select(id_as_text(), (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return id_from_text(rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double"))
