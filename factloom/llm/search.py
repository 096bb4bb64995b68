"""Ranked lexical search, term at a time with limited accumulators.

Documents become rows of terms and counts. Each task evaluates all items over a shard of such rows: terms from the rarest
on, each adding its impacts to the accumulators of documents. Once the most that the terms left can add lies below the
k-th best partial score, no document without an accumulator can be among the best, so no accumulators are created any
more, and those that exist are updated to the end. A shard's best are exact for the shard; the best of all shards follow
from a merge of k rows for each shard and item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored
from factloom.llm.wordbytes import TERMS, counted

K = 10
#: Documents, and postings of the items' terms, of one shard. Either ends it.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000
#: Pairs of an item and a term, about, that go to the tasks at once; more items make more passes over the index.
ITEM_PAIRS = 200_000
#: Terms that one Arrow batch of the index holds, about.
BATCH_TERMS = 200_000
NO_ID = np.iinfo(np.int64).max


def term_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): every row that has a term, with its distinct terms and their counts in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ns, ends, terms, tfs = [], [], [0], [], []

        def made() -> pa.RecordBatch:
            at = pa.array(ends, pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                found = counted(text.as_py() or b"", TERMS)
                if found:
                    ids.append(i.as_py())
                    ns.append(sum(found.values()))
                    terms.extend(found)
                    tfs.extend(found.values())
                    ends.append(len(terms))
                if len(terms) >= BATCH_TERMS:
                    yield made()
                    ids, ns, ends, terms, tfs = [], [], [0], [], []
        if ids:
            yield made()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<binary>, tfs array<int>")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each pair once. Rows that share an id are one item, null ids too."""
    rows = term_index(items, id_col, text_col)
    return rows.select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()


def _postings(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in the batch, term's place in the vocabulary, count) of the postings whose term is in the vocabulary."""
    terms, tfs = batch.column("terms"), batch.column("tfs")
    place = pc.index_in(terms.flatten(), value_set=vocabulary)
    hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    return row[hit], place.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64), tfs.flatten().to_numpy(zero_copy_only=False)[hit].astype(np.int64)


def document_counts(index: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many rows each term of a bounded vocabulary stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = pa.array(vocabulary, pa.binary()), np.zeros(len(vocabulary), np.int64)
        for b in batches:
            n += np.bincount(_postings(b, known)[1], minlength=len(n))
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit])], names=["t", "n"])

    counts = index.select("terms", "tfs").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("df"))
    return {vocabulary[r["t"]]: r["df"] for r in counts.collect()}


def best_of_shard(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, items: list[tuple[list[int], list[int]]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(item, rows, scores, accumulators) of each item's ``k`` best rows; items are (terms, weights), rarest term first."""
    order = np.argsort(term, kind="stable")
    doc, term, impact = doc[order], term[order], impact[order]
    for at, (terms, weights) in enumerate(items):
        cut = np.searchsorted(term, [[t, t + 1] for t in terms])
        most = [w * int(impact[a:b].max()) if b > a else 0 for w, (a, b) in zip(weights, cut, strict=True)]
        score, live = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        done, rest, creating = 0, sum(most), True
        for w, (a, b), bound in zip(weights, cut, most, strict=True):
            d, x = doc[a:b], impact[a:b] * w
            if creating:
                live[d] = True
            else:
                d, x = d[keep := live[d]], x[keep]
            score[d] += x  # a term has one posting in a row
            done, rest = done + bound, rest - bound
            # A partial score is at most ``done``; until that exceeds the rest there is no need to look for the k-th.
            if creating and done > rest:
                partial = score[live]
                creating = len(partial) < k or rest >= np.partition(partial, len(partial) - k)[-k]
        rows = np.flatnonzero(score)
        if len(rows) > k:
            rows = rows[score[rows] >= np.partition(score[rows], len(rows) - k)[-k]]
        rows = rows[np.lexsort((ids[rows], -score[rows]))][:k]
        yield at, rows, score[rows], int(live.sum())


def search_block(index: DataFrame, pairs: dict[int | None, list[bytes]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best rows of each shard for a bounded block of items."""
    vocabulary = sorted({t for terms in pairs.values() for t in terms})
    df = document_counts(index, vocabulary)
    place = {t: p for p, t in enumerate(vocabulary)}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    names = list(pairs)
    ranked = [sorted((t for t in pairs[i] if t in df), key=lambda t: (df[t], t)) for i in names]
    items = [([place[t] for t in terms], [weight[t] for t in terms]) for terms in ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n, postings = pa.array(vocabulary, pa.binary()), [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([b.column("doc_id") for b, *_ in held])
            length = np.concatenate([b.column("n").to_numpy(zero_copy_only=False) for b, *_ in held]).astype(np.int64)
            first = np.cumsum([0] + [b.num_rows for b, *_ in held])
            doc = np.concatenate([row + f for (_, row, _, _), f in zip(held, first, strict=False)])
            term, tf = (np.concatenate([h[j] for h in held]) for j in (2, 3))
            m = 100 - 90 + (90 * length * n_docs) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
            keys = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            found = [(at, rows, score) for at, rows, score, _ in best_of_shard(doc, term, impact, keys, items, k) if len(rows)]
            if found:
                asked = pa.array([names[at] for at, r, _ in found for _ in range(len(r))], pa.int64())
                near, scores = (np.concatenate([f[j] for f in found]) for j in (1, 2))
                yield pa.RecordBatch.from_arrays([asked, ids.take(pa.array(near)), pa.array(scores)], names=["item_id", "doc_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            found = _postings(b, known)
            held.append((b.select(["doc_id", "n"]), *found))
            n, postings = n + b.num_rows, postings + len(found[0])
            if n >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield from flush()
                held, n, postings = [], 0, 0
        if n:
            yield from flush()

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, item_pairs: int = ITEM_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` for each item, scores above 0, ties by ascending id.

    Rows count as documents, repeated ones too; a null id stands last among equals. Null and empty texts have no terms:
    such documents count nowhere, such items find nothing. Long texts are read in segments. Items go to the tasks in
    blocks of about ``item_pairs`` terms, so what the driver and each task hold of them is bounded. Empty tables give empty
    results; other columns are not looked at.
    """
    index = stored(term_index(docs), "terms")
    asked = stored(item_terms(items), "items")
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, math.ceil(asked.count() / item_pairs))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = []
    for b in range(blocks):
        pairs: dict[int | None, list[bytes]] = {}
        for r in asked.filter(part == b).collect():
            pairs.setdefault(r["item_id"], []).append(bytes(r["term"]))
        found.append(search_block(index, pairs, n_docs, n_terms, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
with t as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
c as (select count(*) as docs, sum(len(ws))::bigint as total from t where len(ws) > 0),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
p as (select r, doc_id, term, n, count(*) as tf from (select r, doc_id, len(ws) as n, unnest(ws) as term from t) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * (select docs from c) + 2) / (2 * count(*) + 1)))::bigint as w from p group by term),
s as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::bigint as score
  from q join p using (term) join w using (term), c group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
"""
