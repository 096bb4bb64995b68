"""Approximate top-k over a trained index: coarse cells, product codes, exact re-ranking.

Centroids and code books are fitted on a bounded sample. Every item is stored under its nearest centroid with a code of a
few bytes. A query reads the codes of the cells nearest to it, and the whole vectors of those items alone whose codes score
best. How many cells and how many vectors are read is measured against exact answers, not guessed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.storage import stored
from factloom.operators.temporal import tier_filter
from factloom.operators.vectors import QUERY_BLOCK, cosine, meet, ranked, recall_at, scoped, sized

#: Bounds of the sample on which the index is fitted, and of the queries on which its reach is measured.
SAMPLE, PROBE_QUERIES = 20_000, 64
#: Dimensions of one part of a code; a part is one byte.
PART_DIM, CODES = 4, 256
#: Items whose codes one task reads, of several cells or a part of one; queries that it scores at once.
BIN, AT_ONCE = 65_536, 64


def _means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's iterations from distinct rows; a cell that runs empty keeps its centre."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        nearest = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        n = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T, axis=1)


@dataclass
class CoarseIndex:
    """``items(id, cell, code, embedding)`` and ``held(scope, item, head, cell, code)`` as written, and the model that made the
    cells and codes. With vectors that rows share, items are vectors; ``ids(scope, item, id)`` are the rows that have them."""

    dim: int
    centres: np.ndarray
    books: list[np.ndarray]
    items: DataFrame
    held: DataFrame
    ids: DataFrame
    id_col: str
    shared: DataFrame | None


def unit(vectors: Sequence, dim: int) -> np.ndarray:
    """Rows of length one; zero for null vectors, those of another length, and zero vectors."""
    v = sized(vectors, dim)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def fit_index(items: DataFrame, dim: int, cells: int | None = None, id_col: str = "fact_id", tiers: Sequence[str] | None = ("T1", "T2"), seed: int = 7, shared: DataFrame | None = None) -> CoarseIndex:
    """Fit on at most SAMPLE items and store all of them. ``cells`` is by default about a quarter of the root of their number.

    With ``shared(vec_id, embedding)``, as :func:`knn` has it, a vector is stored once, whatever number of rows name it."""
    ids, all_held = scoped(items, id_col, tiers, shared)
    if shared is None:
        rows = (items if tiers is None else tier_filter(items, tiers)).select(F.col(id_col).alias("id"), "embedding", "group_id")
    else:
        heads = all_held.select("scope", "item", "head")
        rows = shared.select(F.col("vec_id").alias("id"), "embedding").join(heads.select(F.col("item").alias("id")).distinct(), "id", "left_semi")
    n = rows.count()
    cells = cells or max(1, min(4_096, round(math.sqrt(n) / 4)))
    # A hashed order picks the same sample wherever the rows stand; only SAMPLE of them reach the driver.
    picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("embedding").collect()
    v = unit([r["embedding"] for r in picked], dim) if picked else np.zeros((1, dim))
    rng = np.random.default_rng(seed)
    centres = _means(v, cells, rng)
    books = [_means(v[:, p : p + PART_DIM], CODES, rng) for p in range(0, dim, PART_DIM)]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = unit(pdf["embedding"], dim)
            codes = np.stack([_nearest(v[:, p * PART_DIM : p * PART_DIM + b.shape[1]], b) for p, b in enumerate(books)], axis=1).astype(np.uint8)
            yield pdf.assign(cell=_nearest(v, centres), code=[c.tobytes() for c in codes])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell int, code binary"
    made = stored(rows.mapInPandas(encode, schema), "coarse")
    if shared is None:
        scopes = F.explode(F.array_compact(F.array_distinct(F.array("group_id", F.lit("*"))))).alias("scope")
        held = made.select(scopes, F.col("id").alias("item"), F.col("id").alias("head"), "cell", "code")
    else:
        held = heads.join(made.select(F.col("id").alias("item"), "cell", "code"), "item").select("scope", "item", "head", "cell", "code")
    return CoarseIndex(dim, centres, books, made, stored(held, "coarse-held"), ids, id_col, shared)


def search_index(index: CoarseIndex, queries: DataFrame, k: int, probes: int, depth: int) -> DataFrame:
    """Top-k of each of ``queries(query_id, q, scope)``: (query_id, id, score, rank), scores rounded to six digits, ties by id.

    A scope's cells are laid end to end and cut into bins of about BIN items, so small cells share a task and a large one is
    several. A query comes to the bins of its cells; a bin scores the codes of those cells only, AT_ONCE queries at a time,
    and gives ``depth`` rows a query. Of all bins' rows the ``depth`` best of a query are read as vectors.
    """
    dim, books, centres = index.dim, index.books, index.centres
    probes = min(probes, len(centres))

    @F.pandas_udf("array<int>")
    def nearest_cells(qs: pd.Series) -> pd.Series:
        q = unit(qs, dim)
        cells = np.argsort((centres**2).sum(axis=1)[None, :] - 2 * q @ centres.T, axis=1, kind="stable")[:, :probes]
        return pd.Series(list(cells.astype(np.int32)), dtype=object)

    place = Window.partitionBy("scope").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = index.held.groupBy("scope", "cell").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(place), F.lit(0)))
    nq = queries.groupBy("scope").agg((1 + F.floor(F.count("*") / QUERY_BLOCK)).cast("int").alias("nq"))
    cells = stored(cells.hint("merge").join(nq, "scope"), "coarse-cells")  # written, so Spark knows that it is small
    at = lambda slot: F.floor((F.col("before") + slot) / BIN).cast("int")
    near = stored(queries.select("scope", "query_id", F.explode(nearest_cells("q")).alias("cell")), "coarse-probes")
    asked = near.join(cells, ["scope", "cell"]).select("scope", "query_id", "cell", "nq", F.explode(F.sequence(at(F.lit(0)), at(F.col("n") - 1))).alias("bin"))
    asked = asked.groupBy("scope", "bin", "query_id").agg(F.collect_list("cell").alias("cells"), F.pmod(F.xxhash64("query_id"), F.first("nq")).cast("int").alias("qb"))
    asked = asked.hint("merge").join(queries.select("query_id", "q"), "query_id").select("scope", "bin", "qb", "query_id", "q", "cells")
    held = index.held.join(cells, ["scope", "cell"]).withColumn("bin", at(F.pmod(F.xxhash64("item"), F.col("n"))))
    held = held.select("scope", "bin", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), "item", "head", "cell", "code")

    def by_codes(key: tuple, its: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [np.zeros(0, dtype=np.int64)], "item": [np.zeros(0, dtype=np.int64)], "head": [np.zeros(0, dtype=np.int64)], "near": [np.zeros(0)]}
        its = its.sort_values("cell", kind="stable")
        codes = np.frombuffer(b"".join(its["code"]), np.uint8).reshape(len(its), len(books))
        found, begins, counts = np.unique(its["cell"].to_numpy(), return_index=True, return_counts=True)
        items, heads, keep = its["item"].to_numpy(), its["head"].to_numpy(), min(depth, len(its))
        for start in range(0, len(qs) if len(its) else 0, AT_ONCE):
            some = qs.iloc[start : start + AT_ONCE]
            q, asks = unit(some["q"], dim), [set(c) for c in some["cells"]]
            adds = [q[:, p * PART_DIM : p * PART_DIM + b.shape[1]] @ b.T for p, b in enumerate(books)]  # what each code of a part adds to the score
            near = np.full((len(some), len(its)), -np.inf)
            for cell, begin, count in zip(found, begins, counts, strict=True):
                rows = np.flatnonzero([cell in a for a in asks])
                if len(rows):
                    near[rows, begin : begin + count] = sum(a[rows][:, codes[begin : begin + count, p]] for p, a in enumerate(adds))
            best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
            score = np.take_along_axis(near, best, axis=1)
            r, c = np.nonzero(score > -np.inf)
            for name, x in (("query_id", some["query_id"].to_numpy()[r]), ("item", items[best[r, c]]), ("head", heads[best[r, c]]), ("near", score[r, c])):
                out[name].append(x)
        return pd.DataFrame({n: np.concatenate(x) for n, x in out.items()}).assign(scope=key[0])

    keys = ["scope", "bin", "qb"]
    near = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(by_codes, "scope string, query_id long, item long, head long, near double")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "item")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= depth).drop("r", "near")
    scored = near.hint("merge").join(queries.select("query_id", "q"), "query_id").hint("merge").join(index.items.select(F.col("id").alias("item"), "embedding"), "item")
    scored = scored.select("scope", "query_id", "item", "head", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    return ranked(scored, index.ids, k, index.id_col, index.shared)


def reach(index: CoarseIndex, queries: DataFrame, k: int, target: float = 0.95, seed: int = 5) -> tuple[int, int]:
    """(probes, depth) at which at most PROBE_QUERIES of the queries find ``target`` of their exact neighbours.

    Both double in turn from small numbers until that holds; with all cells and items it does. The queries are picked by a
    hash of their id and written once.
    """
    few = stored(queries.select("query_id", "q", "scope").orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(PROBE_QUERIES), "reach")
    held = index.held.select("scope", "item", "head").join(index.items.select(F.col("id").alias("item"), F.col("embedding").alias("v")), "item")
    asked = few.select("scope", F.col("query_id").alias("id"), F.col("q").alias("v"))
    exact = stored(ranked(meet(asked, held, ["scope"], k, QUERY_BLOCK), index.ids, k, index.id_col, index.shared), "reach-exact")
    n, probes, depth = index.items.count(), max(1, len(index.centres) // 16), 4 * k
    while True:
        found = recall_at(search_index(index, few, k, probes, depth), exact, few, index.id_col)
        hit = found.agg(F.sum(F.col("recall") * F.col("n_exact")) / F.sum("n_exact")).first()[0]
        if hit is None or hit >= target or (probes >= len(index.centres) and depth >= n):
            return probes, depth
        if probes < len(index.centres):
            probes = min(len(index.centres), probes * 2)
        else:
            depth *= 2
