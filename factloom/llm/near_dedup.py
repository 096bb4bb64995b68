"""Near-duplicate documents by an LSH forest.

Each distinct shingle set gets a signature of TREES x DEPTH minimum hashes. A tree is the order of all sets by one run of
DEPTH hashes: sets that resemble each other share long prefixes and stand close together. A set's candidates are its
neighbours in each order that share MIN_DEPTH hashes at least; where a region is crowded, the nearest rows, with the
longest common prefixes, come first, so the depth adapts to the region. Crowded regions are looked at again when the first
links are known, and then all their rows that may link to another component meet with their full sets. Candidates are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import id_as_text, id_from_text, stored, text_hash
from factloom.llm.components import components
from factloom.llm.wordhash import shingles

TREES, DEPTH, MIN_DEPTH = 20, 6, 3
#: Links: 100 * intersection >= THRESHOLD * union, over shingles of WORDS words.
WORDS, THRESHOLD = 2, 80
#: A pair's low hash bits agree in (1 + J) / 2 of all places; at J = 0.8 this many of 120 are 5 deviations away.
SKETCH_CUT = 92
#: Rows looked at before a row in each order, and pairs that a row emits there; what lies beyond is left to the second look.
REACH, EMIT = 24, 3
#: Rows and shingles that the second look compares at once; a larger region is dealt into blocks that all meet.
REGION, SHINGLES = 2048, 4_000_000
HASHES = TREES * DEPTH
_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 256):
        np.minimum(low, (s[at : at + 256, None] * _A).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def agreeing(sketch: bytes, others: np.ndarray) -> np.ndarray:
    """Places in which a sketch agrees with each row of ``others``."""
    return HASHES - _BITS[np.frombuffer(sketch, np.uint8) ^ others].sum(axis=1, dtype=np.int64)


def close_sizes(n: int, others: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link at all."""
    return 100 * np.minimum(n, others) >= THRESHOLD * np.maximum(n, others)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n, set_key, sig, sketch) for every row; the last three are null for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                s = shingles(t, words)
                if len(s):
                    low = signature(s)
                    out.append((len(s), set_key(s), low.astype(">u4").tobytes(), np.packbits((low & 1).astype(np.uint8)).tobytes()))
                else:
                    out.append((0, None, None, None))
            made = pd.DataFrame(out, columns=["n", "set_key", "sig", "sketch"])
            made.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            made.insert(1, "text_hash", pdf["text_hash"].to_numpy())
            yield made

    return id_from_text(docs.select(id_as_text(), text_hash(), "text").mapInPandas(run, "doc_id string, text_hash long, n long, set_key binary, sig binary, sketch binary"))


def forest(sets: DataFrame) -> DataFrame:
    """(tree, label, id, n, sketch): a row for each set and tree."""
    rows = sets.select("id", "n", "sig", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    label = F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})")
    return rows.select("tree", label.alias("label"), "id", "n", "sketch")


_NEAR = "a long, b long, tree int, region binary, kind string"
_ROW = ["tree", "label", "id", "n", "sketch"]


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream over rows in order, holding REACH rows. Kinds: pair; dense (a region with rows beyond reach).

    The first and the last region of a task may go on in another task, so they count as dense.
    """
    held: list[tuple] = []  # rows of the region so far, the last REACH of them
    region, seen, dense = None, 0, False
    # Other kinds than pairs have ids 0, not null: pandas would make floats of a column with nulls.
    named = lambda out: pd.DataFrame(out, columns=["a", "b", "tree", "region", "kind"]).astype({"a": "int64", "b": "int64"})
    for pdf in batches:
        out = []
        for tree, label, i, n, sketch in zip(*(pdf[c] for c in _ROW), strict=True):
            here = (tree, label[: 4 * MIN_DEPTH])
            if here != region:
                first = region is None
                region, held, seen, dense = here, [], 0, first
                if first:
                    out.append((0, 0, tree, here[1], "dense"))
            if held:
                found = 0
                for j, m, other in reversed(held):
                    if 100 * min(n, m) >= THRESHOLD * max(n, m) and (int.from_bytes(sketch, "big") ^ other).bit_count() <= HASHES - SKETCH_CUT:
                        out.append((min(i, j), max(i, j), tree, None, "pair"))
                        found += 1
                        if found == EMIT:
                            break
                if not dense and (found == EMIT or seen > len(held)):
                    dense = True
                    out.append((0, 0, tree, here[1], "dense"))
            held.append((i, n, int.from_bytes(sketch, "big")))
            seen += 1
            if len(held) > REACH:
                held.pop(0)
        yield named(out)
    if region and not dense:
        yield named([(0, 0, *region, "dense")])


def _ordered(rows: DataFrame) -> DataFrame:
    """Deal the rows by ranges of (tree, label, id), so that a crowded region is spread over tasks like any other rows."""
    return rows.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")


_BLOCK = ["tree", "region", "qb", "rb"]
_LOOK = "tree int, region binary, qb int, rb int, id long, comp long, side int, out boolean"
_QUERY, _TARGET = 1, 2


def _blocks(rows: DataFrame) -> DataFrame:
    """Deal the rows of crowded regions into blocks (tree, region, qb, rb) in which all pairs that may matter meet.

    ``rows(tree, region, id, n, sketch, comp)``. A pair of components has a row outside the region's largest: each such row
    is a query and meets all rows of its region. A region of at most REGION rows and SHINGLES shingles is one block. Others
    are dealt by id into parts of half that size, and each part of the queries meets each part of the rows, so a block's
    size does not depend on its region's. ``side`` says whether a row is query, target or both there.
    """
    by_comp = rows.groupBy("tree", "region", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    regions = by_comp.groupBy("tree", "region").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "comp"))["comp"].alias("most"))
    share = F.greatest(F.col("c") / F.lit(REGION), F.col("s") / F.lit(SHINGLES))
    regions = stored(regions.filter("comps > 1").select("tree", "region", "most", F.when(share > 1, F.ceil(2 * share)).otherwise(1).cast("int").alias("parts")), "regions")
    rows = rows.join(regions, ["tree", "region"]).withColumn("out", F.col("comp") != F.col("most")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    columns = lambda side, qb, rb: [F.col("tree"), F.col("region"), qb.alias("qb"), rb.alias("rb"), F.col("id"), F.col("n"), F.col("sketch"), F.col("comp"), side.cast("int").alias("side"), F.col("out")]
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    alone = rows.filter("parts = 1").select(columns(F.when(F.col("out"), _QUERY | _TARGET).otherwise(_TARGET), F.lit(0), F.lit(0)))
    large = rows.filter("parts > 1")
    queries = large.filter("out").select("*", every.alias("other")).select(columns(F.lit(_QUERY), F.col("part"), F.col("other")))
    targets = large.select("*", every.alias("other")).select(columns(F.lit(_TARGET), F.col("other"), F.col("part")))
    return alone.union(queries).union(targets).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "id", "side")


def _partners(k: int, ids: np.ndarray, comp: np.ndarray, side: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Targets of other components than query ``k``'s. Of two queries, the one with the lower id asks."""
    return np.flatnonzero((comp != comp[k]) & (side & _TARGET > 0) & (~out | (ids > ids[k])))


def _crowded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of each block whose sketch agrees with a row of another component. One row in, one row out at most."""
    names = [c.split()[0] for c in _LOOK.split(", ")]

    def met(block: list[tuple]) -> Iterator[tuple]:
        ids, n, sketches, comp, side, out = zip(*(r[4:] for r in block), strict=True)
        ids, n, comp, side, out = (np.array(x) for x in (ids, n, comp, side, out))
        sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(block), -1)
        meets = np.zeros(len(block), bool)
        for k in np.flatnonzero(side & _QUERY):
            fit = _partners(k, ids, comp, side, out)
            fit = fit[close_sizes(n[k], n[fit])]
            fit = fit[agreeing(sketches[k].tobytes(), sketches[fit]) >= SKETCH_CUT]
            meets[fit] = True
            meets[k] |= len(fit) > 0
        for k in np.flatnonzero(meets):
            yield (*block[k][:5], *block[k][7:])

    block: list[tuple] = []
    for pdf in batches:
        found: list[tuple] = []
        for row in zip(*(pdf[c] for c in [*_BLOCK, "id", "n", "sketch", "comp", "side", "out"]), strict=True):
            if block and row[:4] != block[0][:4]:
                found += met(block)
                block = []
            block.append(row)
        yield pd.DataFrame(found, columns=names)
    yield pd.DataFrame(list(met(block)) if block else [], columns=names)


def _join_components(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of one block, by exact intersections of full sets; fewer links than rows.

    A query is compared with all rows at once: its shingles are marked, and marks are summed over each other set. Rows
    whose components are joined already are not linked again.
    """
    pdf = pdf.sort_values(["id", "side"], kind="stable")
    ids, n, comp = pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["comp"].to_numpy().copy()
    side, alien = pdf["side"].to_numpy(), pdf["out"].to_numpy()
    sets = [np.frombuffer(b, np.uint64) for b in pdf["bytes"]]
    start = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    named, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(named), np.int32)
    out = []
    for k in np.flatnonzero(side & _QUERY):
        fit = _partners(k, ids, comp, side, alien)
        if not len(fit):
            continue
        own = flat[start[k] : start[k + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], start[:-1])[fit]
        mark[own] = 0
        for j in fit[100 * common >= THRESHOLD * (n[k] + n[fit] - common)]:
            if comp[j] != comp[k]:
                out.append((min(ids[k], ids[j]), max(ids[k], ids[j])))
                low, high = min(comp[j], comp[k]), max(comp[j], comp[k])
                comp[comp == high] = low
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose full sets link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for na, nb, sa, sb in zip(pdf["na"], pdf["nb"], pdf["sa"], pdf["sb"], strict=True):
                common = len(np.intersect1d(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64), assume_unique=True))
                ok.append(100 * common >= THRESHOLD * (na + nb - common))
            yield pdf.loc[ok, ["a", "b"]]

    side = lambda k: sets.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bytes").alias(f"s{k}")).hint("merge")
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def _set_id(sets: DataFrame) -> Column:
    """A 64-bit identifier of each set, verified: one that two sets share is replaced by another for all of them."""
    for salt in range(8):
        ident = F.xxhash64("set_key", F.lit(salt))
        if sets.groupBy(ident.alias("id")).count().filter("count > 1").isEmpty():
            return ident
    raise RuntimeError("set identifiers clash")


def near_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_hash.

    Texts without words (null, empty, separators alone) have empty sets and stand alone. Rows with equal
    sets, repeated rows among them, are one set; its smallest doc_id and those of the sets that it reaches decide. Rows
    that repeat the kept doc_id tie and all stay. An id with several texts is judged by each text. Rows with a null doc_id
    keep their count, link nothing and are their own component (null, kept). Empty tables give empty results; other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(signatures(docs, words), "signatures")
    named = rows.filter("doc_id is not null and set_key is not null")
    # Equal sets: one row each from a partial aggregate; sets that occur once need no join later.
    by_key = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "sig", "sketch")).alias("r"), F.count("*").alias("copies"))
    reps = stored(by_key.select("set_key", "copies", "r.*"), "sets")
    ident = _set_id(reps)
    reps = reps.withColumn("id", ident)
    woods = forest(reps)
    near = stored(_ordered(woods).mapInPandas(_neighbours, _NEAR), "neighbours")
    pairs = stored(near.filter("kind = 'pair'").groupBy("a", "b").agg(F.count("*").alias("hits")), "pairs")
    dense = stored(near.filter("kind = 'dense'").select("tree", "region").distinct(), "dense")

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, n, bytes): full sets, all 64 bits of each shingle, of ``ids(id)``."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                made = [s for t in pdf["text"] if len(s := shingles(t, words))]
                yield pd.DataFrame({"set_key": [set_key(s) for s in made], "n": [len(s) for s in made], "bytes": [s.tobytes() for s in made]})

        # Ids may be many, so no broadcast is forced; Spark knows the stored table's size. An id's other texts do no harm.
        wanted = stored(reps.select("id", "doc_id").join(ids, "id", "left_semi").select("doc_id").distinct(), "wanted")
        some = docs.join(wanted, "doc_id", "left_semi").mapInPandas(run, "set_key binary, n long, bytes binary")
        return stored(some.select(ident.alias("id"), "n", "bytes").dropDuplicates(["id"]), "full-sets")

    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    sets = sets_of(ids)
    comps = None

    def cross(left: DataFrame) -> DataFrame:
        """Those pairs whose ends lie in different components so far, with these."""
        ca, cb = comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        out = left.join(ca, "a", "left").join(cb, "b", "left")
        return out.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).filter("ca <> cb")

    def confirmed(new: DataFrame) -> None:
        """Components of the new links and of what is joined already, which goes in as stars."""
        nonlocal comps
        edges = new.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if comps is not None:
            edges = edges.union(comps.select("node", "component"))
        comps = stored(components(edges), "components")

    # First each set's best candidate, then what still lies between different components, a few pairs of each before all.
    best = Window.partitionBy("b").orderBy(F.desc("hits"), "a")
    ranked = stored(pairs.withColumn("r", F.row_number().over(best)), "ranked-pairs")
    confirmed(_confirm(ranked.filter("r = 1"), sets))
    some = Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy("a", "b")
    rest = stored(cross(ranked.filter("r > 1").select("a", "b")).withColumn("r", F.row_number().over(some)).select("a", "b", "r"), "second-pairs")
    if not rest.isEmpty():
        confirmed(_confirm(rest.filter("r <= 8"), sets))
        last = rest.filter("r > 8")
        if not last.isEmpty():
            confirmed(_confirm(stored(cross(last.select("a", "b")).select("a", "b"), "third-pairs"), sets))
    # The second look: rows of crowded regions that may link to another component meet with their full sets.
    if not dense.isEmpty():
        there = woods.withColumn("region", F.substring("label", 1, 4 * MIN_DEPTH)).join(dense, ["tree", "region"], "left_semi").drop("label")
        there = there.join(comps.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        look = stored(_blocks(stored(there, "crowded-rows")).mapInPandas(_crowded, _LOOK), "second-look")
        if not look.isEmpty():
            full = sets_of(stored(look.select("id").distinct(), "look-ids"))
            met = look.hint("merge").join(full, "id")
            confirmed(met.groupBy(*_BLOCK).applyInPandas(_join_components, "a long, b long"))
    # Back to all rows: only sets that have copies or links are joined.
    of = reps.select("set_key", "id", "doc_id", "copies").join(comps.withColumnRenamed("node", "id"), "id", "left").filter("copies > 1 or component is not null")
    of = stored(of.select("set_key", "doc_id", "component"), "linked-sets")
    least = stored(of.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "component-ids")
    of = stored(of.join(least, "component", "left").select("set_key", F.coalesce("least", "doc_id").alias("component_id")), "set-components")
    out = rows.select("doc_id", "text_hash", "n", "set_key").join(of, "set_key", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), comp).alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"), "text_hash")


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i >= 80 * (x.n + y.n - i)),
both_ways as (select a, b from e union all select b, a from e),
r(id, c) as (select doc_id, doc_id from documents union select both_ways.b, r.c from r join both_ways on r.id = both_ways.a),
m as (select id, min(c) as component_id from r group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n on n.doc_id = d.doc_id join m on m.id = d.doc_id
"""
