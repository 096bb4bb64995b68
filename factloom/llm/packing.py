"""Length-bucketed batches.

The histogram of token lengths over all documents is summed by Spark into a bounded number of cells; dynamic programming
over the cells places the bucket boundaries that minimise padding. Inside each bucket, documents in a fixed hashed order
fill batches up to a token budget that counts the padding.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored, word_count

#: Lengths up to EXACT have cells of their own; beyond, each doubling has EXACT cells. So 2**40 tokens make some 8,000 cells.
EXACT = 256
BUCKETS = 8
BATCH_TOKENS = 16_384
BLOCK_DIGITS = 3


def cell_end(n: Column) -> Column:
    """The largest length in the cell of length ``n`` (0 is counted with 1)."""
    n = F.greatest(n, F.lit(1)).cast("long")
    # Bits beyond those that EXACT resolves; bin() has no rounding, unlike a logarithm.
    shift = F.greatest(F.lit(0), F.length(F.bin(n - 1)) - (int(math.log2(EXACT)) + 1))
    width = F.pow(F.lit(2.0), shift).cast("long")
    return ((F.ceil(n / width)) * width).cast("long")


def boundaries(ends: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket boundaries, ascending, that minimise padded tokens: sum of count times boundary.

    ``ends`` ascending. O(buckets x cells^2) in numpy rows; the number of cells is bounded. Ties take the fewest and then
    the smallest boundaries.
    """
    n = len(ends)
    if n == 0:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = upto[1:] * ends  # one bucket over cells 0..j
    back = [np.zeros(n, dtype=np.int64)]
    last, used = best[-1], 1
    for _ in range(1, min(buckets, n)):
        new, frm = np.empty(n), np.zeros(n, dtype=np.int64)
        for j in range(n):
            cost = np.concatenate([[0.0], best[:j]]) + (upto[j + 1] - upto[: j + 1]) * ends[j]
            frm[j] = int(np.argmin(cost))
            new[j] = cost[frm[j]]
        back.append(frm)
        best = new
        if best[-1] >= last:
            back.pop()
            break
        last, used = best[-1], used + 1
    out, j = [], n - 1
    for k in range(used - 1, -1, -1):
        out.append(int(ends[j]))
        if k == 0:
            break
        j = int(back[k][j]) - 1
        if j < 0:
            break
    return sorted(out)


def length_buckets(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Boundaries for a column ``n_tokens``; the driver sees one row per cell, of which there is a bounded number."""
    cells = lengths.groupBy(cell_end(F.col("n_tokens")).alias("e")).agg(F.count("*").alias("c")).orderBy("e").collect()
    return boundaries(np.array([r["e"] for r in cells], dtype=np.float64), np.array([r["c"] for r in cells], dtype=np.float64), buckets)


def pack(docs: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, bucket (its boundary), batch, slot, batch_rows, padding.

    A batch of a bucket holds ``max(1, batch_tokens // boundary)`` rows; slots count from 0. Documents without words
    stand in the first bucket. A document longer than the budget is a batch of its own. Null ids and repeated rows are
    rows like others; ties of the order are rows of one id. An empty table gives an empty result.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = stored(docs.select("doc_id", word_count("text").alias("n_tokens"), F.substring(digest, 1, BLOCK_DIGITS).alias("block")), "pack-rows")
    ends = length_buckets(rows, buckets)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= e, F.lit(e).cast("long")) for e in ends]) if ends else F.lit(1).cast("long")
    # Rows of one id and length differ in nothing that is asked for: they are counted before they are moved, so an id that
    # many rows share is one row in its block, and drawn out again at the end.
    alike = stored(rows.groupBy(bucket.alias("bucket"), "block", "doc_id", "n_tokens").agg(F.count("*").alias("c")), "pack-counts")
    # A rank inside a bucket is the rows of the blocks before plus the rank in the block, so no bucket is sorted as a whole.
    before = lambda w, order: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = alike.groupBy("bucket", "block").agg(F.sum("c").alias("n"))
    blocks = stored(blocks.withColumn("before", F.coalesce(F.sum("n").over(before(Window.partitionBy("bucket"), ["block"])), F.lit(0))).drop("n"), "pack-blocks")
    inside = before(Window.partitionBy("bucket", "block"), ["doc_id", "n_tokens"])
    first = F.col("before") + F.coalesce(F.sum("c").over(inside), F.lit(0))
    placed = alike.join(blocks, ["bucket", "block"]).withColumn("first", first)
    placed = placed.withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("c") - 1)))
    size = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bucket"))).cast("long")
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        F.floor(F.col("rank") / size).cast("long").alias("batch"),
        F.pmod("rank", size).cast("long").alias("slot"),
        size.alias("batch_rows"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )


def oracle(buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> str:
    """DuckDB SQL: the dynamic programme as one relation for each number of buckets, then ranks."""
    bits = int(math.log2(EXACT)) + 1
    sql = rf"""
with r as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens, substr(md5(coalesce(doc_id::varchar, '')), 1, {BLOCK_DIGITS}) as block from documents),
w as (select *, greatest(n_tokens, 1) as m, (1::bigint << greatest(0, length(bin(greatest(n_tokens, 1) - 1)) - {bits}))::bigint as width from r),
h as (select ((m + width - 1) // width) * width as e, count(*) as c from w group by 1),
d as materialized (select row_number() over (order by e) as j, e, sum(c) over (order by e) as upto from h),
b1 as materialized (select j, upto * e::double as cost, 0::bigint as frm from d)"""
    for k in range(2, buckets + 1):
        sql += f""",
b{k} as materialized (select j, min(v) as cost, arg_min(i, struct_pack(v := v, i := i)) as frm from (
  select d.j, coalesce(p.j, 0) as i, case when p.j is null then d.upto * d.e::double else b.cost + (d.upto - p.upto) * d.e::double end as v
  from d left join (select * from d union all select 0, 0, 0) z on z.j < d.j left join d p on p.j = z.j left join b{k - 1} b on b.j = p.j) group by j)"""
    whole = " union all ".join(f"select {k} as k, cost from b{k} where j = (select max(j) from d)" for k in range(1, buckets + 1))
    sql += f""",
best as (select min(k) as k from ({whole}) where cost = (select min(cost) from ({whole}))),
c{buckets} as (select max(j) as j from d where {buckets} <= (select k from best))"""
    for k in range(buckets - 1, 0, -1):
        sql += f""",
c{k} as (select case when {k} = (select k from best) then (select max(j) from d) when {k} < (select k from best) then (select b.frm from b{k + 1} b, c{k + 1} c where b.j = c.j) end as j)"""
    ends = " union all ".join(f"select j from c{k}" for k in range(1, buckets + 1))
    return sql + f""",
ends as (select d.e::bigint as bucket from d where j in ({ends})),
p as (select r.*, (select min(bucket) from ends where bucket >= n_tokens) as bucket from r),
q as (select *, row_number() over (partition by bucket order by block, doc_id, n_tokens) - 1 as rank, greatest(1, {batch_tokens} // bucket)::bigint as batch_rows from p)
select doc_id, n_tokens, bucket, rank // batch_rows as batch, rank % batch_rows as slot, batch_rows, bucket - n_tokens as padding from q
"""
