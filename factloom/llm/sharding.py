"""A uniform shuffle into shards of exact sizes.

Rows are permuted inside the blocks in which they are read. How many rows of each block go to each shard is drawn before
any row moves, from the law that these counts have under a uniform permutation of all rows: the communication matrix, whose
rows add up to the blocks' sizes and whose columns to the shards' sizes. A block's permuted rows are then dealt in runs of
those lengths, exchanged once, and permuted again inside their shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factloom.llm.common import stored

SHARDS = 40
SEED = 13
#: A block ends after so many rows or bytes; blocks whose part of the matrix one task draws; rows of one sort in a shard.
BLOCK_ROWS, BLOCK_BYTES, GROUP_BLOCKS, SORT_ROWS = 65_536, 32 << 20, 1_024, 65_536
#: Above this numpy's sampler takes no population.
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good, for populations of any size.

    Beyond numpy's limit the probabilities around the mode are summed: their ratios are simple fractions, and what lies
    outside twelve deviations is below the resolution of doubles.
    """
    if good < _NUMPY_LIMIT and bad < _NUMPY_LIMIT and good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(good, n)
    total = good + bad
    mode = ((n + 1) * (good + 1)) // (total + 2)
    reach = int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 16
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(len(k) - 1, np.searchsorted(upto, rng.random() * upto[-1], side="right"))])


def deal(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows fall to each shard of which ``room`` is left: a multivariate hypergeometric draw."""
    out, left = np.zeros(len(room), np.int64), int(room.sum())
    for s in range(len(room) - 1):
        left -= int(room[s])
        out[s] = hypergeometric(rng, int(room[s]), left, n)
        n -= int(out[s])
    out[-1] = n
    return out


def _permuted(rows: DataFrame, seed: int, block_rows: int, block_bytes: int) -> DataFrame:
    """(row, block, place): each block's rows in permuted order, numbered from 0. Written, so that an address stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, held, n, size = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            order = np.random.default_rng([seed, part, chunk]).permutation(n)
            made = pa.Table.from_batches(held).take(pa.array(order)).append_column("block", pa.array(np.full(n, (part << 31) + chunk))).append_column("place", pa.array(np.arange(n)))
            yield from made.to_batches(max_chunksize=10_000)

        for b in batches:
            if b.num_rows:
                held, n, size = [*held, b], n + b.num_rows, size + b.nbytes
            if n >= block_rows or size >= block_bytes:
                yield from flush()
                chunk, held, n, size = chunk + 1, [], 0, 0
        if n:
            yield from flush()

    schema = StructType([*rows.schema.fields, StructField("block", LongType()), StructField("place", LongType())])
    return stored(rows.mapInArrow(run, schema), "shard-rows")


def shard_sizes(n: int, shards: int) -> np.ndarray:
    return np.full(shards, n // shards, np.int64) + (np.arange(shards) < n % shards)


def communication(blocks: DataFrame, shards: int, seed: int, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(block, upto array<long>) for ``blocks(block, n)``: the running sums of a block's counts over the shards.

    The driver draws for groups of blocks, of which it sees only the sizes (one row for some 67 million rows); in each
    group one task draws for its blocks. Merging blocks keeps the law, so this is the same draw as one over all blocks.
    """
    groups = max(1, math.ceil(blocks.count() / group_blocks))
    blocks = blocks.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)))
    sizes = blocks.groupBy("grp").agg(F.sum("n").alias("n")).orderBy("grp").collect()
    room, rng, drawn = shard_sizes(sum(r["n"] for r in sizes), shards), np.random.default_rng([seed, groups]), []
    for r in sizes:
        counts = deal(rng, room, r["n"])
        room = room - counts
        drawn.append((r["grp"], [int(c) for c in counts]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        room, rng, out = np.array(pdf["room"].iloc[0], dtype=np.int64), np.random.default_rng([seed, groups, int(pdf["grp"].iloc[0])]), []
        for n in pdf["n"]:
            counts = deal(rng, room, int(n))
            room = room - counts
            out.append(np.cumsum(counts))
        return pd.DataFrame({"block": pdf["block"], "upto": out})

    rooms = blocks.sparkSession.createDataFrame(drawn, "grp long, room array<long>")
    return stored(blocks.join(rooms.hint("merge"), "grp").groupBy("grp").applyInPandas(run, "block long, upto array<long>"), "shard-matrix")


def exact_shuffle(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, group_blocks: int = GROUP_BLOCKS, sort_rows: int = SORT_ROWS) -> DataFrame:
    """(row, shard, slot): every input row, as a struct of all its columns, in a uniformly drawn shard and slot.

    Shards differ by one row at most; slots count from 0 without gaps. Nothing depends on a row's content, so nulls,
    empty and long texts, repeated rows and ties are rows like others, and column names cannot clash. Blocks are bounded
    in rows and bytes, an empty table gives an empty result. Whole rows move once, to their shard.
    """
    placed = _permuted(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")), seed, block_rows, block_bytes)
    blocks = stored(placed.groupBy("block").agg(F.count("*").alias("n")), "shard-blocks")
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    matrix = communication(blocks, shards, seed, group_blocks)
    buckets = max(1, math.ceil(n / shards / sort_rows))
    key = F.xxhash64(F.lit(seed), "block", "place")

    def exchanged(*carried: str) -> DataFrame:
        # The matrix is a written table of one row a block: Spark broadcasts it while it is small and merges beyond.
        sent = placed.select("block", "place", *carried).join(matrix, "block")
        shard: Column = F.size(F.filter("upto", lambda x: x <= F.col("place")))
        return sent.select("block", "place", *carried, shard.alias("shard"), key.alias("key"), F.pmod(key, F.lit(buckets)).alias("bucket"))

    # The second permutation sorts random keys: a bucket of keys at a time, after the rows of the buckets before it.
    sizes = exchanged().groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "shard-starts")
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "block", "place")
    ranked = exchanged("row").withColumn("rank", F.row_number().over(inside))
    return ranked.join(starts, ["shard", "bucket"]).select("row", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """A folder for each shard with whole rows and their slots."""
    exact_shuffle(rows, shards, seed).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = exact_shuffle(small, shards, seed)
    return out.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
