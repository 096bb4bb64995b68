"""Connected components by alternating large and small stars, all in joins and aggregates on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to its least one. A hub's rows meet in a join that Spark can split."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select("v", "u"))
    least = both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("low"))
    return both.filter("m > n").join(least.hint("merge"), "n").select(F.col("m").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the least of them; edges point from larger to smaller."""
    low = F.min("v").over(Window.partitionBy("u"))
    rows = edges.withColumn("low", low).select(F.explode(F.array(F.struct("v", "low"), F.struct(F.col("u").alias("v"), "low"))).alias("e"))
    return rows.select(F.col("e.v").alias("u"), F.col("e.low").alias("v")).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """A digest of a set of edges: how many, and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its least node. Self-loops are ignored.

    Runs until nothing changes; the driver sees counts and digests only.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        now = stored(_small_star(_large_star(now)), "stars")
        mark, last = _mark(now), mark
        if mark == last:
            # A fixed point is a set of stars: u points at the least node of its component.
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
