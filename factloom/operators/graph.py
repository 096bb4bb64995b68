"""Walks over fact graphs and edge lists. Levels are a bounded driver loop; every level is joins on all walks at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.storage import stored
from factloom.operators.temporal import holds_at, tier_filter

MAX_DEPTH = 4


def load_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct edges, (gid, n_nodes, n_edges))."""
    e = edges.select("gid", "src", "dst").distinct()
    nodes = e.select("gid", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("gid").agg(F.count("*").alias("n_nodes"))
    return e, nodes.hint("merge").join(e.groupBy("gid").agg(F.count("*").alias("n_edges")), "gid")


def bfs_levels(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(gid, start, node, distance): nodes within ``depth`` directed steps, with their shortest distance, start at 0.

    ``starts(gid, start[, depth])`` may have depths of their own; a walk ends at its own one.
    """
    e = stored(edges.select("gid", F.col("src").alias("node"), F.col("dst").alias("next")), "edges")  # read at every level
    own = F.col("depth") if "depth" in starts.columns else F.lit(depth)
    front = starts.select("gid", "start", own.alias("limit")).groupBy("gid", "start").agg(F.max("limit").alias("limit")).withColumn("node", F.col("start"))
    seen = front.withColumn("distance", F.lit(0))
    for d in range(1, depth + 1):
        step = front.filter(F.col("limit") >= d).join(e, ["gid", "node"]).select("gid", "start", "limit", F.col("next").alias("node")).distinct()
        front = stored(step.join(seen.select("gid", "start", "node"), ["gid", "start", "node"], "left_anti"))
        seen = seen.unionByName(front.withColumn("distance", F.lit(d)))
        if front.limit(1).count() == 0:
            break
    return seen.select("gid", "start", "node", "distance")


def bfs_frontier(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(gid, start, node): nodes whose shortest distance is exactly ``depth``; none for a depth below 1."""
    return bfs_levels(edges, starts, max(0, depth)).filter((F.col("distance") == depth) & (F.col("distance") > 0)).select("gid", "start", "node")


def parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gid, node, parent): distinct predecessors, without self-loops."""
    e = edges.select("gid", F.col("dst").alias("node"), F.col("src").alias("parent")).filter("node <> parent")
    return e.join(nodes.select("gid", "node").distinct(), ["gid", "node"], "left_semi").distinct()


def neighbors(facts: DataFrame, starts: DataFrame, depth: int, anchor: str, tiers: Sequence[str] = ("T1", "T2"), cap: int = 256) -> DataFrame:
    """(start, fact_id, valid_at, rank): facts on undirected walks of 1 to ``depth`` steps from ``starts(group_id, start)``.

    Depth is held to 1..4; each step passes the tier and time filters, and the tenant of the start is that of the first
    step. Newest first, at most ``cap`` a start.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    live = tier_filter(facts, tiers).filter(holds_at(anchor)).select("group_id", "fact_id", "subject", "object", "valid_at")
    ways = live.select("group_id", F.col("subject").alias("node"), F.col("object").alias("next"), "fact_id", "valid_at").unionByName(
        live.select("group_id", F.col("object").alias("node"), F.col("subject").alias("next"), "fact_id", "valid_at")
    )
    # Of a node's facts only the newest ``cap`` can be among the newest of a start, so a hub brings no more into the join;
    # Spark limits each node before the shuffle. The walk itself needs the distinct neighbours alone.
    newest = Window.partitionBy("group_id", "node").orderBy(F.desc("valid_at"), "fact_id")
    shown = ways.select("group_id", "node", "fact_id", "valid_at").distinct().withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= cap).drop("_r")
    shown = stored(shown, "node-facts")
    steps = stored(ways.select("group_id", "node", "next").distinct(), "steps") if depth > 1 else None
    front = stored(starts.select("group_id", "start", F.col("start").alias("node")).distinct(), "starts")
    seen = front
    for d in range(1, depth):
        nxt = front.join(steps, ["group_id", "node"]).select("group_id", "start", F.col("next").alias("node")).distinct()
        front = stored(nxt.join(seen, ["group_id", "start", "node"], "left_anti"), "front")
        seen = seen.unionByName(front)
    found = seen.join(shown, ["group_id", "node"]).select("group_id", "start", "fact_id", "valid_at").distinct()
    order = Window.partitionBy("group_id", "start").orderBy(F.desc("valid_at"), "fact_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def run_graph_tasks(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, pred): sorted node sets for tasks (task_id, gid, op, start, depth); op is ``bfs`` or ``parents``.

    Tasks of all depths share the levels; each start walks as deep as its own deepest task asks.
    """
    bfs = tasks.filter("op = 'bfs'")
    deepest = bfs.agg(F.max("depth")).first()[0] or 0
    levels = bfs_levels(edges, bfs.select("gid", "start", "depth"), deepest)
    a = bfs.filter("depth >= 1").join(levels.withColumnRenamed("distance", "depth"), ["gid", "start", "depth"]).select("task_id", "node")
    up = tasks.filter("op = 'parents'").select("task_id", "gid", F.col("start").alias("node"))
    b = up.join(parents(edges, up), ["gid", "node"]).select("task_id", F.col("parent").alias("node"))
    found = a.unionByName(b).groupBy("task_id").agg(F.sort_array(F.collect_set("node")).alias("pred"))
    return tasks.select("task_id").join(found, "task_id", "left").withColumn("pred", F.coalesce("pred", F.array().cast("array<string>")))
