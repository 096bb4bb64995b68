"""Benchmark rows to typed tables and back to messages; run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.storage import stored


def parse_graph_tasks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(task_id, prompt)`` to (tasks with op, start, depth and an error, edges(task_id, src, dst)).

    Edges are the lines ``a -> b`` between the header and the operation.
    """
    body = F.regexp_extract("prompt", r"(?s)Here is the graph to operate on:.*?edges:(.*?)Operation:", 1)
    op = F.regexp_extract("prompt", r"(?s)Operation:(.*)$", 1)
    bfs = r"(?i)BFS from node (\w+) with depth (\d+)"
    par = r"(?i)parents of node (\w+)"
    is_bfs, is_par = op.rlike(bfs), op.rlike(par)
    tasks = rows.select(
        "task_id",
        F.when(is_bfs, "bfs").when(is_par, "parents").alias("op"),
        F.when(is_bfs, F.regexp_extract(op, bfs, 1)).when(is_par, F.regexp_extract(op, par, 1)).alias("start"),
        F.when(is_bfs, F.regexp_extract(op, bfs, 2).try_cast("int")).alias("depth"),
        F.when(body == "", "no graph").when(~is_bfs & ~is_par, "no operation").alias("error"),
    )
    line = rows.select("task_id", F.explode(F.split(body, "\n")).alias("line")).select("task_id", F.trim("line").alias("line"))
    edge = r"^(\w+) -> (\w+)$"
    edges = line.filter(F.col("line").rlike(edge)).select("task_id", F.regexp_extract("line", edge, 1).alias("src"), F.regexp_extract("line", edge, 2).alias("dst"))
    return tasks, edges


# Names of positions.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


def parse_needle_tasks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(task_id, prompt, random_string_to_prepend, desired_msg_index, ...)`` to (lookups, messages).

    The prompt is a JSON list of messages; the last is the query, which names a token, a position and a request. The
    row's own token and message index go before what the query says.
    """
    parsed = rows.withColumn("m", F.from_json("prompt", "array<struct<role:string,content:string>>"))
    query = F.try_element_at("m", F.lit(-1))["content"]
    pattern = r"(?s)Prepend (\S+) to the (?:(\d+)\w*|(\w+)) \([^)]*\)? ?(.*?)\. Do not|Prepend (\S+) to the (?:(\d+)\w*|(\w+)) (.*?)\. Do not"
    part = lambda i, j: F.coalesce(F.nullif(F.regexp_extract(query, pattern, i), F.lit("")), F.nullif(F.regexp_extract(query, pattern, j), F.lit("")))
    word = F.lower(part(3, 7))
    number = F.coalesce(part(2, 6).try_cast("int"), *[F.when(word == w, F.lit(k + 1)) for k, w in enumerate(ORDINALS)])
    lookups = parsed.select("task_id", query.alias("query"), F.coalesce("random_string_to_prepend", part(1, 5)).alias("token"), number.alias("position"), part(4, 8).alias("request"), "desired_msg_index", F.when(F.col("m").isNull(), "no messages").alias("error"))
    messages = parsed.select("task_id", F.posexplode(F.slice("m", 1, F.greatest(F.lit(0), F.size("m") - 1))).alias("msg_idx", "x")).select("task_id", "msg_idx", "x.role", F.col("x.content").alias("text"))
    return lookups, messages


TEMPLATE = r"<\|start_header_id\|>(\w+)<\|end_header_id\|>"


def parse_multikey_tasks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(task_id, input)`` to (tasks(task_id, intro, question), lines(task_id, line_no, line)).

    Template marks go; parts of one role are joined; the question starts at the last line with a question mark.
    """
    plain = F.regexp_replace(F.regexp_replace("input", r"<\|begin_of_text\|>|<\|eot_id\|>", ""), TEMPLATE, "\u0001$1\u0002")
    parts = rows.select("task_id", F.posexplode(F.split(plain, "\u0001")).alias("k", "p"))
    role = F.when(F.contains("p", F.lit("\u0002")), F.substring_index("p", "\u0002", 1)).otherwise("user")
    parts = parts.select("task_id", "k", role.alias("role"), F.regexp_replace(F.regexp_replace("p", "(?s)^\\w*\u0002", ""), r"^\s+|\s+$", "").alias("text")).filter("role = 'user' and text <> ''")
    user = parts.groupBy("task_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    lines = user.select("task_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    per = Window.partitionBy("task_id")
    lines = lines.withColumn("asks", F.max(F.when(F.contains("line", F.lit("?")), F.col("line_no"))).over(per)).withColumn("last", F.max("line_no").over(per))
    ask = F.coalesce("asks", "last")
    join = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    tasks = lines.groupBy("task_id").agg(F.max(F.when(F.col("line_no") == 0, F.col("line"))).alias("intro"), join(F.col("line_no") >= ask).alias("question"))
    return tasks, lines.filter((F.col("line_no") > 0) & (F.col("line_no") < ask)).select("task_id", (F.col("line_no") - 1).alias("line_no"), "line")


# Phrasings of contradictions, in the order in which they are tried.
_PREFIXES = (r"^I notice you'?ve mentioned contradictory information(?: about this)?\.?\s*", r"^You'?ve provided contradictory information\.?\s*", r"^There is contradictory information(?: about this)?\.?\s*")
_PATTERNS = (
    r"You said (.+?),?\s*but you also (?:said|mentioned) (.+?)\.?$",
    r"You (?:said|mentioned) (.+?),?\s*(?:but|however)(?: you also (?:said|mentioned))? (.+?)\.?$",
    r"(.+?),?\s*but you also (?:said|mentioned) (.+?)\.?$",
    r"On one hand,? you (?:said|mentioned) (.+?)\.?\s*On the other(?: hand)?,? (.+?)\.?$",
)


def parse_contradictions(rows: DataFrame) -> DataFrame:
    """``rows(id, ideal_answer, ...)`` with statement_a and statement_b, both null where no phrasing fits."""
    body = F.col("ideal_answer")
    for p in _PREFIXES:
        body = F.regexp_replace(body, f"(?i){p}", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?is)Could you clarify.*?\??$", ""), r"^\s+|\s+$", "")
    side = lambda p, i: F.regexp_replace(F.regexp_replace(F.regexp_extract("_b", f"(?is){p}", i), r"^\s+|\s+$", ""), r"[.,;]+$", "")
    both = [F.when((F.length(side(p, 1)) > 5) & (F.length(side(p, 2)) > 5), F.struct(side(p, 1).alias("a"), side(p, 2).alias("b"))) for p in _PATTERNS]
    out = rows.withColumn("_b", body).withColumn("_s", F.coalesce(*both))
    return out.withColumn("statement_a", F.col("_s.a")).withColumn("statement_b", F.col("_s.b")).drop("_b", "_s")


def final_answer(response: Column) -> Column:
    """The nodes of the last ``Final Answer: [...]`` of a response, blanks trimmed; the empty set without one."""
    last = F.try_element_at(F.regexp_extract_all(response, F.lit(r"(?i)Final Answer:\s*\[([^\]]*)\]"), F.lit(1)), F.lit(-1))
    parts = F.filter(F.transform(F.split(last, ","), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.coalesce(F.array_distinct(parts), F.array().cast("array<string>"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSONL log; corrupt lines are skipped, ``src_shard`` is the file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("src_shard"))
    good = raw.withColumn("r", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return good.filter("r is not null and r._bad is null and trim(value) <> ''").select("r.*", "src_shard").drop("_bad")


def read_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.parquet(*paths).withColumn("src_shard", F.col("_metadata.file_name"))


def write_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def write_turn_csv(turns: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Per-turn CSV with the given column order."""
    turns.select(*columns).write.mode("overwrite").csv(path, header=True)


def graph_to_messages(edges: DataFrame, question: str) -> DataFrame:
    """(gid, msg_idx, role, text): one message per source node in order, an answer after each, the question last."""
    per = edges.groupBy("gid", "src").agg(F.sort_array(F.collect_set("dst")).alias("to"))
    text = F.when(F.size("to") == 1, F.concat("src", F.lit(" -> "), F.element_at("to", 1))).otherwise(F.concat("src", F.lit(" -> ["), F.array_join("to", ", "), F.lit("]")))
    # Places in a graph's order: rows are dealt by ranges, counted by range, and numbered inside theirs.
    rows = per.select("gid", "src", text.alias("text")).repartitionByRange("gid", "src").withColumn("part", F.spark_partition_id())
    rows = stored(rows, "graph-ranges")
    before = Window.partitionBy("gid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("gid", "part").agg(F.count("*").alias("n"))
    parts = stored(parts.select("gid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "graph-parts")
    k = F.col("before") + F.row_number().over(Window.partitionBy("gid", "part").orderBy("src")) - 1
    numbered = rows.join(parts, ["gid", "part"]).select("gid", k.alias("k"), "text")
    return _with_answers(stored(numbered, "graph-rows"), "gid", F.lit(question))


def _with_answers(rows: DataFrame, key: str, question: Column) -> DataFrame:
    both = rows.select(key, F.explode(F.array(F.struct((2 * F.col("k")).alias("msg_idx"), F.lit("user").alias("role"), F.col("text").alias("text")), F.struct((2 * F.col("k") + 1).alias("msg_idx"), F.lit("assistant").alias("role"), F.lit("Noted.").alias("text")))).alias("m")).select(key, "m.*")
    last = rows.groupBy(key).agg((2 * F.max("k") + 2).alias("msg_idx")).select(key, "msg_idx", F.lit("user").alias("role"), question.alias("text"))
    return both.unionByName(last)


def chunk_to_messages(lines: DataFrame, tasks: DataFrame, n: int) -> DataFrame:
    """(task_id, msg_idx, role, text): context lines in messages of ``n``, an answer after each, the question last."""
    k = F.floor(F.col("line_no") / n).cast("int")
    per = lines.withColumn("k", k).groupBy("task_id", "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    out = _with_answers(per, "task_id", F.lit(None).cast("string"))
    return out.join(tasks.select("task_id", "question").hint("merge"), "task_id").select("task_id", "msg_idx", "role", F.coalesce("text", "question").alias("text"))


def flatten_transcript(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, transcript): one text per conversation with role tags between a start and an end mark."""
    part = F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("msg_idx", part.alias("t")))), lambda x: x["t"]), "\n\n")
    return messages.groupBy(key).agg(F.concat(F.lit("=== TRANSCRIPT START ===\n"), body, F.lit("\n=== TRANSCRIPT END ===")).alias("transcript"))
