"""Session transcripts and tool events, from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_TEXT, MOST_TEXT, LEAST_RESULT, BACKFILL = 16, 12_000, 24, 50
# Beginnings of texts that echo commands, and tools whose results are not kept.
ECHOES = ("<command-name>", "<local-command-stdout>", "<local-command-caveat>", "<system-reminder>", "[Request interrupted")
ADMIN_TOOLS = ("TodoWrite", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet", "TaskOutput", "TaskStop", "ExitPlanMode", "EnterPlanMode", "EnterWorktree", "ExitWorktree", "ToolSearch", "ScheduleWakeup")
LINE = "type string, isMeta boolean, isSidechain boolean, message struct<role:string,content:string>, timestamp string, sessionId string"
_STRIP = r"^\s+|\s+$"


def _text(content: Column) -> Column:
    """A plain text, or the text blocks of a JSON list joined by newlines."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    parts = F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    return F.when(F.ltrim(content).startswith("["), F.coalesce(F.array_join(F.transform(parts, lambda b: b["text"]), "\n"), content)).otherwise(content)


def parse_transcripts(lines: DataFrame, client: str = "chat", ingest_time: Column | None = None) -> DataFrame:
    """``lines(value[, session_id])`` to (session_id, role, text, source, event_time).

    Malformed lines, meta lines, side chains, other types and roles, empty texts, command echoes and short texts fall
    away; long texts are cut. A missing or broken time becomes ``ingest_time`` (the current time if not given). Works on
    batches and streams.
    """
    o = lines.withColumn("o", F.from_json("value", LINE, {"mode": "PERMISSIVE"}))
    keep = F.col("o.type").isin("user", "assistant") & F.col("o.message.role").isin("user", "assistant") & ~F.coalesce("o.isMeta", F.lit(False)) & ~F.coalesce("o.isSidechain", F.lit(False))
    text = F.regexp_replace(_text(F.col("o.message.content")), _STRIP, "")
    rows = o.filter(keep).withColumn("text", text).filter(F.length("text") >= LEAST_TEXT)
    for echo in ECHOES:
        rows = rows.filter(~F.col("text").startswith(echo))
    cut = F.when(F.length("text") > MOST_TEXT, F.concat(F.left("text", F.lit(MOST_TEXT)), F.lit("\n[…truncated]"))).otherwise(F.col("text"))
    session = F.coalesce("session_id", "o.sessionId") if "session_id" in lines.columns else F.col("o.sessionId")
    when = F.coalesce(F.try_to_timestamp("o.timestamp"), ingest_time if ingest_time is not None else F.current_timestamp())
    return rows.select(session.alias("session_id"), F.col("o.message.role").alias("role"), cut.alias("text"), F.concat(F.lit(f"{client}:"), "o.message.role").alias("source"), when.alias("event_time"))


def read_transcripts(spark: SparkSession, path: str, client: str = "chat", ingest_time: Column | None = None) -> DataFrame:
    """A folder of JSONL files; a file's name is the session of lines that name none."""
    raw = spark.read.text(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.jsonl?)?$", 1))
    out = raw.withColumn("session_id", F.coalesce(F.get_json_object("value", "$.sessionId"), "file"))
    return parse_transcripts(out.select("value", "session_id"), client, ingest_time)


def backfill(rows: DataFrame, cursors: DataFrame | None = None, most: int = BACKFILL) -> DataFrame:
    """The last rows of each session that has no cursor yet; sessions with one pass whole."""
    order = Window.partitionBy("session_id").orderBy(F.desc("event_time"), F.desc("text"))
    ranked = rows.withColumn("_r", F.row_number().over(order))
    if cursors is None:
        return ranked.filter(F.col("_r") <= most).drop("_r")
    known = cursors.select("session_id").distinct().withColumn("_known", F.lit(True))
    return ranked.join(known, "session_id", "left").filter((F.col("_r") <= most) | F.col("_known")).drop("_r", "_known")


def _json(name: str) -> Column:
    return F.to_json(F.try_variant_get(F.try_parse_json("value"), f"$.{name}", "variant"))


def _plain(j: Column) -> Column:
    """A JSON string's value, or null."""
    return F.when(F.ltrim(j).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), j, F.lit("}")), "$.v"))


def _list_text(j: Column) -> Column:
    items = F.transform(F.from_json(j, "array<variant>"), lambda v: F.to_json(v))
    one = lambda b: F.coalesce(F.when(F.get_json_object(b, "$.type") == "text", F.nullif(F.get_json_object(b, "$.text"), F.lit(""))), _plain(b), b)
    return F.when(F.ltrim(j).startswith("["), F.array_join(F.transform(items, one), "\n"))


def result_text(j: Column) -> Column:
    """A tool's response as text: plain, stdout with stderr, output, content, a list of blocks, or its JSON."""
    get = lambda p: F.get_json_object(j, f"$.{p}")
    out, err = F.nullif(get("stdout"), F.lit("")), F.nullif(get("stderr"), F.lit(""))
    streams = F.when(get("stdout").isNotNull() | get("stderr").isNotNull(), F.concat_ws("\n", out, F.concat(F.lit("[stderr]\n"), err)))
    content = get("content")
    return F.coalesce(_plain(j), _list_text(j), streams, get("output"), F.when(F.ltrim(content).startswith("["), _list_text(content)).otherwise(content), j, F.lit(""))


def classify(name: Column, value: Column) -> tuple[Column, Column]:
    """(source, header) of a tool event by the tool's family; commands are known by a hash."""
    arg = lambda p: F.coalesce(F.get_json_object(value, f"$.tool_input.{p}"), F.lit(""))
    path = F.coalesce(F.nullif(arg("file_path"), F.lit("")), arg("notebook_path"))
    head = lambda *c: F.rtrim(F.concat(F.lit("# "), name, F.lit(" "), *c))
    other = F.concat(F.lit("tool:"), name)
    is_file, is_shell, is_search = name.isin("Read", "NotebookRead", "Edit", "Write", "NotebookEdit"), name.isin("Bash", "PowerShell"), name.isin("Grep", "Glob")
    source = (
        F.when(is_file, F.when(path != "", F.concat(F.lit("file:"), path)).otherwise(other))
        .when(is_shell, F.concat(F.lit("bash:"), F.left(F.sha2(arg("command"), 256), F.lit(8))))
        .when(is_search, F.concat(F.lit("search:"), name))
        .when(name == "WebFetch", F.when(arg("url") != "", F.concat(F.lit("web:"), arg("url"))).otherwise(other))
        .when(name == "WebSearch", "search:web")
        .otherwise(other)
    )
    header = (
        F.when(is_file, head(path))
        .when(is_shell, F.concat(head(arg("description")), F.lit("\n$ "), arg("command")))
        .when(is_search, F.concat(F.lit("# "), name, F.lit(" "), arg("pattern"), F.when(arg("path") != "", F.concat(F.lit("  in "), arg("path"))).otherwise("")))
        .when(name == "WebFetch", head(arg("url")))
        .when(name == "WebSearch", head(arg("query")))
        .otherwise(F.concat(F.lit("# "), name))
    )
    return source, header


def parse_tool_events(lines: DataFrame) -> DataFrame:
    """``lines(value)`` to (session_id, cwd, source, text). Admin tools, failed events and short results fall away."""
    name = F.get_json_object("value", "$.tool_name")
    response = F.coalesce(_json("tool_response"), _json("tool_result"))
    get = lambda p: F.get_json_object(response, f"$.{p}")
    failed = (get("is_error") == "true") | (F.coalesce(get("error"), F.lit("")) != "") | (get("interrupted") == "true")
    rows = lines.filter((F.coalesce(name, F.lit("")) != "") & ~name.isin(*ADMIN_TOOLS) & ~name.startswith("mcp__") & ~F.coalesce(failed, F.lit(False)))
    rows = rows.withColumn("body", F.regexp_replace(result_text(response), _STRIP, "")).filter(F.length("body") >= LEAST_RESULT)
    source, header = classify(name, F.col("value"))
    over = F.length("body") - MOST_TEXT
    cut = F.when(over > 0, F.concat(F.left("body", F.lit(MOST_TEXT)), F.lit("\n[…truncated "), over.cast("string"), F.lit(" chars]"))).otherwise(F.col("body"))
    return rows.select(F.coalesce(F.get_json_object("value", "$.session_id"), F.lit("unknown")).alias("session_id"), F.get_json_object("value", "$.cwd").alias("cwd"), source.alias("source"), F.concat(header, F.lit("\n\n"), cut).alias("text"))


def read_tool_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_tool_events(spark.read.text(path))
