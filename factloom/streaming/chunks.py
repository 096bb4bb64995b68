"""Recorded response chunks: two delta dialects to one event table, whole messages from events, hidden tool calls."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.functions.text import strip

#: ``chunks(response_id, seq, type, block_index, block_type, text, partial_json, tool_use_id, tool_name, stop_reason)``
CHUNKS = "response_id string, seq long, type string, block_index int, block_type string, text string, partial_json string, tool_use_id string, tool_name string, stop_reason string"
# Reasons to stop, between the dialects.
STOP = {"stop": "end_turn", "length": "max_tokens", "tool_calls": "tool_use", "content_filter": "end_turn"}


def normalize_events(raw: DataFrame) -> DataFrame:
    """Dialect 1, ``raw(response_id, seq, value)``: typed events, one chunk each; others become ``ping``."""
    g = lambda p: F.get_json_object("value", f"$.{p}")
    t = g("type")
    kind = (
        F.when(t.isin("message_start", "message_stop", "message_delta", "ping", "error"), t)
        .when(t == "content_block_start", "block_start")
        .when(t == "content_block_stop", "block_stop")
        .when(g("delta.type") == "text_delta", "text_delta")
        .when(g("delta.type") == "input_json_delta", "tool_use_delta")
        .otherwise("ping")
    )
    return raw.select(
        "response_id", "seq", kind.alias("type"), g("index").cast("int").alias("block_index"), g("content_block.type").alias("block_type"),
        F.coalesce(g("delta.text"), g("content_block.text")).alias("text"), g("delta.partial_json").alias("partial_json"),
        g("content_block.id").alias("tool_use_id"), g("content_block.name").alias("tool_name"), g("delta.stop_reason").alias("stop_reason"),
    )


def normalize_deltas(raw: DataFrame) -> DataFrame:
    """Dialect 2: deltas of content, reasoning and tool calls. Text is block 0, the n-th tool call block n + 1.

    Text of white space alone after a tool call is dropped. The rows of a response share a window. The events that this
    dialect leaves out are made: the message opens with its first row and a block with its first delta; where the reason to
    stop comes, the open blocks close and the message ends. Sequence numbers are spread to make room for them.
    """
    g = lambda p: F.get_json_object("value", f"$.{p}")
    calls = F.from_json(g("choices[0].delta.tool_calls"), "array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>")
    rows = raw.select("response_id", (F.col("seq") * 8).alias("seq"), g("choices[0].delta.content").alias("text"), calls.alias("calls"), g("choices[0].finish_reason").alias("reason"))
    order = Window.partitionBy("response_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tool_before = F.coalesce(F.max((F.size("calls") > 0).cast("int")).over(before), F.lit(0)) == 1
    rows = rows.withColumn("said", F.when((F.coalesce("text", F.lit("")) != "") & ~(tool_before & F.col("text").rlike(r"^\s*$")), F.col("text")))
    types = dict(c.split() for c in CHUNKS.split(", "))
    made = lambda df, **c: df.select(*[(c[n] if n in c else F.lit(None)).cast(t).alias(n) for n, t in types.items()])
    rid, seq = F.col("response_id"), F.col("seq")
    text = made(rows.filter("said is not null"), response_id=rid, seq=seq + 2, type=F.lit("text_delta"), block_index=F.lit(0), block_type=F.lit("text"), text=F.col("said"))
    tool = rows.select("response_id", "seq", F.explode("calls").alias("c"))
    tool = made(tool, response_id=rid, seq=seq + 2, type=F.lit("tool_use_delta"), block_index=F.coalesce("c.index", F.lit(0)) + 1, block_type=F.lit("tool_use"), partial_json=F.col("c.function.arguments"), tool_use_id=F.col("c.id"), tool_name=F.col("c.function.name"))
    deltas = text.unionByName(tool)
    blocks = deltas.groupBy("response_id", "block_index").agg(F.min("seq").alias("seq"), F.first("block_type").alias("block_type"), F.max("tool_use_id").alias("tool_use_id"), F.max("tool_name").alias("tool_name"))
    starts = made(blocks, response_id=rid, seq=seq - 1, type=F.lit("block_start"), block_index=F.col("block_index"), block_type=F.col("block_type"), tool_use_id=F.col("tool_use_id"), tool_name=F.col("tool_name"))
    opened = made(rows.groupBy("response_id").agg(F.min("seq").alias("seq")), response_id=rid, seq=seq, type=F.lit("message_start"))
    reason = F.coalesce(*[F.when(F.col("reason") == k, F.lit(v)) for k, v in STOP.items()], F.col("reason"))
    ends = rows.filter("reason is not null")
    closed = blocks.select("response_id", "block_index", "block_type").hint("merge").join(ends.groupBy("response_id").agg(F.max("seq").alias("seq")), "response_id")
    closed = made(closed, response_id=rid, seq=seq + 3, type=F.lit("block_stop"), block_index=F.col("block_index"), block_type=F.col("block_type"))
    stop = made(ends, response_id=rid, seq=seq + 4, type=F.lit("message_delta"), stop_reason=reason)
    over = made(ends.groupBy("response_id").agg(F.max("seq").alias("seq")), response_id=rid, seq=seq + 5, type=F.lit("message_stop"))
    out = opened
    for part in (starts, deltas, closed, stop, over):
        out = out.unionByName(part)
    return out


def stop_reason_out(reason: Column) -> Column:
    """The reason to stop in dialect 2."""
    back = {v: k for k, v in reversed(STOP.items())}
    return F.coalesce(*[F.when(reason == k, F.lit(v)) for k, v in back.items()], reason)


def reassemble(chunks: DataFrame) -> DataFrame:
    """(response_id, blocks, stop_reason): blocks in the order in which they start, with their text, or their tool input as JSON.

    Deltas of a block that no ``block_start`` opened are ignored. Empty input is ``{}``; what does not parse is kept under
    ``_partial_json``. A response without blocks has none.
    """
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c]), "")
    rows = chunks.filter("block_index is not null")
    per = rows.groupBy("response_id", "block_index").agg(F.min(F.when(F.col("type") == "block_start", F.col("seq"))).alias("first_seq"), F.max("block_type").alias("block_type"), ordered("text").alias("text"), ordered("partial_json").alias("json"), F.max("tool_use_id").alias("tool_use_id"), F.max("tool_name").alias("tool_name"))
    good = F.try_parse_json("json").isNotNull() & F.ltrim("json").startswith("{")
    value = F.when(strip(F.col("json")) == "", "{}").when(good, F.col("json")).otherwise(F.to_json(F.struct(F.col("json").alias("_partial_json"))))
    per = per.filter("first_seq is not null")
    block = F.struct("first_seq", "block_index", F.col("block_type").alias("type"), F.when(F.col("block_type") == "text", F.col("text")).alias("text"), "tool_use_id", "tool_name", F.when(F.col("block_type") == "tool_use", value).alias("tool_input"))
    blocks = per.groupBy("response_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    ends = chunks.groupBy("response_id").agg(F.max_by("stop_reason", F.when(F.col("stop_reason").isNotNull(), F.col("seq"))).alias("stop_reason"))
    return ends.join(blocks.hint("merge"), "response_id", "left").select("response_id", "blocks", "stop_reason")


BLOCKS = "array<struct<first_seq:long,block_index:int,type:string,text:string,tool_use_id:string,tool_name:string,tool_input:string>>"
MESSAGES = f"response_id string, blocks {BLOCKS}, stop_reason string, complete boolean"


def _assembled(chunks: list[tuple]) -> tuple[list[Row], str | None]:
    """(blocks, stop_reason) of one response's chunks, as :func:`reassemble` has them."""
    started: dict[int, list] = {}
    reason = None
    for seq, kind, index, block_type, text, part, ident, name, stop in sorted(chunks, key=lambda c: c[0]):
        reason = stop if stop is not None else reason
        if kind == "block_start":
            started.setdefault(index, [seq, block_type, "", "", None, None])
        if index in started:
            b = started[index]
            b[2], b[3], b[4], b[5] = b[2] + (text or ""), b[3] + (part or ""), ident or b[4], name or b[5]

    def value(said: str) -> str:
        try:
            good = isinstance(json.loads(said or "{}"), dict)
        except ValueError:
            good = False
        return (said or "{}") if good else json.dumps({"_partial_json": said}, ensure_ascii=False, separators=(",", ":"))

    names = ("first_seq", "block_index", "type", "text", "tool_use_id", "tool_name", "tool_input")
    rows = [(b[0], i, b[1], b[2] if b[1] == "text" else None, b[4], b[5], value(b[3].strip() and b[3]) if b[1] == "tool_use" else None) for i, b in started.items()]
    return [Row(**dict(zip(names, r, strict=True))) for r in sorted(rows, key=lambda r: r[:2])], reason


class OpenResponse(StatefulProcessor):
    """The chunks of a response that has not ended: each is appended once and read once, at the end."""

    def __init__(self, wait_ms: int | None) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "seq long, type string, block_index int, block_type string, text string, partial_json string, tool_use_id string, tool_name string, stop_reason string")
        self.until = handle.getValueState("until", "ms long")

    def _out(self, key: Any, chunks: list[tuple], complete: bool) -> Iterator[Row]:
        self.chunks.clear()
        self.until.clear()
        for t in list(self.handle.listTimers()) if self.wait_ms is not None else ():
            self.handle.deleteTimer(t)
        blocks, reason = _assembled(chunks)
        yield Row(response_id=key[0], blocks=blocks, stop_reason=reason, complete=complete)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new, newest = [], 0
        for r in rows:
            new.append((r.seq, r.type, r.block_index, r.block_type, r.text, r.partial_json, r.tool_use_id, r.tool_name, r.stop_reason))
            newest = max(newest, r.event_ms or 0)
        if any(c[1] == "message_stop" for c in new):
            yield from self._out(key, [*self.chunks.get(), *new], True)
            return
        self.chunks.appendList(new)
        if self.wait_ms is None:
            return
        before = self.until.get()[0] if self.until.exists() else 0
        if newest + self.wait_ms > before:
            if before:
                self.handle.deleteTimer(before)
            self.until.update((newest + self.wait_ms,))
            self.handle.registerTimer(newest + self.wait_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._out(key, list(self.chunks.get()), False)


def reassemble_stream(chunks: DataFrame, timeout: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The same over a stream, with ``complete``: a response is emitted at its ``message_stop``.

    With a ``timeout`` the chunks have an ``event_time``, and a response whose last chunk is that much older than the
    watermark (``late`` behind the newest chunk) is emitted as incomplete; without one it waits for its end. Time is that of
    the chunks, so a run over what is there ends by itself. State holds the chunks of open responses alone. Needs the state
    store that :func:`factloom.streaming.keyed.run_to` sets.
    """
    wait_ms = None
    rows = chunks.withColumn("event_ms", F.lit(0).cast("long"))
    if timeout is not None:
        wait_ms = chunks.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp '2000-01-01 00:00:00' + interval {timeout}) - unix_millis(timestamp '2000-01-01 00:00:00')")).first()[0]
        rows = chunks.withWatermark("event_time", late).withColumn("event_ms", F.unix_millis("event_time"))
    rows = rows.select("response_id", *[c.split()[0] for c in CHUNKS.split(", ")[1:]], "event_ms")
    return rows.groupBy("response_id").transformWithState(OpenResponse(wait_ms), MESSAGES, "Append", "None" if timeout is None else "EventTime")


def coerce(value: Column) -> Column:
    """A parameter's text as JSON: booleans, null, numbers and JSON as they are, else a string."""
    t = strip(value)
    number = t.rlike(r"^-?\d+(\.\d+)?$")
    return F.when(t.isin("true", "True"), "true").when(t.isin("false", "False"), "false").when(t.isin("null", "None"), "null").when(number | (F.substring(t, 1, 1).isin("[", "{") & F.try_parse_json(t).isNotNull()), t).otherwise(F.substring(F.to_json(F.array(value)), F.lit(2), F.length(F.to_json(F.array(value))) - 2))


def recover_tool_calls(responses: DataFrame) -> DataFrame:
    """``responses(response_id, text, reasoning, has_tool_call)`` with ``calls`` found in the reasoning, and the text.

    Only without a tool call of its own: ``<tool_call><function=name><parameter=key>value</parameter>...`` is read. If
    there is no text either, what follows the last ``</think>`` is.
    """
    calls = F.regexp_extract_all("reasoning", F.lit(r"(?s)<tool_call>\s*(<function=.*?</function>)\s*</tool_call>"), F.lit(1))
    quote = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)

    def one(c: Column) -> Column:
        params = F.regexp_extract_all(c, F.lit(r"(?s)<parameter=[^>]+>.*?</parameter>"), F.lit(0))
        pair = lambda p: F.concat(quote(F.regexp_extract(p, r"<parameter=([^>]+)>", 1)), F.lit(":"), coerce(F.regexp_replace(F.regexp_extract(p, r"(?s)<parameter=[^>]+>(.*?)</parameter>", 1), r"^\n|\n$", "")))
        return F.struct(F.regexp_extract(c, r"<function=([^>]+)>", 1).alias("name"), F.concat(F.lit("{"), F.array_join(F.transform(params, pair), ","), F.lit("}")).alias("input"))

    none = F.array().cast("array<struct<name:string,input:string>>")
    found = F.when(F.col("has_tool_call"), none).otherwise(F.coalesce(F.transform(calls, one), none))
    out = responses.withColumn("calls", found)
    quiet = (F.coalesce("text", F.lit("")) == "") & ~F.col("has_tool_call") & (F.size("calls") == 0)
    return out.withColumn("text", F.when(quiet, strip(F.substring_index("reasoning", "</think>", -1))).otherwise(F.col("text")))
