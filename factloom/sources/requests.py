"""Logged chat requests in two wire shapes, to one table of messages with typed blocks, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.schemas import BLOCK

MAX_TOKENS = 4096
_FIELDS = ("type", "text", "media_type", "data_b64", "url", "tool_use_id", "tool_name", "tool_input", "result_text", "is_error", "original_type", "payload")
_TYPES = {"is_error": "boolean"}


def block(**given: Column) -> Column:
    """A block struct with the given fields, the others null."""
    return F.struct(*[(given.get(c, F.lit(None))).cast(_TYPES.get(c, "string")).alias(c) for c in _FIELDS])


def _get(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def _items(json: Column) -> Column:
    """A JSON array as an array of JSON texts; null for other JSON."""
    return F.when(F.ltrim(json).startswith("["), F.transform(F.from_json(json, "array<variant>"), lambda v: F.to_json(v)))


def _string(json: Column) -> Column:
    """A JSON string's value; null for other JSON."""
    return F.when(F.ltrim(json).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v"))


def _field(body: str, name: str) -> Column:
    """A field of a JSON object as JSON text."""
    return F.to_json(F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant"))


def _texts(json: Column, sep: str) -> Column:
    """A string, or the text blocks of a list joined."""
    parts = F.filter(F.transform(_items(json), lambda b: _get(b, "$.text")), lambda t: t.isNotNull())
    return F.coalesce(_string(json), F.array_join(parts, sep))


def _image(b: Column) -> Column:
    return block(type=F.lit("image"), media_type=_get(b, "$.source.media_type"), data_b64=F.when(_get(b, "$.source.type") == "base64", _get(b, "$.source.data")), url=F.when(_get(b, "$.source.type") == "url", _get(b, "$.source.url")))


def _block_one(b: Column) -> Column:
    kind = _get(b, "$.type")
    result = F.to_json(F.try_variant_get(F.try_parse_json(b), "$.content", "variant"))
    body = F.coalesce(_string(result), F.array_join(F.filter(F.transform(_items(result), lambda x: _get(x, "$.text")), lambda t: t.isNotNull()), "\n"), result)
    return (
        F.when(kind == "text", block(type=F.lit("text"), text=F.coalesce(_get(b, "$.text"), F.lit(""))))
        .when(kind == "image", _image(b))
        .when(kind == "tool_use", block(type=F.lit("tool_use"), tool_use_id=_get(b, "$.id"), tool_name=_get(b, "$.name"), tool_input=F.coalesce(_get(b, "$.input"), F.lit("{}"))))
        .when(kind == "tool_result", block(type=F.lit("tool_result"), tool_use_id=_get(b, "$.tool_use_id"), result_text=body, is_error=F.coalesce(_get(b, "$.is_error") == "true", F.lit(False))))
        .when(kind == "thinking", block(type=F.lit("text"), text=_get(b, "$.thinking")))
        .otherwise(block(type=F.lit("opaque"), original_type=kind, payload=b))
    )


def _as_blocks(content: Column) -> Column:
    one = F.array(block(type=F.lit("text"), text=_string(content)))
    return F.when(_string(content).isNotNull(), one).otherwise(F.coalesce(F.transform(_items(content), _block_one), F.array().cast(f"array<{BLOCK}>")))


def _head(raw: DataFrame, *more: Column) -> DataFrame:
    return raw.select("request_id", *more, _get(F.col("body"), "$.model").alias("model"), F.coalesce(_get(F.col("body"), "$.max_tokens").try_cast("int"), F.lit(MAX_TOKENS)).alias("max_tokens"), F.coalesce(_get(F.col("body"), "$.stream") == "true", F.lit(False)).alias("stream"))


def _messages(raw: DataFrame) -> DataFrame:
    return raw.select("request_id", F.posexplode(_items(_field("body", "messages"))).alias("msg_idx", "m")).select("request_id", "msg_idx", _get(F.col("m"), "$.role").alias("role"), "m", _field("m", "content").alias("content"))


def normalize_one(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shape 1, ``raw(request_id, body)``: (requests with system text, messages with blocks, rejected rows and why)."""
    system = _texts(_field("body", "system"), "\n\n")
    heads = _head(raw, system.alias("system"))
    m = _messages(raw)
    good = F.col("role").isin("user", "assistant")
    bad = m.filter(~F.coalesce(good, F.lit(False))).select("request_id", "msg_idx", F.concat(F.lit("bad role: "), F.coalesce("role", F.lit("none"))).alias("error"))
    broken = raw.filter(F.try_parse_json("body").isNull()).select("request_id", F.lit(None).cast("int").alias("msg_idx"), F.lit("not JSON").alias("error"))
    return heads, m.filter(good).select("request_id", "msg_idx", "role", _as_blocks(F.col("content")).alias("blocks")), bad.unionByName(broken)


def _parts_two(content: Column) -> Column:
    def one(p: Column) -> Column:
        url = _get(p, "$.image_url.url")
        data = url.startswith("data:")
        image = block(type=F.lit("image"), media_type=F.when(data, F.regexp_extract(url, "^data:([^;,]*)", 1)), data_b64=F.when(data, F.regexp_extract(url, ",(.*)$", 1)), url=F.when(~data, url))
        return F.when(_get(p, "$.type") == "text", block(type=F.lit("text"), text=_get(p, "$.text"))).when(_get(p, "$.type") == "image_url", image).otherwise(block(type=F.lit("opaque"), original_type=_get(p, "$.type"), payload=p))

    said = F.array(block(type=F.lit("text"), text=_string(content)))
    return F.when(_string(content).isNotNull(), F.when(_string(content) == "", F.array().cast(f"array<{BLOCK}>")).otherwise(said)).otherwise(F.coalesce(F.transform(_items(content), one), F.array().cast(f"array<{BLOCK}>")))


def _calls(m: Column) -> Column:
    def one(c: Column) -> Column:
        args = F.coalesce(_get(c, "$.function.arguments"), F.lit("{}"))
        good = F.try_parse_json(args).isNotNull() & F.ltrim(args).startswith("{")
        return block(type=F.lit("tool_use"), tool_use_id=_get(c, "$.id"), tool_name=_get(c, "$.function.name"), tool_input=F.when(good, args).otherwise(F.to_json(F.struct(args.alias("_partial_json")))))

    return F.coalesce(F.transform(_items(_field(m, "tool_calls")), one), F.array().cast(f"array<{BLOCK}>"))


def normalize_two(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shape 2: (requests, messages). System and developer texts are joined; runs of tool messages become one user message
    of tool results; other roles are skipped."""
    m = _messages(raw)
    sys = m.filter(F.col("role").isin("system", "developer")).groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("msg_idx", _texts(F.col("content"), "\n").alias("t")))), lambda x: x["t"]), "\n\n").alias("system"))
    heads = _head(raw).join(sys.hint("merge"), "request_id", "left")
    m = m.filter(F.col("role").isin("user", "assistant", "tool"))
    order = Window.partitionBy("request_id").orderBy("msg_idx")
    starts = F.when((F.col("role") == "tool") & (F.lag("role").over(order) == "tool"), 0).otherwise(1)
    m = m.withColumn("run", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    result = block(type=F.lit("tool_result"), tool_use_id=_get(F.col("m"), "$.tool_call_id"), result_text=_texts(F.col("content"), "\n"), is_error=F.lit(False))
    blocks = F.when(F.col("role") == "tool", F.array(result)).when(F.col("role") == "assistant", F.concat(_parts_two(F.col("content")), _calls("m"))).otherwise(_parts_two(F.col("content")))
    m = m.withColumn("blocks", blocks)
    folded = m.groupBy("request_id", "run").agg(F.first("role").alias("role"), F.min("msg_idx").alias("msg_idx"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("msg_idx", "blocks"))), lambda x: x["blocks"])).alias("blocks"))
    return heads, folded.select("request_id", (F.col("run") - 1).cast("int").alias("msg_idx"), F.when(F.col("role") == "tool", "user").otherwise(F.col("role")).alias("role"), "blocks")


def message_text(blocks: Column, include_tools: bool = True) -> Column:
    """A message as text: one line or paragraph per block."""
    tool = lambda c: c if include_tools else F.lit(None).cast("string")
    one = lambda b: (
        F.when(b["type"] == "text", b["text"])
        .when(b["type"] == "image", F.concat(F.lit("[image: "), F.coalesce(b["media_type"], F.lit("url")), F.lit("]")))
        .when(b["type"] == "tool_use", tool(F.concat(F.lit("[tool_use "), b["tool_name"], F.lit("("), b["tool_input"], F.lit(")]"))))
        .when(b["type"] == "tool_result", tool(F.concat(F.lit("[tool_result"), F.when(b["is_error"], " (error)").otherwise(""), F.lit(": "), F.coalesce(b["result_text"], F.lit("")), F.lit("]"))))
        .otherwise(F.concat(F.lit("["), F.coalesce(b["original_type"], F.lit("opaque")), F.lit("]")))
    )
    return F.array_join(F.filter(F.transform(blocks, one), lambda t: t.isNotNull()), "\n")


def is_pure_tool_result(role: Column, blocks: Column) -> Column:
    return (role == "user") & (F.size(blocks) > 0) & F.forall(blocks, lambda b: b["type"] == "tool_result")


def has_open_tool_use(role: Column, blocks: Column) -> Column:
    return (role == "assistant") & F.exists(blocks, lambda b: b["type"] == "tool_use")


def _one_out(b: Column) -> Column:
    source = F.when(b["data_b64"].isNotNull(), F.to_json(F.struct(F.lit("base64").alias("type"), b["media_type"].alias("media_type"), b["data_b64"].alias("data")))).otherwise(F.to_json(F.struct(F.lit("url").alias("type"), b["url"].alias("url"))))
    return (
        F.when(b["type"] == "text", F.to_json(F.struct(b["type"].alias("type"), b["text"].alias("text"))))
        .when(b["type"] == "image", F.concat(F.lit('{"type":"image","source":'), source, F.lit("}")))
        .when(b["type"] == "tool_use", F.concat(F.lit('{"type":"tool_use","id":'), _quote(b["tool_use_id"]), F.lit(',"name":'), _quote(b["tool_name"]), F.lit(',"input":'), b["tool_input"], F.lit("}")))
        .when(b["type"] == "tool_result", F.to_json(F.struct(b["type"].alias("type"), b["tool_use_id"].alias("tool_use_id"), b["result_text"].alias("content"), b["is_error"].alias("is_error"))))
        .otherwise(b["payload"])
    )


def _quote(c: Column) -> Column:
    return F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def _collect(rows: DataFrame, json: Column, order: list[str]) -> DataFrame:
    made = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, json.alias("j")))), lambda x: x["j"]), ",")
    return rows.groupBy("request_id").agg(F.concat(F.lit('"messages":['), made, F.lit("]")).alias("ms"))


def denormalize_one(heads: DataFrame, messages: DataFrame) -> DataFrame:
    """(request_id, body) in shape 1; opaque blocks go out as they came."""
    content = F.concat(F.lit("["), F.array_join(F.transform("blocks", _one_out), ","), F.lit("]"))
    ms = _collect(messages, F.concat(F.lit('{"role":'), _quote(F.col("role")), F.lit(',"content":'), content, F.lit("}")), ["msg_idx"])
    system = F.when(F.coalesce("system", F.lit("")) != "", F.concat(F.lit('"system":'), _quote(F.col("system")), F.lit(","))).otherwise("")
    out = heads.join(ms.hint("merge"), "request_id", "left")
    return out.select("request_id", F.concat(F.lit('{"model":'), _quote(F.col("model")), F.lit(',"max_tokens":'), F.col("max_tokens").cast("string"), F.lit(","), system, F.coalesce("ms", F.lit('"messages":[]')), F.lit("}")).alias("body"))


def _part_two_out(b: Column) -> Column:
    url = F.when(b["data_b64"].isNotNull(), F.concat(F.lit("data:"), b["media_type"], F.lit(";base64,"), b["data_b64"])).otherwise(F.coalesce(b["url"], F.lit("")))
    said = lambda t: F.to_json(F.struct(F.lit("text").alias("type"), t.alias("text")))
    return (
        F.when(b["type"] == "text", said(b["text"]))
        .when(b["type"] == "image", F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url"))))
        .when(b["type"] == "tool_result", said(F.coalesce(b["result_text"], F.lit(""))))
        .when(b["type"] == "tool_use", F.to_json(F.struct(b["type"].alias("type"), b["tool_name"].alias("name"), b["tool_input"].alias("input"))))
        .otherwise(b["payload"])
    )


def denormalize_two(heads: DataFrame, messages: DataFrame) -> DataFrame:
    """(request_id, body) in shape 2; a user message of tool results becomes a tool message for each of them.

    Texts of a message are joined as they stand. A user message with images or other blocks goes out as parts, tool results
    among them as text, opaque blocks as they came. An assistant message without text has null content.
    """
    m = messages.withColumn("pure", is_pure_tool_result(F.col("role"), F.col("blocks")))
    each = m.filter("pure").select("request_id", "msg_idx", F.posexplode("blocks").alias("k", "b"))
    tool = F.to_json(F.struct(F.lit("tool").alias("role"), F.col("b.tool_use_id").alias("tool_call_id"), F.coalesce("b.result_text", F.lit("")).alias("content")))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    plain = F.forall("blocks", lambda b: b["type"] == "text")
    parts = F.concat(F.lit("["), F.array_join(F.transform("blocks", _part_two_out), ","), F.lit("]"))
    silent = (F.col("role") == "assistant") & ~F.exists("blocks", lambda b: b["type"] == "text")
    content = F.when(silent, "null").when((F.col("role") == "assistant") | plain, _quote(text)).otherwise(parts)
    call = lambda b: F.to_json(F.struct(b["tool_use_id"].alias("id"), F.lit("function").alias("type"), F.struct(b["tool_name"].alias("name"), b["tool_input"].alias("arguments")).alias("function")))
    calls = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), call)
    said = F.concat(F.lit('{"role":'), _quote(F.col("role")), F.lit(',"content":'), content, F.when(F.size(calls) > 0, F.concat(F.lit(',"tool_calls":['), F.array_join(calls, ","), F.lit("]"))).otherwise(""), F.lit("}"))
    rows = m.filter("not pure").select("request_id", "msg_idx", F.lit(0).alias("k"), said.alias("j")).unionByName(each.select("request_id", "msg_idx", "k", tool.alias("j")))
    first = heads.filter(F.coalesce("system", F.lit("")) != "").select("request_id", F.lit(-1).alias("msg_idx"), F.lit(0).alias("k"), F.to_json(F.struct(F.lit("system").alias("role"), F.col("system").alias("content"))).alias("j"))
    ms = _collect(rows.unionByName(first), F.col("j"), ["msg_idx", "k"])
    return heads.join(ms.hint("merge"), "request_id", "left").select("request_id", F.concat(F.lit('{"model":'), _quote(F.col("model")), F.lit(',"max_tokens":'), F.col("max_tokens").cast("string"), F.lit(","), F.coalesce("ms", F.lit('"messages":[]')), F.lit("}")).alias("body"))


# Input limits of models by the beginning of their names, the first that fits.
CONTEXT_LIMITS = {
    "claude-opus-4-7": 200_000,
    "claude-opus-4-6": 200_000,
    "claude-opus-4-5": 200_000,
    "claude-sonnet-4-6": 200_000,
    "claude-sonnet-4-5": 200_000,
    "claude-haiku-4-5": 200_000,
    "gpt-5": 200_000,
    "gpt-4o": 128_000,
    "gpt-4o-mini": 128_000,
    "o3": 200_000,
    "o4-mini": 200_000,
}
DEFAULT_LIMIT = 128_000


def context_limit(model: Column) -> Column:
    m = F.lower(model)
    return F.coalesce(*[F.when(m.startswith(p), F.lit(n)) for p, n in CONTEXT_LIMITS.items()], F.lit(DEFAULT_LIMIT))


def provider(model: Column, default: str = "anthropic") -> Column:
    m = F.lower(model)
    other = m.startswith("gpt") | m.startswith("o1") | m.startswith("o3") | m.startswith("o4")
    return F.when(m.startswith("claude") | F.contains(m, F.lit("anthropic")), "anthropic").when(other, "openai").otherwise(default)


def header_int(headers: Column, name: str, default: int = 0) -> Column:
    """A header of a map of texts as a whole number; the default where it is missing or none."""
    return F.coalesce(F.when(F.trim(headers[name]).rlike(r"^[+-]?[0-9]+$"), F.trim(headers[name])).try_cast("long"), F.lit(default).cast("long"))


def header_bool(headers: Column, name: str) -> Column:
    return F.coalesce(F.lower(headers[name]) == "true", F.lit(False))


def scope_of_project(cwd: Column) -> Column:
    """A readable name of the last folder and a hash of the whole path."""
    base = F.element_at(F.split(F.rtrim(cwd, F.lit("/")), "/"), -1)
    slug = F.left(F.trim(F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(32))
    return F.concat(F.when(slug == "", "project").otherwise(slug), F.lit("-"), F.left(F.sha2(cwd, 256), F.lit(8)))


def scope_of_key(key: Column) -> Column:
    return F.concat(F.lit("k:"), F.left(F.sha2(key, 256), F.lit(24)))
