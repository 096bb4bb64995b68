"""Registered queries over logged requests, transcripts, tool events, chunks and streams, with their SQL.

The shipped tables hold no such logs, so each query writes the rows of a table as log lines and reads those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.storage import new_folder
from factloom.functions.tokens import approx_tokens
from factloom.plans import fixtures as fx
from factloom.sources import requests as rq
from factloom.sources import tasks, transcripts
from factloom.streaming import chunks, ingest, keyed

STAMP = "yyyy-MM-dd HH:mm:ss"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcript lines; some are meta, side chains, echoes, broken or without a time."""
    c = fx.table(spark, d, "conversations")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"))))
    said = F.when(F.col("turn") % 7 == 3, F.concat(F.lit("<command-name>"), "text")).otherwise(F.col("text"))
    n = F.col("conv_id") * 31 + F.col("turn")
    quoted = F.to_json(F.array(said))
    content = F.when(F.col("role") == "assistant", blocks).otherwise(F.expr("substring(q, 2, length(q) - 2)"))
    c = c.withColumn("q", quoted)
    line = F.concat(
        F.lit('{"type":"'), "role", F.lit('","isMeta":'), (n % 11 == 0).cast("string"), F.lit(',"isSidechain":'), (n % 13 == 0).cast("string"),
        F.lit(',"sessionId":"c'), F.col("conv_id").cast("string"), F.lit('","timestamp":"'), F.when(n % 5 == 0, "bad").otherwise("2024-03-01T10:00:00Z"), F.lit('","message":{"role":"'), "role", F.lit('","content":'), content, F.when(n % 17 == 0, "").otherwise("}}"),
    )
    return c.select(line.alias("value"))


def transcript_parse(spark: SparkSession, d: str) -> DataFrame:
    t = transcripts.parse_transcripts(_lines(spark, d), ingest_time=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t.select("session_id", "role", "source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), F.date_format("event_time", STAMP).alias("event_time"))


def tool_events(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    k = F.col("o_orderkey")
    name = F.when(k % 7 == 0, "Read").when(k % 7 == 1, "Bash").when(k % 7 == 2, "Grep").when(k % 7 == 3, "WebFetch").when(k % 7 == 4, "TodoWrite").when(k % 7 == 5, "mcp__x").otherwise("Other")
    given = F.struct(F.concat(F.lit("/p/"), k.cast("string")).alias("file_path"), F.concat(F.lit("ls "), k.cast("string")).alias("command"), F.lit("list").alias("description"), F.col("o_orderpriority").alias("pattern"), F.lit("http://u/x").alias("url"))
    response = F.struct(F.concat(F.lit("result of the order "), k.cast("string"), F.lit(" is "), "o_orderstatus").alias("stdout"), F.when(k % 3 == 0, "warned").alias("stderr"), F.when(k % 10 == 0, True).alias("interrupted"))
    line = F.to_json(F.struct(name.alias("tool_name"), given.alias("tool_input"), response.alias("tool_response"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id")))
    return transcripts.parse_tool_events(o.select(line.alias("value"))).select("session_id", "source", "text")


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """A request body in shape 1 per conversation."""
    c = fx.table(spark, d, "conversations")
    one = lambda x: F.concat(F.lit('{"role":"'), x["m"]["role"], F.lit('","content":'), x["m"]["blocks"], F.lit("}"))
    quoted = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    m = F.struct("role", F.when(F.col("turn") % 2 == 0, F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))).otherwise(quoted).alias("blocks"))
    per = c.filter("role <> 'system'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))).alias("ms"))
    body = F.concat(F.lit('{"model":"claude-x","system":"be kind","max_tokens":10,"messages":['), F.array_join(F.transform("ms", one), ","), F.lit("]}"))
    return per.select(F.col("conv_id").cast("string").alias("request_id"), body.alias("body"))


def normalized_requests(spark: SparkSession, d: str) -> DataFrame:
    _, m, _ = rq.normalize_one(_bodies(spark, d))
    t = rq.message_text(F.col("blocks"))
    return m.select("request_id", F.col("msg_idx").cast("long").alias("msg_idx"), "role", F.size("blocks").cast("long").alias("n_blocks"), t.alias("text"), approx_tokens(t).alias("tokens"))


def request_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Shape 1 to messages, to shape 2, to messages again."""
    heads, m, _ = rq.normalize_one(_bodies(spark, d))
    heads2, again = rq.normalize_two(rq.denormalize_two(heads, m))
    rows = again.withColumn("text", rq.message_text(F.col("blocks"))).groupBy("request_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"))
    return rows.hint("merge").join(heads2.select("request_id", "system"), "request_id")


def request_roundtrip_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Messages with images, tool results among texts, and calls: through shape 1, and through shape 2, as text."""
    m = fx.messages(spark, d)
    said = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    user = F.concat(F.lit('[{"type":"text","text":'), said, F.lit('},{"type":"image","source":{"type":"base64","media_type":"image/png","data":"QUJD"}},{"type":"image","source":{"type":"url","url":"http://u/i.png"}},{"type":"tool_result","tool_use_id":"t","content":"res"}]'))
    results = F.concat(F.lit('[{"type":"tool_result","tool_use_id":"t","content":'), said, F.lit('},{"type":"tool_result","tool_use_id":"u","content":[{"type":"text","text":"b"}],"is_error":true}]'))
    other = F.concat(F.lit('[{"type":"text","text":"a "},{"type":"text","text":'), said, F.lit('},{"type":"tool_use","id":"t","name":"f","input":{"n":1}}]'))
    content = F.when(F.col("role") != "user", other).when(F.col("pure_tool_result"), results).otherwise(user)
    one = F.concat(F.lit('{"role":"'), "role", F.lit('","content":'), content, F.lit("}"))
    per = m.select("conv_id", F.struct("msg_idx", one.alias("j")).alias("m")).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda x: x["j"]), ",").alias("ms"))
    raw = per.select(F.col("conv_id").cast("string").alias("request_id"), F.concat(F.lit('{"model":"claude-x","max_tokens":10,"messages":['), "ms", F.lit("]}")).alias("body"))
    heads, first, _ = rq.normalize_one(raw)
    _, again, _ = rq.normalize_one(rq.denormalize_one(heads, first))
    _, other = rq.normalize_two(rq.denormalize_two(heads, first))
    text = lambda df, way: df.select("request_id", F.lit(way).alias("way"), F.col("msg_idx").cast("long").alias("msg_idx"), "role", rq.message_text(F.col("blocks")).alias("text"))
    return text(again, "one").unionByName(text(other, "two"))


def graph_task_parse(spark: SparkSession, d: str) -> DataFrame:
    e = fx.edges(spark, d).withColumn("task_id", F.expr("cast(cast(substr(src, 2) as int) div 50 as int)"))
    text = F.array_join(F.sort_array(F.collect_set(F.concat("src", F.lit(" -> "), "dst"))), "\n")
    p = e.groupBy("task_id").agg(text.alias("g"), F.min("src").alias("s"))
    prompt = F.concat(F.lit("Here is the graph to operate on:\nThe graph has the following edges:\n"), "g", F.lit("\nOperation:\n"), F.when(F.col("task_id") % 2 == 0, F.concat(F.lit("Perform a BFS from node "), "s", F.lit(" with depth 2"))).otherwise(F.concat(F.lit("Find the parents of node "), "s")))
    t, edges = tasks.parse_graph_tasks(p.select("task_id", prompt.alias("prompt")))
    return t.hint("merge").join(edges.groupBy("task_id").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_src")), "task_id")


def graph_messages(spark: SparkSession, d: str) -> DataFrame:
    return tasks.graph_to_messages(fx.edges(spark, d), "Which nodes are reachable?").select("gid", F.col("msg_idx").cast("long").alias("msg_idx"), "role", "text")


def transcript_text(spark: SparkSession, d: str) -> DataFrame:
    return tasks.flatten_transcript(fx.messages(spark, d))


def reassemble_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant turn cut into pieces of 50 characters, put together again, empty ones too. A tool call with a later
    index starts before the text, and a delta belongs to no block."""
    m = fx.messages(spark, d).filter("role = 'assistant'")
    piece = F.explode(F.expr("transform(sequence(1, length(text), 50), i -> named_struct('i', i, 't', substring(text, i, 50)))")).alias("p")
    rid = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("msg_idx").cast("string"))
    delta = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), F.col("p.t").alias("text")).alias("delta")))
    raw = m.filter("length(text) > 0").select(rid.alias("response_id"), piece).select("response_id", F.col("p.i").cast("long").alias("seq"), delta.alias("value"))
    own = [
        (-2, '{"type":"content_block_start","index":3,"content_block":{"type":"tool_use","id":"t","name":"look"}}'),
        (-1, '{"type":"content_block_start","index":0,"content_block":{"type":"text","text":""}}'),
        (10**9, '{"type":"content_block_delta","index":3,"delta":{"type":"input_json_delta","partial_json":"{\\"a\\":1}"}}'),
        (10**9 + 1, '{"type":"content_block_delta","index":5,"delta":{"type":"text_delta","text":"lost"}}'),
    ]
    for seq, value in own:
        raw = raw.unionByName(m.select(rid.alias("response_id"), F.lit(seq).cast("long").alias("seq"), F.lit(value).alias("value")))
    r, b = chunks.reassemble(chunks.normalize_events(raw)), F.col("blocks")
    return r.select("response_id", F.size("blocks").cast("long").alias("n_blocks"), b[0]["tool_name"].alias("tool"), b[0]["tool_input"].alias("input"), b[1]["text"].alias("text"))


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def _stream(spark: SparkSession, d: str, name: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """Messages as a stream, first sights kept, written and read again."""
    s = _stream(spark, d, "conversations", CONVERSATIONS)
    when = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(turn as int))")
    rows = s.select(F.concat(F.lit("g"), (F.col("conv_id") % 4).cast("string")).alias("group_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), "role", "text", when.alias("event_time"))
    out = new_folder(spark, "ingested")
    ingest.sink(ingest.ingest_messages(rows, "30 days"), out, new_folder(spark, "ingest-state")).awaitTermination()
    done = spark.read.schema("group_id string, session_id string, role string, text string, hash string").parquet(out)
    return done.groupBy("group_id", "session_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def payload_monitor_stream(spark: SparkSession, d: str) -> DataFrame:
    """All windows of token counts per user; a last far record moves the watermark past all of them."""
    rows = fx.token_counts(spark, d).drop("event_id")
    out, state = new_folder(spark, "monitor"), new_folder(spark, "monitor-state")
    keyed.feed([rows, keyed.far_record(spark)], new_folder(spark, "counts"), lambda s: ingest.sink(ingest.payload_monitor(s, 800, "1 day"), out, state))
    done = spark.read.schema("window_start timestamp, session_id string, turns long, max_outbound long, max_original long, turns_over long, alert boolean").parquet(out)
    return done.withColumn("window_start", F.date_format("window_start", STAMP))


LINES = """l as (select *, conv_id * 31 + turn as n from conversations), kept as (select 'c' || conv_id as session_id, role, n, text, case when role = 'assistant' then text when turn % 7 = 3 then '<command-name>' || text else text end as t from l
  where role in ('user', 'assistant') and n % 11 <> 0 and n % 13 <> 0 and n % 17 <> 0)"""
TOK = "case when length({0}) = 0 then 0 else greatest(1, length({0}) // 4) end::bigint"
ORACLE = {
    "transcript_parse": f"""with {LINES}, s as (select *, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as u from kept) select session_id, role, 'chat:' || role as source, length(u)::bigint as n_chars, md5(u) as digest, case when n % 5 = 0 then '2024-01-01 00:00:00' else '2024-03-01 10:00:00' end as event_time from s where length(u) >= 16 and not starts_with(u, '<command-name>')""",
    "tool_events": """with o as (select *, o_orderkey % 7 as f, 'result of the order ' || o_orderkey || ' is ' || o_orderstatus || case when o_orderkey % 3 = 0 then chr(10) || '[stderr]' || chr(10) || 'warned' else '' end as body from orders where o_orderkey % 7 not in (4, 5) and o_orderkey % 10 <> 0)
select 's' || o_custkey as session_id, case f when 0 then 'file:/p/' || o_orderkey when 1 then 'bash:' || sha256('ls ' || o_orderkey)[:8] when 2 then 'search:Grep' when 3 then 'web:http://u/x' else 'tool:Other' end as source,
case f when 0 then '# Read /p/' || o_orderkey when 1 then '# Bash list' || chr(10) || '$ ls ' || o_orderkey when 2 then '# Grep ' || o_orderpriority when 3 then '# WebFetch http://u/x' else '# Other' end || chr(10) || chr(10) || body as text from o where length(body) >= 24""",
    "normalized_requests": f"select conv_id::varchar as request_id, (row_number() over (partition by conv_id order by turn) - 1)::bigint as msg_idx, role, 1::bigint as n_blocks, text, {TOK.format('text')} as tokens from conversations where role <> 'system'",
    "request_roundtrip": "select conv_id::varchar as request_id, count(*) as n_messages, sum(length(text))::bigint as n_chars, 'be kind' as system from conversations where role <> 'system' group by conv_id",
    "request_roundtrip_mixed": f"""with {fx.MESSAGES}, m as (select *, row_number() over (partition by conv_id order by msg_idx) - 1 as k from messages), n as (select unnest(['one', 'two']) as way)
select conv_id::varchar as request_id, way, k::bigint as msg_idx, role, case when role <> 'user' then case way when 'one' then 'a ' || chr(10) || text else 'a ' || text end || chr(10) || '[tool_use f({{"n":1}})]'
  when pure_tool_result then '[tool_result: ' || text || ']' || chr(10) || case way when 'one' then '[tool_result (error): b]' else '[tool_result: b]' end
  else text || chr(10) || '[image: image/png]' || chr(10) || '[image: url]' || chr(10) || case way when 'one' then '[tool_result: res]' else 'res' end end as text from m, n""",
    "graph_task_parse": f"""with {fx.EDGES}, t as (select cast(substr(src, 2) as int) // 50 as task_id, count(*) as n_edges, count(distinct src) as n_src, min(src) as start from edges group by 1) select task_id, case when task_id % 2 = 0 then 'bfs' else 'parents' end as op, start, case when task_id % 2 = 0 then 2 end as depth, null::varchar as error, n_edges, n_src from t""",
    "graph_messages": f"""with {fx.EDGES}, p as (select gid, src, case when count(*) = 1 then src || ' -> ' || any_value(dst) else src || ' -> [' || string_agg(dst, ', ' order by dst) || ']' end as text, row_number() over (partition by gid order by src) - 1 as k from edges group by gid, src)
select gid, 2 * k as msg_idx, 'user' as role, text from p union all select gid, 2 * k + 1, 'assistant', 'Noted.' from p union all select gid, 2 * max(k) + 2, 'user', 'Which nodes are reachable?' from p group by gid""",
    "transcript_text": f"with {fx.MESSAGES} select conv_id, '=== TRANSCRIPT START ===' || chr(10) || string_agg('[' || upper(role) || ']' || chr(10) || text, chr(10) || chr(10) order by msg_idx) || chr(10) || '=== TRANSCRIPT END ===' as transcript from messages group by conv_id",
    "reassemble_chunks": f"with {fx.MESSAGES} select conv_id || '/' || msg_idx as response_id, 2::bigint as n_blocks, 'look' as tool, '{{\"a\":1}}' as input, text from messages where role = 'assistant'",
    "ingest_stream": "with f as (select distinct 'g' || (conv_id % 4) as group_id, 'c' || conv_id as session_id, role, text from conversations where length(text) >= 20) select group_id, session_id, count(*) as n, sum(length(text))::bigint as n_chars from f group by all",
    "payload_monitor_stream": """with r as (select 's' || user_id as session_id, ts, date_trunc('day', ts) as w, floor(value * 100)::bigint as o, least(floor(value * 100), 900)::bigint as u from events)
select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, session_id, count(*) as turns, max(u) as max_outbound, max(o) as max_original, count(*) filter (u > 800) as turns_over, count(*) filter (u > 800) > 0 as alert from r group by w, session_id""",
}
QUERIES = {f.__name__: f for f in (transcript_parse, tool_events, normalized_requests, request_roundtrip, request_roundtrip_mixed, graph_task_parse, graph_messages, transcript_text, reassemble_chunks, ingest_stream, payload_monitor_stream)}
