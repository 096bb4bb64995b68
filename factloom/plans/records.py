"""Registered queries over benchmark rows, responses, memory text, samples, checks and streams, with their SQL.

The shipped tables hold no such rows, so each query derives them from a table; the SQL states what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.storage import new_folder
from factloom.operators import context, evaluation as ev, graph, inference, quality, temporal, vectors
from factloom.plans import fixtures as fx
from factloom.plans import memory as mem
from factloom.plans.evaluation import RUNS, runs
from factloom.schemas import BLOCK
from factloom.sources import requests as rq
from factloom.sources import tasks, transcripts
from factloom.streaming import chunks, ingest, keyed

A = fx.ANCHOR
STAMP = "yyyy-MM-dd HH:mm:ss"


def _text(c: str):
    return F.col(c).cast("string")


def _joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


# ---- benchmark rows


def needle_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A prompt of messages per conversation whose last asks for the n-th answer, in three wordings."""
    m = fx.messages(spark, d)
    said = F.sort_array(F.collect_list(F.struct("msg_idx", F.struct("role", F.col("text").alias("content")).alias("m"))))
    per = m.groupBy("conv_id").agg(F.transform(said, lambda x: x["m"]).alias("ms"))
    place = F.when(F.col("conv_id") % 3 == 0, "2nd").when(F.col("conv_id") % 3 == 1, "third").otherwise("10th")
    ask = F.concat(F.lit("Prepend tok"), _text("conv_id"), F.lit(" to the "), place, F.lit(" (1 indexed) poem about c"), _text("conv_id"), F.lit(". Do not include any other text."))
    prompt = F.to_json(F.concat("ms", F.array(F.struct(F.lit("user").alias("role"), ask.alias("content")))))
    rows = per.select(_text("conv_id").alias("task_id"), prompt.alias("prompt"), F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("own"), _text("conv_id"))).alias("random_string_to_prepend"), F.col("conv_id").alias("desired_msg_index"))
    lookups, messages = tasks.parse_needle_tasks(rows)
    n = messages.groupBy("task_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"))
    return lookups.join(n, "task_id").select("task_id", "token", F.col("position").cast("long").alias("position"), "request", "desired_msg_index", "error", "n_messages", "n_chars")


def _multikey(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as lines between an intro and a question, with template marks."""
    line = F.concat(F.lit("order "), _text("o_orderkey"), F.lit(" is "), "o_orderstatus")
    per = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    mark = lambda role: f"<|start_header_id|>{role}<|end_header_id|>"
    text = F.concat(F.lit(f"<|begin_of_text|>{mark('system')}\n\nbe kind<|eot_id|>{mark('user')}\n\nSome orders follow.\n"), "body", F.lit("\nWhich are open?\nName them.<|eot_id|>"), F.lit(f"{mark('assistant')}\n\n"))
    return per.select(F.col("o_custkey").alias("task_id"), text.alias("input"))


def multikey_tasks(spark: SparkSession, d: str) -> DataFrame:
    t, lines = tasks.parse_multikey_tasks(_multikey(spark, d))
    return t.hint("merge").join(lines.groupBy("task_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars")), "task_id")


def chunk_messages(spark: SparkSession, d: str) -> DataFrame:
    t, lines = tasks.parse_multikey_tasks(_multikey(spark, d))
    return tasks.chunk_to_messages(lines, t, 3).withColumn("msg_idx", F.col("msg_idx").cast("long"))


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    a, b = F.concat(F.lit("order "), _text("o_orderkey"), F.lit(" was paid")), F.concat(F.lit("order "), _text("o_orderkey"), F.lit(" was never paid"))
    k = F.col("o_orderkey") % 5
    says = (
        F.when(k == 0, F.concat(F.lit("I notice you've mentioned contradictory information about this. You said "), a, F.lit(", but you also mentioned "), b, F.lit(". Could you clarify which is right?")))
        .when(k == 1, F.concat(F.lit("There is contradictory information. You mentioned "), a, F.lit(", however you also said "), b, F.lit(".")))
        .when(k == 2, F.concat(a, F.lit(", but you also said "), b))
        .when(k == 3, F.concat(F.lit("On one hand, you said "), a, F.lit(". On the other hand, "), b, F.lit(".")))
        .otherwise(F.concat(F.lit("Nothing odd about "), _text("o_orderkey")))
    )
    return tasks.parse_contradictions(o.select(F.col("o_orderkey").alias("id"), says.alias("ideal_answer"))).drop("ideal_answer")


def final_answers(spark: SparkSession, d: str) -> DataFrame:
    """What responses about the successors of each node name, and whether that is the set asked for."""
    e = fx.edges(spark, d).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("gold"))
    n = F.expr("cast(substr(src, 2) as int)")
    listed = F.when(n % 3 == 0, F.array_join(F.reverse("gold"), " , ")).when(n % 3 == 1, F.concat(F.array_join("gold", ","), F.lit(", "), F.element_at("gold", 1))).otherwise("'none'")
    said = F.when(n % 7 == 0, "no answer").otherwise(F.concat(F.lit("Final Answer: [draft]\nfinal answer:  ["), listed, F.lit("]")))
    r = e.select("src", "gold", tasks.final_answer(said).alias("pred"))
    return r.select("src", F.array_join(F.sort_array("pred"), ",").alias("pred"), ev.exact_match(F.col("pred"), F.col("gold")).alias("exact"))


def graph_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Walks of one and two steps and parents, for every node whose number is divisible by 20."""
    e = fx.edges(spark, d)
    n = F.expr("cast(substr(start, 2) as int)")
    t = e.select("gid", F.col("src").alias("start")).distinct().filter(n % 20 == 0)
    t = t.select(F.col("start").alias("task_id"), "gid", "start", F.when(n % 3 == 0, "parents").otherwise("bfs").alias("op"), F.when(n % 3 > 0, n % 3).cast("int").alias("depth"))
    return graph.run_graph_tasks(t, e).select("task_id", F.array_join("pred", ",").alias("pred"))


def _mode():
    return F.concat(F.lit("Mode"), (F.col("l_suppkey") % 7).cast("string"))


def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Keys found, made up and cut answers, over responses built from line items."""
    r = fx.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), _mode().alias("mode"), "l_returnflag", "l_linestatus", F.col("l_partkey").alias("k"))
    gold = F.concat(F.lit("tok "), F.lit("the answer goes by "), "mode", F.lit(" and is "), F.repeat(_text("k"), 12))
    said = F.when(F.col("k") % 3 == 0, gold).when(F.col("k") % 3 == 1, F.left(gold, F.lit(30))).otherwise("tok something else was said here")
    f = ev.answers_found(F.lower(said), F.array("mode", F.concat(F.lit("by "), "mode"), _text("k")))
    lenient = F.when(F.col("k") % 2 == 0, 0.5).otherwise(0.01)
    return r.select("row_idx", f["n_found"].alias("n_found"), f["any_found"].alias("any_found"), f["all_found"].alias("all_found"), ev.hallucinated(said, gold, F.lit("tok ")).alias("made_up"), ev.truncated(said, gold, lenient).alias("cut"), ev.op_match([F.col("l_returnflag")], [F.col("l_linestatus")]).alias("same_op"), ev.contradiction_hit(F.when(F.col("k") % 5 == 0, "unresolved").otherwise("e1_correct")).alias("hit"))


# ---- responses


def delta_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each answer as deltas of the second dialect, with a tool call and a blank after it, put together again."""
    m = fx.messages(spark, d).filter("role = 'assistant' and length(text) > 0")
    rid = F.concat_ws("/", _text("conv_id"), _text("msg_idx"))
    piece = F.explode(F.expr("transform(sequence(1, length(text), 50), i -> named_struct('i', i, 't', substring(text, i, 50)))")).alias("p")
    wrap = lambda delta, reason="null": F.concat(F.lit('{"choices":[{"delta":'), delta, F.lit(f',"finish_reason":{reason}}}]}}'))
    said = m.select(rid.alias("response_id"), piece).select("response_id", F.col("p.i").cast("long").alias("seq"), wrap(F.to_json(F.struct(F.col("p.t").alias("content")))).alias("value"))
    at = 10**9
    call = [
        (at, wrap(F.lit('{"tool_calls":[{"index":0,"id":"c1","function":{"name":"find","arguments":""}}]}'))),
        (at + 1, wrap(F.lit('{"content":" \\n"}'))),
        (at + 2, wrap(F.concat(F.lit('{"tool_calls":[{"index":0,"function":{"arguments":"{\\"n\\":'), _text("msg_idx"), F.when(F.col("msg_idx") % 4 == 3, "").otherwise("}"), F.lit('"}}]}')))),
        (at + 3, wrap(F.lit("{}"), '"tool_calls"')),
    ]
    for seq, value in call:
        said = said.unionByName(m.select(rid.alias("response_id"), F.lit(seq).cast("long").alias("seq"), value.alias("value")))
    made = chunks.normalize_deltas(said)
    per = made.filter("type not like '%delta' or type = 'message_delta'").groupBy("response_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "block_index", "type"))), lambda x: F.concat_ws(":", x["type"], x["block_index"])), " ").alias("events"))
    r = chunks.reassemble(made).join(per, "response_id")
    b = F.col("blocks")
    return r.select("response_id", "events", F.size("blocks").cast("long").alias("n_blocks"), b[0]["text"].alias("text"), b[1]["tool_name"].alias("tool"), b[1]["tool_input"].alias("input"), "stop_reason", chunks.stop_reason_out(F.col("stop_reason")).alias("reason_out"))


def recovered_calls(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    think = F.concat(F.lit("hm <tool_call>\n<function=look><parameter=key>"), _text("o_orderkey"), F.lit("</parameter><parameter=status>\n"), "o_orderstatus", F.lit("\n</parameter><parameter=ok>True</parameter></function></tool_call></think> later"))
    k = F.col("o_orderkey") % 4
    rows = o.select(F.col("o_orderkey").alias("response_id"), F.when(k == 0, "said").otherwise("").alias("text"), F.when(k == 3, F.concat(F.lit("let me see</think> it is "), "o_orderstatus")).otherwise(think).alias("reasoning"), (k == 2).alias("has_tool_call"))
    r = chunks.recover_tool_calls(rows)
    first = F.try_element_at("calls", F.lit(1))
    return r.select("response_id", "text", F.size("calls").cast("long").alias("n_calls"), first["name"].alias("name"), first["input"].alias("input"))


def reassemble_stream(spark: SparkSession, d: str) -> DataFrame:
    """Answers as chunks with times: most end, the others come out incomplete once a late chunk has moved the watermark."""
    m = fx.messages(spark, d).filter("role = 'assistant'")
    rid, none = F.concat_ws("/", _text("conv_id"), _text("msg_idx")), F.lit(None).cast("string")
    when = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id as int))")
    row = lambda seq, kind, index, block, text: m.select(rid.alias("response_id"), F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("type"), F.lit(index).cast("int").alias("block_index"), F.lit(block).cast("string").alias("block_type"), text.alias("text"), none.alias("partial_json"), none.alias("tool_use_id"), none.alias("tool_name"), none.alias("stop_reason"), when.alias("event_time"), "conv_id", "msg_idx")
    half = F.floor(F.length("text") / 2).cast("int")
    parts = row(0, "block_start", 0, "text", none).unionByName(row(1, "text_delta", 0, "text", F.left("text", half))).unionByName(row(2, "text_delta", 0, "text", F.expr("substring(text, cast(length(text) div 2 as int) + 1)")))
    parts = parts.unionByName(row(3, "message_stop", None, None, none).filter("(conv_id + msg_idx) % 5 <> 0")).drop("conv_id", "msg_idx")
    far = parts.select(F.max("event_time").alias("t")).select(F.lit("far").alias("response_id"), F.lit(0).cast("long").alias("seq"), F.lit("ping").alias("type"), F.lit(None).cast("int").alias("block_index"), *[none.alias(c) for c in ("block_type", "text", "partial_json", "tool_use_id", "tool_name", "stop_reason")], (F.col("t") + F.expr("interval 5 days")).alias("event_time"))
    path = new_folder(spark, "chunks")
    parts.unionByName(far).write.parquet(path)
    out = new_folder(spark, "responses")
    s = chunks.reassemble_stream(spark.readStream.schema(parts.schema).parquet(path), timeout="1 hour")
    keyed.run_to(s, out, new_folder(spark, "responses-state")).awaitTermination()
    return spark.read.schema(chunks.MESSAGES).parquet(out).select("response_id", F.col("blocks")[0]["text"].alias("text"), "complete")


# ---- logged requests


def tool_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the second shape with calls, runs of tool messages, images and odd parts, as blocks and as text."""
    c = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    k = _text("conv_id")
    body = F.concat(
        F.lit('{"model":"gpt-5","stream":true,"messages":[{"role":"system","content":"be kind"},{"role":"developer","content":"and brief"},{"role":"user","content":[{"type":"text","text":"see '), k,
        F.lit('"},{"type":"image_url","image_url":{"url":"data:image/png;base64,QUJD"}},{"type":"odd","x":1}]},{"role":"assistant","content":"","tool_calls":[{"id":"a","function":{"name":"f","arguments":"{\\"n\\":'), k,
        F.lit('}"}},{"id":"b","function":{"name":"g","arguments":"{bad"}}]},{"role":"tool","tool_call_id":"a","content":"one '), k,
        F.lit('"},{"role":"tool","tool_call_id":"b","content":"two"},{"role":"other","content":"x"},{"role":"assistant","content":"done '), k, F.lit('"}]}'),
    )
    heads, m = rq.normalize_two(c.select(k.alias("request_id"), body.alias("body")))
    rows = m.select("request_id", F.col("msg_idx").cast("long").alias("msg_idx"), "role", F.size("blocks").cast("long").alias("n_blocks"), rq.message_text(F.col("blocks")).alias("text"), rq.is_pure_tool_result(F.col("role"), F.col("blocks")).alias("pure"), rq.has_open_tool_use(F.col("role"), F.col("blocks")).alias("calls"))
    return rows.hint("merge").join(heads.select("request_id", "system", "stream"), "request_id")


def model_limits(spark: SparkSession, d: str) -> DataFrame:
    """Input limits and providers of models named in a log, one row per order."""
    names = ("claude-opus-4-6-2026", "claude-opus-4-1", "Claude-Sonnet-4-5", "gpt-4o-mini", "gpt-5-x", "o3-pro", "o4-mini", "own-model")
    m = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % len(names) + 1).cast("int"))
    r = fx.table(spark, d, "orders").select("o_orderkey", m.alias("model"))
    cwd = F.concat(F.lit("/home/u/My Project "), _text("o_orderkey"), F.lit("/"))
    return r.select("o_orderkey", "model", rq.context_limit(F.col("model")).cast("long").alias("context"), rq.provider(F.col("model")).alias("provider"), rq.scope_of_project(cwd).alias("scope"), rq.scope_of_key(_text("o_orderkey")).alias("key_scope"))


def header_fields(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, _text("o_custkey")).when(k % 4 == 1, F.concat(F.lit(" "), _text("o_custkey"), F.lit(" "))).when(k % 4 == 2, "many")
    h = F.map_filter(F.create_map(F.lit("tokens"), value, F.lit("done"), F.when(k % 3 == 0, "True").when(k % 3 == 1, "no")), lambda _, v: v.isNotNull())
    return o.select("o_orderkey", rq.header_int(h, "tokens", -1).alias("tokens"), rq.header_bool(h, "done").alias("done"))


def transcript_backfill(spark: SparkSession, d: str) -> DataFrame:
    """The last three rows of sessions without a cursor, all of the others."""
    e = fx.episodes(spark, d).select("session_id", F.col("episode_id"), "text", "event_time")
    known = e.filter("cast(substr(session_id, 2) as int) % 4 = 0").select("session_id")
    return transcripts.backfill(e, known, 3).select("session_id", "episode_id")


# ---- memory text


def fact_lists(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each subject as a list, newest first, some with a part missing."""
    f = temporal.as_of(fx.facts(spark, d), A).withColumn("rank", -F.unix_micros("valid_at")).withColumn("tier", F.when(F.col("fact_id") % 5 > 0, F.col("tier")))
    f = f.withColumn("object", F.when(F.col("fact_id") % 6 > 0, F.col("object")))
    return context.fact_lines(f, ["group_id", "subject"])


def recall_text(spark: SparkSession, d: str) -> DataFrame:
    """Two sections for each session: its facts' texts and its episodes within a budget."""
    e = fx.episodes(spark, d).withColumn("rank", F.col("episode_id"))
    s = context.episode_snippets(e, ["session_id"], 120, most=200)
    f = fx.episodes(spark, d).filter("episode_id % 300 < 100").groupBy("session_id").agg(F.lit("- some fact").alias("facts_text"))
    return s.join(f, "session_id", "full").select("session_id", context.recall_context(F.col("facts_text"), F.col("episodes_text")).alias("recalled"))


def answer_blocks(spark: SparkSession, d: str) -> DataFrame:
    f = temporal.as_of(fx.facts(spark, d), A).select(F.expr("cast(substr(subject, 2) as long)").alias("query_id"), "subject", "predicate", "object", "confidence", "pinned", "tier", F.col("fact_id").alias("rank"))
    return context.answer_block(f.filter("tier = 'T1'"), f.filter("tier = 'T2'"), 3, 2, 12)


def session_primers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    s = fx.table(spark, d, "orders").select(_text("o_orderkey").alias("session_id"), F.concat(F.lit("/srv/app"), _text("o_custkey"), F.lit("/")).alias("cwd"), F.when(k == 0, "compact").when(k == 1, "resume").when(k == 2, "startup").otherwise("clear").alias("kind"))
    return context.session_primer(s).select("session_id", "query", F.col("k").cast("long").alias("k"), F.col("budget").cast("long").alias("budget"))


def _said(asked: DataFrame) -> DataFrame:
    """Verdicts of all kinds, and two broken ones."""
    k = F.col("query_id") / 20 % 6
    good = lambda r: F.lit(f'{{"resolution": "{r}", "reason": "so", "confidence": 0.5}}')
    say = F.when(k == 0, good("e1_correct")).when(k == 1, good("e2_correct")).when(k == 2, good("both_partial")).when(k == 3, good("unresolved")).when(k == 4, '{"resolution": "e1_correct", "confidence": 7}').otherwise("{broken")
    return asked.select("query_id", say.alias("response"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    asked = mem.verdict_requests(spark, d)
    return inference.apply_verdicts(asked, _said(asked))


def verdict_answers(spark: SparkSession, d: str) -> DataFrame:
    f = fx.facts(spark, d)
    return inference.infer(fx.queries(spark, d), f, f, fx.episodes(spark, d), A, "conflict_set", judge=_said, shared=fx.vectors(spark, d))


# ---- samples, stitching, gates


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return ev.quota_sample(runs(spark, d).groupBy("row_idx").agg(F.min("bucket").alias("bucket")), 9, 42)


def diverse_pick(spark: SparkSession, d: str) -> DataFrame:
    return ev.diverse_pick(fx.table(spark, d, "documents").select("doc_id", "source"), 25, "source", "doc_id")


def stitched(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in fours: the first is the base, the others come before its last message."""
    m = fx.messages(spark, d).select(F.expr("conv_id div 4").alias("stitch_id"), (F.col("conv_id") % 4).cast("int").alias("part"), F.col("msg_idx").alias("idx"), "role", "text")
    s = ev.stitch_conversations(m.filter("part = 0").drop("part"), m.filter("part > 0"))
    return s.select("stitch_id", "part", "idx", F.col("msg_idx").cast("long").alias("msg_idx"), "total_messages", "n_chars")


def stitched_contexts(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "documents").select(F.expr("doc_id div 5").alias("stitch_id"), (F.col("doc_id") % 5).alias("part"), F.coalesce("text", F.lit("")).alias("context"))
    base = e.filter("part = 0").select("stitch_id", F.lit("Read this.").alias("intro"), "context", F.lit("What is it?").alias("question"))
    return ev.stitch_contexts(base, e.filter("part > 0"))


def judge_gate(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).select(F.when(F.col("hit"), "e1_correct").otherwise("unresolved").alias("predicted"), F.lit("e1_correct").alias("gold"), F.col("op_match").alias("valid"), "latency_ms")
    return ev.judge_eval(r)


def extract_gate(spark: SparkSession, d: str) -> DataFrame:
    """Triples of each line item, right but for case and blanks, wrong, or missing."""
    t = lambda s, o: F.struct(s.alias("s"), F.lit("ships").alias("p"), o.alias("o"))
    r = fx.table(spark, d, "lineitem")
    a, b = t(_text("l_orderkey"), _mode()), t(_text("l_partkey"), F.col("l_linestatus"))
    k = F.col("l_partkey") % 4
    loose = t(F.concat(F.lit(" "), _text("l_orderkey")), F.lower(_mode()))
    none = F.array().cast("array<struct<s:string,p:string,o:string>>")
    pred = F.when(k == 0, F.array(loose, b)).when(k == 1, F.array(a)).when(k == 2, none).otherwise(F.array(t(F.lit("x"), F.lit("y"))))
    return ev.extract_eval(r.select(pred.alias("pred"), F.array(a, b).alias("gold"), F.col("l_extendedprice").alias("latency_ms")))


def runs_left(spark: SparkSession, d: str) -> DataFrame:
    """What of a dataset an append-only log of runs, read back, has not seen."""
    r = runs(spark, d).select("row_idx", "arm", "bucket")
    path = new_folder(spark, "runs")
    tasks.write_runs(r.filter("row_idx % 3 = 0"), path)
    tasks.write_runs(r.filter("row_idx % 3 = 1 and bucket = 'S'"), path)
    return ev.resume(r.select("row_idx", "bucket"), tasks.read_records(spark, path, "row_idx long, arm string, bucket string").select("row_idx"), "row_idx")


# ---- checks


def _spoilt(spark: SparkSession, d: str) -> DataFrame:
    """Facts with broken tiers, confidences, intervals and repeated ids."""
    k = F.col("fact_id")
    f = fx.facts(spark, d).withColumn("tier", F.when(k % 50 == 0, "T9").otherwise(F.col("tier"))).withColumn("confidence", F.when(k % 70 == 0, 0.1).otherwise(F.col("confidence"))).withColumn("invalid_at", F.when(k % 90 == 0, F.col("valid_at")).otherwise(F.col("invalid_at")))
    return f.unionByName(f.filter(k % 40 == 0))


def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    v = fx.vectors(spark, d).withColumn("embedding", F.when(F.col("vec_id") % 30 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")))
    names = temporal.entities(fx.facts(spark, d))
    return quality.violations(_spoilt(spark, d), fx.episodes(spark, d), v, 64, names.unionByName(names.filter("group_id = 'g2' and name like 'k%'")))


def verdict_checks(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 12).alias("n_conflicts"), F.when(F.col("o_orderkey") % 9 == 0, "maybe").otherwise("unresolved").alias("resolution"))
    o = o.withColumns({"mode": F.when(F.col("query_id") % 13 == 0, "fast").otherwise("consistent"), "confidence": F.when(F.col("query_id") % 17 == 0, 1.5).when(F.col("query_id") % 19 == 0, F.lit(None)).otherwise(0.5)})
    bad = quality.bad_resolutions(o).select("query_id", F.lit("unknown resolution").alias("why"))
    bad = bad.unionByName(quality.bad_modes(o).select("query_id", F.lit("unknown mode").alias("why"))).unionByName(quality.bad_confidences(o).select("query_id", F.lit("confidence out of range").alias("why")))
    return quality.verdict_budget(o).unionByName(bad).groupBy("why").agg(F.count("*").alias("n"), F.sum("query_id").alias("ids"))


def block_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans told apart by role and blocks: the order of a tool input's entries says nothing, its values do."""
    m = fx.messages(spark, d)
    names = [f.name for f in T.StructType.fromDDL(f"b {BLOCK}")["b"].dataType.fields]
    part = F.expr("msg_idx % 3")
    own = {"type": F.lit("tool_use"), "tool_use_id": F.lit("t"), "tool_name": F.lit("look"), "tool_input": F.when(part == 0, '{"a":1,"b":"x"}').when(part == 1, '{"b":"x","a":1}').otherwise('{"a":2,"b":"x"}')}
    said = {"type": F.lit("text"), "text": F.col("role")}
    block = lambda own: F.struct(*[(own[n] if n in own else F.lit(None)).cast("boolean" if n == "is_error" else "string").alias(n) for n in names])
    h = m.select("conv_id", "role", quality.block_hash(F.lit("user"), F.array(block(said), block(own))).alias("hash"))
    return h.groupBy("role").agg(F.count_distinct("hash").alias("n_spans"), F.count("*").alias("n"))


def split_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Tool uses and results of conversations of which some turns are gone."""
    m = fx.messages(spark, d).filter("(conv_id + msg_idx) % 5 <> 0")
    ident = F.concat(F.lit("t"), F.expr("cast(msg_idx div 2 as string)"))
    k = m.select("conv_id", F.when(F.col("role") == "assistant", ident).alias("use_id"), F.when(F.col("role") == "user", ident).alias("result_id"))
    return quality.split_tool_pairs(k)


def payload_split(spark: SparkSession, d: str) -> DataFrame:
    small, large = inference.large_payload_split(fx.table(spark, d, "documents").select("doc_id", "text"), 2000)
    return small.select("doc_id", F.lit(False).alias("large")).unionByName(large.select("doc_id", F.lit(True).alias("large")))


def bulk_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts stored by tenant with defaults for what they lack, read back."""
    f = fx.facts(spark, d).select("group_id", "fact_id", "subject", "predicate", "object", "valid_at", F.when(F.col("fact_id") % 2 == 0, F.col("confidence")).alias("confidence"))
    path = new_folder(spark, "bulk")
    temporal.bulk_load_facts(f, path)
    done = spark.read.schema("fact_id long, subject string, confidence double, tier string, invalid_at timestamp, pinned boolean, group_id string").parquet(path)
    return done.groupBy("group_id", "tier", "pinned").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"), F.count("invalid_at").alias("ended"))


# ---- streams


def late_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages more than five minutes behind what their session has seen."""
    e = fx.episodes(spark, d)
    seen = e.groupBy("session_id").agg(F.max("event_time").alias("max_time"))
    return ingest.late_rows(e, seen, "5 minutes").select("session_id", "episode_id")


LINE_ITEMS = """r as (select l_orderkey * 10 + l_linenumber as row_idx, 'Mode' || (l_suppkey % 7) as mode, l_returnflag, l_linestatus, l_partkey as k, 'tok the answer goes by Mode' || (l_suppkey % 7) || ' and is ' || repeat(l_partkey::varchar, 12) as gold from lineitem),
s as (select *, case k % 3 when 0 then gold when 1 then gold[:30] else 'tok something else was said here' end as said from r)"""
MULTI = """l as (select o_custkey as task_id, 'order ' || o_orderkey || ' is ' || o_orderstatus as line, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k from orders)"""
LIVE = f"{fx.FACTS}, live as (select * from facts where {mem.ASOF})"
EP19 = "strftime(event_time, '%Y-%m-%dT%H:%M:%S')"
ORACLE = {
    "needle_tasks": f"""with {fx.MESSAGES} select conv_id::varchar as task_id, case when conv_id % 4 = 0 then 'own' || conv_id else 'tok' || conv_id end as token, case conv_id % 3 when 0 then 2 when 1 then 3 else 10 end::bigint as position, 'poem about c' || conv_id as request,
conv_id as desired_msg_index, null::varchar as error, count(*) as n_messages, sum(length(text))::bigint as n_chars from messages group by conv_id""",
    "multikey_tasks": f"with {MULTI} select task_id, 'Some orders follow.' as intro, 'Which are open?' || chr(10) || 'Name them.' as question, count(*) as n_lines, sum(length(line))::bigint as n_chars from l group by task_id",
    "chunk_messages": f"""with {MULTI}, c as (select task_id, k // 3 as c, string_agg(line, chr(10) order by k) as text from l group by all)
select task_id, 2 * c as msg_idx, 'user' as role, text from c union all select task_id, 2 * c + 1, 'assistant', 'Noted.' from c union all select task_id, 2 * max(c) + 2, 'user', 'Which are open?' || chr(10) || 'Name them.' from c group by task_id""",
    "contradictions": "select o_orderkey as id, case when o_orderkey % 5 < 4 then 'order ' || o_orderkey || ' was paid' end as statement_a, case when o_orderkey % 5 < 4 then 'order ' || o_orderkey || ' was never paid' end as statement_b from orders",
    "final_answers": f"""with {fx.EDGES}, g as (select src, cast(substr(src, 2) as int) as n, string_agg(dst, ',' order by dst) as gold from edges group by src)
select src, case when n % 7 = 0 then '' when n % 3 = 2 then '''none''' else gold end as pred, n % 7 <> 0 and n % 3 <> 2 as exact from g""",
    "graph_tasks": f"""with {fx.EDGES}, t as (select distinct src as start, cast(substr(src, 2) as int) as n from edges where cast(substr(src, 2) as int) % 20 = 0),
d1 as (select distinct start, n, dst as node from t join edges on src = start where dst <> start), d2 as (select distinct start, dst as node from d1 join edges on src = node where n % 3 = 2 and dst <> start),
p as (select start as task_id, node from d1 where n % 3 = 1 union select start, node from d2 where (start, node) not in (select (start, node) from d1) union select start, src from t join edges on dst = start where n % 3 = 0 and src <> start)
select start as task_id, coalesce(string_agg(node, ',' order by node), '') as pred from t left join p on task_id = start group by start""",
    "answer_checks": f"""with {LINE_ITEMS}, f as (select *, contains(lower(said), lower(mode))::int + contains(lower(said), lower('by ' || mode))::int + contains(lower(said), k::varchar)::int as n from s)
select row_idx, n::bigint as n_found, n > 0 as any_found, n = 3 as all_found, length(said) >= 20 and contains(said, 'tok ') and not contains(said, gold[5:84]) as made_up, length(said) < 0.8::double * length(gold) and k % 2 = 0 as cut, l_returnflag = l_linestatus as same_op, k % 5 = 0 as hit from f""",
    "delta_chunks": f"""with {fx.MESSAGES} select conv_id || '/' || msg_idx as response_id, 'message_start block_start:0 block_start:1 block_stop:0 block_stop:1 message_delta message_stop' as events, 2::bigint as n_blocks, text, 'find' as tool, case when msg_idx % 4 = 3 then '{{"_partial_json":"{{\\"n\\":' || msg_idx || '"}}' else '{{"n":' || msg_idx || '}}' end as input, 'tool_use' as stop_reason, 'tool_calls' as reason_out
from messages where role = 'assistant' and length(text) > 0""",
    "recovered_calls": """with o as (select *, o_orderkey % 4 as k from orders) select o_orderkey as response_id, case k when 0 then 'said' when 3 then 'it is ' || o_orderstatus else '' end as text, case when k < 2 then 1 else 0 end::bigint as n_calls, case when k < 2 then 'look' end as name,
case when k < 2 then '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","ok":true}' end as input from o""",
    "reassemble_stream": f"with {fx.MESSAGES} select conv_id || '/' || msg_idx as response_id, text, (conv_id + msg_idx) % 5 <> 0 as complete from messages where role = 'assistant'",
    "tool_requests": """with c as (select distinct conv_id from conversations), m as (
  select conv_id, 0::bigint as msg_idx, 'user' as role, 3::bigint as n_blocks, 'see ' || conv_id || chr(10) || '[image: image/png]' || chr(10) || '[odd]' as text, false as pure, false as calls from c
  union all select conv_id, 1, 'assistant', 2, '[tool_use f({"n":' || conv_id || '})]' || chr(10) || '[tool_use g({"_partial_json":"{bad"})]', false, true from c
  union all select conv_id, 2, 'user', 2, '[tool_result: one ' || conv_id || ']' || chr(10) || '[tool_result: two]', true, false from c
  union all select conv_id, 3, 'assistant', 1, 'done ' || conv_id, false, false from c)
select conv_id::varchar as request_id, msg_idx, role, n_blocks, text, pure, calls, 'be kind' || chr(10) || chr(10) || 'and brief' as system, true as stream from m""",
    "model_limits": """with o as (select o_orderkey, o_orderkey % 8 as k from orders) select o_orderkey, ['claude-opus-4-6-2026', 'claude-opus-4-1', 'Claude-Sonnet-4-5', 'gpt-4o-mini', 'gpt-5-x', 'o3-pro', 'o4-mini', 'own-model'][k + 1] as model, case when k in (1, 3, 7) then 128000 else 200000 end::bigint as context,
case when k between 3 and 6 then 'openai' else 'anthropic' end as provider, 'my-project-' || o_orderkey || '-' || sha256('/home/u/My Project ' || o_orderkey || '/')[:8] as scope, 'k:' || sha256(o_orderkey::varchar)[:24] as key_scope from o""",
    "header_fields": "select o_orderkey, case when o_orderkey % 4 < 2 then o_custkey else -1 end::bigint as tokens, o_orderkey % 3 = 0 as done from orders",
    "transcript_backfill": f"with {fx.EPISODES}, r as (select *, row_number() over (partition by session_id order by event_time desc, text desc) as r from episodes) select session_id, episode_id from r where r <= 3 or cast(substr(session_id, 2) as int) % 4 = 0",
    "fact_lists": f"""with {LIVE} select group_id, subject, string_agg('- **' || subject || '** ' || predicate || ' **' || object || '**  _(' || strftime(valid_at, '%Y-%m-%dT%H:%M:%S') || case when fact_id % 5 > 0 then ', ' || tier else '' end || ', c=' || printf('%.2f', confidence) || ')_', chr(10) order by valid_at desc) as facts_text
from live where fact_id % 6 > 0 group by group_id, subject""",
    "recall_text": f"""with {fx.EPISODES}, t as (select session_id, episode_id, source, event_time, trim(text, ' ') as t from episodes),
b as (select session_id, episode_id, '### ' || source || ' — ' || {EP19} || '  _(session ' || session_id[:12] || ')_' || chr(10) || '```' || chr(10) || case when length(t) > 200 then t[:200] || chr(10) || '[…truncated]' else t end || chr(10) || '```' as block from t where t <> ''),
u as (select *, sum(length(block)) over (partition by session_id order by episode_id) as used, row_number() over (partition by session_id order by episode_id) as n from b),
s as (select session_id, string_agg(block, chr(10) order by episode_id) as e from u where used <= 480 or n = 1 group by session_id), f as (select distinct session_id, '- some fact' as f from episodes where episode_id % 300 < 100)
select session_id, concat_ws(chr(10) || chr(10), '## Known facts' || chr(10) || f, '## Earlier episodes' || chr(10) || e) as recalled from s full join f using (session_id)""",
    "answer_blocks": f"""with {LIVE}, x as (select cast(substr(subject, 2) as bigint) as query_id, *, row_number() over (partition by subject, tier order by fact_id) as n from live),
a as (select query_id, 'Judged facts:' || chr(10) || string_agg('- ' || subject || ' ' || predicate || ' ' || object || ' (conf=' || printf('%.2f', confidence) || ')' || case when pinned then ' [pinned]' else '' end, chr(10) order by fact_id) as a from x where tier = 'T1' and n <= 3 group by query_id),
s as (select query_id, 'Related facts:' || chr(10) || string_agg('- ' || case when length(subject || ' ' || predicate || ' ' || object) > 12 then (subject || ' ' || predicate || ' ' || object)[:11] || '…' else subject || ' ' || predicate || ' ' || object end, chr(10) order by fact_id) as s from x where tier = 'T2' and n <= 2 group by query_id)
select query_id, concat_ws(chr(10) || chr(10), a, s) as block from a full join s using (query_id)""",
    "session_primers": "select o_orderkey::varchar as session_id, 'project app' || o_custkey as query, case o_orderkey % 4 when 0 then 12 else 8 end::bigint as k, case o_orderkey % 4 when 0 then 2500 else 1500 end::bigint as budget from orders where o_orderkey % 4 < 3",
    "verdicts": f"""{mem.SEEDS}, {mem.PAIRS}, q as (select distinct query_id, query_id // 20 % 6 as k from pairs)
select query_id, case k when 0 then 'e1_correct' when 1 then 'e2_correct' when 2 then 'both_partial' when 3 then 'unresolved' end as resolution, case when k < 4 then 'so' end as reason, case when k < 4 then 0.5::double end as confidence, case when k >= 4 then 'bad response' end as error from q""",
    "verdict_answers": f"""{mem.SEEDS}, {mem.PAIRS}, {mem.ORDERED} select distinct query_id, o.fact_id as fact_id from ordered where query_id // 20 % 6 <> 1 union select query_id, n.fact_id from ordered where query_id // 20 % 6 <> 0 union select query_id, fact_id from seeds where query_id not in (select query_id from pairs)""",
    "quota_sample": f"with {RUNS}, t as (select row_idx, min(bucket) as bucket from runs group by row_idx), r as (select *, row_number() over (partition by bucket order by md5('42/' || row_idx), row_idx) as r from t) select row_idx, bucket from r where r <= case bucket when 'S' then 1 when 'M' then 2 else 6 end",
    "diverse_pick": "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as t from documents) order by t, source nulls first, doc_id limit 25",
    "stitched": f"""with {fx.MESSAGES}, m as (select conv_id // 4 as stitch_id, (conv_id % 4)::int as part, msg_idx as idx, text, max(msg_idx) over (partition by conv_id) = msg_idx as l from messages),
b as (select * from m where (part = 0 or not l)) select stitch_id, part, idx, row_number() over (partition by stitch_id order by (l and part = 0)::int, part, idx) - 1 as msg_idx, count(*) over (partition by stitch_id) as total_messages, (sum(length(text)) over (partition by stitch_id))::bigint as n_chars from b""",
    "stitched_contexts": """with e as (select doc_id // 5 as stitch_id, doc_id % 5 as part, coalesce(text, '') as context from documents)
select b.stitch_id, concat_ws(chr(10), 'Read this.', b.context, m.more, 'What is it?') as text from e b left join (select stitch_id, string_agg(context, chr(10) order by part) as more from e where part > 0 group by stitch_id) m on m.stitch_id = b.stitch_id where b.part = 0""",
    "judge_gate": f"""with {RUNS}, r as (select latency_ms, row_number() over (order by latency_ms) - 1 as i, count(*) over () as n from runs), p as (select max(latency_ms) filter (i = floor(n * 0.95::double)) as p95 from r),
a as (select count(*) as n, round(avg(hit::int), 6)::double as accuracy, round(avg(op_match::int), 6)::double as valid_rate from runs) select n, accuracy, valid_rate, p95 as p95_ms, accuracy >= 0.65 and p95 <= 15000 as passed from a, p""",
    "extract_gate": """with r as (select l_extendedprice as v, case l_partkey % 4 when 0 then 1.0 when 1 then 2.0 / 3.0 else 0.0 end::double as f, row_number() over (order by l_extendedprice) - 1 as i, count(*) over () as n from lineitem)
select count(*) as n, round(avg(case when f between 0.5 and 0.9 then 2::double * 1 * 0.5 / 1.5 else f end), 6) as mean_f1, max(v) filter (i = floor(n * 0.95::double)) as p95_ms, round(avg(case when f between 0.5 and 0.9 then 2::double * 1 * 0.5 / 1.5 else f end), 6) >= 0.70 and max(v) filter (i = floor(n * 0.95::double)) <= 8000 as passed from r""",
    "runs_left": f"with {RUNS}, done as (select row_idx from runs where row_idx % 3 = 0 or (row_idx % 3 = 1 and bucket = 'S')) select row_idx, bucket from runs where row_idx not in (select row_idx from done)",
    "rule_violations": f"""with {fx.FACTS}, s as (select fact_id, case when fact_id % 50 = 0 then 'T9' else tier end as tier, case when fact_id % 70 = 0 then 0.1 else confidence end as confidence, fact_id % 90 = 0 as short from facts), f as (select * from s union all select * from s where fact_id % 40 = 0)
select 'fact_id is unique' as rule, (select count(*) from (select fact_id from f group by fact_id having count(*) > 1)) as violations union all select 'entity is unique', (select count(distinct object) from facts where group_id = 'g2') union all select 'episode_id is unique', 0 union all select 'tier is known', (select count(*) from f where tier = 'T9')
union all select 'confidence is in range', (select count(*) from f where not (confidence >= 0.6 and confidence <= 1.0)) union all select 'interval is not empty', (select count(*) from f where short) union all select 'embedding has its dimension', (select count(*) from embeddings where vec_id % 30 = 0)""",
    "verdict_checks": """select 'too many conflicts' as why, count(*) as n, sum(o_custkey)::bigint as ids from orders where o_orderkey % 12 > 8 union all select 'more than one verdict', count(*), sum(o_custkey)::bigint from (select o_custkey from orders group by o_custkey having count(*) > 1)
union all select 'unknown resolution', count(*), sum(o_custkey)::bigint from orders where o_orderkey % 9 = 0 union all select 'unknown mode', count(*), sum(o_custkey)::bigint from orders where o_custkey % 13 = 0
union all select 'confidence out of range', count(*), sum(o_custkey)::bigint from orders where o_custkey % 17 = 0 or o_custkey % 19 = 0""",
    "block_spans": f"with {fx.MESSAGES} select role, count(distinct msg_idx % 3 = 2) as n_spans, count(*) as n from messages group by role",
    "split_pairs": f"""with {fx.MESSAGES}, k as (select conv_id, role, 't' || (msg_idx // 2) as id from messages where (conv_id + msg_idx) % 5 <> 0), u as (select conv_id, id from k where role = 'assistant'), r as (select conv_id, id from k where role = 'user')
select conv_id, id, 'use' as side from (select * from u except all select * from r) union all select conv_id, id, 'result' from (select * from r except all select * from u)""",
    "payload_split": "select doc_id, length(coalesce(text, '')) > 2000 as large from documents",
    "bulk_facts": f"with {fx.FACTS} select group_id, 'T2' as tier, false as pinned, count(*) as n, round(sum(case when fact_id % 2 = 0 then confidence else 0.9::double end), 4) as confidence, 0::bigint as ended from facts group by group_id",
    "late_messages": f"with {fx.EPISODES}, s as (select *, max(event_time) over (partition by session_id) as m from episodes) select session_id, episode_id from s where event_time < m - interval 5 minutes",
}
QUERIES = {f.__name__: f for f in (needle_tasks, multikey_tasks, chunk_messages, contradictions, final_answers, graph_tasks, answer_checks, delta_chunks, recovered_calls, reassemble_stream, tool_requests, model_limits, header_fields, transcript_backfill, fact_lists, recall_text, answer_blocks, session_primers, verdicts, verdict_answers, quota_sample, diverse_pick, stitched, stitched_contexts, judge_gate, extract_gate, runs_left, rule_violations, verdict_checks, block_spans, split_pairs, payload_split, bulk_facts, late_messages)}
