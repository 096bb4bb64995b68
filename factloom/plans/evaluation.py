"""Registered queries over experiments, conversations and quality checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import STRIP
from factloom.operators import context, evaluation as ev, needles, quality, temporal
from factloom.plans import fixtures as fx

RUNS = """runs as (select l_orderkey * 10 + l_linenumber as row_idx, case l_linenumber % 3 when 0 then 'plain' when 1 then 'ours' else 'frontier' end as arm,
  case when l_quantity < 17 then 'S' when l_quantity < 34 then 'M' else 'L' end as bucket, case when l_returnflag <> 'R' then 'ok' when l_suppkey % 2 = 0 then 'context_overflow' else 'error' end as status,
  l_discount * 10 as strict, least(cast(1 as double), l_discount * 10 + l_tax) as lenient, l_extendedprice as latency_ms, (l_suppkey % 7 = 0) as hallucinated, (l_suppkey % 11 = 0) as truncated,
  (l_partkey % 3 <> 0) as op_match, (l_partkey % 4 <> 0) as any_found, (l_partkey % 4 = 1) as all_found, (l_partkey % 5 <> 0) as hit, 1 as calls from lineitem)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return fx.table(spark, d, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("row_idx"),
        F.when(c("l_linenumber") % 3 == 0, "plain").when(c("l_linenumber") % 3 == 1, "ours").otherwise("frontier").alias("arm"),
        ev.size_bucket(c("l_quantity"), {"S": (0, 17), "M": (17, 34), "L": (34, 10**9)}).alias("bucket"),
        F.when(c("l_returnflag") != "R", "ok").when(c("l_suppkey") % 2 == 0, "context_overflow").otherwise("error").alias("status"),
        (c("l_discount") * 10).alias("strict"),
        F.least(F.lit(1.0), c("l_discount") * 10 + c("l_tax")).alias("lenient"),
        c("l_extendedprice").alias("latency_ms"),
        (c("l_suppkey") % 7 == 0).alias("hallucinated"),
        (c("l_suppkey") % 11 == 0).alias("truncated"),
        (c("l_partkey") % 3 != 0).alias("op_match"),
        (c("l_partkey") % 4 != 0).alias("any_found"),
        (c("l_partkey") % 4 == 1).alias("all_found"),
        (c("l_partkey") % 5 != 0).alias("hit"),
        F.lit(1).alias("calls"),
    )


def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summarize_arms(runs(spark, d))


def arm_analysis(spark: SparkSession, d: str) -> DataFrame:
    return ev.analyze_arms(runs(spark, d))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summarize_graph(runs(spark, d)).withColumn("status_counts", F.array_join(F.transform(F.map_entries("status_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


def needle_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summarize_needles(runs(spark, d))


def multikey_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summarize_multikey(runs(spark, d))


def contradiction_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summarize_contradictions(runs(spark, d))


def latency_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return ev.nearest_rank(runs(spark, d), ["arm", "bucket"], "latency_ms")


def latency_profile(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("size"), F.col("l_quantity").alias("walk_ms"), F.col("l_extendedprice").alias("search_ms"))
    return ev.latency_profile(s, ["walk_ms", "search_ms"])


def call_profile(spark: SparkSession, d: str) -> DataFrame:
    """Runs by line number: one call or two, some verdicts missing, answers of one or two objects."""
    c = F.col
    answer = lambda n: F.concat(F.lit("city"), (c("l_suppkey") % n).cast("string"))
    s = fx.table(spark, d, "lineitem").select(
        c("l_linenumber").alias("size"), F.when((c("l_linenumber") == 7) & (c("l_partkey") % 9 == 0), 2).otherwise(1).alias("calls"), (c("l_orderkey") % 8).alias("n_conflicts"),
        F.when(c("l_partkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("e"), (c("l_partkey") % 3).cast("string"), F.lit("_correct"))).alias("resolution"), F.when(c("l_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(answer(3), answer(5))).alias("answers"),
    )
    p = ev.call_profile(s, "city2")
    text = lambda n: F.array_join(n, ",").alias(n)
    return p.select("size", "n", "calls_min", "calls_max", "all_one", "conflicts_p50", "conflicts_max", "correct_rate", text("answers"), text("resolutions"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """A record per event: sessions are users, sizes come from the value and the hour, some turns repeat."""
    return fx.table(spark, d, "events").select(
        F.col("event_id").alias("record_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        (F.col("event_id") % 37).alias("original_messages"),
        F.floor(F.col("value") * 100).cast("long").alias("original_tokens"),
        F.least(F.floor(F.col("value") * 100), F.lit(900)).cast("long").alias("outbound_tokens"),
        F.col("ts").cast("timestamp").alias("t"),
    )


TURNS = """turns as (select event_id as record_id, 's' || user_id as session_id, event_id % 37 as original_messages, floor(value * 100)::bigint as original_tokens, least(floor(value * 100), 900)::bigint as outbound_tokens, ts as t from events),
deduped as (select *, row_number() over (partition by session_id order by original_messages) as logical_turn from (select * from turns qualify row_number() over (partition by session_id, original_messages order by t desc, record_id desc) = 1))"""


def dedupe_turns(spark: SparkSession, d: str) -> DataFrame:
    return ev.dedupe_turns(_turns(spark, d)).drop("t")


def payload_summary(spark: SparkSession, d: str) -> DataFrame:
    """Turns over a threshold, and turns at it or over it."""
    t = ev.dedupe_turns(_turns(spark, d))
    return ev.payload_summary(t, 900).withColumn("inclusive", F.lit(False)).unionByName(ev.payload_summary(t, 900, inclusive=True).withColumn("inclusive", F.lit(True)))


def group_stats(spark: SparkSession, d: str) -> DataFrame:
    g = ev.group_stats(fx.episodes(spark, d), fx.facts(spark, d))
    return g.withColumn("last_event", F.date_format("last_event", "yyyy-MM-dd HH:mm:ss"))


def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d, lambda a, b: ev.compare_runs(a, b))


def _comparison(spark: SparkSession, d: str, f) -> DataFrame:
    """Two runs: rows of one in which the second scores by tax as well."""
    r = runs(spark, d).groupBy("row_idx", "arm").agg(F.min("status").alias("status"), F.min("strict").alias("strict"), F.min("lenient").alias("lenient"))
    return f(r.select("row_idx", "arm", "status", F.col("strict").alias("lenient")), r.select("row_idx", "arm", "status", "lenient"))


def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d, lambda a, b: ev.compare_summary(a, b, "ours", "plain", "frontier"))


def nearest_to_target(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), F.length("text").alias("n_chars"))
    targets = spark.range(1, 8).select((F.pow(F.lit(10), F.col("id"))).cast("long").alias("target"))
    return ev.nearest_to_target(rows, targets).withColumn("n_chars", F.col("n_chars").cast("long"))


def set_prf(spark: SparkSession, d: str) -> DataFrame:
    e = fx.edges(spark, d)
    out = e.groupBy(F.col("src").alias("node")).agg(F.collect_set("dst").alias("pred"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.collect_set("src").alias("gold"))
    none = F.array().cast("array<string>")
    j = out.join(into, "node", "full").select("node", F.coalesce("pred", none).alias("pred"), F.coalesce("gold", none).alias("gold"))
    s = ev.set_prf(F.col("pred"), F.col("gold"))
    return j.select("node", *[F.round(s[c], 6).alias(c) for c in ("precision", "recall", "f1")])


def needle_score(spark: SparkSession, d: str) -> DataFrame:
    p = needles.turn_pairs(fx.messages(spark, d))
    """Whole answers against themselves, cut by a word, or without the token."""
    gold = F.concat(F.lit("tok "), "assistant_text")
    k = (F.col("conv_id") + F.col("pair_index")) % 3
    said = F.when(k == 0, gold).when(k == 1, F.concat(F.lit(" \n"), gold)).otherwise(F.regexp_replace(gold, r"\s\S+\s*$", ""))
    both = [F.round(ev.needle_score(said, gold, F.lit("tok "), lenient), 6).alias(n) for n, lenient in (("strict", False), ("lenient", True))]
    return p.select("conv_id", "pair_index", *both)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    t = runs(spark, d).groupBy("row_idx").agg(F.min("bucket").alias("bucket"), F.min("op_match").alias("m"))
    t = t.select(F.col("row_idx").alias("task_id"), "bucket", F.when(F.col("m"), "bfs").otherwise("parents").alias("op"))
    return ev.sample_two_classes(t, 9, 42).withColumn("extra", F.lit(False)).unionByName(ev.sample_two_classes(t, 9, 42, extra_to_first=True).withColumn("extra", F.lit(True)))


def _needled(spark: SparkSession, d: str) -> DataFrame:
    t = runs(spark, d).groupBy("row_idx").agg(F.min("bucket").alias("bucket"))
    return t.withColumn("n_needles", F.pow(F.lit(2), 1 + F.col("row_idx") % 3).cast("long"))


def needle_sample(spark: SparkSession, d: str) -> DataFrame:
    return ev.sample_needles(_needled(spark, d), 10, 42)


def needle_sample_cut(spark: SparkSession, d: str) -> DataFrame:
    """The variant that cuts each bucket first."""
    return ev.sample_needles(_needled(spark, d), 10, 42, over_all=False)


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = needles.turn_pairs(fx.messages(spark, d))
    return p.select("conv_id", "pair_index", "user_idx", "assistant_idx", "user_text", "assistant_text")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in tens, requests cut to their first letter, so that they repeat."""
    m = fx.messages(spark, d)
    user = F.concat(F.when(F.col("conv_id") % 2 == 0, "Write a ").otherwise("write an  "), F.substring("text", 1, 1))
    return m.select(F.expr("conv_id div 10").alias("conv_id"), (F.col("conv_id") * 1000 + F.col("msg_idx")).alias("msg_idx"), "role", F.when(F.col("role") == "user", user).otherwise(F.col("text")).alias("text"))


def nth_needle(spark: SparkSession, d: str) -> DataFrame:
    pairs = needles.turn_pairs(_keyed(spark, d))
    asked = pairs.select("conv_id", F.col("pair_index").alias("n"), F.lower("user_text").alias("request"))
    asked = asked.select((F.col("conv_id") * 1_000_000 + F.col("n")).alias("lookup_id"), "conv_id", "request", (1 + F.col("n") % 4).cast("int").alias("position"))
    return needles.nth_needle(pairs, asked)


def needle_answers(spark: SparkSession, d: str) -> DataFrame:
    """What each lookup answers: its token before what was found, or nothing. Requests are whole texts, of which some repeat."""
    m = fx.messages(spark, d)
    user = F.concat(F.lit("Write about "), F.when(F.col("msg_idx") % 4 < 2, F.lit("the first thing")).otherwise(F.col("text")))
    m = m.select("conv_id", "msg_idx", "role", F.when(F.col("role") == "user", user).otherwise(F.col("text")).alias("text"))
    pairs = needles.turn_pairs(m)
    asked = pairs.select("conv_id", F.col("pair_index").alias("n"), F.col("user_text").alias("request"))
    asked = asked.select((F.col("conv_id") * 1_000_000 + F.col("n")).alias("lookup_id"), "conv_id", "request", (1 + F.col("n") % 3).cast("int").alias("position"))
    found = needles.nth_needle(pairs, asked)
    return found.select("lookup_id", needles.needle_answer(F.col("found"), F.concat(F.lit("tok"), (F.col("lookup_id") % 7).cast("string"), F.lit(" "))).alias("answer"), F.col("candidates").cast("long").alias("candidates"))


def atomic_groups(spark: SparkSession, d: str) -> DataFrame:
    return context.atomic_groups(fx.messages(spark, d)).select("conv_id", "msg_idx", "group_no")


def last_user_query(spark: SparkSession, d: str) -> DataFrame:
    return context.last_user_query(fx.messages(spark, d))


LIMIT = 400


def _virtual(spark: SparkSession, d: str) -> DataFrame:
    return context.virtualize(fx.messages(spark, d), LIMIT, margin=0, last_k=1)


def virtualize_report(spark: SparkSession, d: str) -> DataFrame:
    return context.report(_virtual(spark, d))


def recap_text(spark: SparkSession, d: str) -> DataFrame:
    return _virtual(spark, d).select("conv_id", "recap", "recap_tokens", "verbatim_budget", "summary_budget", "recall_budget")


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Messages in which the first two turns and the last user's query share an identifier."""
    m = fx.messages(spark, d)
    mark = F.concat(F.lit(" PAYLOAD_"), F.lpad(F.col("conv_id").cast("string"), 6, "0"))
    return m.withColumn("text", F.when((F.col("msg_idx") <= 1) | ((F.col("role") == "user") & ~F.col("pure_tool_result")), F.concat("text", mark)).otherwise(F.col("text")))


def _group_vectors(spark: SparkSession, d: str, groups: DataFrame) -> DataFrame:
    """A stored vector for each group and one for each conversation's query."""
    v = fx.vectors(spark, d)
    n = v.count()
    g = groups.withColumn("vec_id", (F.col("conv_id") * 31 + F.col("group_no")) % n).join(v, "vec_id").select("conv_id", "group_no", "embedding", ((F.col("conv_id") * 17) % n).alias("qv"))
    return g.join(v.select(F.col("vec_id").alias("qv"), F.col("embedding").alias("q")), "qv").drop("qv")


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """Virtualization with all its parts: system texts and tools, groups ranked by vectors where the conversation's id is even,
    and facts recalled by a function of the queries where it is divisible by three."""
    c = fx.table(spark, d, "conversations").filter("role = 'system'")
    system = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("system")).withColumn("tools_tokens", F.col("conv_id") % 50)

    def recall(asked: DataFrame) -> DataFrame:
        line = F.format_string("- %s %s %s", "subject", "predicate", "object")
        f = fx.facts(spark, d).select((F.col("source_episode_id") / 100).cast("long").alias("conv_id"), "fact_id", line.alias("line"))
        told = f.groupBy("conv_id").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("fact_id", "line"))), 1, 3), lambda x: x["line"]), "\n").alias("facts"))
        both = asked.filter("conv_id % 3 = 0").join(told, "conv_id")
        return both.select("conv_id", F.left(F.concat_ws("\n", F.concat(F.lit("asked: "), F.left("query", F.lit(10))), "facts"), (F.col("recall_budget") * 4).cast("int")).alias("recall_text"))

    near = lambda groups: _group_vectors(spark, d, groups.filter("conv_id % 2 = 0"))
    m = _marked(spark, d)
    m = m.withColumn("text", F.when(F.col("conv_id") % 4 == 3, F.regexp_replace("text", " PAYLOAD_[0-9]+$", "")).otherwise(F.col("text")))
    return context.virtualize(m, LIMIT, 0, 1, near, recall, requests=system, recall_k=2)


def whole_report(spark: SparkSession, d: str) -> DataFrame:
    return context.report(_whole(spark, d))


def whole_recap(spark: SparkSession, d: str) -> DataFrame:
    return _whole(spark, d).select("conv_id", "outcome", "recap", "system")


def literal_needles(spark: SparkSession, d: str) -> DataFrame:
    m = _marked(spark, d)
    cold = context.cold_messages(m, context.outcomes(m, LIMIT, 0, 1), 1)
    return context.literal_groups(context.last_user_query(m), context.group_blocks(cold))


def cold_group_recall(spark: SparkSession, d: str) -> DataFrame:
    m = _marked(spark, d)
    per = context.outcomes(m, LIMIT, 0, 1)
    groups = context.group_blocks(context.cold_messages(m, per, 1))
    vectors = _group_vectors(spark, d, groups)
    ranked = context.rank_cold_groups(groups, context.literal_groups(context.last_user_query(m), groups), vectors, k=2)
    return context.render_groups(ranked, groups, per)


def cold_summary(spark: SparkSession, d: str) -> DataFrame:
    """Half of the texts stand between line breaks and blanks."""
    m = fx.messages(spark, d)
    m = m.withColumn("text", F.when(F.col("msg_idx") % 2 == 0, F.concat(F.lit("\n \t"), "text", F.lit(" \n"))).otherwise(F.col("text")))
    return context.cold_summary(context.cold_messages(m, context.outcomes(m, LIMIT, 0, 1), 1))


def embedding_input(spark: SparkSession, d: str) -> DataFrame:
    m = fx.messages(spark, d)
    return context.embedding_input(context.cold_messages(m, context.outcomes(m, LIMIT, 0, 1), 1), 700)


def secret_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit(" AKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "0"))).otherwise(F.col("text"))
    return quality.flag_secrets(docs.select("doc_id", text.alias("text")), "text").select("doc_id", "secret")


def question_flags(spark: SparkSession, d: str) -> DataFrame:
    """Texts as they are, and some with a question word behind white space of several kinds."""
    k = F.col("conv_id") % 4
    text = F.when(k == 0, F.concat(F.lit("\n\u00a0What "), "text")).when(k == 1, F.concat(F.lit("\t Is "), "text", F.lit("\u2003\n"))).when(k == 2, F.concat(F.lit("How\t"), "text")).otherwise(F.col("text"))
    rows = fx.table(spark, d, "conversations").withColumn("text", text)
    return rows.groupBy("role", k.alias("k")).agg(F.count_if(quality.is_question(F.col("text"))).alias("questions"), F.count("*").alias("n"))


def message_dedupe(spark: SparkSession, d: str) -> DataFrame:
    m = fx.messages(spark, d)
    twice = m.unionByName(m.withColumn("msg_idx", F.col("msg_idx") + 1000).filter("msg_idx % 5 = 0"))
    return quality.first_spans(twice, ["conv_id"], "msg_idx").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("msg_idx").alias("ids"))


def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    f = fx.facts(spark, d)
    return quality.violations(f, fx.episodes(spark, d), fx.vectors(spark, d), 64, temporal.entities(f))


GROUPED = f"""{fx.MESSAGES}, grouped as (select *, sum(case when rn = 1 then 1 when role = 'user' and not pure_tool_result then 1 else 0 end) over (partition by conv_id order by msg_idx) - 1 as group_no from (select *, row_number() over (partition by conv_id order by msg_idx) as rn from messages))"""
TOK = "case when length({0}) = 0 then 0 else greatest(1, length({0}) // 4) end"
OUTCOMES = f"""{GROUPED}, t as (select *, {TOK.format('text')} as tokens, group_no > max(group_no) over (partition by conv_id) - 1 as hot from grouped),
p as (select conv_id, count(*) as original_messages, sum(tokens)::bigint as original_tokens, count(*) filter (hot) as hot_messages, coalesce(sum(tokens) filter (hot), 0)::bigint as hot_tokens, coalesce(sum(tokens) filter (not hot), 0)::bigint as cold_tokens, count(distinct group_no) filter (not hot) as cold_groups from t group by conv_id),
o as (select *, case when original_tokens <= {LIMIT} then 'fits' when hot_tokens > {LIMIT} then 'degraded' else 'virtualized' end as outcome from p),
q as (select *, case when outcome = 'virtualized' then greatest(256, {LIMIT} - hot_tokens) end as recap_budget from o),
v as (select *, case when cold_groups > 0 then floor(recap_budget * 0.70::double) else recap_budget * 0 end::bigint as verbatim_budget from q),
b as (select *, case when cold_groups > 0 then floor((recap_budget - verbatim_budget) * 0.25::double) else recap_budget * 0 end::bigint as summary_budget from v),
per as (select *, case when outcome <> 'degraded' then greatest(256, case when outcome = 'fits' then {LIMIT} - original_tokens else recap_budget - verbatim_budget - summary_budget end) end::bigint as recall_budget from b),
cold as (select t.* from t join per using (conv_id) where outcome = 'virtualized' and not hot)"""
SUMMARY = r"s as (select conv_id, string_agg('- [' || role || '] ' || case when length(line) > 280 then line[:279] || '…' else line end, chr(10) order by msg_idx) as summary from (select *, translate(regexp_replace(text, '" + STRIP + r"', '', 'g'), chr(10), ' ') as line from cold) group by conv_id)"
PADDED = fx.MESSAGES.replace("role, text,", "role, case when turn % 2 = 0 then chr(10) || ' ' || chr(9) || text || ' ' || chr(10) else text end as text,")
RECAP = f"""{OUTCOMES}, {SUMMARY}, w as (select per.*, case when summary is null then null when summary_budget + verbatim_budget <= 0 then '' when length(summary) > 4 * (summary_budget + verbatim_budget) then summary[:4 * (summary_budget + verbatim_budget) - 1] || '…' else summary end as summary from per left join s using (conv_id)),
x as (select *, case when coalesce(summary, '') = '' then '' else '{context.RECAP_OPEN}{context.SUMMARY_HEAD}' || summary || '{context.RECAP_CLOSE}' end as recap from w), y as (select *, ({TOK.format('recap')})::bigint as recap_tokens from x)"""
MARKED = fx.MESSAGES.replace("role, text,", "role, case when turn <= 1 or (role = 'user' and turn % 4 not in (2, 3)) then text || ' PAYLOAD_' || lpad(conv_id::varchar, 6, '0') else text end as text,")
BLOCKS = """blocks as (select conv_id, group_no, string_agg('[turn ' || group_no || '.' || j || ' ' || role || ']' || chr(10) || text, chr(10) order by j) as block, string_agg(text, chr(10) order by j) as body from (select *, row_number() over (partition by conv_id, group_no order by msg_idx) - 1 as j from cold) group by conv_id, group_no),
lq as (select conv_id, arg_max(text, msg_idx) as query from messages where role = 'user' and not pure_tool_result group by conv_id),
nd as (select conv_id, unnest(list_transform(list_filter(regexp_extract_all(query, '\\b[A-Za-z][A-Za-z0-9_-]{7,}\\b'), lambda t: regexp_matches(t, '[0-9_-]')), lambda t: lower(t))) as needle from lq),
lit as (select distinct b.conv_id, group_no from blocks b join nd using (conv_id) where contains(lower(body), needle))"""
M6 = "round(avg({0}), 6)::double"
PERFECT = "case when {0} >= 0.99 then 1.0 else 0.0 end"
NR = """with {fix}, r as (select *, row_number() over (partition by {keys} order by {value}) - 1 as i, count(*) over (partition by {keys}) as n from {src} where {value} is not null)
select {keys}, max(n) as n, max({value}) filter (i = round_even(0.5 * (n - 1), 0)) as p50_round, max({value}) filter (i = round_even(0.95 * (n - 1), 0)) as p95_round, max({value}) filter (i = least(n - 1, floor(n * 0.5))) as p50_floor, max({value}) filter (i = n // 2) as upper_median,
coalesce(max({value}) filter (n >= 20 and i = floor(n * 0.95::double)), max({value})) as p95_or_max, round((max({value}) filter (i = (n - 1) // 2) + max({value}) filter (i = n // 2)) / 2, 6) as median from r group by {keys}"""

DEALT = "md5('42/' || {0}::varchar)"
HISTORY = r"""nv as (select count(*) as n from embeddings),
vs as (select conv_id, group_no, -round(list_dot_product(e.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]) * list_dot_product(q.embedding::double[], q.embedding::double[])), 6) as far
  from blocks join nv on true join embeddings e on e.vec_id = (conv_id * 31 + group_no) % n join embeddings q on q.vec_id = (conv_id * 17) % n where {0}),
nl as (select conv_id, count(*) as k from lit group by conv_id), near as (select vs.*, row_number() over (partition by vs.conv_id order by far, group_no) as r, coalesce(k, 0) as k from vs left join nl using (conv_id)),
hits as (select conv_id, group_no, 0 as path, 0.0::double as far from lit union all select conv_id, group_no, 1, far from near where r <= 2 + k),
f as (select conv_id, group_no, min(struct_pack(p := path, f := far)) as x from hits group by all), rk as (select conv_id, group_no, row_number() over (partition by conv_id order by x.p, x.f, group_no) as rank from f),
u as (select rk.*, block, verbatim_budget, sum(greatest(1, length(block) // 4) + 2) over (partition by rk.conv_id order by rank) as used from rk join blocks using (conv_id, group_no) join per using (conv_id) where verbatim_budget > 0),
history as (select conv_id, 'HEAD' || chr(10) || chr(10) || regexp_replace(string_agg(block, chr(10) || chr(10) order by group_no), '\s+$', '') as history, count(*) as groups_shown from u where used <= verbatim_budget or rank = 1 group by conv_id)""".replace("HEAD", context.HISTORY_HEAD)
UNMARKED = MARKED.replace("when turn <= 1", "when conv_id % 4 <> 3 and (turn <= 1").replace("turn % 4 not in (2, 3)) then", "turn % 4 not in (2, 3))) then")
WHOLE = f"""{OUTCOMES.replace(fx.MESSAGES, UNMARKED)}, {BLOCKS}, {HISTORY.format('conv_id % 2 = 0')}, {SUMMARY}, {fx.FACTS},
sy as (select conv_id, arg_max(text, turn) as system, conv_id % 50 as tools from conversations where role = 'system' group by conv_id),
rf as (select conv_id, string_agg('- ' || subject || ' ' || predicate || ' ' || object, chr(10) order by fact_id) as facts from (select *, source_episode_id // 100 as conv_id, row_number() over (partition by source_episode_id order by fact_id) as r from facts) where r <= 3 group by conv_id),
rc as (select per.conv_id, ('asked: ' || coalesce(query, '')[:10] || chr(10) || facts)[:recall_budget * 4] as recalled from per join rf using (conv_id) left join lq using (conv_id) where per.conv_id % 3 = 0 and outcome <> 'degraded'),
jn as (select per.*, history, recalled, coalesce(system, '') as sys, coalesce(tools, 0) as tools_tokens, case when history is null and summary is not null then case when summary_budget + verbatim_budget <= 0 then '' when length(summary) > 4 * (summary_budget + verbatim_budget) then summary[:4 * (summary_budget + verbatim_budget) - 1] || '…' else summary end end as summary
  from per left join history using (conv_id) left join s using (conv_id) left join rc using (conv_id) left join sy using (conv_id)),
bd as (select *, concat_ws(chr(10) || chr(10), case when coalesce(history, '') <> '' then '{context.VERBATIM_HEAD}' || regexp_replace(history, '{STRIP}', '', 'g') end, case when coalesce(summary, '') <> '' then '{context.SUMMARY_HEAD}' || summary end, case when coalesce(recalled, '') <> '' then '{context.RECALL_HEAD}' || regexp_replace(recalled, '{STRIP}', '', 'g') end) as body from jn),
zz as (select *, case when outcome = 'degraded' or body = '' then '' else '{context.RECAP_OPEN}' || body || '{context.RECAP_CLOSE}' end as recap from bd),
z as (select * exclude (sys), sys as system, ({TOK.format('recap')})::bigint as recap_tokens, ({TOK.format('sys')})::bigint as system_tokens, ({TOK.format('(sys || recap)')})::bigint as post_system_tokens from zz)"""
ORACLE = {
    "stratified_sample": f"""with {RUNS}, t as (select row_idx as task_id, min(bucket) as bucket, case when bool_and(op_match) then 'bfs' else 'parents' end as op from runs group by row_idx),
r as (select *, row_number() over (partition by bucket, op order by {DEALT.format('task_id')}, task_id) as r, count(*) filter (op = 'bfs') over (partition by bucket) as f from t)
select task_id, bucket, op, q = 5 as extra from r, (select unnest([4, 5]) as q) where case when op = 'bfs' then r <= q else r <= 9 - least(q, f) end""",
    "needle_sample_cut": f"""with {RUNS}, a as (select row_idx, min(bucket) as bucket, pow(2, 1 + row_idx % 3)::bigint as n_needles from runs group by row_idx), t as (select row_idx, bucket, n_needles from (select *, row_number() over (partition by bucket order by {DEALT.format('row_idx')}, row_idx) as c from a) where c <= 10)
select row_idx, bucket, n_needles from t""",
    "needle_sample": f"""with {RUNS}, t as (select row_idx, min(bucket) as bucket, pow(2, 1 + row_idx % 3)::bigint as n_needles from runs group by row_idx),
r as (select *, row_number() over (partition by bucket, n_needles order by {DEALT.format('row_idx')}, row_idx) <= 4 as picked from t),
k as (select *, row_number() over (partition by bucket order by (not picked)::int, case when picked then n_needles end nulls first, {DEALT.format('row_idx')}, row_idx) as k from r) select row_idx, bucket, n_needles from k where k <= 10""",
    "arm_summary": f"with {RUNS} select bucket, arm, count(*) as n, {M6.format('strict')} as mean_strict, {M6.format('lenient')} as mean_lenient, {M6.format(PERFECT.format('strict'))} as perfect_strict, {M6.format(PERFECT.format('lenient'))} as perfect_lenient from runs where status = 'ok' group by grouping sets ((arm), (bucket, arm))",
    "arm_analysis": f"""with {RUNS}, r as (select *, row_number() over (partition by arm order by latency_ms) - 1 as i, count(*) over (partition by arm) as n from runs) select arm, count(*) filter (status = 'ok') as n_ok, count(*) filter (status = 'context_overflow') as n_overflow, count(*) filter (status not in ('ok', 'context_overflow')) as n_err,
round(avg(strict) filter (status = 'ok'), 6) as strict_mean, round(avg(lenient) filter (status = 'ok'), 6) as lenient_mean, round(avg({PERFECT.format('strict')}) filter (status = 'ok'), 6)::double as perfect_strict, round(avg({PERFECT.format('lenient')}) filter (status = 'ok'), 6)::double as perfect_lenient,
count(*) filter (status = 'ok' and hallucinated) as hallucinations, count(*) filter (status = 'ok' and truncated) as truncations, max(latency_ms) filter (i = n // 2) as median_latency_ms from r group by arm""",
    "graph_summary": f"""with {RUNS}, r as (select *, row_number() over (partition by bucket order by latency_ms) - 1 as i, count(*) over (partition by bucket) as c from runs), k as (select bucket, string_agg(status || '=' || c, ',' order by status) as status_counts from (select bucket, status, count(*) as c from runs group by all) group by bucket)
select bucket, count(*) as n, {M6.format(PERFECT.format('lenient'))} as em, {M6.format('lenient')} as f1, {M6.format('op_match::int')} as op_match_rate, round(avg(strict) filter (status = 'ok'), 6) as baseline_over_runnable, round(avg(case when status = 'ok' then strict else 0 end), 6) as baseline_over_all,
max(latency_ms) filter (i = least(c - 1, floor(c * 0.5))) as p50_ms, any_value(status_counts) as status_counts from r join k using (bucket) group by bucket""",
    "needle_summary": f"""with {RUNS}, r as (select *, row_number() over (partition by bucket order by latency_ms) - 1 as i, count(*) over (partition by bucket) as c from runs)
select bucket, count(*) as n, {M6.format('lenient')} as mean_ours, {M6.format(PERFECT.format('lenient'))} as perfect_ours, round(avg(case when status = 'ok' then strict else 0 end), 6) as baseline_all, round(avg(strict) filter (status = 'ok'), 6) as baseline_runnable, max(latency_ms) filter (i = least(c - 1, floor(c * 0.5))) as p50_ms from r group by bucket""",
    "multikey_summary": f"with {RUNS} select arm, bucket, count(*) as n, {M6.format('any_found::int')} as any_rate, {M6.format('all_found::int')} as all_rate from runs where status = 'ok' group by grouping sets ((arm), (arm, bucket))",
    "contradiction_summary": f"""with {RUNS}, u as (select *, 'all' as dimension, 'all' as value from runs union all select *, 'type', arm from runs union all select *, 'bucket', bucket from runs), v as (select *, case when status <> 'error' and latency_ms > 0 then latency_ms end as lat from u),
a as (select dimension, value, count(*) as n, count(*) filter (hit) as hits, count(*) filter (status = 'error') as errors, {M6.format('hit::int')} as accuracy, coalesce(bool_and(calls = 1) filter (status <> 'error'), false) as one_call_each, round(avg(lat), 6) as mean_ms from v group by all),
r as (select dimension, value, lat, row_number() over (partition by dimension, value order by lat) - 1 as i, count(*) over (partition by dimension, value) as c from v where lat is not null),
s as (select dimension, value, round((max(lat) filter (i = (c - 1) // 2) + max(lat) filter (i = c // 2)) / 2, 6) as p50_ms, coalesce(max(lat) filter (c >= 20 and i = floor(c * 0.95::double)), max(lat)) as p95_ms from r group by all) select * from a left join s using (dimension, value)""",
    "latency_nearest_rank": NR.format(fix=RUNS, keys="arm, bucket", value="latency_ms", src="runs"),
    "latency_profile": f"""with l as (select l_linenumber as size, 'walk_ms' as stage, l_quantity as ms from lineitem union all select l_linenumber, 'search_ms', l_extendedprice from lineitem),
r as (select *, row_number() over (partition by size, stage order by ms) - 1 as i, count(*) over (partition by size, stage) as n from l)
select size, stage, max(n) as n, max(ms) filter (i = round_even(0.5 * (n - 1), 0)) as p50, max(ms) filter (i = round_even(0.95 * (n - 1), 0)) as p95, {M6.format('ms')} as mean from r group by size, stage""",
    "call_profile": f"""with s as (select l_linenumber as size, case when l_linenumber = 7 and l_partkey % 9 = 0 then 2 else 1 end as calls, l_orderkey % 8 as k, case when l_partkey % 3 > 0 then 'e' || (l_partkey % 3) || '_correct' end as resolution,
  case when l_partkey % 5 = 0 then [] else ['city' || (l_suppkey % 3), 'city' || (l_suppkey % 5)] end as answers from lineitem), a as (select size, string_agg(a, ',' order by a) as answers from (select distinct size, unnest(answers) as a from s) group by size)
select size, count(*) as n, min(calls) as calls_min, max(calls) as calls_max, bool_and(calls = 1) as all_one, round(median(k), 6) as conflicts_p50, max(k) as conflicts_max, round(avg(list_contains(answers, 'city2')::int), 6) as correct_rate, any_value(a.answers) as answers, string_agg(distinct resolution, ',' order by resolution) as resolutions
from s join a using (size) group by size""".replace("list_contains(answers", "list_contains(s.answers"),
    "dedupe_turns": f"with {TURNS} select session_id, original_messages, record_id, original_tokens, outbound_tokens, logical_turn from deduped",
    "payload_summary": f"""with {TURNS}, r as (select *, row_number() over (partition by session_id order by outbound_tokens) - 1 as i, count(*) over (partition by session_id) as n from deduped)
select session_id, count(*) as turns, max(outbound_tokens) as max_outbound, max(original_tokens) as max_original, count(*) filter (outbound_tokens > 900 or (e and outbound_tokens = 900)) as turns_over, bool_or(outbound_tokens < original_tokens) as ever_virtualized, count(*) filter (outbound_tokens > 900 or (e and outbound_tokens = 900)) = 0 as passed, max(outbound_tokens) filter (i = n // 2) as median_outbound, e as inclusive
from r, (select unnest([false, true]) as e) group by session_id, e""",
    "group_stats": f"""with {fx.FACTS}, {fx.EPISODES}, e as (select group_id, count(*) as episodes, count(distinct session_id) as sessions, array_to_string(list_sort(list(distinct source))[:10], ',') as sources, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') as last_event from episodes group by group_id),
f as (select group_id, count(*) as facts from facts group by group_id) select group_id, coalesce(episodes, 0) as episodes, coalesce(sessions, 0) as sessions, sources, last_event, coalesce(facts, 0) as facts from e full join f using (group_id)""",
    "compare_runs": f"""with {RUNS}, r as (select row_idx, arm, min(status) as status, min(strict) as a, min(lenient) as b from runs group by all), d as (select *, case when status = 'ok' then round(b - a, 6) end as delta from r)
select row_idx, arm, status as status_a, status as status_b, delta, case when delta > 0.001 then '+' when delta < -0.001 then '-' when delta is not null then '=' end as sign from d""",
    "compare_summary": f"""with {RUNS}, r as (select row_idx, arm, min(status) as status, min(strict) as a, min(lenient) as b from runs group by all), m as (select arm, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b from r where status = 'ok' group by arm),
v as (select *, max(mean_b) filter (arm = 'ours') over () as o, max(mean_b) filter (arm = 'plain') over () as p, max(mean_b) filter (arm = 'frontier') over () as f from m)
select arm, mean_a, mean_b, round(mean_b - mean_a, 6) as delta, case when o <> 0 and f <> 0 and o >= 0.90 * f then 'on par with the frontier' when o <> 0 and p <> 0 and o > p + 0.10 then 'better than plain' when o <> 0 and p <> 0 and abs(o - p) < 0.05 then 'like plain' else 'behind' end as verdict from v""",
    "nearest_to_target": """with t as (select pow(10, i)::bigint as target from range(1, 8) t(i)), r as (select doc_id as row_idx, length(text)::bigint as n_chars from documents),
b as (select target, row_idx, n_chars from t join r on abs(n_chars - target) <= 0.20 * target qualify row_number() over (partition by target order by abs(n_chars - target), row_idx) = 1) select target, row_idx, n_chars from t left join b using (target)""",
    "set_prf": f"""with {fx.EDGES}, p as (select src as node, count(*) as n from edges group by src), g as (select dst as node, count(*) as m from edges group by dst), t as (select a.src as node, count(*) as tp from edges a join edges b on a.src = b.dst and a.dst = b.src group by a.src),
j as (select node, coalesce(n, 0) as n, coalesce(m, 0) as m, coalesce(tp, 0)::double as tp from p full join g using (node) left join t using (node))
select node, case when n = 0 or m = 0 then 0.0 else round(tp / n, 6) end::double as precision, case when n = 0 or m = 0 then 0.0 else round(tp / m, 6) end::double as recall, case when n = 0 or m = 0 or tp = 0 then 0.0 else round(2 * (tp / n) * (tp / m) / (tp / n + tp / m), 6) end::double as f1 from j""",
    "turn_pairs": f"""with {fx.MESSAGES}, l as (select *, lead(role) over w as nr, lead(text) over w as nt, lead(msg_idx) over w as ni from messages window w as (partition by conv_id order by msg_idx))
select conv_id, row_number() over (partition by conv_id order by msg_idx) - 1 as pair_index, msg_idx as user_idx, ni as assistant_idx, text as user_text, nt as assistant_text from l where role = 'user' and nr = 'assistant'""",
    "nth_needle": f"""with {fx.MESSAGES}, k as (select conv_id // 10 as conv_id, conv_id * 1000 + msg_idx as msg_idx, role, case when role = 'user' then case when conv_id % 2 = 0 then 'Write a ' else 'write an  ' end || text[:1] else text end as text from messages),
l as (select *, lead(role) over w as nr, lead(text) over w as nt from k window w as (partition by conv_id order by msg_idx)), p as (select conv_id, row_number() over (partition by conv_id order by msg_idx) - 1 as pair_index, text as u, nt as a from l where role = 'user' and nr = 'assistant'),
n as (select *, row_number() over (partition by conv_id, u order by pair_index) as pos, case when z like 'write an %' then 'write a ' || z[10:] else z end as norm from (select *, trim(regexp_replace(lower(u), '\\s+', ' ', 'g'), ' ') as z from p)),
q as (select conv_id * 1000000 + pair_index as lookup_id, conv_id, lower(u) as request, norm, (1 + pair_index % 4)::int as position from n),
keys as (select conv_id, u, norm, min(pair_index) as first, count(*) as candidates from n group by all),
c as (select q.*, coalesce((select any_value(u) from keys k where k.conv_id = q.conv_id and k.u = q.request), (select arg_min(u, first) from keys k where k.conv_id = q.conv_id and k.norm = q.norm)) as key from q)
select lookup_id, n.a as found, coalesce(k.candidates, 0) as candidates from c left join keys k on k.conv_id = c.conv_id and k.u = c.key left join n on n.conv_id = c.conv_id and n.u = c.key and n.pos = c.position""",
    "needle_answers": f"""with {fx.MESSAGES}, t as (select conv_id, msg_idx, role, case when role = 'user' then 'Write about ' || case when msg_idx % 4 < 2 then 'the first thing' else text end else text end as text from messages),
w as (select *, lead(role) over (partition by conv_id order by msg_idx) as nr, lead(text) over (partition by conv_id order by msg_idx) as a from t),
p as (select conv_id, text as u, a, row_number() over (partition by conv_id order by msg_idx) - 1 as n from w where role = 'user' and nr = 'assistant'),
q as (select *, row_number() over (partition by conv_id, u order by n) as pos, count(*) over (partition by conv_id, u) as c from p)
select p.conv_id * 1000000 + p.n as lookup_id, coalesce('tok' || ((p.conv_id * 1000000 + p.n) % 7) || ' ' || x.a, '') as answer, q.c as candidates from q p join q using (conv_id, u, n) left join q x on x.conv_id = p.conv_id and x.u = p.u and x.pos = 1 + p.n % 3""",
    "atomic_groups": f"with {GROUPED} select conv_id, msg_idx, group_no::bigint as group_no from grouped",
    "last_user_query": f"with {fx.MESSAGES} select conv_id, arg_max(text, msg_idx) as query from messages where role = 'user' and not pure_tool_result group by conv_id",
    "virtualize_report": f"""with {RECAP} select conv_id, outcome, original_messages, original_tokens, case when outcome = 'fits' then original_messages else hot_messages end as kept_messages, case when outcome = 'fits' then original_tokens else hot_tokens end as kept_tokens,
case when outcome = 'fits' then 0 else cold_groups end::bigint as cold_groups, case when outcome = 'fits' then 0 else cold_tokens end::bigint as cold_tokens, recap_tokens, original_tokens as original_total_tokens, recap_tokens as post_system_tokens, 0::bigint as tools_tokens, case when outcome = 'virtualized' and recap <> '' then hot_tokens + recap_tokens else original_tokens end as outbound_tokens,
outcome = 'degraded' as degraded, outcome = 'virtualized' and cold_groups > 0 and hot_messages < original_messages as virtualized,
concat_ws('; ', case when outcome = 'degraded' then 'the last groups alone take ' || hot_tokens || ' tokens' end, case when outcome = 'virtualized' and recap = '' then 'nothing to recall, passed through' end, case when outcome = 'virtualized' and recap <> '' then 'recap of ' || cold_groups || ' groups' end) as notes from y""",
    "recap_text": f"with {RECAP} select conv_id, recap, recap_tokens, verbatim_budget, summary_budget, recall_budget from y",
    "cold_summary": f"with {OUTCOMES.replace(fx.MESSAGES, PADDED)}, {SUMMARY} select conv_id, summary from s",
    "embedding_input": f"""with {OUTCOMES}, g as (select *, greatest(200, 700 // count(*) over (partition by conv_id, group_no)) as share from cold)
select conv_id, group_no::bigint as group_no, (string_agg('[' || role || '] ' || case when length(text) > share then text[:share] || '…' else text end, chr(10) order by msg_idx))[:700] as text from g group by conv_id, group_no""",
    "literal_needles": f"with {OUTCOMES.replace(fx.MESSAGES, MARKED)}, {BLOCKS} select conv_id, group_no::bigint as group_no from lit",
    "cold_group_recall": f"with {OUTCOMES.replace(fx.MESSAGES, MARKED)}, {BLOCKS}, {HISTORY.format('true')} select conv_id, history, groups_shown from history",
    "whole_report": f"""with {WHOLE} select conv_id, outcome, original_messages, original_tokens, original_tokens + system_tokens + tools_tokens as original_total_tokens, case when outcome = 'fits' then original_messages else hot_messages end as kept_messages, case when outcome = 'fits' then original_tokens else hot_tokens end as kept_tokens,
case when outcome = 'fits' then 0 else cold_groups end::bigint as cold_groups, case when outcome = 'fits' then 0 else cold_tokens end::bigint as cold_tokens, recap_tokens, post_system_tokens, tools_tokens, case when outcome = 'virtualized' and recap <> '' then hot_tokens else original_tokens end + post_system_tokens + tools_tokens as outbound_tokens,
outcome = 'degraded' as degraded, outcome = 'virtualized' and cold_groups > 0 and hot_messages < original_messages as virtualized,
concat_ws('; ', case when outcome = 'degraded' then 'the last groups alone take ' || hot_tokens || ' tokens' end, case when outcome = 'virtualized' and recap = '' then 'nothing to recall, passed through' end, case when outcome = 'virtualized' and recap <> '' then 'recap of ' || cold_groups || ' groups' end, case when outcome = 'fits' and recap <> '' then 'fits, with recalled facts' end) as notes from z""",
    "whole_recap": f"with {WHOLE} select conv_id, outcome, recap, system || recap as system from z",
    "secret_flags": r"""with d as (select doc_id, case when doc_id % 17 = 0 then text || ' AKIA' || lpad(doc_id::varchar, 16, '0') else text end as text from documents)
select doc_id, case when regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----') then 'private_key' when regexp_matches(text, 'sk-ant-[A-Za-z0-9_-]{40,}') then 'ant_key' when regexp_matches(text, 'sk-[A-Za-z0-9]{40,}') then 'sk_key' when regexp_matches(text, 'AKIA[0-9A-Z]{16}') then 'access_key_id'
when regexp_matches(text, 'ghp_[A-Za-z0-9]{30,}') then 'access_token' when regexp_matches(text, 'xox[bpoa]-[A-Za-z0-9-]{20,}') then 'chat_token' end as secret from d""",
    "question_flags": f"""with t as (select role, conv_id % 4 as k, case conv_id % 4 when 0 then chr(10) || chr(160) || 'What ' || text when 1 then chr(9) || ' Is ' || text || chr(8195) || chr(10) when 2 then 'How' || chr(9) || text else text end as text from conversations)
select role, k, count(*) filter (contains(text, '?') or string_split(lower(regexp_replace(text, '{STRIP}', '', 'g')), ' ')[1] in {quality.QUESTION_WORDS}) as questions, count(*) as n from t group by role, k""",
    "message_dedupe": f"""with {fx.MESSAGES}, t as (select conv_id, msg_idx, role, text from messages union all select conv_id, msg_idx + 1000, role, text from messages where (msg_idx + 1000) % 5 = 0),
f as (select conv_id, role, text, min(msg_idx) as msg_idx from t where length(text) >= 20 group by all) select conv_id, count(*) as n, sum(msg_idx)::bigint as ids from f group by conv_id""",
    "quality_checks": f"""with {fx.FACTS}, {fx.EPISODES} select 'fact_id is unique' as rule, (select count(*) from (select fact_id from facts group by fact_id having count(*) > 1)) as violations union all select 'entity is unique', 0
union all select 'episode_id is unique', (select count(*) from (select episode_id from episodes group by episode_id having count(*) > 1)) union all select 'tier is known', (select count(*) from facts where tier not in ('T1', 'T2', 'T3', 'T4') or tier is null)
union all select 'confidence is in range', (select count(*) from facts where not (confidence >= 0.6 and confidence <= 1.0) or confidence is null) union all select 'interval is not empty', (select count(*) from facts where invalid_at <= valid_at)
union all select 'embedding has its dimension', (select count(*) from embeddings where len(embedding) <> 64 or embedding is null)""",
}
QUERIES = {f.__name__: f for f in (arm_summary, arm_analysis, graph_summary, needle_summary, multikey_summary, contradiction_summary, latency_nearest_rank, latency_profile, dedupe_turns, payload_summary, group_stats, compare_runs, compare_summary, nearest_to_target, set_prf, needle_score, stratified_sample, needle_sample, needle_sample_cut, call_profile, turn_pairs, nth_needle, needle_answers, atomic_groups, last_user_query, virtualize_report, recap_text, whole_report, whole_recap, literal_needles, cold_group_recall, cold_summary, embedding_input, secret_flags, question_flags, message_dedupe, quality_checks)}
