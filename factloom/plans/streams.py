"""Registered queries over streams with keyed state, each fed in several arrivals, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.storage import new_folder
from factloom.plans import fixtures as fx
from factloom.plans import memory as mem
from factloom.streaming import keyed

SPANS, GAP_MS, THRESHOLD = 8, 12 * 3_600_000, 800


def _quarter(spark: SparkSession, d: str, parts: int = 4) -> str:
    """SQL of an event's part by its id, from the number of events."""
    return f"cast(least({parts - 1}, event_id div {fx.table(spark, d, 'events').agg(F.max('event_id')).first()[0] // parts + 1}) as int)"


def _streamed(spark: SparkSession, arrivals: list[DataFrame], make, schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    out, state = new_folder(spark, "streamed"), new_folder(spark, "stream-state")
    keyed.feed(arrivals, new_folder(spark, "arrivals"), lambda s: keyed.run_to(make(s), out, state, by))
    return spark.read.schema(schema).parquet(out)


def span_memory(spark: SparkSession, d: str) -> DataFrame:
    """Spans of each user's events, of which eight are remembered: first sights, and repeats of what was forgotten."""
    e = fx.table(spark, d, "events")
    text = F.concat_ws(" ", F.lit("an event of this kind:"), "event_type", (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))
    rows = e.select(F.lit("g").alias("group_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), F.lit("user").alias("role"), text.alias("text"), F.col("ts").cast("timestamp").alias("event_time"), F.expr(_quarter(spark, d)).alias("part"))
    arrivals = [rows.filter(F.col("part") == k).drop("part") for k in range(4)]
    done = _streamed(spark, arrivals, lambda s: keyed.first_sights(s, most=SPANS), "session_id string, seq long, text string")
    return done.select("session_id", F.col("seq").alias("event_id"), "text")


def stream_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that arrive in four parts against those that came before and a fifth that was stored before them."""
    f = fx.facts(spark, d).withColumn("part", F.expr(_quarter(spark, d, 5).replace("event_id", "fact_id")))
    arrivals = [f.filter(F.col("part") == k).drop("part") for k in range(1, 5)]
    done = _streamed(spark, arrivals, lambda s: keyed.conflicts_of_stream(s, f.filter("part = 0").drop("part"), salts=4), "fact_id long, salt int, conflicts array<long>")
    return keyed.merged_conflicts(done).select("fact_id", F.size("conflicts").cast("long").alias("n_conflicts"), F.aggregate("conflicts", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


def _changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts, and what comes out when their changes, and some of facts that do not exist, arrive in three parts."""
    f, m = fx.facts(spark, d), fx.mutations(spark, d)
    m = m.unionByName(m.filter("fact_id % 91 = 0").withColumns({"fact_id": -F.col("fact_id") - 1, "mutation_id": -F.col("mutation_id") - 1}))
    cuts = ["2024-01-11", "2024-01-21"]
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("ts") >= F.lit(c).cast("timestamp")).cast("int")
    arrivals = [m.filter(part == k) for k in range(3)]
    return f, _streamed(spark, arrivals, lambda s: keyed.changes_of_stream(s, f), keyed.CHANGED, ("kind",))


def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """Attestations, invalidations and deletions folded by a stream."""
    f, out = _changed(spark, d)
    now = keyed.folded_facts(f, out.filter("kind = 'fact'"))
    return now.groupBy("group_id").agg(F.count("*").alias("n"), F.count("invalid_at").alias("ended"), F.count_if("pinned").alias("pinned"), F.round(F.sum("confidence"), 4).alias("confidence"))


def unknown_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of facts that never were, or were deleted by then, as the stream's second output."""
    _, out = _changed(spark, d)
    return out.filter("kind = 'unknown'").select("mutation_id", "fact_id")


def session_monitor(spark: SparkSession, d: str) -> DataFrame:
    """Activity windows of token counts per user, all of them, and the records that came too late for one."""
    part = F.expr(_quarter(spark, d)) + F.when(F.col("event_id") % 23 == 0, 1).otherwise(0)
    rows = fx.token_counts(spark, d).withColumn("part", F.least(F.lit(3), part))
    arrivals = [rows.filter(F.col("part") == k).drop("part", "event_id") for k in range(4)] + [keyed.far_record(spark)]
    done = _streamed(spark, arrivals, lambda s: keyed.monitor_sessions(s, THRESHOLD, GAP_MS), keyed.SESSIONS, ("kind",))
    return done.select("kind", "session_id", "begins", "ends", "turns", "max_outbound", "max_original", "turns_over", "outbound_tokens", "original_tokens")


CUT = "(event_id // ((select max(event_id) from events) // {0} + 1))"
UNKNOWN = """x as (select mutation_id, fact_id, ts, action from mutations union all select -mutation_id - 1, -fact_id - 1, ts, action from mutations where fact_id % 91 = 0),
gone as (select fact_id, min(struct_pack(t := ts, m := mutation_id)) as g from mutations where action = 'delete' group by fact_id)"""
ORACLE = {
    "span_memory": f"""with recursive m as (select 's' || user_id as session_id, event_id, 'an event of this kind: ' || event_type || ' ' || (cast(json_extract_string(props, '$.k') as int) % 10) as text, row_number() over (partition by user_id order by ts, event_id) as k from events),
w(session_id, k, held, fresh) as (select session_id, 0::bigint, []::varchar[], false from m where k = 1 union all
  select w.session_id, m.k, case when list_contains(held, m.text) then held else list_append(held, m.text)[-{SPANS}:] end, not list_contains(held, m.text) from w join m on m.session_id = w.session_id and m.k = w.k + 1)
select session_id, event_id, text from w join m using (session_id, k) where fresh""",
    "stream_conflicts": f"""with {fx.FACTS} select a.fact_id, count(*) as n_conflicts, sum(b.fact_id)::bigint as ids from facts a join facts b using (group_id, subject, predicate)
where b.fact_id < a.fact_id and a.object <> b.object and (b.invalid_at is null or b.invalid_at > a.valid_at) and a.fact_id // ((select max(event_id) from events) // 5 + 1) > 0 group by a.fact_id""",
    "stream_changes": mem.ORACLE["attest_fold"].split("\nselect s.fact_id")[0] + """,
z as (select s.fact_id, s.confidence, s.pinned from s left join (select fact_id, max(k) as n from m group by fact_id) c on c.fact_id = s.fact_id where s.k = coalesce(c.n, 0)), i as (select fact_id, min(ts) as i from mutations where action = 'invalidate' group by fact_id)
select group_id, count(*) as n, count(coalesce(f.invalid_at, i.i)) as ended, count(*) filter (z.pinned) as pinned, round(sum(z.confidence), 4) as confidence from facts f join z using (fact_id) left join i using (fact_id) where fact_id not in (select fact_id from mutations where action = 'delete') group by group_id""",
    "unknown_changes": f"with {fx.MUTATIONS}, {UNKNOWN} select mutation_id, x.fact_id from x left join gone using (fact_id) where x.fact_id < 0 or (g is not null and struct_pack(t := ts, m := mutation_id) > g)",
    "session_monitor": f"""with e as (select 's' || user_id as session_id, epoch_us(ts) // 1000 as t, floor(value * 100)::bigint as o, least(floor(value * 100), 900)::bigint as u, event_id, least(3, {CUT.format(4)} + case when event_id % 23 = 0 then 1 else 0 end) as k from events),
x as (select *, coalesce(t < (select max(t) from e b where b.k < e.k) - 1800000, false) as late from e), y as (select *, t - lag(t) over (partition by session_id order by t, event_id) as d from x where not late),
z as (select *, sum(case when d is null or d >= {GAP_MS} then 1 else 0 end) over (partition by session_id order by t, event_id) as w from y)
select 'session' as kind, session_id, min(t) as begins, max(t) + {GAP_MS} as ends, count(*) as turns, max(u) as max_outbound, max(o) as max_original, count(*) filter (u > {THRESHOLD}) as turns_over, null::bigint as outbound_tokens, null::bigint as original_tokens from z group by session_id, w
union all select 'late', session_id, t, null, null, null, null, null, u, o from x where late""",
}
QUERIES = {f.__name__: f for f in (span_memory, stream_conflicts, stream_changes, unknown_changes, session_monitor)}
