"""The operators' inputs, derived from the shipped tables: once in Spark, once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = "2024-01-20 00:00:00"
SCOPE = "g1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id")).first()[0]
    vectors = table(spark, sf_dir, "embeddings").count()
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fact_id"),
        F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("group_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string")).alias("object"),
        ts.alias("valid_at"),
        F.when(F.col("event_id") % 3 == 0, ts + F.expr("interval 5 days")).alias("invalid_at"),
        F.concat(F.lit("T"), (1 + F.col("event_id") % 4).cast("string")).alias("tier"),
        (F.lit(0.6) + (F.col("event_id") % 5) * F.lit(0.1)).cast("double").alias("confidence"),
        (F.col("event_id") % 7 == 0).alias("pinned"),
        ((F.col("event_id") % chats) * 100).alias("source_episode_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")).alias("session_id"),
        (F.col("event_id") % vectors).alias("vec_id"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20; they ask the four tenants and all tenants in turn."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.expr("case when vec_id div 20 % 5 = 4 then '*' else concat('g', vec_id div 20 % 5) end").alias("scope"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("episode_id"),
        F.concat(F.lit("g"), (F.col("conv_id") % 4).cast("string")).alias("group_id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"),
        F.concat(F.lit("msg:"), "role").alias("source"),
        "text",
        F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id * 10 + turn as int))").alias("event_time"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    pure = (F.col("role") == "user") & (F.col("turn") % 4).isin(2, 3)
    return c.select("conv_id", F.col("turn").alias("msg_idx"), "role", "text", pure.alias("pure_tool_result"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lit(0).cast("long").alias("gid"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("c"), ((F.col("o_orderkey") * 7919) % n).cast("string")).alias("dst"),
    ).distinct()


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attestations of some facts, one of them a correction, and invalidations."""
    f = facts(spark, sf_dir).select("fact_id", "valid_at")
    picks = [("confirmed", 11, 1), ("corrected", 13, 1), ("confirmed", 26, 2), ("invalidate", 17, 1), ("invalidate", 34, 3), ("delete", 19, 1)]
    parts = [
        f.filter(F.col("fact_id") % m == 0).select((F.col("fact_id") * 10 + k).alias("mutation_id"), "fact_id", F.lit(a).alias("action"), F.expr(f"valid_at + interval {d} days").alias("ts"), F.lit(f"r{k}").alias("reason"), F.concat(F.lit("a"), (F.col("fact_id") % 3).cast("string")).alias("actor"))
        for k, (a, m, d) in enumerate(picks)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of original and outbound tokens for each event; its user is the session."""
    tokens = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").cast("timestamp").alias("t"), tokens.alias("original_tokens"), F.least(tokens, F.lit(900)).cast("long").alias("outbound_tokens"))


FACTS = """facts as (select event_id as fact_id, 'g' || (user_id % 4) as group_id, 'u' || user_id as subject, event_type as predicate,
  'k' || (cast(json_extract_string(props, '$.k') as int) % 10) as object, ts as valid_at, case when event_id % 3 = 0 then ts + interval 5 days end as invalid_at,
  'T' || (1 + event_id % 4) as tier, cast(0.6 as double) + (event_id % 5) * cast(0.1 as double) as confidence, (event_id % 7 = 0) as pinned,
  (event_id % (select count(distinct conv_id) from conversations)) * 100 as source_episode_id, 's' || (user_id % 9) as session_id,
  event_id % (select count(*) from embeddings) as vec_id from events)"""
EPISODES = """episodes as (select conv_id * 100 + turn as episode_id, 'g' || (conv_id % 4) as group_id, 'c' || conv_id as session_id, 'msg:' || role as source, text,
  timestamp '2024-01-01' + to_minutes(cast(conv_id * 10 + turn as int)) as event_time from conversations)"""
MESSAGES = """messages as (select conv_id, turn as msg_idx, role, text, (role = 'user' and turn % 4 in (2, 3)) as pure_tool_result from conversations where role <> 'system')"""
EDGES = """edges as (select distinct 0::bigint as gid, 'c' || o_custkey as src, 'c' || ((o_orderkey * 7919) % (select count(*) from customer)) as dst from orders)"""
MUTATIONS = FACTS + """,
mutations as (
  select fact_id * 10 + 0 as mutation_id, fact_id, 'confirmed' as action, valid_at + interval 1 day as ts, 'r0' as reason, 'a' || (fact_id % 3) as actor from facts where fact_id % 11 = 0
  union all select fact_id * 10 + 1, fact_id, 'corrected', valid_at + interval 1 day, 'r1', 'a' || (fact_id % 3) from facts where fact_id % 13 = 0
  union all select fact_id * 10 + 2, fact_id, 'confirmed', valid_at + interval 2 days, 'r2', 'a' || (fact_id % 3) from facts where fact_id % 26 = 0
  union all select fact_id * 10 + 3, fact_id, 'invalidate', valid_at + interval 1 day, 'r3', 'a' || (fact_id % 3) from facts where fact_id % 17 = 0
  union all select fact_id * 10 + 4, fact_id, 'invalidate', valid_at + interval 3 days, 'r4', 'a' || (fact_id % 3) from facts where fact_id % 34 = 0
  union all select fact_id * 10 + 5, fact_id, 'delete', valid_at + interval 1 day, 'r5', 'a' || (fact_id % 3) from facts where fact_id % 19 = 0)"""
QUERIES = "queries as (select vec_id as query_id, embedding as q, case when vec_id // 20 % 5 = 4 then '*' else 'g' || (vec_id // 20 % 5) end as scope from embeddings where vec_id % 20 = 0)"
