"""Data-quality checks, secrets, questions and span identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip
from factloom.schemas import MODES, RESOLUTIONS, TIERS

# Markers of secrets, in the order of their names.
SECRETS = {
    "private_key": r"-----BEGIN (RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----",
    "ant_key": r"sk-ant-[A-Za-z0-9_-]{40,}",
    "sk_key": r"sk-[A-Za-z0-9]{40,}",
    "access_key_id": r"AKIA[0-9A-Z]{16}",
    "access_token": r"ghp_[A-Za-z0-9]{30,}",
    "chat_token": r"xox[bpoa]-[A-Za-z0-9-]{20,}",
}
# First words of questions.
QUESTION_WORDS = ("what", "why", "when", "where", "who", "how", "which", "is", "are", "do", "does", "should", "can")
LEAST_CHARS = 20


def secret_kind(text: Column) -> Column:
    """The first kind of secret that a text shows, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECRETS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def flag_secrets(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("secret", secret_kind(F.col(col)))


def is_question(text: Column) -> Column:
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return F.contains(t, F.lit("?")) | F.element_at(F.split(t, " "), 1).isin(*QUESTION_WORDS)


def ingest_eligible(df: DataFrame, col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """Rows whose text is long enough and shows no secret."""
    return df.filter((F.length(col) >= least) & secret_kind(F.col(col)).isNull())


def span_hash(role: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", role, F.coalesce(text, F.lit(""))), 256)


def block_hash(role: Column, blocks: Column) -> Column:
    """SHA-256 of role and blocks; JSON inside blocks counts by its entries, not by their order."""
    keyed = F.transform(
        blocks,
        lambda b: F.to_json(
            F.struct(
                *[b[c].alias(c) for c in ("type", "text", "media_type", "data_b64", "url", "tool_use_id", "tool_name", "result_text", "is_error", "original_type", "payload")],
                F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(b["tool_input"], "map<string,string>"))))), b["tool_input"]).alias("tool_input"),
            )
        ),
    )
    return F.sha2(F.concat_ws("\x1f", role, F.array_join(keyed, "\x1e")), 256)


def first_spans(messages: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First sight of each role and text in a key; short texts and secrets go before anything is remembered."""
    rows = ingest_eligible(messages).withColumn("hash", span_hash(F.col("role"), F.col("text")))
    return rows.groupBy(*keys, "hash").agg(F.min(F.struct(order, "role", "text")).alias("m")).select(*keys, "hash", "m.*")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def wrong_dimension(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    return df.filter(F.col(col).isNull() | (F.size(col) != dim))


def not_accepted(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(*values))


def out_of_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.filter(F.col(col).isNull() | ~F.col(col).between(lo, hi))


def verdict_budget(requests: DataFrame, most: int = 8) -> DataFrame:
    """Requests over their conflicts, and queries with more than one request."""
    many = requests.filter(F.col("n_conflicts") > most).select("query_id", F.lit("too many conflicts").alias("why"))
    return many.unionByName(duplicates(requests, ["query_id"]).select("query_id", F.lit("more than one verdict").alias("why")))


def bad_resolutions(verdicts: DataFrame) -> DataFrame:
    return not_accepted(verdicts, "resolution", RESOLUTIONS)


def split_tool_pairs(kept: DataFrame) -> DataFrame:
    """Tool uses without their result and results without their use, among kept (conv_id, use_id, result_id)."""
    u = kept.filter("use_id is not null").select("conv_id", F.col("use_id").alias("id"))
    r = kept.filter("result_id is not null").select("conv_id", F.col("result_id").alias("id"))
    return u.exceptAll(r).withColumn("side", F.lit("use")).unionByName(r.exceptAll(u).withColumn("side", F.lit("result")))


def bad_modes(requests: DataFrame) -> DataFrame:
    return not_accepted(requests, "mode", MODES)


def bad_confidences(verdicts: DataFrame) -> DataFrame:
    return out_of_range(verdicts, "confidence", 0.0, 1.0)


def violations(facts: DataFrame, episodes: DataFrame, vectors: DataFrame, dim: int, entities: DataFrame) -> DataFrame:
    """(rule, violations): how many rows or keys break each rule. Entities are (group_id, name)."""
    parts = {
        "fact_id is unique": duplicates(facts, ["fact_id"]),
        "entity is unique": duplicates(entities, ["group_id", "name"]),
        "episode_id is unique": duplicates(episodes, ["episode_id"]),
        "tier is known": not_accepted(facts, "tier", TIERS),
        "confidence is in range": out_of_range(facts, "confidence", 0.6, 1.0),
        "interval is not empty": facts.filter("invalid_at <= valid_at"),
        "embedding has its dimension": wrong_dimension(vectors, dim),
    }
    out = None
    for rule, rows in parts.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
