"""Looking up the n-th answer to a request in long conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_request(text: Column) -> Column:
    """Lower case, single spaces, ``write an`` read as ``write a``."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(plain.startswith("write an "), F.concat(F.lit("write a "), F.substring(plain, 10, 2_000_000_000))).otherwise(plain)


def turn_pairs(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, pair_index, user_text, assistant_text, user_idx, assistant_idx): user rows directly followed by an answer."""
    order = Window.partitionBy(conv).orderBy("msg_idx")
    m = messages.withColumns({"n_role": F.lead("role").over(order), "n_text": F.lead("text").over(order), "n_idx": F.lead("msg_idx").over(order)})
    m = m.filter("role = 'user' and n_role = 'assistant'")
    return m.select(conv, (F.row_number().over(order) - 1).alias("pair_index"), F.col("text").alias("user_text"), F.col("n_text").alias("assistant_text"), F.col("msg_idx").alias("user_idx"), F.col("n_idx").alias("assistant_idx"))


def _key_groups(pairs: DataFrame, lookups: DataFrame, conv: str) -> DataFrame:
    """(lookup_id, conv, position, key): the lookup's own text if asked for verbatim, else the first text that is the same normalised."""
    keys = pairs.groupBy(conv, "user_text").agg(F.min("pair_index").alias("first")).withColumn("norm", normalize_request(F.col("user_text")))
    exact = lookups.join(keys.select(conv, F.col("user_text").alias("request")), [conv, "request"]).select("lookup_id", conv, "position", F.col("request").alias("key"))
    rest = lookups.join(exact.select("lookup_id"), "lookup_id", "left_anti").withColumn("norm", normalize_request(F.col("request")))
    loose = rest.join(keys, [conv, "norm"]).groupBy("lookup_id", conv, "position").agg(F.min_by("user_text", "first").alias("key"))
    return exact.unionByName(loose)


def nth_needle(pairs: DataFrame, lookups: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(lookup_id, found, candidates) for lookups (lookup_id, conv, request, position from 1); null out of range."""
    chosen = _key_groups(pairs, lookups, conv)
    order = Window.partitionBy(conv, "user_text").orderBy("pair_index")
    p = pairs.withColumn("n", F.row_number().over(order)).select(conv, F.col("user_text").alias("key"), "n", "assistant_text")
    counts = p.groupBy(conv, "key").agg(F.count("*").alias("candidates"))
    out = chosen.join(counts, [conv, "key"]).join(p.withColumnRenamed("n", "position"), [conv, "key", "position"], "left")
    done = lookups.select("lookup_id").join(out.select("lookup_id", "assistant_text", "candidates"), "lookup_id", "left")
    return done.select("lookup_id", F.col("assistant_text").alias("found"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def needle_answer(found: Column, prefix: Column) -> Column:
    """The prefix before what was found; empty if nothing was."""
    return F.coalesce(F.concat(prefix, found), F.lit(""))
