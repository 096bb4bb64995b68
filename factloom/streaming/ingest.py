"""Structured Streaming jobs over messages, transcripts, facts and token counts.

The batch operators are reused; checkpoints take the place of cursors, watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.quality import ingest_eligible, span_hash
from factloom.sources.transcripts import parse_transcripts


def ingest_messages(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """First sight of each role and text in a tenant and session, for ``messages(group_id, session_id, role, text, event_time)``.

    Short texts and secrets go before anything is remembered. A repeat within the watermark is dropped; state older than
    it is freed, which bounds memory by time.
    """
    rows = ingest_eligible(messages).withColumn("hash", span_hash(F.col("role"), F.col("text")))
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["group_id", "session_id", "hash"])


def late_rows(messages: DataFrame, seen_until: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of a batch that came after their session's watermark, for a side table: ``seen_until(session_id, max_time)``."""
    j = messages.join(seen_until, "session_id", "left")
    return j.filter(F.col("event_time") < F.col("max_time") - F.expr(f"interval {late}")).drop("max_time")


def transcripts_stream(spark: SparkSession, path: str, client: str = "chat") -> DataFrame:
    """New lines of a folder of JSONL files as they arrive; restarting from a checkpoint reads nothing twice."""
    raw = spark.readStream.text(path).withColumn("session_id", F.coalesce(F.get_json_object("value", "$.sessionId"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.jsonl?)?$", 1)))
    return parse_transcripts(raw.select("value", "session_id"), client)


def payload_monitor(records: DataFrame, threshold: int, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Outbound against original tokens per session and window of ``records(session_id, t, original_tokens, outbound_tokens)``."""
    g = records.withWatermark("t", late).groupBy(F.window("t", window), "session_id")
    out = g.agg(F.count("*").alias("turns"), F.max("outbound_tokens").alias("max_outbound"), F.max("original_tokens").alias("max_original"), F.count_if(F.col("outbound_tokens") > threshold).alias("turns_over"))
    return out.select(F.col("window.start").alias("window_start"), "session_id", "turns", "max_outbound", "max_original", "turns_over", (F.col("turns_over") > 0).alias("alert"))


def sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_to(stream: DataFrame, fn: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``fn(batch)``, such as a sink of episodes."""
    return stream.writeStream.foreachBatch(lambda batch, _: fn(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
