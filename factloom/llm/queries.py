"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat, exact_dedup, langid, licenses, mixing, near_dedup, packing, quality, search, sharding, spelling, toxicity, urls
from factloom.llm.common import table


def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op2_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op7_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks", "text_hash")


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), max_repeats=mixing.MAX_REPEATS)
    return mixed.withColumn("exponent", F.round("exponent", 9))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    schema = "conv_id long, turn long, role string, text string"
    probe = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], schema)
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat.read_back(chat.format_chats(chats))


def op11_fm_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


def op12_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_matrix_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


#: Lines that :func:`licence_expressions` puts below the texts, what is read of them, and the policy's verdict.
TAGGED = (
    ("MIT", "mit", "true"),
    ("(MIT OR GPL-3.0-only) AND BSD-3-Clause", "( mit or gpl-3.0-only ) and bsd-3-clause", "true"),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2.0-or-later with classpath-exception-2.0", "false"),
    ("Apache-2.0 and (mit", "apache-2.0", "true"),
    ("LGPL-2.1 OR MPL-2.0 OR ISC", "lgpl-2.1 or mpl-2.0 or isc", "true"),
    ("MIT AND LGPL-2.1 OR MPL-2.0 AND ISC", "mit and lgpl-2.1 or mpl-2.0 and isc", "false"),
    ("AND MIT", "", "null"),
)
#: Rules that label a part of what a template covers, so that templates reject the rest.
STRICT = (("block", "net", "/en/1"), ("block", "net", "/en/2"), ("allow", "net", "/fr/"), ("allow", "com", "/en/"), ("block", "org", "/en/3"))


def licence_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a licence tag in a line of its own: the expression that is parsed, and its verdict."""
    line = F.element_at(F.array(*[F.lit(said) for said, _, _ in TAGGED]), (F.pmod("doc_id", F.lit(len(TAGGED))) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n# SPDX-License-Identifier: "), line, F.lit("\nend")).alias("text"))
    found = licenses.license_scan(docs)
    return found.select("doc_id", F.array_join("expressions", ";").alias("expression"), F.when(F.size("expressions") > 0, F.col("allowed")).alias("allowed"))


def strict_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under rules that leave verdicts to rejecting templates."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), STRICT)


QUERIES = {
    f.__name__: f
    for f in (op1_mcd_outliers, op2_nnpu_toxicity, op3_license_scan, op4_length_buckets, op5_byte_cnn, op6_path_templates, op7_chunk_recipes, op8_lsh_forest, op9_temperature_mixing, op10_chat_format, op11_fm_spelling, op12_limited_accumulators, op13_matrix_shuffle, licence_expressions, strict_templates)
}
#: The others rest on trained models, estimates, random draws or CRC-32, which SQL cannot express; the tests compare them with
#: brute force.
ORACLE_SQL = {"op3_license_scan": licenses.oracle(), "op4_length_buckets": packing.oracle(), "op10_chat_format": chat.oracle(), "op6_path_templates": urls.oracle(), "op7_chunk_recipes": exact_dedup.ORACLE, "op8_lsh_forest": near_dedup.ORACLE, "op9_temperature_mixing": mixing.ORACLE, "op12_limited_accumulators": search.ORACLE}
ORACLE_SQL["strict_templates"] = urls.oracle(STRICT)
ORACLE_SQL["licence_expressions"] = f"""select doc_id, {[said for _, said, _ in TAGGED]}[doc_id % {len(TAGGED)} + 1] as expression,
  [{", ".join(v for _, _, v in TAGGED)}][doc_id % {len(TAGGED)} + 1] as allowed from documents"""
