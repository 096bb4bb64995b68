"""Exact de-duplication by content-defined chunk recipes (DataFrame functions only).

Every text is normalised and cut at places that its own content decides, so that equal passages give equal chunks
wherever they stand. A chunk is known by a 64-bit hash; the table of distinct (hash, SHA-256) pairs proves that each hash
stands for one content, which makes the hash a verified identifier. Texts are then compared as ordered lists of chunk
identifiers. Texts themselves never enter a shuffle: only identifiers and digests move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACE, stored, text_hash

#: A chunk ends after a mark once it has 256 characters, and has 4,096 at most.
MIN_CHUNK, MAX_CHUNK = 256, 4096
#: Marks: ends of sentences, and for text without them pairs and letters that are rare in their scripts.
MARKS = r"[.!?] |[\u3002\uff01\uff1f]|[jqxzJQXZ0-9][a-f ]|[\u0449\u0444\u03be\u03c8\u0638\u063a\u091e]|[\u5000-\u50ff\u6000-\u60ff\u7000-\u70ff\ub000-\ub0ff]"


def normalised(column: str) -> Column:
    """Null is empty; each run of separators becomes one space."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), SPACE, " ")


def chunks(text: Column) -> Column:
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 2}}}?(?:{MARKS}|$)|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, text_sha256, recipe): the recipe is the ordered list of (chunk hash, chunk SHA-256)."""
    text = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col), normalised(text_col).alias("t"))
    return text.select(
        "doc_id",
        "text_hash",
        F.sha2(F.col("t"), 256).alias("text_sha256"),
        F.transform(chunks(F.col("t")), lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("sha"))).alias("recipe"),
    )


def chunk_identifiers(recipe_table: DataFrame) -> DataFrame:
    """Distinct chunks: (h, n_contents). ``h`` is a verified identifier where ``n_contents`` is 1."""
    distinct = recipe_table.select(F.explode("recipe").alias("c")).select("c.h", "c.sha").distinct()
    return distinct.groupBy("h").agg(F.count("*").alias("n_contents"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, text_hash.

    Null and empty texts are equal to each other and to nothing else; a text of separators alone equals the others of
    its kind. Of equal texts the smallest doc_id stays; rows that repeat that doc_id tie and all stay. Null ids never win
    against others; if a group has only null ids, its rows all stay. An empty table gives an empty result; other columns
    are not looked at.
    """
    made = stored(recipes(docs, id_col, text_col), "recipes")
    shared_hash = chunk_identifiers(made).filter("n_contents > 1").limit(1).count() > 0
    # Two contents under one 64-bit hash: identify chunks by their SHA-256 instead.
    ident = F.transform("recipe", lambda c: c["sha"] if shared_hash else c["h"])
    rows = made.select("doc_id", "text_hash", "text_sha256", F.size("recipe").cast("long").alias("n_chunks"), ident.alias("ids"))
    groups = rows.groupBy("ids").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    several = stored(groups.filter("group_size > 1"), "copies")
    # Only lists that occur twice are joined; the table's size is known, so Spark picks broadcast or a skew-aware merge.
    joined = rows.join(several, "ids", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        "n_chunks",
        "text_hash",
    )


ORACLE = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from t group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from t join g using (t)
"""
