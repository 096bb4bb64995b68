"""The corpus pipeline: toxicity, exact and near copies, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from factloom.llm.common import stored, table, text_hash


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` but the rejected ones. A row is known by its id, null or not, and its text, so rows that share an id
    with a rejected one but not its text stay.

    The rejected ones are written first, so that Spark knows how large they are and picks the join. Columns may have any
    names and come back as they are.
    """
    gone = stored(verdicts.filter("not kept").select(F.struct("doc_id", "text_hash").alias("rejected")).distinct(), "rejected")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # as one struct, its columns clash with nothing
    same = F.col("row.doc_id").eqNullSafe(F.col("rejected.doc_id")) & (text_hash("row.text") == F.col("rejected.text_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier calls toxic go; it learns from the labels outside the held-out fifth.

    Null and empty texts show nothing and stay; each row is judged by its whole text, repeated rows alike.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(~toxicity.toxic("text", model))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for spacing, the row with the smallest id stays.

    Null and empty texts are one text; null ids go if a row with an id has the text. Rows that repeat id and text stay.
    """
    return _without(docs, exact_dedup.exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8.

    Null and empty texts are near nothing and stay. Ties do not occur: the smallest id stays, and rows that repeat it.
    """
    return _without(docs, near_dedup.near_dedup(docs, words=5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is drawn once at least; small sources are repeated up to twice.

    A null source is a source. Rows without words are drawn once in each whole pass. Rows that share an id are drawn alike.
    """
    return mixing.repeat_rows(docs, max_repeats=mixing.MAX_REPEATS)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each drawn document stands: bucket, batch and slot.

    Rows without words stand in the first bucket, longer ones than a batch in one of their own. Each stage gives an empty
    table for an empty table.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", batches),
]

#: The first stage's verdicts come from a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
