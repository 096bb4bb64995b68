"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.storage import shared_folder, stored

__all__ = ["SPACE", "WORD", "crc_mod", "id_as_text", "id_from_text", "shared_folder", "stored", "table", "text_hash", "word_count"]

#: Java character class for the separators of the text contracts.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_as_text(column: str = "doc_id") -> Column:
    """An id on its way to Python, where pandas would make inexact floats of a numeric column with nulls."""
    return F.col(column).cast("string").alias(column)


def id_from_text(made: DataFrame, column: str = "doc_id") -> DataFrame:
    return made.withColumn(column, F.col(column).cast("long"))


def text_hash(column: str = "text") -> Column:
    """With the id it tells rows apart that share an id but not a text; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("text_hash")


def crc_mod(column: str, m: int) -> Column:
    """``crc32(column as text) mod m``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(m))


def word_count(column: str) -> Column:
    """Words between the contract's separators; null text has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")
