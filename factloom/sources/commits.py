"""Several tables as one commit: all of a batch is there, or none of it.

A batch's tables are written to folders of their own, then one row in the list of commits names the attempt that counts.
Readers join with that list, so files of attempts that broke off are never seen, and a batch that comes again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_LIST, _ENTRY = "_commits", "batch long, attempt string"


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(batch, attempt) of what counts; an empty table before the first commit."""
    try:
        return spark.read.schema(_ENTRY).parquet(f"{root}/{_LIST}").select("batch", "attempt")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ENTRY)


def commit(root: str, batch: int, tables: dict[str, DataFrame]) -> bool:
    """Write all tables of a batch, then its entry. False, and nothing is written, if the batch has one.

    Batches come one after the other from one writer, as a stream's do. An entry is a folder of its own, written by one
    Spark job, whose commit is what makes it visible.
    """
    spark = next(iter(tables.values())).sparkSession
    if committed(spark, root).filter(F.col("batch") == batch).limit(1).count():
        return False
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}/batch={batch}/attempt={attempt}")
    spark.createDataFrame([(attempt,)], "attempt string").write.mode("overwrite").parquet(f"{root}/{_LIST}/batch={batch}")
    return True


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The committed rows of a table, with their batch. The list of commits prunes the folders that are read."""
    try:
        rows = spark.read.schema(f"{schema}, {_ENTRY}").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
    return rows.join(committed(spark, root), ["batch", "attempt"], "left_semi").drop("attempt")


def commit_stream(stream: DataFrame, root: str, tables: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Each micro-batch as one commit under its number; a batch replayed after a failure is written once."""
    return stream.writeStream.foreachBatch(lambda batch, number: commit(root, number, tables(batch)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
