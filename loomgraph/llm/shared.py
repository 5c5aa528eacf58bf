"""Helpers that several text operators share: shared-folder tables, Arrow batches, running totals."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that Python code holds decoded at once.
ROWS_AT_ONCE = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only for local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Cuts lineage: df written as Parquet in the shared folder, and read again.

    few: by twice as many tasks at most as run at once. For tables of a round that are small beside the input: many
    partitions would each make, name and protect a file of a few rows.
    """
    path = new_folder(df.sparkSession, name)
    if few:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `rows`, so that few texts are decoded at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: int | str) -> list[str]:
    """A column's texts; null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def few_collections() -> None:
    """For workers that keep many small objects and make no cycles: the collector would scan them over and over."""
    gc.set_threshold(200_000, 50, 50)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns, under fixed names: other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
