"""Micro-batches that skip what a store already has; progress is in the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import insert_ignore

#: The column that a store is partitioned by.
BUCKET = "_bucket"


def append_new(stream: DataFrame, store: str, keys: Sequence[str], checkpoint: str, buckets: int | None = None) -> StreamingQuery:
    """Appends to the Parquet table `store` the rows whose keys it lacks. A batch that is repeated after a failure adds nothing twice.

    buckets: the store is partitioned by a hash of the keys into so many parts, the column BUCKET, and a batch reads
    only the parts that it has rows for. Without, the store has the stream's columns only, and each batch reads its keys.
    """
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, *([T.StructField(BUCKET, T.IntegerType())] if buckets else [])])

    def existing(met: list[int] | None) -> DataFrame:
        try:
            there = spark.read.schema(schema).parquet(store)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)
        return there if met is None else there.filter(F.col(BUCKET).isin(met))

    def write(batch: DataFrame, _: int) -> None:
        if not buckets:
            insert_ignore(existing(None), batch, keys).write.mode("append").parquet(store)
            return
        placed = batch.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        met = [r[0] for r in placed.select(BUCKET).distinct().collect()]  # `buckets` numbers at most
        insert_ignore(existing(met), placed, keys).write.mode("append").partitionBy(BUCKET).parquet(store)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key in time windows; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
