"""Rendezvous hashing of stable record keys over weighted shards.

For every shard a record draws a number from its key and the shard's number alone; the highest weighted draw wins.
Adding a shard adds one draw, so a record either stays or goes to the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Draws have 52 bits, as many as a double holds exactly.
HEX_DIGITS = 13


def _draw(key: Column, shard: int, weight: float) -> Column:
    """-w / ln(u) with u in (0, 1): the shard of the largest is chosen with probability w / sum of weights."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"shard{shard}"), key)), 1, HEX_DIGITS), 16, 10).cast("double")
    return -F.lit(float(weight)) / F.log((number + 0.5) / F.lit(float(16**HEX_DIGITS)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard with the largest draw; the lower number on a tie."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("shards need weights above 0")
    draws = F.array(*(F.struct(_draw(key, i, w).alias("draw"), F.lit(-i).alias("back")) for i, w in enumerate(weights)))
    return (-F.array_max(draws)["back"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, *, added_weight: float = 1.0, slices: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard, its gapless slot there, and its shard if one were added.

    Returns doc_id, size (UTF-8 bytes of the text and 1; null: 1), text_crc32 (null: that of the empty text), law
    ('key'), shard, slot, grown_shard. A null id counts as the key 'null'. Rows that repeat share a shard and get
    slots of their own. The text itself isn't shuffled, however long. An empty table gives an empty result; other
    columns of docs are left out, whatever their names.

    Slots need no sort of a whole shard: rows of a shard are dealt by a hash into slices (64 for each shuffle
    partition over all shards), numbered within a slice, and moved up by the rows of the slices before it; that
    table has shards x slices rows whatever the input.
    """
    spark = docs.sparkSession
    parts = slices or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 64 // len(weights))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
        .withColumns({"shard": rendezvous(key, weights), "grown_shard": rendezvous(key, [*weights, added_weight])})
        .withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    )
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")
    starts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n")).select("shard", "slice", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("number", number)
        .join(F.broadcast(starts), ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"), "grown_shard")
    )
