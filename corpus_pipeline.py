"""A training corpus from the documents table: drop toxic documents, drop low quality, keep one of each near-duplicate
class, pack what is left into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import minhash, packing, quality_rules, toxicity
from loomgraph.llm.shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the whole documents table; keeps the rows of docs that score below 0.7.

    Null and empty texts have no evidence and stay; repeated rows stay; very long texts are scored whole; an empty docs
    gives an empty result. Other columns of docs stay, whatever their names.
    """
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that pass every rule of the policy.

    Null and empty texts are too short and go, repeated rows stay, very long texts are measured whole, an empty docs
    gives an empty result. Other columns of docs stay, whatever their names.
    """
    return quality_rules.kept_rows(docs, "strict-1")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each near-duplicate class; of rows with equal id and text one, whatever else differs.

    Texts without a word are alike only if equal; null counts as empty; a null id stays only in a class without ids.
    Very long texts are compared whole; an empty docs gives an empty result. Other columns stay, whatever their names.
    """
    return minhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, of every row, repeated ones as often as they come; a null or empty text has its end id alone.

    A very long text is moved in sections; an empty docs gives an empty result. Other columns of docs are left out.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: None: SQL can express neither the learned scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
