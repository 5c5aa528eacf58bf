"""Writers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def delimited(df: DataFrame, path: str, *, sep: str = "\t", header: bool = True, mode: str = "overwrite", single: bool = False) -> None:
    """single: one file, by one task; only for results that are small by nature."""
    if (path.endswith(".csv") and sep != ",") or (path.endswith(".tsv") and sep != "\t"):
        raise ValueError(f"{path} doesn't go with the separator {sep!r}")
    (df.coalesce(1) if single else df).write.csv(path, sep=sep, header=header, mode=mode)


def json_records(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))


def append_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def config_key(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, config: dict, make) -> DataFrame:
    """The table made under this configuration before, or make()'s, written first."""
    path = f"{folder}/{config_key(config)}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
