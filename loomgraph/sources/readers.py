"""Readers with explicit schemas; malformed rows are kept apart, not guessed at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

CORRUPT = "_corrupt"


def delimited(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, *, sep: str = "\t", header: bool = True, encoding: str = "UTF-8", names: Sequence[str] | None = None, use: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.csv([paths] if isinstance(paths, str) else list(paths), schema=schema, sep=sep, header=header, encoding=encoding)
    if names is not None:
        if len(names) != len(df.columns):
            raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
        df = df.toDF(*names)
    return df.select(*use) if use else df


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, schemas.NODES)


def edges(spark: SparkSession, path: str, filter_null_years: bool = True) -> DataFrame:
    df = delimited(spark, path, schemas.EDGES)
    return df.filter("year is not null") if filter_null_years else df


def edges_by_year(spark: SparkSession, path: str) -> DataFrame:
    """Edges with their years joined by |, as a row for each year."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("subject_id", "object_id", "relation_type", "year_occurrences")] + [T.StructField("number_of_occurrences", T.IntegerType())])
    return delimited(spark, path, schema).withColumn("year", F.explode(F.split("year_occurrences", r"\|").cast("array<int>")))


def ndjson(spark: SparkSession, path: str, schema: T.StructType, *, valid: bool = True) -> DataFrame:
    """Rows that parse; with valid=False those that don't, as text."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    if valid:
        df = spark.read.json(path, schema=full, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        return df.withColumn("_kept", F.col(CORRUPT)).filter("_kept is null").select(*schema.fieldNames())
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return spark.read.text(path).filter((F.trim("value") != "") & parsed[CORRUPT].isNotNull()).select(F.col("value").alias("line"))


def publications(spark: SparkSession, path: str, parquet: bool = False) -> DataFrame:
    """Strings trimmed; authors without a name dropped; only rows with a positive year and an author. NDJSON, or Parquet."""
    df = spark.read.schema(schemas.PUBLICATIONS).parquet(path) if parquet else ndjson(spark, path, schemas.PUBLICATIONS)
    df = df.withColumns({c: F.trim(c) for c in ("pmid", "title", "abstract", "doi")})
    named = F.filter("authors", lambda a: (F.coalesce(F.trim(a["first_name"]), F.lit("")) != "") | (F.coalesce(F.trim(a["last_name"]), F.lit("")) != ""))
    return df.withColumn("authors", named).filter((F.col("year") > 0) & (F.size("authors") > 0))


def publication_links(spark: SparkSession, path: str, parquet: bool = False) -> DataFrame:
    """Links with both ids. NDJSON, or Parquet."""
    return (spark.read.schema(schemas.LINKS).parquet(path) if parquet else ndjson(spark, path, schemas.LINKS)).dropna()


def row_count(spark: SparkSession, path: str, header: bool = True) -> int:
    """Records of a delimited file, quoted line ends counted as text; without the header of each file."""
    return spark.read.csv(path, header=header, multiLine=True).count()


def n_triples(spark: SparkSession, path: str, skip: Sequence[str] = ()) -> DataFrame:
    """(src, rel, dst) of N-Triples lines; comments and other lines are passed over."""
    line = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.+?)\s*\.\s*$"
    part = lambda k: F.regexp_replace(F.regexp_extract("value", line, k), r"^<|>$", "")
    return spark.read.text(path).filter(F.col("value").rlike(line)).select(part(1).alias("src"), part(2).alias("rel"), part(3).alias("dst")).filter(~F.col("rel").isin(list(skip)))


def edge_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Edge-cache files; the start of a file's name gives the direction."""
    df = spark.read.json(folder, schema=schemas.EDGE_CACHE)
    return df.withColumn("direction", F.regexp_extract(F.input_file_name(), r"/(in|out)_[^/]*$", 1))


def relation_rules(spark: SparkSession, path: str) -> DataFrame:
    """Relations that a JSONL rule file keeps or swaps, in capitals with underscores: (original, relation, swap)."""
    rules = spark.read.json(path, schema="relation string, action string, new_relation string")
    name = lambda c: F.regexp_replace(F.upper(F.trim(c)), r"\s+", "_")
    return rules.filter(F.upper("action").isin("KEEP", "SWAP")).select(name(F.col("relation")).alias("original"), name(F.coalesce("new_relation", "relation")).alias("relation"), (F.upper("action") == "SWAP").alias("swap")).distinct()


def hypothesis_files(spark: SparkSession, folder: str) -> DataFrame:
    """Hypothesis CSV files of a folder tree: ids in brackets from the pair's text, score, relation in capitals, kind from the file's name."""
    df = spark.read.csv(folder, schema="pair string, relation string, score double", header=True, recursiveFileLookup=True)
    ids = F.regexp_extract_all("pair", F.lit(r"\[([^\]]+)\]"), 1)
    return df.select(F.get(ids, F.lit(0)).alias("subject"), F.get(ids, F.lit(1)).alias("object"), F.upper("relation").alias("relation"), "score", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("kind")).dropna()
