"""Cleaning of literature relations and their aggregation over years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_id, relation_id, strip_quotes
from .relational import filter_by_value, split_column

RAW = ("domain_pipe_subject_id_raw", "domain_pipe_object_id_raw")


def clean_relations(relations: DataFrame) -> DataFrame:
    """Distinct rows without quotes, DOMAIN|id split, rows with a null part or the sentinel '-' dropped, ids hashed, domains and relations in capitals."""
    df = relations.distinct().withColumns({c: strip_quotes(F.col(c)) for c in RAW})
    df = split_column(split_column(df, RAW[0], "subject_domain", "subject_raw"), RAW[1], "object_domain", "object_raw")
    parts = ["subject_domain", "subject_raw", "object_domain", "object_raw"]
    df = filter_by_value(df.dropna(subset=["pmid", "relation_type", *parts]), parts, "-")
    df = df.withColumns({"subject_id": entity_id(F.col(RAW[0])), "object_id": entity_id(F.col(RAW[1]))})
    df = df.withColumns({c: F.upper(c) for c in ("subject_domain", "object_domain", "relation_type")})
    return df.withColumn("relation_id", relation_id(F.col("subject_id"), F.col("relation_type"), F.col("object_id")))


def attach_year(relations: DataFrame, years: DataFrame) -> DataFrame:
    """Inner join on pmid: relations of unknown years are dropped."""
    return relations.join(years.select("pmid", F.col("year").cast("int").alias("year")), "pmid")


def aggregate_years(relations: DataFrame) -> DataFrame:
    """One row for each (subject, relation, object): first year, occurrences (distinct year and pmid), sorted years and pmids joined by |."""
    facts = relations.dropDuplicates(["subject_id", "relation_type", "object_id", "year", "pmid"])
    return facts.groupBy("subject_id", "relation_type", "object_id").agg(
        F.min("year").alias("year"),
        F.count("*").alias("number_of_occurrences"),
        F.array_join(F.transform(F.sort_array(F.collect_set("year")), lambda y: y.cast("string")), "|").alias("year_occurrences"),
        F.array_join(F.transform(F.sort_array(F.collect_set("pmid")), lambda p: p.cast("string")), "|").alias("pmids"),
        F.min("subject_domain").alias("subject_domain"),
        F.min("object_domain").alias("object_domain"),
    )


def collisions(df: DataFrame, id_col: str, original: str) -> DataFrame:
    """Ids that stand for more than one original value."""
    return df.groupBy(id_col).agg(F.count_distinct(original).alias("n_originals")).filter("n_originals > 1")


def multi_label(nodes: DataFrame, id_col: str, label: str) -> DataFrame:
    return nodes.groupBy(id_col).agg(F.array_join(F.sort_array(F.collect_list(label)), "|").alias("labels"))


def last_edge(edges: DataFrame, position: str) -> DataFrame:
    """Of edges with the same ends and relation, the one written last."""
    w = Window.partitionBy("subject_id", "relation_type", "object_id").orderBy(F.desc(position))
    return edges.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def entity_domains(edges: DataFrame, position: str) -> DataFrame:
    """Each entity's domain where it is seen first, as subject before object in one row."""
    seen = edges.select(F.explode(F.array(F.struct(F.col("subject_id").alias("entity"), F.col("subject_domain").alias("domain"), F.col(position).alias("p"), F.lit(0).alias("side")), F.struct(F.col("object_id").alias("entity"), F.col("object_domain").alias("domain"), F.col(position).alias("p"), F.lit(1).alias("side")))).alias("x")).select("x.*")
    return seen.groupBy("entity").agg(F.min_by("domain", F.struct("p", "side")).alias("domain"))


def annotations(records: DataFrame) -> DataFrame:
    """Annotations of parsed JSON records: a row for each entity mention with its place."""
    p = records.select("id", F.explode("passages").alias("p"))
    a = p.select("id", F.explode("p.annotations").alias("a"))
    return a.select("id", F.coalesce("a.infons.name", "a.text").alias("name"), F.col("a.text").alias("mention"), F.col("a.infons.type").alias("type"), F.col("a.infons.identifier").alias("entity"), F.get("a.locations", F.lit(0))["offset"].alias("start"), (F.get("a.locations", F.lit(0))["offset"] + F.get("a.locations", F.lit(0))["length"]).alias("end"))
