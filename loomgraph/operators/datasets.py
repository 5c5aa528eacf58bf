"""Datasets of facts for models: reading, pruning, id tables, splits, graphs and matrices of them, saving and loading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import packed, unpacked
from .graph import _ids
from .relational import concat, dense_index, encode
from .splits import proportion_split, prune_unseen


@dataclass
class Dataset:
    """facts: subject_id, relation_type, object_id, split, and their indexes s, r, o (timestamps: t); entities, relations, times: id and index."""

    facts: DataFrame
    entities: DataFrame
    relations: DataFrame
    times: DataFrame | None = None


def timestamp_year(column: Column, form: str | None = None) -> Column:
    """The year of a timestamp in text, null where it can't be read."""
    return F.year(F.try_to_timestamp(column, F.lit(form)) if form else F.try_to_timestamp(column))


def with_years(facts: DataFrame, timestamp: str, form: str | None = None) -> DataFrame:
    """facts with the timestamp's year in its place; rows whose timestamp can't be read are left out."""
    return facts.withColumn(timestamp, timestamp_year(F.col(timestamp), form)).dropna(subset=[timestamp])


def temporal_split(facts: DataFrame, at: str, bounds: Mapping[str, tuple[int | None, int | None]]) -> DataFrame:
    """facts with `split`: the first whose bounds hold the value, both ends included (None: open); rows that fit none are left out."""
    split: Column = F.lit(None).cast("string")
    for name, (low, high) in reversed(list(bounds.items())):
        fits = F.lit(True) if low is None else F.col(at) >= low
        fits = fits if high is None else fits & (F.col(at) <= high)
        split = F.when(fits, F.lit(name)).otherwise(split)
    return facts.withColumn("split", split).filter("split is not null")


def mapped(facts: DataFrame, timestamp: str | None = None) -> Dataset:
    """Dense indexes of all entities, relations and timestamps of the facts, shared by all splits, and the facts with them."""
    entities = dense_index(facts.select(F.explode(F.array("subject_id", "object_id")).alias("id")), "id")
    relations = dense_index(facts.select(F.col("relation_type").alias("id")), "id")
    pack, back = _ids(facts, "subject_id")
    out, short = facts.withColumns({c: pack(F.col(c)) for c in ("subject_id", "object_id")}), entities.withColumn("id", pack(F.col("id")))
    for column, table, name in (("subject_id", short, "s"), ("relation_type", relations, "r"), ("object_id", short, "o")):
        out = encode(out, column, table, "id", "index", name)
    out = out.withColumns({c: back(F.col(c)) for c in ("subject_id", "object_id")})
    if timestamp is None:
        return Dataset(out, entities, relations)
    times = dense_index(facts.select(F.date_format(F.make_date(F.col(timestamp), F.lit(1), F.lit(1)), "yyyy").alias("id")), "id")
    placed = encode(out.withColumn("_year", F.date_format(F.make_date(F.col(timestamp), F.lit(1), F.lit(1)), "yyyy")), "_year", times, "id", "index", "t").drop("_year")
    return Dataset(placed, entities, relations, times)


def from_facts(facts: DataFrame, *, shares: Sequence[float] | None = None, order: str | None = None, bounds: Mapping[str, tuple[int | None, int | None]] | None = None, timestamp: str | None = None, prune: bool = True) -> Dataset:
    """A dataset of one table of facts: split by shares in the order of a unique column, or by bounds of the timestamp's year.

    prune: facts of other splits than the first need ends that the first one has.
    """
    names = list(bounds) if bounds else ["train", "val", "test"]
    split = temporal_split(facts, timestamp, bounds) if bounds else proportion_split(facts, order, shares, names)
    if prune:
        train = split.filter(F.col("split") == names[0])
        split = train.unionByName(prune_unseen(split.filter(F.col("split") != names[0]), train))
    return mapped(split, timestamp)


def from_splits(frames: Mapping[str, DataFrame], timestamp: str | None = None) -> Dataset:
    """A dataset of one table for each split; indexes are those of their union."""
    return mapped(concat([df.withColumn("split", F.lit(name)) for name, df in frames.items()]), timestamp)


def in_time_order(facts: DataFrame, at: str = "t") -> DataFrame:
    """Facts by timestamp, then by their ids: a sort over range parts."""
    return facts.orderBy(at, "subject_id", "relation_type", "object_id")


def by_target(facts: DataFrame) -> DataFrame:
    """Edges in parts of neighbouring objects, each sorted by object and subject, as sparse columns are laid out."""
    return facts.repartitionByRange("o", "s").sortWithinPartitions("o", "s")


def relation_lists(facts: DataFrame) -> DataFrame:
    """(subject_id, object_id, relations): a simple graph's edges, each with the sorted list of its relations, repeats kept."""
    return facts.groupBy("subject_id", "object_id").agg(F.sort_array(F.collect_list("relation_type")).alias("relations"))


def build_graph(facts: DataFrame, *, directed: bool = True, multi: bool = True) -> DataFrame:
    """(src, rel, dst) of facts: each once for a multigraph; one edge a pair, with its least relation, for a simple graph. Undirected ones have the lesser end first."""
    edges = facts.select(F.col("subject_id").alias("src"), F.col("relation_type").alias("rel"), F.col("object_id").alias("dst"))
    if not directed:
        edges = edges.select(F.least("src", "dst").alias("src"), "rel", F.greatest("src", "dst").alias("dst"))
    pack, back = _ids(edges, "src")
    edges = edges.select(pack(F.col("src")).alias("src"), "rel", pack(F.col("dst")).alias("dst"))
    edges = edges.distinct() if multi else edges.groupBy("src", "dst").agg(F.min("rel").alias("rel"))
    return edges.select(back(F.col("src")).alias("src"), "rel", back(F.col("dst")).alias("dst"))


def ordered_matrix(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """(index, vector) in the index's order; raises if an id of the index has no vector. index: id, index; vectors: id, vector."""
    joined = index.join(vectors.select("id", "vector"), "id", "left")
    if not (lost := joined.filter("vector is null").limit(1)).isEmpty():
        raise KeyError(f"no vector for {lost.first()['id']}")
    return joined.select("index", "vector").orderBy("index")


def domain_indexes(nodes: DataFrame, domains: DataFrame) -> DataFrame:
    """Distinct nodes (node_id, node_domain) with their domain's index, null where it has none; domains: id, index."""
    return nodes.select("node_id", "node_domain").distinct().join(domains.select(F.col("id").alias("node_domain"), F.col("index").alias("domain_index")), "node_domain", "left").select("node_id", "domain_index")


def degrees_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree) of the nodes asked for, 0 without edges; edges are cut to theirs before they are counted."""
    asked = nodes.select("node_id").distinct()
    ends = [
        edges.select(F.col(c).alias("node_id"), F.lit(i).alias("i"), F.lit(o).alias("o")).join(asked, "node_id", "left_semi")
        for c, i, o in (("object_id", 1, 0), ("subject_id", 0, 1))
    ]
    counts = ends[0].unionByName(ends[1]).groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return asked.join(counts, "node_id", "left").select("node_id", zero("in_degree"), zero("out_degree"))


def unique_values(df: DataFrame, column: str, nulls: bool = True) -> DataFrame:
    """The distinct values, with null as one of them or without."""
    out = df.select(column).distinct()
    return out if nulls else out.dropna()


def vertex_hash(name: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of a name's md5."""
    return F.substring(F.md5(name), 1, digits)


def literal(text: Column) -> Column:
    """A query answer's literal: number if it reads as one, else its text without quotes, type and language."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(@[A-Za-z-]+|\^\^\S+)$", ""), r'^"|"$', "")
    return F.struct(plain.try_cast("double").alias("number"), plain.alias("text"))


def decode(df: DataFrame, column: str, index: DataFrame, name: str) -> DataFrame:
    """df with the id behind an index; null for an index that isn't there."""
    return df.join(index.select(F.col("index").alias(column), F.col("id").alias(name)), column, "left")


def fact_table(edges: DataFrame, dataset: Dataset) -> DataFrame:
    """(subject_id, relation_type, object_id) of indexed edges (s, r, o)."""
    out, short = edges, dataset.entities.withColumn("id", packed(F.col("id")))
    for column, table, name in (("s", short, "subject_id"), ("r", dataset.relations, "relation_type"), ("o", short, "object_id")):
        out = decode(out, column, table, name)
    return out.select(unpacked(F.col("subject_id")).alias("subject_id"), "relation_type", unpacked(F.col("object_id")).alias("object_id"))


def save(dataset: Dataset, folder: str) -> None:
    """Facts by split and the id tables as Parquet, for load(); a folder that is there is replaced."""
    dataset.facts.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/facts")
    for name in ("entities", "relations", "times"):
        if (table := getattr(dataset, name)) is not None:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> Dataset:
    def table(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    return Dataset(table("facts"), table("entities"), table("relations"), table("times"))


def complete_domains(ledger: DataFrame, markers: DataFrame, wanted: DataFrame, predict: Column) -> DataFrame:
    """wanted triples with `score`: the ledger's; 0 where it has none but its object's whole (subject, relation) is marked complete; else the prediction.

    ledger: subject_id, relation_type, object_id, score; markers: subject_id, relation_type.
    """
    key = ["subject_id", "relation_type", "object_id"]
    known = ledger.select(*key, F.col("score").alias("_known"))
    whole = markers.select("subject_id", "relation_type").distinct().withColumn("_whole", F.lit(True))
    met = wanted.join(known, key, "left").join(whole, ["subject_id", "relation_type"], "left")
    return met.withColumn("score", F.when(F.col("_known").isNotNull(), F.col("_known")).when(F.col("_whole"), F.lit(0.0)).otherwise(predict)).drop("_known", "_whole")
