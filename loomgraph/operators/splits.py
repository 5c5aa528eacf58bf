"""Temporal and proportional splits, id tables, labels and batches for models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import year_start
from .graph import _ids, forget, in_order, stored, stored_by, stored_with
from .walks import Name, as_text, draw, uniform


def between_years(facts: DataFrame, start: str | None, end: str | None, year: str = "year") -> DataFrame:
    """start <= January 1 of the year < end; either bound may be left out."""
    date = year_start(F.col(year))
    if start is not None:
        facts = facts.filter(date >= F.lit(start).cast("date"))
    return facts if end is None else facts.filter(date < F.lit(end).cast("date"))


def proportion_split(df: DataFrame, order: str, shares: Sequence[float], names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Contiguous slices in ascending order of a unique column: int(rows x share) rows each, and what is left in the last."""
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("the shares must sum to 1")
    placed = in_order(df, order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part")
    before = sizes.select("_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    split: Column = F.lit(names[len(shares) - 1])
    for k in range(len(shares) - 1, 0, -1):
        end = sum((F.floor(F.col("_all") * F.lit(s)) for s in shares[:k]), F.lit(0))
        split = F.when(F.col("_at") < end, F.lit(names[k - 1])).otherwise(split)
    return placed.join(F.broadcast(before), "_part").withColumn("_at", at).select(*df.columns, split.alias("split"))


def prune_unseen(facts: DataFrame, train: DataFrame) -> DataFrame:
    """Facts whose ends both occur in the training facts."""
    seen = train.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    return facts.join(seen.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(seen.withColumnRenamed("id", "object_id"), "object_id", "left_semi")


def used_nodes(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    used = facts.select(F.explode(F.array("subject_id", "object_id")).alias("node_id")).distinct()
    return nodes.join(used, "node_id", "left_semi")


def history_labels(facts: DataFrame, pair: Sequence[str], relation: str, time: str) -> DataFrame:
    """Relations that the pair had strictly earlier, and the fact's own, sorted."""
    w = Window.partitionBy(*pair).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    return facts.withColumn("labels", F.sort_array(F.array_union(F.collect_set(relation).over(w), F.array(relation))))


def timestamp_batches(facts: DataFrame, time: str, order: str, size: int) -> DataFrame:
    """Batches of at most `size` rows of one timestamp, in ascending order of a unique column.

    Rows are range-partitioned by timestamp and order and numbered inside their part; a table with a row for each part
    and timestamp moves the numbers up, so that a timestamp with most of the rows is numbered by many tasks.
    """
    placed = stored(facts.repartitionByRange(F.col(time), F.col(order)).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(time, "_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col(time).alias("_time"), "_part", (F.sum("_n").over(Window.partitionBy(time).orderBy("_part")) - F.col("_n")).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_part", time).orderBy(order))
    numbered = placed.withColumn("_row", row).join(before.withColumnRenamed("_part", "_of"), F.col(time).eqNullSafe(F.col("_time")) & (F.col("_part") == F.col("_of")))
    return numbered.select(*facts.columns, F.floor((F.col("_before") + F.col("_row") - 1) / size).cast("long").alias("batch"))


def corrupt_one_slot(facts: DataFrame, entities: DataFrame, relations: DataFrame, known: DataFrame, negatives: int, chances: Sequence[float] = (1 / 3, 1 / 3, 1 / 3), seed: int = 0, *, name: Name = as_text) -> DataFrame:
    """(subject_id, relation_type, object_id, k, slot): `negatives` rows for each fact, with just one slot of it replaced.

    The slot (s, r or o) is drawn with the given chances, its new value from the index (id, index from 0) of entities or
    relations. While the triple is a known fact, as the fact itself is, the next value of the index takes its place; so
    no row is lost, unless every value makes a known fact: then ValueError. Draws are hashes of seed, fact and k.
    name: the texts that are drawn by, made of subjects and objects where these are numbers; the texts are not moved.
    Known facts are dealt by their triple once; those that are repeated are made distinct where they are.
    """
    if abs(sum(chances) - 1) > 1e-9:
        raise ValueError("the chances must sum to 1")
    key = ["subject_id", "relation_type", "object_id"]
    n_entities, n_relations = entities.count(), relations.count()
    if not n_entities or not n_relations:
        return facts.select(*key, F.lit(0).alias("k"), F.lit("").alias("slot")).limit(0)
    pack, back = _ids(facts, "subject_id")
    ends = lambda df: df.select(pack(F.col("subject_id")).alias("subject_id"), "relation_type", pack(F.col("object_id")).alias("object_id"))
    known = stored_by(ends(known), *key)
    names = stored(entities.select(F.col("index").cast("long").alias("at"), pack(F.col("id")).alias("_new")))
    relations = stored(relations.select(F.col("index").cast("long").alias("at"), F.col("id").alias("_new")))
    of = (f"{seed}", name(F.col("subject_id")), F.col("relation_type"), name(F.col("object_id")), F.col("k"))
    u = uniform(*of, "slot")
    slot = F.when(u < chances[0], "s").when(u < chances[0] + chances[1], "r").otherwise("o")
    size = F.when(F.col("slot") == "r", F.lit(n_relations)).otherwise(F.lit(n_entities))
    asked = facts.select(*key, F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("k")).withColumn("slot", slot).withColumn("at", F.pmod(draw(*of, "value"), size))
    kept = [F.when(F.col("slot") != x, c if x == "r" else pack(c)).alias(n) for (n, c), x in zip(((n, F.col(n)) for n in key), "sro", strict=True)]
    done, open_, tries = [], asked.select(*kept, "k", "slot", "at"), 0
    while True:  # in an open row, the slot to fill is null
        fill = lambda df, slots: df.select(*(F.when(F.col("slot") == x, F.col("_new")).otherwise(F.col(c)).alias(c) if x in slots else c for c, x in zip(key, "sro", strict=True)), "k", "slot", "at")
        triple = fill(open_.filter("slot <> 'r'").join(names, "at"), "so").unionByName(fill(open_.filter("slot = 'r'").join(relations, "at"), "r"))
        taken = known.distinct().withColumn("_taken", F.lit(True))
        state, seen = stored_with(triple.join(taken, key, "left"), open=F.count("_taken"))
        done.append(state.filter("_taken is null").select(back(F.col("subject_id")).alias("subject_id"), "relation_type", back(F.col("object_id")).alias("object_id"), "k", "slot"))
        if not seen["open"]:
            forget(known)
            return reduce(DataFrame.unionByName, done)
        empty = [F.when(F.col("slot") != x, F.col(c)).alias(c) for c, x in zip(key, "sro", strict=True)]
        open_ = state.filter("_taken").select(*empty, "k", "slot", F.pmod(F.col("at") + 1, size).alias("at"))
        tries += 1
        if tries > max(n_entities, n_relations):
            raise ValueError("every value of the slot makes a known fact")


def corrupt_in_subgraph(pairs: DataFrame, nodes: DataFrame, negatives: int, seed: int = 0) -> DataFrame:
    """(batch, subject_id, object_id, k, negative_subject, negative_object): one end of each pair replaced by a node of its batch's subgraph.

    pairs: batch, subject_id, object_id; nodes: batch, node (distinct). Either end is as likely, and so is every node,
    the pair's own included. Nodes are numbered within their batch, and drawn numbers are joined.
    """
    numbered = nodes.select("batch", "node", (F.row_number().over(Window.partitionBy("batch").orderBy("node")) - 1).cast("long").alias("_at"))
    sizes = nodes.groupBy("batch").agg(F.count("*").alias("_n"))
    of = (f"{seed}", F.col("batch"), F.col("subject_id"), F.col("object_id"), F.col("k"))
    asked = pairs.select("batch", "subject_id", "object_id", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("k")).join(sizes, "batch")
    drawn = asked.withColumn("_at", F.pmod(draw(*of, "node"), F.col("_n"))).join(numbered, ["batch", "_at"])
    subject = draw(*of, "end") % 2 == 0
    return drawn.select("batch", "subject_id", "object_id", "k", F.when(subject, F.col("node")).otherwise(F.col("subject_id")).alias("negative_subject"), F.when(subject, F.col("object_id")).otherwise(F.col("node")).alias("negative_object"))


def corrupt_objects(facts: DataFrame, entities: DataFrame, known: DataFrame, negatives: int, *, name: Name = as_text) -> DataFrame:
    """For each fact `negatives` objects drawn by hash from the indexed entities, without those that make known facts.

    name: the texts that are drawn by, made of subjects and objects where these are numbers; the texts are not moved.
    """
    total = entities.agg(F.count("*").alias("n_entities"))
    drawn = facts.join(F.broadcast(total)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(negatives))))
    of = (name(F.col("subject_id")), F.col("relation_type"), name(F.col("object_id")), F.col("k"))
    drawn = drawn.withColumn("index", F.pmod(draw(*of), F.col("n_entities")))
    named = drawn.drop("object_id", "n_entities").join(entities.select("index", F.col("id").alias("object_id")), "index")
    return named.select("subject_id", "relation_type", "object_id", "k").join(known.select("subject_id", "relation_type", "object_id").distinct(), ["subject_id", "relation_type", "object_id"], "left_anti")
