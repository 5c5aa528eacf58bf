"""Lookups between ids, names and relations, and lists that keep their order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import top_per_key


def names_of(ids: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """ids with node_name, null where the id isn't known; nodes has node_id, node_name."""
    return ids.join(nodes.select(F.col("node_id").alias(id_col), "node_name"), id_col, "left")


def relations_of_pairs(edges: DataFrame) -> DataFrame:
    """(subject_id, object_id, relations): the sorted distinct relations of each pair."""
    return edges.groupBy("subject_id", "object_id").agg(F.sort_array(F.collect_set("relation_type")).alias("relations"))


def linked_facts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """facts with subject_id and object_id, matched by name and domain; facts with an end that isn't known are dropped, and of several ids of a name the least counts.

    facts: subject_name, subject_domain, object_name, object_domain and others; entities: id, name, domain.
    """
    for end in ("subject", "object"):
        known = entities.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"), F.col("domain").alias(f"{end}_domain")).groupBy(f"{end}_name", f"{end}_domain").agg(F.min(f"{end}_id").alias(f"{end}_id"))
        facts = facts.join(known, [f"{end}_name", f"{end}_domain"])
    return facts


def merged(a: Column, b: Column, without: Column | None = None) -> Column:
    """Both lists, each item where it is met first; without the items of a third list."""
    both = F.array_distinct(F.concat(F.coalesce(a, b), F.coalesce(b, a)))
    return both if without is None else F.filter(both, lambda x: ~F.array_contains(without, x))


def updated_chunk_ids(all_ids: Column, old: Column, new: Column) -> Column:
    """The list of chunk ids after `old` ones were replaced by `new` ones: those that stay keep their order, and ids that are new but not old follow."""
    stay = F.filter(all_ids, lambda x: ~F.array_contains(old, x) | F.array_contains(new, x))
    more = F.filter(new, lambda x: ~F.array_contains(old, x) & ~F.array_contains(stay, x))
    return F.concat(stay, F.array_distinct(more))


def stratified(df: DataFrame, strata: Sequence[str], key: str, n: int | None = None, seed: int = 0, *, fraction: float | None = None) -> DataFrame:
    """n rows of each stratum, or with `fraction` that share of it, rounded up: the first by the md5 of seed and key, then by key."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    if fraction is None:
        return top_per_key(df.withColumn("_draw", draw), list(strata), [F.col("_draw"), F.col(key)], n).drop("_draw")
    sizes = df.groupBy(*strata).agg(F.ceil(F.count("*") * F.lit(fraction)).alias("_most"))
    at = F.row_number().over(Window.partitionBy(*strata).orderBy(draw, key))
    return df.withColumn("_at", at).join(sizes, list(strata)).filter(F.col("_at") <= F.col("_most")).select(*df.columns)


def edge_weights(edges: DataFrame, node: str, weight: str, *, inverse: bool = False) -> DataFrame:
    """edges with `normalised`: the weight, or with `inverse` the node's greatest plus least less the weight, over the sum of its edges'."""
    of = edges.groupBy(node).agg(F.max(weight).alias("_hi"), F.min(weight).alias("_lo"), F.sum(weight).alias("_sum"), F.count("*").alias("_n"))
    w, total = F.col(weight), F.col("_sum")
    if inverse:
        w, total = F.col("_hi") + F.col("_lo") - w, F.col("_n") * (F.col("_hi") + F.col("_lo")) - total
    return edges.join(of, node).select(*edges.columns, F.when(total != 0, w / total).otherwise(F.lit(0.0)).alias("normalised"))


def migrated_rules(rules: DataFrame, changes: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """rules (original, action, new_relation) with the action and new relation that `changes` gives for an original."""
    action, new = F.col("action"), F.col("new_relation")
    for original, (act, relation) in changes.items():
        here = F.col("original") == original
        action, new = F.when(here, F.lit(act)).otherwise(action), F.when(here, F.lit(relation).cast("string")).otherwise(new)
    return rules.withColumns({"action": action, "new_relation": new})


def context_before(context: DataFrame, targets: DataFrame, time: str) -> DataFrame:
    """The context edges no later than the earliest of a batch of targets; its time is one row, which is broadcast."""
    cutoff = targets.agg(F.min(time).alias("_cutoff"))
    return context.join(F.broadcast(cutoff), context[time] <= cutoff["_cutoff"]).select(*context.columns)


def finalized(hypotheses: DataFrame, pair: str, score: str, token: str = " <=====> ") -> DataFrame:
    """Best first, ties by pair; two-element lists as `a token b`."""
    return hypotheses.withColumn(pair, F.concat_ws(token, F.col(pair))).orderBy(F.desc(score), pair)


def combined_walks(backward: DataFrame, forward: DataFrame) -> DataFrame:
    """(root, walk): each walk that leads to a root, given from the root backward, followed by each walk that leads on."""
    b = backward.select("root", F.reverse("walk").alias("_b"))
    f = forward.select("root", F.col("walk").alias("_f"))
    return b.join(f, "root").select("root", F.concat("_b", F.slice("_f", F.lit(2), F.size("_f"))).alias("walk")).distinct()
