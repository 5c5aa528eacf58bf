"""Explanations of a fact: candidate paths scored by what they show alone and by what is missed without them.

A fact of the context has a weight in [0, 1), how far it supports anything; a context's score is the chance that some
fact of it does, 1 - (1 - w1)(1 - w2) ... So a score with some facts left out is the whole sum of logarithms less theirs,
and no context is copied for each explanation. Any link predictor that gives weights can stand in for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import distances, stored
from ..operators.relational import top_per_key
from ..operators.walks import draw

FACT = ("s", "r", "o")


def context(edges: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """(target, s, r, o): facts among the nodes that reach an end of each target fact within `hops` steps along the edges, without the target.

    targets: target (a name), s, r, o; edges: src, rel, dst.
    """
    ends = stored(targets.select("target", F.explode(F.array("s", "o")).alias("source")).distinct())
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = distances(back, ends.select("source").distinct(), hops).join(ends, "source").select("target", "node").distinct()
    facts = edges.select(F.col("src").alias("s"), F.col("rel").alias("r"), F.col("dst").alias("o")).distinct()
    inside = facts.join(near.select("target", F.col("node").alias("s")), "s").join(near.select("target", F.col("node").alias("o")), ["target", "o"])
    return inside.select("target", *FACT).join(targets.select("target", *FACT), ["target", *FACT], "left_anti")


def downsample(contexts: DataFrame, paths: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most `most` facts of each target's context (target, s, r, o): all that a candidate path uses, then others by draw.

    paths: target, facts (arrays of structs s, r, o). Raises if a target's paths alone use more facts of its context.
    Each task keeps the first `most` of a target before rows move.
    """
    used = paths.select("target", F.explode("facts").alias("f")).select("target", "f.*").distinct().withColumn("_keep", F.lit(0))
    marked = stored(contexts.join(used, ["target", *FACT], "left").withColumn("_keep", F.coalesce("_keep", F.lit(1))))
    if not (over := marked.filter("_keep = 0").groupBy("target").count().filter(F.col("count") > most).limit(1)).isEmpty():
        raise ValueError(f"the paths of a target use more facts than {most}: {tuple(over.first())}")
    order = [F.col("_keep"), draw(f"{seed}", F.col("target"), *map(F.col, FACT)), *map(F.col, FACT)]
    return top_per_key(marked, ["target"], order, most).select("target", *FACT)


def _support(logs: Column) -> Column:
    return 1 - F.exp(F.coalesce(logs, F.lit(0.0)))


def explain(targets: DataFrame, paths: DataFrame, contexts: DataFrame, weight: Column, by_length: bool = False) -> DataFrame:
    """(target, facts, score_sufficient, score_necessary, score), best first within a target by `rank`.

    Sufficient: the score of the path's facts alone less the whole context's. Necessary: the whole context's less that
    of the context without the path's facts. score is their mean. weight: an expression over s, r, o; facts that aren't
    in the context miss nothing. by_length: shorter paths rank first, then scores.
    """
    log = F.log(1 - weight)
    whole = contexts.withColumn("_log", log).groupBy("target").agg(F.sum("_log").alias("_all"))
    named = stored(targets.select("target").join(paths.select("target", "facts").distinct(), "target").withColumn("_path", F.to_json("facts")))
    facts = named.select("target", "_path", F.explode(F.array_distinct("facts")).alias("f")).select("target", "_path", "f.*").withColumn("_log", log)
    there = contexts.select("target", *FACT, F.lit(True).alias("_there"))
    sums = facts.join(there, ["target", *FACT], "left").groupBy("target", "_path").agg(F.sum("_log").alias("_own"), F.sum(F.when(F.col("_there"), F.col("_log"))).alias("_missed"))
    joined = named.join(sums, ["target", "_path"]).join(whole, "target", "left")
    total = F.coalesce("_all", F.lit(0.0))
    scored = joined.withColumn("score_sufficient", _support(F.col("_own")) - _support(total)).withColumn("score_necessary", _support(total) - _support(total - F.coalesce("_missed", F.lit(0.0))))
    scored = scored.withColumn("score", (F.col("score_sufficient") + F.col("score_necessary")) / 2)
    order = [F.size("facts")] * by_length + [F.desc(F.round("score", 9)), F.col("_path")]
    return scored.select("target", "facts", "score_sufficient", "score_necessary", "score", F.row_number().over(Window.partitionBy("target").orderBy(*order)).alias("rank"))
