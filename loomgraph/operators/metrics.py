"""Classification and ranking metrics, each one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def class_counts(df: DataFrame, predicted: str, target: str) -> DataFrame:
    """True positives, false positives and false negatives of each class: each row counts for its target and its prediction."""
    rows = df.select(F.explode(F.array(F.struct(F.col(target).alias("class"), (F.col(target) == F.col(predicted)).cast("int").alias("tp"), F.lit(0).alias("fp"), (F.col(target) != F.col(predicted)).cast("int").alias("fn")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("tp"), (F.col(target) != F.col(predicted)).cast("int").alias("fp"), F.lit(0).alias("fn")))).alias("x")).select("x.*")
    return rows.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def precision_recall_f1(df: DataFrame, predicted: str, target: str) -> DataFrame:
    """Macro, micro and weighted averages in one row; a class without rows in the denominator counts 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per = class_counts(df, predicted, target).withColumns({"p": ratio(tp, tp + fp), "r": ratio(tp, tp + fn), "f": ratio(2 * tp, 2 * tp + fp + fn), "n": tp + fn})
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    s = {c: F.sum(c) for c in ("tp", "fp", "fn")}
    return per.agg(
        F.avg("p").alias("precision_macro"),
        F.avg("r").alias("recall_macro"),
        F.avg("f").alias("f1_macro"),
        (s["tp"] / (s["tp"] + s["fp"])).alias("precision_micro"),
        (s["tp"] / (s["tp"] + s["fn"])).alias("recall_micro"),
        weighted("p").alias("precision_weighted"),
        weighted("r").alias("recall_weighted"),
        weighted("f").alias("f1_weighted"),
    )


def ranks(scores: DataFrame, query: str, score: str, is_target: str) -> DataFrame:
    """Each query's target rank: pessimistic (score >= target's) and optimistic (1 + score > target's), in two aggregations."""
    target = scores.filter(F.col(is_target)).groupBy(query).agg(F.max(score).alias("_t"))
    met = scores.join(target, query)
    return met.groupBy(query).agg(F.sum((F.col(score) >= F.col("_t")).cast("long")).alias("rank_pessimistic"), (1 + F.sum((F.col(score) > F.col("_t")).cast("long"))).alias("rank_optimistic"))


def ranking_metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    return ranked.agg(F.avg("rank_pessimistic").alias("mean_rank"), F.avg(1 / F.col("rank_optimistic")).alias("mrr"), *(F.avg((F.col("rank_optimistic") <= k).cast("double")).alias(f"hits_at_{k}") for k in ks))


def accuracy(df: DataFrame, predicted: str, target: str) -> DataFrame:
    """The share of rows whose prediction is the target; null for no rows."""
    return df.agg(F.avg((F.col(predicted) == F.col(target)).cast("double")).alias("accuracy"))


def without_known(scores: DataFrame, known: DataFrame, on: list[str], is_target: str) -> DataFrame:
    """Scores without the candidates that make known facts other than the target: filtered ranking.

    Leaving a row out ranks the target as a score of minus infinity for that row would.
    """
    facts = known.select(*on).distinct().withColumn("_known", F.lit(True))
    return scores.join(facts, on, "left").filter(F.col(is_target) | F.col("_known").isNull()).drop("_known")
