"""Scores of conditions combined to scores of candidates, as aggregations in long form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import scores_of


def condition_score(score: Column, negated: Column) -> Column:
    """A negated condition holds as far as the plain one doesn't."""
    return F.when(negated, 1 - score).otherwise(score)


def disjunction_of_conjunctions(scores: DataFrame, candidate: str, clause: str, score: str, least: bool = False) -> DataFrame:
    """(candidate, query_score) of (candidate, clause, score) rows: t-norm inside a clause, t-conorm over the clauses.

    Product and probabilistic sum, or with `least` minimum and maximum.
    """
    norm, conorm = (F.min(score), F.max("_c")) if least else (F.product(F.col(score)), 1 - F.product(1 - F.col("_c")))
    clauses = scores.groupBy(candidate, clause).agg(norm.alias("_c"))
    return clauses.groupBy(candidate).agg(conorm.alias("query_score"))


@dataclass(frozen=True)
class Atom:
    """A condition (subject, relation, object); a variable is written ?name. negated: it holds as far as the plain one doesn't."""

    subject: str
    relation: str
    object: str
    negated: bool = False


def all_assignments(candidates: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row for each way to give every variable a value that some candidate gives it.

    candidates has a column for each variable, null where a candidate doesn't bind it. They are beams, so the values
    of a variable are as many as the beams' rows at most; the rows here are the product of these numbers.
    """
    values = candidates.agg(*(F.array_sort(F.collect_set(v)).alias(v) for v in variables))
    return reduce(lambda df, v: df.withColumn(v, F.explode(v)), variables, values)


def disjuncts_over_bindings(candidates: DataFrame, clauses: Sequence[Sequence[Atom]], ledger: DataFrame, predict: Column, least: bool = False) -> DataFrame:
    """Every assignment of the candidates' values with query_score: each disjunct's t-norm over its conditions, then the t-conorm.

    A candidate that one disjunct has found is scored on all of them. A condition's score is the ledger's (subject_id,
    relation_type, object_id, score) where it has the triple, else `predict` over these columns; each distinct triple
    is scored once.
    """
    variables = sorted({x[1:] for c in clauses for a in c for x in (a.subject, a.object) if x.startswith("?")})
    assigned = all_assignments(candidates, variables)
    term = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    rows = [
        F.struct(F.lit(k).alias("clause"), F.lit(n).alias("atom"), F.lit(a.negated).alias("negated"), term(a.subject).alias("subject_id"), F.lit(a.relation).alias("relation_type"), term(a.object).alias("object_id"))
        for k, c in enumerate(clauses)
        for n, a in enumerate(c)
    ]
    long = assigned.select(*variables, F.inline(F.array(*rows)))
    key = ["subject_id", "relation_type", "object_id"]
    scored = long.join(scores_of(long.select(*key).distinct(), ledger, predict), key)
    held = scored.withColumn("_score", condition_score(F.col("score"), F.col("negated"))).withColumn("_binding", F.struct(*variables))
    return disjunction_of_conjunctions(held, "_binding", "clause", "_score", least).select("_binding.*", "query_score")


def weighted_score(scores: DataFrame, key: str, score: str, weight: str) -> DataFrame:
    """(key, weighted_score): the sum of scores times their weights."""
    return scores.groupBy(key).agg(F.sum(F.col(score) * F.col(weight)).alias("weighted_score"))


def pair_triples(pairs: DataFrame, relations: list[str]) -> DataFrame:
    """Every pair (subject_id, object_id) with each relation of a stated list."""
    return pairs.withColumn("relation_type", F.explode(F.array(*map(F.lit, relations))))


def scored_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame, score: Column, missing: float | None = None) -> DataFrame:
    """triples with `score` (an expression over the columns s, r, o: the vectors of subject, relation, object).

    entities and relations have id and vector; a triple with an id that isn't there gets `missing`.
    """
    out = triples
    for column, table, name in (("subject_id", entities, "s"), ("relation_type", relations, "r"), ("object_id", entities, "o")):
        out = out.join(table.select(F.col("id").alias(column), F.col("vector").alias(name)), column, "left")
    whole = F.col("s").isNotNull() & F.col("r").isNotNull() & F.col("o").isNotNull()
    return out.select(*triples.columns, F.when(whole, score).otherwise(F.lit(missing).cast("double")).alias("score"))


#: What a pair gets for a relation where one of the triple's ids has no vector.
MISSING_SCORE = -1000.0


def pair_predictions(pairs: DataFrame, relations: list[str], entities: DataFrame, vectors: DataFrame, score: Column, scaled: Column | None = None) -> DataFrame:
    """pairs with `scores`, in the order of the relations' list, and with `scaled` (an expression over score) `normalised` beside it.

    A list is as long as the list of relations, which is stated; triples are scored as by scored_triples().
    """
    place = F.array_position(F.array(*map(F.lit, relations)), F.col("relation_type"))
    scored = scored_triples(pair_triples(pairs.select("subject_id", "object_id").distinct(), relations).select("subject_id", "relation_type", "object_id"), entities, vectors, score, MISSING_SCORE)
    rows = F.array_sort(F.collect_list(F.struct(place.alias("place"), "score", *([scaled.alias("scaled")] if scaled is not None else []))))
    made = scored.groupBy("subject_id", "object_id").agg(rows.alias("_rows"))
    lists = made.select("subject_id", "object_id", F.transform("_rows", lambda x: x["score"]).alias("scores"), *([F.transform("_rows", lambda x: x["scaled"]).alias("normalised")] if scaled is not None else []))
    return pairs.join(lists, ["subject_id", "object_id"])


def top_triples(scored: DataFrame, k: int) -> DataFrame:
    """The k triples of the highest score, ties by their ids: each task keeps k, and only these are merged."""
    return scored.orderBy(F.desc("score"), "subject_id", "relation_type", "object_id").limit(k)
