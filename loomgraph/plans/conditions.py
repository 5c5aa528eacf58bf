"""Link conditions: atoms over (subject, relation, object), combined by all_of, any_of and none_of.

Conditions are built in Python; there is no query text to parse. An atom has one open end and gives the nodes that fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """X -relation-> node if `outgoing`, else node -relation-> X."""

    relation: str
    node: str
    outgoing: bool = True

    def nodes(self, edges: DataFrame) -> DataFrame:
        own, other = ("subject_id", "object_id") if self.outgoing else ("object_id", "subject_id")
        return edges.filter((F.col("relation_type") == self.relation) & (F.col(other) == self.node)).select(F.col(own).alias("node_id")).distinct()


@dataclass(frozen=True)
class AllOf:
    parts: tuple

    def nodes(self, edges: DataFrame) -> DataFrame:
        return reduce(lambda a, b: a.join(b, "node_id", "left_semi"), [p.nodes(edges) for p in self.parts])


@dataclass(frozen=True)
class AnyOf:
    parts: tuple

    def nodes(self, edges: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.nodes(edges) for p in self.parts]).distinct()


@dataclass(frozen=True)
class NotLink:
    """Nodes linked to the node by some relation, none of them this one (anchored), or all nodes of `among` without the link."""

    link: Link
    among: DataFrame | None = None

    def nodes(self, edges: DataFrame) -> DataFrame:
        if self.among is not None:
            return self.among.select("node_id").distinct().join(self.link.nodes(edges), "node_id", "left_anti")
        own, other = ("subject_id", "object_id") if self.link.outgoing else ("object_id", "subject_id")
        near = edges.filter(F.col(other) == self.link.node).groupBy(F.col(own).alias("node_id")).agg(F.max((F.col("relation_type") == self.link.relation).cast("int")).alias("has"))
        return near.filter("has = 0").select("node_id")


def pattern(edges: DataFrame, subject: str | None = None, relation: str | None = None, object_: str | None = None, subject_domain: str | None = None, object_domain: str | None = None) -> DataFrame:
    """Edges that agree with the constants given; the filters reach the scan."""
    for column, value in (("subject_id", subject), ("relation_type", relation), ("object_id", object_), ("subject_domain", subject_domain), ("object_domain", object_domain)):
        if value is not None:
            edges = edges.filter(F.col(column) == value)
    return edges


def bindings(edges: DataFrame, variable: str, **constants: str) -> DataFrame:
    return pattern(edges, **constants).select(F.col(variable).alias("node_id")).distinct()


def hash_score(*parts: Column) -> Column:
    """A stand-in for a link predictor: a number in [0, 1) from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def answer(edges: DataFrame, condition, relation: str, target: str, n: int) -> DataFrame:
    """Single-variable query: candidates of the condition, scored for (X, relation, target), best first."""
    return condition.nodes(edges).withColumn("score", hash_score(F.col("node_id"), F.lit(relation), F.lit(target))).orderBy(F.desc("score"), "node_id").limit(n)


def beam(candidates: DataFrame, steps: list[tuple[str, DataFrame]], width: int) -> DataFrame:
    """Conjunctive query over several variables: each step binds one more (relation, domain table with node_id).

    candidates has `last` and `score`; a step scores each beam member with the domain and keeps the best `width`.
    The beam is at most `width` rows, so it is the side that is broadcast.
    """
    state = candidates.select(F.array("last").alias("path"), "last", "score").orderBy(F.desc("score"), "last").limit(width)
    for relation, domain in steps:
        met = domain.select(F.col("node_id").alias("next")).join(F.broadcast(state))
        scored = met.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last"), (F.col("score") * hash_score(F.col("last"), F.lit(relation), F.col("next"))).alias("score"))
        state = scored.orderBy(F.desc("score"), "last", "path").limit(width)
    return state


def named(domain: str, key: int) -> str:
    """A node's id, as text.node_id makes it."""
    return hashlib.md5(f"{domain}|{key}".encode()).hexdigest()


def conjunctive_beam(atoms: Sequence, domains: Mapping[str, DataFrame], ledger: DataFrame, predict: Column, width: int) -> DataFrame:
    """The beam (a column for each variable, and score) of a conjunction of atoms (see combine.Atom).

    Variables are bound in the order of `domains`, each to all nodes of its table (column named as the variable); the
    product of the scores of the atoms whose ends are bound by then ranks the bindings, and the best `width` go on.
    Scores rank by nine digits, then bindings by name. Every step must settle an atom, so that a domain never meets more
    than `width` rows, which are the side that is broadcast.
    """
    term = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    key = ["subject_id", "relation_type", "object_id"]
    known = ledger.select(*key, F.col("score").alias("_known"))
    state, bound, open_ = None, [], list(atoms)
    for variable, domain in domains.items():
        rows = domain.select(variable)
        state = rows.withColumn("score", F.lit(1.0)) if state is None else rows.join(F.broadcast(state))
        bound.append(variable)
        ready = [a for a in open_ if all(not x.startswith("?") or x[1:] in bound for x in (a.subject, a.object))]
        if not ready:
            raise ValueError(f"no condition settles ?{variable}")
        for a in ready:
            asked = state.withColumnRenamed("score", "_before").withColumns({"subject_id": term(a.subject), "relation_type": F.lit(a.relation), "object_id": term(a.object)})
            one = F.coalesce("_known", predict)
            state = asked.join(known, key, "left").select(*bound, (F.col("_before") * (1 - one if a.negated else one)).alias("score"))
        open_ = [a for a in open_ if a not in ready]
        state = state.orderBy(F.desc(F.round("score", 9)), *bound).limit(width)
    return state
