"""Communities by modularity: nodes move in synchronous rounds, then the graph is contracted, and again.

Edges are undirected, with whole-number weights, so that gains compare exactly. In a round only the nodes of one half
may move, which the md5 of the node and the round tells; without that, neighbours would change places for ever. A node
goes to the community, of its neighbours' and its own, with the greatest 2m w(node, community) - d(node) D(community),
where the node itself is left out of its own; of equals it stays, or goes to the least name. Edges are dealt by their
far end once; in a round only those of nodes that may move carry a community, its size along, to their node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import forget, stored, stored_by


def halves(node: Column, turn: int) -> Column:
    """Whether a node may move in a round."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", node.cast("string"), F.lit(str(turn // 2)))), 1, 4), 16, 10).cast("int") % 2 == turn % 2


def _moved(state: DataFrame, links: DataFrame, twice: int, turn: int, name: Callable[[Column], Column]) -> DataFrame:
    """state (node, community, d, turns) after a round; links: u, v, w both ways, without loops, and the turns of u."""
    may = F.substring("turns", turn + 1, 1) == "1"
    told = state.join(state.groupBy("community").agg(F.sum("d").alias("_total")), "community")
    near = links.filter(may).join(told.select(F.col("node").alias("v"), "community", "_total"), "v").select(F.col("u").alias("node"), "community", F.col("w").alias("_w"), "_total")
    own = told.filter(may).select("node", "community", F.lit(0).cast("long").alias("_w"), "_total")
    options = near.unionByName(own).repartition("node").groupBy("node", "community").agg(F.sum("_w").alias("_w"), F.max("_total").alias("_total"))
    asked = options.join(state.filter(may).select("node", "d", F.col("community").alias("_own")), "node")
    stays = F.col("community") == F.col("_own")
    gain = F.lit(twice) * F.col("_w") - F.col("d") * (F.col("_total") - F.when(stays, F.col("d")).otherwise(F.lit(0)))
    best = asked.groupBy("node").agg(F.min_by("community", F.struct(-gain, (~stays).cast("int"), name(F.col("community")))).alias("_new"))
    return state.join(best, "node", "left").select("node", F.coalesce("_new", "community").alias("community"), "d", "turns")


def communities(edges: DataFrame, rounds: int = 6, levels: int = 2, name: Callable[[Column], Column] = lambda node: node) -> DataFrame:
    """(node, community) of every node with an edge (src, dst, w); a community is named by a node.

    `rounds` rounds of moves on each of `levels` graphs, the next one made of the last one's communities. Edges count
    both ways, loops as twice their weight, parallel ones together. name: of a node, where nodes are numbers for it.
    """
    pair = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.col("w").cast("long").alias("w"))
    graph = stored(pair.groupBy("u", "v").agg(F.sum("w").alias("w")))
    placed = stored(graph.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("community", F.col("node")))
    for level in range(levels):
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))  # a loop comes twice: 2 w
        degree = stored(both.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("d")))
        twice = degree.agg(F.sum("d")).first()[0] or 0
        turns = lambda node: F.concat(*(F.when(halves(name(node), turn), "1").otherwise("0") for turn in range(rounds))).alias("turns")
        links = stored_by(both.filter("u <> v").select("u", "v", "w", turns(F.col("u"))), "v")
        state = stored(degree.select("node", F.col("node").alias("community"), "d", turns(F.col("node"))))
        for turn in range(rounds):
            older, state = state, stored(_moved(state, links, twice, turn, name))
            forget(older)
        forget(links, degree)
        up = state.select(F.col("node").alias("community"), F.col("community").alias("_up"))
        older, placed = placed, stored(placed.join(up, "community").select("node", F.col("_up").alias("community")))
        forget(older)
        if level + 1 < levels:
            ended = lambda c: state.select(F.col("node").alias(c), F.col("community").alias(f"_{c}"))  # noqa: B023, E731
            merged = graph.join(ended("u"), "u").join(ended("v"), "v")
            graph = stored(merged.groupBy(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).agg(F.sum("w").alias("w")))
    return placed


def modularity(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: the modularity of the communities of edges (src, dst, w)."""
    where = lambda c: placed.select(F.col("node").alias(c), F.col("community").alias(f"_{c}"))
    ends = edges.join(where("src"), "src").join(where("dst"), "dst")
    halves_ = ends.select(F.explode(F.array(F.struct(F.col("_src").alias("c"), "w"), F.struct(F.col("_dst").alias("c"), "w"))).alias("x")).select("x.*")
    degrees = halves_.groupBy("c").agg(F.sum("w").alias("d"))
    inside = ends.filter("_src = _dst").groupBy(F.col("_src").alias("c")).agg(F.sum("w").alias("i"))
    m = F.sum("d") / 2
    both = degrees.join(inside, "c", "left")
    return both.agg((F.sum(F.coalesce("i", F.lit(0))) / m - F.sum(F.col("d").cast("double") * F.col("d")) / (4 * m * m)).alias("modularity"))
