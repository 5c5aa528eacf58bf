"""Seeded walks, what is counted on them, ego networks, hitting times and communities.

Draws are hashes: of a seed, the walk, the step and what may be chosen. So a run can be repeated, by any engine and in
any order of rows. One step of all walks is one join with the edges and one minimum for each walk, which is combined
before rows move: a hub's edges never meet in one task. Edges have src and dst, and where named rel and weight.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import distances, forget, stored, stored_by, undirected
from .relational import dense_index


def draw(*parts: Column | str) -> Column:
    """A number below 2^48 from the md5 of the parts, joined by |."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """draw() as a number inside (0, 1)."""
    return (draw(*parts) + F.lit(0.5)) / F.lit(float(1 << 48))


def as_text(c: Column) -> Column:
    return c.cast("string")


Name = Callable[[Column], Column]


def _chosen(options: DataFrame, seed: int, step: int, weight: str | None, name: Column, walk_name: Name = as_text) -> DataFrame:
    """One row for each walk: the option of the least key, an exponential draw over its weight; of equal weights, of the least draw."""
    of = (f"{seed}", walk_name(F.col("walk")), F.lit(step), name)
    key = draw(*of).cast("double") if weight is None else -F.log(uniform(*of)) / F.col(weight)
    row = F.struct(*(c for c in options.columns if c != "walk"))
    return options.groupBy("walk").agg(F.min_by(row, F.struct(key, name)).alias("_row")).select("walk", "_row.*")


def seeded_walks(edges: DataFrame, starts: DataFrame, steps: int, *, seed: int = 0, weight: str | None = None, name: Name = as_text, walk_name: Name = as_text) -> DataFrame:
    """(walk, step, node, rel) of walks from `starts` (walk, node): step 0 is the start, with a null rel.

    Each step goes to a neighbour by weight (positive; all equal by default); parallel edges of other relations are
    options of their own. A walk ends where no edge leads on. name, walk_name: the texts that are drawn by, made of
    nodes and walks where these are numbers; the texts are not moved. Edges are dealt by their start once.
    """
    has_rel = "rel" in edges.columns
    out_of = edges.select(F.col("src").alias("node"), "dst", (F.col("rel") if has_rel else F.lit(None).cast("string")).alias("rel"), *([weight] if weight else []))
    out_of = stored_by(out_of.distinct(), "node")
    at = stored(starts.select("walk", F.lit(0).alias("step"), "node", F.lit(None).cast("string").alias("rel")))
    levels = [at]
    for k in range(1, steps + 1):
        options = at.select("walk", "node").join(out_of, "node").drop("node")
        told = F.concat_ws(">", F.coalesce("rel", F.lit("")), name(F.col("dst")))
        at = stored(_chosen(options, seed, k, weight, told, walk_name).select("walk", F.lit(k).alias("step"), F.col("dst").alias("node"), "rel"))
        levels.append(at)
    forget(out_of)
    return reduce(DataFrame.unionByName, levels)


def walk_arrays(walks: DataFrame) -> DataFrame:
    """(walk, path): node, relation, node ... of each walk; a walk is as long as its steps."""
    row = F.struct("step", "rel", "node")
    made = walks.groupBy("walk").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    flat = F.flatten(F.transform("_rows", lambda x: F.when(x["step"] == 0, F.array(x["node"])).otherwise(F.array(x["rel"], x["node"]))))
    return made.select("walk", flat.alias("path"))


def sampled_walks(edges: DataFrame, roots: DataFrame, depth: int, most: int, *, seed: int = 0, weight: str | None = None, name: Name = as_text) -> DataFrame:
    """(root, walk): the distinct walks among `most` that are drawn from each root (column root), of at most `depth` hops.

    name: of the nodes, where these are numbers; roots and walks have the names.
    """
    numbered = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")
    starts = roots.select("root", numbered).select(F.struct("root", "k").alias("walk"), F.col("root").alias("node"))
    walk_name = lambda w: F.concat_ws("#", name(w["root"]), w["k"].cast("string"))
    steps = seeded_walks(edges, starts, depth, seed=seed, weight=weight, name=name, walk_name=walk_name)
    walks = walk_arrays(steps.withColumn("node", name(F.col("node"))))
    return walks.select(F.element_at("path", 1).alias("root"), F.col("path").alias("walk")).distinct()


def walk_subgraph(edges: DataFrame, starts: DataFrame, steps: int, *, seed: int = 0, name: Name = as_text) -> DataFrame:
    """The edges (src, rel, dst) that seeded walks from `starts` (walk, node) use, each once; walks take edges both ways.

    name: of the nodes and walks, where these are numbers.
    """
    both = edges.select("src", F.concat(F.lit(">"), "rel").alias("rel"), "dst").unionByName(edges.select(F.col("dst").alias("src"), F.concat(F.lit("<"), "rel").alias("rel"), F.col("src").alias("dst")))
    walks = seeded_walks(both, starts, steps, seed=seed, name=name, walk_name=name)
    before = walks.select("walk", (F.col("step") + 1).alias("step"), F.col("node").alias("_from"))
    used = walks.filter("step > 0").join(before, ["walk", "step"])
    ahead = F.startswith("rel", F.lit(">"))
    return used.select(F.when(ahead, F.col("_from")).otherwise(F.col("node")).alias("src"), F.substring("rel", 2, 1 << 20).alias("rel"), F.when(ahead, F.col("node")).otherwise(F.col("_from")).alias("dst")).distinct()


def visit_shares(edges: DataFrame, homes: DataFrame, walks: int, steps: int, *, alpha: float = 0.85, seed: int = 0) -> DataFrame:
    """(home, node, share): personalised PageRank by walks, the share of all steps of a home's walks that are at a node.

    `walks` walks of `steps` steps from each home (column home); a step goes back home with chance 1 - alpha, and from a
    node without edges.
    """
    out_of = stored(edges.select(F.col("src").alias("node"), "dst").distinct())
    start = homes.select("home", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("k"))
    at = stored(start.select("home", F.concat_ws("#", "home", F.col("k").cast("string")).alias("walk"), F.col("home").alias("node")))
    counts = []
    for k in range(1, steps + 1):
        stays = uniform(f"{seed}", F.col("walk"), F.lit(k), "restart") < alpha
        goes = _chosen(at.filter(stays).select("walk", "node").join(out_of, "node").drop("node"), seed, k, None, F.col("dst"))
        older, at = at, stored(at.select("home", "walk").join(goes, "walk", "left").select("home", "walk", F.coalesce("dst", "home").alias("node")))
        counts.append(stored(at.groupBy("home", "node").agg(F.count("*").alias("n"))))
        forget(older)
    every = reduce(DataFrame.unionByName, counts)
    return every.groupBy("home", "node").agg((F.sum("n") / F.lit(float(walks * steps))).alias("share"))


def hop_walks(walks: DataFrame, members: DataFrame, chance: float, *, seed: int = 0) -> DataFrame:
    """walks (walk, step, node, rel), each node but the start replaced with the given chance by a member of its community.

    members: (node, community), of which every member is as likely, the node itself included. A node without a
    community stays. Members are numbered, so a hop is a join by (community, number) and no community is gathered.
    """
    sizes = members.groupBy("community").agg(F.count("*").alias("_size"))
    placed = members.withColumn("_name", F.concat_ws("|", F.col("community").cast("string"), F.col("node").cast("string")))
    index = dense_index(placed.select("_name"), "_name", "_at").join(placed, "_name")
    first = index.groupBy("community").agg(F.min("_at").alias("_first"))
    numbered = index.join(first, "community").select("community", (F.col("_at") - F.col("_first")).alias("_number"), F.col("node").alias("_other"))
    of = (f"{seed}", F.col("walk"), F.col("step"))
    asked = walks.join(members, "node", "left").join(sizes, "community", "left")
    hops = (F.col("step") > 0) & (uniform(*of, "hop") < chance)
    asked = asked.withColumn("_number", F.when(hops, F.pmod(draw(*of, "member"), F.col("_size"))))
    return asked.join(numbered, ["community", "_number"], "left").select("walk", "step", F.coalesce("_other", "node").alias("node"), "rel")


def ego_network(edges: DataFrame, centres: DataFrame, radius: int, *, frontier: int | None = None, seed: int = 0) -> DataFrame:
    """(centre, src, rel, dst): the edges among all nodes within `radius` steps of each centre (column centre), edges taken both ways.

    frontier: of each level only so many draws, with replacement, go on; the draws of a level number its nodes by name.
    """
    near = stored(undirected(edges))
    if frontier is None:
        inside = distances(near, centres.select(F.col("centre").alias("source")).distinct(), radius).select(F.col("source").alias("centre"), "node")
    else:
        inside = front = stored(centres.select("centre", F.col("centre").alias("node")).distinct())
        for k in range(1, radius + 1):
            reached = front.join(near, front["node"] == near["src"]).select("centre", F.col("dst").alias("node")).distinct().join(inside, ["centre", "node"], "left_anti")
            numbered = stored(reached.withColumn("_at", F.row_number().over(Window.partitionBy("centre").orderBy("node")) - 1))
            sizes = numbered.groupBy("centre").agg(F.count("*").alias("_n"))
            draws = sizes.select("centre", "_n", F.explode(F.sequence(F.lit(1), F.lit(frontier))).alias("_k")).select("centre", F.pmod(draw(f"{seed}", F.col("centre"), F.lit(k), F.col("_k")), F.col("_n")).cast("int").alias("_at")).distinct()
            front = stored(numbered.join(draws, ["centre", "_at"]).select("centre", "node"))
            inside = stored(inside.unionByName(front))
    ends = [inside.select("centre", F.col("node").alias(c)) for c in ("src", "dst")]
    return edges.select("src", "rel", "dst").join(ends[0], "src").join(ends[1], ["centre", "dst"]).select("centre", "src", "rel", "dst")


def hitting_times(edges: DataFrame, targets: DataFrame, rounds: int, *, residual: float = 0.0) -> DataFrame:
    """(target, node, steps): the mean steps of a walk from each node until it meets the target (column target).

    steps(target) = 0, and of every other node 1 and the mean over its edges of its neighbours' steps: a sparse linear
    system for each target, iterated on all of them at once from 0 until no value moves by more than `residual`, or for
    `rounds` rounds. Parallel edges count as often as they are there. Nodes from which some walk never meets the target
    have no limit; they are left out where an edge from them leads out of the nodes that can reach it.
    """
    step = edges.groupBy("src", "dst").agg(F.count("*").alias("_w"))
    degree = step.groupBy("src").agg(F.sum("_w").alias("_d"))
    chance = stored(step.join(degree, "src").select("src", "dst", (F.col("_w") / F.col("_d")).alias("p")))
    back = chance.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reach, front = None, stored(targets.select("target", F.col("target").alias("node")).distinct())
    while not front.isEmpty():
        reach = front if reach is None else stored(reach.unionByName(front))
        grown = front.join(back, front["node"] == back["src"]).select("target", F.col("dst").alias("node")).distinct()
        front = stored(grown.join(reach, ["target", "node"], "left_anti"))
    lost = reach.join(chance, reach["node"] == chance["src"]).filter("node <> target").select("target", "node", "dst")
    kept = reach
    while True:  # nodes whose edges lead away from the target for ever, and nodes before them
        leads = lost.join(kept.select("target", F.col("node").alias("dst")), ["target", "dst"], "left_anti").select("target", "node").distinct()
        fewer = stored(kept.join(leads, ["target", "node"], "left_anti"))
        if fewer.count() == kept.count():
            break
        kept = fewer
    rows = stored(kept.filter("node <> target").join(chance, F.col("node") == F.col("src")).select("target", "node", "dst", "p"))
    steps = stored(kept.select("target", "node", F.lit(0.0).alias("steps")))
    for _ in range(rounds):
        sums = rows.join(steps.select("target", F.col("node").alias("dst"), "steps"), ["target", "dst"]).groupBy("target", "node").agg((1 + F.sum(F.col("p") * F.col("steps"))).alias("_new"))
        new = stored(steps.join(sums, ["target", "node"], "left").select("target", "node", F.coalesce("_new", F.lit(0.0)).alias("steps"), F.abs(F.coalesce("_new", F.lit(0.0)) - F.col("steps")).alias("_gap")))
        moved = new.agg(F.max("_gap")).first()[0] if residual > 0 else None
        forget(steps)
        steps = new
        if moved is not None and moved <= residual:
            break
    return steps.select("target", "node", "steps")


def commute_times(edges: DataFrame, pairs: DataFrame, rounds: int, *, residual: float = 0.0) -> DataFrame:
    """pairs (a, b) with the mean steps from a to b, from b to a, and their sum; null where a walk may never arrive."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("target")).distinct()
    steps = stored(hitting_times(edges, ends, rounds, residual=residual))
    there = steps.select(F.col("target").alias("b"), F.col("node").alias("a"), F.col("steps").alias("to_b"))
    back = steps.select(F.col("target").alias("a"), F.col("node").alias("b"), F.col("steps").alias("to_a"))
    return pairs.select("a", "b").join(there, ["a", "b"], "left").join(back, ["a", "b"], "left").withColumn("commute", F.col("to_b") + F.col("to_a"))
