"""Walks, hitting times, communities, negatives and explanations against plain Python."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import communities, graph, splits, walks
from loomgraph.plans import combine, conditions, explain


def town(n=24, extra=20, seed=4):
    rnd = random.Random(seed)
    pairs = {(f"n{i:02}", f"n{(i * 7 + 3) % n:02}") for i in range(n)} | {(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(extra)}
    return sorted((a, b) for a, b in pairs if a != b)


def test_visit_shares_are_near_the_power_iteration(spark):
    edges = town(12, 14)
    both = sorted({*edges, *((b, a) for a, b in edges)})
    e = spark.createDataFrame(both, "src string, dst string")
    homes = spark.createDataFrame([("n00",)], "home string")
    got = {r.node: r.share for r in walks.visit_shares(e, homes, 1500, 8, seed=2).collect()}
    assert sum(got.values()) == pytest.approx(1)
    # the same law with exact chances: the share at each of the 8 steps, home first
    at, want = collections.Counter({"n00": 1.0}), collections.Counter()
    near = collections.defaultdict(list)
    for a, b in both:
        near[a].append(b)
    for _ in range(8):
        nxt = collections.Counter({"n00": 0.15})
        for node, p in at.items():
            for other in near[node]:
                nxt[other] += 0.85 * p / len(near[node])
        at = nxt
        want.update({k: v / 8 for k, v in at.items()})
    assert all(abs(want[k] - got.get(k, 0)) < 0.02 for k in want)
    assert got == {r.node: r.share for r in walks.visit_shares(e.repartition(3), homes, 1500, 8, seed=2).collect()}


def test_weighted_steps_follow_their_weights(spark):
    e = spark.createDataFrame([("a", "r", "b", 3.0), ("a", "r", "c", 1.0), ("b", "r", "a", 1.0)], "src string, rel string, dst string, weight double")
    starts = spark.range(2000).select(F.col("id").cast("string").alias("walk"), F.lit("a").alias("node"))
    steps = walks.seeded_walks(e, starts, 2, seed=1, weight="weight").groupBy("step", "node").count().collect()
    n = {(r.step, r.node): r["count"] for r in steps}
    assert n[0, "a"] == 2000 and abs(n[1, "b"] / 2000 - 0.75) < 0.04 and n[2, "a"] == n[1, "b"]  # walks end at c


def test_hitting_times_solve_the_system(spark):
    edges = [*town(16, 18), ("n00", "n01"), ("n00", "n01")]
    both = [*edges, *((b, a) for a, b in edges), ("lone", "other"), ("n02", "trap")]
    nodes = sorted({n for x in both for n in x})
    degree, near = collections.Counter(a for a, _ in both), collections.Counter(both)
    target = "n05"
    # nodes that surely meet the target
    sure = {n for n in nodes}
    while True:
        reach = {target}
        while more := {a for a, b in both if b in reach and a in sure} - reach:
            reach |= more
        fewer = {n for n in reach if n == target or all(b in reach for a, b in both if a == n)}
        if fewer == sure:
            break
        sure = fewer
    e = spark.createDataFrame(both, "src string, dst string")
    got = {r.node: r.steps for r in walks.hitting_times(e, spark.createDataFrame([(target,)], "target string"), 3000, residual=1e-7).collect()} if sure != {target} else {target: 0.0}
    assert set(got) == sure
    rest = sorted(sure - {target})
    if rest:
        a = np.eye(len(rest)) - np.array([[near[x, y] / degree[x] for y in rest] for x in rest])
        assert np.allclose([got[x] for x in rest], np.linalg.solve(a, np.ones(len(rest))), rtol=1e-3)


def test_commute_times(spark):
    """A path a - b - c: from an end to the other 4 steps on average, both ways 8."""
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "y")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "c"), ("a", "b"), ("a", "y")], "a string, b string")
    got = {(r.a, r.b): (r.to_b, r.to_a, r.commute) for r in walks.commute_times(e, pairs, 200, residual=1e-9).collect()}
    assert got["a", "c"] == pytest.approx((4, 4, 8)) and got["a", "b"] == pytest.approx((1, 3, 4)) and got["a", "y"] == (None, None, None)


def plain_communities(edges, rounds, levels):
    """The same rules, one node at a time from the state before."""
    graph_, placed = collections.Counter(), {}
    for a, b, w in edges:
        graph_[min(a, b), max(a, b)] += w
    placed = {n: n for e in graph_ for n in e}
    for _ in range(levels):
        degree, near = collections.Counter(), collections.defaultdict(collections.Counter)
        for (a, b), w in graph_.items():
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        twice, state = sum(degree.values()), {n: n for n in degree}
        for turn in range(rounds):
            total = collections.Counter()
            for n, c in state.items():
                total[c] += degree[n]
            new = dict(state)
            for n, own in state.items():
                if int(hashlib.md5(f"{n}|{turn // 2}".encode()).hexdigest()[:4], 16) % 2 != turn % 2:
                    continue
                to = collections.Counter({own: 0})
                for other, w in near[n].items():
                    to[state[other]] += w
                new[n] = min(to, key=lambda c: (-(twice * to[c] - degree[n] * (total[c] - degree[n] * (c == own))), c != own, c))
            state = new
        placed = {n: state[c] for n, c in placed.items()}
        merged = collections.Counter()
        for (a, b), w in graph_.items():
            x, y = sorted((state[a], state[b]))
            merged[x, y] += w
        graph_ = merged
    return placed


def plain_modularity(edges, placed):
    m, degree, inside = sum(w for *_, w in edges), collections.Counter(), 0
    for a, b, w in edges:
        degree[placed[a]] += w
        degree[placed[b]] += w
        inside += w * (placed[a] == placed[b])
    return inside / m - sum(d * d for d in degree.values()) / (4 * m * m)


def test_communities_of_blocks(spark):
    """Four dense blocks with few edges between: found, and equal to the plain version in every move."""
    rnd = random.Random(6)
    edges = [(f"b{i // 8}_{i % 8}", f"b{j // 8}_{j % 8}", rnd.randrange(1, 4)) for i in range(32) for j in range(i + 1, 32) if rnd.random() < (0.8 if i // 8 == j // 8 else 0.03)]
    edges += [("b0_0", "b0_0", 2), ("b0_1", "b0_0", 1)]
    df = spark.createDataFrame(edges, "src string, dst string, w long")
    placed = communities.communities(df, rounds=6, levels=2)
    got = {r.node: r.community for r in placed.collect()}
    assert got == plain_communities(edges, 6, 2)
    q = communities.modularity(df, placed).first().modularity
    assert q == pytest.approx(plain_modularity(edges, got)) and q > 0.55
    assert len({got[f"b{i}_{k}"] for i in range(4) for k in range(8)}) <= 6


def test_one_slot_negatives_are_free(spark):
    facts = [(f"e{i}", f"r{(i + j) % 2}", f"e{j}") for i in range(5) for j in range(5) if (i * j) % 3]
    key = "subject_id string, relation_type string, object_id string"
    df = spark.createDataFrame(facts, key)
    entities = spark.createDataFrame([(f"e{i}", i) for i in range(5)], "id string, index long")
    relations = spark.createDataFrame([("r0", 0), ("r1", 1), ("r2", 2)], "id string, index long")
    got = [tuple(r) for r in splits.corrupt_one_slot(df, entities, relations, df, 3, (0.3, 0.3, 0.4)).collect()]
    assert len(got) == 3 * len(facts) and not {x[:3] for x in got} & set(facts) and {x[4] for x in got} == set("sro")
    full = spark.createDataFrame([("a", "r", "a")], key)
    one = spark.createDataFrame([("a", 0)], "id string, index long"), spark.createDataFrame([("r", 0)], "id string, index long")
    with pytest.raises(ValueError):
        splits.corrupt_one_slot(full, *one, full, 1)


def test_subgraph_negatives_stay_inside(spark):
    pairs = spark.createDataFrame([(b, f"s{b}{i}", f"o{b}{i}") for b in (1, 2) for i in range(6)], "batch int, subject_id string, object_id string")
    nodes = pairs.select("batch", F.explode(F.array("subject_id", "object_id")).alias("node"))
    got = splits.corrupt_in_subgraph(pairs, nodes, 4).collect()
    assert len(got) == 48
    for r in got:
        assert (r.negative_subject == r.subject_id) or (r.negative_object == r.object_id)
        assert r.negative_subject[1] == r.negative_object[1] == str(r.batch)


def test_batches_of_a_hot_timestamp(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.lit(2)).alias("t"), "id")
    got = collections.Counter((r.t, r.batch) for r in splits.timestamp_batches(df, "t", "id", 50).collect())
    assert sum(got.values()) == 1000 and max(got.values()) == 50
    for when in (None, 1, 2):
        sizes = [n for (t, b), n in sorted(got.items(), key=repr) if t == when]
        assert sum(n < 50 for n in sizes) <= 1 and len(sizes) == max(b for t, b in got if t == when) + 1


def test_context_downsample(spark):
    contexts = spark.createDataFrame([("t", f"s{i}", "r", "o") for i in range(9)] + [("u", "s0", "r", "o")], "target string, s string, r string, o string")
    used = spark.createDataFrame([("t", [("s7", "r", "o"), ("s8", "r", "o"), ("elsewhere", "r", "o")])], "target string, facts array<struct<s:string,r:string,o:string>>")
    got = sorted((r.target, r.s) for r in explain.downsample(contexts, used, 4).collect())
    assert len(got) == 5 and ("t", "s7") in got and ("t", "s8") in got and ("u", "s0") in got
    with pytest.raises(ValueError):
        explain.downsample(contexts, used, 1)


def test_explain(spark):
    fact = "array<struct<s:string,r:string,o:string>>"
    targets = spark.createDataFrame([("t",), ("v",)], "target string")
    contexts = spark.createDataFrame([("t", "a", "r", "b"), ("t", "b", "r", "c"), ("t", "x", "r", "y")], "target string, s string, r string, o string")
    p = spark.createDataFrame([("t", [("a", "r", "b"), ("b", "r", "c")]), ("t", [("x", "r", "y")]), ("v", [("q", "r", "q")])], f"target string, facts {fact}")
    weight = F.when(F.col("s") == "a", 0.5).when(F.col("s") == "x", 0.8).otherwise(0.2)
    got = {(r.target, len(r.facts)): r for r in explain.explain(targets, p, contexts, weight).collect()}
    whole = 1 - 0.5 * 0.8 * 0.2
    assert got["t", 2].score_sufficient == pytest.approx(0.6 - whole) and got["t", 2].score_necessary == pytest.approx(whole - 0.8)
    assert got["t", 1].score == pytest.approx((0.8 - whole + whole - 0.6) / 2) and (got["t", 1].rank, got["t", 2].rank) == (1, 2)
    assert got["v", 1].score_sufficient == pytest.approx(0.2) and got["v", 1].score_necessary == 0
    assert next(r.rank for r in explain.explain(targets, p, contexts, F.lit(0.1), by_length=True).collect() if r.target == "t" and len(r.facts) == 1) == 1


def test_all_bindings_are_scored_on_all_disjuncts(spark):
    key = "subject_id string, relation_type string, object_id string, score double"
    ledger = spark.createDataFrame([("a", "p", "n", 0.9), ("b", "p", "n", 0.1), ("a", "q", "n", 0.2), ("b", "q", "n", 0.7)], key)
    clauses = [[combine.Atom("?x", "p", "n")], [combine.Atom("?x", "q", "n", negated=True)]]
    found = spark.createDataFrame([("a",), ("b",)], "x string")
    got = {r.x: r.query_score for r in combine.disjuncts_over_bindings(found, clauses, ledger, F.lit(0.0)).collect()}
    assert got == pytest.approx({"a": 1 - 0.1 * 0.2, "b": 1 - 0.9 * 0.7})
    least = {r.x: r.query_score for r in combine.disjuncts_over_bindings(found, clauses, ledger, F.lit(0.0), least=True).collect()}
    assert least == pytest.approx({"a": 0.9, "b": 0.3})
    with pytest.raises(ValueError):
        conditions.conjunctive_beam([combine.Atom("?x", "p", "?y")], {"x": found, "y": found.toDF("y")}, ledger, F.lit(0.0), 3)


def test_ego_network_and_walk_subgraph(spark):
    edges = [(a, "r", b) for a, b in town()]
    e = spark.createDataFrame(edges, "src string, rel string, dst string")
    near = collections.defaultdict(set)
    for a, _, b in edges:
        near[a].add(b)
        near[b].add(a)
    inside = {"n03"} | near["n03"]
    got = walks.ego_network(e, spark.createDataFrame([("n03",)], "centre string"), 1).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(x for x in edges if x[0] in inside and x[2] in inside)
    some = walks.ego_network(e, spark.createDataFrame([("n03",)], "centre string"), 2, frontier=1)
    assert len({n for r in some.collect() for n in (r.src, r.dst)}) <= 3
    used = walks.walk_subgraph(e, spark.createDataFrame([("w", "n00")], "walk string, node string"), 5, seed=1)
    found = [tuple(r) for r in used.collect()]
    assert 0 < len(found) <= 5 and set(found) <= set(edges)
    assert graph.components(used).select("root").distinct().count() == 1
