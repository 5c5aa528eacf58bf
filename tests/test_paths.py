"""Searches from both ends against plain Python, on graphs with cycles, hubs and parts that don't meet."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, hypotheses, paths


def graph_of(seed, nodes=14, edges=20):
    rnd = random.Random(seed)
    return sorted({(f"n{rnd.randrange(nodes):02}", rnd.choice("rst"), f"n{rnd.randrange(nodes):02}") for _ in range(edges)} | {("z1", "r", "z2"), ("z2", "s", "z2")})


def near_of(edges, both):
    near = collections.defaultdict(set)
    for s, _, o in edges:
        near[s].add(o)
        if both:
            near[o].add(s)
    return near


def plain_paths(near, nodes, s, t, k=None):
    """All shortest paths, or all simple ones of k edges."""
    if s not in nodes or t not in nodes:
        return []
    if k is None:
        seen, layer = {s: 0}, [(s,)]
        while layer:
            if found := [p for p in layer if p[-1] == t]:
                return found
            grown = [(*p, n) for p in layer for n in near[p[-1]] if n not in seen]
            for p in grown:
                seen[p[-1]] = len(p) - 1
            layer = grown
        return []
    layer = [(s,)]
    for _ in range(k):
        layer = [(*p, n) for p in layer for n in near[p[-1]] if n not in p]
    return [p for p in layer if p[-1] == t]


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    edges = graph_of(request.param)
    nodes = {n for s, _, o in edges for n in (s, o)}
    names = [f"n{i:02}" for i in range(0, 14, 3)] + ["z1", "z2", "nowhere"]
    pairs = list(itertools.product(names, names))
    return edges, nodes, pairs, spark.createDataFrame(edges, "src string, rel string, dst string"), spark.createDataFrame(pairs, "source string, target string")


def found(df):
    return sorted((r.source, r.target, tuple(r.path)) for r in df.collect())


def test_shortest_paths(case):
    edges, nodes, pairs, e, p = case
    near = near_of(edges, False)
    want = sorted((s, t, x) for s, t in pairs for x in plain_paths(near, nodes, s, t))
    assert found(paths.shortest_paths(e, p)) == want
    lengths = {(r.source, r.target): r.length for r in paths.pair_lengths(e, p).collect()}
    least = {(s, t): len(x) - 1 for s, t, x in want}
    assert lengths == {x: least.get(x, -1) for x in pairs}
    assert found(paths.shortest_path(e, p)) == sorted((s, t, min(x for a, b, x in want if (a, b) == (s, t))) for s, t in least)
    some = {(r.source, r.target): r.length for r in paths.pair_lengths(e, p, 2).collect()}
    assert all(n == least.get(x, -1) or n is None and (x not in least or least[x] > 2) for x, n in some.items()) and None in some.values()


def test_simple_paths(case):
    edges, nodes, pairs, e, p = case
    near = near_of(edges, True)
    for k in (1, 2, 3, 4):
        assert found(paths.simple_paths(graph.undirected(e), p, k)) == sorted((s, t, x) for s, t in pairs for x in plain_paths(near, nodes, s, t, k) if s != t)


def plain_facts(edges, path, allowed=None, reverse=True):
    hops = [[f for f in edges if (f[0], f[2]) == (u, v) or reverse and (f[2], f[0]) == (u, v)] for u, v in itertools.pairwise(path)]
    assert all(hops)
    return list(itertools.product(*[[f for f in h if allowed is None or f[1] in allowed] for h in hops]))


@pytest.mark.parametrize("k", [None, 1, 3])
@pytest.mark.parametrize("allowed", [None, ["r", "s"]])
def test_candidate_paths(case, k, allowed):
    edges, nodes, pairs, e, p = case
    near, want = near_of(edges, True), []
    for s, t in pairs:
        shortest = plain_paths(near, nodes, s, t)
        least = len(shortest[0]) - 1 if shortest else -1
        chosen = shortest if k in (None, least) else sorted(plain_paths(near, nodes, s, t, k))[:2] if 0 < least < k else []
        want += [(s, t, x) for path in chosen if len(path) > 1 for x in plain_facts(edges, path, allowed)]
    got = paths.candidate_paths(e, p, k, max_candidates=2, allowed=allowed)
    assert sorted((r.source, r.target, tuple(map(tuple, r.facts))) for r in got.collect()) == sorted(want)


def test_fact_paths(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "s", "a"), ("a", "t", "b"), ("b", "r", "c")], "src string, rel string, dst string")
    p = spark.createDataFrame([("a", "c", ["a", "b", "c"]), ("a", "a", ["a"])], "source string, target string, path array<string>")
    told = lambda df: sorted(" ".join("".join(f) for f in r.facts) for r in df.collect())
    assert told(paths.path_triples(p, e)) == ["arb brc", "atb brc"]
    assert told(paths.path_triples(p, e, inverse=True)) == ["arb brc", "atb brc", "bsa brc"]
    assert told(paths.fact_paths(p, e, reverse=True, most=2)) == ["arb brc", "atb brc"]
    assert told(paths.fact_paths(p, e, allowed=["s"])) == []
    with pytest.raises(ValueError):
        paths.fact_paths(p.withColumn("path", F.array(F.lit("c"), F.lit("a"))), e)


def test_path_lengths_beyond_the_bound(spark):
    """A chain of five: the bound drops the far pair, however the search goes, and keeps the pair without a path."""
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("e", "d"), ("x", "y"), ("w", "w")], "src string, dst string").withColumn("rel", F.lit("-"))
    h = spark.createDataFrame([("a", "e"), ("e", "b"), ("a", "x"), ("a", "w"), ("a", "nowhere"), ("w", "w"), ("a", "b")], "a string, b string")
    told = lambda df: sorted((r.a, r.b, r.shortest_path_length) for r in df.collect())
    none = [("a", "nowhere", -1), ("a", "w", -1), ("a", "x", -1)]
    assert told(hypotheses.path_length_filter(h, e, "a", "b", most=3)) == sorted([*none, ("a", "b", 1), ("e", "b", 3), ("w", "w", 0)])
    assert told(hypotheses.path_length_filter(h, e, "a", "b", least=2)) == [("a", "e", 4), ("e", "b", 3)]
    assert told(hypotheses.path_length_filter(h, e, "a", "b", least=3, most=5, include_extrema=True)) == [("a", "b", 3), ("e", "b", 5)]


def test_components(spark):
    e = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "e"), ("f", "f"), ("a", "c"), ("e", "e")], "src string, dst string")
    assert {(r.node, r.root) for r in graph.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")}
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)], "src string, dst string")
    assert {r.root for r in graph.components(chain).collect()} == {"000"}


def test_forget_deletes(spark):
    df = graph.stored(spark.range(3))
    place = df.inputFiles()[0]
    graph.forget(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(place.rsplit("/", 1)[0])
