"""Runs of walks, numbered for many roots at once: the same as by windows and by plain Python."""

import collections
import contextlib
import io
import itertools
import random

import pytest

from loomgraph.operators import graph

SCHEMA = "root string, walk array<string>"


def plain_walks(rows, n, wildcards):
    by_root = collections.defaultdict(set)
    for root, walk in rows:
        by_root[root].add(tuple(walk))
        for k in wildcards:
            for places in itertools.combinations(range(1, len(walk)), k):
                by_root[root].add(tuple("*" if i in places else x for i, x in enumerate(walk)))
    out = set()
    for root, walks in by_root.items():
        numbers = {}
        for walk in sorted(walks):
            made = [x if i % 2 or i < max(2, n) else numbers.setdefault(walk[i - n + 1 : i + 1], str(len(numbers))) for i, x in enumerate(walk)]
            out.add((root, tuple(made)))
    return out


def some_walks(seed):
    rnd = random.Random(seed)
    names = ["a", "b", "ab", "*", "é", "0", "B"]
    return [(r, [r] + [rnd.choice(names) for _ in range(rnd.choice((0, 2, 4, 6)))]) for r in (f"r{rnd.randrange(9)}" for _ in range(120))] + [("hub", ["hub", "x", rnd.choice(names), "y", str(i)]) for i in range(40)]


@pytest.mark.parametrize("n,wildcards,at_once,of_a_root", [(3, (1, 3), 16, 1000), (3, (), 1000, 1000), (2, (2,), 1, 1000), (4, (1,), 7, 1000), (1, (1, 2), 50, 1000), (3, (1, 3), 16, 20)])
def test_numbers_of_runs(spark, monkeypatch, n, wildcards, at_once, of_a_root):
    monkeypatch.setattr(graph, "WALKS_AT_ONCE", at_once)
    monkeypatch.setattr(graph, "WALKS_OF_A_ROOT", of_a_root)
    rows = some_walks(n)
    made = graph.n_gram_walks(spark.createDataFrame(rows, SCHEMA).repartition(3), n, wildcards)
    got = [(r.root, tuple(r.walk)) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_walks(rows, n, wildcards)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        made.explain()
    assert ("Window" in out.getvalue()) == (of_a_root == 20)  # only where a root has many walks


def test_nulls_are_as_by_windows(spark, monkeypatch):
    rows = [(None, ["a", "b", None, "c", "d"]), (None, ["a", None, "x", "c", "d"]), ("r", None), ("r", []), ("s", None), ("q", ["q", "b", "c", "d", None])]
    df = spark.createDataFrame(rows, SCHEMA)
    sets = []
    for most in (1000, 1):
        monkeypatch.setattr(graph, "WALKS_OF_A_ROOT", most)
        sets.append({(r.root, None if r.walk is None else tuple(r.walk)) for r in graph.n_gram_walks(df, 3).collect()})
    assert sets[0] == sets[1]
    assert graph.n_gram_walks(df.limit(0), 3, (1,)).count() == 0
