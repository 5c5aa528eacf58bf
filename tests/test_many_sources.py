"""Distances from many sources at once: right ones, and one row for a node in a level, however many sources reach it."""

import collections
import random

import pytest

from loomgraph.operators import graph


def plain_distances(edges, sources, depth, both):
    near = collections.defaultdict(set)
    for s, o in edges:
        near[s].add(o)
        if both:
            near[o].add(s)
    out = {}
    for start in sources:
        seen = {start: 0}
        for d in range(depth):
            for x in [x for x, at in seen.items() if at == d]:
                for y in near[x]:
                    seen.setdefault(y, d + 1)
        out |= {(start, x): d for x, d in seen.items()}
    return out


@pytest.mark.parametrize("both", [False, True])
def test_sources_beyond_one_number(spark, both):
    rnd = random.Random(5)
    edges = sorted({(rnd.randrange(150), rnd.randrange(150)) for _ in range(260)})
    sources = [*range(0, 150), 999]
    got = graph.distances(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(x,) for x in sources * 2], "source long"), 4, both=both)
    rows = [tuple(r) for r in got.select("source", "node", "distance").collect()]
    assert len(rows) == len(set(rows)) and {(s, n): d for s, n, d in rows} == plain_distances(edges, sources, 4, both)


def test_a_node_is_one_row_for_its_sources(spark, monkeypatch):
    tables, store = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: tables.append(store(df)) or tables[-1])
    edges = spark.createDataFrame([(s, 100) for s in range(30)] + [(100, x) for x in range(200, 230)], "src long, dst long")
    got = graph.distances(edges, edges.select("src").where("src < 30").withColumnRenamed("src", "source"), 2)
    assert got.count() == 30 + 30 + 30 * 30
    assert [x.count() for x in tables if "mask" in x.columns] == [1, 30]
