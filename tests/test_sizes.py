"""What moves in a shuffle, and how often: plans that large tables depend on."""

import contextlib
import io

from pyspark.sql import functions as F

from loomgraph import kg
from loomgraph.functions import scalers
from loomgraph.operators import graph, paths

from .conftest import SF


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_scaler_states_are_sent_to_the_rows(spark):
    rows = spark.range(20_000_000).filter("id < 60").select((F.col("id") % 3).alias("k"), (F.col("id") % 4).alias("b"), F.col("id").alias("x"))
    state = scalers.merged(scalers.states(rows, "x", ("k", "b")), ("k",))
    out = scalers.scaled(rows, "x", state, "min_max", ("k",))
    assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    assert {(r.k, round(r.scaled, 6)) for r in out.filter("x >= 57").collect()} == {(0, 1.0), (1, 1.0), (2, 1.0)}


def test_n_gram_walks_deal_walks_once(spark):
    walks = spark.createDataFrame([("a", ["a", "r", "b", "r", "c"]), ("a", ["a", "q", "b", "r", "c"]), ("a", ["a", "r", "b", "q", "d", "r", "e"]), ("b", ["b", "r", "c"])], "root string, walk array<string>")
    for wildcards in ((), (1, 3)):
        out = plan(graph.n_gram_walks(walks, 3, wildcards))
        assert out.count("Exchange") == 1 and "Join" not in out
    got = {tuple(r.walk) for r in graph.n_gram_walks(walks, 3).collect()}
    assert got == {("a", "q", "b", "r", "0"), ("a", "r", "b", "q", "1", "r", "2"), ("a", "r", "b", "r", "0"), ("b", "r", "c")}


def test_facts_are_made_distinct_by_keys(spark):
    key = ["subject_id", "relation_type", "object_id"]
    want = {tuple(r) for r in kg.edges(spark, SF).select(*key).distinct().collect()}
    got = [tuple(r) for r in kg.facts(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "md5" not in "".join(x for x in plan(kg.facts(spark, SF, "SUPPLIES")).splitlines() if "Exchange" in x)


def test_searches_run_on_numbers(spark, monkeypatch):
    seen = []
    found = paths.search
    monkeypatch.setattr(paths, "search", lambda edges, pairs, most=None: seen.extend([edges.dtypes, pairs.dtypes]) or found(edges, pairs, most))
    edges = spark.createDataFrame([("b", "a"), ("a", "c"), ("b", "d"), ("d", "c"), ("x", "y"), ("b", "a")], "src string, dst string")
    pairs = spark.createDataFrame([("b", "c"), ("b", "x"), ("b", "b")], "source string, target string")
    got = sorted(tuple(r.path) for r in paths.shortest_paths(edges, pairs, both=True).collect())
    assert got == [("b",), ("b", "a", "c"), ("b", "d", "c")]
    assert sorted(tuple(r.path) for r in paths.shortest_paths(edges, pairs, first=1).collect()) == [("b",), ("b", "a", "c")]
    assert {(r.source, r.target, r.length) for r in paths.pair_lengths(edges, pairs, both=True).collect()} == {("b", "c", 2), ("b", "x", -1), ("b", "b", 0)}
    assert {t for d in seen for _, t in d} == {"bigint"}


def test_facts_with_years(spark):
    want = {tuple(r) for r in kg.edges(spark, SF).filter("relation_type in ('SUPPLIES', 'PLACED')").select("subject_id", "relation_type", "object_id", "year").distinct().collect()}
    got = [tuple(r) for r in kg.facts(spark, SF, "SUPPLIES", "PLACED", years=True).collect()]
    assert len(got) == len(want) and set(got) == want
