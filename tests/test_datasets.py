"""Datasets of facts on small tables: splits, indexes, saving and loading, and what raises."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import datasets

KEY = "subject_id string, relation_type string, object_id string"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("a", "r", "b", 1990), ("b", "r", "c", 1991), ("a", "s", "c", 1995), ("c", "r", "a", 1996), ("c", "r", "z", 1996), ("x", "r", "y", 1999)]
    return spark.createDataFrame(rows, KEY + ", year int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_split_bounds_hold_both_ends(facts):
    got = datasets.temporal_split(facts, "year", {"train": (None, 1991), "val": (1995, 1996)})
    assert rows(got.select("subject_id", "object_id", "split")) == [("a", "b", "train"), ("a", "c", "val"), ("b", "c", "train"), ("c", "a", "val"), ("c", "z", "val")]


def test_dataset_prunes_and_shares_indexes(spark, facts, tmp_path):
    made = datasets.from_facts(facts, bounds={"train": (None, 1995), "val": (1996, None)}, timestamp="year")
    assert rows(made.entities) == [("a", 0), ("b", 1), ("c", 2)] and rows(made.relations) == [("r", 0), ("s", 1)]
    assert rows(made.times) == [("1990", 0), ("1991", 1), ("1995", 2), ("1996", 3)]
    assert rows(made.facts.select("s", "r", "o", "t", "split")) == [(0, 0, 1, 0, "train"), (0, 1, 2, 2, "train"), (1, 0, 2, 1, "train"), (2, 0, 0, 3, "val")]
    datasets.save(made, str(tmp_path / "kg"))
    back = datasets.load(spark, str(tmp_path / "kg"))
    assert rows(back.facts.select(made.facts.columns)) == rows(made.facts) and rows(back.entities) == rows(made.entities) and rows(back.times) == rows(made.times)
    assert rows(datasets.fact_table(back.facts.select("s", "r", "o"), back)) == rows(made.facts.select("subject_id", "relation_type", "object_id"))
    assert [r.t for r in datasets.in_time_order(made.facts).collect()] == [0, 1, 2, 3]
    whole = datasets.from_facts(facts.withColumn("id", F.col("year") * 10 + F.ascii("object_id")), shares=(0.5, 0.5, 0.0), order="id", prune=False)
    assert whole.facts.count() == 6 and whole.times is None
    two = datasets.from_splits({"train": facts.limit(0).select("subject_id", "relation_type", "object_id"), "test": facts.select("subject_id", "relation_type", "object_id")})
    assert two.facts.filter("split = 'test'").count() == 6
    datasets.save(two, str(tmp_path / "two"))
    assert datasets.load(spark, str(tmp_path / "two")).times is None


def test_graphs(facts, spark):
    doubled = facts.unionByName(spark.createDataFrame([("b", "t", "a", 1990), ("a", "r", "b", 1990)], facts.schema))
    assert ("a", "b", ["r", "r"]) in [tuple(r) for r in datasets.relation_lists(doubled).collect()]
    pair = lambda **k: [tuple(r) for r in datasets.build_graph(doubled, **k).collect() if {r.src, r.dst} == {"a", "b"}]
    assert sorted(pair()) == [("a", "r", "b"), ("b", "t", "a")] and pair(directed=False, multi=False) == [("a", "r", "b")] and sorted(pair(directed=False)) == [("a", "r", "b"), ("a", "t", "b")]
    made = datasets.mapped(facts)
    assert [tuple(r) for r in datasets.by_target(made.facts).select("o", "s").coalesce(1).collect()] == sorted(map(tuple, made.facts.select("o", "s").collect()))


def test_timestamps_literals_and_missing_vectors(spark):
    t = spark.createDataFrame([("01/02/1999",), ("soon",), (None,)], "at string")
    assert rows(datasets.with_years(t, "at", "dd/MM/yyyy")) == [(1999,)]
    x = spark.createDataFrame([('"4.5"^^<xsd:float>',), ('"word"@en-GB',), ("plain",), (None,)], "x string").select(datasets.literal(F.col("x")).alias("l")).select("l.*")
    assert rows(x) == [(4.5, "4.5"), (None, "plain"), (None, "word"), (None, None)]
    index = spark.createDataFrame([("a", 1), ("b", 0)], "id string, index long")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "id string, vector array<double>")
    assert [tuple(r) for r in datasets.ordered_matrix(index, vectors).collect()] == [(0, [2.0]), (1, [1.0])]
    with pytest.raises(KeyError):
        datasets.ordered_matrix(index, vectors.filter("id = 'a'"))
    assert rows(datasets.unique_values(t, "at", nulls=False)) == [("01/02/1999",), ("soon",)] and datasets.unique_values(t, "at").count() == 3


def test_complete_domains(spark):
    ledger = spark.createDataFrame([("a", "r", "x", 0.7)], KEY + ", score double")
    markers = spark.createDataFrame([("a", "r")], "subject_id string, relation_type string")
    wanted = spark.createDataFrame([("a", "r", "x"), ("a", "r", "y"), ("b", "r", "x")], KEY)
    got = {(r.subject_id, r.object_id): r.score for r in datasets.complete_domains(ledger, markers, wanted, F.lit(0.5)).collect()}
    assert got == {("a", "x"): 0.7, ("a", "y"): 0.0, ("b", "x"): 0.5}
