"""Loops over numbers of nodes: the same ids in the end, and edges that are made and dealt once."""

import contextlib
import io

from pyspark.sql import functions as F

from loomgraph import kg, queries
from loomgraph.operators import communities, graph, retrieval, walks

from .conftest import SF


def counted(spark, rows, schema):
    """A table, and how often a row of it was made."""
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    one = F.udf(count, "long").asNondeterministic()
    return spark.createDataFrame(rows, schema).withColumn("src", one("src")), made


EDGES = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (4, 1, 2.0)]


def test_rank_and_distances_make_edges_once(spark):
    e, made = counted(spark, EDGES, "src long, dst long, weight double")
    got = {r.node: r.cost for r in graph.weighted_distances(e, spark.createDataFrame([(1,)], "source long"), 4).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 2.0, 4: 3.0} and made.value == len(EDGES)
    e, made = counted(spark, EDGES, "src long, dst long, weight double")
    assert abs(graph.page_rank(e, 3).agg(F.sum("rank")).first()[0] - 1) < 1e-9 and made.value == len(EDGES)


def test_edges_are_dealt_once(spark):
    step = graph.stored_by(spark.range(50).select(F.col("id").alias("src"), (F.col("id") % 7).alias("dst")), "src")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        spark.range(50).select(F.col("id").alias("src")).hint("merge").join(step, "src").explain()
    assert out.getvalue().count("Exchange hashpartitioning") <= 1
    graph.forget(step)


def test_codes_have_the_ids(spark):
    e = kg.edges(spark, SF).select("subject_id", "relation_type", "object_id", "year", "number_of_occurrences")
    c = kg.coded_edges(spark, SF).select(kg.id_of(F.col("src")), "rel", kg.id_of(F.col("dst")), "year", "n")
    assert sorted(map(str, map(tuple, e.collect()))) == sorted(map(str, map(tuple, c.collect())))
    keys = spark.sql("SELECT explode(array(-5L, 0L, 7L, 1152921504606846975L)) AS k")
    assert all(a == b for a, b in keys.select(kg.id_of(kg.code("PART", F.col("k"))), F.md5(F.concat(F.lit("PART|"), F.col("k").cast("string")))).collect())


def test_walks_over_numbers_are_the_same(spark):
    """Names are drawn by, but neither kept nor moved."""
    e = kg.coded_rows(spark, SF, "SUPPLIES").select("src", "rel", "dst").distinct()
    starts = e.select(F.col("src").alias("walk"), F.col("src").alias("node")).distinct()
    named = lambda df: df.select(*(kg.id_of(F.col(c)).alias(c) if t == "bigint" else c for c, t in df.dtypes))
    got = walks.seeded_walks(e, starts, 2, seed=3, name=kg.id_of, walk_name=kg.id_of)
    assert dict(got.dtypes)["node"] == "bigint"
    want = walks.seeded_walks(named(e), named(starts), 2, seed=3)
    assert set(named(got).select(*want.columns).collect()) == set(want.collect())


def text(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_statistics_of_years_move_numbers(spark):
    degrees, recent = (text(queries.QUERIES[q](spark, SF)) for q in ("q122_year_degrees", "q078_recency_filter"))
    assert "Expand" not in degrees  # no row three times
    assert not any("md5" in line.split("Exchange hashpartitioning")[-1] for line in (degrees + recent).splitlines() if "Exchange" in line)
    assert recent.count("percentile") == 0  # statistics are made once and stored


def test_hits_of_frequent_words_are_spread(spark, monkeypatch):
    """A word of all documents and queries: rows are dealt by document, in tasks of a stated size."""
    monkeypatch.setattr(retrieval, "HITS_A_TASK", 100)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("the word").alias("text"))
    asked = spark.range(10).select(F.col("id").alias("query_id"), F.lit("the").alias("text"))
    out = retrieval.bm25(docs, asked, "doc_id")
    assert out.count() == 600
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 300 and "hashpartitioning(query_id" not in text(out)


def test_communities_over_numbers_are_the_same(spark):
    e = kg.coded_rows(spark, SF, "SUPPLIES").filter("dst % 64 = 2").select("src", "dst", F.lit(1).alias("w"))
    got = communities.communities(e, rounds=2, levels=2, name=kg.id_of)
    want = communities.communities(e.select(kg.id_of(F.col("src")).alias("src"), kg.id_of(F.col("dst")).alias("dst"), "w"), rounds=2, levels=2)
    assert set(got.select(kg.id_of(F.col("node")), kg.id_of(F.col("community"))).collect()) == set(want.select("node", "community").collect())
