from pyspark.sql import functions as F

from loomgraph.operators import linking


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lists_keep_their_order(spark):
    df = spark.createDataFrame([(["c", "a"], ["b", "a"], ["c"])], "a array<string>, b array<string>, w array<string>")
    r = df.select(linking.merged(F.col("a"), F.col("b")).alias("m"), linking.merged(F.col("a"), F.col("b"), F.col("w")).alias("n"), linking.updated_chunk_ids(F.col("a"), F.col("w"), F.lit(["d"])).alias("u")).first()
    assert (r.m, r.n, r.u) == (["c", "a", "b"], ["a", "b"], ["a", "d"])


def test_linked_facts_drop_unknown_ends(spark):
    facts = spark.createDataFrame([("x", "D", "y", "E"), ("x", "E", "y", "E")], "subject_name string, subject_domain string, object_name string, object_domain string")
    known = spark.createDataFrame([(1, "x", "D"), (2, "y", "E")], "id int, name string, domain string")
    assert rows(linking.linked_facts(facts, known).select("subject_id", "object_id")) == [(1, 2)]


def test_rules_samples_and_walks(spark):
    rules = spark.createDataFrame([("A", "KEEP", None), ("B", "KEEP", None)], "original string, action string, new_relation string")
    assert sorted((r.original, r.action, r.new_relation or "") for r in linking.migrated_rules(rules, {"B": ("SWAP", "C")}).collect()) == [("A", "KEEP", ""), ("B", "SWAP", "C")]
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    one, two = (rows(linking.stratified(df, ["g"], "id", 5, seed)) for seed in (1, 2))
    assert len(one) == 15 and one != two and one == rows(linking.stratified(df, ["g"], "id", 5, 1))
    b = spark.createDataFrame([("r", ["r", "p", "a"]), ("r", ["r"])], "root string, walk array<string>")
    f = spark.createDataFrame([("r", ["r", "q", "z"])], "root string, walk array<string>")
    assert {"".join(r.walk) for r in linking.combined_walks(b, f).collect()} == {"aprqz", "rqz"}


def test_context_and_final_order(spark):
    context = spark.createDataFrame([("e1", 1), ("e2", 5)], "edge string, t int")
    targets = spark.createDataFrame([("x", 4), ("x", 9)], "edge string, t int")
    assert rows(linking.context_before(context, targets, "t")) == [("e1", 1)]
    h = spark.createDataFrame([(["a", "b"], 0.1), (["c", "d"], 0.9)], "pair array<string>, score double")
    assert [r.pair for r in linking.finalized(h, "pair", "score").collect()] == ["c <=====> d", "a <=====> b"]
    e = spark.createDataFrame([("n", 1.0), ("n", 3.0), ("z", 0.0)], "node string, w double")
    assert rows(linking.edge_weights(e, "node", "w").select("node", "normalised")) == [("n", 0.25), ("n", 0.75), ("z", 0.0)]
