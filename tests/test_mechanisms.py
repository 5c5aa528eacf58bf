"""Resumable reads, mergeable scalers, table functions, the vector index, chunk look-ups and incremental stores."""

import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph import kg
from loomgraph.functions import scalers, tables
from loomgraph.operators import relational, retrieval, vector_index
from loomgraph.sources import resumable
from loomgraph.streaming import incremental

LINES = [f"line {i}" + " ä" * (i % 3) for i in range(95)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("lines")
    for k, (a, b) in enumerate(((0, 40), (40, 40), (40, 95))):
        (place / f"part-{k}.txt").write_text("".join(x + "\n" for x in LINES[a:b])[: None if k < 2 else -1])
    (place / "_hidden").write_text("no\n")
    return str(place)


def test_rows_from_any_place(spark, folder):
    resumable.register(spark)
    read = lambda **o: [tuple(r) for r in spark.read.format("lines_from").options(**o).load(folder).orderBy("row").collect()]
    assert read() == list(enumerate(LINES))
    assert read(skip=37, split=10) == list(enumerate(LINES))[37:]
    assert read(skip=95) == [] and read(skip=500) == []


def test_stream_goes_on_after_a_failure(spark, folder, tmp_path):
    """A sink that fails in its third batch; the next run goes on there, without gap or repeat."""
    resumable.register(spark)
    seen: list = []

    def run(fail_at):
        def write(batch, number):
            rows = [tuple(r) for r in batch.collect()]
            if number == fail_at:
                raise RuntimeError("stopped")
            seen.append((number, rows))

        stream = spark.readStream.format("lines_from").options(rows=20, split=7).load(folder)
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="stopped"):
        run(2)
    assert [n for n, _ in seen] == [0, 1]
    run(None)
    assert sorted(r for _, rows in seen for r in rows) == list(enumerate(LINES))
    assert all(len(rows) <= 20 for _, rows in seen)


def test_scalers_merge_in_any_order(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.gauss(1e6, 3) if k == "a" else rnd.expovariate(0.1), rnd.randrange(9)) for k in "ab" for _ in range(400)] + [("a", None, 1), ("c", 5.0, 1)]
    df = spark.createDataFrame(rows, "k string, x double, batch int")
    whole = {r.k: r for r in scalers.states(df, "x", ("k",)).collect()}
    parts = scalers.states(df, "x", ("k", "batch"))
    for order in (parts, parts.orderBy(F.desc("batch")).repartition(3)):
        got = {r.k: r for r in scalers.merged(order, ("k",)).collect()}
        for k, r in got.items():
            x = [v for kk, v, _ in rows if kk == k and v is not None]
            assert (r.n, r.low, r.high) == (len(x), min(x), max(x)) == (whole[k].n, whole[k].low, whole[k].high)
            assert r["mean"] == pytest.approx(statistics.fmean(x)) and r.m2 == pytest.approx(statistics.pvariance(x) * len(x), rel=1e-9, abs=1e-9)
    state = scalers.merged(parts, ("k",))
    median = {r.k: r.m for r in state.select("k", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("m")).collect()}
    assert all(abs(median[k] - statistics.median([v for kk, v, _ in rows if kk == k and v is not None])) < s for k, s in (("a", 0.6), ("b", 1.0)))
    for kind in ("min_max", "standard", "sigmoid"):
        there = scalers.scaled(df.filter("k <> 'c'").dropna(), "x", state, kind, ("k",))
        back = scalers.unscaled(there.withColumnRenamed("x", "was"), "x", state, kind, ("k",))
        assert all(abs(r.x - r.was) < 1e-4 * max(1, abs(r.was)) for r in back.filter("scaled < 0.999999").collect())


def test_scaler_states_of_a_stream(spark, tmp_path):
    """States that micro-batches write, merged, are the state of all rows."""
    rows = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), rows.schema, files=1)
    write = lambda batch, n: scalers.states(batch, "x").withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "states"))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(str(tmp_path / "states"))
    got, want = scalers.merged(parts).first(), scalers.states(rows, "x").first()
    assert parts.count() == 5 and (got.n, got.low, got.high) == (want.n, want.low, want.high) and got.m2 == pytest.approx(want.m2)


def test_table_function(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, 'a,"b\nc",d\n\nx'), (2, None), (3, "p,q")], "id int, text string")
    got = spark.sql("SELECT id, line, one, two FROM {df} d, LATERAL split_fields(d.text, ',', 'one, two') ORDER BY id, line", df=df).collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", "b\nc"), (1, 1, None, None), (1, 2, "x", None), (3, 0, "p", "q")]


def test_chunks_are_bounded(spark):
    sized = lambda t: pa.table({"n": pa.array([t.num_rows], pa.int64()), "total": pa.array([sum(t.column("id").to_pylist())], pa.int64())})
    got = tables.by_chunks(spark.range(1003).repartition(2), sized, "n long, total long", rows=100).collect()
    assert max(r.n for r in got) == 100 and sum(r.n for r in got) == 1003 and sum(r.total for r in got) == 1003 * 501


def test_index_recall(spark, tmp_path):
    """Queries: every vector whose id is divisible by 100, against all rows of sf0.1."""
    items = kg.table(spark, "/root/testdata/sf0.1", "embeddings")
    queries = items.filter("vec_id % 100 = 0")
    index = vector_index.build(items, str(tmp_path / "index"), cells=16, keep=("label",))
    assert index.items.count() == items.count()
    exact = {(r.query_id, r.vec_id) for r in retrieval.nearest(queries, items, 10).collect()}
    got = vector_index.search(queries, index, 10, probes=12).collect()
    recall = len(exact & {(r.query_id, r.id) for r in got}) / len(exact)
    print("recall at 10:", recall)
    assert len(exact) == 200 and recall >= 0.9
    everything = {(r.query_id, r.id) for r in vector_index.search(queries, index, 10, probes=16).collect()}
    assert everything == exact
    some = vector_index.search(queries, index, 5, probes=16, least=0.2, where=F.col("label") == 1).collect()
    labels = {r.vec_id: r.label for r in items.select("vec_id", "label").collect()}
    assert some and all(labels[r.id] == 1 and r.score >= 0.2 for r in some)


def test_nearest_by_and_threshold(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, kind string, embedding array<double>")
    cos = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    want = set()
    for i, kind, x in rows[:10]:
        best = sorted(((-round(cos(x, y), 9), j) for j, k, y in rows if k == kind and j != i and cos(x, y) >= 0.3))[:4]
        want |= {(i, j) for _, j in best}
    got = retrieval.nearest(df.filter("vec_id < 10"), df, 4, least=0.3, by="kind")
    assert {(r.query_id, r.vec_id) for r in got.collect()} == want


def test_resolve_in_a_large_domain(spark):
    known = [(i, f"k{i}", "D" if i % 3 else "E", [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(900, "k1", "D", [0.0, 0.0, 1.0])]
    new = [("k1", "D", [9.0, 9.0, 9.0]), ("other", "D", [1.0, 1.0, 1.0]), ("other", "E", [1.0, 1.0, 1.0]), ("far", "D", [-1.0, -1.0, -1.0]), ("k1", "F", [1.0, 1.0, 1.0])]
    schema = "name string, domain string, vector array<double>"
    got = {(r.name, r.domain): r.id for r in retrieval.resolve(spark.createDataFrame(new, schema), spark.createDataFrame(known, "id long, " + schema), 0.9).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    best = lambda d: min((-round(float(unit(v) @ unit([1, 1, 1])), 9), i) for i, _, dd, v in known if dd == d)[1]
    assert got == {("k1", "D"): 1, ("other", "D"): best("D"), ("other", "E"): best("E"), ("far", "D"): None, ("k1", "F"): None}


def test_publications_of_equal_concepts(spark):
    """A concept that many publications have alone: the most cited are first, as without groups."""
    links = [(p, "hot") for p in range(300)] + [(1000, "hot"), (1000, "rare"), (1001, "rare")]
    pubs = [(p, p % 50) for p in range(300)] + [(1000, 7), (1001, None)]
    asked = [("q", "hot"), ("z", "rare"), ("z", "hot")]
    got = retrieval.publications_for(spark.createDataFrame(asked, "question_id string, concept string"), spark.createDataFrame(links, "publication_id long, concept string"), spark.createDataFrame(pubs, "publication_id long, citations int"), 4)
    own, matched = {}, {}
    for p, c in links:
        own[p] = own.get(p, 0) + 1
        for q, cc in asked:
            matched[q, p] = matched.get((q, p), 0) + (c == cc)
    cited = dict(pubs)
    want = set()
    for q in "qz":
        order = sorted((-matched[q, p] / own[p], -(cited[p] if cited[p] is not None else -1), p) for p in own if matched[q, p])
        want |= {(q, p, n) for n, (_, _, p) in enumerate(order[:4], 1)}
    assert {(r.question_id, r.publication_id, r["rank"]) for r in got.collect()} == want


def test_store_takes_only_new_keys(spark, tmp_path):
    for k in range(3):
        spark.range(k * 50, k * 50 + 100).withColumn("v", F.lit(k)).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "id long, v int").schema)
        incremental.append_new(stream, str(tmp_path / "store"), ["id"], str(tmp_path / "c"), buckets=8).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "store")).select("id", "v").collect()
    assert len(rows) == 200 and {r.id for r in rows} == set(range(200))


def test_lookup_in_order(spark):
    keys, table = spark.createDataFrame([(0, "b"), (1, "x")], "pos int, k string"), spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted((r.pos, r.v) for r in relational.lookup_in_order(keys, table, "k").collect()) == [(0, 2), (1, None)]
    with pytest.raises(KeyError):
        relational.lookup_in_order(keys, table, "k", strict=True)
