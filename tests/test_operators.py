import json
import uuid

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions import text as tx
from loomgraph.functions import vectors
from loomgraph.operators import chunking, clean, graph, hypotheses, metrics, paths, relational, retrieval, splits
from loomgraph.plans import combine, conditions
from loomgraph.sources import readers, writers
from loomgraph.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_column_checks(spark):
    df = spark.createDataFrame([(1, None), (2, "-"), (3, "x")], "a int, b string")
    with pytest.raises(relational.MissingColumnError):
        relational.select_columns(df, ["nope"])
    with pytest.raises(relational.EmptyListError):
        relational.concat([])
    assert relational.column_has_nulls(df, "b") and not relational.column_has_nulls(df, "a")
    assert rows(relational.filter_by_value(df, ["b"])) == [(3, "x")]
    assert rows(relational.split_column(spark.createDataFrame([("p|q|r",), ("z",)], "c string"), "c", "x", "y").select("x", F.coalesce("y", F.lit("none")))) == [("p", "q"), ("z", "none")]


def test_insert_ignore_and_upsert(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    assert rows(relational.insert_ignore(old, new, ["k"])) == [(2, "c")]
    assert rows(relational.upsert(old, new.dropDuplicates(), ["k"])) == [(1, "b"), (2, "c")]


def test_clean_relations(spark):
    raw = [(1, "treats", '"Chem|C1"', "Gene|G1"), (1, "treats", "Chem|C1", "Gene|G1"), (2, "treats", "Chem|-", "Gene|G1"), (3, None, "Chem|C1", "Gene|G2")]
    got = clean.clean_relations(spark.createDataFrame(raw, schemas.RELATIONS)).collect()
    assert {(r.pmid, r.relation_type, r.subject_domain, r.subject_raw) for r in got} == {(1, "TREATS", "CHEM", "C1")}


def test_last_edge_and_domains(spark):
    e = spark.createDataFrame([("a", "r", "b", 2000, 0), ("a", "r", "b", 2001, 1)], "subject_id string, relation_type string, object_id string, year int, pos int")
    assert [r.year for r in clean.last_edge(e, "pos").collect()] == [2001]
    e = e.withColumns({"subject_domain": F.lit("S"), "object_domain": F.lit("O")})
    assert rows(clean.entity_domains(e, "pos")) == [("a", "S"), ("b", "O")]


def test_annotations(spark, tmp_path):
    record = {"id": "7", "passages": [{"infons": {"type": "title", "year": "2001"}, "text": "t", "annotations": [{"infons": {"name": "N", "type": "Gene", "identifier": "G1"}, "text": "n", "locations": [{"offset": 3, "length": 4}]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(record) + "\n{broken\n")
    df = readers.ndjson(spark, str(tmp_path / "a.json"), schemas.ANNOTATED)
    assert [tuple(r) for r in clean.annotations(df).collect()] == [("7", "N", "n", "Gene", "G1", 3, 7)]
    assert readers.ndjson(spark, str(tmp_path / "a.json"), schemas.ANNOTATED, valid=False).count() == 1


def test_history_is_strictly_before(spark):
    f = spark.createDataFrame([("p", "a", 1), ("p", "b", 1), ("p", "c", 2)], "s string, r string, t int")
    assert [tuple(r) for r in splits.history_labels(f, ["s"], "r", "t").select("r", F.array_join("labels", "")).orderBy("r").collect()] == [("a", "a"), ("b", "b"), ("c", "abc")]


def test_timestamp_batches(spark):
    f = spark.createDataFrame([(t, i) for t in (1, 2) for i in range(5)], "t int, i int")
    assert rows(splits.timestamp_batches(f, "t", "i", 2).groupBy("t", "batch").count()) == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (2, 0, 2), (2, 1, 2), (2, 2, 1)]


def test_prepare(spark):
    raw = spark.createDataFrame([("A <=====> B", "r1, r2", "0.5, 0.25", "r2"), ("C <=====> D", None, None, None)], "pair string, predictions string, confidence string, known string")
    assert [(r.node_pair, r.relation, r.confidence_score) for r in hypotheses.prepare(raw).collect()] == [(["A", "B"], "r1", 0.5)]


def test_top_k_counts_either_end(spark):
    h = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("a", "d", 0.7), ("d", "e", 0.1)], "x string, y string, s double")
    assert rows(hypotheses.top_k_per_entity(h, 1, "x", "y", "s")) == [("a", "b", 0.9), ("a", "c", 0.8), ("a", "d", 0.7), ("d", "e", 0.1)]


def test_node_scores(spark):
    """Windows [0, 2), [2, 4) of the range [0, 6); the last two years count in D alone."""
    import math

    years = {"a": [0, 0, 2, 4, 5], "b": [1]}
    e = spark.createDataFrame([(n, "-", y) for n, ys in years.items() for y in ys] + [("a", "-", 9)], "subject_id string, object_id string, year int").withColumn("object_id", F.concat("subject_id", F.lit("'")))
    own = {r.node_id: r.score for r in hypotheses.recency_scores(e, 0, 6, 2, 0.5).collect()}
    coded = {r.node_id: r.score for r in hypotheses.recency_scores(e, 0, 6, 2, 0.5, as_coded=True).collect()}
    assert own["a"] == pytest.approx(math.log(6) * (2 * 0.5 + 1 * 1.0)) and own["b"] == pytest.approx(math.log(2) * 0.5)
    assert coded["b"] == pytest.approx(math.log(2) * 2 * (2 * 0.5 + 1 + 0.5))
    entropy = {r.node_id: r.score for r in hypotheses.entropy_scores(e, 0, 6, 2).collect()}
    assert entropy["a"] == pytest.approx((1 + 3 / 5) * math.log(5)) and entropy["b"] == 0


def test_entity_years_and_recent(spark):
    e = spark.createDataFrame([("a", "b", 2000, 1), ("a", "b", 2003, 2), ("a", "c", None, 3)], "subject_id string, object_id string, year int, paper int")
    years = hypotheses.entity_years(e)
    assert rows(years.select("entity", "mode_year", "median_year", "papers")) == [("a", 2000, 2001, 2), ("b", 2000, 2001, 2)]
    pairs = spark.createDataFrame([("a", "b"), ("a", "z"), ("y", "z")], "x string, y string")
    got = {(r.x, r.y): (r.recency_median, r.papers_count) for r in hypotheses.recent(pairs, years, "x", "y").collect()}
    assert got == {("a", "b"): ([2001, 2001], [2, 2]), ("a", "z"): ([2001, None], [2, None]), ("y", "z"): ([None, None], [None, None])}
    assert {(r.x, r.y) for r in hypotheses.recent(pairs, years, "x", "y", 2001).collect()} == {("a", "b"), ("a", "z")}


def test_self_pair_takes_one_place(spark):
    h = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.8), ("a", "c", 0.7)], "x string, y string, s double")
    assert ("a", "b", 0.8) in rows(hypotheses.top_k_per_entity(h, 2, "x", "y", "s"))


def test_proportion_split_is_contiguous(spark):
    got = {r.id: r.split for r in splits.proportion_split(spark.range(17), "id", (0.5, 0.2, 0.3)).collect()}
    assert [got[i] for i in range(17)] == ["train"] * 8 + ["val"] * 3 + ["test"] * 6
    with pytest.raises(ValueError):
        splits.proportion_split(spark.range(3), "id", (0.5, 0.2))


def test_path_length_filter(spark):
    e = spark.createDataFrame([("p", "q"), ("q", "r"), ("x", "y")], "src string, dst string").withColumn("rel", F.lit("-"))
    h = spark.createDataFrame([("p", "r"), ("r", "q"), ("p", "x"), ("p", "p")], "a string, b string")
    only_most = hypotheses.path_length_filter(h, e, "a", "b", most=1)
    assert rows(only_most.select("a", "b", "shortest_path_length")) == [("p", "p", 0), ("p", "x", -1), ("r", "q", 1)]
    assert rows(hypotheses.path_length_filter(h, e, "a", "b", least=1).select("a", "b")) == [("p", "r"), ("r", "q")]


def test_filtered_ranking(spark):
    s = spark.createDataFrame([("q", "x", 0.9, False), ("q", "y", 0.8, False), ("q", "z", 0.5, True)], "q string, o string, score double, hit boolean")
    known = spark.createDataFrame([("q", "x"), ("q", "z"), ("other", "y")], "q string, o string")
    assert rows(metrics.ranks(metrics.without_known(s, known, ["q", "o"], "hit"), "q", "score", "hit")) == [("q", 2, 2)]


def test_combined_scores(spark):
    s = spark.createDataFrame([("c", 1, 0.5, 2.0), ("c", 1, 0.4, 1.0), ("c", 2, 0.1, 0.0)], "cand string, clause int, score double, w double")
    assert combine.disjunction_of_conjunctions(s, "cand", "clause", "score").first().query_score == pytest.approx(1 - (1 - 0.2) * (1 - 0.1))
    assert combine.disjunction_of_conjunctions(s, "cand", "clause", "score", least=True).first().query_score == pytest.approx(0.4)
    assert combine.weighted_score(s, "cand", "score", "w").first().weighted_score == pytest.approx(1.4)
    assert combine.weighted_score(s.filter("clause = 2"), "cand", "score", "w").first().weighted_score == 0


def test_metrics_ties(spark):
    s = spark.createDataFrame([(1, 0.5, True), (1, 0.5, False), (1, 0.1, False)], "q int, score double, hit boolean")
    assert rows(metrics.ranks(s, "q", "score", "hit")) == [(1, 2, 1)]


#: Streets of a small town, with two shortest ways from the mill to the port and one road of two names.
EDGES = [("mill", "lane", "inn"), ("inn", "road", "port"), ("mill", "road", "inn"), ("port", "ferry", "isle"), ("mill", "path", "farm"), ("farm", "path", "port")]


def test_paths(spark):
    e = spark.createDataFrame(EDGES, "src string, rel string, dst string")
    pairs = spark.createDataFrame([("mill", "port"), ("mill", "isle"), ("isle", "mill"), ("inn", "inn")], "source string, target string")
    assert rows(paths.pair_lengths(e, pairs)) == [("inn", "inn", 0), ("isle", "mill", -1), ("mill", "isle", 3), ("mill", "port", 2)]
    found = {tuple(r.path) for r in paths.shortest_paths(e, pairs).collect()}
    assert found == {("mill", "inn", "port"), ("mill", "farm", "port"), ("mill", "inn", "port", "isle"), ("mill", "farm", "port", "isle"), ("inn",)}
    facts = paths.fact_paths(paths.shortest_paths(e, pairs.filter("target = 'port'")), e)
    assert {r.p for r in facts.select(tx.render_path(F.col("facts")).alias("p")).collect()} == {"[mill-lane->inn] <> [inn-road->port]", "[mill-road->inn] <> [inn-road->port]", "[mill-path->farm] <> [farm-path->port]"}


def test_walk_transforms(spark):
    w = spark.createDataFrame([("a", list("apbqa")), ("a", list("apcqd")), ("z", ["z"])], "root string, walk array<string>")
    assert {tuple(r.x) for r in w.select(graph.anonymous(F.col("walk")).alias("x")).collect()} == {("a", "1", "2", "3", "a"), ("a", "1", "2", "3", "4"), ("z",)}
    assert {r.vertex for r in graph.walklets(w).collect()} == set("pbqacd")
    assert {"".join(r.walk) for r in graph.frequent_hops(w, 0.5).collect()} == {"apbqa", "apcqd", "z"}
    rare = w.unionByName(spark.createDataFrame([("a", list("axe"))], w.schema))
    assert {"".join(r.walk) for r in graph.frequent_hops(rare, 0.5).filter("root = 'a'").collect()} == {"apbqa", "apcqd"}
    assert {"".join(r.walk) for r in graph.n_gram_walks(w, 3).collect()} == {"apbq0", "apcq1", "z"}
    starred = {"".join(r.walk) for r in graph.with_wildcards(w.filter("root = 'a' and walk[2] = 'b'"), [1, 2]).collect()}
    assert len(starred) == 1 + 4 + 6 and "a*b*a" in starred and all(x[0] == "a" for x in starred)


def test_personalised_page_rank_sums_to_one(spark):
    e = spark.createDataFrame(EDGES, "src string, rel string, dst string")
    home = spark.createDataFrame([("mill",)], "node string")
    assert graph.page_rank(e, 3, restart=home).agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_walks_keep_dead_ends(spark):
    e = spark.createDataFrame(EDGES, "src string, rel string, dst string")
    got = {">".join(r.walk) for r in graph.walks(e, spark.createDataFrame([("port",), ("isle",)], "root string"), 2).collect()}
    assert got == {"port>ferry>isle", "isle"}


def test_not_link_is_anchored(spark):
    e = spark.createDataFrame([("a", "r1", "n"), ("a", "r2", "n"), ("b", "r2", "n"), ("c", "r1", "m")], "subject_id string, relation_type string, object_id string")
    not_r1 = conditions.NotLink(conditions.Link("r1", "n"))
    assert rows(not_r1.nodes(e)) == [("b",)]
    everyone = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    assert rows(conditions.NotLink(conditions.Link("r1", "n"), everyone).nodes(e)) == [("b",), ("c",)]


def test_resolution(spark):
    new = spark.createDataFrame([("x", "d", [1.0, 0.0]), ("y", "d", [0.9, 0.1]), ("z", "d", [0.0, 1.0])], "name string, domain string, vector array<double>")
    old = spark.createDataFrame([(1, "x", "d", [1.0, 0.0])], "id int, name string, domain string, vector array<double>")
    assert {r.name: r.id for r in retrieval.resolve(new, old, 0.8).collect()} == {"x": 1, "y": 1, "z": None}


def test_uuid_and_sentences(spark):
    df = spark.createDataFrame([("One. Two! Three is longer? Four",)], "t string")
    r = df.select(tx.uuid5(F.col("t")).alias("u"), tx.sentence_chunks(F.col("t"), 10).alias("c"), tx.sentence_chunks(F.lit(""), 10).alias("e")).first()
    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, "One. Two! Three is longer? Four"))
    assert r.c == ["One. Two!", "Three is longer?", "Four"] and r.e == []


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "n.nt").write_text('<a> <p> <b> .\n# note\n<b> <skip> "x" .\n')
    assert [tuple(r) for r in readers.n_triples(spark, str(tmp_path / "n.nt"), ["skip"]).collect()] == [("a", "p", "b")]
    (tmp_path / "e.tsv").write_text("subject_id\tobject_id\trelation_type\tyear_occurrences\tnumber_of_occurrences\na\tb\tr\t2016|2017\t2\n")
    assert [r.year for r in readers.edges_by_year(spark, str(tmp_path / "e.tsv")).collect()] == [2016, 2017]
    with pytest.raises(ValueError):
        writers.delimited(spark.range(1), str(tmp_path / "x.csv"), sep="\t")
    made = []
    for _ in range(2):
        writers.cached(spark, str(tmp_path / "cache"), {"a": 1}, lambda: made.append(1) or spark.range(3))
    assert made == [1]


def test_stream_adds_each_key_once(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    for lot in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(lot, "k int, v string").write.mode("append").parquet(src)
        q = incremental.append_new(incremental.file_stream(spark, src, spark.read.parquet(src).schema), store, ["k"], str(tmp_path / "checkpoint"))
        q.awaitTermination()
    assert rows(spark.read.parquet(store)) == [(1, "a"), (2, "b"), (3, "d")]


def test_polling(spark):
    e = spark.createDataFrame([("a", 0, 3, list("stuvwxyz")), ("b", 1, 3, ["m"]), ("c", 2, 3, ["p", "q"])], "entity string, rank int, n int, chunks array<string>")
    got = {r.entity: "".join(r.taken) for r in retrieval.poll_chunks(e, 5, 1).collect()}
    assert got == {"a": "stuvwxy", "b": "m", "c": "p"}
    two = e.withColumn("q", F.lit(1)).unionByName(e.withColumn("q", F.lit(2)))
    assert {(r.q, r.entity, "".join(r.taken)) for r in retrieval.poll_chunks(two, 5, 1, ("q",)).collect()} == {(q, k, v) for q in (1, 2) for k, v in got.items()}


def test_insert_ignore_takes_nulls_as_equal(spark):
    old = spark.createDataFrame([(None, 1)], "k int, v int")
    new = spark.createDataFrame([(None, 1), (None, 2), (3, 1)], "k int, v int")
    assert rows(relational.insert_ignore(old, new, ["k"])) == [(3, 1)]


def test_nearest_leaves_null_vectors_aside(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in retrieval.nearest(v, v, 2).collect()} == {(1, 2), (2, 1)}


def test_identity_uuid_equals_the_json_one(spark):
    import json

    names = ['plain', 'quo"te \\ back', "über 😀 \u2028", "", "tab\tline\n"]
    got = spark.createDataFrame([(x,) for x in names], "name string").select("name", tx.identity_uuid(name=F.col("name"), domain=F.lit("d")).alias("id")).collect()
    for r in got:
        assert r.id == str(uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(sorted({"name": r.name, "domain": "d"}.items()))))


def test_small_functions(spark):
    df = spark.createDataFrame([("x [A b]", "<think>no</think>yes", "a;b,c", "r/s", "r/t", 86400 * 366, 0.5, 0.25)], "l string, t string, m string, p string, q string, e long, x double, y double")
    c = F.col
    r = df.select(tx.without_thoughts(c("t")).alias("t"), tx.same_parent(c("p"), c("q")).alias("s"), tx.year_of_epoch(c("e")).alias("y"), vectors.product_norm(c("x"), c("y")).alias("n"), vectors.product_conorm(c("x"), c("y")).alias("o"), tx.split_by_markers(c("m"), [";", ","]).alias("m")).first()
    assert (r.t.strip(), r.y, r.n, r.o) == ("yes", 1971, 0.125, 0.625) and isinstance(r.s, bool) and "".join(r.m) == "abc"


def test_where(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(6)], "a int, b int")
    assert [r.a for r in relational.where(df, ["a"], {"b": 1}, ["a"], limit=1, offset=1).collect()] == [3]
    with pytest.raises(Exception, match="nope"):
        relational.where(df, ["nope"])


def test_json_records_and_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert [r.record for r in writers.json_records(df).collect()] == ['{"a":1,"b":"x"}']
    for _ in range(2):
        writers.append_ndjson(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_publication_files(spark, tmp_path):
    (tmp_path / "p.ndjson").write_text('{"pmid": " 1 ", "year": 2000, "title": " t ", "authors": [{"first_name": "", "last_name": " "}, {"first_name": "F", "last_name": "L"}]}\n{"pmid": "2", "year": 0, "authors": [{"first_name": "F", "last_name": "L"}]}\nnot json\n')
    got = readers.publications(spark, str(tmp_path / "p.ndjson")).collect()
    assert [(r.pmid, r.title, len(r.authors)) for r in got] == [("1", "t", 1)]
    (tmp_path / "l.ndjson").write_text('{"pmid": "1", "node_id": "n"}\n{"pmid": "1"}\n')
    assert rows(readers.publication_links(spark, str(tmp_path / "l.ndjson"))) == [("1", "n")]
    for name, schema in (("p", schemas.PUBLICATIONS), ("l", schemas.LINKS)):
        readers.ndjson(spark, str(tmp_path / f"{name}.ndjson"), schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [r.pmid for r in readers.publications(spark, str(tmp_path / "p.parquet"), parquet=True).collect()] == ["1"]
    assert rows(readers.publication_links(spark, str(tmp_path / "l.parquet"), parquet=True)) == [("1", "n")]
    (tmp_path / "r.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert readers.row_count(spark, str(tmp_path / "r.csv")) == 2


def test_answer(spark):
    e = spark.createDataFrame([("a", "r", "n"), ("b", "r", "n"), ("c", "s", "n")], "subject_id string, relation_type string, object_id string")
    got = conditions.answer(e, conditions.Link("r", "n"), "t", "z", 1).collect()
    scores = {r.node_id: r.score for r in conditions.answer(e, conditions.Link("r", "n"), "t", "z", 9).collect()}
    assert set(scores) == {"a", "b"} and got[0].node_id == max(scores, key=lambda k: (scores[k], k))


def test_rule_and_hypothesis_files(spark, tmp_path):
    (tmp_path / "rules.jsonl").write_text('{"relation": "acts on", "action": "KEEP"}\n{"relation": "hit by", "action": "SWAP", "new_relation": "hits"}\n{"relation": "x", "action": "DROP"}\n')
    assert rows(readers.relation_rules(spark, str(tmp_path / "rules.jsonl"))) == [("ACTS_ON", "ACTS_ON", False), ("HIT_BY", "HITS", True)]
    (tmp_path / "h" / "deep").mkdir(parents=True)
    (tmp_path / "h" / "deep" / "drug.csv").write_text("pair,relation,score\nA [1] to B [2],treats,0.5\nno ids,treats,0.5\n")
    assert rows(readers.hypothesis_files(spark, str(tmp_path / "h"))) == [("1", "2", "TREATS", 0.5, "drug")]


def test_section_chunks(spark):
    text = "intro.\n# A\none. two.\n| table |\n## B\nthree.\n# C\nfour."
    got = chunking.section_chunks(spark.createDataFrame([(1, text)], "id int, text string"), "id", 6).orderBy("section", "chunk").collect()
    assert [(r.path, r.chunk_text) for r in got] == [("", "intro."), ("A", "one."), ("A", "two."), ("A / B", "three."), ("C", "four.")]


def test_named_paths(spark):
    p = spark.createDataFrame([(1, "[a-knows->b] <> [b-likes->z]")], "id int, path string")
    n = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "node_id string, node_name string")
    assert [r.path for r in chunking.named_paths(p, n, "id").collect()] == ["[Ann-knows->Bob] <> [Bob-likes->z]"]
    hyphens = spark.createDataFrame([(1, "[a-b-knows-of->c-d] <> [c-d-likes->x-y]")], "id int, path string")
    n = spark.createDataFrame([("a-b", "Ann"), ("c-d", "Bob")], "node_id string, node_name string")
    assert [r.path for r in chunking.named_paths(hyphens, n, "id").collect()] == ["[Ann-knows-of->Bob] <> [Bob-likes->x-y]"]
