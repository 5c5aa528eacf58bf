"""Registered queries of datasets of facts, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import kg
from .functions import text as tx
from .operators import datasets, relational
from .plans import conditions
from .queries import EDGES_SQL, NODES_SQL, WITH_EDGES, query, t

FACTS_SQL = EDGES_SQL + ", f AS (SELECT DISTINCT subject_id, relation_type, object_id, year FROM edges WHERE relation_type IN ('SUPPLIES', 'PLACED'))"


def _facts(spark, d):
    return kg.facts(spark, d, "SUPPLIES", "PLACED", years=True)


@query(f"""WITH {FACTS_SQL}, sp AS (SELECT *, CASE WHEN year <= 1995 THEN 'train' WHEN year BETWEEN 1996 AND 1996 THEN 'val' ELSE 'test' END AS split FROM f),
seen AS (SELECT subject_id AS id FROM sp WHERE split = 'train' UNION SELECT object_id FROM sp WHERE split = 'train'),
k AS (SELECT * FROM sp WHERE split = 'train' OR subject_id IN (FROM seen) AND object_id IN (FROM seen)),
en AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT subject_id AS id FROM k UNION SELECT object_id FROM k)),
re AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT DISTINCT relation_type AS id FROM k)), ti AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT DISTINCT year AS id FROM k))
SELECT CAST(a.i AS BIGINT) AS s, CAST(re.i AS BIGINT) AS r, CAST(b.i AS BIGINT) AS o, CAST(ti.i AS BIGINT) AS t, split FROM k JOIN en a ON a.id = subject_id JOIN en b ON b.id = object_id JOIN re ON re.id = relation_type JOIN ti ON ti.id = year""")
def q022_dataset(spark, d):
    """Facts split by year, pruned to ends that the training facts have, with shared indexes."""
    bounds = {"train": (None, 1995), "val": (1996, 1996), "test": (1997, None)}
    return datasets.from_facts(_facts(spark, d), bounds=bounds, timestamp="year").facts.select("s", "r", "o", "t", "split")


@query(f"""WITH {FACTS_SQL}, k AS (SELECT DISTINCT subject_id, relation_type, object_id, relation_type AS split FROM f),
en AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT subject_id AS id FROM k UNION SELECT object_id FROM k))
SELECT CAST(a.i AS BIGINT) AS s, CAST(b.i AS BIGINT) AS o, split FROM k JOIN en a ON a.id = subject_id JOIN en b ON b.id = object_id""")
def q023_split_tables(spark, d):
    """One table for each split, with the indexes of their union."""
    return datasets.from_splits({r: kg.facts(spark, d, r) for r in ("PLACED", "SUPPLIES")}).facts.select("s", "o", "split")


@query(f"WITH {FACTS_SQL} SELECT subject_id, object_id, string_agg(relation_type, '|' ORDER BY relation_type) AS relations FROM f GROUP BY 1, 2")
def q036_relation_lists(spark, d):
    return datasets.relation_lists(_facts(spark, d)).withColumn("relations", F.array_join("relations", "|"))


@query(f"""WITH {NODES_SQL}, dom AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT DISTINCT node_domain AS id FROM nodes WHERE node_domain <> 'ORDER'))
SELECT node_id, CAST(i AS BIGINT) AS domain_index FROM nodes LEFT JOIN dom ON id = node_domain""")
def q089_domain_indexes(spark, d):
    """Nodes with the index of their domain; orders have none in the table."""
    nodes = kg.nodes(spark, d)
    return datasets.domain_indexes(nodes, relational.dense_index(nodes.filter("node_domain <> 'ORDER'").select(F.col("node_domain").alias("id")), "id"))


@query(WITH_EDGES + """, a AS (SELECT md5('PART|' || p_partkey) AS node_id FROM part WHERE p_size > 45 UNION SELECT md5('PART|none'))
SELECT node_id, (SELECT count(*) FROM edges WHERE object_id = node_id) AS in_degree, (SELECT count(*) FROM edges WHERE subject_id = node_id) AS out_degree FROM a""")
def q105_degrees_of(spark, d):
    """Degrees of large parts and of a node that isn't there."""
    large = t(spark, d, "part").filter("p_size > 45").select(tx.node_id("PART", F.col("p_partkey")).alias("node_id"))
    none = t(spark, d, "region").select(F.md5(F.lit("PART|none")).alias("node_id"))
    return datasets.degrees_of(kg.edges(spark, d), large.unionByName(none))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) - 1 AS BIGINT) AS index, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def q108_ordered_matrix(spark, d):
    """Vectors in the order of their ids' index."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    index = relational.dense_index(e.select("id"), "id")
    rows = datasets.ordered_matrix(index, e).join(index, "index")
    return rows.select("id", "index", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT DISTINCT o_orderstatus AS value FROM orders UNION ALL SELECT NULL WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus IS NULL)")
def q111_unique_values(spark, d):
    return datasets.unique_values(t(spark, d, "orders"), "o_orderstatus").withColumnRenamed("o_orderstatus", "value")


@query(f"WITH {EDGES_SQL}, f AS (SELECT DISTINCT least(subject_id, object_id) AS src, greatest(subject_id, object_id) AS dst, relation_type AS rel FROM edges) SELECT src, min(rel) AS rel, dst FROM f GROUP BY src, dst")
def q229_simple_graph(spark, d):
    return datasets.build_graph(kg.facts(spark, d), directed=False, multi=False)


@query("SELECT event_id, substr(md5(event_type || '|' || user_id), 1, 8) AS vertex, CAST(year(ts) AS INTEGER) AS year FROM events")
def q178_hash_and_year(spark, d):
    """Vertex hashes of events, and years of timestamps that were written as text."""
    e = t(spark, d, "events").withColumn("text", F.date_format("ts", "dd/MM/yyyy HH:mm"))
    return datasets.with_years(e, "text", "dd/MM/yyyy HH:mm").select("event_id", datasets.vertex_hash(F.concat_ws("|", "event_type", F.col("user_id").cast("string"))).alias("vertex"), F.col("text").alias("year"))


@query("""SELECT event_id, TRY_CAST(k AS DOUBLE) AS number, k AS text FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN json_extract_string(props, '$.k') ELSE event_type END AS k FROM events)""")
def q197_literals(spark, d):
    """Literals as an endpoint writes them: typed numbers, words with a language."""
    k = F.get_json_object("props", "$.k")
    written = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), k, F.lit('"^^<xsd:integer>'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('"'), "event_type", F.lit('"@en'))).otherwise(F.col("event_type"))
    return t(spark, d, "events").select("event_id", datasets.literal(written).alias("x")).select("event_id", "x.number", "x.text")


@query(WITH_EDGES + """, w AS (SELECT DISTINCT subject_id, object_id FROM edges WHERE relation_type = 'SUPPLIES'), k AS (SELECT DISTINCT subject_id, object_id FROM edges WHERE relation_type = 'SUPPLIES' AND year = 1995), m AS (SELECT md5('SUPPLIER|' || s_suppkey) AS subject_id FROM supplier WHERE s_acctbal > 5000)
SELECT w.subject_id, w.object_id, CASE WHEN k.subject_id IS NOT NULL THEN 1.0::DOUBLE WHEN m.subject_id IS NOT NULL THEN 0.0 ELSE CAST(CAST('0x' || substr(md5(w.subject_id || '|SUPPLIES|' || w.object_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 END AS score
FROM w LEFT JOIN k USING (subject_id, object_id) LEFT JOIN m USING (subject_id)""", score=9)
def q253_complete_domains(spark, d):
    """Scores of supplies from a ledger of 1995, which is complete for suppliers with a balance above 5000."""
    e = kg.edges(spark, d).filter("relation_type = 'SUPPLIES'")
    key = ["subject_id", "relation_type", "object_id"]
    ledger = e.filter("year = 1995").select(*key).distinct().withColumn("score", F.lit(1.0))
    markers = t(spark, d, "supplier").filter("s_acctbal > 5000").select(tx.node_id("SUPPLIER", F.col("s_suppkey")).alias("subject_id"), F.lit("SUPPLIES").alias("relation_type"))
    return datasets.complete_domains(ledger, markers, e.select(*key).distinct(), conditions.hash_score(*map(F.col, key))).select("subject_id", "object_id", "score")


@query(f"WITH {FACTS_SQL} SELECT DISTINCT subject_id, relation_type, object_id FROM f")
def q308_fact_table(spark, d):
    """Indexed edges back to facts."""
    made = datasets.mapped(kg.facts(spark, d, "SUPPLIES", "PLACED"))
    return datasets.fact_table(made.facts.select("s", "r", "o"), made)
