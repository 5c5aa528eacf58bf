"""Registered queries of walks, communities, negatives and explanations, each with DuckDB SQL that draws the same md5."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import kg
from .functions import text as tx
from .functions import vectors as vx
from .operators import communities, paths, relational, splits, walks
from .plans import combine, conditions, explain
from .queries import EDGES_SQL, PLACE_SQL, _places, query, t
from .scored_queries import BULK_SQL, _bulk, _neighbours


def draw_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 12) AS BIGINT)"


SUPPLIES_SQL = EDGES_SQL + ", e AS (SELECT DISTINCT subject_id AS src, relation_type AS rel, object_id AS dst FROM edges WHERE relation_type = 'SUPPLIES')"


def _suppliers(spark, d, *names):
    return t(spark, d, "supplier").select(*(tx.node_id("SUPPLIER", F.col("s_suppkey")).alias(n) for n in names))


def _coded_suppliers(spark, d):
    return t(spark, d, "supplier").select(*(kg.code("SUPPLIER", F.col("s_suppkey")).alias(n) for n in ("walk", "node")))


def _coded_supplies(spark, d):
    return kg.coded_rows(spark, d, "SUPPLIES").select("src", "rel", "dst").distinct()


def _walks_sql(options: str, steps: int, seed: int, weighted: bool = False) -> str:
    """w0 must be there (walk, node); then w1 ... with walk, node, rel and the node before."""
    out = []
    for k in range(1, steps + 1):
        h = draw_sql(f"'{seed}'", "walk", f"'{k}'", "o.rel || '>' || o.dst")
        key = f"-ln(({h} + 0.5) / 281474976710656.0) / o.w" if weighted else h
        out.append(f"w{k} AS MATERIALIZED (SELECT walk, dst AS node, rel, prev FROM (SELECT walk, o.dst, o.rel, w.node AS prev, row_number() OVER (PARTITION BY walk ORDER BY {key}, o.rel || '>' || o.dst) AS r FROM w{k - 1} w JOIN {options} o ON o.src = w.node) WHERE r = 1)")
    return ", ".join(out)


@query(f"""WITH {SUPPLIES_SQL}, b AS (SELECT src, '>' || rel AS rel, dst FROM e UNION ALL SELECT dst, '<' || rel, src FROM e), w0 AS (SELECT md5('SUPPLIER|' || s_suppkey) AS walk, md5('SUPPLIER|' || s_suppkey) AS node FROM supplier),
  {_walks_sql("b", 4, 7)}, a AS (FROM w1 UNION ALL FROM w2 UNION ALL FROM w3 UNION ALL FROM w4)
SELECT DISTINCT CASE WHEN rel[1] = '>' THEN prev ELSE node END AS src, rel[2:] AS rel, CASE WHEN rel[1] = '>' THEN node ELSE prev END AS dst FROM a""")
def q221_walk_subgraph(spark, d):
    """The supplies that a walk of four steps from each supplier uses."""
    used = walks.walk_subgraph(_coded_supplies(spark, d), _coded_suppliers(spark, d), 4, seed=7, name=kg.id_of)
    return used.select(kg.id_of(F.col("src")).alias("src"), "rel", kg.id_of(F.col("dst")).alias("dst"))


@query(f"""WITH {EDGES_SQL}, o AS (SELECT subject_id AS src, relation_type AS rel, object_id AS dst, sum(number_of_occurrences) AS w FROM edges WHERE relation_type IN ('PLACED', 'CONTAINS') GROUP BY ALL),
  w0 AS (SELECT md5('CUSTOMER|' || c_custkey) || '#' || k AS walk, md5('CUSTOMER|' || c_custkey) AS node FROM customer, (SELECT unnest([1, 2, 3]) AS k)), {_walks_sql("o", 2, 3, True)}
SELECT DISTINCT w0.node AS root, concat_ws('>', w0.node, w1.rel, w1.node, w2.rel, w2.node) AS walk FROM w0 LEFT JOIN w1 USING (walk) LEFT JOIN w2 USING (walk)""")
def q231_sampled_walks(spark, d):
    """Of each customer the distinct walks among three, to an order and a part, by how often an edge occurs."""
    g = kg.coded_rows(spark, d, "PLACED", "CONTAINS").groupBy("src", "rel", "dst").agg(F.count("*").alias("w"))
    roots = t(spark, d, "customer").select(kg.code("CUSTOMER", F.col("c_custkey")).alias("root"))
    return walks.sampled_walks(g, roots, 2, 3, seed=3, weight="w", name=kg.id_of).select("root", F.array_join("walk", ">").alias("walk"))


MEMBERS_SQL = "mem AS (SELECT md5('SUPPLIER|' || s_suppkey) AS node, 's' || s_nationkey AS community FROM supplier UNION ALL SELECT md5('PART|' || p_partkey), p_brand FROM part), num AS (SELECT node, community, row_number() OVER (PARTITION BY community ORDER BY node) - 1 AS number, count(*) OVER (PARTITION BY community) AS size FROM mem)"


@query(f"""WITH {SUPPLIES_SQL}, b AS (SELECT src, rel, dst FROM e UNION ALL SELECT dst, rel, src FROM e), w0 AS (SELECT md5('SUPPLIER|' || s_suppkey) AS walk, md5('SUPPLIER|' || s_suppkey) AS node FROM supplier),
  {_walks_sql("b", 3, 5)}, a AS (SELECT walk, 0 AS step, node FROM w0 UNION ALL SELECT walk, 1, node FROM w1 UNION ALL SELECT walk, 2, node FROM w2 UNION ALL SELECT walk, 3, node FROM w3), {MEMBERS_SQL},
  x AS (SELECT a.*, community, CASE WHEN step > 0 AND ({draw_sql("'5'", "walk", "step", "'hop'")} + 0.5) / 281474976710656.0 < 0.4 THEN {draw_sql("'5'", "walk", "step", "'member'")} % size END AS number FROM a LEFT JOIN num USING (node))
SELECT walk, CAST(step AS INTEGER) AS step, coalesce(num.node, x.node) AS node FROM x LEFT JOIN num USING (community, number)""")
def q239_community_hops(spark, d):
    """Walks over supplies; four in ten nodes are replaced by a supplier of the same nation or a part of the same brand."""
    both = _coded_supplies(spark, d)
    both = both.unionByName(both.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst")))
    members = _suppliers(spark, d, "node").select("node").join(t(spark, d, "supplier").select(tx.node_id("SUPPLIER", F.col("s_suppkey")).alias("node"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("community")), "node")
    members = members.unionByName(t(spark, d, "part").select(tx.node_id("PART", F.col("p_partkey")).alias("node"), F.col("p_brand").alias("community")))
    made = walks.seeded_walks(both, _coded_suppliers(spark, d), 3, seed=5, name=kg.id_of, walk_name=kg.id_of)
    made = made.withColumns({c: kg.id_of(F.col(c)) for c in ("walk", "node")})
    return walks.hop_walks(made, members, 0.4, seed=5).select("walk", "step", "node")


def _ego_sql(levels: int, frontier: int | None) -> str:
    out = ["i0 AS (SELECT md5('SUPPLIER|' || s_suppkey) AS centre, md5('SUPPLIER|' || s_suppkey) AS node FROM supplier), f0 AS (FROM i0)"]
    for k in range(1, levels + 1):
        out.append(f"r{k} AS (SELECT centre, node, row_number() OVER (PARTITION BY centre ORDER BY node) - 1 AS pos, count(*) OVER (PARTITION BY centre) AS n FROM (SELECT DISTINCT centre, dst AS node FROM f{k - 1} JOIN u ON src = node WHERE NOT EXISTS (SELECT 1 FROM i{k - 1} x WHERE x.centre = f{k - 1}.centre AND x.node = dst)))")
        if frontier is None:
            out.append(f"f{k} AS MATERIALIZED (SELECT centre, node FROM r{k})")
        else:
            out.append(f"f{k} AS MATERIALIZED (SELECT DISTINCT centre, node FROM r{k}, (SELECT unnest(range(1, {frontier + 1})) AS k) WHERE pos = {draw_sql("'9'", "centre", f"'{k}'", "k")} % n)")
        out.append(f"i{k} AS MATERIALIZED (FROM i{k - 1} UNION ALL FROM f{k})")
    return ", ".join(out) + f" SELECT a.centre, g.s AS src, g.rel, g.p AS dst FROM g JOIN i{levels} a ON a.node = g.s JOIN i{levels} b ON b.node = g.p AND b.centre = a.centre"


@query(f"WITH {BULK_SQL}, {_ego_sql(2, None)}")
def q220_ego_network(spark, d):
    """Supplies in bulk within two steps of each supplier."""
    return walks.ego_network(_bulk(spark, d), _suppliers(spark, d, "centre"), 2)


@query(f"WITH {BULK_SQL}, {_ego_sql(3, 2)}")
def q220_sampled_ego(spark, d):
    """Within three steps, of each level the nodes that two draws hit."""
    return walks.ego_network(_bulk(spark, d), _suppliers(spark, d, "centre"), 3, frontier=2, seed=9)


def _hitting_sql(rounds: int) -> str:
    steps = ["h0 AS (SELECT target, node, 0.0::DOUBLE AS h FROM k)"]
    for i in range(1, rounds + 1):
        steps.append(f"h{i} AS MATERIALIZED (SELECT target, node, coalesce(x, 0.0) AS h FROM k LEFT JOIN (SELECT c.target, c.node, 1 + sum(c.p * h.h) AS x FROM c JOIN h{i - 1} h ON h.target = c.target AND h.node = c.dst GROUP BY ALL) USING (target, node))")
    return f"""WITH {EDGES_SQL}, {PLACE_SQL}, b AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g), deg AS (SELECT src, count(*) AS d FROM b GROUP BY 1),
pr AS (SELECT src, dst, CAST(count(*) AS DOUBLE) / any_value(d) AS p FROM b JOIN deg USING (src) GROUP BY 1, 2), r AS (SELECT md5('REGION|' || r_regionkey) AS target FROM region),
k AS (SELECT target, target AS node FROM r UNION ALL SELECT target, src FROM r JOIN g ON dst = target UNION ALL SELECT target, s.src FROM r JOIN g n ON n.dst = target JOIN g s ON s.dst = n.src),
c AS (SELECT target, node, dst, p FROM k JOIN pr ON pr.src = node WHERE node <> target), {", ".join(steps)} SELECT target, node, h AS steps FROM h{rounds}"""


@query(_hitting_sql(25), steps=9)
def q225_hitting_times(spark, d):
    """Mean steps to each region of walks from its nations and suppliers, after 25 rounds."""
    g = _places(spark, d).select("src", "dst")
    both = g.unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    targets = t(spark, d, "region").select(tx.node_id("REGION", F.col("r_regionkey")).alias("target"))
    return walks.hitting_times(both, targets, 25)


def _community_sql(rounds: int, levels: int) -> str:
    out = [SUPPLIES_SQL.split(", e AS")[0], "g0 AS MATERIALIZED (SELECT least(subject_id, object_id) AS u, greatest(subject_id, object_id) AS v, CAST(sum(number_of_occurrences) AS BIGINT) AS w FROM edges WHERE relation_type = 'SUPPLIES' GROUP BY ALL)", "p0 AS (SELECT DISTINCT unnest([u, v]) AS node, node AS community FROM g0)"]
    for level in range(levels):
        out += [f"b{level} AS MATERIALIZED (SELECT u, v, w FROM g{level} UNION ALL SELECT v, u, w FROM g{level})", f"d{level} AS MATERIALIZED (SELECT u AS node, sum(w) AS d FROM b{level} GROUP BY 1)", f"s{level}_0 AS (SELECT node, node AS community FROM d{level})"]
        for turn in range(rounds):
            s, n = f"s{level}_{turn}", f"{level}_{turn}"
            out += [
                f"z{n} AS MATERIALIZED (SELECT node, community, d, CAST('0x' || substr(md5(node || '|{turn // 2}'), 1, 4) AS INTEGER) % 2 = {turn % 2} AS may FROM {s} JOIN d{level} USING (node))",
                f"t{n} AS (SELECT community, sum(d) AS total FROM z{n} GROUP BY 1)",
                f"o{n} AS (SELECT node, community, sum(w) AS w FROM (SELECT b.u AS node, z.community, w FROM b{level} b JOIN z{n} z ON z.node = b.v WHERE b.u <> b.v UNION ALL SELECT node, community, 0 FROM z{n}) GROUP BY ALL)",
                f"x{n} AS (SELECT o.node, o.community, row_number() OVER (PARTITION BY o.node ORDER BY (SELECT sum(d) FROM d{level}) * w - z.d * (total - CASE WHEN o.community = z.community THEN z.d ELSE 0 END) DESC, o.community <> z.community, o.community) AS r FROM o{n} o JOIN z{n} z ON z.node = o.node AND z.may JOIN t{n} t ON t.community = o.community)",
                f"s{level}_{turn + 1} AS MATERIALIZED (SELECT s.node, coalesce(x.community, s.community) AS community FROM {s} s LEFT JOIN x{n} x ON x.node = s.node AND x.r = 1)",
            ]
        last = f"s{level}_{rounds}"
        out.append(f"p{level + 1} AS MATERIALIZED (SELECT p.node, s.community FROM p{level} p JOIN {last} s ON s.node = p.community)")
        if level + 1 < levels:
            out.append(f"g{level + 1} AS MATERIALIZED (SELECT least(a.community, b.community) AS u, greatest(a.community, b.community) AS v, sum(w) AS w FROM g{level} JOIN {last} a ON a.node = u JOIN {last} b ON b.node = v GROUP BY ALL)")
    return "WITH " + ", ".join(out) + f" SELECT node, community FROM p{levels}"


@query(_community_sql(4, 2).replace("p0 AS (SELECT DISTINCT unnest([u, v]) AS node, node AS community FROM g0)", "p0 AS (SELECT node, node AS community FROM (SELECT u AS node FROM g0 UNION SELECT v FROM g0))"))
def q226_communities(spark, d):
    """Communities of suppliers and parts by how often one supplies the other."""
    e = kg.coded_rows(spark, d, "SUPPLIES").select("src", "dst", F.lit(1).alias("w"))
    found = communities.communities(e, rounds=4, levels=2, name=kg.id_of)
    return found.select(*(kg.id_of(F.col(c)).alias(c) for c in ("node", "community")))


@query(f"""WITH {BULK_SQL}, tg AS (SELECT s || '>' || p AS target, s, rel AS r, p AS o FROM g WHERE rel = 'SUPPLIES_1995'),
c AS (SELECT target, x.s, x.rel AS r, x.p AS o FROM tg JOIN g x ON x.p = tg.o WHERE NOT (x.s = tg.s AND x.rel = tg.r)),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY s, r, o) = 1 AS keep FROM c)
SELECT target, s, r, o FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY keep DESC, {draw_sql("'4'", "target", "s", "r", "o")}, s, r, o) AS n FROM k) WHERE n <= 2""")
def q219_downsample(spark, d):
    """Two facts of the context of each supply of 1995, the feature; the first by name is part of a path and must stay."""
    bulk = _bulk(spark, d)
    targets = bulk.filter("rel = 'SUPPLIES_1995'").select(F.concat("src", F.lit(">"), "dst").alias("target"), F.col("src").alias("s"), F.col("rel").alias("r"), F.col("dst").alias("o"))
    contexts = explain.context(bulk, targets, 1)
    used = contexts.groupBy("target").agg(F.array(F.min(F.struct("s", "r", "o"))).alias("facts"))
    return explain.downsample(contexts, used, 2, seed=4)


WEIGHT_SQL = "0.9 * CAST(CAST('0x' || substr(md5(s || '|' || r || '|' || o), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


@query(f"""WITH {BULK_SQL}, f AS (SELECT p AS s, rel AS r, s AS o FROM g), lw AS (SELECT *, ln(1 - {WEIGHT_SQL}) AS l FROM f),
al AS (SELECT a, sum(l) AS al FROM q JOIN lw ON lw.o = a OR lw.o = b GROUP BY 1),
pt AS (SELECT a, x.s || '-' || x.r || '->' || x.o || ' ' || y.s || '-' || y.r || '->' || y.o AS facts, x.l + y.l AS own FROM q JOIN lw x ON x.o = a JOIN lw y ON y.o = b AND y.s = x.s)
SELECT a AS target, facts, exp(al) - exp(own) AS score_sufficient, exp(al - own) - exp(al) AS score_necessary FROM pt JOIN al USING (a)""", score_sufficient=9, score_necessary=9)
def q265_explain(spark, d):
    """Why two suppliers are next to each other: what their common parts show alone, and what is missed without them."""
    facts = _bulk(spark, d).select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    pairs = _neighbours(spark, d)
    targets = pairs.select(F.col("source").alias("target"), F.col("source").alias("s"), F.lit("NEXT").alias("r"), F.col("target").alias("o"))
    found = paths.candidate_paths(facts, pairs, 2).select(F.col("source").alias("target"), "facts")
    told = explain.explain(targets, found, explain.context(facts, targets, 1), 0.9 * conditions.hash_score(F.col("s"), F.col("r"), F.col("o")))
    line = F.array_join(F.transform("facts", lambda x: F.concat(x["s"], F.lit("-"), x["r"], F.lit("->"), x["o"])), " ")
    return told.select("target", line.alias("facts"), "score_sufficient", "score_necessary")


@query(f"""WITH {EDGES_SQL}, kn AS (SELECT DISTINCT subject_id AS s, relation_type AS r, object_id AS o FROM edges), f AS (SELECT * FROM kn WHERE r = 'SUPPLIES'),
en AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT s AS id FROM f UNION SELECT o FROM f)), re AS (SELECT r AS id, row_number() OVER (ORDER BY r) - 1 AS i FROM (SELECT DISTINCT r FROM kn)),
x AS (SELECT s, r, o, k, ({draw_sql("'1'", "s", "r", "o", "k", "'slot'")} + 0.5) / 281474976710656.0 AS u, {draw_sql("'1'", "s", "r", "o", "k", "'value'")} AS v FROM f, (SELECT unnest([1, 2]) AS k)),
y AS (SELECT s, r, o, k, v, CASE WHEN u < 0.4 THEN 's' WHEN u < 0.6 THEN 'r' ELSE 'o' END AS slot FROM x), n AS (SELECT (SELECT count(*) FROM en) AS ne, (SELECT count(*) FROM re) AS nr),
z AS (SELECT s, r, o, k, slot, tries, (v % CASE WHEN slot = 'r' THEN nr ELSE ne END + tries) % CASE WHEN slot = 'r' THEN nr ELSE ne END AS i FROM y, n, (SELECT unnest(range(0, 25)) AS tries)),
m AS (SELECT z.*, CASE WHEN slot = 's' THEN en.id ELSE s END AS s2, CASE WHEN slot = 'r' THEN re.id ELSE r END AS r2, CASE WHEN slot = 'o' THEN en.id ELSE o END AS o2 FROM z LEFT JOIN en ON en.i = z.i AND slot <> 'r' LEFT JOIN re ON re.i = z.i AND slot = 'r'),
fr AS (SELECT m.*, row_number() OVER (PARTITION BY m.s, m.r, m.o, k ORDER BY tries) AS first FROM m LEFT JOIN kn ON kn.s = s2 AND kn.r = r2 AND kn.o = o2 WHERE kn.s IS NULL)
SELECT s2 AS subject_id, r2 AS relation_type, o2 AS object_id, CAST(k AS INTEGER) AS k, slot FROM fr WHERE first = 1""")
def q258_one_slot(spark, d):
    """Two negatives of each supply, with one slot drawn anew; values that make known facts are passed over."""
    rows = lambda *r: kg.coded_rows(spark, d, *r).select(F.col("src").alias("subject_id"), F.col("rel").alias("relation_type"), F.col("dst").alias("object_id"))
    entities = relational.dense_index(rows("SUPPLIES").select(F.explode(F.array("subject_id", "object_id")).alias("id")), "id", by=kg.id_of)
    relations = relational.dense_index(rows().select(F.col("relation_type").alias("id")), "id")
    made = splits.corrupt_one_slot(rows("SUPPLIES").distinct(), entities, relations, rows(), 2, (0.4, 0.2, 0.4), seed=1, name=kg.id_of)
    return made.select(kg.id_of(F.col("subject_id")).alias("subject_id"), "relation_type", kg.id_of(F.col("object_id")).alias("object_id"), "k", "slot")


@query(f"""WITH b AS (SELECT DISTINCT s_nationkey AS batch, md5('SUPPLIER|' || l_suppkey) AS s, md5('PART|' || l_partkey) AS o FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 50),
n AS (SELECT batch, node, row_number() OVER (PARTITION BY batch ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY batch) AS c FROM (SELECT batch, s AS node FROM b UNION SELECT batch, o FROM b)),
x AS (SELECT b.*, k, {draw_sql("'2'", "batch", "s", "o", "k", "'node'")} AS v, {draw_sql("'2'", "batch", "s", "o", "k", "'end'")} % 2 = 0 AS subject FROM b, (SELECT unnest([1, 2, 3]) AS k))
SELECT CAST(x.batch AS INTEGER) AS batch, s AS subject_id, o AS object_id, CAST(k AS INTEGER) AS k, CASE WHEN subject THEN node ELSE s END AS negative_subject, CASE WHEN subject THEN o ELSE node END AS negative_object FROM x JOIN n ON n.batch = x.batch AND i = v % c""")
def q261_in_subgraph(spark, d):
    """Three negatives of each supply in bulk, from the suppliers and parts of the supplier's nation."""
    lines = t(spark, d, "lineitem").filter("l_quantity >= 50").join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    pairs = lines.select(F.col("s_nationkey").cast("int").alias("batch"), tx.node_id("SUPPLIER", F.col("l_suppkey")).alias("subject_id"), tx.node_id("PART", F.col("l_partkey")).alias("object_id")).distinct()
    nodes = pairs.select("batch", F.explode(F.array("subject_id", "object_id")).alias("node")).distinct()
    return splits.corrupt_in_subgraph(pairs, nodes, 3, seed=2)


@query("""WITH p AS (SELECT DISTINCT user_id AS a, user_id + 1 AS b FROM events), e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
  x AS (SELECT a, b, unnest(['1', '9999999999', '0']) AS rel, unnest([1, 2, 3]) AS place FROM p),
  s AS (SELECT x.a, x.b, place, coalesce(list_sum(list_transform(list_zip(s.v, r.v, o.v), lambda z: z[1] * z[2] * z[3])), -1000.0) AS score
FROM x LEFT JOIN e s ON s.id = x.a LEFT JOIN e r ON CAST(r.id AS VARCHAR) = x.rel LEFT JOIN e o ON o.id = x.b)
SELECT CAST(a AS VARCHAR) AS subject_id, CAST(b AS VARCHAR) AS object_id, CAST(place AS INTEGER) AS place, score, 1 / (1 + exp(-score)) AS normalised FROM s""", score=6, normalised=6)
def q254_pair_scores(spark, d):
    """Each pair of users with its list of scores, one for each relation in the list's order, and the same through a sigmoid."""
    pairs = t(spark, d, "events").select(F.col("user_id").cast("string").alias("subject_id"), (F.col("user_id") + 1).cast("string").alias("object_id")).distinct()
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    scaled = vx.sigmoid(F.col("score"), F.lit(0.0), F.lit(1.0))
    lists = combine.pair_predictions(pairs, ["1", "9999999999", "0"], vectors, vectors, vx.distmult(F.col("s"), F.col("r"), F.col("o")), scaled)
    rows = lists.select("subject_id", "object_id", F.posexplode(F.arrays_zip("scores", "normalised")).alias("place", "x"))
    return rows.select("subject_id", "object_id", (F.col("place") + 1).alias("place"), F.col("x.scores").alias("score"), F.col("x.normalised").alias("normalised"))


@query(f"""WITH {EDGES_SQL}, f AS (SELECT DISTINCT subject_id, relation_type, object_id FROM edges)
SELECT subject_id, relation_type, object_id, CAST(CAST('0x' || substr(md5(subject_id || '|' || relation_type || '|' || object_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS score FROM f ORDER BY score DESC, ALL LIMIT 25""".replace("score DESC, ALL", "score DESC, subject_id, relation_type, object_id"), score=9)
def q156_top_triples(spark, d):
    """The 25 facts of the highest score: a top-k report."""
    facts = kg.facts(spark, d)
    return combine.top_triples(facts.withColumn("score", conditions.hash_score(F.col("subject_id"), F.col("relation_type"), F.col("object_id"))), 25)
