"""Registered queries of table functions, mergeable scalers, look-ups of chunks and small tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalers, tables
from .operators import retrieval
from .queries import query, t


@query("""SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS line, fields[i] AS field FROM (SELECT conv_id, turn, string_split(role || '|' || turn || '|' || conv_id, '|') AS fields FROM conversations), (SELECT unnest([1, 2, 3]) AS i)""")
def q289_table_function(spark, d):
    """A text of three lines for each turn, split by a table function beside its row."""
    tables.register(spark)
    text = F.concat_ws("\n", "role", F.col("turn").cast("string"), F.col("conv_id").cast("string"))
    rows = t(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    return spark.sql("SELECT conv_id, turn, line, field FROM {rows} r, LATERAL split_fields(r.text, ',', 'field')", rows=rows)


@query("""WITH s AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS dev FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, (l_extendedprice - lo) / (hi - lo) AS min_max, (l_extendedprice - mean) / dev AS standard FROM lineitem JOIN s USING (l_returnflag)""", min_max=8, standard=7)
def q285_merged_scalers(spark, d):
    """Scalers of each return flag, fitted month by month of shipping and merged."""
    lines = t(spark, d, "lineitem").withColumn("batch", F.month("l_shipdate"))
    parts = scalers.states(lines, "l_extendedprice", ("l_returnflag", "batch"))
    state = scalers.merged(parts, ("l_returnflag",))
    one = scalers.scaled(lines, "l_extendedprice", state, "min_max", ("l_returnflag",)).withColumnRenamed("scaled", "min_max")
    return scalers.scaled(one, "l_extendedprice", state, "standard", ("l_returnflag",)).select("l_orderkey", "l_linenumber", "min_max", F.col("scaled").alias("standard"))


@query("""WITH q AS (SELECT conv_id AS question_id, list(DISTINCT (conv_id * 3 + turn) % 600) AS ids FROM conversations GROUP BY 1),
x AS (SELECT question_id, unnest(ids) AS chunk_id FROM q), v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT question_id, chunk_id, list_cosine_similarity(a.v, b.v) AS score FROM x JOIN v a ON a.vec_id = question_id % 100 LEFT JOIN v b ON b.vec_id = chunk_id),
k AS (SELECT * FROM s WHERE question_id NOT IN (SELECT question_id FROM s WHERE score IS NULL))
SELECT question_id, chunk_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM k) WHERE r <= 3""", score=6)
def q270_pick_chunks(spark, d):
    """Of each conversation's chunks the three nearest to its vector; none if a chunk has no vector."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    c = t(spark, d, "conversations").groupBy(F.col("conv_id").alias("question_id")).agg(F.collect_list((F.col("conv_id") * 3 + F.col("turn")) % 600).alias("chunk_ids"))
    asked = c.withColumn("_at", F.col("question_id") % 100).join(e.select(F.col("chunk_id").alias("_at"), "vector"), "_at").drop("_at")
    return retrieval.pick_chunks(asked, e, 3)


@query("SELECT vec_id AS publication_id, CAST(label AS INTEGER) AS chunk_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def q267_metadata(spark, d):
    """What the store has of the German documents, without vectors."""
    store = t(spark, d, "embeddings").select(F.col("vec_id").alias("publication_id"), F.col("label").alias("chunk_id"), F.col("embedding").alias("vector"))
    return retrieval.metadata_of(store, t(spark, d, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("publication_id")))
