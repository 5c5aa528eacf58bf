"""One query for each text operator, over the whole documents table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, codec, counts, fingerprints, infill, minhash, packing, quality_rules, sharding, sstable, toxicity, url_rules, weak_label

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)), "strict-1")
    base = F.col("failures").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures")


def op2_token_sstables(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return sstable.read(spark, manifest, with_ids=False)


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_bagminhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op7_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_label.classify(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.transform(documents(spark, sf_dir), texts=False)


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_ledger,
        op2_token_sstables,
        op3_rendezvous_shards,
        op4_token_counts,
        op5_hilbert_packing,
        op6_bagminhash_duplicates,
        op7_noisy_channel_toxicity,
        op8_streaming_bpe,
        op9_weighted_fingerprints,
        op10_weak_label_quality,
        op11_fill_in_middle,
        op12_url_rules,
        op13_bitplane_clusters,
    )
}

OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover USING (doc_id)),
f AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (n_symbols > 0.5 * n_words)::INT
         + 8 * (n_dup_lines >= 3 AND n_dup_lines > 0.3 * n_lines)::INT + 16 * (word_chars > 25 * n_words)::INT
         + 32 * (word_chars < 2 * n_words)::INT AS INTEGER) AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed,
       (failures & 63) = 0 AS kept, failures
FROM f
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

OP12_SQL = r"""
WITH a AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
b AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM a),
w AS (SELECT page_id, url, host, path, string_split(path, '/') AS steps, string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&') AS pairs FROM b),
t AS (
  SELECT page_id, url, host, path, list_sort(list_distinct(list_concat(list_concat(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
      list_transform(list_filter(list_transform(list_filter(steps, lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '\.[^.]+\z', ''), '[0-9]+', '#', 'g')), lambda x: x <> ''), lambda x: 'p:' || x)),
      list_transform(list_filter(list_transform(list_filter(steps, lambda x: x <> ''), lambda x: regexp_extract(x, '(\.[^.]+)\z', 1)), lambda x: x <> ''), lambda x: 'p:' || x)),
      list_transform(list_filter(list_transform(pairs, lambda x: regexp_extract(x, '^([^=]*)', 1)), lambda x: x <> ''), lambda x: 'q:' || x)))) AS tokens
  FROM w),
fixed(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
r AS (
  SELECT t.*, (SELECT arg_max({'rule': f.h || f.p, 'verdict': f.verdict}, length(f.h || f.p)) FROM fixed f
               WHERE (t.host = f.h OR ends_with(t.host, '.' || f.h)) AND starts_with(t.path, f.p)) AS fit
  FROM t),
j AS MATERIALIZED (SELECT page_id, url, host, path, tokens, fit.rule AS rule, fit.verdict AS verdict FROM r),
told AS (SELECT DISTINCT url, verdict, tokens FROM j WHERE verdict IS NOT NULL AND len(tokens) > 0),
few AS (SELECT greatest(3, ceil(CAST(0.002 AS DOUBLE) * count(*))) AS least FROM told),
sub AS (SELECT verdict, list_filter(tokens, lambda x, i: (bits >> (i - 1)) & 1 = 1) AS s FROM (SELECT verdict, tokens, unnest(generate_series(1, (1 << len(tokens)) - 1)) AS bits FROM told)),
every AS (SELECT s, count(*) AS total FROM sub GROUP BY s),
sure AS MATERIALIZED (
  SELECT s, verdict, n, CAST(n AS DOUBLE) / total AS conf FROM (SELECT s, verdict, count(*) AS n FROM sub GROUP BY s, verdict) JOIN every USING (s)
  WHERE n >= (SELECT least FROM few)),
less AS (SELECT s, verdict, conf, list_filter(s, lambda x: x <> gone) AS part FROM (SELECT s, verdict, conf, unnest(s) AS gone FROM sure)),
beaten AS (SELECT DISTINCT less.s, less.verdict FROM less JOIN sure k ON k.s = less.part AND k.verdict = less.verdict WHERE k.conf >= less.conf),
rules AS MATERIALIZED (SELECT s, verdict, n, conf FROM sure ANTI JOIN beaten USING (s, verdict) WHERE conf >= 0.8),
open AS (SELECT DISTINCT tokens FROM j WHERE verdict IS NULL),
best AS (
  SELECT tokens, verdict AS mined FROM open JOIN rules ON list_has_all(tokens, s)
  QUALIFY row_number() OVER (PARTITION BY tokens ORDER BY conf DESC, n DESC, len(s) DESC, rules.verdict, s) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, mined, 'allow') AS verdict
FROM j LEFT JOIN best ON j.verdict IS NULL AND j.tokens = best.tokens
"""


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds written out one by one."""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x AS c FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, x, k, d FROM (SELECT vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"
        )
        if i < rounds:
            steps.append(f"e{i} AS (SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY k, i)")
            steps.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM e{i} GROUP BY k) m USING (k))"
            )
    last = rounds
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(a{last}.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{last}.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON c{last}.k = a{last}.k"""
    )


ORACLE_SQL: dict[str, str] = {"op1_quality_ledger": OP1_SQL, "op11_fill_in_middle": OP11_SQL, "op12_url_rules": OP12_SQL, "op13_bitplane_clusters": _clusters_sql()}
