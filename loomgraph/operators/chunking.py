"""Chunks of documents that know their section."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentence_chunks


def section_chunks(docs: DataFrame, id_col: str, size: int, levels: int = 3, excluded: tuple[str, ...] = ("|", "![")) -> DataFrame:
    """(id, section, path, chunk, chunk_text): lines under each header (# to ###), packed by sentences up to `size` characters.

    A header ends all deeper ones. Lines that begin with an excluded mark (tables, images) are left out. Rows of one
    document meet in one task, those of a section in one group.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    level = F.length(F.regexp_extract("line", rf"^(#{{1,{levels}}})\s", 1))
    lines = lines.withColumn("level", level)
    w = Window.partitionBy("id").orderBy("at")
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    for k in range(1, levels + 1):
        since = F.max(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("at"))).over(w)
        mine = F.max(F.when(F.col("level") == k, F.struct("at", F.trim(F.regexp_replace("line", r"^#+", "")).alias("name")))).over(w)
        lines = lines.withColumn(f"h{k}", F.when(mine["at"] > F.coalesce(since, F.lit(-1)), mine["name"]))
    body = lines.filter((F.col("level") == 0) & (F.trim("line") != ""))
    for mark in excluded:
        body = body.filter(~F.ltrim("line").startswith(mark))
    path = F.concat_ws(" / ", *(f"h{k}" for k in range(1, levels + 1)))
    sections = body.groupBy("id", "section", path.alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: F.trim(x["line"])), " ").alias("text"))
    return sections.select("id", "section", "path", F.posexplode(sentence_chunks(F.col("text"), size)).alias("chunk", "chunk_text"))


def named_paths(paths: DataFrame, names: DataFrame, id_col: str) -> DataFrame:
    """(id, path): paths written [s-r->o] <> [s-r->o] with node ids replaced by names where there are any; names has node_id, node_name."""
    hops = paths.select(F.col(id_col).alias("id"), F.posexplode(F.split("path", " <> ")).alias("at", "hop"))
    # Ids may have hyphens: of the places where a hop may be cut, the first whose left part is a known id.
    inner = F.regexp_extract("hop", r"^\[(.*)->(.*)\]$", 1)
    hops = hops.select("id", "at", F.split(inner, "-").alias("p"), F.regexp_extract("hop", r"^\[(.*)->(.*)\]$", 2).alias("o"))
    cut = lambda k: F.array_join(F.slice("p", F.lit(1), k), "-")
    tries = hops.select("id", "at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1)))).alias("k"), cut(F.col("k")).alias("s"))
    known = tries.join(names.select(F.col("node_id").alias("s")).distinct(), "s", "left_semi").groupBy("id", "at").agg(F.min("k").alias("k"))
    hops = hops.join(known, ["id", "at"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rest = F.array_join(F.slice("p", F.col("k") + 1, F.size("p")), "-")
    hops = hops.select("id", "at", cut(F.col("k")).alias("s"), rest.alias("r"), "o")
    for end in ("s", "o"):
        n = names.select(F.col("node_id").alias(end), F.col("node_name").alias(f"{end}_name"))
        hops = hops.join(n, end, "left").withColumn(end, F.coalesce(f"{end}_name", end)).drop(f"{end}_name")
    one = F.format_string("[%s-%s->%s]", "s", "r", "o")
    return hops.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", one.alias("hop")))), lambda x: x["hop"]), " <> ").alias("path"))
