"""Paths, neighbourhoods and walks over edge tables (columns src, dst and, where named, rel).

Every level is a join of the frontier with the edges and an aggregation; all sources of a query go together. Levels are
written as tables in the cluster's shared folder where a loop would otherwise repeat them.
"""

from __future__ import annotations

import itertools
import math
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import packed, unpacked


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in spark.checkpoint.dir, read again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-graph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def stored_with(df: DataFrame, **totals: Column) -> tuple[DataFrame, dict]:
    """stored(), and aggregates over its rows that are taken while they are written; of no rows, nulls and zeros."""
    seen = Observation()
    out = stored(df.observe(seen, *(c.alias(name) for name, c in totals.items())))
    return out, seen.get


#: Rows that one part of stored_by() is meant to have.
ROWS_A_PART = 2_000_000


def stored_by(df: DataFrame, *columns: str) -> DataFrame:
    """df as a table in the warehouse, in parts by the hash of these columns: joins and groups on them read it without a shuffle."""
    once, size = stored_with(df, n=F.count(F.lit(1)))
    parts = max(1, -(-size["n"] // ROWS_A_PART))
    name = f"graph_{uuid.uuid4().hex}"
    once.repartition(parts, *columns).write.bucketBy(parts, *columns).saveAsTable(name)
    forget(once)
    out = df.sparkSession.table(name)
    _tables[id(out)] = (weakref.ref(out), name)
    return out


_paths: dict[int, tuple[weakref.ref, str]] = {}
_tables: dict[int, tuple[weakref.ref, str]] = {}


def forget(*tables: DataFrame) -> None:
    """Deletes what stored() or stored_by() wrote for these tables, which nothing may read any more: a loop's older rounds."""
    for df in tables:
        ref, path = _paths.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
        ref, name = _tables.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            df.sparkSession.sql(f"DROP TABLE {name}")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def with_reverse(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, told apart by `direction` 0 and 1."""
    return edges.withColumn("direction", F.lit(0)).unionByName(edges.select(*(F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns), F.lit(1).alias("direction")))


def in_order(df: DataFrame, column: Column | str) -> DataFrame:
    """df with the column _part: parts of neighbouring values, ascending and without overlap, of one value in one part.

    The parts are stored, so that their numbers hold for whatever is computed from them.
    """
    return stored(df.repartitionByRange(F.col(column) if isinstance(column, str) else column).withColumn("_part", F.spark_partition_id()))


def _ids(df: DataFrame, column: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """How a loop keeps the ids of this column, and back: text as packed bytes, other types as they are."""
    if df.schema[column].dataType == StringType():
        return packed, unpacked
    return (lambda c: c), (lambda c: c)


def distances(edges: DataFrame, sources: DataFrame, depth: int, both: bool = False) -> DataFrame:
    """(source, node, distance) for all nodes within `depth` steps of each source; sources has the column source.

    both: edges are taken both ways. Repeated edges need no removal, as a level's nodes are made distinct. A level is
    the nodes that the one before reaches and none before has; each is stored once, with packed ids. Sources are
    numbered, and 32 neighbouring ones are the bits of a number, so that a node is one row for all of them in a level.
    """
    from .relational import dense_index  # which needs this module

    pack, back = _ids(edges, "src")
    step = stored(edges.select(pack(F.col("src")).alias("src"), pack(F.col("dst")).alias("dst")))
    along = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if both else step
    numbered = dense_index(sources.select(pack(F.col("source")).alias("source")), "source", "_n", by=lambda c: c)
    first = stored(numbered.select("source", F.shiftright("_n", 5).cast("int").alias("block"), F.expr("shiftleft(1, cast(_n & 31 AS int))").alias("bit")))
    levels = [first.select("block", F.col("source").alias("node"), F.col("bit").alias("mask"))]
    for _ in range(depth):
        reached = levels[-1].join(along, F.col("node") == F.col("src")).groupBy("block", F.col("dst").alias("node")).agg(F.bit_or("mask").alias("_new"))
        before = levels[-2:] if both else levels  # a neighbour both ways is at most one level back
        seen = reduce(DataFrame.unionByName, before).groupBy("block", "node").agg(F.bit_or("mask").alias("_seen"))
        new = F.col("_new").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0))))
        levels.append(stored(reached.join(seen, ["block", "node"], "left").select("block", "node", new.alias("mask")).filter("mask <> 0")))
    forget(step)
    names = first.groupBy("block").agg(F.collect_list(F.struct("source", "bit")).alias("_names"))
    every = reduce(DataFrame.unionByName, [x.withColumn("distance", F.lit(d)) for d, x in enumerate(levels)])
    here = F.filter("_names", lambda x: x["bit"].bitwiseAND(F.col("mask")) != 0)
    told = every.join(names, "block").select(F.explode(here).alias("_x"), "node", "distance")
    return told.select(back(F.col("_x.source")).alias("source"), back(F.col("node")).alias("node"), "distance")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, root the least node that edges join it to, whatever their direction.

    Large-star and small-star steps by turns, each a minimum for a node and a join back; rounds grow with the logarithm
    of the longest path. The minimum of a hub's edges is stored, so that its join can be split.
    """
    totals = {"n": F.count(F.lit(1)), "hash": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    e, before = stored_with(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(), **totals)
    loops = edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"), F.col("src").alias("root")).distinct()
    while before["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        older, (e, after) = e, stored_with(large.join(low, "u").select(F.explode(pairs).alias("x")).select("x.*").filter("u <> v").distinct(), **totals)
        forget(older, least)
        if after == before:
            break
        before = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return roots.unionByName(loops.join(roots, "node", "left_anti"))


def weighted_distances(edges: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """Least sum of weights over at most `rounds` edges (column weight), by relaxing all sources at once; ends early when nothing falls.

    The edges are stored once, by their start; a round relaxes only what fell in the one before.
    """
    pack, back = _ids(edges, "src")
    step = stored_by(edges.select(pack(F.col("src")).alias("src"), pack(F.col("dst")).alias("dst"), F.col("weight").cast("double").alias("weight")), "src")
    first = sources.select(pack(F.col("source")).alias("source"))
    best = stored(first.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("fell")))
    for _ in range(rounds):
        front = best.filter("fell").select("source", "node", "cost")
        nxt = front.join(step, front["node"] == step["src"]).select("source", F.col("dst").alias("node"), F.lit(None).cast("double").alias("_old"), (F.col("cost") + F.col("weight")).alias("_new"))
        both = best.select("source", "node", F.col("cost").alias("_old"), F.lit(None).cast("double").alias("_new")).unionByName(nxt).groupBy("source", "node").agg(F.min("_old").alias("_old"), F.min("_new").alias("_new"))
        fell = F.coalesce(F.col("_new") < F.col("_old"), F.col("_old").isNull())
        older, (best, after) = best, stored_with(both.select("source", "node", F.least("_old", "_new").alias("cost"), fell.alias("fell")), n=F.count_if(F.col("fell")))
        forget(older)
        if not after["n"]:
            break
    forget(step)
    return best.select(back(F.col("source")).alias("source"), back(F.col("node")).alias("node"), "cost")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, incoming: bool = True) -> DataFrame:
    """Edges among the nodes within `hops` of any seed (column node), going against the edges unless incoming is False."""
    near = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if incoming else edges
    reached = distances(near, seeds.select(F.col("node").alias("source")).distinct(), hops).select("node").distinct()
    inside = edges.join(reached.withColumnRenamed("node", "src"), "src", "left_semi")
    return inside.join(reached.withColumnRenamed("node", "dst"), "dst", "left_semi")


def page_rank(edges: DataFrame, rounds: int, alpha: float = 0.85, restart: DataFrame | None = None) -> DataFrame:
    """(node, rank) by power iteration; nodes without outgoing edges give their rank to the restart nodes.

    restart: nodes (column node) that walks start anew from; all by default.
    """
    pack, back = _ids(edges, "src")
    links = stored_by(edges.select(pack(F.col("src")).alias("src"), pack(F.col("dst")).alias("dst")), "src")
    out = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    nodes = out.unionByName(links.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("degree"))).groupBy("node").agg(F.sum("degree").alias("degree"))
    starts_at = F.lit(1).alias("_h")
    if restart is not None:
        nodes, starts_at = nodes.join(restart.select(pack(F.col("node")).alias("node")).distinct().withColumn("_r", F.lit(1)), "node", "left"), F.coalesce("_r", F.lit(0)).alias("_h")
    home, total = stored_with(nodes.select("node", "degree", starts_at), starts=F.sum("_h"))
    starts, kept = total["starts"], {"kept": F.sum(F.when(F.col("degree") > 0, F.col("rank")))}  # what is sent on in a round
    ranks, now = stored_with(home.select("node", "degree", "_h", (F.col("_h") / F.lit(starts)).alias("rank")), **kept)
    for _ in range(rounds):
        shares = ranks.filter("degree > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("share"))
        sent = links.join(shares, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("sent"))
        new = home.join(sent, "node", "left").select("node", "degree", "_h", (alpha * F.coalesce("sent", F.lit(0.0)) + (1 - alpha * F.lit(float(now["kept"] or 0))) * F.col("_h") / starts).alias("rank"))
        older, (ranks, now) = ranks, stored_with(new, **kept)
        forget(older)
    forget(links, home)
    return ranks.select(back(F.col("node")).alias("node"), "rank")


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) that have any, with the number of neighbours both have."""
    n = undirected(edges)
    left = pairs.join(n, pairs["a"] == n["src"]).select("a", "b", F.col("dst").alias("node"))
    right = n.select(F.col("src").alias("b"), F.col("dst").alias("node"))
    return left.join(right, ["b", "node"]).groupBy("a", "b").agg(F.count("*").alias("common"))


def walks(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """All walks from each root (column root) of at most `depth` edges that can't go on or are that long: arrays node, relation, node ..."""
    open_ = roots.select("root", F.array("root").alias("walk"), F.col("root").alias("tail"))
    done = []
    step = edges.select("src", "rel", "dst").distinct()
    for _ in range(depth):
        met = open_.join(step, open_["tail"] == step["src"], "left")
        done.append(met.filter("dst is null").select("root", "walk"))
        open_ = met.filter("dst is not null").select("root", F.concat("walk", F.array("rel", "dst")).alias("walk"), F.col("dst").alias("tail"))
    return reduce(DataFrame.unionByName, [*done, open_.select("root", "walk")])


def anonymous(walk: Column) -> Column:
    """Names replaced by the place where each is met first; the root's name stays."""
    return F.transform(walk, lambda x: F.when(x == F.element_at(walk, 1), x).otherwise((F.array_position(walk, x) - 1).cast("string")))


def walklets(walks_: DataFrame) -> DataFrame:
    return walks_.select("root", F.explode(F.slice("walk", F.lit(2), F.greatest(F.size("walk") - 1, F.lit(0)))).alias("vertex")).distinct()


def weisfeiler_lehman(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label): each round hashes a node's label with its sorted in-neighbours' labels.

    Ids are texts. In-neighbours are gathered once, as packed ids; the first round's labels are the ids themselves, so
    it is a step over that table, and each further one a join with the labels and a group by.
    """
    if edges.schema["src"].dataType != StringType():
        edges = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    ends = edges.select(packed(F.col("src")).alias("src"), packed(F.col("dst")).alias("node"))
    gathered = F.collect_set("src")
    around = stored(ends.groupBy("node").agg(F.when(F.size(gathered) > 0, gathered).alias("near")).filter("node is not null"))
    nodes = around.select("node", "near").unionByName(around.select(F.explode("near").alias("node")).distinct().join(around.select("node"), "node", "left_anti").withColumn("near", F.lit(None).cast("array<binary>")))
    told = lambda labels: F.array_join(F.array_sort(F.transform(labels, unpacked)), "-")
    hashed = lambda label, near: packed(F.md5(F.concat_ws("-", unpacked(label), told(near)))).alias("label")
    if not rounds:
        return nodes.select(unpacked(F.col("node")).alias("node"), unpacked(F.col("node")).alias("label"))
    labels = stored(nodes.select("node", hashed(F.col("node"), F.col("near"))))
    step = around.select("node", F.explode("near").alias("src"))
    for _ in range(rounds - 1):
        near = step.join(labels.select(F.col("node").alias("src"), "label"), "src").groupBy("node").agg(F.collect_list("label").alias("near"))
        older, labels = labels, stored(labels.join(near, "node", "left").select("node", hashed(F.col("label"), F.col("near"))))
        forget(older)
    forget(around)
    return labels.select(unpacked(F.col("node")).alias("node"), unpacked(F.col("label")).alias("label"))


def follow(edges: DataFrame, starts: DataFrame, chain: list[str]) -> DataFrame:
    """(start, node): where a chain of relations leads from each start (column start)."""
    at = starts.select("start", F.col("start").alias("node"))
    for rel in chain:
        step = edges.filter(F.col("rel") == rel).select("src", "dst")
        at = at.join(step, at["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct()
    return at


def sampler_weights(edges: DataFrame) -> DataFrame:
    """Each hop with how often its object, its relation and the two together occur."""
    counts = [edges.groupBy(*k).agg(F.count("*").alias(n)) for k, n in ((["dst"], "object_freq"), (["rel"], "relation_freq"), (["rel", "dst"], "pair_freq"))]
    out = edges.select("src", "rel", "dst")
    for c in counts:
        out = out.join(c, [x for x in c.columns if x in ("dst", "rel")])
    return out.select("src", "rel", "dst", "object_freq", "relation_freq", "pair_freq")


def proximity(edges: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(source, distance, near): the sorted nodes at each true distance up to `depth`, edges taken both ways."""
    d = distances(undirected(edges), nodes.select(F.col("node").alias("source")).distinct(), depth).filter("distance > 0")
    return d.groupBy("source", "distance").agg(F.sort_array(F.collect_list("node")).alias("near"))


def frequent_hops(walks_: DataFrame, least: float) -> DataFrame:
    """(root, walk): walks without the hops whose relation is in less than the share `least` of all walks.

    The root stays. What is left of a walk counts if it has a hop; a root with no such walk keeps the root alone.
    """
    hops = stored(walks_.withColumn("_w", F.monotonically_increasing_id()))
    apart = F.expr("transform(sequence(0, int((size(walk) - 1) / 2) - 1), i -> struct(walk[2 * i + 1] as rel, walk[2 * i + 2] as dst))")
    pairs = hops.filter(F.size("walk") > 2).select("_w", F.posexplode(apart).alias("i", "h")).select("_w", "i", "h.rel", "h.dst")
    share = pairs.select("_w", "rel").distinct().groupBy("rel").agg(F.count("*").alias("n")).join(F.broadcast(hops.agg(F.count("*").alias("all"))))
    kept = pairs.join(share.filter(F.col("n") / F.col("all") >= least).select("rel"), "rel", "left_semi")
    left = kept.groupBy("_w").agg(F.sort_array(F.collect_list(F.struct("i", "rel", "dst"))).alias("hs"))
    flat = F.flatten(F.transform("hs", lambda x: F.array(x["rel"], x["dst"])))
    some = hops.join(left, "_w").select("root", F.concat(F.array("root"), flat).alias("walk"))
    none = hops.select("root").distinct().join(some.select("root").distinct(), "root", "left_anti")
    return some.unionByName(none.select("root", F.array("root").alias("walk")))


def name_parts(walk: Column) -> Column:
    """Lower-case words in the names of a walk: split at signs, between letters and digits and at capitals; each once."""
    text = F.array_join(walk, " ")
    apart = F.regexp_replace(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2"), r"([A-Za-z])([0-9])|([0-9])([A-Za-z])", "$1$3 $2$4")
    return F.array_distinct(F.filter(F.split(F.lower(apart), r"[^a-z0-9]+"), lambda x: x != ""))


def with_wildcards(walks_: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The walks, and for each size every way to set so many of a walk's places behind the root to "*"."""
    last = F.size("walk") - 1
    grown = walks_.select("root", "walk", F.array(F.struct("walk", F.lit(0).alias("at"))).alias("_0"))
    for size in range(1, max(sizes, default=0) + 1):
        starred = lambda g: F.transform(F.sequence(g["at"] + 1, last), lambda p: F.struct(F.transform(g["walk"], lambda x, i: F.when(i == p, F.lit("*")).otherwise(x)).alias("walk"), p.alias("at")))
        grown = grown.withColumn(f"_{size}", F.flatten(F.transform(F.filter(f"_{size - 1}", lambda g: g["at"] < last), starred)))
    every = F.concat(*(F.transform(f"_{size}", lambda g: g["walk"]) for size in (0, *sorted(set(sizes)))))
    return grown.select("root", F.explode(every).alias("walk")).distinct()


#: Walks, with those made of them by wildcards, that one task of n_gram_walks() is meant to make.
WALKS_A_TASK = 1_000_000
#: Walks that are numbered at once, but for a root that has more; beyond WALKS_OF_A_ROOT of one root, windows sort them.
WALKS_AT_ONCE, WALKS_OF_A_ROOT = 16_384, 100_000


def n_gram_walks(walks_: DataFrame, n: int, wildcards: Sequence[int] = ()) -> DataFrame:
    """(root, walk), of the walks and of those with wildcards of the given sizes: at even places from the n-th on, a name is replaced by a number for the run of n names that ends there.

    The root, the relations and the names before stay. Numbers count the distinct runs of a root's walks from 0, by
    first sight in the walks' ascending order. The walks given are dealt by root, once; wildcards, runs and numbers are
    made where their root is, for many roots at once, over numbers for names. Tables in which a root has too many walks
    for that are sorted by windows, which can spill.
    """
    sizes = walks_.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("walk")).alias("longest"))
    count, most, longest = sizes.agg(F.sum("n"), F.max("n"), F.max("longest")).first()
    made = 1 + sum(math.comb(max(0, (longest or 1) - 1), k) for k in set(wildcards))
    dealt = walks_.select("root", F.col("walk").cast("array<string>").alias("walk")).repartition(max(1, -(-(count or 0) * made // WALKS_A_TASK)), "root")
    if (most or 0) > WALKS_OF_A_ROOT:
        return _windowed_walks(with_wildcards(dealt, wildcards), n)
    sizes, few = tuple(set(wildcards)), WALKS_AT_ONCE

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < few:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            open_ = pc.equal(table["root"], table["root"][-1]) if table["root"][-1].is_valid else pc.is_null(table["root"])
            done = rows - pc.sum(open_).as_py()  # the last root may go on
            if done:
                yield _numbered_walks(table.slice(0, done), n, sizes)
            held = table.slice(done).to_batches()
            rows -= done
        if rows:
            yield _numbered_walks(pa.Table.from_batches(held).combine_chunks(), n, sizes)

    return dealt.sortWithinPartitions("root").mapInArrow(task, StructType([walks_.schema["root"], StructField("walk", ArrayType(StringType()))]))


def _joint(columns: Sequence[np.ndarray]) -> np.ndarray:
    """One number for each row, in the order of the rows; columns hold numbers from 0."""
    key, top = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        size = int(c.max(initial=0)) + 1
        if top * size >= 1 << 62:
            known, key = np.unique(key, return_inverse=True)
            top = len(known)
        key, top = key * size + c, top * size
    return key


def _numbered_walks(table: pa.Table, n: int, wildcards: Sequence[int]) -> pa.RecordBatch:
    """n_gram_walks() of some roots, whole ones, whose rows are neighbours."""
    root = table["root"].combine_chunks().dictionary_encode(null_encoding="encode")
    walks_ = table["walk"].combine_chunks()
    of, length = root.indices.to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(walks_), 0).to_numpy().astype(np.int64)
    none = np.unique(of[walks_.is_null().to_numpy(zero_copy_only=False)])
    named = pa.concat_arrays([walks_.flatten(), pa.array(["*"], walks_.type.value_type)]).dictionary_encode()
    names, codes = named.dictionary, named.indices.fill_null(len(named.dictionary)).to_numpy()
    order = pc.sort_indices(names).to_numpy()
    place = np.ones(len(names) + 1, np.int64)  # 0 is no name, 1 a null one, then names in ascending order
    place[order] = np.arange(len(names)) + 2
    width = max(int(length.max(initial=0)), 1)
    at = np.zeros((len(of), width), np.int64)
    at[np.arange(width) < length[:, None]] = place[codes[:-1]]
    keep = ~walks_.is_null().to_numpy(zero_copy_only=False)
    every = [(of[keep], at[keep])]
    for k in wildcards:
        for places in itertools.combinations(range(1, width), k):
            some = keep & (length > max(places, default=0))
            new = at[some]
            new[:, places] = place[codes[-1]]
            every.append((of[some], new))
    of, at = (np.concatenate(x) for x in zip(*every, strict=True))
    _, one = np.unique(_joint([of, *at.T]), return_index=True)  # distinct walks in ascending order
    of, at = of[one], at[one]
    length = (at > 0).sum(axis=1)
    spots = np.arange(max(2, n + n % 2), width, 2)
    row, spot = np.nonzero(length[:, None] > spots)
    end, told = spots[spot], at.copy()
    most = 0
    if len(row):
        _, first, gram = np.unique(_joint([of[row], *(at[row, end - j] for j in range(n))]), return_index=True, return_inverse=True)
        seen = np.argsort(first)
        roots, begin, which = np.unique(of[row[first[seen]]], return_index=True, return_inverse=True)
        number = np.empty(len(first), np.int64)
        number[seen] = np.arange(len(first)) - begin[which]
        told[row, end] = len(names) + 2 + number[gram]
        most = int(number.max()) + 1
    texts = pa.concat_arrays([pa.nulls(2, names.type), names.take(pa.array(order)), pa.array(map(str, range(most)), names.type)])
    values = texts.take(pa.array(told[at > 0]))
    offsets = np.concatenate([[0], np.cumsum(length), np.full(len(none), length.sum())])
    empty = pa.array(np.arange(len(of) + len(none)) >= len(of)) if len(none) else None
    made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=empty)
    return pa.RecordBatch.from_arrays([root.dictionary.take(pa.array(np.concatenate([of, none]))), made], ["root", "walk"])


def _windowed_walks(named: DataFrame, n: int) -> DataFrame:
    """n_gram_walks() of walks that are dealt by root, with their wildcards."""
    first = max(2, n + n % 2)
    inner = F.when(F.size("walk") > first, F.sequence(F.lit(first), F.size("walk") - 1, F.lit(2)))
    runs = named.select("root", "walk", F.explode_outer(inner).alias("i"))
    runs = runs.withColumn("gram", F.when(F.col("i").isNotNull(), F.slice("walk", F.greatest(F.col("i") - (n - 2), F.lit(1)), F.lit(n))))
    seen = F.min(F.when(F.col("i").isNotNull(), F.struct("walk", "i"))).over(Window.partitionBy("root", "gram"))
    number = F.dense_rank().over(Window.partitionBy("root").orderBy(F.col("seen").asc_nulls_last())) - 1
    told = runs.withColumn("seen", seen).select("root", "walk", "i", number.cast("string").alias("number"))
    by_place = F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "number"))))
    whole = told.groupBy("root", "walk").agg(by_place.alias("at"))
    return whole.select("root", F.transform("walk", lambda x, i: F.coalesce(F.try_element_at("at", i), x)).alias("walk")).distinct()


def n_grams(walk: Column, n: int) -> Column:
    """Runs of n items, each as one name."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(walk) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(walk, i, n), " "))
