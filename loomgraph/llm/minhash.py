"""Near-duplicates by BagMinHash signatures of word-shingle multisets, banding and exact verification.

Signature. A shingle that a text has w times covers [0, w) of its own line of weights, which is cut into blocks [0,1),
[1,2), [2,4), [4,8) ... Each block has a Poisson process of its own, with a rate as its length; each point of it has a
time, a register and a place in the block, all from hashes of shingle, block and the point's number. Points beyond w are
left out: a block is thinned as a whole, where BagMinHash splits it further in halves; the points that stay are the
same process, for at most twice the draws. A register keeps its earliest time. So two texts agree on a register with just the chance of their weighted
Jaccard similarity, and only as many points are drawn as come before the latest register's time.

Candidates. Equal texts are one node first. Nodes that agree on a whole band share a bucket.

Links. Nodes of a bucket are compared by their multisets themselves, in four rounds; after each, linked nodes are
merged into components, and only pairs across components go on. First all with one pivot of their bucket. Then all
with the bucket's best linked node, which is the text that copies were made from where there is one, and with one more
node by hash. Last, all pairs of nodes that are left in buckets of several components, by an exact prefix filter: each
node's elements are put in one order for all, those in few nodes first, and a pair at the threshold shares an element
that comes early in both. No pair is dropped for a bucket's size or by chance, and a group of copies costs a pair or two
for each of its nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import id_and_text, stored, texts_of
from .stores import Kept, enter, held
from .tokens import byte_slices

BANDS, ROWS, REGISTERS = 24, 5, 256
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Slots of the table that tells about how many nodes an element is in; only the order of elements depends on it.
SLOT_BITS = 18

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x moves every bit of the result."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes of texts or elements that are taken apart at once, or one row's.
AT_ONCE = 1 << 20


def _words() -> Kept:
    return held("words", lambda: Kept(lambda w: xxhash.xxh64_intdigest(w.encode())))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, with repeats; of fewer words, one of them all; of none, none."""
    w = _WORD.findall(text)
    if not w:
        return np.empty(0, _U)
    if len(w) < size:
        return np.array([xxhash.xxh64_intdigest(("\x00" + " ".join(w)).encode())], _U)
    h = np.fromiter(map(_words().__getitem__, w), _U, len(w))
    out = np.zeros(len(w) - size + 1, _U)
    for k in range(size):
        out = out * _MULTIPLIER + h[k : len(h) - size + 1 + k]
    return mix(out)


def elements(text: str) -> np.ndarray:
    """The multiset as a set: a shingle's k-th occurrence is an element of its own. Sorted."""
    values, counts = np.unique(shingles(text), return_counts=True)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(np.repeat(values, counts) + number.astype(_U) * _U(0xD6E8FEB86659FD93))


def alike(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash of (distinct shingles, their counts): a row of register times for each bag; of an empty bag, infinity."""
    h = np.full((len(bags), registers), np.inf)
    flat, parts = h.reshape(-1), []
    for d, (keys, counts) in enumerate(bags):
        low, block = 0, 0
        while len(keys):
            length = max(1, low)
            parts.append((mix(keys + _U(block * int(_MULTIPLIER) & (1 << 64) - 1)), np.full(len(keys), d), np.full(len(keys), length), counts - low))
            low, block = low + length, block + 1
            more = counts > low
            keys, counts = keys[more], counts[more]
    if not parts:
        return h
    key, doc, rate, inside = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, step = np.zeros(len(key)), 0
    while len(key):
        wide = int(max(1, min(64, 8192 // len(key))))
        seeds = mix(key[:, None] + np.arange(step + 1, step + wide + 1).astype(_U) * _U(0xA0761D6478BD642F))
        gaps = -np.log(((seeds >> _U(11)).astype(float) + 0.5) / 2.0**53) / rate[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        other = mix(seeds ^ _U(0xE7037ED1A0B428DB))
        register = ((other >> _U(32)) * _U(registers)) >> _U(32)
        place = ((other & _U(0xFFFFFFFF)) * rate[:, None].astype(_U)) >> _U(32)
        ok = place < inside[:, None].astype(_U)
        np.minimum.at(flat, (doc[:, None] * registers + register.astype(np.int64))[ok], times[ok])
        time, step = times[:, -1], step + wide
        some = np.unique(doc)
        latest = np.zeros(len(bags))
        latest[some] = h[some].max(axis=1)
        alive = time < latest[doc]
        key, doc, rate, inside, time = key[alive], doc[alive], rate[alive], inside[alive], time[alive]
    return h


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of the first bands x rows registers."""
    bits = np.ascontiguousarray(h[:, : bands * rows]).view(_U).reshape(len(h), bands, rows)
    key = np.broadcast_to(np.arange(bands).astype(_U) * _MULTIPLIER, (len(h), bands))
    for k in range(bits.shape[2]):
        key = mix(key * _MULTIPLIER + bits[:, :, k])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("minhash")
    for b in byte_slices(batches, 1, AT_ONCE):
        texts = texts_of(b, 1)
        bags = [np.unique(shingles(x), return_counts=True) for x in texts]
        registers = signatures(bags)
        keys = band_keys(registers)
        sizes = [int(c.sum()) for _, c in bags]
        offsets = np.concatenate([[0], np.cumsum([keys.shape[1] if n else 0 for n in sizes])]).astype(np.int32)
        rows = keys[np.array(sizes) > 0].reshape(-1) if texts else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.md5(x.encode()).digest() for x in texts], pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows))], ["doc_id", "node", "size", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("minhash")
    for b in byte_slices(batches, "text", AT_ONCE):
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([elements(x).tobytes() for x in texts_of(b, "text")], pa.binary())], ["node", "elements"])


def arrays_of(column: pa.Array) -> list[np.ndarray]:
    """Rows of 64-bit numbers in bytes, as views of Arrow's buffer."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2] or b""
    return [np.frombuffer(whole, _U, (stop - at) >> 3, at) for at, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("minhash")
    for b in batches:
        linked = []
        for x, y in zip(arrays_of(b.column("x")), arrays_of(b.column("y")), strict=True):
            both, union = alike(x, y)
            linked.append(DENOMINATOR * both >= NUMERATOR * union)
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "ra", "rb")], ["a", "b", "ra", "rb"]).filter(pa.array(linked, pa.bool_()))


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of one bucket and different components (ra, rb), whose sizes allow the similarity."""
    x, y = (df.select("band", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "size", "root"))) for k, df in ((1, left), (2, right)))
    least, most = F.least("size_1", "size_2"), F.greatest("size_1", "size_2")
    met = (x["band"] == y["band"]) & (F.col("root_1") != F.col("root_2")) & (DENOMINATOR * least >= NUMERATOR * most)
    one, two = (F.struct(F.col(f"node_{k}").alias("n"), F.col(f"root_{k}").alias("r")) for k in (1, 2))
    ends = x.join(y, met).select(F.least(one, two).alias("p"), F.greatest(one, two).alias("q"))
    return ends.select(F.col("p.n").alias("a"), F.col("q.n").alias("b"), F.col("p.r").alias("ra"), F.col("q.r").alias("rb")).distinct()


def _slots(e: np.ndarray) -> np.ndarray:
    return (e >> _U(64 - SLOT_BITS)).astype(np.int64)


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for b in batches:
        for x in arrays_of(b.column("elements")):
            np.add.at(total, _slots(x), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])


def prefix(e: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements, of those in several nodes, that may be the first which a pair at the threshold shares; their places.

    of e in order (often by slot, then the element). With x elements, y in the other node and at least 4/9 (x + y) in
    both, the first shared one has no more than x - 4/9 (x + y) elements before it, and y is at least 4/5 of x.
    """
    n = often[_slots(e)]
    order = np.lexsort((e, n))[: len(e) * (DENOMINATOR - NUMERATOR) // DENOMINATOR + 1]
    places = np.flatnonzero(n[order] > 1)
    return e[order[places]], places


def prefixed_pairs(bags: DataFrame) -> DataFrame:
    """All pairs (a, b) of nodes of different components that may reach the threshold; bags: node, root, elements.

    A pair is looked at where the two share an element that comes early enough in both; of a pair's shared elements
    before the bounds, as many as are missing at the last one must still be able to follow.
    """
    counts = bags.select("elements").mapInArrow(_often, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << SLOT_BITS, np.int64)
    often[counts["slot"].to_numpy()] = counts["n"].to_numpy()

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "elements", AT_ONCE):
            sizes, found, places = [], [], []
            for e in arrays_of(b.column("elements")):
                f, p = prefix(e, often)
                sizes.append(len(e))
                found.append(f.view(np.int64))
                places.append(p)
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (found, places)]
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(rows)), b.column("root").take(pa.array(rows)), pa.array(np.array(sizes, np.int64)[rows]), *map(pa.array, flat)], ["node", "root", "size", "element", "place"])

    rows = stored(bags.select("node", "root", "elements").mapInArrow(early, "node binary, root binary, size long, element long, place long"), "prefixes")
    several = rows.groupBy("element").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("element")
    rows = rows.join(several, "element")
    x, y = (rows.select("element", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "size", "place"))) for k in (1, 2))
    both, whole = NUMERATOR, NUMERATOR + DENOMINATOR
    least, most = F.least("size_1", "size_2"), F.greatest("size_1", "size_2")
    room = F.least(F.col("size_1") - F.col("place_1"), F.col("size_2") - F.col("place_2"))
    met = (x["element"] == y["element"]) & (F.col("node_1") < F.col("node_2")) & (F.col("root_1") != F.col("root_2"))
    met = met & (DENOMINATOR * least >= NUMERATOR * most) & (whole * room >= both * (F.col("size_1") + F.col("size_2")))
    pairs = x.join(y, met).select(F.col("node_1").alias("a"), F.col("node_2").alias("b"), F.col("root_1").alias("ra"), F.col("root_2").alias("rb"), (F.col("size_1") + F.col("size_2")).alias("sizes"), room.alias("room"))
    shared = pairs.groupBy("a", "b", "ra", "rb", "sizes").agg(F.count("*").alias("n"), F.min("room").alias("room"))
    return shared.filter(whole * (F.col("n") + F.col("room") - 1) >= both * F.col("sizes")).select("a", "b", "ra", "rb")


def links(signed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that join all nodes whose links are within buckets, and (node, root) of every node that shares a bucket.

    signed: doc_id, node, size, bands. Roots are kept from round to round: a round's links join roots, and only these
    few go through components().
    """
    nodes = signed.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.first("bands").alias("bands"))
    spread = nodes.select("node", "doc_id", "size", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.count("*").alias("nodes"), F.min("node").alias("pivot")).filter("nodes > 1")
    members = stored(spread.join(buckets, "band"), "members")

    lowest = F.lit(-(2**63))
    wanted = members.select("node", F.coalesce("doc_id", lowest).alias("key")).distinct()
    texts = id_and_text(docs, "doc_id", "text").select(F.coalesce("doc_id", lowest).alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    bags = stored(texts.join(wanted, ["key", "node"], "left_semi").dropDuplicates(["key", "node"]).select("node", "text").mapInArrow(_elements, "node binary, elements binary"), "bags")

    def verified(pairs: DataFrame) -> DataFrame:
        with_x = pairs.join(bags.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
        with_both = with_x.join(bags.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "ra", "rb", "x", "y")
        return stored(with_both.mapInArrow(_verify, "a binary, b binary, ra binary, rb binary"), "links", few=True)

    def merged(roots: DataFrame, linked: DataFrame) -> DataFrame:
        """roots after the links' roots have been joined."""
        up = components(linked, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("up"))
        return stored(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots", few=True)

    def unmerged(roots: DataFrame, linked: DataFrame, turn: int = 0) -> DataFrame:
        """Members of buckets that still have several components, with their root and a node to compare with.

        That is the bucket's best linked node at first, and then one by hash.
        """
        order = F.xxhash64("node", F.lit(turn)) if turn else F.struct("degree", F.xxhash64("node"))
        degree = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        now = members.join(roots, "node").join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        several = now.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.max_by("node", order).alias("best")).filter("r1 <> r2").select("band", "best")
        return stored(now.filter("nodes > 2").join(several, "band"), "unmerged", few=True)

    alone = members.withColumn("root", F.col("node"))
    roots = members.select("node", F.col("node").alias("root")).distinct()
    linked = verified(_pairs(alone.filter("node <> pivot"), alone.filter("node = pivot")))
    roots = merged(roots, linked)
    for turn in range(2):
        left = unmerged(roots, linked, turn)
        more = verified(_pairs(left.filter(F.col("node") == F.col("best")), left))
        roots, linked = merged(roots, more), linked.unionByName(more)
    left = unmerged(roots, linked).select("node", "root").distinct()
    last = verified(stored(prefixed_pairs(bags.join(left, "node")), "pairs", few=True))
    return linked.unionByName(last).select("a", "b"), merged(roots, last)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_node: bool = False) -> DataFrame:
    """doc_id, class_id (the least id of the document's class) and n_links for every row; with_node: and the text's MD5 as `node`.

    A class is made of equal texts and of links: weighted Jaccard similarity of the multisets of 5-word shingles (of a
    shorter text: all its words) of at least 0.8. n_links is how many different texts the search has linked to this
    one: enough to hold each class together, not all pairs of a class. Texts without a word are alike only if equal;
    null counts as empty. A null id takes its class's id, or null if the class has no other. Repeated rows share a
    class. An empty table gives an empty result; a very long text is signed and compared whole; other columns of docs
    are left out.
    """
    rows = id_and_text(docs, id_col, text_col)
    signed = stored(rows.mapInArrow(_sign, "doc_id long, node binary, size long, bands array<long>"), "signed")
    linked, roots = links(signed, rows)
    degree = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = stored(roots.join(degree, "node", "left"), "classes", few=True)
    placed = signed.select("doc_id", "node").join(known, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    ids = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return placed.join(ids, "root").select("doc_id", "class_id", "n_links", *["node"] * with_node)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that have their class's least id; of rows with the same id and text, one.

    Null texts count as empty, and are alike with other empty ones only; a row with a null id stays only in a class
    without ids. A very long text is compared whole. An empty table gives an empty result; other columns may have any
    names, and of repeated rows that differ in them an arbitrary one stays.
    """
    classes = near_duplicates(docs, id_col=id_col, text_col=text_col, with_node=True)
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"), F.col("node").alias("_node")).distinct()
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_key"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("_node"))
    return keyed.join(first, ["_key", "_node"], "left_semi").dropDuplicates(["_key", "_node"]).select("_row.*")
