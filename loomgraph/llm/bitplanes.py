"""Centroid clustering with exact integer arithmetic on bit planes.

A vector of 64 fixed-point components is kept as its bit planes: plane b packs bit b of all components into one 64-bit
word, in two's complement, so the top plane counts negative. The dot product of two vectors is the sum over pairs of
planes of their weights times the bits that both have: a bitwise and, a bit count, and a weighted sum. Distances follow
exactly, with no rounding, whatever the order of the rows or the number of tasks.

Each round is one pass over the packed planes (an eighth of the vectors' bytes, or less), in which every task gives one
row of counts and sums for each centroid, and Spark adds them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

DIMENSIONS = 64
#: Components lie within 2^27, so that 64 squared differences fit a long.
MOST_BITS = 28
#: Vectors that are taken apart at once.
ROWS = 16_384


def bits_for(low: int, high: int) -> int:
    """Planes that hold every integer from low to high in two's complement."""
    return max(1, int(high).bit_length() + 1, (-int(low) - 1).bit_length() + 1 if low < 0 else 1)


def planes_of(x: np.ndarray, bits: int) -> np.ndarray:
    """(rows, 64) integers as (bits, rows) words; component i is bit i."""
    out = np.empty((bits, len(x)), np.uint64)
    for b in range(bits):
        flags = ((x >> b) & 1).astype(np.uint8)
        out[b] = np.packbits(flags, axis=1, bitorder="little").view("<u8").ravel()
    return out


def integers_of(planes: np.ndarray) -> np.ndarray:
    """planes_of() undone."""
    out = np.zeros((planes.shape[1], DIMENSIONS), np.int64)
    for weight, plane in zip(weights(len(planes)), planes, strict=True):
        out += weight * np.unpackbits(np.ascontiguousarray(plane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    return out


def weights(bits: int) -> list[int]:
    return [1 << b for b in range(bits - 1)] + [-(1 << (bits - 1))]


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The dot products of all vectors in `planes` with one vector, whose planes are the words of `other`."""
    total = np.zeros(planes.shape[1], np.int64)
    both, count = np.empty(planes.shape[1], np.uint64), np.empty(planes.shape[1], np.uint8)
    for v, plane in zip(weights(len(planes)), planes, strict=True):
        part = np.zeros(planes.shape[1], np.int64)
        for w, word in zip(weights(len(other)), other, strict=True):
            if word:
                np.bitwise_count(np.bitwise_and(plane, word, out=both), out=count)
                part += count * np.int64(w)
        total += part * np.int64(v)
    return total


def squares(planes: np.ndarray) -> np.ndarray:
    """Each vector's dot product with itself."""
    w, total = weights(len(planes)), np.zeros(planes.shape[1], np.int64)
    for a in range(len(planes)):
        for b in range(a, len(planes)):
            total += np.bitwise_count(planes[a] & planes[b]) * np.int64(w[a] * w[b] * (1 if a == b else 2))
    return total


class Centroids:
    """Integer vectors, with their planes."""

    def __init__(self, rows: Sequence[Sequence[int]]):
        self.rows = [[int(x) for x in r] for r in rows]
        table = np.array(self.rows, np.int64).reshape(-1, DIMENSIONS)
        self.planes = planes_of(table, bits_for(table.min(initial=0), table.max(initial=0))).T
        self.squares = [sum(x * x for x in r) for r in self.rows]

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid (of equals the first) and the squared distance to it, of each vector."""
        own = squares(planes)
        cluster, least = np.zeros(planes.shape[1], np.int32), None
        for k, (other, square) in enumerate(zip(self.planes, self.squares, strict=True)):
            far = own + np.int64(square) - 2 * dots(planes, other)
            if least is None:
                least = far
            else:
                nearer = far < least
                cluster[nearer], least[nearer] = k, far[nearer]
        return cluster, least

    def moved(self, found: dict[int, tuple[int, Sequence[int]]]) -> Centroids:
        """Each one with vectors becomes the floor of their mean; found: count and sums by centroid."""
        return Centroids([[s // found[k][0] for s in found[k][1]] if k in found else row for k, row in enumerate(self.rows)])

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[k])).encode()).hexdigest()


def packed(vectors: DataFrame, *, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and planes (64-bit words, lowest plane first) of every vector that can be clustered.

    Left out are nulls, vectors that haven't 64 components, and those with a component that is null, not finite, or
    beyond 2^27 in steps of 1 / scale.
    """
    x = F.col(vector_col).cast("array<double>")
    limit = float(1 << (MOST_BITS - 1))
    fine = F.coalesce(F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (v * scale >= -limit) & (v * scale < limit), F.lit(False))), F.lit(False))
    kept = vectors.where((F.size(vector_col) == DIMENSIONS) & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                x = b.column("x").flatten().to_numpy().reshape(-1, DIMENSIONS)
                bits = np.frexp(np.maximum(x.max(axis=1), -1 - x.min(axis=1)).astype(np.float64))[1] + 1
                for n in np.unique(bits).tolist():  # as few planes as a vector needs, so that equal ones are equal bytes
                    some = np.flatnonzero(bits == n)
                    words = planes_of(x[some], n).T.astype("<u8")
                    yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id").take(pa.array(some)), "planes": pa.array([r.tobytes() for r in words], pa.binary())})

    return kept.mapInArrow(task, "vec_id long, planes binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids, and planes as (bits, rows), of vectors with equally many planes."""
    for batch in batches:
        lengths = pc.binary_length(batch.column("planes")).to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            b = batch.take(pa.array(np.flatnonzero(lengths == length)))
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                words = np.frombuffer(b"".join(part.column("planes").to_pylist()), "<u8").reshape(part.num_rows, -1)
                yield part.column("vec_id"), np.ascontiguousarray(words.T)


def _sums(planes: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int], int]]:
    """By centroid: vectors, sums of their components, sum of their distances. The driver gets one row a centroid."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = np.zeros(len(centroids.rows), np.int64), [0] * len(centroids.rows)
        total = np.zeros((len(centroids.rows), DIMENSIONS), np.int64)
        for _, words in _unpacked(batches):
            cluster, distance = centroids.nearest(words)
            x = integers_of(words)
            for k in np.unique(cluster).tolist():
                mine = cluster == k
                n[k] += int(mine.sum())
                total[k] += x[mine].sum(axis=0)
                far[k] += int(distance[mine].astype(object).sum())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"k": pa.array(some, pa.int32()), "n": pa.array(n[some]), "sums": pa.array(total[some].tolist(), pa.list_(pa.int64())), "far": pa.array([str(far[k]) for k in some], pa.string())})

    parts = planes.select("vec_id", "planes").mapInArrow(task, "k int, n long, sums array<long>, far string")
    exact = "decimal(38,0)"
    added = parts.groupBy("k").agg(
        F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("far").cast(exact)).alias("far"), *(F.sum(F.col("sums")[i].cast(exact)).alias(f"s{i}") for i in range(DIMENSIONS))
    )
    return {r.k: (int(r.n), [int(r[f"s{i}"]) for i in range(DIMENSIONS)], int(r.far)) for r in added.collect()}


def first_centroids(planes: DataFrame, k: int, seed: int) -> Centroids:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order; of equal ids the least planes first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = planes.select(digest.alias("digest"), F.hex("planes").alias("planes")).orderBy("digest", "planes").limit(k).collect()
    return Centroids([integers_of(np.frombuffer(bytes.fromhex(r.planes), "<u8").reshape(-1, 1))[0] for r in rows])


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that can be clustered.

    `rounds` times every vector goes to the nearest centroid (ties: the smaller number) and every centroid that has
    vectors to the floor of their mean; then vectors are assigned once more. packed() says which vectors are left out.
    A null id stays, and draws as an empty one; repeated rows count as often as they come; fewer vectors than k give
    fewer centroids, an empty table an empty result. A sum of distances beyond a long is null. Other columns are left
    out, whatever their names. What the driver holds is k centroids and their sums.
    """
    spark = vectors.sparkSession
    planes = stored(packed(vectors, scale=scale, id_col=id_col, vector_col=vector_col), "bitplanes")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(planes, k, seed)
    if not centroids.rows:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = centroids.moved({j: x[:2] for j, x in _sums(planes, centroids).items()})
    far = {j: x[2] for j, x in _sums(planes, centroids).items()}
    fits = lambda x: x if x < 1 << 63 else None
    inertia, by_cluster = fits(sum(far.values())), [fits(far.get(j, 0)) for j in range(len(centroids.rows))]
    digests = [centroids.digest(j) for j in range(len(centroids.rows))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in _unpacked(batches):
            found, distance = centroids.nearest(words)
            places = pa.array(found)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": ids,
                    "cluster": places,
                    "distance": pa.array(distance),
                    "cluster_inertia": pa.array(by_cluster, pa.int64()).take(places),
                    "inertia": pa.array([inertia] * len(ids), pa.int64()),
                    "centroid_sha256": pa.array(digests, pa.string()).take(places),
                }
            )

    return planes.mapInArrow(task, schema)
