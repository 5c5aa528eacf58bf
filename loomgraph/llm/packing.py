"""Packing along a space-filling curve.

Each document's token ids are hashed into a count vector, projected to three dimensions and mapped to its place
on a Hilbert curve. A range sort by that place lays similar documents side by side, spread evenly over
partitions; each partition then fills sequences of fixed length with its documents in that order. Documents are
cut where a sequence is full, so only the last sequence of a partition needs padding, and that to a power of two.

Data movement: one compact table of token ids in the shared folder (so that the sort's sampling doesn't encode
twice), then one shuffle of it by range. (place, doc_id, a hash of the ids, the section) is the sort key, so copies, which
share one place, still spread over partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, slices, stored
from .stores import enter
from .tokens import byte_slices, encoder

BUCKETS, DIMENSIONS, BITS = 256, 3, 10
#: A document of more tokens is sorted in sections, so that rows are bounded and equal shares of rows are nearly equal work.
SECTION = 16_384


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with `bits` bits in each dimension.

    Skilling's transform: undo the excess rotations and exchanges from the highest bit down, Gray-code the result
    and interleave its bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for shift in range(bits - 1, 0, -1):
        q = 1 << shift
        low = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ t)
            if i:
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & (1 << shift), (1 << shift) - 1, 0)
    x ^= t
    place = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> shift) & 1)
    return place


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(BUCKETS, DIMENSIONS)) / np.sqrt(BUCKETS)


def place_of(ids: list[np.ndarray], project: np.ndarray) -> np.ndarray:
    """Hilbert places of documents: hashed log counts of unit length, projected, squashed to the unit cube."""
    counts = np.stack([np.bincount((x * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS) for x in ids])
    vectors = np.log1p(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    flat = 0.5 + np.arctan(vectors @ project * np.sqrt(BUCKETS) * 1.5) / np.pi
    return hilbert(np.clip((flat * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def pack(docs: DataFrame, tokenizer: str, *, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and place (on the curve). A
    document's tokens are its ids and then end_id. A null or empty text has the end id alone. Rows that repeat are
    packed once each. No row goes missing; an empty table gives an empty result. A very long text is moved in sections
    of SECTION tokens, which may share a sequence with others. Other columns of docs are left out, whatever their names.
    Sequence ids are unique and not gapless: the partition's number is in the high bits.
    """
    project = projection()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        codec = encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        for b in byte_slices(batches, 1):
            ids = [np.frombuffer(x, "<u4") for x in codec.ids(b.column(1), end)]
            sizes = np.array([len(x) for x in ids])
            cuts = [(i, at) for i, n in enumerate(sizes.tolist()) for at in range(0, n, SECTION)]
            row, start = (np.array(c) for c in zip(*cuts, strict=True))
            parts = [ids[i][at : at + SECTION] for i, at in cuts]
            small = [x.astype("<u2") if x.max() < 65536 else x for x in parts]
            ties = np.array([zlib.crc32(x) for x in ids])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(place_of(ids, project)[row], pa.int64()), pa.array(sizes[row], pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in parts], pa.int64()), pa.array([x.tobytes() for x in small], pa.binary()), pa.array(ties[row], pa.int64())],
                ["doc_id", "place", "doc_tokens", "start", "n", "ids", "tie"],
            )

    coded = stored(id_and_text(docs, id_col, text_col).mapInArrow(encode, "doc_id long, place long, doc_tokens long, start long, n long, ids binary, tie long"), "packing")
    order = ["place", "doc_id", "tie", "start"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, used = TaskContext.get().partitionId() << 32, 0
        for b in slices(batches, 2048):
            rows: list[tuple] = []
            for doc, place, whole, start, n, raw in zip(*(b.column(k).to_pylist() for k in ("doc_id", "place", "doc_tokens", "start", "n", "ids")), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    take = min(n - at, length - used)
                    rows.append((doc, start + at, take, zlib.crc32(ids[at : at + take]), whole, sequence, used, place))
                    at, used = at + take, used + take
                    if used == length:
                        sequence, used = sequence + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "place"])

    return coded.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order).mapInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, place long")
