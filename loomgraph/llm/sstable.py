"""Sorted-string-table shards of token ids.

A shard is one immutable file: data blocks with Bloom filters between them, a sparse index of each, a footer. Keys are document ids
as 8 big-endian bytes with the sign bit flipped, so byte order is id order; a null id is the empty key. In a block
each entry stores how many key bytes it shares with the key before it and only the rest (prefix compression; every
RESTART entries the whole key), then the ids. Blocks are compressed and carry a crc32. The index has each block's
last key, place and tokens before it; point lookups find the filter of their key range, test it, binary-search the
index and read one block. A filter has a fixed size and takes bits as keys come; it is written when it has its number
of keys, folded in halves if it has fewer, so a writer's memory doesn't grow with its shard.

Shards are written by Spark tasks after a range sort by id. Each attempt writes a file of its own name, and only
files that a finished task reported are in the manifest, so a lost executor leaves at most an unused file.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_and_text, new_folder
from .stores import enter
from .tokens import byte_slices, encoder

BLOCK_BYTES, RESTART = 1 << 16, 16
#: A filter covers so many keys, which follow each other; it is written when it is full.
FILTER_BITS, BITS_PER_KEY, BLOOM_HASHES = 1 << 20, 10, 7
FILTER_KEYS = FILTER_BITS // BITS_PER_KEY
#: Shards whose ranges are broadcast at once by a lookup.
SHARDS_AT_ONCE = 50_000
MAGIC = b"LGSST001"
_FOOTER = struct.Struct("<QQQQQQ8s")  # block index at, its bytes, filter index at, its bytes, entries, tokens, magic
_INDEX = struct.Struct("<QQQQB")  # block at, its bytes, entries, tokens before it, bytes of the last key
_FILTER = struct.Struct("<QQB")  # filter at, its bytes (a power of 2), bytes of its last key
_ENTRY = struct.Struct("<BBIB")  # shared key bytes, other key bytes, ids, bytes of an id


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(BLOOM_HASHES)]


def split_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.FileSystem.from_uri("file://" + path.removeprefix("file:")))


class ShardWriter:
    """add() in key order, then close(). Holds one block, one filter of fixed size, and the indexes of both."""

    def __init__(self, path: str):
        fs, at = split_path(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.path, self.out = path, fs.open_output_stream(at)
        self.block, self.in_block, self.block_tokens, self.last = bytearray(), 0, 0, b""
        self.index, self.at, self.entries, self.tokens = bytearray(), 0, 0, 0
        self.filters, self.filter, self.filter_keys = bytearray(), bytearray(FILTER_BITS // 8), 0
        self.first: bytes | None = None

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian 32-bit ids."""
        key, values = key_of(doc_id), np.frombuffer(ids, "<u4")
        shared = 0
        if self.in_block % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        wide = 2 if not len(values) or values.max() < 65536 else 4
        self.block += _ENTRY.pack(shared, len(key) - shared, len(values), wide) + key[shared:] + values.astype(f"<u{wide}").tobytes()
        self.first = key if self.first is None else self.first
        self.in_block, self.block_tokens, self.last = self.in_block + 1, self.block_tokens + len(values), key
        for place in _bloom_places(key, FILTER_BITS):
            self.filter[place >> 3] |= 1 << (place & 7)
        self.filter_keys += 1
        if self.filter_keys == FILTER_KEYS:
            self._flush_filter()
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            data = zstandard.ZstdCompressor(level=1).compress(bytes(self.block))
            data = struct.pack("<I", zlib.crc32(data)) + data
            self.index += _INDEX.pack(self.at, len(data), self.in_block, self.tokens, len(self.last)) + self.last
            self.out.write(data)
            self.at, self.entries, self.tokens = self.at + len(data), self.entries + self.in_block, self.tokens + self.block_tokens
            self.block, self.in_block, self.block_tokens = bytearray(), 0, 0

    def _flush_filter(self) -> None:
        """Writes the filter, folded in halves while its keys leave it more bits than they need."""
        if self.filter_keys:
            bits = np.frombuffer(bytes(self.filter), np.uint8)
            while len(bits) > 8 and len(bits) * 4 >= self.filter_keys * BITS_PER_KEY:
                bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
            self.filters += _FILTER.pack(self.at, len(bits), len(self.last)) + self.last
            self.out.write(bits.tobytes())
            self.at += len(bits)
            self.filter, self.filter_keys = bytearray(FILTER_BITS // 8), 0

    def close(self) -> dict:
        self._flush()
        self._flush_filter()
        self.out.write(bytes(self.index) + bytes(self.filters) + _FOOTER.pack(self.at, len(self.index), self.at + len(self.index), len(self.filters), self.entries, self.tokens, MAGIC))
        self.out.close()
        return {"path": self.path, "first": self.first or b"", "last": self.last, "entries": self.entries, "tokens": self.tokens}


class ShardReader:
    """entries() in order; get() for one key."""

    def __init__(self, path: str):
        fs, at = split_path(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()
        index_at, index_n, filters_at, filters_n, self.n, self.tokens, magic = _FOOTER.unpack(self._read(self.size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        self.blocks, self.filters = self._index(_INDEX, index_at, index_n), self._index(_FILTER, filters_at, filters_n)
        self.filter_keys, self.at, self.filter = [x[-1] for x in self.filters], -1, b""

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _index(self, entry: struct.Struct, at: int, n: int) -> list[tuple]:
        """Fixed fields, and the last key in place of its length."""
        raw, at, out = self._read(at, n), 0, []
        while at < len(raw):
            *fields, k = entry.unpack_from(raw, at)
            out.append((*fields, raw[at + entry.size : at + entry.size + k]))
            at += entry.size + k
        return out

    def may_have(self, key: bytes) -> bool:
        """What the filter says whose key range has the key; the filter read last is kept."""
        k = bisect.bisect_left(self.filter_keys, key)
        if k == len(self.filters):
            return False
        if k != self.at:
            self.at, self.filter = k, self._read(*self.filters[k][:2])
        return all(self.filter[x >> 3] >> (x & 7) & 1 for x in _bloom_places(key, 8 * len(self.filter)))

    def block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        """Key, tokens of the shard before the entry, ids."""
        at, n, entries, before, _ = self.blocks[k]
        raw = self._read(at, n)
        if zlib.crc32(raw[4:]) != struct.unpack_from("<I", raw)[0]:
            raise ValueError("a block of a token shard is damaged")
        data, key, at = zstandard.ZstdDecompressor().decompress(raw[4:]), b"", 0
        for _ in range(entries):
            shared, rest, count, wide = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, before, np.frombuffer(data, f"<u{wide}", count, at).astype("<u4").tobytes()
            at, before = at + count * wide, before + count

    def entries(self) -> Iterator[tuple[int | None, int, bytes]]:
        for k in range(len(self.blocks)):
            for key, before, ids in self.block(k):
                yield id_of(key), before, ids

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every entry with the key; [] if there is none."""
        key, found = key_of(doc_id), []
        if self.may_have(key):
            for k in range(bisect.bisect_left([b[4] for b in self.blocks], key), len(self.blocks)):
                here = [ids for other, _, ids in self.block(k) if other == key]
                found += here
                if self.blocks[k][4] > key:
                    break
        return found


def write(docs: DataFrame, tokenizer: str, *, end_id: int | None = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encodes and writes all documents in ascending id order; the manifest: one dict for each shard, in order, with `base`, the ids of all shards before it.

    The manifest's length is the number of partitions, whatever the number of documents. A null text has no ids but
    the end id; a null id comes first; rows with equal ids are kept, in the order of their texts' hashes. A very long
    text is one entry, as long as its ids. An empty table gives an empty manifest; other columns of docs are left out.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("sstable")
        codec, shard = encoder(tokenizer), None
        for b in byte_slices(batches, 1):
            shard = shard or ShardWriter(f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst")
            for doc, ids in zip(b.column(0).to_pylist(), codec.ids(b.column(1), end), strict=True):
                shard.add(doc, ids)
        if shard:
            yield pa.RecordBatch.from_pylist([shard.close() | {"part": TaskContext.get().partitionId()}], schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("entries", pa.int64()), ("tokens", pa.int64())]))

    rows = id_and_text(docs, id_col, text_col)
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    manifest = [r.asDict() for r in ordered.mapInArrow(task, "part long, path string, first binary, last binary, entries long, tokens long").collect()]
    base = 0
    for x in sorted(manifest, key=lambda x: x["part"]):
        x["base"], base = base, base + x["tokens"]
    return sorted(manifest, key=lambda x: x["part"])


def _shards(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    rows = [(x["path"], x["base"]) for x in manifest]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "path string, base long")


def read(spark: SparkSession, manifest: list[dict], *, with_ids: bool = True) -> DataFrame:
    """All entries of a manifest, a task for each shard; of an empty one none, and a very long entry whole: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list[tuple] = []
                for doc, before, ids in ShardReader(path).entries():
                    rows.append((doc, base + before, len(ids) // 4, zlib.crc32(ids), *[ids] * with_ids))
                    if len(rows) == 512:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return _shards(spark, manifest).mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def lookup(spark: SparkSession, manifest: list[dict], wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of the wanted ids that are stored: each id goes to the shards whose key range has it.

    A null id finds the entries without an id; an id that is wanted twice is looked up once, one that several rows had
    gives a row for each. No wanted row, or an empty manifest, gives an empty result; other columns of wanted are left
    out. Ranges of SHARDS_AT_ONCE shards are broadcast at a time, some hundred bytes each.
    """
    if len(manifest) > SHARDS_AT_ONCE:
        return lookup(spark, manifest[:SHARDS_AT_ONCE], wanted, id_col).unionAll(lookup(spark, manifest[SHARDS_AT_ONCE:], wanted, id_col))
    ranges = spark.createDataFrame([(x["path"], id_of(x["first"]), id_of(x["last"])) for x in manifest], "path string, lo long, hi long")
    keys = wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    hits = keys.join(F.broadcast(ranges), (F.coalesce("doc_id", F.lit(-(2**63))) >= F.coalesce("lo", F.lit(-(2**63)))) & (F.coalesce("doc_id", F.lit(-(2**63))) <= F.coalesce("hi", F.lit(-(2**63)))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, shard = None, None
        for b in batches:
            found = []
            for doc, path in zip(b.column("doc_id").to_pylist(), b.column("path").to_pylist(), strict=True):
                if path != open_path:
                    open_path, shard = path, ShardReader(path)
                found += [(doc, ids) for ids in shard.get(doc)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["doc_id", "ids"])

    return hits.repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(task, "doc_id long, ids binary")
