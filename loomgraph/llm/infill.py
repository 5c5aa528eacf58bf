"""Fill-in-the-middle transformation, with unit ends found a machine word at a time.

A batch's texts lie side by side in Arrow's UTF-8 buffer, which is viewed as 64-bit words. Bytes that end a unit (a line
or a character) are marked arithmetically, eight at once; a bit count of each word's marks and a running total tell how
many units end before any byte (rank). The k-th end (select) is found by a binary search in the running total, which
names the word, and a prefix sum of the marks inside that word by one multiplication. So cutting costs a few word
operations for each eight bytes, and nothing for each unit.

An output is the text itself (plain), `<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm);
restored() takes it apart at its sentinels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import enter
from .tokens import byte_slices

#: Signs before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("line", "character")
_ONES, _HIGH, _LOW = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, with one to eight zero bytes behind."""
    words = np.zeros(len(data) // 8 + 1, "<u8")
    words.view(np.uint8)[: len(data)] = data
    return words


def line_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a line feed."""
    x = words ^ (_ONES * np.uint64(10))
    return ~(((x & _LOW) + _LOW) | x) & _HIGH


def character_starts(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that isn't the inside of a character (10xxxxxx)."""
    return ~(words & (~words << np.uint64(1))) & _HIGH


def character_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte before one that starts a character."""
    starts = character_starts(words)
    return (starts >> np.uint64(8)) | (np.append(starts[1:], _HIGH) << np.uint64(56))


class Marks:
    """Marked bytes: how many lie before a place, and where the k-th is."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.counts = np.bitwise_count(marks).astype(np.int64)
        self.totals = np.cumsum(self.counts)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Marks at bytes before each place."""
        word, inside = places >> 3, (np.asarray(places) & 7).astype(np.uint64) << np.uint64(3)
        before = self.marks[word] & ((np.uint64(1) << inside) - np.uint64(1))
        return self.totals[word] - self.counts[word] + np.bitwise_count(before)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th mark, from 1."""
        word = np.searchsorted(self.totals, k, "left")
        left = (k - (self.totals[word] - self.counts[word])).astype(np.uint64)
        sums = (self.marks[word] >> np.uint64(7)) * _ONES  # each byte: the marks up to it
        fewer = ~((sums | _HIGH) - left * _ONES) & _HIGH
        return (word << 3) + np.bitwise_count(fewer)


class Cuts(NamedTuple):
    """For each text: its units, the two cuts (bytes from the batch's first) and the characters of prefix and middle."""

    units: np.ndarray
    first: np.ndarray
    second: np.ndarray
    prefix_chars: np.ndarray
    middle_chars: np.ndarray


def cuts(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, two: np.ndarray, unit: str = "line") -> Cuts:
    """Where texts data[offsets[i]:offsets[i + 1]] are cut: after one % (n + 1) and two % (n + 1) of their n units."""
    words = words_of(data)
    ends, chars = Marks(line_ends(words) if unit == "line" else character_ends(words)), Marks(character_starts(words))
    start, stop = offsets[:-1], offsets[1:]
    before = ends.rank(start)
    marked = ends.rank(stop) - before
    last = np.maximum(stop - 1, start)
    units = marked + ((stop > start) & (ends.rank(last) - before == marked))  # a last unit without an end of its own

    def place(k: np.ndarray) -> np.ndarray:
        out = np.where(k == 0, start, stop)
        inside = np.flatnonzero((k > 0) & (k <= marked))
        out[inside] = ends.select(before[inside] + k[inside]) + 1
        return out

    k, m = one % (units + 1), two % (units + 1)
    first, second = place(np.minimum(k, m)), place(np.maximum(k, m))
    here = chars.rank(first)
    return Cuts(units, first, second, here - chars.rank(start), chars.rank(second) - here)


def restored(output: bytes, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> bytes:
    """The text again."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in sentinels)
    a, b = (p, s) if form == "psm" else (s, p)
    head, middle = output[len(a) :].split(m, 1)
    x, y = head.split(b, 1)
    return x + middle + y if form == "psm" else y + middle + x


def _number(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Sentinels that a reader finds again: none begins as one (or itself) ends, or lies in another."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[:n] == b[-n:] for n in range(1, min(len(a), len(b)))):
                raise ValueError("sentinels must be distinct, and none may begin as one ends")
    if len(set(sentinels)) < 3:
        raise ValueError("sentinels must be distinct, and none may begin as one ends")


def transform(
    docs: DataFrame,
    *,
    unit: str = "line",
    rate: int = 100,
    spm: int = 50,
    seed: int = 7,
    sentinels: tuple[str, str, str] = SENTINELS,
    texts: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256, and output if `texts`, for every row.

    unit is line or character. Draws are the first four 8-digit groups of SHA-256 of `seed:doc_id`: two cuts, whether
    the text is transformed (`rate` of 100) and whether as spm (`spm` of 100). A text that is empty or has a sentinel in
    it stays plain, with null prefix_chars and middle_chars; a null text counts as empty. A null id draws as an empty
    one. Repeated rows give repeated rows, an empty table an empty result; a very long text is cut whole, in a batch of
    its own. Other columns of docs are left out, whatever their names. No shuffle, and no state between rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    _checked(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = rows.withColumn("digest", digest)
    drawn = drawn.select("doc_id", "text", *(_number(F.col("digest"), k).alias(f"h{k + 1}") for k in range(4)))
    p, s, m = (x.encode() for x in sentinels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("infill")
        for b in byte_slices(batches, 1):
            column = b.column(1).cast(pa.large_string())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            buffer = column.buffers()[2]
            data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
            h1, h2, h3, h4 = (b.column(f"h{k}").to_numpy() for k in range(1, 5))
            found = cuts(data, offsets, h1, h2, unit)
            signed = np.zeros(len(column), bool)
            for x in sentinels:
                signed |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
            plain = signed | (offsets[1:] == offsets[:-1]) | (h3 % 100 >= rate)
            forms = np.where(plain, "plain", np.where(h4 % 100 < spm, "spm", "psm")).tolist()
            view, outputs, digests, back = memoryview(data), [], [], []
            for form, start, one, two, stop in zip(forms, offsets[:-1].tolist(), found.first.tolist(), found.second.tolist(), offsets[1:].tolist(), strict=True):
                if form == "plain":
                    made = bytes(view[start:stop])
                elif form == "psm":
                    made = b"".join((p, view[start:one], s, view[two:stop], m, view[one:two]))
                else:
                    made = b"".join((s, view[two:stop], p, view[start:one], m, view[one:two]))
                digests.append(hashlib.sha256(made).hexdigest())
                back.append(hashlib.sha256(restored(made, form, sentinels)).hexdigest())
                if texts:
                    outputs.append(made.decode())
            columns = {
                "doc_id": b.column(0),
                "n": pa.array(found.units, pa.int64()),
                "form": pa.array(forms, pa.string()),
                "prefix_chars": pa.array(found.prefix_chars.astype(np.int64), mask=plain),
                "middle_chars": pa.array(found.middle_chars.astype(np.int64), mask=plain),
                "output_sha256": pa.array(digests, pa.string()),
                "restored_sha256": pa.array(back, pa.string()),
            }
            if texts:
                columns["output"] = pa.array(outputs, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return drawn.mapInArrow(task, schema + ", output string" * texts)
