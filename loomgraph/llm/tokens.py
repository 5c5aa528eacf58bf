"""Token ids as the tokenizers library gives them, asking it once for each distinct piece of text.

Byte-level splitting never joins a space to a visible character before it, and white space before a word gives its last
space to the word. So a text can be cut before every space that a visible character follows, and the ids of the pieces
make up the ids of the text. Pieces repeat all over a corpus: Arrow finds the distinct ones of a batch, each Python
worker keeps the ids of those it has met, the library encodes the new ones side by side as one text, and Arrow lays the
ids side by side again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pieces import pretokens
from .stores import KEEP_CHARS, Kept, KeptArrays, held

#: Texts of a batch that are taken apart at once hold so many bytes, or are one text.
BYTES_AT_ONCE = 4 << 20
#: New pieces that the library encodes as one text; each has KEEP_CHARS characters at most.
PIECES_AT_ONCE = 4096

#: White space as Python and Unicode have it.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Where a space isn't a place to cut: white space on both sides, or white space before it at the end.
_UNSAFE = rf"[{_WHITE}] (?:[{_WHITE}]|\z)"
_CUT = re.compile(r" (?=\S)")


def byte_slices(batches: Iterable[pa.RecordBatch], column: int | str, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts in `column` hold at most so many bytes, or of one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(at, stop - at)
            at = stop


def distinct(values: pa.Array) -> tuple[list, np.ndarray]:
    """The distinct values, and each value's place among them."""
    coded = values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


class Gathered:
    """A byte string for each value, side by side: slices of values are slices of bytes."""

    def __init__(self, strings: list[bytes] | pa.Array, places: np.ndarray):
        strings = strings if isinstance(strings, pa.Array) else pa.array(strings, pa.large_binary())
        made = strings.take(pa.array(places)) if len(places) else pa.array([], pa.large_binary())
        self.ends = np.frombuffer(made.buffers()[1], np.int64)[: len(made) + 1] if len(made) else np.zeros(1, np.int64)
        self.data = memoryview(made.buffers()[2] or b"").cast("B") if len(made) else memoryview(b"")

    def of(self, first: int, stop: int) -> memoryview:
        return self.data[self.ends[first] : self.ends[stop]]


def pieces_of(texts: pa.Array, anywhere: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Groups of rows: their numbers, where each one's pieces begin (and the end), all pieces.

    Pieces lack their leading space; a row's first one had none. Every row is in one group; a null has one empty piece.
    anywhere: for tokenizers that drop white space, so that every space, and every line's end, is a place to cut.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if anywhere:
        texts = pc.replace_substring(texts, "\n", " ")
        unsafe = np.zeros(len(texts), bool)
    else:
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False).astype(bool)
    for rows, plain in ((np.flatnonzero(~unsafe), True), (np.flatnonzero(unsafe), False)):
        if len(rows):
            some = texts.take(pa.array(rows))
            lists = pc.split_pattern(some, " ") if plain else pa.array([_CUT.split(x) for x in some.to_pylist()], pa.list_(pa.string()))
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            starts = lists.offsets.to_numpy()
            yield rows, starts - starts[0], lists.flatten()


class PieceEncoder:
    """ids() for texts, as little-endian 32-bit ids in bytes."""

    def __init__(self, path: str):
        self.pretokens = pretokens(path)
        if self.pretokens.tokenizer.normalizer:
            raise ValueError("only for byte-level files without a normaliser")
        self.tokenizer = self.pretokens.tokenizer
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of text that a token stands for; a byte-level token has a character for each.
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.sizes[list(vocab.values())] = list(map(len, vocab))
        self.table = dict(enumerate(self.pretokens.letters))
        self.token_ids = Kept(self._pretoken)
        self.pieces = KeptArrays()
        self.first = Kept(self._piece)

    def _pretoken(self, raw: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.table))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pretokens.of(piece)
        if len(found) == 1 and isinstance(found[0], bytes):  # the piece's own entry is enough
            return self.token_ids.get(found[0]) or self._pretoken(found[0])
        return b"".join([self.token_ids[x] if isinstance(x, bytes) else x.to_bytes(4, "little") for x in found])

    def _pieces(self, rests: list[str]) -> list[bytes]:
        """The ids of each piece, whose leading space is left out.

        Pieces that begin and end visibly don't change each other's ids side by side, so the library gets many as one
        text; its tokens' bytes tell where each piece ends. Long pieces and special strings are encoded one by one.
        """
        out, special = [b""] * len(rests), self.pretokens.special
        alone = [not x or len(x) > KEEP_CHARS or x != x.strip() or bool(special and special.search(x)) for x in rests]
        for i in np.flatnonzero(alone).tolist():
            out[i] = self._piece(" " + rests[i])
        together = np.flatnonzero(~np.array(alone, bool)).tolist()
        for first in range(0, len(together), PIECES_AT_ONCE):
            places = together[first : first + PIECES_AT_ONCE]
            some = [" " + rests[i] for i in places]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends, borders = np.cumsum(self.sizes[ids]), np.cumsum([len(x.encode()) for x in some])
            stops = np.searchsorted(ends, borders)
            if stops[-1] != len(ids) - 1 or not np.array_equal(ends[stops], borders):
                raise ValueError("the tokens don't end where the pieces do")
            raw, at = ids.tobytes(), 0
            for i, stop in zip(places, (4 * (stops + 1)).tolist(), strict=True):
                out[i], at = raw[at:stop], stop
        return out

    def ids(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """Of each text, with `end` behind."""
        out: list[bytes] = [b""] * len(texts)
        for rows, starts, pieces in pieces_of(texts):
            heads = pieces.take(pa.array(starts[:-1])).to_pylist()
            mask = np.zeros(len(pieces), bool)
            mask[starts[:-1]] = True
            coded = pc.if_else(pa.array(mask), "", pieces).dictionary_encode()
            made = Gathered(self.pieces.many(coded.dictionary, self._pieces), coded.indices.to_numpy())
            for row, head, at, stop in zip(rows.tolist(), heads, (starts[:-1] + 1).tolist(), starts[1:].tolist(), strict=True):
                out[row] = b"".join((self.first[head], made.of(at, stop), end))
        return out


def encoder(path: str) -> PieceEncoder:
    """One for each worker process and file, while it works for the same operator."""
    return held(("encoder", path), lambda: PieceEncoder(path))
