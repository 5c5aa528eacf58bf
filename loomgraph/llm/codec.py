"""Encoding by a streaming transducer, and decoding by a state machine.

`Encoder` takes a text in parts. Its characters go through the normaliser, the splitter and bpe.Emitting, which gives a
token as soon as no later symbol can change it; what is held is one character with its marks, two characters of the
splitter and fewer symbols than the merge list's sufficient look-ahead and two longest tokens (see bpe), whatever the
text. Where every pretoken ends, before a word behind white space, the transducer is in its first state again: from
there a whole word is one kept transition, with the word's ids. A part's first and last word go symbol by symbol, as
other parts may belong to them.

`Decoder` turns ids back to text as they come: files with a byte-level decoder give bytes, of which incomplete
characters wait for the next id; files without a decoder give the tokens' strings with spaces between them, as their
library does.

Every text goes through both, PART characters at a time.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Emitting, Walk, machine
from .pieces import Normalised, Splitter, byte_letters, pretokens
from .shared import few_collections, id_and_text
from .stores import Kept, enter, held
from .tokens import byte_slices

#: Characters of a text that are taken at once.
PART = 1 << 13
#: Signs that are a pretoken of their own behind a letter and before white space.
ENDINGS = frozenset(".,;:!?)")
#: Bytes of words and pretokens that a worker keeps.
KEEP_BYTES = 320 << 20


class Decoder:
    """feed() ids, then end()."""

    def __init__(self, codec: Codec):
        self.names, self.special, self.raw = codec.names, codec.machine.special_ids, codec.raw
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.raw is None:
            before, self.begun = " " * self.begun, True
            return before + " ".join(map(self.names.__getitem__, ids))
        if self.special.isdisjoint(ids):
            return self.utf8.decode(b"".join(map(self.raw.__getitem__, ids)))
        out = []
        for i in ids:
            if i in self.special:
                out.append(self.utf8.decode(b"", True) + self.names[i])
                self.utf8.reset()
            else:
                out.append(self.utf8.decode(self.raw[i]))
        return "".join(out)

    def end(self) -> str:
        return self.utf8.decode(b"", True)


class Codec:
    """What encoders and decoders of one tokenizer file share; words that came before are kept."""

    def __init__(self, path: str):
        pre = pretokens(path)
        self.pretokens, self.machine, self.splitter = pre, machine(Emitting, path), Splitter(pre)
        self.names = {i: t for t, i in self.machine.vocab.items()} | {i: t for t, i in self.machine.special.items()}
        letters = {c: b for b, c in enumerate(byte_letters())}
        #: What each id adds in bytes; None for files whose tokens are joined by spaces.
        self.raw = {i: bytes(map(letters.__getitem__, t)) for i, t in self.names.items() if i not in self.machine.special_ids} if self.machine.decoder == "ByteLevel" else None
        self.starts = {s[:n] for s in pre.special_ids for n in range(1, len(s))}
        self.longest = max(map(len, self.starts), default=0)
        #: Where every pretoken ends, and what the word behind has before it. Files that drop white space end one at each.
        self.cut, self.space = (re.compile(r" (?=\S)"), " ") if self.splitter.spaces else (re.compile(r"[ \n]"), "")
        self.pretoken = Kept(self._pretoken)
        self.word = Kept(lambda w: self._word(self.space + w))

    def _pretoken(self, raw: bytes) -> bytes:
        return array("I", self.machine.run(raw, [])).tobytes()

    def _word(self, word: str) -> bytes:
        body = word[:-1]
        plain = body[1:] if self.space else body
        if word[-1:] in ENDINGS and plain.isascii() and plain.isalpha():  # a run of letters and a sign
            return self.pretoken[(body.lower() if self.pretokens.lower else body).encode()] + self.pretoken[word[-1].encode()]
        found = self.pretokens.of(word)
        if len(found) == 1 and isinstance(found[0], bytes):  # the word's own entry is enough
            return self.pretoken.get(found[0]) or self._pretoken(found[0])
        return b"".join([self.pretoken[x] if isinstance(x, bytes) else x.to_bytes(4, "little") for x in found])

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids of a text that is taken part by part, as they come, as little-endian 32-bit numbers."""
        encoder = Encoder(self)
        for at in range(0, len(text), PART):
            yield encoder.feed(text[at : at + PART])
        yield encoder.end()


class Encoder:
    """feed() parts of one text, then end(); each gives the ids that are final, as little-endian 32-bit numbers."""

    def __init__(self, codec: Codec):
        self.codec, self.held = codec, ""
        self.chars, self.run = Normalised(codec.pretokens), Walk(codec.splitter, codec.machine)

    def feed(self, part: str) -> bytes:
        text, codec = self.held + part, self.codec
        stop = next((k for k in range(max(0, len(text) - codec.longest), len(text)) if text[k:] in codec.starts), len(text))
        self.held = text[stop:]
        first, *words = codec.cut.split(text[:stop])
        if not words:
            return self.walk(first)
        last = words.pop()
        return b"".join((self.walk(first), self.close(), *map(codec.word.__getitem__, words), self.walk(codec.space + last)))

    def end(self) -> bytes:
        held, self.held = self.held, ""
        return self.walk(held) + self.close()

    def walk(self, chars: str) -> bytes:
        """Whole special strings, and what is between them through the transducer."""
        out, at = [], 0
        for m in self.codec.pretokens.special_in(chars):
            out += (self._through(chars[at : m.start()]), self.close(), self.codec.pretokens.special_ids[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join((*out, self._through(chars[at:])))

    def _through(self, chars: str) -> bytes:
        return _ids(self.run.feed(self.chars.feed(chars)))

    def close(self) -> bytes:
        """The ids that an end here brings; the transducer is in its first state then."""
        return _ids(self.run.feed(self.chars.end())) + _ids(self.run.end())


def _ids(annotations: list[tuple[int, ...]]) -> bytes:
    return array("I", chain.from_iterable(annotations)).tobytes()


def round_trip(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), decoded, and the SHA-256 of both, for every row, without a shuffle.

    A null text counts as empty: no ids, and an empty decoded text. A very long text is encoded part by part; only its
    ids and decoded text are whole, as they are the result. Null ids and repeated rows stay as they are, an empty table
    gives an empty result, and other columns of docs are left out, whatever their names.
    Select only the columns you need: texts that aren't selected still cross from Python to Spark, so
    `digests` leaves them out.
    """
    return _run(docs, tokenizer, id_col, text_col, True)


def digests(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """round_trip() without ids and decoded; of a very long text no more than a part is held."""
    return _run(docs, tokenizer, id_col, text_col, False)


def _streamed(codec: Codec, text: str, full: bool) -> tuple:
    """Number of ids, the SHA-256 of the ids and of the decoded text, and if `full` both: all of them as they come."""
    n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(codec)
    all_ids, all_text = [], []
    for part in codec.parts(text):
        n += len(part) // 4
        of_ids.update(part)
        told = decoder.feed(memoryview(part).cast("I").tolist())
        of_text.update(told.encode())
        if full:
            all_ids.append(part)
            all_text.append(told)
    told = decoder.end()
    of_text.update(told.encode())
    return n, of_ids.hexdigest(), of_text.hexdigest(), *([b"".join(all_ids), "".join(all_text) + told] if full else [])


def _run(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, full: bool) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("codec", KEEP_BYTES)
        few_collections()
        codec = held(("codec", tokenizer), lambda: Codec(tokenizer))
        kinds = [pa.int64(), pa.string(), pa.string(), *([pa.binary(), pa.string()] if full else [])]
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])]
        for b in byte_slices(batches, 1):
            made = [_streamed(codec, text or "", full) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), kinds, strict=True))], ["doc_id", *names])

    return id_and_text(docs, id_col, text_col).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * full)
