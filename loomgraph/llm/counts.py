"""Token counts by a compiled finite-state tokenizer.

The splitter and bpe.Counting are one transducer over characters (bpe.Walk); its transitions carry the change in the
number of tokens, so a text's count is their sum. Special strings split a text first, as the library does.

What lies between is read in chunks of CHUNK characters, short texts too. A chunk's state map sends the state before
the chunk to the state behind it and a count. A space that a visible character follows ends every pretoken, whatever
the state: so a map is the characters before the chunk's first such place (which the state before still has to walk),
the count from there on, and the state behind the chunk. Maps compose associatively, by walking the later map's open
characters from the earlier one's state; a parallel prefix scan over a tree of log2(chunks) levels gives every prefix's.

Words between two such places take the transducer from the same state to the same state. Each is walked once and its
count kept, as a transition over the whole word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import Counting, Walk, machine
from .pieces import Splitter, pretokens
from .shared import few_collections, id_and_text
from .stores import Kept, enter, held
from .tokens import byte_slices, distinct, pieces_of

CHUNK = 1 << 12


class StateMap(NamedTuple):
    """head: walked from the state before; behind it, if state isn't None, `count` more tokens and that state."""

    head: str
    count: int
    state: tuple | None


class Counter:
    def __init__(self, path: str):
        pre = pretokens(path)
        if pre.tokenizer.normalizer:
            raise ValueError("only for files without a normaliser")
        self.special = pre.special
        self.walk = Walk(Splitter(pre), machine(Counting, path))
        self.first = self.walk.first
        self.pretokens = pre
        self.pretoken = Kept(lambda raw: self.walk.machine.run(raw, 0))
        self.of_word = Kept(lambda word: self._whole(" " + word))
        self.open_word = Kept(lambda word: self._walked(self.first, " " + word, False))

    def _walked(self, state: tuple, chars: str, over: bool = True) -> tuple[int, tuple | None]:
        """Tokens of the transitions over chars, and of the end behind them if the text is over there; the state."""
        self.walk.state = state
        n = sum(self.walk.feed(chars))
        return (n + sum(self.walk.end()), None) if over else (n, self.walk.state)

    def _whole(self, chars: str) -> int:
        """Tokens from the first state to the first state again."""
        found = self.pretokens.of(chars)
        if len(found) == 1 and isinstance(found[0], bytes):  # the word's own entry is enough
            return self.pretoken.get(found[0]) or self.walk.machine.run(found[0], 0)
        return sum([self.pretoken[x] if isinstance(x, bytes) else 1 for x in found])

    def maps(self, chunks: list[str]) -> list[StateMap]:
        out: list[StateMap] = [StateMap("", 0, None)] * len(chunks)
        for rows, starts, words in pieces_of(pa.array(chunks, pa.string())):
            names, places = distinct(words)
            counts = np.array([self.of_word[x] for x in names], np.int64)[places]
            sums = np.concatenate([[0], np.cumsum(counts)])
            first, last = words.take(pa.array(starts[:-1])).to_pylist(), words.take(pa.array(starts[1:] - 1)).to_pylist()
            between = sums[starts[1:] - 1] - sums[np.minimum(starts[:-1] + 1, starts[1:] - 1)]
            for row, head, tail, n, several in zip(rows.tolist(), first, last, between.tolist(), (np.diff(starts) > 1).tolist(), strict=True):
                if several:
                    more, state = self.open_word[tail]
                    out[row] = StateMap(head, n + more, state)
                else:
                    out[row] = StateMap(head, 0, None)
        return out

    def join(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of a's chunk and b's behind it."""
        if a.state is None:
            return StateMap(a.head + b.head, b.count, b.state)
        n, state = self._walked(a.state, b.head, b.state is not None)
        return StateMap(a.head, a.count + n + b.count, b.state or state)

    def started(self, m: StateMap) -> StateMap:
        """The map of a text's first chunk, whose state before is known: nothing is left to walk."""
        n, state = self._walked(self.first, m.head, m.state is not None)
        return StateMap("", n + m.count, m.state or state)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """The map of every prefix: those of pairs first, and from their scan every second one."""
        if len(maps) < 2:
            return maps
        up = self.scan([self.join(a, b) for a, b in zip(maps[::2], maps[1::2])])
        return [up[i // 2] if i % 2 else self.join(up[i // 2 - 1], m) if i else m for i, m in enumerate(maps)]

    def prefix_counts(self, texts: list[str]) -> list[list[int]]:
        """For each text, the tokens that its first chunk, its first two chunks ... would have alone; the last is its count."""
        parts: list[list[str]] = [self.special.split(x) if self.special else [x] for x in texts]
        chunks = [[p[i : i + CHUNK] for i in range(0, len(p), CHUNK)] for x in parts for p in x]
        maps, at, made = self.maps([c for x in chunks for c in x]), 0, iter(chunks)
        out = []
        for x in parts:
            counts, before = [], -1
            for _ in x:
                n = len(next(made))
                before += 1  # the special string between two parts
                if n:
                    scanned = self.scan([self.started(maps[at]), *maps[at + 1 : at + n]])
                    counts += [before + m.count + self._walked(m.state, "")[0] for m in scanned]
                before, at = counts[-1] if n else before, at + n
            out.append(counts or [0])
            if before > out[-1][-1]:
                out[-1].append(before)
        return out


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens), prefix_tokens for every row, in one pass without a shuffle.

    prefix_tokens has the tokens of the text's first chunk of CHUNK characters alone, of its first two chunks, and so
    on; a special string ends a chunk. A null text counts as empty: 0 bytes, 0 tokens. A very long text is read in
    chunks like any other. Null ids and repeated rows stay as they are, an empty table gives an empty result, and
    other columns of docs are left out, whatever their names.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few_collections()
        enter("counts")
        counter = held(("counter", tokenizer), lambda: Counter(tokenizer))
        for b in byte_slices(batches, 1):
            texts = pc.fill_null(b.column(1).cast(pa.string()), "")
            found = counter.prefix_counts(texts.to_pylist())
            n = [x[-1] for x in found]
            columns = [b.column(0), pa.array(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "prefix_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, prefix_tokens array<long>")
