"""Toxicity: noisy-channel restoration of disguised words, then a learned scorer over words and families of words.

Restoration. A piece of text that looks disguised (look-alike digits or signs inside a word, a letter three times in a
row, single letters apart by spaces or signs) is read as the output of a noisy channel: a lattice gives for each
character the letters it may stand for, with the channel's cost; Viterbi finds the likeliest letters under a character
trigram model of the training texts. Other pieces have one reading only and pass as they are.

Scoring. A logistic scorer over what a text has: its words, the beginnings of its words, and whether it has two or
three different words with one beginning, as toxic words come in families. Features are taken that at least `least`
toxic texts have and that are `lift` times as frequent in toxic texts as in others; both are parameters, and no other
bound drops one. Weights are at least 0 and have a small L2 penalty; the bias is what a text without any has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, slices, stored, texts_of
from .stores import Kept, enter, held

#: Letters that signs stand for in disguised words.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Costs of the channel in nats: a look-alike, a repeated letter left out, a separator left out.
SIGN_COST, REPEAT_COST, GAP_COST = 1.0, 0.7, 0.3
#: Lengths of the beginnings of words, and how many words of one beginning are told apart.
PREFIXES, FAMILY = (3, 4, 5, 6, 7, 8), 3

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(LOOK_ALIKES))
_GAPS = r".\-_*~"
_DISGUISED = re.compile(rf"[^\W\d_][{_SIGNS}{_GAPS}]+[^\W\d_]|(?<![{_SIGNS}\w])[{_SIGNS}][^\W\d_]{{2}}|([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)[^\W_](?: [^\W_]){3,}(?!\S)")


class Letters:
    """Character trigram model over words, with boundaries as spaces, mixed with its bigrams and single letters."""

    def __init__(self, counts: dict[str, int]):
        self.three = counts
        self.two, self.one, self.context, self.before = Counter(), Counter(), Counter(), Counter()
        for gram, n in counts.items():
            self.two[gram[1:]] += n
            self.one[gram[2]] += n
            self.context[gram[:2]] += n
            self.before[gram[1]] += n
        self.total = max(1, sum(self.one.values()))
        self.known: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        c = self.known.get(gram)
        if c is None:
            p = 1e-6 + 0.1 * self.one[gram[2]] / self.total
            p += 0.3 * self.two[gram[1:]] / max(1, self.before[gram[1]]) + 0.6 * self.three.get(gram, 0) / max(1, self.context[gram[:2]])
            c = self.known[gram] = -math.log(p)
        return c


def restore(piece: str, letters: Letters) -> str:
    """The likeliest words behind a lower-case piece, by Viterbi over its lattice."""
    best: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
    before = ""
    for c in piece:
        options: list[tuple[str, float]] = [(x, SIGN_COST) for x in LOOK_ALIKES.get(c, "")]
        if _WORD.fullmatch(c):
            options = [(c, 0.0)]
        elif not options:
            options = [("", GAP_COST)]
        if c == before and options[0][0]:
            options.append(("", REPEAT_COST))
        before = c
        nxt: dict[str, tuple[float, tuple]] = {}
        for state, (cost, path) in best.items():
            for letter, extra in options:
                to = state[1] + letter if letter else state
                total = cost + extra + (letters.cost(state + letter) if letter else 0.0)
                if to not in nxt or total < nxt[to][0]:
                    nxt[to] = (total, (path, letter) if letter else path)
        best = nxt
    _, path = min((cost + letters.cost(state + " "), path) for state, (cost, path) in best.items())
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def words(piece: str, letters: Letters) -> list[str]:
    """Words of a lower-case piece as they are, and as restored if it looks disguised."""
    found = _WORD.findall(piece)
    if _DISGUISED.search(piece):
        found.append(restore(piece.strip("\"'.,;:?#%&"), letters))
    return found


def all_words(text: str, letters: Letters, kept: Kept | None = None) -> set[str]:
    text = text.lower()
    get = kept.__getitem__ if kept is not None else lambda p: words(p, letters)
    found = {w for p in set(text.split()) for w in get(p)}
    return found | {restore(m.replace(" ", ""), letters) for m in _SPACED.findall(text)}


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if len(word) > n]


def features(found: set[str]) -> list[str]:
    """Of a text with these words: word$, and beginning+k for k = 1 to FAMILY, if at least k of its words begin so."""
    families = Counter(p for w in found for p in beginnings(w))
    return [*(w + "$" for w in found), *(f"{p}+{k}" for p, n in families.items() for k in range(1, min(n, FAMILY) + 1))]


@dataclass
class Model:
    """letters: trigram counts of the training words; weights by feature; bias: log odds of a text without any."""

    letters: dict[str, int] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.6


def train(hits: list[list[int]], toxic: list[int], clean: list[int], size: int, *, ridge: float = 0.1, rounds: int = 400, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights >= 0 and the bias of a logistic scorer, by full-batch gradient steps with step sizes of their own.

    Texts with equal features are one row, with how many of them are toxic and how many clean.
    """
    y, all_ = np.array(toxic, float), np.array(toxic, float) + np.array(clean, float)
    at, slot = np.repeat(np.arange(len(hits)), [len(x) for x in hits]), np.array([k for x in hits for k in x], np.int64)
    weights, seen = np.zeros(size), np.full(size, 1e-8)
    bias, seen_bias = math.log((y.sum() + 0.5) / (all_.sum() - y.sum() + 0.5)), 1e-8
    for _ in range(rounds):
        z = np.bincount(at, weights[slot], minlength=len(y)) + bias
        gap = all_ / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.bincount(slot, gap[at], minlength=size) + ridge * weights
        seen += gradient**2
        weights = np.maximum(weights - rate * gradient / np.sqrt(seen), 0)
        seen_bias += gap.sum() ** 2
        bias -= rate * gap.sum() / math.sqrt(seen_bias)
    return weights, bias


def held_out(id_col: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def _sums(rows: DataFrame, made: str, task) -> DataFrame:
    return rows.mapInArrow(task, f"{made} string, n long").groupBy(made).agg(F.sum("n").alias("n"))


def _batch(name: str, counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], [name, "n"])


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", least: int = 3, lift: float = 5.0) -> Model:
    """Learns from all labelled rows that aren't held out.

    Rows without a label, a text or an id are left aside; of several labels of one id the highest counts. Without a
    toxic row, as in an empty table, the model has no features, and every score is its bias's. What is collected is
    trigrams, features, and the different sets of chosen features that texts have, with their numbers of texts.
    """
    label = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    chosen = label.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = id_and_text(docs, id_col, text_col).dropna().filter(~held_out(F.col("doc_id")))
    known = stored(texts.join(chosen.hint("merge"), "doc_id"), "toxicity")  # labels grow with the texts: never one broadcast

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts_with = Counter(w for text in texts_of(b, "text") for w in set(_WORD.findall(text.lower())))
            counts: Counter = Counter()
            for w, n in texts_with.items():
                padded = f"  {w} "
                for i in range(len(padded) - 2):
                    counts[padded[i : i + 3]] += n
            yield _batch("gram", counts)

    letters = {r.gram: r.n for r in _sums(known, "gram", grams).collect()}
    toxic_rows = known.filter("label = 1").count()
    clean_rows = known.count() - toxic_rows
    if not toxic_rows:
        return Model(letters, {}, math.log(0.5 / (clean_rows + 1)))

    def of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        model = Letters(letters)
        kept = Kept(lambda p: words(p, model))
        for b in slices(batches):
            counts: Counter = Counter()
            for text in texts_of(b, "text"):
                counts.update(features(all_words(text, model, kept)))
            yield _batch("feature", counts)

    toxic = {r.feature: r.n for r in _sums(known.filter("label = 1"), "feature", of_toxic).filter(F.col("n") >= least).collect()}
    names = sorted(toxic)
    number = {f: i for i, f in enumerate(names)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        model = Letters(letters)
        kept = Kept(lambda p: words(p, model))
        for b in slices(batches):
            found = [sorted(number[f] for f in features(all_words(text, model, kept)) if f in number) for text in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "hits"])

    with_hits = stored(known.mapInArrow(hits, "doc_id long, label int, hits array<int>"), "toxicity")
    clean = np.zeros(len(names))
    for r in with_hits.filter("label <> 1").select(F.explode("hits").alias("k")).groupBy("k").count().collect():
        clean[r.k] = r["count"]
    often = np.array([toxic[f] for f in names]) / toxic_rows >= lift * (clean + 0.5) / max(1, clean_rows)
    place = {int(k): i for i, k in enumerate(np.flatnonzero(often))}
    if not place:
        return Model(letters, {}, math.log((toxic_rows + 0.5) / (clean_rows + 0.5)))

    def chosen_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([[place[k] for k in x if k in place] for x in b.column("hits").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "label", "hits"])

    each = with_hits.mapInArrow(chosen_only, "doc_id long, label int, hits array<int>")
    sets = each.groupBy("hits").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") != 1).alias("clean")).toArrow().to_pylist()
    sets.sort(key=lambda r: r["hits"])
    weights, bias = train([r["hits"] for r in sets], [r["toxic"] for r in sets], [r["clean"] for r in sets], len(place))
    return Model(letters, {names[k]: float(weights[i]) for k, i in place.items() if weights[i] > 0}, bias)


def scorer(model: Model) -> Callable[[str], float]:
    """A text's score; pieces that came before are kept, with what they have of the model's features."""
    letters, weights = Letters(model.letters), model.weights
    families = {f.rpartition("+")[0] for f in weights if not f.endswith("$")}

    def evidence(found: Iterable[str]) -> tuple[tuple[str, float, tuple[str, ...]], ...]:
        of_words = ((w, weights.get(w + "$", 0.0), tuple(p for p in beginnings(w) if p in families)) for w in found)
        return tuple(x for x in of_words if x[1] or x[2])

    kept = Kept(lambda p: evidence(words(p, letters)))

    def of(text: str) -> float:
        text = text.lower()
        seen = {e[0]: e for p in map(kept.__getitem__, set(text.split())) if p for e in p}
        for m in _SPACED.findall(text):
            seen.update((e[0], e) for e in evidence([restore(m.replace(" ", ""), letters)]))
        z = model.bias + sum(weight for _, weight, _ in seen.values())
        counts = Counter(p for _, _, begin in seen.values() for p in begin)
        z += sum(weights.get(f"{p}+{k}", 0.0) for p, n in counts.items() for k in range(1, min(n, FAMILY) + 1))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    return of


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold.

    Only the text decides: rows with null ids and repeated rows stay or go by it, and other columns may have any names.
    A null text counts as empty and has the score of the model's bias; a very long text is scored whole; an empty table
    gives an empty result.
    """
    run = uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        score_of = held(("scorer", run), lambda: scorer(model))
        for b in slices(batches):
            yield b.filter(pa.array([score_of(x) < threshold for x in texts_of(b, text_col)], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, in one pass without a shuffle.

    Only the text decides the score. Null and empty texts get the score of the model's bias; null ids and repeated
    rows stay, an empty table gives an empty result, and other columns of docs are left out, whatever their names.
    A very long text is scored whole; what is kept of it is its distinct pieces.
    """
    run = uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        score_of = held(("scorer", run), lambda: scorer(model))
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score_of(x) for x in texts_of(b, 1)], pa.float64())], ["doc_id", "score"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
