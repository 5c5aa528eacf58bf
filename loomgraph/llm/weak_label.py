"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation estimates how often each is
right, from the counts of vote patterns over all documents: at most 3^labellers rows, whatever the input. The posterior
of a document's pattern is its soft label. A bounded sample of documents, chosen by the hash of their ids, trains a
logistic scorer over hashed features with these labels; it scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, slices, stored, texts_of
from .stores import Kept, enter

#: Hashed features, and the documents that train the scorer (a bound, whatever the input).
DIMENSIONS, SAMPLE_ROWS = 4096, 10_000
#: Steps of the scores that the bar is chosen among.
STEPS = 10_000
BAD, NOTHING, GOOD = 0, 1, 2
LABELLERS = ("length", "symbols", "capitals", "stutter", "variety", "word_length", "lines", "letters")
_UPPER, _LOWER, _OTHER, _DIGIT, _SYMBOL, _SPACE, _MARK = range(7)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[:128] = _MARK
    for chars, kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("abcdefghijklmnopqrstuvwxyz", _LOWER), ("0123456789", _DIGIT), ("#*$%&|<>", _SYMBOL), (" \t\n\v\f\r", _SPACE)):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


_KINDS = _byte_kinds()


def measures(text: str) -> dict[str, float]:
    words = text.split()
    n = len(words)
    kinds = np.bincount(_KINDS[np.frombuffer(text.encode(), np.uint8)], minlength=7)
    letters = max(1, kinds[_UPPER] + kinds[_LOWER] + kinds[_OTHER])
    lines = [x for x in text.split("\n") if x.strip()]
    visible = max(1, kinds.sum() - kinds[_SPACE])
    return {
        "words": n,
        "symbols": kinds[_SYMBOL] / max(1, n),
        "capitals": kinds[_UPPER] / letters,
        "stutter": sum(map(eq, words, words[1:])) / max(1, n),
        "variety": len(set(words)) / max(1, n),
        "word_length": sum(map(len, words)) / max(1, n),
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "letters": (visible - kinds[_SYMBOL] - kinds[_DIGIT] - kinds[_MARK]) / visible,
    }


def votes(m: dict[str, float]) -> list[int]:
    """One of BAD, NOTHING, GOOD for each labeller."""

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else NOTHING

    n = m["words"]
    return [
        vote(n < 10, n >= 20),
        vote(m["symbols"] > 0.3, m["symbols"] < 0.1),
        vote(m["capitals"] > 0.4, m["capitals"] < 0.15),
        vote(m["stutter"] > 0.2, m["stutter"] < 0.05),
        vote(n >= 20 and m["variety"] < 0.3, m["variety"] > 0.45 or n > 2000),
        vote(not 2.5 <= m["word_length"] <= 15, 3.5 <= m["word_length"] <= 10),
        vote(m["lines"] > 0.5, m["lines"] < 0.3),
        vote(m["letters"] < 0.75, m["letters"] > 0.85),
    ]


def pattern_of(found: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(found))


def expectation_maximisation(patterns: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior chance of good by pattern, each labeller's chances of its votes by class [class, labeller, vote], share of good.

    Starts from the share of good votes among those cast. A mild prior holds that labellers are right more often than
    wrong, so the classes can't swap.
    """
    keys = np.array(sorted(patterns), dtype=np.int64)
    counts = np.array([patterns[int(k)] for k in keys], dtype=float)
    table = np.stack([keys // 3**k % 3 for k in range(labellers)], axis=1) if len(keys) else np.zeros((0, labellers), np.int64)
    good, bad = (table == GOOD).sum(1), (table == BAD).sum(1)
    post = np.clip((good + 1) / (good + bad + 2) - 0.15 * bad, 0.01, 0.99)
    scale = max(1.0, counts.sum() * 0.002)
    prior = np.array([[4.0, 2.0, 2.0], [0.5, 2.0, 8.0]])[:, None, :] * scale / 4
    chances, share = np.zeros((2, labellers, 3)), 0.5
    for _ in range(rounds if len(keys) else 0):
        weight = np.stack([counts * (1 - post), counts * post])
        for v in (BAD, NOTHING, GOOD):
            chances[:, :, v] = weight @ (table == v)
        chances += prior
        chances /= chances.sum(2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        log = np.log(chances)
        score = sum(log[:, k, table[:, k]] for k in range(labellers)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return {int(k): float(p) for k, p in zip(keys, post, strict=True)}, chances, float(share)


_RUNS = re.compile(r"(.)\1+")


def _slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode()) % DIMENSIONS


def _shape(word: str) -> str:
    """Letters as x or X, digits as 9, runs as one, other signs as they are."""
    return _RUNS.sub(r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word))


def word_slots(word: str) -> tuple[int, ...]:
    shape = _shape(word)
    return _slot("shape " + shape), _slot("end " + shape[-1:]), _slot(f"length {min(len(word), 20)}")


def whole_slots(m: dict[str, float]) -> list[int]:
    """Coarse steps of the measures, as features."""
    steps = {"words": np.log2(1 + m["words"]), **{k: 10 * m[k] for k in ("symbols", "capitals", "stutter", "variety", "lines", "letters")}, "word_length": m["word_length"]}
    return [_slot(f"{k} {min(int(v), 20)}") for k, v in steps.items()]


def vector(text: str, m: dict[str, float], slots: Kept) -> dict[int, float]:
    words = Counter(text.split())
    n = max(1, sum(words.values()))
    out: Counter = Counter(whole_slots(m))
    for w, c in words.items():
        for s in slots[w]:
            out[s] += c / n
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float


def train(rows: list[tuple[list[int], list[float], float]], rounds: int = 200, rate: float = 0.5, ridge: float = 1e-4) -> Scorer:
    """Logistic regression by full-batch gradient steps with per-feature step sizes."""
    weights, bias, seen = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-6)
    if not rows:
        return Scorer(weights, bias)
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    slot, value = np.concatenate([np.array(r[0], np.int64) for r in rows]), np.concatenate([np.array(r[1]) for r in rows])
    target = np.array([r[2] for r in rows])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, value * weights[slot], minlength=len(rows)) + bias, -30, 30)))
        gap = p - target
        grad = np.bincount(slot, value * gap[at], minlength=DIMENSIONS) / len(rows) + ridge * weights
        seen += grad**2
        weights -= rate * grad / np.sqrt(seen)
        bias -= rate * gap.mean()
    return Scorer(weights, bias)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Scorer, DataFrame, float]:
    """The scorer, every row's doc_id, pattern and posterior, and the estimated share of good rows. All rows' votes are counted.

    sample_rows documents train the scorer: the ids first by hash, of repeated ids the least text. Null texts count as
    empty; rows without an id vote but don't train.
    """
    rows = id_and_text(docs, id_col, text_col)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pattern_of(votes(measures(x))) for x in texts_of(b, 1)], pa.int64())], ["doc_id", "pattern"])

    voted = stored(rows.mapInArrow(vote, "doc_id long, pattern long"), "votes")
    posterior, _, share = expectation_maximisation({r.pattern: r["count"] for r in voted.groupBy("pattern").count().collect()})
    chosen = rows.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("weak_label")
        slots = Kept(word_slots)
        for b in slices(batches):
            made = []
            for text in texts_of(b, 1):
                m = measures(text)
                x = vector(text, m, slots)
                made.append((list(x), list(x.values()), posterior.get(pattern_of(votes(m)), 0.5)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in made], pa.list_(pa.int32())), pa.array([x[1] for x in made], pa.list_(pa.float32())), pa.array([x[2] for x in made], pa.float64())], ["doc_id", "slots", "shares", "label"])

    gathered = sample.mapInArrow(features, "doc_id long, slots array<int>, shares array<float>, label double").collect()
    scorer = train([(r.slots, r.shares, r.label) for r in sorted(gathered, key=lambda r: r.doc_id)])
    by_pattern = docs.sparkSession.createDataFrame([*posterior.items()] or [(0, 0.5)], "pattern long, posterior double")
    return scorer, voted.join(F.broadcast(by_pattern), "pattern").select("doc_id", "pattern", "posterior"), share


def score(docs: DataFrame, scorer: Scorer, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (chance of good) for every row, in one pass without a shuffle.

    A null text counts as empty, a very long one is scored whole; null ids and repeated rows stay, an empty table gives
    an empty result, and other columns of docs are left out, whatever their names.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("weak_label")
        weights = scorer.weights
        worth = Kept(lambda w: float(weights[list(word_slots(w))].sum()))
        for b in slices(batches):
            scores = []
            for text in texts_of(b, 1):
                words = text.split()
                z = scorer.bias + sum(map(worth.__getitem__, words)) / max(1, len(words)) + float(weights[whole_slots(measures(text))].sum())
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(task, "doc_id long, score double")


def bar(scored: DataFrame, share: float) -> float:
    """The score from which on rows are kept, so that they are the estimated share of good ones, to a step of 1 / STEPS.

    Scores are counted by step, at most STEPS + 1 rows; the highest step is taken whose rows and those above reach the
    share.
    """
    counts = {r.step: r["count"] for r in scored.groupBy(F.floor(F.col("score") * STEPS).alias("step")).count().collect()}
    wanted, above = share * sum(counts.values()), 0
    for step in sorted(counts, reverse=True):
        above += counts[step]
        if above >= wanted:
            return step / STEPS
    return 0.0


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (chance of good) and kept for every row: fit(), score(), and the bar that the estimated share of good sets.

    Null ids and repeated rows stay as they are; an empty table gives an empty result. A very long text is measured and
    scored whole.
    """
    scorer, _, share = fit(docs, id_col=id_col, text_col=text_col)
    scored = stored(score(docs, scorer, id_col=id_col, text_col=text_col), "scores")
    return scored.withColumn("kept", F.floor(F.col("score") * STEPS) >= F.lit(round(bar(scored, share) * STEPS)))
