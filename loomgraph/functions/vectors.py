"""Vector maths, link scores, scalers and logic over arrays of numbers, in column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """A norm of 0 counts as 1."""
    safe = lambda v: F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return dot(a, b) / (safe(a) * safe(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def euclidean_likeness(a: Column, b: Column) -> Column:
    return 1 / (1 + distance(a, b))


def distmult(s: Column, r: Column, o: Column) -> Column:
    return dot(F.zip_with(doubles(s), doubles(r), lambda x, y: x * y), o)


def _halves(v: Column) -> tuple[Column, Column]:
    half = (F.size(v) / 2).cast("int")
    return F.slice(doubles(v), F.lit(1), half), F.slice(doubles(v), half + 1, half)


def complex_score(s: Column, r: Column, o: Column) -> Column:
    """Real part of <s, r, conjugate of o>; first halves real, second imaginary."""
    (sr, si), (rr, ri), (orr, oi) = map(_halves, (s, r, o))
    mul = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    return dot(mul(sr, rr), orr) + dot(mul(si, rr), oi) + dot(mul(sr, ri), oi) - dot(mul(si, ri), orr)


def rotate_score(s: Column, r: Column, o: Column) -> Column:
    """Minus the distance of s turned by the unit complex numbers r / |r| from o."""
    (sr, si), (rr, ri), (orr, oi) = map(_halves, (s, r, o))
    parts = F.transform(F.arrays_zip(sr.alias("a"), si.alias("b"), rr.alias("c"), ri.alias("d"), orr.alias("e"), oi.alias("f")), lambda z: z)

    def gap(z: Column) -> Column:
        a, b, c, d, e, f = (z[k] for k in "abcdef")
        length = F.sqrt(c * c + d * d)
        u, v = c / length, d / length
        return (a * u - b * v - e) * (a * u - b * v - e) + (a * v + b * u - f) * (a * v + b * u - f)

    return -F.sqrt(_sum(F.transform(parts, gap)))


def product_norm(*scores: Column) -> Column:
    return reduce(lambda a, b: a * b, scores)


def product_conorm(*scores: Column) -> Column:
    return 1 - reduce(lambda a, b: a * b, (1 - s for s in scores))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Into [0, 1], clamped; 0 if low and high are equal."""
    return F.when(high == low, F.lit(0.0)).otherwise(F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def standard(x: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation == 0, F.lit(0.0)).otherwise((x - mean) / deviation)


def sigmoid(x: Column, middle: Column, temperature: Column) -> Column:
    return 1 / (1 + F.exp(-(x - middle) / temperature))


def sigmoid_temperature(median: Column, epsilon: float = 1e-2, least: float = 1e-6) -> Column:
    """The temperature at which the median is mapped to 1 - epsilon; at least `least`."""
    return F.greatest(median / math.log((1 - epsilon) / epsilon), F.lit(least))


def ln_or_minus_infinity(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def multi_hot(members: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(members, i).cast("int"))
