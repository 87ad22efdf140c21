"""Losses of a detector's heads, as columns over arrays; their means are aggregates over rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smooth_l1(predicted: Column, target: Column, inside: Column | None = None, outside: Column | None = None, sigma: float = 1.0) -> Column:
    """Of a row of values: square below 1 / sigma^2, straight beyond, summed; weights of the differences and of what they give.

    Null where an array is null or has a null, or the arrays differ in length.
    """
    near = 1.0 / sigma**2

    def one(p: Column, t: Column, w: Column, o: Column) -> Column:
        d = F.abs(w * (p - t))
        return o * F.when(d < near, d * d * (sigma**2 / 2)).otherwise(d - 0.5 * near)

    ones = F.transform(predicted, lambda _: F.lit(1.0))
    zipped = F.arrays_zip(predicted.alias("p"), target.alias("t"), (ones if inside is None else inside).alias("w"), (ones if outside is None else outside).alias("o"))
    return F.aggregate(zipped, F.lit(0.0), lambda a, z: a + one(z.p, z.t, z.w, z.o))


def cross_entropy(scores: Column, label: Column) -> Column:
    """-log softmax of the label's score, from the largest score on so that nothing overflows; null for a label that isn't there."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return F.log(total) + top - F.get(scores, label.cast("int"))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return F.transform(scores, lambda s: F.exp(s - top) / total)
