"""Masks as columns against pixels."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from holdfast.functions import masks


def drawn(corners, h, w):
    """Pixels of a polygon: points densely along its edges, sides changed where they cross a column's middle."""
    n = len(corners)
    x, y = ([int(5 * c[k] + 0.5) for c in corners] for k in (0, 1))
    flips = np.zeros(h * w + 1, int)
    for i in range(n):
        a, b = (x[i], y[i]), (x[(i + 1) % n], y[(i + 1) % n])
        flat = abs(b[0] - a[0]) >= abs(b[1] - a[1])
        if a[not flat] > b[not flat]:
            a, b = b, a
        long = b[not flat] - a[not flat]
        slope = (b[flat] - a[flat]) / long if long else 0
        points = [(t, int(a[flat] + slope * t + 0.5)) for t in range(long + 1)]
        points = [(a[0] + t, v) if flat else (v, a[1] + t) for t, v in points]
        for (u0, v0), (u1, v1) in zip(points, points[1:], strict=False):
            m = min(u0, u1)
            if u0 != u1 and m % 5 == 2 and 0 <= (m - 2) // 5 < w:
                flips[(m - 2) // 5 * h + min(h, max(0, -(-(min(v0, v1) - 2) // 5)))] += 1
    return (np.cumsum(flips)[:-1] % 2).reshape((h, w), order="F")


def test_polygons(spark):
    rng = random.Random(6)
    shapes = []
    for i in range(300):
        h, w, n = rng.randint(1, 30), rng.randint(1, 30), rng.choice([1, 2, 3, 4, 4, 7])
        low, high = (-10, 40) if i % 2 else (0, 25)
        shapes.append((i, h, w, [(rng.uniform(low, high), rng.uniform(low, high)) if i % 3 else (float(rng.randint(low, high)), float(rng.randint(low, high))) for _ in range(n)]))
    df = spark.createDataFrame(shapes, "i int, h int, w int, c array<struct<x:double,y:double>>").repartition(3)
    got = {r.i: r.m for r in df.select("i", masks.polygon(F.col("c"), F.col("h"), F.col("w")).alias("m")).collect()}
    for i, h, w, corners in shapes:
        assert got[i] == masks.encode(drawn(corners, h, w)), (i, corners)
    assert sum(len(m) > 1 for m in got.values()) > 100


def test_merges_overlaps_and_boxes(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        h, w = rng.integers(1, 9, 2)
        some = [(rng.random((h, w)) < p) for p in (0.5, rng.choice([0, 0.2, 0.9, 1]), 0.7)]
        counts = [masks.encode(m) for m in some]
        if i % 5 == 0:  # runs of length 0 in between
            counts[0] = counts[0][:1] + [0, 0] + counts[0][1:]
        rows.append((i, int(h), *counts, some))
    df = spark.createDataFrame([r[:5] for r in rows], "i int, h int, a array<int>, b array<int>, c array<int>").repartition(3)
    a, b, c = (F.col(k) for k in "abc")
    out = df.select("i", masks.merged(a, b).alias("u"), masks.merged(a, b, True).alias("n"), masks.merged_all(F.array("a", "b", "c")).alias("all"), masks.merged_all(F.array("c"), True).alias("one"), masks.overlap(a, b).alias("o"), masks.overlap(a, b, F.lit(True)).alias("crowd"), masks.box(b, F.col("h"), True).alias("box"))
    for r in out.collect():
        _, h, _, _, cc, (x, y, z) = rows[r.i]
        assert r.u == masks.encode(x | y) and r.n == masks.encode(x & y) and r.all == masks.encode(x | y | z) and r.one == cc
        shared = (x & y).sum()
        assert abs(r.o - shared / max(1, (x | y).sum())) < 1e-12 and abs(r.crowd - shared / max(1, x.sum())) < 1e-12
        ys, xs = np.nonzero(y)
        assert tuple(r.box) == ((xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1) if len(xs) else (0, 0, 0, 0))


def test_boxes_by_the_ends_of_runs(spark):
    rows = [([2, 4, 2], 4), ([], 4), ([7], 4), ([0, 3], 3), ([5, 0, 3], 4), (None, 4)]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "m array<int>, h int").coalesce(1).select(masks.box(F.col("m"), F.col("h"))).collect()]
    assert got == [(0, 1, 2, 2), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 1, 3), (1, 0, 1, 2), None]
    odd = spark.createDataFrame([([3], [2, 2]), (None, [3]), ([], [])], "a array<int>, b array<int>").coalesce(1)
    assert [(r.u, r.o) for r in odd.select(masks.merged(F.col("a"), F.col("b")).alias("u"), masks.overlap(F.col("a"), F.col("b")).alias("o")).collect()] == [(None, None), (None, None), ([], 0.0)]


def test_polygons_are_folded_by_batches(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(0, square, 6), (1, None, 6), (2, square, None), (3, [], 6), (4, [(0.0, 0.0), (None, 1.0), (4.0, 4.0)], 6)], "i int, c array<struct<x:double,y:double>>, h int")
    out = df.select("i", masks.polygon(F.col("c"), F.col("h"), F.lit(5)).alias("m"))
    shown = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in shown and "lambdafunction" not in shown
    assert {r.i: r.m for r in out.collect()} == {0: masks.encode(drawn(square, 6, 5)), 1: None, 2: None, 3: [30], 4: None}
