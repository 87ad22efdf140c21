"""Losses, fits and pooling against numpy and plain loops."""

from __future__ import annotations

from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import losses
from holdfast.operators import heads, pooling


def test_losses(spark):
    rows = [([0.5, 3.0], [0.0, 1.0], [1.0, 1.0], [1.0, 2.0], [1.0, 2.0, 900.0], 2), ([1.0], [1.0], [0.0], [1.0], [0.0, -5.0], 1), (None, [1.0], [1.0], [1.0], [1.0], 7)]
    df = spark.createDataFrame(rows, "p array<double>, t array<double>, i array<double>, o array<double>, s array<double>, y int").coalesce(1)
    p, t, i, o, s, y = (F.col(c) for c in "ptiosy")
    got = df.select(losses.smooth_l1(p, t, i, o).alias("a"), losses.smooth_l1(p, t, sigma=3.0).alias("b"), losses.cross_entropy(s, y).alias("c"), losses.softmax(s).alias("d")).collect()
    assert [r.a for r in got] == [0.125 + 2 * 1.5, 0.0, None] and got[0].b == pytest.approx((0.5 - 0.5 / 9) + (2 - 0.5 / 9))
    assert got[0].c == 0.0 and got[1].c == pytest.approx(np.log(1 + np.exp(-5)) + 5) and got[2].c is None and sum(got[1].d) == pytest.approx(1)


@pytest.mark.parametrize("kind", ["softmax", "smooth_l1"])
def test_fits_are_numpys_and_resume(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x @ rng.normal(size=(4, 3)) + rng.normal(size=(300, 3)) * 0.3)
    target = y.argmax(axis=1).tolist() if kind == "softmax" else (3 * y).tolist()
    odd = [(None, target[0]), ([1.0], target[0]), ([1.0, None, 1.0, 1.0], target[0]), ([1.0] * 4, None), ([1.0] * 4, 9 if kind == "softmax" else [1.0])]
    schema = f"features array<double>, target {'int' if kind == 'softmax' else 'array<double>'}"
    df = spark.createDataFrame(list(zip(x.tolist(), target, strict=True)) + odd, schema).repartition(3)
    chosen = heads.FitConfig(steps=12, rate=0.3, drops=(8,), every=5)
    w, v, x1 = np.zeros((3, 5)), np.zeros((3, 5)), np.column_stack([x, np.ones(300)])
    for step in range(12):
        s = x1 @ w.T
        if kind == "softmax":
            e = np.exp(s)
            g = e / e.sum(axis=1, keepdims=True) - np.eye(3)[target]
        else:
            g = np.clip(s - np.array(target), -1, 1)
        decay = 0.0005 * w
        decay[:, -1] = 0
        v = 0.9 * v + g.T @ x1 / 300 + decay
        rate = 0.3 * (0.1 if step >= 8 else 1)
        w = w - v * np.array([rate] * 4 + [2 * rate])
    whole = heads.fit(df, 4, 3, kind, chosen)
    assert np.allclose(whole.weights, w, atol=1e-9) and whole.losses[-1] < whole.losses[0]
    heads.fit(df, 4, 3, kind, heads.FitConfig(steps=5, rate=0.3, drops=(8,), every=5), f"{tmp_path}/fit")
    again = heads.fit(df, 4, 3, kind, chosen, f"{tmp_path}/fit")
    assert again.step == 12 and len(again.losses) == 12 and np.allclose(again.weights, w, atol=1e-9)
    scored = heads.scored(df.where("target is not null and size(features) = 4").limit(20), again).collect()
    assert all(np.allclose(r.scores, again.scores(np.array([r.features], float))[0]) for r in scored if None not in r.features)
    assert not heads.fit(df.where("false"), 4, 3, kind, heads.FitConfig(steps=2)).weights.any()
    with pytest.raises(ValueError, match="shape"):
        heads.fit(df, 4, 2, kind, chosen, f"{tmp_path}/fit")


def looped(f, roi, size, scale, sampling):
    c, h, w = f.shape
    x1, y1, x2, y2 = (v * scale for v in roi)
    rw, rh = max(x2 - x1, 1), max(y2 - y1, 1)
    gy, gx = (sampling, sampling) if sampling else (ceil(rh / size[0]), ceil(rw / size[1]))
    out = np.zeros((c, *size))
    for i in range(size[0]):
        for j in range(size[1]):
            for a in range(gy):
                for b in range(gx):
                    y, x = y1 + (i + (a + 0.5) / gy) * rh / size[0], x1 + (j + (b + 0.5) / gx) * rw / size[1]
                    if y < -1 or y > h or x < -1 or x > w:
                        continue
                    y, x = max(y, 0), max(x, 0)
                    yl, xl = min(int(y), h - 1), min(int(x), w - 1)
                    yh, xh = min(yl + 1, h - 1), min(xl + 1, w - 1)
                    ly, lx = (0 if yl == h - 1 else y - yl), (0 if xl == w - 1 else x - xl)
                    out[:, i, j] += ((1 - ly) * ((1 - lx) * f[:, yl, xl] + lx * f[:, yl, xh]) + ly * ((1 - lx) * f[:, yh, xl] + lx * f[:, yh, xh])) / (gy * gx)
    return out


def greatest(f, roi, size, scale):
    c, h, w = f.shape
    x1, y1, x2, y2 = (int(np.floor(abs(v * scale) + 0.5) * np.sign(v)) for v in roi)
    sh, sw = max(y2 - y1 + 1, 1) / size[0], max(x2 - x1 + 1, 1) / size[1]
    out = np.zeros((c, *size))
    for i in range(size[0]):
        for j in range(size[1]):
            ys = range(max(0, int(np.floor(i * sh)) + y1), min(h, ceil((i + 1) * sh) + y1))
            xs = range(max(0, int(np.floor(j * sw)) + x1), min(w, ceil((j + 1) * sw) + x1))
            if len(ys) and len(xs):
                out[:, i, j] = f[:, ys.start : ys.stop, xs.start : xs.stop].max(axis=(1, 2))
    return out


def test_region_features(spark, monkeypatch):
    monkeypatch.setattr(pooling, "TOGETHER", 7)
    rng = np.random.default_rng(5)
    f = {k: rng.normal(size=(2, 6 + k, 9)) for k in (1, 2)}
    maps = spark.createDataFrame([(k, *v.shape, v.ravel().tolist()) for k, v in f.items()] + [(None, 1, 1, 1, [1.0])], "image_id long, channels int, height int, width int, features array<double>")
    rois = [(int(rng.integers(1, 4)), i, *(float(v) for v in (x, y, x + rng.integers(-5, 150), y + rng.integers(0, 120)))) for i, (x, y) in enumerate(rng.integers(-40, 160, (60, 2)))]
    odd = [(None, 100, 0.0, 0.0, 5.0, 5.0), (1, 101, None, 0.0, 5.0, 5.0), (1, 102, 0.0, 0.0, 5.0, 5.0), (1, 102, 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rois + odd, "image_id long, roi_id int, x1 double, y1 double, x2 double, y2 double").repartition(3)
    for kind, sampling, size in (("align", 2, (3, 2)), ("align", 0, (2, 2)), ("max", 0, (3, 3))):
        got = pooling.region_features(maps, df, size, 1 / 16, kind, sampling).collect()
        assert len(got) == len(rois) + 4 and sum(r.roi_id == 102 for r in got) == 2
        for r in (r for r in got if r.roi_id < 100):
            image, _, *roi = rois[r.roi_id]
            expected = None if image not in f else looped(f[image], roi, size, 1 / 16, sampling) if kind == "align" else greatest(f[image], roi, size, 1 / 16)
            assert (r.pooled is None) if expected is None else np.allclose(r.pooled, expected.ravel())
        assert all(r.pooled is None for r in got if r.roi_id in (100, 101))
    assert pooling.region_features(maps, df.where("false")).count() == 0
