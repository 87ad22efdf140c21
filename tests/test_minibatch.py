"""Cuts, pads and dense batches against plain loops over small arrays."""

from __future__ import annotations

import hashlib
from math import ceil, floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import minibatch, runs

BOXES = "array<struct<x1:double,y1:double,x2:double,y2:double,class:int>>"


def choose(low, high, image):
    return low + int(hashlib.md5(f"7-{image}".encode()).hexdigest()[:12], 16) % max(high - low, 1)


def start(first, last, trim, length, image):
    if first == 0:
        return 0
    region = last - first + 1
    if region < trim:
        low, high = max(last - trim, 0), min(first, length - trim)
        return low if low == high else choose(low, high, image)
    spare = (region - trim) // 2
    return first if spare == 0 else choose(first, first + spare, image)


def plain(image, w, h, ratio, crop, boxes, pixels, most):
    boxes = [list(b) for b in boxes or []]
    first, last = ((int(f(b[k] for b in boxes)) if boxes else 0 for f, k in pair) for pair in (((min, 0), (min, 1)), ((max, 2), (max, 3))))
    (fx, fy), (lx, ly) = first, last
    top = left = 0
    data = pixels
    if crop and ratio < 1:
        trim = min(floor(w / ratio), h)
        top = start(fy, ly, trim, h, image)
        data = data[top : top + trim]
        for b in boxes:
            b[1], b[3] = (min(max(b[k] - top, 0), trim - 1) for k in (1, 3))
    elif crop:
        trim = min(ceil(h * ratio), w)
        left = start(fx, lx, trim, w, image)
        data = data[:, left : left + trim]
        for b in boxes:
            b[0], b[2] = (min(max(b[k] - left, 0), trim - 1) for k in (0, 2))
    if ratio < 1:
        out = np.zeros((ceil(w / ratio), w, 3), np.float32)
    elif ratio > 1:
        out = np.zeros((h, ceil(h * ratio), 3), np.float32)
    else:
        t = min(w, h)
        out, data = np.zeros((t, t, 3), np.float32), data[:t, :t]
        boxes = [[min(max(v, 0), t) for v in b[:4]] + b[4:] for b in boxes]
    data = data[: out.shape[0], : out.shape[1]]
    out[: data.shape[0], : data.shape[1]] = data
    kept = [tuple(b) for b in boxes if not (b[2] - b[0] < 10 and b[3] - b[1] < 10)]
    return out, kept


def test_batches(spark):
    rng = np.random.default_rng(9)
    rows, pixels = [], {}
    for i in range(60):
        w, h = (int(v) for v in rng.integers(8, 40, 2))
        if i % 3 == 0:
            w, h = (w * 4, h) if i % 2 else (w, h * 4)
        boxes = [(float(x), float(y), float(x + rng.integers(1, w)), float(y + rng.integers(1, h)), int(k)) for k, (x, y) in enumerate(zip(rng.integers(0, w, 5), rng.integers(0, h, 5), strict=True))][: int(rng.integers(0, 6))]
        pixels[i] = rng.normal(size=(h, w, 3)).astype(np.float32)
        rows.append((i, w, h, boxes if i % 11 else None, pixels[i].tobytes()))
    df = spark.createDataFrame(rows, f"image_id long, width int, height int, boxes {BOXES}, pixels binary").repartition(3)
    shaped = runs.batches_by_shape(df, 4)
    out = minibatch.geometry(shaped, most=4)
    expected, seen = {}, set()
    for r, s in zip(sorted(out.collect(), key=lambda r: r.image_id), sorted(shaped.collect(), key=lambda r: r.image_id), strict=True):
        want, kept = plain(s.image_id, s.width, s.height, s.target_ratio, s.need_crop, s.boxes, pixels[s.image_id], 4)
        assert (r.out_height, r.out_width) == want.shape[:2]
        assert len(r.boxes) == 4 and r.n_boxes == min(4, len(kept)) and {tuple(b) for b in r.boxes[: r.n_boxes]} <= set(kept) and all(tuple(b) == (0, 0, 0, 0, 0) for b in r.boxes[r.n_boxes :])
        if len(kept) <= 4:
            assert sorted(tuple(b) for b in r.boxes[: r.n_boxes]) == sorted(kept)
        expected.setdefault(r.batch, {})[r.image_id] = want
        seen.add((s.need_crop, s.target_ratio < 1, s.target_ratio == 1))
    assert len(seen) >= 5
    for r in minibatch.dense(out).collect():
        blob = np.frombuffer(r.blob, np.float32).reshape(r.shape)
        images = expected.pop(r.batch)
        assert r.image_ids == sorted(images) and r.shape[:2] == [len(images), 3]
        for got, i in zip(blob, r.image_ids, strict=True):
            h, w, _ = images[i].shape
            assert np.array_equal(got[:, :h, :w].transpose(1, 2, 0), images[i]) and not got[:, h:].any() and not got[:, :, w:].any()
    assert not expected
    with pytest.raises(Exception, match="no pixels of its size"):
        minibatch.dense(out.withColumn("pixels", F.lit(b"abc"))).collect()
    assert minibatch.dense(out.where("false")).count() == 0
