"""Features of regions from feature maps: bilinear alignment and maximum pooling.

Maps and regions are dealt by image; a map comes to a task before its regions, which pass by in Arrow batches: a task holds one map
and one batch. An image with very many regions is dealt in parts, and its map once to each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import shuffle_partitions

#: Regions of one image that one task pools, and values that are gathered at once.
TOGETHER, VALUES = 50_000, 1 << 21


def _samples(begin: np.ndarray, length: np.ndarray, size: int, grid: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each region's ``size * grid`` sample places along one axis: lower and upper neighbour, their weights, and whether inside."""
    step = length / size
    at = begin[:, None] + (np.arange(size).repeat(grid) + (np.tile(np.arange(grid), size) + 0.5) / grid) * step[:, None]
    inside = (at >= -1) & (at <= limit)
    at = np.maximum(at, 0)
    low = np.minimum(at.astype(np.int64), limit - 1)
    last = low >= limit - 1
    high = np.where(last, limit - 1, low + 1)
    part = np.where(last, 0.0, at - low)
    return low, high, 1 - part, part, inside


def align(features: np.ndarray, rois: np.ndarray, size: tuple[int, int], scale: float, sampling: int) -> np.ndarray:
    """(n, channels, height, width) of each region (x1, y1, x2, y2): means over bilinear samples, ``sampling`` a bin and axis (0: as many as a bin has cells)."""
    channels, height, width = features.shape
    out = np.zeros((len(rois), channels, *size))
    box = rois * scale
    wide, high = np.maximum(box[:, 2] - box[:, 0], 1), np.maximum(box[:, 3] - box[:, 1], 1)
    grid_y, grid_x = (np.full(len(rois), sampling) if sampling > 0 else np.ceil(x / s).astype(int) for x, s in ((high, size[0]), (wide, size[1])))
    for gy, gx in sorted(set(zip(grid_y.tolist(), grid_x.tolist(), strict=True))):
        of = np.flatnonzero((grid_y == gy) & (grid_x == gx))
        most = max(1, VALUES // (channels * size[0] * size[1] * gy * gx))
        for i in range(0, len(of), most):
            part = of[i : i + most]
            y0, y1, wy0, wy1, in_y = _samples(box[part, 1], high[part], size[0], gy, height)
            x0, x1, wx0, wx1, in_x = _samples(box[part, 0], wide[part], size[1], gx, width)
            take = lambda y, x: features[:, y[:, :, None], x[:, None, :]]
            value = wy0[:, :, None] * (wx0[:, None] * take(y0, x0) + wx1[:, None] * take(y0, x1)) + wy1[:, :, None] * (wx0[:, None] * take(y1, x0) + wx1[:, None] * take(y1, x1))
            value = value * (in_y[:, :, None] & in_x[:, None])
            out[part] = value.reshape(channels, len(part), size[0], gy, size[1], gx).mean(axis=(3, 5)).transpose(1, 0, 2, 3)
    return out


def _half_up(x: np.ndarray) -> np.ndarray:
    """Rounded, halves away from zero."""
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


def pool(features: np.ndarray, rois: np.ndarray, size: tuple[int, int], scale: float, _: int = 0) -> np.ndarray:
    """(n, channels, height, width) of each region: the greatest value of the cells of each bin, 0 for a bin without cells."""
    channels, height, width = features.shape
    out = np.zeros((len(rois), channels, *size))
    box = _half_up(rois * scale)
    for n, (x1, y1, x2, y2) in enumerate(box.tolist()):
        edges = []
        for low, high, k, limit in ((y1, y2, size[0], height), (x1, x2, size[1], width)):
            step = max(high - low + 1, 1) / k
            begin, end = np.floor(np.arange(k) * step).astype(int), np.ceil(np.arange(1, k + 1) * step).astype(int)
            edges.append((np.clip(begin + low, 0, limit), np.clip(end + low, 0, limit)))
        for i, (a, b) in enumerate(zip(*edges[0], strict=True)):
            for j, (c, d) in enumerate(zip(*edges[1], strict=True)):
                if a < b and c < d:
                    out[n, :, i, j] = features[:, a:b, c:d].max(axis=(1, 2))
    return out


def region_features(maps: DataFrame, rois: DataFrame, size: tuple[int, int] = (7, 7), scale: float = 1 / 16, kind: str = "align", sampling: int = 0) -> DataFrame:
    """(image_id, roi_id, pooled) of ``rois`` (image_id, roi_id, x1, y1, x2, y2) in ``maps`` (image_id, channels, height, width,
    features: values by channel, row and column). ``pooled`` has channels x height x width values.

    A region of an image without a map, or with a corner that is null, has a null; an image's map must be one row (of several the
    last that comes counts). Null image_ids meet nothing. Regions that repeat are pooled each.
    """
    if kind not in ("align", "max"):
        raise ValueError(f"unknown pooling {kind!r}")
    pooled: Callable[..., np.ndarray] = align if kind == "align" else pool
    corners = ("x1", "y1", "x2", "y2")
    counts = rois.groupBy("image_id").agg(F.count("*").alias("n")).select("image_id", F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts"))
    none = lambda kind: F.lit(None).cast(kind)
    m = maps.join(counts, "image_id").select("image_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("late"), none("bigint").alias("roi_id"), *[none("double").alias(c) for c in corners], F.array(*[F.col(c).cast("bigint") for c in ("channels", "height", "width")]).alias("shape"), F.col("features").cast("array<double>").alias("features"))
    part = F.pmod(F.xxhash64("roi_id", *corners), F.col("parts")).cast("int")
    of = counts.withColumnRenamed("image_id", "of_image")
    known = rois.join(of, rois["image_id"].eqNullSafe(of["of_image"])).drop("of_image")
    r = known.select("image_id", part.alias("part"), F.lit(1).alias("late"), F.col("roi_id").cast("bigint"), *[F.col(c).cast("double").alias(c) for c in corners], none("array<bigint>").alias("shape"), none("array<double>").alias("features"))
    id_type = r.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            ids, parts, late = (batch.column(c).to_pylist() for c in ("image_id", "part", "late"))
            for (key, is_roi), rows in groupby(range(batch.num_rows), key=lambda i: ((ids[i], parts[i]), late[i])):
                rows = list(rows)
                if key != at:
                    at, held = key, None
                if not is_roi:
                    held = np.array(batch.column("features")[rows[-1]].as_py(), float).reshape(batch.column("shape")[rows[-1]].as_py())
                    continue
                some = batch.slice(rows[0], len(rows))
                box = np.stack([some.column(c).to_numpy(zero_copy_only=False).astype(float) for c in corners], axis=1)
                good = ~np.isnan(box).any(axis=1)
                out: list = [None] * len(rows)
                if held is not None and held.size and key[0] is not None:
                    for i, v in zip(np.flatnonzero(good).tolist(), pooled(held, box[good], size, scale, sampling).reshape(int(good.sum()), -1), strict=True):
                        out[i] = v
                yield pa.RecordBatch.from_arrays([some.column("image_id"), some.column("roi_id"), pa.array(out, pa.list_(pa.float64()))], names=["image_id", "roi_id", "pooled"])

    dealt = m.unionByName(r).repartition(shuffle_partitions(rois.sparkSession), "image_id", "part").sortWithinPartitions("image_id", "part", "late", "roi_id")
    return dealt.mapInArrow(run, f"image_id {id_type}, roi_id bigint, pooled array<double>")
