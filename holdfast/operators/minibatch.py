"""Batches of images of one target ratio: what is cropped and padded by column expressions, dense arrays by Arrow batches.

``runs.batches_by_shape`` gives batch, target_ratio and need_crop; ``geometry`` says for each image where it is cut and how large it
becomes, and what becomes of its boxes; ``dense`` puts a batch's pixels together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .streams import in_order, whole_groups

#: Boxes that are smaller than this both ways after cutting go.
LEAST = 10
_long = lambda c: c.cast("bigint")


def drawn(low: Column, high: Column, seed: int, *by: str) -> Column:
    """One of low .. high - 1 by a seeded hash of the row's columns."""
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), *by).cast("binary"))
    return low + F.pmod(_long(F.conv(F.substring(key, 1, 12), 16, 10)), F.greatest(high - low, F.lit(1)))


def _start(first: Column, last: Column, trim: Column, length: Column, seed: int) -> Column:
    """Where a cut of ``trim`` begins along an axis of ``length``, so that it covers the boxes, from first to last, or a part of them."""
    region = last - first + 1
    low, high = F.greatest(last - trim, F.lit(0)), F.least(first, length - trim)
    spare = F.floor((region - trim) / 2)
    around = F.when(low == high, low).otherwise(drawn(low, high, seed, "image_id"))
    within = F.when(spare == 0, first).otherwise(drawn(first, first + spare, seed, "image_id"))
    return F.when(first == 0, 0).when(region < trim, around).otherwise(within)


def geometry(df: DataFrame, most: int = 20, seed: int = 7) -> DataFrame:
    """``df`` (image_id, width, height, target_ratio, need_crop, boxes) with left, top, cut_width, cut_height: the part that stays;
    out_width, out_height: the padded size; boxes in it, ``most`` of them, and n_boxes, how many are boxes and not padding.

    ``boxes`` are an array of (x1, y1, x2, y2, class). An image that is narrow for its batch loses height and is padded below, a
    wide one loses width and is padded on the right, at a ratio of 1 the upper left square stays. The cut covers the boxes where
    it can. Boxes come in a seeded order; those beyond ``most`` and those smaller than ``LEAST`` both ways go. An image without
    boxes is cut from 0 on.
    """
    w, h, ratio = _long(F.col("width")), _long(F.col("height")), F.col("target_ratio").cast("double")
    crop, narrow = F.coalesce("need_crop", F.lit(False)), ratio < 1
    edge = lambda pick, k: F.coalesce(_long(pick(F.transform("boxes", lambda b: b[k]))), F.lit(0).cast("bigint"))
    tall, wide = F.least(_long(F.floor(w / ratio)), h), F.least(_long(F.ceil(h * ratio)), w)
    top = F.when(crop & narrow, _start(edge(F.array_min, "y1"), edge(F.array_max, "y2"), tall, h, seed)).otherwise(0)
    left = F.when(crop & ~narrow, _start(edge(F.array_min, "x1"), edge(F.array_max, "x2"), wide, w, seed)).otherwise(0)
    square = F.least(w, h)
    out = df.withColumns({"top": _long(top), "left": _long(left)})
    cut_h, cut_w = F.when(crop & narrow, F.least(tall, h - F.col("top"))).otherwise(h), F.when(crop & ~narrow, F.least(wide, w - F.col("left"))).otherwise(w)
    even = ratio == 1
    out = out.withColumns({
        "cut_height": F.when(even, F.least(cut_h, square)).otherwise(cut_h), "cut_width": F.when(even, F.least(cut_w, square)).otherwise(cut_w),
        "out_height": F.when(narrow, _long(F.ceil(w / ratio))).when(even, square).otherwise(h), "out_width": F.when(narrow, w).when(even, square).otherwise(_long(F.ceil(h * ratio))),
    })
    limit = lambda c, some, high: F.when(some, F.greatest(F.lit(0.0), F.least(c, high.cast("double")))).otherwise(c)

    def moved(b: Column) -> Column:
        y1, y2 = (limit(b[k].cast("double") - F.col("top"), crop & narrow, tall - 1) for k in ("y1", "y2"))
        x1, x2 = (limit(b[k].cast("double") - F.col("left"), crop & ~narrow, wide - 1) for k in ("x1", "x2"))
        sides = [limit(c, even, square).alias(k) for k, c in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))]
        order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("image_id"), *[b[k] for k in ("x1", "y1", "x2", "y2", "class")]).cast("binary"))
        return F.struct(order.alias("order"), *sides, b["class"].alias("class"))

    large = F.filter(F.array_sort(F.transform(F.coalesce("boxes", F.expr("slice(boxes, 1, 0)")), moved)), lambda b: ~((b.x2 - b.x1 < LEAST) & (b.y2 - b.y1 < LEAST)))
    kept = F.slice(F.transform(large, lambda b: b.dropFields("order")), 1, most)
    nothing = F.struct(*[F.lit(0.0).alias(k) for k in ("x1", "y1", "x2", "y2")], F.lit(0).cast(_class_type(df)).alias("class"))
    out = out.withColumn("__kept", F.coalesce(kept, F.slice(F.array(nothing), 1, 0)))
    return out.withColumns({"n_boxes": F.size("__kept"), "boxes": F.concat("__kept", F.array_repeat(nothing, most - F.size("__kept")))}).drop("__kept")


def _class_type(df: DataFrame) -> str:
    return df.schema["boxes"].dataType.elementType["class"].dataType.simpleString()


DENSE = "batch bigint, image_ids array<bigint>, shape array<int>, blob binary"


def dense(df: DataFrame) -> DataFrame:
    """A row for each batch of ``geometry``'s images with their ``pixels`` (32-bit floats, by row, column and 3 channels, as binary).

    image_ids, in order; shape (images, 3, height, width); blob: 32-bit floats of that shape, cut and padded with 0. A batch is as large as
    its largest padded image. Images whose pixels are null or don't have their size are an error. A task holds one batch.
    """
    names = ["batch", "image_id", "width", "height", "left", "top", "cut_width", "cut_height", "out_width", "out_height", "pixels"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["batch"]):
            numbers = group.column("batch").to_pylist()
            edges = [0, *[i for i in range(1, len(numbers)) if numbers[i] != numbers[i - 1]], len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = group.slice(a, b - a)
                v = {c: part.column(c).to_pylist() for c in names[:-1]}
                blob = np.zeros((b - a, 3, max(v["out_height"]), max(v["out_width"])), np.float32)
                for i in range(b - a):
                    content = part.column("pixels")[i].as_py()
                    h, w, top, left, tall, wide = (v[k][i] for k in ("height", "width", "top", "left", "cut_height", "cut_width"))
                    if content is None or len(content) != h * w * 12:
                        raise ValueError(f"image {v['image_id'][i]} has no pixels of its size")
                    cut = np.frombuffer(content, np.float32).reshape(h, w, 3)[top : top + tall, left : left + wide][: blob.shape[2], : blob.shape[3]]
                    blob[i, :, : cut.shape[0], : cut.shape[1]] = cut.transpose(2, 0, 1)
                row = [[numbers[a]], [v["image_id"]], [list(blob.shape)], [blob.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["batch", "image_ids", "shape", "blob"])

    rows = df.select(*[_long(F.col(c)).alias(c) if c != "pixels" else F.col(c) for c in names])
    return in_order(rows, ["batch"], ["image_id"]).mapInArrow(run, DENSE)
