"""Box geometry as Column expressions, so that it stays within whole-stage codegen.

A ``Box`` holds four columns. Conventions of overlap differ and are named: ``iou`` is exclusive (width x2 - x1), ``iou_pixels``
counts both edges (+1), ``iou_xywh`` is for boxes given by corner and size and knows crowd regions, ``coverage`` divides the
intersection by the query box alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "bbox_") -> Box:
    """The box in columns {prefix}x1, {prefix}y1, {prefix}x2, {prefix}y2."""
    return Box(*(F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2")))


def _zero(c: Column) -> Column:
    return F.greatest(c.cast("double"), F.lit(0.0))


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    return _zero(width(b)) * _zero(height(b))


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def intersection(a: Box, b: Box, edge: int = 0) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1) + edge
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1) + edge
    return _zero(w) * _zero(h)


def iou(a: Box, b: Box) -> Column:
    """Exclusive; 0 without overlap or with an empty union."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def _pixels(b: Box) -> Column:
    return (width(b) + 1).cast("double") * (height(b) + 1)


def iou_pixels(a: Box, b: Box) -> Column:
    inter = intersection(a, b, 1)
    return inter / (_pixels(a) + _pixels(b) - inter)


def iou_pixels_masked(anchor: Box, truth: Box) -> Column:
    """Batch form: an empty (1 x 1) truth overlaps nothing, an empty anchor gets -1."""
    empty = lambda b: (width(b) + 1 == 1) & (height(b) + 1 == 1)
    return F.when(empty(anchor), -1.0).when(empty(truth), 0.0).otherwise(iou_pixels(anchor, truth))


def coverage(a: Box, query: Box) -> Column:
    return intersection(a, query, 1) / _pixels(query)


def iou_xywh(dt: Box, gt: Box, crowd: Column) -> Column:
    """Boxes as (x, y, width, height); against a crowd the union is the detection's own area."""
    w = _zero(F.least(dt.x1 + dt.x2, gt.x1 + gt.x2) - F.greatest(dt.x1, gt.x1))
    h = _zero(F.least(dt.y1 + dt.y2, gt.y1 + gt.y2) - F.greatest(dt.y1, gt.y1))
    own = (dt.x2 * dt.y2).cast("double")
    return F.try_divide(w * h, F.when(crowd, own).otherwise(own + gt.x2 * gt.y2 - w * h))


def centre_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def offset_distance(hand: Box, obj: Box, mag: Column, ox: Column, oy: Column) -> Column:
    """Squared distance from the object's centre to the point that the hand's offset names; null offsets count as 0."""
    (hx, hy), (cx, cy) = centre(hand), centre(obj)
    far = F.coalesce(mag, F.lit(0.0)) * 10000
    dx, dy = cx - (hx + far * F.coalesce(ox, F.lit(0.0))), cy - (hy + far * F.coalesce(oy, F.lit(0.0)))
    return dx * dx + dy * dy


def aspect_ratio(b: Box) -> Column:
    return width(b) / F.greatest(height(b).cast("double"), F.lit(1e-6))


def valid(b: Box) -> Column:
    return (b.x2 > b.x1) & (b.y2 > b.y1)


def _within(c: Column, most: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(c.cast("double"), most.cast("double")))


def clip(b: Box, w: Column, h: Column, last: int = 0) -> Box:
    """Upper left within the last pixel, lower right within ``last`` pixels of the frame's size (1: all corners on pixels)."""
    return Box(_within(b.x1, w - 1), _within(b.y1, h - 1), _within(b.x2, w - last), _within(b.y2, h - last))


def encode(b: Box, target: Box) -> tuple[Column, Column, Column, Column]:
    """Regression of ``target`` from ``b``: dx, dy, log dw, log dh (+1 widths)."""
    w, h, tw, th = width(b) + 1.0, height(b) + 1.0, width(target) + 1.0, height(target) + 1.0
    cx, cy, tx, ty = b.x1 + 0.5 * w, b.y1 + 0.5 * h, target.x1 + 0.5 * tw, target.y1 + 0.5 * th
    return (tx - cx) / w, (ty - cy) / h, F.log(tw / w), F.log(th / h)


def decode(b: Box, dx: Column, dy: Column, dw: Column, dh: Column) -> Box:
    w, h = width(b) + 1.0, height(b) + 1.0
    cx, cy = dx * w + (b.x1 + 0.5 * w), dy * h + (b.y1 + 0.5 * h)
    pw, ph = F.exp(dw) * w, F.exp(dh) * h
    return Box(cx - 0.5 * pw, cy - 0.5 * ph, cx + 0.5 * pw, cy + 0.5 * ph)


def to_xywh(b: Box, edge: int = 0) -> Box:
    return Box(b.x1, b.y1, width(b) + edge, height(b) + edge)


def to_xyxy(b: Box, edge: int = 0) -> Box:
    return Box(b.x1, b.y1, b.x1 + b.x2 - edge, b.y1 + b.y2 - edge)


def flip(b: Box, w: Column) -> Box:
    """Mirrored left to right in a frame of width w."""
    return Box(w - b.x2 - 1, b.y1, w - b.x1 - 1, b.y2)


def moved_on(before: Box, last: Box) -> Box:
    """The last box moved on by its centre's latest step, its size kept; the last box itself where there is none before."""
    step = lambda a, b: F.coalesce(((b[0] + b[1]) - (a[0] + a[1])) / 2, F.lit(0.0))
    dx, dy = step((before.x1, before.x2), (last.x1, last.x2)), step((before.y1, before.y2), (last.y1, last.y2))
    return Box(last.x1 + dx, last.y1 + dy, last.x2 + dx, last.y2 + dy)


def enlarge(b: Box, ratio: float, im_height: Column, im_width: Column) -> Box:
    """Grown by ``ratio`` about its centre. Known quirk, kept: x is clamped by the height, y by the width."""
    (cx, cy), w, h = centre(b), width(b) * ratio, height(b) * ratio
    return Box(F.greatest(cx - w / 2, F.lit(0.0)), F.greatest(cy - h / 2, F.lit(0.0)), F.least(cx + w / 2, im_height - 1.0), F.least(cy + h / 2, im_width - 1.0))


def centre_crop(w: Column, h: Column, crop_w: int, crop_h: int) -> Box:
    """The crop's box; a frame that is smaller is an error."""
    small = (w < crop_w) | (h < crop_h)
    x = F.when(small, F.raise_error(F.lit("frame is smaller than the crop"))).otherwise(F.floor((w - crop_w) / 2))
    y = F.floor((h - crop_h) / 2)
    return Box(x, y, x + crop_w, y + crop_h)
