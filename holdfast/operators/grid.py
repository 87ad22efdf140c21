"""Boxes that meet, by a grid: each box is dealt to the cells that it touches, and a pair meets once, in the cell of its shared corner.

So pairs are formed of boxes that are near each other, not of all boxes of an image: rows grow with boxes and with what overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.boxes import Box

#: Length of a cell's side; a box of n cells' size is dealt to about n * n of them.
CELL = 128


def _cell(x: Column, side: float) -> Column:
    return F.floor(x / side)


def _dealt(df: DataFrame, b: Box, side: float) -> DataFrame:
    """``df`` once for each cell (__cx, __cy) that the box touches, edges included; a box without a corner or turned inside out touches none."""
    span = lambda low, high: F.when(low <= high, F.sequence(_cell(low, side), _cell(high, side)))
    return df.withColumn("__cx", F.explode(span(b.x1, b.x2))).withColumn("__cy", F.explode(span(b.y1, b.y2)))


def meeting(left: DataFrame, right: DataFrame, keys: list[str], prefixes: tuple[str, str] = ("bbox_", "gt_"), side: float = CELL, edge: int = 1) -> DataFrame:
    """Pairs of rows of one ``keys`` whose boxes share a pixel (``edge`` 1: corners are pixels) or an area (0), each pair once.

    Boxes are columns <prefix>x1 to <prefix>y2; but for ``keys`` the two frames' columns must differ. Null keys meet nothing.
    """
    a, b = boxes.box(prefixes[0]), boxes.box(prefixes[1])
    both = _dealt(left, a, side).join(_dealt(right, b, side), [*keys, "__cx", "__cy"])
    x, y = F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1)
    share = (F.least(a.x2, b.x2) - x + edge > 0) & (F.least(a.y2, b.y2) - y + edge > 0)
    return both.where((F.col("__cx") == _cell(x, side)) & (F.col("__cy") == _cell(y, side)) & share).drop("__cx", "__cy")


def side_for(df: DataFrame, prefix: str = "gt_") -> float:
    """A cell's side for few copies: four times the boxes' mean length, so that a box is dealt to some 1.6 cells; ``CELL`` at least.

    At ``CELL`` a box of that length is dealt to four, and so are both sides of a join.
    """
    b = boxes.box(prefix)
    mean = df.agg(F.avg(F.greatest(b.x2 - b.x1, b.y2 - b.y1)).cast("double")).first()[0]
    return max(float(CELL), 4.0 * mean) if mean is not None and mean < float("inf") else float(CELL)


def with_truths(regions: DataFrame, truths: DataFrame, key: str, side: float | None = None) -> DataFrame:
    """Regions with each truth of their image that they meet and the pixel overlap; and once more with the image's first truth.

    The second row has the overlap of a region that meets nothing: 0, or -1 for an empty region (see ``boxes.iou_pixels_masked``);
    without a truth in the image gt_id is null and the overlap 0. Greatest overlaps and first truths are then what all pairs give.
    """
    side = side_for(truths) if side is None else side
    pairs = meeting(regions, truths, [key], side=side).withColumn("overlap", boxes.iou_pixels_masked(boxes.box(), boxes.box("gt_")))
    first = truths.groupBy(key).agg(F.min("gt_id").alias("gt_id"))
    nothing = F.when(F.col("gt_id").isNotNull(), boxes.iou_pixels_masked(boxes.box(), Box(*[F.lit(0)] * 4))).otherwise(0.0)
    alone = regions.join(first, key, "left").withColumn("overlap", nothing)
    return pairs.unionByName(alone, allowMissingColumns=True)
