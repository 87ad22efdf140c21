"""A database of regions to train a detector on: clean truths, crowds set apart, proposals with their overlaps, hands with objects.

A crowd is a region of many things: it is no truth to learn, and what lies in it is no background either. Both have the overlap -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from .grid import meeting, side_for, with_truths

_SIDES = ("x1", "y1", "x2", "y2")
ROI = "image_id, roi_id, kind, bbox_x1, bbox_y1, bbox_x2, bbox_y2, gt_class, overlap, best_class"


def truth_rois(annotations: DataFrame, images: DataFrame, classes: DataFrame) -> DataFrame:
    """ROI rows of annotations (image_id, roi_id, category_id, x, y, w, h, area, iscrowd), images (image_id, width, height) and
    classes (category_id, class).

    Boxes are clamped to their image; those without area or turned inside out go. A crowd's overlap is -1 with every class, so
    that class 0 is its best; another truth has 1 with its own class. Annotations of unknown images or categories go.
    """
    df = annotations.join(images, "image_id").join(classes, "category_id")
    x1, y1 = F.greatest(F.lit(0.0), F.col("x").cast("double")), F.greatest(F.lit(0.0), F.col("y").cast("double"))
    x2 = F.least(F.col("width") - 1.0, x1 + F.greatest(F.lit(0.0), F.col("w") - 1.0))
    y2 = F.least(F.col("height") - 1.0, y1 + F.greatest(F.lit(0.0), F.col("h") - 1.0))
    crowd = F.coalesce(F.col("iscrowd") == 1, F.lit(False))
    clean = df.withColumns({f"bbox_{k}": v for k, v in zip(_SIDES, (x1, y1, x2, y2), strict=True)}).where((F.col("area") > 0) & (F.col("bbox_x2") >= F.col("bbox_x1")) & (F.col("bbox_y2") >= F.col("bbox_y1")))
    cls = F.col("class").cast("int")
    return clean.select("image_id", "roi_id", F.lit("truth").alias("kind"), *[f"bbox_{k}" for k in _SIDES], cls.alias("gt_class"), F.when(crowd, -1.0).otherwise(1.0).alias("overlap"), F.when(crowd, 0).otherwise(cls).alias("best_class"))


def with_proposals(truths: DataFrame, proposals: DataFrame, covered: float = 0.7, side: float | None = None) -> DataFrame:
    """``truths`` (ROI rows) and below them ``proposals`` (image_id, roi_id, bbox_x1 .. bbox_y2): class 0, and the greatest overlap
    with a truth that is no crowd, with its class as the best one (0 without overlap).

    A proposal of which at least ``covered`` lies in one crowd has the overlap -1 and best class 0. Pairs are formed by the grid.
    """
    sides = [F.col(f"bbox_{k}").alias(f"gt_{k}") for k in _SIDES]
    real = truths.where("overlap >= 0").select("image_id", F.col("roi_id").alias("gt_id"), *sides, F.col("gt_class").alias("of_class"))
    crowds = truths.where("overlap < 0").select("image_id", *sides)
    side = side_for(truths, "bbox_") if side is None else side
    regions = proposals.select("image_id", "roi_id", *[F.col(f"bbox_{k}").cast("double").alias(f"bbox_{k}") for k in _SIDES])
    best = with_truths(regions, real, "image_id", side).groupBy("image_id", "roi_id").agg(F.max(F.struct("overlap", -F.col("gt_id"), "of_class")).alias("m"))
    inside = meeting(regions, crowds, ["image_id"], side=side).where(boxes.coverage(boxes.box("gt_"), boxes.box()) >= covered).select("image_id", "roi_id").distinct().withColumn("in_crowd", F.lit(True))
    joined = regions.join(best, ["image_id", "roi_id"]).join(inside, ["image_id", "roi_id"], "left")
    crowd, over = F.coalesce("in_crowd", F.lit(False)), F.col("m.overlap")
    rows = joined.select(
        "image_id", "roi_id", F.lit("proposal").alias("kind"), *[f"bbox_{k}" for k in _SIDES], F.lit(0).alias("gt_class"),
        F.when(crowd, -1.0).otherwise(over).alias("overlap"), F.when(crowd | (over <= 0), 0).otherwise(F.col("m.of_class")).alias("best_class"),
    )
    return truths.select(*ROI.split(", ")).unionByName(rows)


def kind_for_training(overlap: Column, foreground: float = 0.5, low: float = 0.1, high: float = 0.5) -> Column:
    """fg from ``foreground`` on, bg in [low, high); null for the rest, crowds and what they cover among them."""
    return F.when(overlap >= foreground, "fg").when((overlap >= low) & (overlap < high), "bg")


def hands_with_objects(hands: DataFrame, objects: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each image that has either: its hands and its objects as arrays of structs (order, columns), by ``order``.

    Nulls in ``order`` come first; a null key is an image of its own. The arrays of an image are one row.
    """
    # One grouping of both tables: a join of two groupings would lose the images that only one has, or shuffle twice.
    both = hands.select(key, F.lit(True).alias("hand"), order, *columns).unionByName(objects.select(key, F.lit(False).alias("hand"), order, *columns))
    packed = both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("hand", F.struct(order, *columns).alias("row")))).alias("rows"))
    part = lambda which: F.transform(F.filter("rows", lambda r: r.hand == which), lambda r: r.row)
    return packed.select(key, part(F.lit(True)).alias("hands"), part(F.lit(False)).alias("objects"))
