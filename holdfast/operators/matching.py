"""Matches of hands and objects within a frame. Every choice names its whole key, down to the order of rows.

A frame has some ten rows. Its candidates are packed into one array, by a window where both sides are rows of one table and by
an aggregate where they aren't, and each row takes the least of its array: one exchange, and no table is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes

FRAME = ("video_id", "frame_number")


def pairs(df: DataFrame, hands: Column, objects: Column) -> DataFrame:
    """Hands and objects of one frame, their columns prefixed with h_ and o_."""
    left = df.where((F.col("detection_type") == "hand") & hands).select(*FRAME, *[F.col(c).alias(f"h_{c}") for c in _COLUMNS])
    right = df.where((F.col("detection_type") == "object") & objects).select(*FRAME, *[F.col(c).alias(f"o_{c}") for c in _COLUMNS])
    return left.join(right, list(FRAME))


_COLUMNS = ("row_id", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "confidence", "offset_x", "offset_y", "offset_mag")


def _packed(df: DataFrame, rows: Column) -> DataFrame:
    """``df`` with the frame's ``rows`` (those of them that are objects) as an array in each row."""
    objects = (F.col("detection_type") == "object") & rows
    return df.withColumn("__objects", F.collect_list(F.when(objects, F.struct(*_COLUMNS))).over(Window.partitionBy(*FRAME)))


def _found(df: DataFrame, best: Column) -> DataFrame:
    """``df`` with __best, a row's choice from its array, as the output of a generator.

    A plain column would be copied into each of its fields and into filters above it, and each copy walks the array anew.
    """
    return df.withColumn("__best", F.explode(F.array(best)))


def _box_of(item: Column, prefix: str = "bbox_") -> boxes.Box:
    return boxes.Box(*(item[f"{prefix}{k}"] for k in ("x1", "y1", "x2", "y2")))


def best_object(df: DataFrame, hands: Column, objects: Column) -> DataFrame:
    """``df`` with m_row_id, m_confidence, m_area and m_iou of each such hand's best object; null elsewhere.

    Best: highest confidence, nearest to where the hand's offset points, largest overlap, largest area, smallest corners.
    """
    hand = boxes.box()

    def judged(o: Column) -> Column:
        b, conf = _box_of(o), F.coalesce(o.confidence, F.lit(0.0))
        iou, area = boxes.iou(hand, b), boxes.area(b)
        far = boxes.offset_distance(hand, b, F.col("offset_mag"), F.col("offset_x"), F.col("offset_y"))
        key = [(-conf).alias("k1"), far.alias("k2"), (-iou).alias("k3"), (-area).alias("k4"), *[c.alias(f"k{i}") for i, c in enumerate(b, 5)]]
        return F.struct(*key, o.row_id.alias("row_id"))

    best = F.when((F.col("detection_type") == "hand") & hands, F.array_min(F.transform("__objects", judged)))
    out = _found(_packed(df, objects), best)
    named = {"row_id": F.col("__best.row_id"), "confidence": -F.col("__best.k1"), "area": -F.col("__best.k4"), "iou": -F.col("__best.k3")}
    return out.withColumns({f"m_{k}": v for k, v in named.items()}).drop("__objects", "__best")


def best_hand(objects: DataFrame, hands: DataFrame) -> DataFrame:
    """``objects`` with their frame's best hand (hand_row_id, its box, matched_hand_iou, matched_hand_center_dist), or nulls.

    Best: largest overlap, nearest centre, first in order of rows.
    """
    names = ("x1", "y1", "x2", "y2")
    of_frame = hands.groupBy(*FRAME).agg(F.collect_list(F.struct("row_id", *[f"bbox_{k}" for k in names])).alias("__hands"))

    def judged(h: Column) -> Column:
        b = _box_of(h)
        iou, far = boxes.iou(boxes.box(), b), boxes.centre_distance(boxes.box(), b)
        return F.struct((-iou).alias("k"), far.alias("far"), h.row_id.alias("row_id"), *[c.alias(k) for k, c in zip(names, b, strict=True)])

    out = _found(objects.join(of_frame, list(FRAME), "left"), F.array_min(F.transform("__hands", judged)))
    named = {"hand_row_id": F.col("__best.row_id"), **{f"hand_{k}": F.col(f"__best.{k}") for k in names}, "matched_hand_iou": -F.col("__best.k"), "matched_hand_center_dist": F.col("__best.far")}
    return out.withColumns(named).drop("__hands", "__best")


def nearest_object(df: DataFrame, in_contact: Column) -> DataFrame:
    """Hands with the object nearest to where their offset points (object_row_id, -1 without contact or object)."""
    far = lambda o: F.struct(boxes.offset_distance(boxes.box(), _box_of(o), F.col("offset_mag"), F.col("offset_x"), F.col("offset_y")).alias("far"), o.row_id.alias("row_id"))
    best = F.when(in_contact, F.array_min(F.transform("__objects", far)))
    return _packed(df, F.lit(True)).where("detection_type = 'hand'").select(*FRAME, "row_id", F.coalesce(best["row_id"], F.lit(-1)).alias("object_row_id"))


#: Truths of an image that are judged by generated code; what an image has beyond them, by a lambda.
FIRST = 4


def overlaps(dets: DataFrame, truths: DataFrame, keys: list[str], masked: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each detection with its best truth by pixel overlap: gt_id, overlap (ties: smallest gt_id), ``extra`` columns of it; nulls without a truth."""
    measure = boxes.iou_pixels_masked if masked else boxes.iou_pixels
    of_image = truths.groupBy(*keys).agg(F.collect_list(F.struct("gt_id", *[f"gt_{k}" for k in ("x1", "y1", "x2", "y2")], *extra)).alias("__truths"))

    def judged(g: Column) -> Column:
        over = measure(boxes.box(), _box_of(g, "gt_"))
        return F.struct((-over).alias("k"), g.gt_id.alias("gt_id"), *[g[c].alias(c) for c in extra])

    # Lambdas are interpreted, and so is all of a generator that has one: an image's first truths are judged by plain expressions of
    # a projection, whose code is split into methods small enough to be compiled.
    n = F.size("__truths")
    rest = F.when(n > FIRST, F.array_min(F.transform(F.slice("__truths", FIRST + 1, n), judged)))
    first = [F.when(n > i, judged(F.get("__truths", F.lit(i)))) for i in range(FIRST)]
    out = _found(dets.join(of_image, keys, "left").withColumn("__least", F.least(*first, rest)), F.col("__least"))
    return out.withColumns({"overlap": -F.col("__best.k"), **{k: F.col(f"__best.{k}") for k in ("gt_id", *extra)}}).drop("__truths", "__least", "__best")


def aligned(predictions: DataFrame, truth: DataFrame, keys: list[str], missing: str = "drop") -> DataFrame:
    """Predictions with gt. A frame without truth is dropped ("drop"), 0 ("zero") or kept as null ("count")."""
    if missing not in ("drop", "zero", "count"):
        raise ValueError(f"unknown policy {missing!r}")
    out = predictions.join(truth.select(*keys, "gt"), keys, "inner" if missing == "drop" else "left")
    return out.fillna(0, ["gt"]) if missing == "zero" else out
