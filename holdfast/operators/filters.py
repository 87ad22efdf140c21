"""Row-level cleaning of detections: relabelling, marking and dropping.

Detections are rows of a video's frame, hands and objects alike (see ``holdfast.testdata``). Keys are ``FRAME``. ``row_id`` is
unique within a frame and stands for the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, labels, parsing
from .matching import best_object

FRAME = ("video_id", "frame_number")


def unfiltered(strict: bool = False) -> Column:
    """Rows that no filter has marked. A null mark counts as unmarked, unless ``strict``."""
    return F.col("is_filtered") == False if strict else ~F.coalesce(F.col("is_filtered"), F.lit(False))  # noqa: E712


def with_missing(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns added only where the frame has none of that name."""
    return df.withColumns({k: v for k, v in columns.items() if k not in df.columns})


def blue_glove(df: DataFrame, threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    """Unfiltered hands: a blue share at the threshold makes an experimenter without contact, else a participant.

    A degenerate box counts as share 0; a null share (no image) leaves the row as it is. ``inclusive`` is the rule that is live.
    """
    df = with_missing(df, contact_label_raw=F.col("contact_label"), contact_state_raw=F.col("contact_state"), blue_glove_status=F.lit("NA"))
    share = F.when(boxes.valid(boxes.box()), F.col("blue_prop")).otherwise(0.0)
    known = (F.col("detection_type") == "hand") & unfiltered(strict=True) & share.isNotNull()
    blue = known & ((share >= threshold) if inclusive else (share > threshold))
    return df.withColumns({
        "blue_glove_status": F.when(blue, "experimenter").when(known, "participant").otherwise(F.col("blue_glove_status")),
        "contact_label": F.when(blue, labels.NO_CONTACT).otherwise(F.col("contact_label")),
        "contact_state": F.when(blue, 0).otherwise(F.col("contact_state")),
        "blue_prop": F.when(known, share).otherwise(F.col("blue_prop")),
    })


def object_size(df: DataFrame, frames: DataFrame | tuple[Column, Column], most: float = 0.5) -> DataFrame:
    """Mark unfiltered objects that take more than ``most`` of their frame; ``frames`` has width and height by video, or is both as columns."""
    df = with_missing(df, filtered_by=F.lit(None).cast("string"), filtered_reason=F.lit(None).cast("string"))
    if isinstance(frames, DataFrame):
        size = frames.select("video_id", F.struct("width", "height").alias("__frame"))
        joined, (w, h) = df.join(size, "video_id", "left"), (F.col("__frame.width"), F.col("__frame.height"))
    else:
        joined, (w, h) = df, frames
    share = F.try_divide(boxes.area(boxes.box()), w * h)
    large = (F.col("detection_type") == "object") & unfiltered(strict=True) & (share > most)
    large = F.coalesce(large, F.lit(False))
    reason = F.format_string("area ratio %.4f > %.2f", share, F.lit(most))
    marked = joined.withColumns({"is_filtered": F.when(large, True).otherwise(F.col("is_filtered")), "filtered_by": F.when(large, "object_size_filter").otherwise(F.col("filtered_by")), "filtered_reason": F.when(large, reason).otherwise(F.col("filtered_reason"))})
    return marked.drop("__frame")


def object_ratio(df: DataFrame, factor: float, flag: str | None = None) -> DataFrame:
    """Unfiltered portable hands whose best object is larger than ``factor`` times the hand lose contact.

    The columns of the match are written wherever there is one; ``flag`` names a column that tells where the rule applied.
    """
    df = with_missing(df, contact_label_raw=F.col("contact_label"), contact_state_raw=F.col("contact_state"))
    match = best_object(df, (F.col("contact_label") == labels.PORTABLE) & unfiltered(strict=True), unfiltered(strict=True))
    hand = F.when(F.col("m_row_id").isNotNull(), boxes.area(boxes.box()))
    large = F.coalesce(F.col("m_area") > factor * hand, F.lit(False))
    out = match.withColumns({
        "matched_object_conf": F.col("m_confidence"), "matched_object_area": F.col("m_area"), "hand_area": hand,
        "area_ratio": F.try_divide(F.col("m_area"), F.when(hand > 0, hand)), "obj_match_method": F.when(F.col("m_row_id").isNotNull(), "offset"),
        "contact_label": F.when(large, labels.NO_CONTACT).otherwise(F.col("contact_label")), "contact_state": F.when(large, 0).otherwise(F.col("contact_state")),
        **({flag: large} if flag else {}),
    })
    return out.drop("m_row_id", "m_confidence", "m_area", "m_iou")


def bigger_than_hand(df: DataFrame, k: float = 1.0) -> DataFrame:
    return object_ratio(df, k)


def smaller_factor(df: DataFrame, factor: float = 2.0) -> DataFrame:
    return object_ratio(df, factor, "small_object_rule_applied")


def frame_tracking_box(df: DataFrame) -> DataFrame:
    """Each frame's tracked box: the first non-null of each column in order of rows; null if its source or box is void."""
    w = Window.partitionBy(*FRAME).orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = ("x1", "y1", "x2", "y2")
    df = df.withColumns({f"t_{k}": F.first(f"tracking_bbox_{k}", ignorenulls=True).over(w) for k in names} | {"t_source": F.lower(F.trim(F.first("tracking_bbox_source", ignorenulls=True).over(w)))})
    good = ~F.coalesce(F.col("t_source"), F.lit("none")).isin("", "none", "na") & boxes.valid(boxes.box("t_"))
    return df.withColumns({f"t_{k}": F.when(good, F.col(f"t_{k}")) for k in names})


def strict_portable(df: DataFrame, detected: float = 0.05, tracked: float = 0.15) -> DataFrame:
    """Portable hands keep their label only with evidence: a detected object, or else the frame's tracked box, overlaps enough."""
    detected, tracked = (max(0.0, min(1.0, t)) for t in (detected, tracked))
    df = with_missing(df, tracking_bbox_x1=F.lit(None).cast("double"), tracking_bbox_y1=F.lit(None).cast("double"), tracking_bbox_x2=F.lit(None).cast("double"), tracking_bbox_y2=F.lit(None).cast("double"), tracking_bbox_source=F.lit(None).cast("string"))
    df = frame_tracking_box(df).withColumn("__strict", labels.strict(F.col("contact_label")))
    judged = (F.col("detection_type") == "hand") & unfiltered()
    portable = judged & F.coalesce(F.col("__strict") == labels.PORTABLE, F.lit(False))
    blue = portable & (F.lower(F.trim(F.coalesce(F.col("blue_glove_status"), F.lit("")))) == "experimenter")
    df = df.withColumns({"__judged": judged, "__blue": blue, "__asked": portable & ~blue})
    df = best_object(df, F.col("__asked"), unfiltered())
    t_iou = F.when(F.col("__asked") & F.col("t_x1").isNotNull(), boxes.iou(boxes.box(), boxes.box("t_")))
    by_object = F.coalesce(F.col("m_iou") >= detected, F.lit(False))
    by_track = ~by_object & F.coalesce(t_iou >= tracked, F.lit(False))
    lost = F.col("__asked") & ~by_object & ~by_track
    why = F.concat_ws("|", F.when(F.col("m_iou").isNull(), "no_detected_match").otherwise("detected_iou_below_threshold"), F.when(t_iou.isNull(), "no_tracked_match").otherwise("tracked_iou_below_threshold"))
    out = df.withColumns({
        "portable_strict_eligible": F.when(F.col("__judged"), by_object | by_track),
        "portable_evidence_source": F.when(by_object, "detected").when(by_track, "tracked").when(F.col("__judged"), "none"),
        "portable_evidence_iou": F.when(by_object, F.col("m_iou")).when(by_track, t_iou),
        "portable_evidence_detected_conf": F.col("m_confidence"),
        "strict_demote_reason": F.when(F.col("__blue"), "blue_experimenter").when(lost, why).when(F.col("__judged"), ""),
        "contact_label": F.when(F.col("__blue") | lost, labels.NO_CONTACT).otherwise(F.col("contact_label")),
        "contact_state": F.when(F.col("__blue") | lost, 0).otherwise(F.col("contact_state")),
    })
    return out.drop("__judged", "__blue", "__asked", "__strict", "m_row_id", "m_confidence", "m_area", "m_iou", "t_x1", "t_y1", "t_x2", "t_y2", "t_source")


def heuristics(objects: DataFrame, hands: DataFrame, min_confidence: float = 0.8, aspect: tuple[float, float] = (0.8, 1.2), require_hand: bool = True, max_area_ratio: float = 0.5, max_overlap: float = 0.4) -> DataFrame:
    """Objects with their best hand, what they fail (all reasons) and whether they pass."""
    from .matching import best_hand

    df = best_hand(objects, hands)
    own, hand = boxes.box(), boxes.box("hand_")
    has = F.col("hand_row_id").isNotNull()
    ratio = F.when(has, boxes.area(own) / F.greatest(boxes.area(hand), F.lit(1e-6)))
    overlap = F.when(has, boxes.intersection(own, hand) / F.greatest(boxes.area(own), F.lit(1e-6)))
    shape = boxes.aspect_ratio(own)
    reasons = parsing.joined(
        ("low_confidence", F.col("confidence") < min_confidence),
        ("aspect_ratio_out_of_range", ~shape.between(*aspect)),
        ("no_hand_in_frame", ~has & F.lit(require_hand)),
        ("object_too_large_relative_to_hand", F.coalesce(ratio >= max_area_ratio, F.lit(False))),
        ("object_too_occluded_by_hand", F.coalesce(overlap > max_overlap, F.lit(False))),
    )
    out = df.withColumns({"aspect_ratio": shape, "object_area": boxes.area(own), "object_to_hand_area_ratio": ratio, "hand_overlap_ratio": overlap, "heuristics_fail_reasons": reasons})
    return out.withColumn("passed_heuristics", F.col("heuristics_fail_reasons") == "")


def k_means_filter(*_: object, **__: object) -> DataFrame:
    """Named by the configurations, without a behaviour of its own."""
    raise NotImplementedError("the k-means filter has no defined behaviour")


#: Filters of pseudo-labels by the name that a configuration gives.
STRATEGIES = {"heuristics": heuristics, "kmeans": k_means_filter}


def strategy(name: str):
    if name not in STRATEGIES:
        raise ValueError(f"unknown filter {name!r}; choices: {sorted(STRATEGIES)}")
    return STRATEGIES[name]


def best_of_frame(df: DataFrame, hand: float = 0.5, obj: float = 0.5, most: int = 10) -> DataFrame:
    """Detections over their type's threshold, at most ``most`` of each type in a frame, by confidence."""
    kept = df.where(F.col("confidence") >= F.when(F.col("detection_type") == "hand", hand).otherwise(obj))
    w = Window.partitionBy(*FRAME, "detection_type").orderBy(F.desc("confidence"), "row_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def best_of_image(df: DataFrame, most: int = 100) -> DataFrame:
    """Over all classes the rows whose score is at least the ``most``-th largest; ties stay."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*FRAME).orderBy(F.desc("confidence")))).where(F.col("rank") <= most)


def large_boxes(df: DataFrame, least: int = 10) -> DataFrame:
    """Drop boxes whose both sides are below ``least``, then frames that have none."""
    b = boxes.box()
    return df.where((boxes.width(b) >= least) | (boxes.height(b) >= least))


def inside(df: DataFrame, w: Column, h: Column, allowed: int = 0) -> DataFrame:
    b = boxes.box()
    return df.where((b.x1 >= -allowed) & (b.y1 >= -allowed) & (b.x2 < w + allowed) & (b.y2 < h + allowed))


def sane_boxes(df: DataFrame, w: Column, h: Column) -> DataFrame:
    """COCO sanitising of (x, y, width, height): clamp to the image, keep positive areas and ordered corners."""
    x1, y1 = F.greatest(F.lit(0.0), F.col("x").cast("double")), F.greatest(F.lit(0.0), F.col("y").cast("double"))
    x2 = F.least(w - 1.0, x1 + F.greatest(F.lit(0.0), F.col("w") - 1.0))
    y2 = F.least(h - 1.0, y1 + F.greatest(F.lit(0.0), F.col("h") - 1.0))
    return df.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2}).where((F.col("w") * F.col("h") > 0) & (F.col("x2") >= F.col("x1")) & (F.col("y2") >= F.col("y1")))


def repaired_boxes(df: DataFrame, w: Column, h: Column) -> DataFrame:
    """Scene-graph repair: a box without positive sides becomes the whole image (known quirk, kept: y2 is width - 1)."""
    bad = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    return df.select("*", F.when(bad, 0).otherwise(F.col("x1")).alias("fixed_x1"), F.when(bad, 0).otherwise(F.col("y1")).alias("fixed_y1"), F.when(bad, w - 1).otherwise(F.col("x2")).alias("fixed_x2"), F.when(bad, w - 1).otherwise(F.col("y2")).alias("fixed_y2"))


def same_object(a: boxes.Box, b: boxes.Box, most: float = 0.5) -> Column:
    """Both absent: true; both present: overlap over ``most``; else false."""
    return F.when(a.x1.isNull() & b.x1.isNull(), True).when(a.x1.isNull() | b.x1.isNull(), False).otherwise(boxes.iou(a, b) > most)


def ids(df: DataFrame, among: dict[str, list], area: tuple[float, float] | None = None, crowd: bool | None = None) -> DataFrame:
    """Annotations by lists of values, an open range of area, and crowd; an empty list doesn't restrict."""
    tests = [F.col(k).isin(v) for k, v in among.items() if v]
    if area is not None:
        tests.append((F.col("area") > area[0]) & (F.col("area") < area[1]))
    if crowd is not None:
        tests.append(F.col("iscrowd") == int(crowd))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def with_all_categories(annotations: DataFrame, categories: list) -> DataFrame:
    """Images that have every one of the categories."""
    some = annotations.where(F.col("category_id").isin(categories)).groupBy("image_id").agg(F.count_distinct("category_id").alias("n"))
    return some.where(F.col("n") == len(set(categories))).select("image_id")


def extra_regions(rois: DataFrame, extra: DataFrame, key: str, scale: Column, w: Column, h: Column) -> DataFrame:
    """``rois`` (key, box) and, scaled and clipped to the image, the valid boxes of ``extra``."""
    b = boxes.Box(*(c * scale for c in boxes.box()))
    b = boxes.clip(b, w, h, 1)
    added = extra.select(key, *[c.alias(f"bbox_{k}") for k, c in zip(("x1", "y1", "x2", "y2"), b, strict=True)], F.lit(True).alias("is_extra"))
    kept = added.where(boxes.valid(boxes.box()))
    return rois.select(key, *[F.col(f"bbox_{k}").cast("double").alias(f"bbox_{k}") for k in ("x1", "y1", "x2", "y2")], F.lit(False).alias("is_extra")).unionByName(kept)


def with_vocabulary(nodes: DataFrame, vocabulary: DataFrame, key: str = "image_id") -> DataFrame:
    """The images that have at least one object with a name of the vocabulary."""
    return nodes.join(vocabulary.select("name").distinct(), "name", "left_semi").select(key).distinct()
