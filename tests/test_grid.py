"""Boxes that meet in a grid, and regions beside crowds, against all pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from holdfast.operators import dataset, grid, proposals, rois

BOX = "image_id int, {0}_id int, {1}x1 double, {1}y1 double, {1}x2 double, {1}y2 double"


def some(n, images, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-200, 300), rng.uniform(-200, 300), *(rng.choice([0, 1, 5, 60, 300]) for _ in range(2))
        out.append((rng.choice(images), i, float(round(x)), float(round(y)), float(round(x) + w), float(round(y) + h)))
    return out + [(images[0], n, 128.0, 0.0, 255.0, 127.0), (images[0], n + 1, None, 0.0, 1.0, 1.0), (images[0], n + 2, 9.0, 9.0, 3.0, 3.0), (None, n + 3, 0.0, 0.0, 50.0, 50.0)]


def test_pairs_meet_once(spark):
    a, b = some(150, [1, 2, 3], 1), some(120, [1, 2, 4], 2)
    left, right = spark.createDataFrame(a, BOX.format("anchor", "bbox_")), spark.createDataFrame(b, BOX.format("gt", "gt_"))
    valid = lambda r: None not in r and r[2] <= r[4] and r[3] <= r[5]
    for edge, side in ((1, 128), (0, 128), (1, 10), (1, 1000)):
        expected = sorted((x[1], y[1]) for x in a for y in b if valid(x) and valid(y) and x[0] == y[0] and min(x[4], y[4]) - max(x[2], y[2]) + edge > 0 and min(x[5], y[5]) - max(x[3], y[3]) + edge > 0)
        assert sorted((r.anchor_id, r.gt_id) for r in grid.meeting(left, right, ["image_id"], edge=edge, side=side).collect()) == expected and expected


def test_far_boxes_form_no_pairs(spark):
    """A row of boxes, each of which overlaps its neighbours: pairs grow with boxes, not with their square."""
    n = 3000
    line = spark.range(n).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("anchor_id"), (F.col("id") * 100.0).alias("bbox_x1"), F.lit(0.0).alias("bbox_y1"), (F.col("id") * 100.0 + 120).alias("bbox_x2"), F.lit(50.0).alias("bbox_y2"))
    truths = line.select("image_id", F.col("anchor_id").alias("gt_id"), *[F.col(f"bbox_{k}").alias(f"gt_{k}") for k in ("x1", "y1", "x2", "y2")])
    rows = grid.with_truths(line, truths, "image_id")
    assert rows.count() == n + (3 * n - 2)
    found = proposals.anchor_targets(line, truths, "image_id")
    assert found.where("gt_id = anchor_id and label = 1 and overlap = 1").count() == n


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
    size = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    inter = max(0, w) * max(0, h)
    return inter / (size(a) + size(b) - inter), inter / size(a)


def test_regions_beside_crowds(spark):
    rng = np.random.default_rng(3)
    anns = []
    for i in range(60):
        x, y = rng.integers(-20, 180, 2).tolist()
        anns.append((int(rng.integers(1, 4)), i, int(rng.integers(1, 4)), float(x), float(y), float(rng.choice([0, 30, 90])), float(rng.choice([1, 30, 90])), float(rng.choice([0, 5, 9, 7])), int(rng.random() < 0.3)))
    anns += [(9, 900, 1, 0.0, 0.0, 9.0, 9.0, 1.0, 0), (1, 901, 77, 0.0, 0.0, 9.0, 9.0, 1.0, 0), (1, 902, 1, 5.0, 5.0, 9.0, 9.0, 1.0, None)]
    names = "image_id int, roi_id int, category_id int, x double, y double, w double, h double, area double, iscrowd int"
    images = spark.createDataFrame([(i, 200, 150) for i in (1, 2, 3)], "image_id int, width int, height int")
    classes = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "category_id int, class int")
    props = [(int(rng.integers(1, 5)), 1000 + i, *(float(v) for v in (x, y, x + rng.integers(0, 80), y + rng.integers(0, 80)))) for i, (x, y) in enumerate(rng.integers(0, 150, (80, 2)))]
    got = rois.with_proposals(rois.truth_rois(spark.createDataFrame(anns, names), images, classes), spark.createDataFrame(props, BOX.format("roi", "bbox_"))).collect()
    truths = {}
    for image, roi, category, x, y, w, h, area, crowd in anns:
        x1, y1 = max(0, x), max(0, y)
        x2, y2 = min(199, x1 + max(0, w - 1)), min(149, y1 + max(0, h - 1))
        if image in (1, 2, 3) and category in (1, 2, 3) and area > 0 and x2 >= x1 and y2 >= y1:
            truths[roi] = (image, (x1, y1, x2, y2), category * 10, crowd == 1)
    assert {r.roi_id: (r.overlap, r.gt_class, r.best_class, (r.bbox_x1, r.bbox_y1, r.bbox_x2, r.bbox_y2)) for r in got if r.kind == "truth"} == {k: (-1.0 if c else 1.0, cls, 0 if c else cls, b) for k, (_, b, cls, c) in truths.items()}
    kinds = set()
    for r in (r for r in got if r.kind == "proposal"):
        b = (r.bbox_x1, r.bbox_y1, r.bbox_x2, r.bbox_y2)
        empty = b[0] == b[2] and b[1] == b[3]
        here = [(k, t) for k, t in truths.items() if t[0] == r.image_id]
        in_crowd = any(overlap(b, t[1])[1] >= 0.7 for _, t in here if t[3])
        best = max(((-1 if empty else 0 if t[1][0] == t[1][2] and t[1][1] == t[1][3] else overlap(b, t[1])[0], -k, t[2]) for k, t in here if not t[3]), default=(0, 0, 0))
        expected = (-1, 0) if in_crowd else (best[0], best[2] if best[0] > 0 else 0)
        assert (round(r.overlap, 9), r.best_class, r.gt_class) == (round(expected[0], 9), expected[1], 0)
        kinds.add("crowd" if in_crowd else "free")
    assert kinds == {"crowd", "free"} and len(got) == len(truths) + len(props)


def test_hands_with_objects(spark):
    h = spark.createDataFrame([("a", 2, 0.5), ("a", 1, 0.7), ("b", 1, 0.1), (None, 1, 0.2)], "image string, n int, score double")
    o = spark.createDataFrame([("a", 5, None), ("c", 1, 0.9)], "image string, n int, score double")
    got = {r.image: ([x.n for x in r.hands], [(x.n, x.score) for x in r.objects]) for r in rois.hands_with_objects(h, o, "image", "n", ["score"]).collect()}
    assert got == {"a": ([1, 2], [(5, None)]), "b": ([1], []), "c": ([], [(1, 0.9)]), None: ([1], [])}


def test_a_null_split_is_a_split(spark):
    rows = [("train", 1, 0, 100, 50, 1.0, 1.0, 9.0, 9.0, 0.5, 1), (None, 2, 0, 100, 50, 1.0, 1.0, 9.0, 9.0, 0.5, 2), (None, None, 3, 100, 50, 1.0, 1.0, 9.0, 9.0, 0.5, 3)]
    labels = spark.createDataFrame(rows, "split string, video_id int, frame_idx int, width int, height int, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, confidence double, row_id int")
    images, annotations = dataset.coco_tables(labels)
    assert images.count() == 3 and sorted((str(r.split), r.image_id, r.annotation_id) for r in annotations.collect()) == [("None", 1, 1), ("None", 2, 2), ("train", 1, 1)]


def test_coco_curves_sort_a_detection_once(spark, monkeypatch):
    """A detection is one row for all areas and thresholds: none of the staged tables has more rows than there are detections."""
    from holdfast.operators import detection_eval as e

    rng, sizes, staged = random.Random(5), [], e.staged

    def counted(df, tag, *rest):
        out = staged(df, tag, *rest)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(e, "staged", counted)
    box = lambda: [float(rng.randint(0, 30)), float(rng.randint(0, 30)), float(rng.randint(5, 60)), float(rng.randint(5, 60))]
    d = [(i % 40, i % 3, i, *box(), rng.randint(0, 9) / 10) for i in range(400)]
    g = [(i % 40, i % 3, i, *b[3:7], b[5] * b[6], int(i % 9 == 0), 0) for i, b in enumerate(d) if i % 2]
    dd = spark.createDataFrame(d, "image_id bigint, category_id bigint, det_id bigint, x double, y double, w double, h double, score double").repartition(7)
    gg = spark.createDataFrame(g, "image_id bigint, category_id bigint, gt_id bigint, x double, y double, w double, h double, area double, iscrowd int, gt_ignore int")
    rows = e.coco_match(dd, gg, e.AREAS).collect()
    got = {(r.kind, r.category_id, r.threshold, r.at): r.precision for r in e.coco_precision(staged(e.coco_folded(dd, gg, e.AREAS), "m"), e._counted(gg, e.AREAS), e.AREAS).collect()}
    npos = {(r.kind, r.category_id): r.npos for r in e._counted(gg, e.AREAS).collect()}
    assert len(got) == len(npos) * 1010 and len(rows) == 16000
    for kind, category, threshold in {k[:3] for k in got}:
        own = sorted((r for r in rows if (r.kind, r.category_id, r.threshold) == (kind, category, threshold) and not r.ignored), key=lambda r: (-r.score, r.image_id, r["rank"]))
        tp, want = 0, [0.0] * 101
        for n, r in enumerate(own, 1):
            tp += r.matched
            at = int(tp / npos[kind, category] * 100 + 1e-9)
            want[: at + 1] = [max(w, tp / n) for w in want[: at + 1]]
        assert [got[kind, category, threshold, at] for at in range(101)] == want
    e.coco_means(dd, gg).collect()
    e.coco_means_by_category(dd, gg).collect()
    assert len(sizes) == 5 and max(sizes) <= 400
