"""Operators on small inline frames: thresholds, ties, streaks and policies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import boxes, labels, masks, parsing
from holdfast.operators import condense, dataset, filters, metrics, proposals, refine, runs
from holdfast.operators import detection_eval as e
from holdfast.operators import tracking as t

DET = "video_id bigint, frame_number bigint, frame_id string, row_id bigint, detection_type string, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, confidence double, contact_state int, contact_label string, hand_side string, offset_x double, offset_y double, offset_mag double, blue_prop double, blue_glove_status string, is_filtered boolean"


def hand(row, box, label="Portable Object", frame=1, side="Left", blue="participant", filtered=False, video=1, prop=0.0):
    return (video, frame, f"{frame:06d}.png", row, "hand", *box, 90.0, 3, label, side, 0.0, 0.0, 0.0, prop, blue, filtered)


def obj(row, box, conf=95.0, frame=1, filtered=False, video=1):
    return (video, frame, f"{frame:06d}.png", row, "object", *box, conf, None, None, None, None, None, None, None, "NA", filtered)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), DET)


def by_row(df):
    return {r.row_id: r for r in df.collect()}


H, NEAR, FAR = (10, 10, 30, 30), (12, 12, 28, 28), (200, 200, 240, 240)


def test_blue_glove_threshold_is_inclusive(spark):
    df = frame(spark, hand(1, H, prop=0.5), hand(2, H, prop=0.49), hand(3, (5, 5, 5, 9), prop=0.9), hand(4, H, prop=0.9, filtered=True), hand(5, H, prop=None))
    got = by_row(filters.blue_glove(df))
    assert [(got[i].blue_glove_status, got[i].contact_label) for i in (1, 2, 3)] == [("experimenter", "No Contact"), ("participant", "Portable Object"), ("participant", "Portable Object")]
    assert got[4].contact_label == got[5].contact_label == "Portable Object"
    assert by_row(filters.blue_glove(df, inclusive=False))[1].contact_label == "Portable Object"


def test_object_size(spark):
    frames = spark.createDataFrame([(1, 100, 100)], "video_id bigint, width int, height int")
    got = by_row(filters.object_size(frame(spark, obj(1, (0, 0, 20, 20)), obj(2, (0, 0, 100, 100)), obj(3, (0, 0, 100, 50))), frames))
    assert [(got[i].is_filtered, got[i].filtered_by) for i in (1, 2, 3)] == [(False, None), (True, "object_size_filter"), (False, None)]


def test_ratio_filters_keep_equality(spark):
    for size, label in ((8, "Portable Object"), (10, "Portable Object"), (11, "No Contact")):
        got = by_row(filters.bigger_than_hand(frame(spark, hand(1, (0, 0, 10, 10)), obj(2, (0, 0, size, size)))))
        assert got[1].contact_label == label and got[1].matched_object_area == size * size and got[1].obj_match_method == "offset"
    got = by_row(filters.smaller_factor(frame(spark, hand(1, (0, 0, 10, 10)), obj(2, (0, 0, 20, 20)), obj(3, (0, 0, 9, 9), 90.0))))
    assert got[1].contact_label == "No Contact" and got[1].small_object_rule_applied
    alone = by_row(filters.bigger_than_hand(frame(spark, hand(1, (0, 0, 10, 10)))))
    assert alone[1].contact_label == "Portable Object" and alone[1].matched_object_area is None


def test_strict_portable(spark):
    def tracked(df, box, source="predicted"):
        return df.withColumns({f"tracking_bbox_{k}": F.lit(float(v)) for k, v in zip(("x1", "y1", "x2", "y2"), box, strict=True)} | {"tracking_bbox_source": F.lit(source)})

    got = by_row(filters.strict_portable(frame(spark, hand(1, H))))
    assert (got[1].contact_label, got[1].strict_demote_reason) == ("No Contact", "no_detected_match|no_tracked_match")
    got = by_row(filters.strict_portable(frame(spark, hand(1, H), obj(2, FAR))))
    assert got[1].strict_demote_reason == "detected_iou_below_threshold|no_tracked_match"
    got = by_row(filters.strict_portable(frame(spark, hand(1, H), obj(2, NEAR))))
    assert (got[1].contact_label, got[1].portable_evidence_source) == ("Portable Object", "detected")
    assert by_row(filters.strict_portable(frame(spark, hand(1, H, blue="experimenter"), obj(2, NEAR))))[1].strict_demote_reason == "blue_experimenter"
    assert by_row(filters.strict_portable(tracked(frame(spark, hand(1, H)), NEAR)))[1].portable_evidence_source == "tracked"
    assert by_row(filters.strict_portable(tracked(frame(spark, hand(1, H)), FAR)))[1].strict_demote_reason == "no_detected_match|tracked_iou_below_threshold"
    assert by_row(filters.strict_portable(tracked(frame(spark, hand(1, H)), NEAR, "none")))[1].contact_label == "No Contact"


def test_condense_priorities(spark):
    df = frame(spark, hand(1, H), hand(2, H, "No Contact", side="Right"), hand(3, H, "Portable Object", frame=2, side="Right"), obj(4, H, frame=3), hand(5, H, "Self Contact", frame=4))
    got = {r.frame_number: (r.contact_label, r.source_hand) for r in condense.condense(df).collect()}
    assert got == {1: ("No Contact", "Both"), 2: ("Portable Object", "Right"), 3: ("No Contact", "NA"), 4: ("No Contact", "Left")}
    assert {r.frame_number: r.contact_label for r in condense.condense(df, "portable_first").collect()}[1] == "Portable Object"
    with pytest.raises(ValueError, match="portable_first"):
        condense.condense(df, "other")


def bridge(spark, *rows, **config):
    return by_row(t.tracking_bridge(frame(spark, *rows), t.BridgeConfig(**config)))


def test_bridge_promotes_on_the_confirming_miss(spark):
    rows = [hand(1, H), obj(2, NEAR), hand(3, H, "No Contact", frame=2), hand(4, H, "No Contact", frame=3)]
    got = bridge(spark, *rows, confirm=2)
    assert [got[i].contact_label for i in (1, 3, 4)] == ["Portable Object", "No Contact", "Portable Object"]
    assert (got[1].tracking_bbox_source, got[3].tracking_bbox_source, got[4].tracking_promoted, got[4].tracking_missed_count) == ("seed_detected", "predicted", True, 2)


def test_bridge_seeds_need_confidence_and_a_portable_hand(spark):
    for rows in ([hand(1, H), obj(2, NEAR, 60.0)], [hand(1, H, "No Contact"), obj(2, NEAR)], [hand(1, H, blue="experimenter"), obj(2, NEAR)]):
        assert bridge(spark, *rows, hand(3, H, "No Contact", frame=2), confirm=1)[3].tracking_state == "inactive"


def test_bridge_gap_budget_and_experimenter(spark):
    rows = [hand(1, H), obj(2, NEAR), *[hand(2 + i, H, "No Contact", frame=1 + i) for i in range(1, 4)]]
    got = bridge(spark, *rows, confirm=5, max_missed=2)
    assert [got[i].tracking_state for i in (3, 4, 5)] == ["tracking", "tracking", "lost"] and got[5].tracking_track_id == 1 and got[5].tracking_bbox_x1 is None
    blocked = bridge(spark, hand(1, H), obj(2, NEAR), hand(3, H, "No Contact", frame=2), hand(4, FAR, "No Contact", frame=2, blue="experimenter"), confirm=1)
    assert not blocked[3].tracking_promoted


def test_bridge_stationary_and_best_overlap(spark):
    rows = [hand(1, H), obj(2, NEAR), hand(3, H, "Stationary Object Contact", frame=2)]
    assert not bridge(spark, *rows, confirm=1)[3].tracking_promoted
    assert bridge(spark, *rows, confirm=1, promote_stationary=True, stationary_confirm=1)[3].tracking_promoted
    best = bridge(spark, hand(1, H), obj(2, NEAR), hand(3, (20, 20, 40, 40), "No Contact", frame=2), hand(4, H, "No Contact", frame=2), confirm=1, contact_iou=0.0)
    assert best[4].tracking_promoted and not best[3].tracking_promoted
    hit = bridge(spark, hand(1, H), obj(2, NEAR), hand(3, H, "No Contact", frame=2), obj(4, NEAR, frame=2), confirm=1)
    assert hit[3].tracking_bbox_source == "associated_detected" and not hit[3].tracking_promoted


def test_temporal_region_steps():
    far, near = (100.0, 100.0, 120.0, 120.0), (10.0, 10.0, 30.0, 30.0)
    assert t.pick([(far, 0.9), (near, 0.5)], (12.0, 12.0, 32.0, 32.0)) == near and t.pick([(far, 0.9), (near, 0.5)], None) == far
    assert t.pick([((5.0, 5.0, 5.0, 9.0), 1.0)], None) is None
    detect = lambda im, region: im[0] if region is None else im[1]
    never = lambda im, b: False
    state, _, what = t.region_step(t.RegionState(), ([(near, 0.9)], []), detect, never)
    assert (state.last, what) == (near, "picked")
    state, found, what = t.region_step(state, ([], [(near, 0.3)]), detect, never)
    assert (state.missed, what, found) == (0, "recovered", [(near, 0.3)])
    state, _, what = t.region_step(state, ([], []), detect, never, 2)
    assert (state.missed, what) == (1, "missed")
    state, _, what = t.region_step(state, ([], []), detect, never, 2)
    assert (state.last, state.missed) == (None, 0)
    assert t.region_step(t.RegionState(near), ([(far, 0.9)], []), detect, lambda im, b: True)[0].last == near


def test_islands_gaps_veto_and_middle(spark):
    data = [(1, f, l, f == 5) for f, l in zip((0, 1, 2, 4, 5, 6, 8), (0, 0, 0, 0, 1, 1, 1), strict=True)]
    df = spark.createDataFrame(data, "video_id int, frame bigint, label int, blue boolean")
    found = runs.islands(df, ["video_id"], "frame", "label", "blue")
    assert sorted((r.label, r.first, r.last, r.length) for r in found.collect()) == [(0, 0, 2, 3), (0, 4, 4, 1), (1, 5, 6, 2), (1, 8, 8, 1)]
    passed = runs.pass_islands(found, F.lit(2), "label", "blue").where("selected")
    assert [(r.first, r.m) for r in passed.withColumn("m", runs.middle()).collect()] == [(0, 1)]
    m = spark.createDataFrame([(10, 11), (30, 4)], "first int, length int").select(runs.middle().alias("m")).collect()
    assert [r.m for r in m] == [15, 32]


def test_similarity_and_subsample(spark):
    rows = [(1, f / 10, f, f, 100.0 + 20 * i, 100.0, 400.0 + 200 * i, 1000) for i, f in enumerate((0, 5, 16, 20, 30))]
    df = spark.createDataFrame(rows, "video_id int, time_sec double, frame_idx int, row_id int, cx double, cy double, area double, width int")
    assert [r.frame_idx for r in runs.similarity_filter(df, ["video_id"], 1.0, 0.05, 0.1).orderBy("frame_idx").collect()] == [0, 20]
    assert [r.frame_idx for r in runs.subsample(df, ["video_id"], 1.5).orderBy("frame_idx").collect()] == [0, 16]


def test_heuristics_reasons(spark):
    objects = frame(spark, obj(1, (10, 10, 20, 20), 0.9), obj(2, (10, 10, 20, 20), 0.5), obj(3, (10, 10, 50, 20), 0.9), obj(4, (0, 0, 90, 90), 0.9), obj(5, (0, 0, 10, 10), 0.9, frame=2))
    got = by_row(filters.heuristics(objects, frame(spark, hand(9, (18, 18, 48, 48)))))
    assert got[1].passed_heuristics and got[2].heuristics_fail_reasons == "low_confidence" and "aspect_ratio_out_of_range" in got[3].heuristics_fail_reasons
    assert "object_too_large_relative_to_hand" in got[4].heuristics_fail_reasons and got[5].heuristics_fail_reasons == "no_hand_in_frame"


def test_participant_split():
    names = [f"P{i}" for i in range(5)]
    a, b = dataset.split_participants(names, 0.2, 42), dataset.split_participants(names[::-1], 0.2, 42)
    assert a == b and list(a.values()).count("val") == 1 and dataset.split_participants(["x"], 0.5, 1) == {"x": "train"}


def test_coco_tables(spark):
    df = spark.createDataFrame([("train", 7, 3, 640, 480, 10, 12, 30, 32, 1), ("train", 7, 1003, 640, 480, 0, 0, 5, 5, 2)], "split string, video_id int, frame_idx int, width int, height int, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, row_id int")
    images, ann = dataset.coco_tables(df)
    assert [r.bbox for r in ann.orderBy("annotation_id").collect()][0] == [10.0, 12.0, 20.0, 20.0]
    assert sorted(r.file_name for r in images.collect()) == ["7_000003.png", "7_000003_1.png"]


def enumerate_segments(n, k, longest):
    if k == 1:
        return [[n]] if n <= longest else []
    return [[d, *rest] for d in range(1, min(longest, n - k + 1) + 1) for rest in enumerate_segments(n - d, k - 1, longest)]


def test_hsmm_equals_enumeration():
    import math

    rng = np.random.default_rng(13)
    for n, k, start, longest in ((8, 3, 0, 8), (7, 4, 1, 4), (6, 1, 1, 6), (9, 5, 0, 3)):
        x = rng.integers(0, 2, n)
        m = refine.SegmentHSMM(k, (3.2, 2.5), (0.8, 0.6), 0.08, 0.2, start, 1.3, 0.7, longest, posterior=True)
        scores, paths = [], []
        for d in enumerate_segments(n, k, longest):
            seq = np.concatenate([np.full(v, (start + i) % 2) for i, v in enumerate(d)])
            emit = sum(math.log((0.08, 0.8)[s] if o else (0.92, 0.2)[s]) for o, s in zip(x, seq, strict=True))
            dur = sum((a := (3.2, 2.5)[(start + i) % 2]) * math.log(r := (0.8, 0.6)[(start + i) % 2]) - math.lgamma(a) + (a - 1) * math.log(v) - r * v for i, v in enumerate(d))
            scores.append(1.3 * emit + 0.7 * dur)
            paths.append(seq)
        got = m.predict(x)
        assert got.objective == pytest.approx(max(scores)) and got.sequence.tolist() == paths[int(np.argmax(scores))].tolist()
        w = np.exp(np.array(scores) - max(scores))
        assert np.allclose(got.posteriors, (w[:, None] * np.array(paths)).sum(axis=0) / w.sum())
    with pytest.raises(ValueError):
        refine.SegmentHSMM(2, (3, 3), (1, 1), 0.1, 0.1, longest=3).predict(np.zeros(10))


def test_transition_dp_equals_enumeration():
    rng = np.random.default_rng(4)
    dur = refine.Durations((2.0, 3.0), (1.0, 1.5), (2.0, 2.0), 1.0)
    for k in (0, 1, 3):
        p = rng.random(7)
        best = []
        for start in (0, 1):
            for d in enumerate_segments(7, k + 1, 7):
                seq = np.concatenate([np.full(v, (start + i) % 2) for i, v in enumerate(d)])
                q = np.clip(p, 1e-6, 1 - 1e-6)
                cost = -np.log(np.where(seq == 1, q, 1 - q)).sum()
                for i, v in enumerate(d):
                    s = (start + i) % 2
                    sigma = (2.0, 2.0)[s] if i in (0, k) else (1.0, 1.5)[s]
                    cost += 0.5 * ((v - (2.0, 3.0)[s]) / sigma) ** 2
                best.append(cost)
        got = refine.TransitionDP(k, dur).predict(p)
        assert got.objective == pytest.approx(min(best)) and got.transitions == k


def test_metrics_of_a_short_sequence(spark):
    df = spark.createDataFrame([(1, i, p, g) for i, (p, g) in enumerate(zip((0, 0, 1, 1, 0, 1), (0, 1, 1, 1, 0, 0), strict=True))], "video_id int, pos bigint, pred int, gt int")
    r = metrics.evaluate(df, ["video_id"], "pos").first()
    assert r.accuracy == pytest.approx(4 / 6) and (r.tp, r.fp, r.tn, r.fn) == (2, 1, 2, 1)
    assert r.f1_50 == pytest.approx(200 / 3) and r.edit == pytest.approx(50)
    empty = metrics.rates(spark.createDataFrame([(0, 0, 0, 0)], "tp int, fp int, tn int, fn int")).first()
    assert empty.macro_f1 == 0 and empty.accuracy == 0


def greedy_nms(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[5])):
        def over(k, r=r):
            w = max(0, min(k[2], r[2]) - max(k[0], r[0]) + 1) * max(0, min(k[3], r[3]) - max(k[1], r[1]) + 1)
            size = lambda b: (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
            return w / (size(k) + size(r) - w)

        if all(over(k) < threshold for k in kept):
            kept.append(r)
    return [r[5] for r in kept]


def test_suppression_equals_greedy(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        x, y = rng.randint(0, 80), rng.randint(0, 80)
        rows.append((x, y, x + rng.randint(5, 40), y + rng.randint(5, 40), rng.randint(1, 30) / 30, i))
    df = spark.createDataFrame([(i % 3, *r) for i, r in enumerate(rows)], "image int, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, confidence double, row_id int")
    got = proposals.suppressed(df, ["image"], 0.3).orderBy("image", "rank").collect()
    for k in range(3):
        assert [r.row_id for r in got if r.image == k] == greedy_nms(rows[k::3], 0.3)


def coco_by_hand(dets, truths, threshold):
    """Greedy matching of one image: dets (score, box), truths (box, crowd, ignored)."""
    def over(d, g, crowd):
        w = max(0.0, min(d[0] + d[2], g[0] + g[2]) - max(d[0], g[0])) * max(0.0, min(d[1] + d[3], g[1] + g[3]) - max(d[1], g[1]))
        return w / (d[2] * d[3] if crowd else d[2] * d[3] + g[2] * g[3] - w)

    order, taken, out = sorted(range(len(truths)), key=lambda i: truths[i][2]), set(), []
    for score, d in sorted(dets, key=lambda x: -x[0]):
        best, mark = None, min(threshold, 1 - 1e-10)
        for i in order:
            if i in taken and not truths[i][1]:
                continue
            if best is not None and not truths[best][2] and truths[i][2]:
                break
            if (v := over(d, truths[i][0], truths[i][1])) >= mark:
                best, mark = i, v
        if best is not None:
            taken.add(best)
        out.append((score, best is not None, best is not None and truths[best][2]))
    return out


def test_coco_matching_equals_greedy(spark):
    rng = random.Random(7)
    d, g, images = [], [], {}
    for image in range(25):
        dets, truths = [], []
        for j in range(rng.randint(0, 7)):
            box = [float(rng.randint(0, 30)), float(rng.randint(0, 30)), float(rng.randint(5, 25)), float(rng.randint(5, 25))]
            dets.append((rng.random(), box))
            d.append((image, 1, j, *box, dets[-1][0]))
        for j in range(rng.randint(0, 5)):
            box, crowd, ignore = [float(rng.randint(0, 30)), float(rng.randint(0, 30)), float(rng.randint(5, 25)), float(rng.randint(5, 25))], rng.random() < 0.2, rng.random() < 0.2
            truths.append((box, crowd, crowd or ignore))
            g.append((image, 1, j, *box, box[2] * box[3], int(crowd), int(ignore)))
        images[image] = dets, truths
    dd = spark.createDataFrame(d, "image_id bigint, category_id bigint, det_id bigint, x double, y double, w double, h double, score double")
    gg = spark.createDataFrame(g, "image_id bigint, category_id bigint, gt_id bigint, x double, y double, w double, h double, area double, iscrowd int, gt_ignore int")
    got = e.coco_match(dd, gg, thresholds=(0.3, 0.6)).collect()
    for image, (dets, truths) in images.items():
        for threshold in (0.3, 0.6):
            mine = [(r.score, r.matched, r.ignored) for r in sorted(got, key=lambda r: r["rank"]) if r.image_id == image and r.threshold == threshold]
            assert mine == coco_by_hand(dets, truths, threshold)


def test_masks():
    rng = np.random.default_rng(2)
    for _ in range(30):
        h, w = rng.integers(1, 9, 2)
        a, b = rng.random((h, w)) < 0.5, rng.random((h, w)) < 0.4
        ca, cb = masks.encode(a), masks.encode(b)
        assert np.array_equal(masks.decode(ca, h, w), a) and masks.from_string(masks.to_string(ca)) == ca
        assert np.array_equal(masks.decode(masks.merge([ca, cb], h, w, True), h, w), a & b)
        assert masks.iou(ca, cb) == pytest.approx((a & b).sum() / max(1, (a | b).sum()))
        ys, xs = np.nonzero(a)
        x, y, bw, bh = masks.bounds(ca, int(h))
        if len(xs):
            assert (x, x + bw - 1) == (xs.min(), xs.max()) and y <= ys.min() and y + bh - 1 >= ys.max()


def test_mask_area(spark):
    assert spark.createDataFrame([([2, 3, 1, 4],)], "c array<int>").select(masks.area(F.col("c")).alias("a")).first().a == 7


def test_parsing(spark):
    df = spark.createDataFrame([("a/b/P12/clip 3.MP4", "Yes"), ("x", "maybe"), ("", None)], "p string, b string")
    got = df.select(parsing.first_number(F.col("p")).alias("n"), parsing.stem(F.col("p")).alias("s"), parsing.suffix(F.col("p")).alias("e"), parsing.participant(F.col("p")).alias("who"), parsing.token(F.col("p")).alias("t"), parsing.tolerant_bool(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(12, "clip 3", ".mp4", "P12", "a_b_P12_clip_3_MP4", True), (None, "x", "", "unknown", "x", None), (None, "", "", "unknown", "", False)]


def test_box_conventions(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0)], "bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, q_x1 double, q_y1 double, q_x2 double, q_y2 double")
    a, b = boxes.box(), boxes.box("q_")
    back = boxes.decode(a, *boxes.encode(a, b))
    r = df.select(boxes.iou(a, b).alias("i"), boxes.iou_pixels(a, b).alias("p"), boxes.coverage(a, b).alias("c"), boxes.centre_distance(a, b).alias("d"), back.x1.alias("x")).first()
    assert (r.i, r.p, r.c, r.d) == pytest.approx((1 / 3, 66 / 176, 66 / 121, 5.0)) and r.x == pytest.approx(5.0)
    assert spark.range(1).select(labels.probability(F.lit(1.0)).alias("a"), labels.probability(F.lit(70.0)).alias("b"), labels.probability(F.lit(None).cast("double")).alias("c")).first() == (1.0, 0.7, 0.0)
