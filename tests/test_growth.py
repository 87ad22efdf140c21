"""Steps whose work once grew faster than their input: each is done once, and results stay those of the plain way."""

import io
import random
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from holdfast.operators import detection_eval, filters, matching, refine, tracking
from holdfast.operators.streams import whole_groups
from holdfast.plans import batch
from holdfast.plans.workflow import PipelineConfig
from holdfast.queries.detections import det

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_best_candidate_is_found_once_below_filters(spark):
    df = det(spark, SMALL)
    hands, objects = df.where("detection_type = 'hand'"), df.where("detection_type = 'object'")
    kept = filters.heuristics(objects, hands, 60, (0.5, 2.0), True, 1.5, 0.4).where("passed_heuristics").select("row_id", "hand_row_id", "matched_hand_iou")
    assert plan(kept).count("array_min(") == 1
    truths = hands.select("video_id", "frame_number", F.col("row_id").alias("gt_id"), *[F.col(f"bbox_{k}").alias(f"gt_{k}") for k in ("x1", "y1", "x2", "y2")])
    over = matching.overlaps(df, truths, ["video_id", "frame_number"]).where("overlap > 0.5 and gt_id % 2 = 0").select("row_id", "gt_id", "overlap")
    assert plan(over).count("array_min(") == 1


def test_all_conditions_of_hands_are_summed_in_one_sort(spark, monkeypatch):
    sorted_rows = []
    plain = detection_eval.prefix_sums
    monkeypatch.setattr(detection_eval, "prefix_sums", lambda df, *rest: sorted_rows.append(df.count()) or plain(df, *rest))
    dets = [(v, i, v % 2, 10 * i, 0, 10 * i + 20, 20, float((i * 7 + v) % 5), i % 3) for v in range(4) for i in range(6)]
    d = spark.createDataFrame(dets, "video_id int, det_id int, class int, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, confidence double, state int")
    truths = [(v, i, v % 2, 10 * i, 0, 10 * i + 20, 20, i == 2, (i + v) % 3) for v in range(4) for i in range(0, 6, 2)]
    g = spark.createDataFrame(truths, "video_id int, gt_id int, class int, gt_x1 int, gt_y1 int, gt_x2 int, gt_y2 int, gt_difficult boolean, gt_state int")
    tests = {"": F.lit(True), "state": F.col("state") == F.col("gt_state"), "never": F.lit(None).cast("boolean")}
    got = {(r["name"], r["class"]): r["ap"] for r in detection_eval.average_precision_of_tests(d, g, ["video_id"], ["class"], tests, 0.3).collect()}
    assert sorted_rows == [len(dets)]
    want = {}
    for name, test in tests.items():
        curve = detection_eval.precision_curve(detection_eval.voc_hits(d, g.drop("class"), ["video_id"], 0.3, test), g, ["class"])
        want |= {(name, r["class"]): r["ap"] for r in detection_eval.average_precision(curve, ["class"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert 0 < got["", 0] and got["never", 1] == 0


def test_regions_are_dealt_to_few_cells(spark):
    from holdfast.operators import grid

    boxes = [(v, i, 37 * i % 400, 53 * i % 250, 37 * i % 400 + 90 + i % 100, 53 * i % 250 + 80 + i % 90) for v in range(3) for i in range(200)]
    truths = spark.createDataFrame(boxes, "image_id int, gt_id int, gt_x1 int, gt_y1 int, gt_x2 int, gt_y2 int")
    side = grid.side_for(truths)
    assert side > grid.CELL and grid.side_for(truths.limit(0)) == grid.CELL
    from holdfast.functions.boxes import box

    assert grid._dealt(truths, box("gt_"), side).count() < 2 * len(boxes) < grid._dealt(truths, box("gt_"), grid.CELL).count()
    regions = truths.toDF("image_id", "anchor_id", *[f"bbox_{k}" for k in ("x1", "y1", "x2", "y2")])
    few, many = (grid.with_truths(regions, truths, "image_id", s).orderBy("anchor_id", "image_id", "gt_id", "overlap").collect() for s in (None, grid.CELL))
    assert few == many


def test_masks_of_a_batch_are_compared_without_lambdas(spark):
    from holdfast.functions import masks
    from holdfast.queries import QUERIES

    assert "aggregate(" not in plan(QUERIES["mask_merges"](spark, SMALL))
    rows = [([0, 3, 2], [2, 3]), ([5], [0, 5]), ([1, 0, 2, 2], [4, 1, 0]), ([], []), ([0], []), (None, [1]), ([1, 2], [4]), ([1, None], [1])]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").coalesce(1)
    a, b = F.col("a"), F.col("b")
    got = df.select(masks.compared(a, b).alias("m")).select("m.united", "m.shared_pixels", F.expr("case when m.shared_pixels > 0 then m.shared_pixels / m.either_pixels else 0D end").alias("iou"), F.col("m.united").isNull().alias("none")).collect()
    want = df.select(masks.merged(a, b).alias("united"), masks.area(masks.merged(a, b, True)).alias("shared_pixels"), masks.overlap(a, b).alias("iou")).collect()
    assert [r.united for r in got] == [r.united for r in want] and [r.shared_pixels for r in got] == [r.shared_pixels for r in want]
    assert [r.iou for r in got if not r.none] == [r.iou for r in want if r.iou is not None]


TABLE = "frame_id,detection_type,bbox_x1,bbox_y1,bbox_x2,bbox_y2\n1.png,hand,1,2,3,4\n"


def test_only_wanted_datasets_are_read(spark, tmp_path):
    for key, text in (("a", TABLE), ("b", "frame_id\n1.png\n"), ("c", TABLE.replace(",1,2,", ",1,x,"))):
        (tmp_path / "in" / key).mkdir(parents=True)
        (tmp_path / "in" / key / "detections_full.csv").write_text(text)
    batch.postprocess(spark, f"{tmp_path}/in", f"{tmp_path}/out", (100, 100), keys=["a"])
    batch.postprocess(spark, f"{tmp_path}/in", f"{tmp_path}/out", (100, 100), keys=["a"], skip_existing=True)
    assert [r.dataset_key for r in spark.read.option("header", True).csv(f"{tmp_path}/out").collect()] == ["a"]


def test_detections_are_parsed_once(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "detections_full.csv").write_text(TABLE)
    labels = batch.labelled(batch.detections(spark, f"{tmp_path}"), (100, 100), PipelineConfig(object_size=None, smaller_factor=None))
    assert plan(labels).count("Relation [") == 1 and "Join" not in plan(labels)
    assert [tuple(r) for r in labels.select("dataset_key", "video_id", "frame_number").collect()] == [("a", 0, 1)]


def test_any_number_of_orders_of_columns(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "detections_full.csv").write_text("\n".join(",".join(x[i:] + x[:i]) for x in (r.split(",") for r in TABLE.split())))
    few = sorted(map(str, batch.detections(spark, f"{tmp_path}").collect()))
    monkeypatch.setattr(batch, "LAYOUTS", 2)
    assert few == sorted(map(str, batch.detections(spark, f"{tmp_path}").collect())) and len(few) == 3


def test_a_batch_of_frames_is_annotated_as_rows_are(spark):
    rng = random.Random(5)
    rows, row = [], 0
    for v, number in ((v, n) for v in (None, 1, 2) for n in range(150)):
        for i in range(rng.choice([1, 2, 4])):
            row += 1
            x, y = rng.randrange(0, 40), rng.randrange(0, 40)
            label = rng.choice(["Portable Object", "No Contact", "Stationary Object", None])
            rows.append((v, number // 2, f"{number}.png", row, rng.choice(["hand", "object"]), x, y, x + 40, y + 40, rng.choice([None, 90.0, 0.9, 50.0]), label, rng.choice(["NA", "NA", None, "experimenter"]), rng.choice([True, False, None])))
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    config, want = tracking.BridgeConfig(max_missed=3, confirm=1).clamped(), []
    for _, video in groupby(rows, key=lambda r: r[0]):
        want += [r[3:] for r in tracking.annotate(list(video), tracking.BridgeState(), config)[0]]
    got, state, video = [], tracking.BridgeState(), None
    whole = pa.RecordBatch.from_arrays(columns, names=tracking.NEEDED)
    for batch in whole_groups((whole.slice(i, 100) for i in range(0, len(rows), 100)), tracking.NEEDED[:3]):
        added, state, video = tracking.annotated_batch(batch, state, video, config)
        got += list(zip(*(c.to_pylist() for c in added), strict=True))
    assert got == want and any(r[0] for r in got) and {r[4] for r in got} == {"inactive", "tracking", "lost"}


def test_short_sequences_score_segments_once(monkeypatch):
    rng = np.random.default_rng(1)
    for start in (0, 1):
        model = refine.SegmentHSMM(3, (2.0, 3.0), (0.3, 0.4), 0.2, 0.3, start_state=start, longest=20, posterior=True)
        for n in (3, 17, 40):
            x, found = rng.integers(0, 2, n), []
            for short in (512, 0):
                monkeypatch.setattr(refine, "SHORT", short)
                found.append(model.predict(x))
            assert found[0].objective == found[1].objective and found[0].segments == found[1].segments and (found[0].posteriors == found[1].posteriors).all()


def test_first_truths_are_judged_without_lambdas(spark, monkeypatch):
    rng, names = random.Random(8), ("x1", "y1", "x2", "y2")
    box = lambda: (x := rng.randrange(30), y := rng.randrange(30), x + rng.randrange(9, 20), y + rng.randrange(9, 20))
    dets = [(rng.choice([None, *range(7)]), i, *box()) for i in range(60)]
    truths = [(v, 9 * i % 10, *b, rng.choice([None, "a"])) for v in (*range(6), None) for i in range(v or 3) for b in [box()] * (1 + i % 2)]
    d = spark.createDataFrame(dets, "v int, det_id int, " + ", ".join(f"bbox_{k} int" for k in names))
    g = spark.createDataFrame(truths, "v int, gt_id int, " + ", ".join(f"gt_{k} int" for k in names) + ", gt_side string")
    over = lambda a, b: (w := max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1) * max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)) / ((a[2] - a[0] + 1) * (a[3] - a[1] + 1) + (b[2] - b[0] + 1) * (b[3] - b[1] + 1) - w)
    want = {}
    for v, i, *a in dets:
        found = min(((-over(a, b), t, side is not None, side) for n, t, *b, side in truths if v is not None and n == v), default=None)
        want[i] = (found[1], -found[0], found[3]) if found else (None, None, None)
    for first in (1, matching.FIRST, 12):
        monkeypatch.setattr(matching, "FIRST", first)
        out = matching.overlaps(d, g, ["v"], extra=("gt_side",))
        assert {r.det_id: (r.gt_id, r.overlap, r.gt_side) for r in out.collect()} == want
        assert plan(out).count("transform(") == 1 and "transform(slice(__truths" in plan(out)


def test_videos_are_made_from_single_frames(spark, tmp_path, monkeypatch):
    """A task gets frames in order, no rows of whole videos, and holds few bytes of those it made; a video may span batches."""
    from holdfast.queries import videos
    from holdfast.sources import avi, frames

    spark.range(3000).selectExpr("(id * 7919) % 3000 as o_orderkey", "if(id % 3 = 0, 'F', 'O') as o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    made, plain = [], frames.write
    monkeypatch.setattr(frames, "write", lambda df, *rest, **options: made.append(df) or plain(df, *rest, **options))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        read = videos.video_frames(spark, str(tmp_path))
        got = {(r.video_id, r.frame_idx): r.image for r in read.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = videos._frames(spark, str(tmp_path)).selectExpr("video_id", "frame_number as i", "md5(concat_ws(':', video_id, frame_number, gt)) as image").collect()
    assert got == {(r.video_id, r.i): r.image for r in want} and len(got) == 3000
    assert "collect_list" not in plan(made[0])
    monkeypatch.setattr(frames, "BATCH", 1000)
    rows = [pa.RecordBatch.from_pydict({"video_id": [str(i // 50)] * 10, "image": [f"{i}:{k}" for k in range(10)]}) for i in range(0, 500, 10)]
    taken = []
    out = videos._made(taken.append(i) or b for i, b in enumerate(rows))
    assert next(out).num_rows == 1 and len(taken) == 6
    rest = [x for b in out for x in b.column("content").to_pylist()]
    assert len(rest) == 9 and all(len(avi.Avi(io.BytesIO(x))) == 50 for x in rest)
