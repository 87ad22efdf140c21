"""Queries do the whole job: nothing of their tables is left out."""

import os

import pytest
from pyspark.sql import functions as F

from holdfast.queries import QUERIES
from holdfast.queries.detections import det

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", ["anchor_targets", "region_classes", "sampled_anchor_targets"])
def test_targets_of_all_images(name, spark):
    df = det(spark, SF).withColumn("image_id", F.col("video_id") * 512 + F.col("frame_number"))
    regions = {(r.image_id, r.row_id) for r in df.select("image_id", "row_id").collect()}
    without = df.groupBy("image_id").agg(F.max((F.col("detection_type") == "object").cast("int")).alias("t")).where("t = 0").count()
    found = {(r.image_id, r.anchor_id) for r in QUERIES[name](spark, SF).collect()}
    assert found == regions and without  # regions of images without truth, too


def test_pseudo_labels_split_all_videos(spark, tmp_path):
    first = QUERIES["pseudo_label_images"](spark, SF).select("video_id", "frame_idx").first()
    order = spark.read.parquet(f"{SF}/lineitem.parquet").where(F.col("l_orderkey") == first.video_id * 512 + first.frame_idx)
    video = spark.range(1100).select((F.col("id") * 512 + first.frame_idx).alias("key"))
    order.crossJoin(video).withColumn("l_orderkey", F.col("key").cast(order.schema["l_orderkey"].dataType)).drop("key").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = {(r.video_id, r.split) for r in QUERIES["pseudo_label_images"](spark, str(tmp_path)).select("video_id", "split").collect()}
    assert len(rows) == 1100
    assert sum(s == "val" for _, s in rows) == 220


def test_changepoints_and_batches_of_all_rows(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    batches = QUERIES["shape_batches"](spark, SF)
    assert batches.count() == li.select("l_orderkey", "l_linenumber").distinct().count()
    counts = [n for _, n in sorted((r.batch, r["count"]) for r in batches.groupBy("batch").count().collect())]
    assert set(counts[:-1]) == {16}
    frames = QUERIES["changepoint_frames"](spark, SF).where("label = 1")
    held = li.selectExpr("l_orderkey % 100 as video_id", "l_partkey % 200 as frame").where("frame < 120 + video_id").join(li.where("l_linenumber < 7 and l_suppkey % 5 > 0").selectExpr("l_orderkey % 100 as video_id", "l_partkey % 200 as frame").distinct(), ["video_id", "frame"], "left_semi")
    assert held.join(frames, ["video_id", "frame"], "left_anti").count() == 0


def test_ranks_need_no_single_task(spark):
    from holdfast.operators import runs

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1009).alias("v"))
    rows = runs.ranked(df, ["k"], ["v"], "at").collect()
    for k in range(3):
        assert [r["at"] for r in sorted((r for r in rows if r.k == k), key=lambda r: r.v)] == list(range(sum(r.k == k for r in rows)))
    shapes = df.select(F.col("v").alias("image_id"), F.lit(3).alias("width"), F.lit(2).alias("height"))
    plan = runs.batches_by_shape(shapes, 16)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[1]


def test_coco_means_over_all_thresholds_and_areas(spark):
    from holdfast.operators import detection_eval as e

    # A small truth found exactly, and a large one with an overlap of 77 / 123, which passes .50, .55 and .60.
    dets = spark.createDataFrame([(1, 1, 1, 0, 0, 10, 10, 0.9), (2, 1, 2, 23, 0, 100, 100, 0.8)], "image_id int, category_id int, det_id int, x int, y int, w int, h int, score double")
    truths = spark.createDataFrame([(1, 1, 1, 0, 0, 10, 10, 100.0, 0, 0), (2, 1, 2, 0, 0, 100, 100, 10000.0, 0, 0)], "image_id int, category_id int, gt_id int, x int, y int, w int, h int, area double, iscrowd int, gt_ignore int")
    ap = 0.3 + 0.7 * 51 / 101
    want = {"ap": ap, "ap50": 1, "ap75": 51 / 101, "ap_small": 1, "ap_medium": -1, "ap_large": 0.3, "ar_1": 0.65, "ar_10": 0.65, "ar_100": 0.65, "ar_small": 1, "ar_medium": -1, "ar_large": 0.3}
    assert e.coco_means(dets, truths).first().asDict() == pytest.approx(want)
    assert [r.asDict() for r in e.coco_means_by_category(dets, truths).collect()] == [pytest.approx({"category_id": 1, "ap": ap, "ap_small": 1, "ap_medium": -1, "ap_large": 0.3})]
    assert set(QUERIES["coco_average_precision"](spark, SF).columns) == set(want)
    assert QUERIES["coco_precision_by_category"](spark, SF).columns == ["category_id", "ap", "ap_small", "ap_medium", "ap_large"]


def test_annotations_of_all_objects(spark):
    n = det(spark, SF).where("detection_type = 'object'").count()
    assert QUERIES["coco_annotations"](spark, SF).count() == n
