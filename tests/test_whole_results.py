"""Results that must be whole whatever order, nulls or absent columns the input has."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from holdfast.operators import metrics, runs
from holdfast.plans import batch
from holdfast.sources import files

#: A run's own order of columns, none of which stands where FULL has it.
FOREIGN = "frame_id,frame_number,detection_type,bbox_x1,bbox_y1,bbox_x2,bbox_y2,confidence,contact_state,contact_label,hand_side,offset_x,offset_y,offset_mag,blue_prop,blue_glove_status,is_filtered,filtered_by"


def run_folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    hand = "{0:06d}.png,{0},hand,10,10,30.0,30,90.5,3,Portable Object,Left,0.5,0,0,0,participant,False,"
    thing = "{0:06d}.png,{0},object,12,12,28,28,95,,,,,,,,NA,False,"
    (tmp_path / "a" / "detections_full.csv").write_text("﻿" + "\n".join([FOREIGN, hand.format(1), thing.format(1), hand.format(2)]) + "\n")
    (tmp_path / "a" / "detections_condensed.csv").write_text("frame_id,frame_number,contact_label,source_hand\n000001.png,1,Stationary Object,Left\n")
    (tmp_path / "a" / "part-notes.csv").write_text("detection_type,frame_id\nhand,9.png\n")
    (tmp_path / "b" / "detections_full.csv").write_text('"bbox_y2",bbox_x2,bbox_y1,bbox_x1,detection_type, frame_id\n30,30,10,10,hand,f12.png\n31,31,11,11,object,f12.png\n')
    return f"{tmp_path}"


def test_detections_by_header(spark, tmp_path):
    rows = batch.detections(spark, run_folder(tmp_path)).collect()
    got = {(r.dataset_key, r.frame_number, r.row_id): r for r in rows}
    assert set(got) == {("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("b", 12, 1), ("b", 12, 2)}
    first = got["a", 1, 1]
    assert (first.frame_id, first.detection_type, first.bbox_x1, first.bbox_x2, first.confidence, first.contact_state, first.contact_label, first.offset_x, first.is_filtered) == ("000001.png", "hand", 10, 30, 90.5, 3, "Portable Object", 0.5, False)
    assert got["a", 1, 2].contact_label is None and got["a", 1, 2].contact_state is None
    other = got["b", 12, 1]
    assert (other.bbox_x1, other.bbox_y2, other.confidence, other.is_filtered, other.video_id, other.frame_id) == (10, 30, None, False, 0, "f12.png")


def test_labels_of_a_foreign_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root = run_folder(tmp_path / "in")
    batch.postprocess(spark, root, f"{tmp_path}/out", (100, 100), keys=["a"])
    assert {(r.dataset_key, r.frame_number, r.contact_label) for r in spark.read.option("header", True).csv(f"{tmp_path}/out").collect()} == {("a", "1", "Portable Object"), ("a", "2", "Portable Object")}


def test_detections_that_break_the_contract(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        batch.detections(spark, f"{tmp_path}")
    (tmp_path / "detections_full.csv").write_text("frame_id,detection_type,bbox_x1,bbox_y1,bbox_x2\n")
    with pytest.raises(ValueError, match="bbox_y2"):
        batch.detections(spark, f"{tmp_path}")
    (tmp_path / "detections_full.csv").write_text("frame_id,detection_type,bbox_x1,bbox_y1,bbox_x2,bbox_y2\n1.png,hand,1,2,x,4\n")
    with pytest.raises(Exception, match="bbox_x2 holds no bigint"):
        batch.detections(spark, f"{tmp_path}").collect()


def test_null_keys_stay(spark):
    rows = [(k, j, i, None if i == 3 else 1) for i in range(40) for k, j in [(None, 1), ("a", None), (None, None), ("a", 1)]]
    df = spark.createDataFrame(rows, "k string, j int, i int, v int").repartition(7)
    ranks = runs.ranked(df, ["k", "j"], ["i"], "nth").collect()
    assert len(ranks) == len(rows) and all(r.nth == r.i for r in ranks)
    sums = runs.prefix_sums(df, ["k", "j"], ["i"], {"s": "v"}).collect()
    assert len(sums) == len(rows) and all(r.s == r.i + 1 - (r.i >= 3) for r in sums)


def test_a_null_label_is_a_step(spark):
    schema = "k int, label int, start long, end long, nth long"
    one = spark.createDataFrame([(1, None, 0, 2, 0), (1, 3, 2, 4, 1)], schema)
    two = spark.createDataFrame([(1, 3, 2, 4, 0)], schema)
    assert metrics.edit_score(one, two, ["k"]).first().edit == 50
    assert metrics.edit_score(one, one, ["k"]).first().edit == 100
    words = spark.createDataFrame([(1, "null", 0, 2, 0)], schema.replace("label int", "label string"))
    null = spark.createDataFrame([(1, None, 0, 2, 0)], schema.replace("label int", "label string"))
    assert metrics.edit_score(words, null, ["k"]).first().edit == 0


def test_rows_without_a_time_are_not_kept(spark):
    df = spark.createDataFrame([(1, t, i, i) for i, t in enumerate([None, 0.0, 1.0, 2.5, None])], "v int, time_sec double, frame_idx int, row_id int")
    assert sorted(r.row_id for r in runs.subsample(df, ["v"], 2.0).collect()) == [1, 3]


def test_the_first_line_is_that_of_the_first_file(spark, tmp_path):
    """The second part is the larger one, which Spark deals first."""
    (tmp_path / "part-0.csv").write_text("frame_id,predicted_label\n1,0\n2,1\n")
    (tmp_path / "part-1.csv").write_text("frame_id,predicted_label\n" + "".join(f"{i},1\n" for i in range(1, 3000)))
    (tmp_path / "part-2.csv").write_text("frame_id,predicted_label\n2,0\n")
    found = {r.frame_id: r.predicted_label for r in files.selected(spark, f"{tmp_path}").where("frame_id < 4").collect()}
    assert found == {1: 0, 2: 1, 3: 1}
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "a.csv").write_text("frame_number,gt_binary\n" + "".join(f"{i},1\n" for i in range(1, 3000)))
    (tmp_path / "gt" / "b.csv").write_text("frame_number,gt_binary\n5,0\n")
    truth = files.ground_truth(spark, f"{tmp_path}/gt").where(F.col("frame") == 5).first()
    assert truth.gt == 0


def test_missing_segments(spark):
    p = spark.createDataFrame([("a", f) for f in (1, 2, 3, 7, 7, 9)] + [("b", 1), ("c", None), (None, 4)], "k string, f int")
    g = spark.createDataFrame([("a", 2), ("a", 20), ("a", 21), ("b", 1), ("d", 5)], "k string, f int")
    got = {r.k: (r.missing_gt_segments, r.missing_pred_segments) for r in metrics.missing_segments(p, g, "k", "f").collect()}
    assert got == {"a": ("[[1,1,1],[3,3,1],[7,7,1],[9,9,1]]", "[[20,21,2]]"), "b": ("[]", "[]"), "d": ("[]", "[[5,5,1]]"), None: ("[[4,4,1]]", "[]")}


def test_truths_and_scores_from_files(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("frame_id,label\nx.png,Portable Object\n")
    with pytest.raises(ValueError, match="no frame"):
        files.truth_map(spark, f"{tmp_path}/gt.csv")
    (tmp_path / "gt.csv").write_text("frame_number;gt_binary\n3;1\n3;0\n")
    assert [tuple(r) for r in files.truth_map(spark, f"{tmp_path}/gt.csv").collect()] == [(3, 0)]
    (tmp_path / "m.csv").write_text("dataset_key,status,selected_csv,gt_csv,n_gt_total,accuracy,note,error\n7,success,a,b,3.0,0.5,x,\n,failed,,,oops,,y,bad\n")
    one, two = files.dataset_metrics(spark, f"{tmp_path}/m.csv").orderBy("status", ascending=False).collect()
    assert (one.dataset_key, one.n_gt_total, one.accuracy, one.note, one.error) == ("7", 3, 0.5, "x", None) and (two.dataset_key, two.n_gt_total, two.accuracy, two.error) == ("nan", None, None, "bad")
    (tmp_path / "m.csv").write_text("dataset_key,status\n")
    with pytest.raises(ValueError, match="gt_csv"):
        files.dataset_metrics(spark, f"{tmp_path}/m.csv")
