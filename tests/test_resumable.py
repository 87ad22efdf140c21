"""Workflows go on where they stopped, and a failed dataset is a row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from holdfast.plans import resumable
from holdfast.plans.resumable import Stage, Workflow


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "dataset_key string")


def rows(df):
    return {(r.stage, r.dataset_key): (r.status, r.error, r.n_rows) for r in df.collect()}


def test_a_run_resumes(spark, tmp_path):
    done, broken = [], {"twice"}

    def first(due, earlier):
        done.append(("first", sorted(r.dataset_key for r in due.collect())))
        return due.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))

    def second(due, earlier):
        done.append(("second", sorted(r.dataset_key for r in due.collect())))
        if "twice" in broken:
            raise KeyboardInterrupt  # as if the driver were killed
        return earlier("first").groupBy("dataset_key").agg(F.sum("n").alias("total"))

    flow = Workflow(spark, f"{tmp_path}/run", [Stage("first", first), Stage("second", second, ("first",))])
    with pytest.raises(KeyboardInterrupt):
        flow.run(keys(spark, "a", "b"))
    assert rows(flow.manifest()) == {("first", "a"): ("success", None, 2), ("first", "b"): ("success", None, 2)}
    broken.clear()
    flow = Workflow(spark, f"{tmp_path}/run", flow.stages)
    assert rows(flow.run(keys(spark, "a", "b", "c")))["second", "c"] == ("success", None, 1)
    assert done == [("first", ["a", "b"]), ("second", ["a", "b"]), ("first", ["c"]), ("second", ["a", "b", "c"])]
    assert {r.dataset_key: r.total for r in flow.output("second").collect()} == {"a": 3, "b": 3, "c": 3}
    done.clear()
    flow.run(keys(spark, "a", "b", "c"))
    assert not done
    flow.run(keys(spark, "b"), recompute=True)
    assert done == [("first", ["b"]), ("second", ["b"])] and flow.output("first").count() == 6


def test_failures_are_rows(spark, tmp_path):
    bad = {"d3", "d5"}

    def work(due, earlier):
        return due.where("dataset_key <> 'empty'").withColumn("n", F.when(F.col("dataset_key").isin(sorted(bad)) if bad else F.lit(False), F.raise_error(F.concat(F.lit("broken "), "dataset_key"))).otherwise(1))

    flow = Workflow(spark, f"{tmp_path}/run", [Stage("one", work), Stage("two", lambda due, earlier: earlier("one"), ("one",))])
    names = [f"d{i}" for i in range(8)] + ["empty"]
    out = rows(flow.run(keys(spark, *names)))
    assert {k for (s, k), v in out.items() if s == "one" and v[0] == "failed"} == bad | {"empty"}
    assert "broken d3" in out["one", "d3"][1] and out["one", "empty"][1] == "no rows"
    assert {k for s, k in out if s == "two"} == set(names) - bad - {"empty"}
    bad.clear()
    out = rows(flow.run(keys(spark, *names)))
    assert out["one", "d3"] == ("success", None, 1) and out["two", "d5"] == ("success", None, 1)


def test_orders_of_stages(spark, tmp_path):
    none = lambda due, earlier: due
    for stages in ([Stage("a", none, ("b",)), Stage("b", none)], [Stage("a", none), Stage("a", none)]):
        with pytest.raises(ValueError, match="stages"):
            Workflow(spark, f"{tmp_path}", stages)


def test_contact_workflow(spark, tmp_path):
    head = "frame_id,frame_number,detection_type,bbox_x1,bbox_y1,bbox_x2,bbox_y2,confidence,contact_label,hand_side,blue_prop,is_filtered\n"
    hand = "{0:06d}.png,{0},hand,10,10,30,30,90,{1},Left,0.0,False\n"
    for key, labels in {"x": ["Portable Object", "No Contact"], "y": ["No Contact"] * 2, "bad": ["No Contact"]}.items():
        (tmp_path / "in" / key).mkdir(parents=True)
        (tmp_path / "in" / key / "detections_full.csv").write_text(head + "".join(hand.format(i + 1, v) for i, v in enumerate(labels)).replace(",90,", ",oops," if key == "bad" else ",90,"))
    truth = spark.createDataFrame([("x", 1, 1), ("x", 2, 1), ("y", 7, 0)], "dataset_key string, frame long, gt int")
    flow = resumable.contact_workflow(spark, f"{tmp_path}/in", truth, f"{tmp_path}/run", (100, 100), resumable.profile("tracking", strict=False))
    out = rows(flow.run(keys(spark, "x", "y", "bad", "missing")))
    assert out["labels", "x"][0] == out["labels", "y"][0] == out["metrics", "x"][0] == "success"
    assert "holds no double" in out["labels", "bad"][1] and out["labels", "missing"][0] == "failed" and out["metrics", "y"][1] == "labels and truth share no frame"
    total = {r.dataset: r.accuracy for r in resumable.summary(flow).collect()}
    assert total == {"x": 0.5, "__macro__": 0.5, "__weighted__": 0.5}
    with pytest.raises(ValueError, match="tracking"):
        resumable.profile("other")


def test_command_line_of_videos_and_workflows(spark, tmp_path, capsys):
    from holdfast.__main__ import main
    from holdfast.sources import avi

    (tmp_path / "videos").mkdir()
    (tmp_path / "videos" / "v.avi").write_bytes(avi.written([b"a", b"b"], 25, 4, 4))
    assert main(["preprocess", f"{tmp_path}/videos", "--output", f"{tmp_path}/images"], spark) == 0
    assert (tmp_path / "images" / "v" / "000002.png").read_bytes() == b"b"
    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "detections_full.csv").write_text("frame_id,frame_number,detection_type,bbox_x1,bbox_y1,bbox_x2,bbox_y2,contact_label,is_filtered\n1.png,1,hand,1,1,9,9,Portable Object,False\n")
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "x.csv").write_text("frame_number,gt_binary\n1,1\n")
    (tmp_path / "gt" / "y.csv").write_text("frame_number,gt_binary\n1,1\n")
    call = ["workflow", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--truth", f"{tmp_path}/gt", "--frame-size", "100", "100"]
    assert main(call, spark) == 1 and "y: labels" in capsys.readouterr().err
    assert main([*call, "--keys", "x"], spark) == 0


def test_documents_of_a_bounded_size(spark, tmp_path):
    from holdfast.sources import annotations

    images = spark.createDataFrame([(s, i, f"{s}{i}.png", 9, 9) for s in ("train", None) for i in range(1, 8)], "split string, image_id int, file_name string, width int, height int")
    anns = images.where("image_id <> 4").selectExpr("split", "image_id as annotation_id", "image_id", "1 as category_id", "array(0d, 0d, 1d, 1d) as bbox", "1d as area", "0 as iscrowd")
    annotations.write_coco(images, anns, "thing", f"{tmp_path}/coco", most=3)
    for split in ("train", "__HIVE_DEFAULT_PARTITION__"):
        assert len([f for f in (tmp_path / "coco" / f"split={split}").iterdir() if f.name.startswith("part")]) == 3
        read = annotations.coco(spark, f"{tmp_path}/coco/split={split}")
        assert read["images"].count() == 7 and sorted(r.image_id for r in read["annotations"].collect()) == [1, 2, 3, 5, 6, 7]


def test_refined_labels_are_exported(spark, tmp_path):
    from holdfast.operators import refine

    df = spark.createDataFrame([(v, i, int(2 <= i < 7 and i != 4), int(2 <= i < 7)) for v in (1, 2) for i in range(10)], "video_id long, pos long, pred int, gt int")
    model = refine.SegmentHSMM(3, (4.0, 4.0), (1.0, 1.0), 0.1, 0.1, posterior=True)
    refine.export(df, refine.refine(df, model), f"{tmp_path}/out")
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out/refined").where("video_id = 2").collect()
    assert len(rows) == 10 and {r.pos for r in rows if r.refined == "1"} == {str(i) for i in range(2, 7)} and all(0 <= float(r.posterior) <= 1 for r in rows)
    (first, second) = spark.read.option("header", True).csv(f"{tmp_path}/out/metrics").orderBy("video_id").collect()
    assert (first.before, first.after, second.status, second.n_segments) == ("0.9", "1.0", "ok", "3")
    sums = refine.log_likelihood_sums(df, model).where("video_id = 1 and pos = 9").first()
    from math import log

    assert sums.contact == pytest.approx(4 * log(0.9) + 6 * log(0.1)) and sums.free == pytest.approx(4 * log(0.1) + 6 * log(0.9))
