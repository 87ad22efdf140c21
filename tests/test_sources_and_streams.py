"""Readers, sinks, the detector hook and streams."""

import json

import pytest
from pyspark.sql import functions as F

from holdfast.operators.tracking import BridgeConfig, tracking_bridge
from holdfast.sources import annotations, detector, files
from holdfast.streaming import events
from holdfast.streaming.bridge import stream_bridge

from .test_operators import DET, FAR, H, NEAR, hand, obj


def test_image_order_and_sequences(spark, tmp_path):
    for name in ("10_x.png", "2_b.png", "2_a.jpg", "cover.png", ".hidden.png", "note.txt"):
        (tmp_path / name).write_bytes(b"0")
    got = files.images(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["2_a.jpg", "2_b.png", "10_x.png", "cover.png"]
    assert [r.kind for r in files.sequences(spark, str(tmp_path)).collect()] == ["frames"]
    assert {r.number: r.path.rsplit("/", 1)[1] for r in files.frame_index(spark, str(tmp_path)).collect()} == {2: "2_a.jpg", 10: "10_x.png"}
    records = files.frame_records(spark, str(tmp_path), 0).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.frame_time_sec) for r in records][1] == (1, 1 / 30)
    (tmp_path / "v").mkdir()
    (tmp_path / "v/b.MP4").write_bytes(b"0")
    assert [r.kind for r in files.sequences(spark, str(tmp_path)).collect()] == ["video"]


def test_ground_truth_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("frame_number;gt_binary\n1;1\n3;0\n3;1\n")
    assert {r.frame: r.gt for r in files.ground_truth(spark, str(tmp_path / "a.csv")).collect()} == {1: 1, 3: 1}
    (tmp_path / "b.csv").write_text("video_id,frame_id,label,fps\nv,0_sv1.jpg,holding,30\nv,7_sv1.jpg,not_holding,30\n")
    assert {r.frame: r.gt for r in files.ground_truth(spark, str(tmp_path / "b.csv")).collect()} == {0: 1, 7: 0}
    (tmp_path / "c.csv").write_text("frame_number,gt_binary\n1,2\n")
    with pytest.raises(Exception, match="neither 0 nor 1"):
        files.ground_truth(spark, str(tmp_path / "c.csv")).collect()
    (tmp_path / "d.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="neither"):
        files.ground_truth(spark, str(tmp_path / "d.csv"))


def test_predictions_selected_and_pairs(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1/predictions.csv").write_text("frame_id,predicted_label\n1,1\n1,0\n2,0\n")
    (tmp_path / "v1/metadata.csv").write_text("frame_id,blue_glove_detected\n1,Yes\n2,0\n")
    p = str(tmp_path / "v1/predictions.csv")
    assert {r.frame_id: r.predicted_label for r in files.selected(spark, p).collect()} == {1: 1, 2: 0}
    with pytest.raises(Exception, match="duplicate"):
        files.selected(spark, p, True).collect()
    assert [r.blue_glove_detected for r in files.metadata(spark, str(tmp_path / "v1/metadata.csv")).orderBy("frame_id").collect()] == [True, False]
    assert [r.video_id for r in files.prediction_pairs(spark, str(tmp_path)).collect()] == ["v1"]
    (tmp_path / "v1/metadata.csv").unlink()
    with pytest.raises(Exception, match="no metadata.csv"):
        files.prediction_pairs(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="lacks"):
        files.manifest(spark, p)


def test_table_comparison(spark):
    a = spark.createDataFrame([(1, 0.5, "x"), (2, float("nan"), None)], "k int, v double, s string")
    assert files.same_tables(a, spark.createDataFrame([(2, float("nan"), None), (1, 0.5000001, "x")], a.schema))
    assert not files.same_tables(a, spark.createDataFrame([(2, float("nan"), None), (1, 0.6, "x")], a.schema))


def test_voc_and_coco(spark, tmp_path):
    (tmp_path / "i1.xml").write_text("<annotation><object><name>Hand</name><difficult>0</difficult><bndbox><xmin>1</xmin><ymin>0</ymin><xmax>20</xmax><ymax>30</ymax></bndbox><contactstate>3</contactstate><handside>None</handside><magnitude>500</magnitude></object><object><name>targetobject</name><bndbox><xmin>5</xmin><ymin>5</ymin><xmax>9</xmax><ymax>9</ymax></bndbox></object></annotation>")
    got = annotations.voc_objects(spark, str(tmp_path / "i1.xml")).orderBy("name").collect()
    assert (got[0].image, got[0].bbox_x1, got[0].bbox_y1, got[0].bbox_x2, got[0].contactstate, got[0].handside, got[0].magnitude) == ("i1", 0.0, 0.0, 19.0, 3.0, 0.0, 0.5)
    lines = annotations.result_lines(spark.createDataFrame([("i1", 0.5, 0.0, 1.0, 9.0, 9.0)], "image string, score double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double"))
    lines.write.text(str(tmp_path / "r"))
    r = annotations.read_result_lines(spark, str(tmp_path / "r")).first()
    assert lines.first().value == "i1 0.500 1.0 2.0 10.0 10.0" and (r.bbox_x1, r.bbox_y2) == (0.0, 9.0)
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a", "width": 9, "height": 9}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 0}], "categories": [{"id": 1, "name": "x"}]}))
    tables = annotations.coco(spark, str(tmp_path / "c.json"))
    assert tables["annotations"].first().bbox == [1.0, 2.0, 3.0, 4.0]
    (tmp_path / "d.json").write_text(json.dumps([{"image_id": 2, "category_id": 1, "bbox": [0, 0, 2, 3], "score": 0.5}]))
    with pytest.raises(ValueError, match="image 2"):
        annotations.coco_results(spark, str(tmp_path / "d.json"), tables["images"])


def test_detector_is_made_once_a_task(spark):
    def factory():
        made = []

        def run(content):
            made.append(1)
            return [("hand", 0.0, 0.0, 1.0, 1.0, float(len(made)), 3, 0, 0.0, 0.0, 0.0, 0.0)]

        return run

    images = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary").coalesce(1)
    assert [r.confidence for r in detector.detect(images, factory).orderBy("path").collect()] == [1.0, 2.0]


def rows_of(n):
    out = []
    for f in range(1, n + 1):
        portable = f % 9 == 1
        out += [hand(10 * f, H, "Portable Object" if portable else "No Contact", frame=f, video=f % 2), hand(10 * f + 1, FAR, "No Contact", frame=f, video=f % 2)]
        if f % 4 != 3:
            out.append(obj(10 * f + 2, NEAR if f % 5 else FAR, frame=f, video=f % 2))
    return out


def test_stream_bridge_equals_batch(spark, tmp_path):
    config = BridgeConfig(max_missed=3, confirm=1)
    rows = rows_of(40)
    names = ("row_id", "tracking_promoted", "tracking_track_id", "tracking_missed_count", "tracking_state", "tracking_bbox_source", "tracking_bbox_x1")
    last = {v: max(r[1] for r in rows if r[0] == v) for v in (0, 1)}
    expected = {tuple(r[c] for c in names) for r in tracking_bridge(spark.createDataFrame(rows, DET), config).collect() if r.frame_number != last[r.video_id]}
    for k, part in enumerate((rows[:30], rows[30:61], rows[61:])):
        spark.createDataFrame(part[::-1], DET).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(DET).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{tmp_path}/in")
    query = stream_bridge(source, config, 3_600_000).writeStream.format("memory").queryName("bridged").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r[c] for c in names) for r in spark.table("bridged").collect()} == expected


def test_windowed_stream_equals_batch(spark, tmp_path):
    data = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", i % 3, "click" if i % 2 else "view", 1.5) for i, (h, m) in enumerate((h, m) for h in range(6) for m in range(0, 60, 7))]
    df = spark.createDataFrame(data, "event_id int, t string, user_id int, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    batch = {tuple(r) for r in events.windowed(events.read_events(spark, str(tmp_path), False)).collect()}
    stream = events.windowed(events.read_events(spark, str(tmp_path)))
    q = stream.writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("win").collect()} == batch
    assert events.first_seen(events.read_events(spark, str(tmp_path), False).unionAll(events.read_events(spark, str(tmp_path), False))).count() == len(data)
