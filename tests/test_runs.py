"""Configurations, videos through a decoder, runs over folders, the command line; and what the reworked operators promise."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holdfast.operators import dataset, detection_eval, matching, metrics, proposals, refine, runs, streams, tracking
from holdfast.plans import batch, config, workflow
from holdfast.sources import files, video


def test_configurations_round_trip(tmp_path):
    chosen = workflow.PipelineConfig(smaller_factor=None, strict=True, bridge=tracking.BridgeConfig(max_missed=3))
    config.save(chosen, f"{tmp_path}/a/c.json")
    assert config.load(workflow.PipelineConfig, f"{tmp_path}/a/c.json") == chosen
    assert config.from_dict(workflow.PipelineConfig, {"strict": True, "unknown": 1}) == workflow.PipelineConfig(strict=True)
    base = {"rate": 0.5, "train": {"size": 8, "name": "x"}}
    assert config.overridden(base, ["train.size", "16", "train.name", "y z"]) == {"rate": 0.5, "train": {"size": 16, "name": "y z"}}
    assert base["train"]["size"] == 8
    for pairs, error in ((["train.depth", "1"], KeyError), (["rate", "'a'"], ValueError), (["rate"], ValueError)):
        with pytest.raises(error):
            config.overridden(base, pairs)
    assert config.output_dir(None, "/data/videos/a.mp4") == "/data/videos/pipeline_output" and config.output_dir("/out", "x") == "/out"


def test_barcode_rows():
    assert config.barcode_rows([[0, 1], [0.5, 1.0]], ["a", "p"], ("p",)) == [("a", 0, 0.0), ("a", 1, 1.0), ("p", 0, 0.5), ("p", 1, 1.0)]
    for signals, names in (([[0, 1], [1]], ["a", "b"]), ([], []), ([[]], ["a"]), ([[0, 2]], ["a"]), ([[0]], ["a", "b"])):
        with pytest.raises(ValueError):
            config.barcode_rows(signals, names)


def decoder():
    def frames(path, content):
        if content == b"broken":
            raise OSError("no such codec")
        return (0.0 if b"?" in content else 10.0), ((content + str(i).encode(), 4, 2) for i in range(3))

    return frames


def test_videos_through_a_decoder(spark, tmp_path):
    videos = spark.createDataFrame([("d/a.mp4", b"A", [0, 2]), ("d/b.mp4", b"B?", None), ("d/c.mp4", b"broken", None)], "path string, content binary, wanted array<bigint>").repartition(2)
    rows = {(r.video_id, r.frame_idx): r for r in video.decode(videos, decoder, wanted="wanted").collect()}
    assert set(rows) == {("a", 0), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("c", None)}
    assert rows["a", 2].frame_time_sec == 0.2 and rows["b", 2].fps == 30.0 and bytes(rows["a", 2].content) == b"A2" and "no such codec" in rows["c", None].error
    frames = video.decode(videos, decoder)
    for name, want in (("one_based", {"a/000001.png", "a/000003.png"}), ("zero_based", {"a/000000.png", "a/000002.png"}), ("legacy", {"0_a.png", "2_a.png"})):
        out = video.write_frames(frames, f"{tmp_path}/{name}", name).collect()
        assert sum(r.error is not None for r in out) == 1 and len(out) == 7
        assert all((tmp_path / name / w).read_bytes().startswith(b"A") for w in want)
    with pytest.raises(ValueError):
        video.write_frames(frames, str(tmp_path), "other")
    chosen = spark.createDataFrame([("a", 3), ("a", 9)], "video_id string, frame bigint")
    found = {r.frame: r for r in video.selected_from_folders(spark, chosen, f"{tmp_path}/one_based").collect()}
    assert found[3].path.endswith("a/000003.png") and found[9].error
    assert video.resolve_input(spark, f"{tmp_path}/one_based/a")[0] == "frames" and video.unsorted_images(spark, f"{tmp_path}/one_based/a").count() == 3


def test_command_line(spark, tmp_path, capsys):
    from holdfast.__main__ import main
    from holdfast.queries.detections import det

    names = [c.split()[0] for c in batch.FULL.split(", ")]
    rows = det(spark, "/root/testdata/sf0.001").where("video_id < 3").select(F.format_string("d%d", F.col("video_id") % 2).alias("dataset_key"), *[c.strip() for c in names])
    rows.write.option("header", True).partitionBy("dataset_key").csv(f"{tmp_path}/in")
    config.save(workflow.PipelineConfig(object_size=None), f"{tmp_path}/c.json")
    call = ["postprocess", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/c.json", "--set", "strategy", "portable_first", "--keys", "d0"]
    assert main(call, spark) == 0
    assert batch.done_keys(spark, f"{tmp_path}/out") == ["d0"]
    assert main([*call[:-1], "d0", "d1", "--skip-existing"], spark) == 0
    out = spark.read.option("header", True).csv(f"{tmp_path}/out")
    want = workflow.contact_labels(det(spark, "/root/testdata/sf0.001").where("video_id < 3"), (F.lit(1920), F.lit(1080)), workflow.PipelineConfig(object_size=None, strategy="portable_first"))
    key = lambda df: sorted((str(r.video_id), str(r.frame_number), r.contact_label, r.source_hand) for r in df.collect())
    assert key(out) == key(want)
    labels, truth = tmp_path / "predictions" / "x" / "detections_condensed.csv", tmp_path / "gt.csv"
    labels.parent.mkdir(parents=True)
    labels.write_text("frame_number,contact_label\n1,Portable Object\n2,No Contact\n3,Portable Object\n")
    truth.write_text("frame_number,gt_binary\n2,0\n3,0\n9,1\n")
    (tmp_path / "run_manifest.csv").write_text(f"dataset_key,gt_csv\nx,{truth}\ny,\n")
    capsys.readouterr()
    assert main(["evaluate", "--root", str(tmp_path), "--key", "x"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert (found["n_common"], found["accuracy"], found["tn"], found["fp"], found["frame_max"]) == (2, 0.5, 1, 1, 3)
    for given in ({}, {"condensed": str(labels), "root": str(tmp_path), "key": "x"}, {"condensed": str(labels)}, {"root": str(tmp_path), "key": "y"}):
        with pytest.raises((ValueError, FileNotFoundError)):
            batch.resolve(spark, **given)


def made_up_detector():
    def detect(content):
        n = int(content)
        hand = ("hand", 10.0, 10.0, 30.0, 30.0, 90.0, 3, 1, 0.0, 0.0, 0.0, 0.0)
        return [hand, ("object", 12.0, 12.0, 28.0, 28.0, 95.0, None, None, None, None, None, None)] if n % 2 else [hand[:6] + (0,) + hand[7:]]

    return detect


def test_command_line_from_images_to_labels(spark, tmp_path):
    from holdfast.__main__ import main

    (tmp_path / "frames").mkdir()
    for i in range(1, 5):
        (tmp_path / "frames" / f"{i:06d}.png").write_bytes(str(i).encode())
    call = ["detect", f"{tmp_path}/frames", "--output", f"{tmp_path}/det", "--detector", "tests.test_runs:made_up_detector", "--key", "a"]
    assert main(call, spark) == 0 and main([*call, "--skip-existing"], spark) == 0
    rows = batch.detections(spark, f"{tmp_path}/det").collect()
    assert len(rows) == 6 and {(r.frame_id, r.contact_label, r.hand_side) for r in rows if r.detection_type == "hand"} == {(f"{i:06d}.png", "Portable Object" if i % 2 else "No Contact", "Right") for i in range(1, 5)}
    assert main(["postprocess", f"{tmp_path}/det", "--output", f"{tmp_path}/out", "--frame-size", "100", "100"], spark) == 0
    out = {int(r.frame_number): r.contact_label for r in spark.read.option("header", True).csv(f"{tmp_path}/out").collect()}
    assert out == {i: "Portable Object" if i % 2 else "No Contact" for i in range(1, 5)}


def test_manifest_and_summary(spark):
    ready = batch.evaluation_manifest(spark.createDataFrame([("a", "1.csv"), ("b", "2.csv")], "dataset_key string, selected_csv string"), spark.createDataFrame([("a", "g.csv")], "dataset_key string, gt_csv string"))
    assert {r.dataset_key: r.status for r in ready.collect()} == {"a": "ready", "b": "missing_gt"}
    d = spark.createDataFrame([("a", "success", 2, 1, 0.5), ("b", "failed", None, None, None), ("c", "success", 1, 0, 1.0)], "dataset_key string, status string, fp int, fn int, accuracy double")
    row = batch.run_summary(d, spark.range(4), spark.range(0)).first().asDict()
    assert row == {"n_datasets_total": 3, "n_datasets_success": 2, "n_datasets_failed": 1, "fp_total": 3, "fn_total": 1, "mean_accuracy_success": 0.75, "n_frame_mismatches": 4, "n_selected_missing_gt_rows": 0}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from holdfast import staging

    def session(master, where=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: where or d), sparkContext=context)

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://x"):
        with pytest.raises(ValueError, match="share"):
            staging.shared_dir(session(master))
        assert staging.shared_dir(session(master, "hdfs://n/ck/")) == "hdfs://n/ck"
    assert staging.shared_dir(session("local[4]")).startswith("file://")


def test_edit_score_of_labels_with_several_characters(spark):
    seg = lambda rows: spark.createDataFrame(rows, "k int, label int, start int")
    score = lambda a, b: metrics.edit_score(seg(a), seg(b), ["k"]).first().edit
    assert score([(1, 10, 0)], [(1, 1, 0)]) == 0.0
    assert score([(1, 10, 0), (1, 1, 5)], [(1, 10, 0), (1, 11, 5)]) == 50.0
    assert score([(1, 10, 0)], [(1, 10, 3)]) == 100.0


def test_segments_meet_across_stretches(spark):
    rng = np.random.default_rng(9)
    cuts = [np.unique(np.concatenate([[0, 3000], rng.integers(1, 3000, 25)])) for _ in range(2)]
    segs = [[(1, int(rng.integers(1, 3)), int(a), int(b), i) for i, (a, b) in enumerate(zip(c, c[1:], strict=False))] for c in cuts]
    pred, gt = (spark.createDataFrame(x, "k int, label int, start int, end int, nth int") for x in segs)
    found = metrics.segmental_f1(pred, gt, ["k"]).first()
    for t in (0.1, 0.25, 0.5):
        hit = set()
        for _, label, a, b, _ in segs[0]:
            over = [(max(0, min(b, d) - max(a, c)) / (max(b, d) - min(a, c)), -n) for _, other, c, d, n in segs[1] if other == label]
            if over and max(over)[0] >= t:
                hit.add(-max(over)[1])
        assert found[f"f1_{round(t * 100)}"] == pytest.approx(200 * len(hit) / (len(segs[0]) + len(segs[1])))


def test_infeasible_is_a_status_and_bad_input_an_error(spark):
    df = spark.createDataFrame([(1, i, i % 2) for i in range(4)] + [(2, i, 1) for i in range(30)], "video_id bigint, pos bigint, pred int")
    out = {r.video_id: (r.status, r.refined) for r in refine.refine(df, refine.SegmentHSMM(9, (2.0, 3.0), (0.3, 0.4), 0.2, 0.3)).collect()}
    assert out[1] == ("infeasible", None) and out[2][0] == "ok" and out[2][1] in (0, 1)
    with pytest.raises(Exception, match="0 or 1"):
        refine.refine(df.withColumn("pred", F.lit(5)), refine.SegmentHSMM(2, (2.0, 3.0), (0.3, 0.4), 0.2, 0.3)).collect()


def test_posteriors_of_a_long_sequence_need_a_band(spark):
    import tracemalloc

    x = (np.arange(30_000) // 1700) % 2
    r = refine.SegmentHSMM(9, (32.0, 30.0), (0.1, 0.1), 0.1, 0.1, longest=4000, posterior=True)
    tracemalloc.start()
    x = x[:12_000]
    found = r.predict(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and np.isfinite(found.posteriors).all()


def test_groups_are_never_split():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 40, 500))
    table = pa.table({"k": pa.array([None if k == 0 else int(k) for k in keys]), "v": np.arange(500)})
    for size in (1, 7, 64, 500):
        out = list(streams.whole_groups(iter(table.to_batches(max_chunksize=size)), ["k"]))
        assert pa.Table.from_batches(out).equals(table)
        seen = [set(b.column("k").to_pylist()) for b in out]
        assert all(not (a & b) for i, a in enumerate(seen) for b in seen[:i])
    assert not list(streams.whole_groups(iter([]), ["k"]))


def test_running_sums_by_ranges(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 2003).alias("v"), (F.col("id") % 5).alias("x"))
    out = runs.prefix_sums(df, ["k"], [F.desc("v")], {"s": "x"}).collect()
    for k in range(3):
        rows = sorted((r for r in out if r.k == k), key=lambda r: -r.v)
        assert [r.s for r in rows] == np.cumsum([r.x for r in rows]).tolist()


def test_envelope_is_the_best_precision_from_there_on(spark):
    rng = np.random.default_rng(4)
    hits = [(int(i % 2), int(i), float(s), int(t), 1 - int(t)) for i, (s, t) in enumerate(zip(rng.random(400), rng.random(400) < 0.6, strict=True))]
    truths = spark.createDataFrame([(i % 2, i, False) for i in range(300)], "class int, gt_id int, gt_difficult boolean")
    got = detection_eval.precision_curve(spark.createDataFrame(hits, "class int, det_id int, confidence double, tp int, fp int"), truths, ["class"]).collect()
    for c in (0, 1):
        rows = sorted((r for r in got if r["class"] == c), key=lambda r: (-r.confidence, r.det_id))
        tp = np.cumsum([r.tp for r in rows])
        precision = tp / np.arange(1, len(rows) + 1)
        assert np.allclose([r.envelope for r in rows], np.maximum.accumulate(precision[::-1])[::-1])


def test_regions_without_truth_stay(spark):
    box = "x1 int, y1 int, x2 int, y2 int"
    rois = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (2, 2, 0, 0, 10, 10)], "image_id int, anchor_id int, " + box).withColumnsRenamed({k: f"bbox_{k}" for k in ("x1", "y1", "x2", "y2")})
    truths = spark.createDataFrame([(1, 7, 0, 0, 10, 10, 3)], "image_id int, gt_id int, " + box + ", gt_class int").withColumnsRenamed({k: f"gt_{k}" for k in ("x1", "y1", "x2", "y2")})
    assert {r.image_id: (r.gt_class, r.overlap) for r in proposals.truth_classes(rois, truths, "image_id").collect()} == {1: (3, 1.0), 2: (0, 0.0)}
    assert {r.image_id: (r.label, r.gt_id) for r in proposals.anchor_targets(rois, truths, "image_id").collect()} == {1: (1, 7), 2: (0, None)}
    assert matching.overlaps(rois.withColumnRenamed("anchor_id", "det_id"), truths, ["image_id"]).where("gt_id is null").count() == 1


def test_splits_and_subsets(spark):
    names = spark.range(50).select(F.format_string("p%d", "id").alias("p"))
    split = {r.p: r.split for r in dataset.split_by_rank(names.unionAll(names), "p", 0.2, 42).collect()}
    assert len(split) == 50 and sum(s == "val" for s in split.values()) == 10
    assert split == {r.p: r.split for r in dataset.split_by_rank(names.repartition(3), "p", 0.2, 42).collect()}
    assert [r.split for r in dataset.split_by_rank(names.limit(1), "p", 0.2, 42).collect()] == ["train"]
    assert dataset.subset(spark.range(5000), "minival", "id").count() == 100 and dataset.subset(spark.range(5000), "train", "id").count() == 5000


def test_untested_functions(spark, tmp_path):
    from holdfast.functions import images, parsing
    from holdfast.operators import filters

    blue, grey = np.full((4, 6, 3), (255, 0, 0), np.uint8), np.full((4, 6, 3), 90, np.uint8)
    mixed = np.concatenate([blue, grey], axis=1)
    assert images.blue_share(mixed, (0, 0, 12, 4)) == 0.5 and images.blue_share(mixed, (6, 0, 12, 4)) == 0 and images.blue_share(mixed, (3, 3, 3, 4)) == 0
    assert images.hsv(blue)[0, 0].tolist() == [120, 255, 255]
    assert images.crop_box(10, 6, 4) == (3, 1, 7, 5) and images.crop_box(10, 6, None) is None
    x = np.arange(60 * 3).reshape(6, 10, 3)
    assert np.array_equal(images.cropped(x, (3, 1, 7, 5), True), x[1:5, 3:7][::-1])
    assert images.blob([x, x[:2, :3]]).shape == (2, 6, 10, 3) and images.centred(x).dtype == np.float32
    for bad in (lambda: images.crop_box(3, 3, 4), lambda: images.cropped(x[:2], (3, 1, 7, 5)), lambda: filters.strategy("other")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        filters.strategy("kmeans")()
    assert filters.strategy("heuristics") is filters.heuristics
    registry = {"a": lambda s: s.range(2).withColumn("x", F.lit(1)), "b": lambda s: s.range(3)}
    assert files.combined(spark, "a+b", registry).groupBy("dataset").count().count() == 2
    with pytest.raises(KeyError):
        files.combined(spark, "c", registry)
    assert "| a | 1 |" in files.summary_markdown([{"k": "a", "n": 1}], "T") and json.loads(files.to_json({"b": 1})) == {"b": 1}
    (tmp_path / "v").mkdir()
    for n in ("b.MP4", "a.avi", ".c.mp4", "d.txt"):
        (tmp_path / "v" / n).write_bytes(b"v")
    assert [r.path.rsplit("/", 1)[-1] for r in files.videos(spark, f"{tmp_path}/v").collect()] == ["a.avi", "b.MP4"]
    assert spark.range(1).select(parsing.safe_float(F.lit("nan")).alias("x")).first().x is None
