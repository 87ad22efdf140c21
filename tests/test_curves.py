"""Average precision by blocks of sorted detections: nothing is dealt after the sort, and results are those of the curve's rows."""

import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import detection_eval as e

HITS = "class string, det_id int, confidence double, tp int, fp int"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def hits_and_truths(spark):
    rng, hits = random.Random(3), []
    for i in range(600):
        tp = int(rng.random() < 0.5)
        hits.append((rng.choice(["a", "a", "b", "never hit", "one", "no truth", None]), i, rng.choice([None, *(k / 20 for k in range(20))]), tp, int(not tp and rng.random() < 0.8)))
    hits = [(*h[:3], 0, 1) if h[0] == "never hit" else h for h in hits]
    truths = [(c, i, d) for c, n in (("a", 150), ("b", 90), ("never hit", 9), ("one", 1), (None, 4), ("no detection", 5)) for i in range(n) for d in (False, True, None)[: 1 + i % 3]]
    return spark.createDataFrame(hits, HITS).repartition(5), spark.createDataFrame(truths, "class string, gt_id int, gt_difficult boolean")


def as_dict(df):
    return {r["class"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("eleven", [False, True])
def test_blocks_give_what_the_curve_gives(spark, small_batches, eleven):
    hits, truths = hits_and_truths(spark)
    got = as_dict(e.average_precision_of_hits(hits, truths, ["class"], eleven).select("class", "ap"))
    want = as_dict(e.average_precision(e.precision_curve(hits, truths, ["class"]), ["class"], eleven).select("class", "ap"))
    assert got.keys() == want.keys() == {"a", "b", "never hit", "one"}
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 for k in want) and got["never hit"] == (0.0,) and got["a"][0] > 0


def test_blocks_give_the_best_threshold(spark, small_batches):
    hits, truths = hits_and_truths(spark)
    got, want = (as_dict(x) for x in (e.best_threshold_of_hits(hits, truths, ["class"]), e.best_threshold(e.precision_curve(hits, truths, ["class"]), ["class"])))
    assert got == want and len(got) == 4


def test_no_detections(spark):
    hits, truths = hits_and_truths(spark)
    assert not e.average_precision_of_hits(hits.limit(0), truths, ["class"]).collect()
    assert not e.best_threshold_of_hits(hits.limit(0), truths, ["class"]).collect()


def test_sorted_detections_are_not_dealt_again(spark, monkeypatch):
    """What stages write after the sort is blocks: fewer rows than detections, of which each is two bits."""
    written, plain = {}, e.staged
    monkeypatch.setattr(e, "prefix_sums", None)
    monkeypatch.setattr(e, "staged", lambda df, tag: written.setdefault(tag, plain(df, tag)))
    boxes = [(i // 20, i, "A " if i % 2 else "a", 10 * (i % 20), 0, 10 * (i % 20) + 20, 20, float(i * 7 % 11)) for i in range(400)]
    d = spark.createDataFrame(boxes, "image_id int, det_id int, class string, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, confidence double")
    g = d.where("det_id % 3 = 0").drop("confidence").withColumnsRenamed({"det_id": "gt_id", **{f"bbox_{k}": f"gt_{k}" for k in ("x1", "y1", "x2", "y2")}})
    out = e.class_average_precision(d, g.unionAll(g.withColumn("class", F.lit("c"))), "image_id").collect()
    assert {r["class"]: r.npos for r in out} == {"a": 134, "c": 134} and {r["class"]: r.ap > 0 for r in out} == {"a": True, "c": False}
    blocks = written["blocks"].collect()
    assert sum(b.n for b in blocks) == 400 and len(blocks) <= 8 and all(len(b.hit) == -(-b.n // 8) for b in blocks)


def test_ids_of_many_videos_stay_bigints(spark, tmp_path):
    """360 copies of sf0.1 with shifted keys have 105,480 videos."""
    from holdfast.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    few, many = ({}, {})
    for shift, out in ((0, few), (105_000, many)):
        rows.withColumn("l_orderkey", F.col("l_orderkey") + shift * 512).coalesce(1).write.parquet(f"{tmp_path}/{shift}/lineitem.parquet")
        out |= as_dict(QUERIES["scene_graph_average_precision"](spark, f"{tmp_path}/{shift}"))
    assert few == many and len(few) == 5
