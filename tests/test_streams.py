"""Streams by event time give what batches give, and forget sequences that are over."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import runs, tracking
from holdfast.streaming import sequences

from .test_sources_and_streams import DET, rows_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def stream(spark, tmp_path, parts, make, name):
    """What ``make`` gives of a stream of the parts, one micro-batch each; rows of state after the last."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(300)
    progress = query.recentProgress[-1]["stateOperators"][0]
    return spark.table(name).collect(), progress["numRowsTotal"]


def timed(spark, rows, schema, seconds):
    return spark.createDataFrame(rows, schema).withColumn("ts", sequences.at_seconds(seconds))


def beats(spark, schema, key, *seconds):
    """Rows that only move the watermark, one micro-batch each."""
    names = [f.name for f in schema.fields if f.name != "ts"]
    return [spark.createDataFrame([(0,) * 0 + tuple(0 if n == key else None for n in names)], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if f.name != "ts")).withColumn("ts", sequences.at_seconds(F.lit(s))) for s in seconds]


def detections(spark):
    rows = rows_of(40)
    df = timed(spark, rows, DET, F.col("frame_number") / 10.0)
    cut = sorted(rows, key=lambda r: r[1])
    random.Random(4).shuffle(head := cut[:30])
    return rows, [df.where(F.col("row_id").isin([r[3] for r in part])) for part in (head, cut[30:61], cut[61:])], df.schema


def test_bridge(spark, tmp_path):
    rows, parts, schema = detections(spark)
    config = tracking.BridgeConfig(max_missed=3, confirm=1)
    got, state = stream(spark, tmp_path, [*parts, *beats(spark, schema, "video_id", 60, 5000, 9000)], lambda s: sequences.stream_bridge(s, config, delay="1 second"), "bridge_by_time")
    names = [c.split()[0] for c in tracking.OUTPUT.split(", ")]
    expected = {tuple(r[c] for c in names) for r in tracking.tracking_bridge(spark.createDataFrame(rows, DET), config).collect()}
    assert len(got) == len(rows) and {tuple(r[c] for c in names) for r in got} == expected
    assert state == 0


def test_regions(spark, tmp_path):
    rows, parts, schema = detections(spark)
    got, state = stream(spark, tmp_path, [*parts, *beats(spark, schema, "video_id", 60, 5000, 9000)], lambda s: sequences.stream_regions(s, 2, delay="1 second"), "regions_by_time")
    assert sorted(map(tuple, got)) == sorted(map(tuple, tracking.temporal_regions(spark.createDataFrame(rows, DET), 2).collect()))
    assert {r.outcome for r in got} >= {"picked", "missed"} and state == 0


def boxes():
    rng = random.Random(8)
    return [(v, i / 4, i, 100 * v + i, rng.uniform(0, 400), rng.uniform(0, 300), rng.uniform(50, 5000), 440.0) for v in range(3) for i in range(60)]


BOXES = "v bigint, time_sec double, frame_idx bigint, row_id bigint, cx double, cy double, area double, width double"


@pytest.mark.parametrize("which", ["similarity", "subsample"])
def test_filters(spark, tmp_path, which):
    df = timed(spark, boxes(), BOXES, F.col("time_sec"))
    parts = [df.where(f"time_sec >= {a} and time_sec < {b}") for a, b in ((0, 4), (4, 5.5), (5.5, 99))]
    some, make = {
        "similarity": (runs.similarity_filter(df, ["v"], 0.5, 0.2, 0.3), lambda s: sequences.stream_similarity_filter(s, ["v"], 0.5, 0.2, 0.3, delay="1 second")),
        "subsample": (runs.subsample(df, ["v"], 2.0), lambda s: sequences.stream_subsample(s, ["v"], 2.0, delay="1 second")),
    }[which]
    got, state = stream(spark, tmp_path, [*parts, *beats(spark, df.schema, "v", 60, 5000, 9000)], make, f"{which}_by_time")
    assert sorted(r.row_id for r in got) == sorted(r.row_id for r in some.collect()) and 3 < len(got) < 180
    assert state == 0


def test_a_sequence_that_is_over_begins_anew(spark, tmp_path):
    """Forgotten after its idle time, a video's next row is kept whatever came before; a late row isn't."""
    schema = "v bigint, time_sec double, frame_idx bigint, row_id bigint"
    part = lambda *rows: timed(spark, list(rows), schema, F.col("time_sec"))
    parts = [part((1, 0.0, 0, 10), (1, 1.0, 1, 11)), part((1, 20.0, 2, 12)), part((1, 3.0, 3, 13), (1, 21.0, 4, 14)), part((2, 900.0, 0, 20)), part((1, 901.0, 5, 15)), part((2, 2000.0, 1, 21))]
    got, state = stream(spark, tmp_path, parts, lambda s: sequences.stream_subsample(s, ["v"], 5000.0, delay="1 second", idle="60 seconds"), "anew")
    assert sorted(r.row_id for r in got) == [10, 15, 20] and state > 0


def test_rows_that_wait_are_few_values(spark, tmp_path):
    df = timed(spark, [(1, 5.0, i, i) for i in range(50)], "v bigint, time_sec double, frame_idx bigint, row_id bigint", F.col("time_sec"))
    got, state = stream(spark, tmp_path, [df], lambda s: sequences.stream_subsample(s, ["v"], 2.0, delay="10 seconds"), "waiting")
    assert got == [] and 0 < state < 10


def test_intervals():
    assert sequences.milliseconds("2 seconds") == 2000 and sequences.milliseconds("1.5 minutes") == 90_000
