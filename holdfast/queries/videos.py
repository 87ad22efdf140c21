"""Queries that write videos made from the tables, read their frames by ranges, and write and read images of selected frames."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from ..operators.streams import in_order
from ..sources import avi, frames
from ..staging import scratch
from ..testdata import GT, cte, view
from .registry import ORACLE_SQL, query

FPS = 25
_V = f"{cte(gt=GT)}, f as (select *, row_number() over (partition by video_id order by frame_number) - 1 as frame_idx from gt)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame for each order."""
    return view(spark, sf_dir, GT).select("video_id", "frame_number", "gt")


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Videos of (video_id, image) in order: a task holds one video's images, and ``frames.BATCH`` of videos that wait."""

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([0] * len(ids), pa.int32()), pa.array(videos, pa.binary())], names=["video_id", "frame_idx", "content"])

    ids, videos, held = [], [], 0
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for video, of_video in groupby(rows, itemgetter(0)):
        ids.append(video)
        videos.append(avi.written([image.encode() for _, image in of_video], FPS, 64, 48))
        held += len(videos[-1])
        if held > frames.BATCH:
            yield made()
            ids, videos, held = [], [], 0
    yield made()


def _videos(spark: SparkSession, sf_dir: str) -> str:
    """A folder of videos {0}_{video_id}.avi, written by the sink that commits; a frame's image names it."""
    folder = scratch(spark, "videos")
    rows = in_order(_frames(spark, sf_dir), ["video_id"], ["frame_number", "gt"]).select(F.col("video_id").cast("string").alias("video_id"), F.concat_ws(":", "video_id", "frame_number", "gt").alias("image"))
    frames.write(rows.mapInArrow(_made, "video_id string, frame_idx int, content binary"), folder, name="legacy", extension="avi")
    return folder


def _number(name: str = "video_id"):
    return F.regexp_extract(name, r"_(\d+)", 1).cast("bigint")


@query(f"{_V} select video_id, frame_idx, frame_idx / 25.0::double as frame_time_sec, 64 as width, md5(video_id || ':' || frame_number || ':' || gt) as image from f")
def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of all videos, each read by several tasks."""
    read = frames.read(spark, _videos(spark, sf_dir), split_mb=0.01)
    return read.select(_number().alias("video_id"), F.col("frame_idx").cast("bigint").alias("frame_idx"), "frame_time_sec", "width", F.md5("content").alias("image"))


@query(f"""{_V}, r as (select *, frame_idx - row_number() over (partition by video_id, gt order by frame_idx) as run from f),
i as (select video_id, gt, run, min(frame_idx) as first, count(*) as n from r group by all having count(*) >= 3)
select f.video_id, f.frame_idx + 1 as number, md5(f.video_id || ':' || f.frame_number || ':' || f.gt) as image from i join f on f.video_id = i.video_id and f.frame_idx = i.first + i.n // 2""")
def written_frame_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle frame of each island of three frames or more: read by seeking, written as images, listed and read again."""
    folder, out = _videos(spark, sf_dir), scratch(spark, "images")
    numbered = runs.ranked(_frames(spark, sf_dir), ["video_id"], ["frame_number"], "frame_idx")
    found = runs.islands(numbered, ["video_id"], "frame_idx", "gt").where("length >= 3")
    chosen = found.select(F.concat(F.lit(f"{folder}/0_"), F.col("video_id").cast("string"), F.lit(".avi")).alias("path"), runs.middle().alias("frame_idx"))
    frames.write(frames.selected(chosen), out)
    images = frames.images(spark, out)
    return images.select(F.regexp_extract("path", r"_(\d+)/\d+\.png$", 1).cast("bigint").alias("video_id"), F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("number"), F.md5("content").alias("image"))


@query(ORACLE_SQL["subsampled_frames"])
def streamed_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch query's rule on a stream of the table in three parts by time, a run each, with heartbeats after them; its rows as the sink has them."""
    from ..streaming import sequences

    provider = "spark.sql.streaming.stateStore.providerClass"
    own = spark.newSession()
    own.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    path, out, cp = (scratch(spark, tag) for tag in ("events", "streamed", "progress"))
    e = own.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as video_id", "unix_micros(cast(ts as timestamp)) / 1000000D as time_sec", "event_id as frame_idx", "event_id as row_id", "cast(ts as timestamp) as ts")
    low, high = e.agg(F.min("time_sec"), F.max("time_sec")).first()
    third = F.floor((F.col("time_sec") - low) / (high - low) * 2.999)
    # Heartbeats, twice: the watermark moves after the micro-batch that shows it.
    beat = ["cast(null as double) as time_sec", *(f"0L as {c}" for c in ("video_id", "frame_idx", "row_id"))]
    beats = [own.range(1).selectExpr(*beat, f"timestamp_micros(cast({high + 86_400.0 * i} * 1000000 as bigint)) as ts").select(e.columns) for i in (1, 2)]
    for i, part in enumerate([*(e.where(third == i) for i in range(3)), *beats]):
        part.write.parquet(f"{path}/{i}")
        source = own.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(path)
        kept = sequences.stream_subsample(source, ["video_id"], 90000.0, delay="1 second", idle="100000 days")
        kept.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("video_id", F.col("row_id").alias("event_id"))
