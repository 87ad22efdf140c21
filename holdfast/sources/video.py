"""Videos to frames through a pluggable decoder, and frames of folders: one record or one written image for each frame.

Decoding needs a codec, which comes as a function from a video's path and bytes to frames. Videos are decoded one by one within a
task; frames leave it as they come, so that a task holds one video's bytes and a few frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from .files import IMAGES, VIDEOS, _kind, frame_index, images, paths

#: A decoder gives the frame rate (0 or less: unknown) and the frames, each as (encoded image, width, height).
Decoder = Callable[[str, bytes], tuple[float, Iterator[tuple[bytes, int, int]]]]
FRAMES = "path string, video_id string, frame_idx int, frame_time_sec double, fps double, width int, height int, content binary, error string"
_names = [x.split()[0] for x in FRAMES.split(", ")]
_types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]


def decode(videos: DataFrame, factory: Callable[[], Decoder], default_fps: float = 30.0, wanted: str | None = None) -> DataFrame:
    """FRAMES of ``videos`` (path, content), numbered from 0; time = frame_idx / fps, with ``default_fps`` where the rate is unknown.

    ``wanted`` names a column with the frame numbers to keep (all if null). A video that can't be decoded is one row with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = factory()
        for batch in batches:
            for path, content, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                some = None if some is None else set(some)
                try:
                    fps, frames = decoder(path, content)
                    fps = fps if fps > 0 else default_fps
                    for i, (image, width, height) in enumerate(frames):
                        if some is None or i in some:
                            yield _row(path, stem, i, i / fps, fps, width, height, image, None)
                except Exception as e:  # a decoder's failure is data, whatever its kind
                    yield _row(path, stem, None, None, None, None, None, None, f"{type(e).__name__}: {e}")

    return videos.select("path", "content", F.col(wanted) if wanted else F.lit(None).cast("array<bigint>")).mapInArrow(run, FRAMES)


def _row(*values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _types, strict=True)], names=_names)


def write_frames(frames: DataFrame, folder: str, name: str = "legacy", extension: str = "png", width: int = 6) -> DataFrame:
    """Write each frame's image below ``folder``, which all executors share; (path, video_id, frame_idx, target, error), written when read.

    Names: ``one_based`` {video}/{idx + 1 padded}, ``zero_based`` {video}/{idx padded}, ``legacy`` {idx}_{video}. A frame with an error, or one
    that can't be written, keeps its row with the error. Written again, a frame replaces itself.
    """
    if name not in ("one_based", "zero_based", "legacy"):
        raise ValueError(f"unknown naming {name!r}")
    root = folder.rstrip("/")

    def target(video: str, i: int) -> str:
        return f"{root}/{i}_{video}.{extension}" if name == "legacy" else f"{root}/{video}/{i + (name == 'one_based'):0{width}d}.{extension}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, video, i, content, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = None if error else target(video, i)
                if at:
                    try:
                        fs, inner = pa.fs.FileSystem.from_uri(at if "://" in at else "file://" + at)
                        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                        with fs.open_output_stream(inner) as f:
                            f.write(content)
                    except OSError as e:
                        at, error = None, str(e)
                out.append((path, video, i, at, error))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "video_id", "frame_idx", "target", "error"])

    return frames.select("path", "video_id", "frame_idx", "content", "error").mapInArrow(run, "path string, video_id string, frame_idx int, target string, error string")


def resolve_input(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """("frames", images of a folder) or ("video", the video's path); anything else is an error."""
    kind = F.lit(path)
    if spark.range(1).where(_kind(kind, VIDEOS)).count():
        return "video", paths(spark, path).select("path")
    if spark.range(1).where(_kind(kind, IMAGES)).count():
        raise ValueError(f"{path} is a single image, neither a folder nor a video")
    return "frames", images(spark, path)


def unsorted_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images in the order in which the listing gives them, from the last to the first (the archived demos' order)."""
    return paths(spark, folder).where(_kind(F.col("path"), IMAGES)).withColumn("listed", F.monotonically_increasing_id()).orderBy(F.desc("listed")).select("path")


def selected_from_folders(spark: SparkSession, selections: DataFrame, root: str) -> DataFrame:
    """(video_id, frame, path, error) of ``selections`` (video_id, frame) among the images of folders below ``root``: the lowest name of a number."""
    files = paths(spark, root, True).where(_kind(F.col("path"), IMAGES)).select("path", parsing.parent(F.col("path")).alias("video_id"), parsing.first_number(parsing.stem(F.col("path"))).alias("frame"))
    lowest = files.groupBy("video_id", "frame").agg(F.min("path").alias("path"))
    out = selections.select("video_id", "frame").join(lowest, ["video_id", "frame"], "left")
    return out.withColumn("error", F.when(F.col("path").isNull(), "no image of that number"))


__all__ = ["FRAMES", "Decoder", "decode", "frame_index", "resolve_input", "selected_from_folders", "unsorted_images", "write_frames"]
