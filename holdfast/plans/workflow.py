"""Whole runs: detections to labels, runs to representative frames and scores, sweeps, and dataset building."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, labels
from ..operators import condense, dataset, filters, metrics, runs
from ..operators.matching import aligned
from ..operators.tracking import BridgeConfig, tracking_bridge
from ..staging import staged
from . import config


@dataclass(frozen=True)
class PipelineConfig:
    """Parameters of ``contact_labels``; a factor of None leaves its filter out."""

    blue_threshold: float = 0.5
    object_size: float | None = 0.5
    smaller_factor: float | None = 2.0
    bigger_factor: float | None = None
    bridge: BridgeConfig | None = None
    strict: bool = False
    strategy: str = "no_contact_first"


config.NESTED["PipelineConfig", "bridge"] = BridgeConfig


def contact_labels(df: DataFrame, frames: DataFrame | tuple[Column, Column], chosen: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Blue gloves, object size, ratios, bridge, strict evidence, one label for each frame; in this order."""
    df = filters.blue_glove(df, chosen.blue_threshold)
    if chosen.object_size is not None:
        df = filters.object_size(df, frames, chosen.object_size)
    if chosen.smaller_factor is not None:
        df = filters.smaller_factor(df, chosen.smaller_factor)
    if chosen.bigger_factor is not None:
        df = filters.bigger_than_hand(df, chosen.bigger_factor)
    if chosen.bridge is not None:
        df = tracking_bridge(df, chosen.bridge)
    if chosen.strict:
        df = filters.strict_portable(df)
    return condense.condense(df, chosen.strategy)


def as_binary(label: str) -> Column:
    """A condensed label as 0 or 1, as evaluation reads it."""
    return labels.binary(F.col(label), "exact")


def with_metadata(predictions: DataFrame, metadata: DataFrame, keys: list[str], how: str = "inner", flag: str = "blue") -> DataFrame:
    """Predictions with their frame's flag; with "left" a frame without metadata counts as not flagged."""
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join mode {how!r}")
    return predictions.join(metadata.select(*keys, flag), keys, how).fillna(False, [flag])


def frame_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame whether any hand is an experimenter's."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("blue_glove_status") == "experimenter"), F.lit(False)).alias("blue"))


def extract_timestamps(predictions: DataFrame, keys: list[str], order: str, label: str, seconds: float, fps: float, flag: str = "blue") -> DataFrame:
    """One representative frame for each island that is long enough and not vetoed."""
    found = runs.islands(predictions, keys, order, label, flag)
    kept = runs.pass_islands(found, runs.least_frames(seconds, F.lit(fps)), label, flag).where("selected")
    return kept.select(*keys, runs.middle().cast("bigint").alias(order), F.col(label).alias("pred"), "first", "last", "length")


def evaluate_selected(selected: DataFrame, truth: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per dataset: how many selected frames have truth, coverage, confusion and rates; status failed without any.

    Of duplicate selected frames the first by ``first`` counts.
    """
    once = selected.groupBy(*keys, order).agg(F.min_by("pred", "first").alias("pred"), F.count("*").alias("n"))
    both = aligned(once, truth, [*keys, order], "count")
    n_gt = truth.groupBy(*keys).agg(F.count_distinct(order).alias("n_gt_total"))
    known = F.col("gt").isNotNull()
    agg = both.groupBy(*keys).agg(F.sum("n").alias("n_selected_total"), F.count("*").alias("n_selected_unique"), F.count_if(known).alias("n_selected_with_gt"), F.count_if(~known).alias("n_selected_missing_gt"), *metrics.confusion())
    out = metrics.rates(agg).join(n_gt, keys, "left")
    return out.withColumns({
        "status": F.when(F.col("n_selected_with_gt") > 0, "success").otherwise("failed"),
        "coverage_selected_over_gt": F.coalesce(F.try_divide(F.col("n_selected_with_gt").cast("double"), F.col("n_gt_total")), F.lit(0.0)),
        "coverage_aligned_over_selected": F.coalesce(F.try_divide(F.col("n_selected_with_gt").cast("double"), F.col("n_selected_total")), F.lit(0.0)),
    })


def errors(selected: DataFrame, truth: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Selected frames whose truth differs ("fp", "fn") or is missing ("missing_gt")."""
    both = aligned(selected.select(*keys, order, "pred"), truth, [*keys, order], "count")
    kind = F.when(F.col("gt").isNull(), "missing_gt").when(F.col("pred") > F.col("gt"), "fp").when(F.col("pred") < F.col("gt"), "fn")
    return both.withColumn("kind", kind).where("kind is not null")


def sweep(predictions: DataFrame, truth: DataFrame, keys: list[str], order: str, label: str, seconds: list[float], fps: list[float]) -> DataFrame:
    """All cells of the grid in one plan: islands are found once, each cell filters them; best micro accuracy first by rank."""
    found = runs.islands(predictions, keys, order, label, "blue")
    cells = found.sparkSession.createDataFrame([(s, f) for s in seconds for f in fps], "seconds double, fps double")
    kept = found.join(F.broadcast(cells), found["length"] >= F.ceil(F.col("seconds") * F.col("fps"))).where(~((F.col(label) == 1) & F.col("has_blue")))
    selected = kept.select("seconds", "fps", *keys, runs.middle().cast("bigint").alias(order), F.col(label).alias("pred"))
    both = aligned(selected, truth, [*keys, order], "drop")
    return metrics.rates(both.groupBy("seconds", "fps").agg(*metrics.confusion())).select("seconds", "fps", *metrics.COUNTS, "accuracy", "macro_f1")


def sweep_modes(predictions: DataFrame, flags: DataFrame, truth: DataFrame, key: str, order: str, label: str, seconds: list[float], modes: list[str], groups: DataFrame) -> DataFrame:
    """The whole grid of seconds and join modes, with rates by group of datasets; one row for each cell, the best first (rank from 1).

    ``groups`` are rows (key, fps); datasets without one take no part, and a rate that isn't positive is an error. Best: micro accuracy, then fewest failed datasets (those
    without a frame that has truth), then the cell's name.
    """
    if not set(modes) <= {"inner", "left"} or not modes or not seconds:
        raise ValueError("a sweep needs seconds and join modes among inner and left")
    spark = predictions.sparkSession
    rate = F.col("fps").cast("double")
    fps = groups.select(key, F.when(rate > 0, rate).otherwise(F.raise_error(F.lit("a group's fps is not positive"))).alias("fps")).dropDuplicates([key])
    cells = spark.createDataFrame([(float(s),) for s in seconds], "seconds double")
    joined = predictions.join(fps, key).join(flags.select(key, order, "blue"), [key, order], "left")
    by_mode = joined.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).where("mode = 'left' or blue is not null").fillna(False, ["blue"])
    found = runs.islands(by_mode, [key, "mode", "fps"], order, label, "blue")
    kept = found.join(F.broadcast(cells), F.col("length") >= F.ceil(F.col("seconds") * F.col("fps"))).where(~((F.col(label) == 1) & F.col("has_blue")))
    chosen = kept.select("seconds", "mode", key, runs.middle().cast("bigint").alias(order), F.col(label).alias("pred"))
    by_dataset = aligned(chosen, truth, [key, order], "drop").groupBy("seconds", "mode", key).agg(*metrics.confusion())
    grid = cells.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    totals = by_dataset.groupBy("seconds", "mode").agg(F.count("*").alias("n"), *[F.sum(c).cast("bigint").alias(c) for c in metrics.COUNTS])
    out = grid.join(totals, ["seconds", "mode"], "left").fillna(0).crossJoin(fps.agg(F.count("*").alias("n_datasets"))).withColumn("n_failed", F.col("n_datasets") - F.col("n"))  # one row
    name = F.concat_ws("_", F.col("mode"), F.col("seconds").cast("string"))
    w = Window.orderBy(F.desc("accuracy"), "n_failed", "name")  # one row for each cell of the grid
    return metrics.rates(out).withColumn("name", name).withColumn("rank", F.row_number().over(w)).select("name", "seconds", "mode", *metrics.COUNTS, "n_failed", "accuracy", "macro_f1", "rank")


@dataclass(frozen=True)
class DatasetConfig:
    """Parameters of ``pseudo_labels``. ``min_confidence`` is in the unit of the confidences; ``strategy`` thins a video's labels out
    in time: bbox_similarity, subsample, or none."""

    min_confidence: float = 0.7
    aspect: tuple[float, float] = (0.8, 1.2)
    require_hand: bool = True
    max_area_ratio: float = 1.0
    max_hand_overlap: float = 1.0
    strategy: str = "bbox_similarity"
    gap_sec: float = 0.25
    move: float = 0.10
    area_change: float = 0.20
    interval_sec: float = 0.25
    default_fps: float = 60.0
    category: str = "stimulus"


def pseudo_labels(objects: DataFrame, hands: DataFrame, splits: DataFrame, videos: DataFrame, chosen: DatasetConfig = DatasetConfig()) -> tuple[DataFrame, DataFrame]:
    """Dataset building: heuristics, thinning out in time, split, COCO tables. Returns (images, annotations).

    ``videos`` (video_id, width, height, fps) says how large and fast each video is; a rate that is null or not positive is the
    default one. Objects of videos that aren't there go. Videos without a split are train.
    """
    if chosen.strategy not in ("bbox_similarity", "subsample", "none"):
        raise ValueError(f"unknown strategy {chosen.strategy!r}")
    kept = filters.heuristics(objects, hands, chosen.min_confidence, chosen.aspect, chosen.require_hand, chosen.max_area_ratio, chosen.max_hand_overlap).where("passed_heuristics")
    kept = kept.select("video_id", "frame_number", *boxes.box(), "confidence", "row_id").join(videos.select("video_id", "width", "height", "fps"), "video_id")
    if chosen.strategy != "none":
        kept = staged(kept, "candidates")  # read twice: by the rule, and for what it keeps
        cx, cy = boxes.centre(boxes.box())
        rate = F.when(F.col("fps") > 0, F.col("fps").cast("double")).otherwise(chosen.default_fps)
        timed = kept.select("video_id", (F.col("frame_number") / rate).alias("time_sec"), F.col("row_id").alias("frame_idx"), "row_id", cx.alias("cx"), cy.alias("cy"), boxes.area(boxes.box()).alias("area"), "width")
        thin = runs.subsample(timed, ["video_id"], chosen.interval_sec) if chosen.strategy == "subsample" else runs.similarity_filter(timed, ["video_id"], chosen.gap_sec, chosen.move, chosen.area_change)
        kept = kept.join(thin.select("video_id", "row_id"), ["video_id", "row_id"], "left_semi")
    rows = kept.select("video_id", F.col("frame_number").alias("frame_idx"), "width", "height", *boxes.box(), "confidence", "row_id")
    return dataset.coco_tables(staged(dataset.with_split(rows, splits, "video_id"), "labels"), chosen.category)
