"""Datasets for training: splits without leakage, COCO export, statistics, scene graphs."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, parsing
from .runs import ranked


def split_participants(participants: list[str], share: float, seed: int) -> dict[str, str]:
    """Each participant's split. A seeded shuffle of the sorted names; validation gets round(n x share), one at least of two or more."""
    names = sorted(set(participants))
    if len(names) < 2:
        return {p: "train" for p in names}
    random.Random(seed).shuffle(names)
    n = max(1, min(len(names) - 1, round(len(names) * share)))
    return {p: "val" if i < n else "train" for i, p in enumerate(names)}


def split_by_hash(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """The same without a driver-side list: keys fall by a seeded hash, so the share holds in expectation."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(share * 10_000), "val").otherwise("train"))


def split_by_rank(names: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """(key, split) of distinct names: the first round(n x share) by a seeded hash are val, one at least of two or more; no driver-side list."""
    once = names.select(key).distinct().withColumn("__draw", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary")))
    n = once.count()
    most = 0 if n < 2 else max(1, min(n - 1, round(n * share)))
    return ranked(once, [], ["__draw", key], "__nth").select(key, F.when(F.col("__nth") < most, "val").otherwise("train").alias("split"))


def with_split(df: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Rows with their key's split; a key without one is train."""
    return df.join(splits, key, "left").fillna("train", ["split"])


def image_names(df: DataFrame, *parts: Column, number: Column) -> Column:
    return F.concat_ws("_", *[parsing.token(p) for p in parts], F.lpad(number.cast("string"), 6, "0"))


def coco_tables(labels: DataFrame, category: str = "stimulus") -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of labels (split, video_id, frame_idx, width, height, box, confidence, row_id).

    Ids run from 1 within a split in order of (video_id, frame_idx). Names that collide after cleaning get _1, _2, ...
    A null split is a split of its own.
    """
    frames = labels.select("split", "video_id", "frame_idx", "width", "height").distinct()
    name = image_names(frames, F.col("video_id").cast("string"), number=F.col("frame_idx") % 1000)
    images = ranked(frames, ["split"], ["video_id", "frame_idx"], "image_id").withColumns({"image_id": (F.col("image_id") + 1).cast("int"), "stem": name})
    again = F.row_number().over(Window.partitionBy("split", "stem").orderBy("image_id")) - 1
    images = images.withColumn("file_name", F.concat("stem", F.when(again > 0, F.concat(F.lit("_"), again.cast("string"))).otherwise(""), F.lit(".png"))).drop("stem")
    b = boxes.to_xywh(boxes.box())
    of = images.select(F.col("split").alias("__split"), F.col("video_id").alias("__video"), F.col("frame_idx").alias("__frame"), "image_id")
    same = labels["split"].eqNullSafe(of["__split"]) & labels["video_id"].eqNullSafe(of["__video"]) & labels["frame_idx"].eqNullSafe(of["__frame"])
    ann = labels.join(of, same).drop("__split", "__video", "__frame")
    ann = ranked(ann, ["split"], ["image_id", "row_id"], "annotation_id")
    ann = ann.select("split", "image_id", (F.col("annotation_id") + 1).cast("int").alias("annotation_id"), F.array(*[c.cast("double") for c in b]).alias("bbox"), boxes.area(boxes.box()).alias("area"), F.lit(1).alias("category_id"), F.lit(0).alias("iscrowd"))
    return images, ann


def counts_by_participant(labels: DataFrame, splits: DataFrame, key: str = "participant_id") -> DataFrame:
    """(participant, split, selected_frames): how many labels each participant has; one without a split is train."""
    return with_split(labels.groupBy(key).agg(F.count("*").alias("selected_frames")), splits, key)


def counts_by_fps(labels: DataFrame, fps: str = "fps") -> DataFrame:
    """(fps, n): how many labels each rate has, rates rounded to three places."""
    return labels.groupBy(F.round(F.col(fps).cast("double"), 3).alias("fps")).agg(F.count("*").alias("n"))


#: How many lines of a split file the small splits have.
SUBSETS = {"minitrain": 1000, "smalltrain": 20_000, "minival": 100, "smallval": 2000}


def subset(lines: DataFrame, name: str, *order: str) -> DataFrame:
    """The first lines of a split by its name; a name without a limit has all. The limit is the point of these splits."""
    return lines.orderBy(*order).limit(SUBSETS[name]) if name in SUBSETS else lines


def training_order(df: DataFrame, order: list[str], size: int, seed: int) -> DataFrame:
    """``df`` with place: batches of ``size`` neighbours in ``order``, drawn in a seeded order; the rows left over come last."""
    rows = ranked(df, [], order, "__n").withColumn("__batch", F.floor(F.col("__n") / size))
    full = df.count() // size
    draw = F.when(F.col("__batch") < full, F.md5(F.concat(F.lit(f"{seed}-"), F.col("__batch").cast("string")).cast("binary"))).otherwise("~")
    batches = ranked(rows.select("__batch").distinct().withColumn("__draw", draw), [], ["__draw", "__batch"], "__at_batch").select("__batch", "__at_batch")
    return rows.join(batches, "__batch").withColumn("place", F.col("__at_batch") * size + F.col("__n") % size).select(*df.columns, "place")


def scene_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (image_id, subject, predicate, object) whose ends are both known."""
    known = nodes.select("image_id", F.col("node_id"))
    s = edges.join(known.withColumnRenamed("node_id", "subject"), ["image_id", "subject"], "left_semi")
    return s.join(known.withColumnRenamed("node_id", "object"), ["image_id", "object"], "left_semi").select("image_id", "subject", "predicate", "object").distinct()
