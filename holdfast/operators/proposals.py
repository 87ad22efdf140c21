"""Boxes as a detector makes them: anchors, suppression, proposals, and their assignment to truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from .grid import with_truths


def base_anchors(base: int = 16, ratios: tuple[float, ...] = (0.5, 1.0, 2.0), scales: tuple[int, ...] = (8, 16, 32)) -> Column:
    """An array of (anchor, x1, y1, x2, y2), one for each ratio and scale in that order, centred on the base window."""
    c, out = (base - 1) / 2, []
    for ratio in ratios:
        w = F.bround(F.sqrt(F.lit(base * base / ratio)))
        h = F.bround(w * ratio)
        for scale in scales:
            half_w, half_h = (w * float(scale) - 1) / 2, (h * float(scale) - 1) / 2
            out.append(F.struct(F.lit(len(out)).alias("anchor"), (c - half_w).alias("x1"), (c - half_h).alias("y1"), (c + half_w).alias("x2"), (c + half_h).alias("y2")))
    return F.array(*out)


def shifted_anchors(images: DataFrame, rows: Column, columns: Column, stride: int = 16, base: Column | None = None) -> DataFrame:
    """``images`` with every base anchor at every cell of their feature map of ``rows`` times ``columns`` cells: anchor_id, bbox_x1 .. bbox_y2.

    An image without cells has no anchors.
    """
    base = base_anchors(stride) if base is None else base
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int")))
    cells = images.withColumn("__columns", columns.cast("bigint")).withColumn("__row", F.explode(span(rows))).withColumn("__column", F.explode(span(columns)))
    each = cells.select("*", base.alias("__all")).withColumn("__n", F.size("__all")).withColumn("__a", F.explode("__all"))
    dx, dy = F.col("__column") * stride, F.col("__row") * stride
    place = ((F.col("__row") * F.col("__columns") + F.col("__column")) * F.col("__n") + F.col("__a.anchor")).cast("bigint")
    sides = [(F.col(f"__a.{k}") + d).alias(f"bbox_{k}") for k, d in (("x1", dx), ("y1", dy), ("x2", dx), ("y2", dy))]
    return each.select(*images.columns, place.alias("anchor_id"), *sides)


def suppressed(df: DataFrame, keys: list[str], threshold: float = 0.3, inclusive: bool = True, first: int | None = None, most: int | None = None) -> DataFrame:
    """Greedy suppression by confidence (ties: row_id) within ``keys``; needs bbox_x1.., confidence, row_id.

    A box goes if a kept one overlaps it by the threshold (``inclusive``, the rule that is live) or by more. ``first`` boxes are
    looked at, ``most`` are kept. A frame's boxes are folded as one array in the JVM: what is kept depends on what was kept.
    """
    inter = "greatest(0D, least(k.x2, b.x2) - greatest(k.x1, b.x1) + 1) * greatest(0D, least(k.y2, b.y2) - greatest(k.y1, b.y1) + 1)"
    area = lambda v: f"(({v}.x2 - {v}.x1 + 1D) * ({v}.y2 - {v}.y1 + 1D))"
    over = f"{inter} / ({area('k')} + {area('b')} - {inter}) {'>=' if inclusive else '>'} {threshold}"
    item = F.struct((-F.col("confidence")).alias("s"), F.col("row_id").alias("id"), *[F.col(f"bbox_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("bs"))
    if first:
        packed = packed.withColumn("bs", F.slice("bs", 1, first))
    packed = packed.withColumn("kept", F.expr(f"aggregate(bs, slice(bs, 1, 0), (ks, b) -> case when exists(ks, k -> {over}) then ks else concat(ks, array(b)) end)"))
    if most:
        packed = packed.withColumn("kept", F.slice("kept", 1, most))
    out = packed.select(*keys, F.posexplode("kept").alias("rank", "k"))
    return out.select(*keys, "rank", F.col("k.id").alias("row_id"), (-F.col("k.s")).alias("confidence"), *[F.col(f"k.{c}").alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")])


def proposals(df: DataFrame, keys: list[str], w: Column, h: Column, first: int = 6000, most: int = 300, threshold: float = 0.7) -> DataFrame:
    """Decoded boxes clipped to the image, the best of them suppressed."""
    b = boxes.clip(boxes.box(), w, h, 1)
    return suppressed(df.withColumns({f"bbox_{k}": v for k, v in zip(("x1", "y1", "x2", "y2"), b, strict=True)}), keys, threshold, True, first, most)


def anchor_targets(anchors: DataFrame, truths: DataFrame, key: str, positive: float = 0.7, negative: float = 0.3) -> DataFrame:
    """Labels of anchors: 1 if the overlap is high or the best of some truth, 0 if low, else -1. Needs anchor_id and gt_id."""
    p = with_truths(anchors, truths, key).withColumn("most", F.max("overlap").over(Window.partitionBy(key, "gt_id")))
    by = p.groupBy(key, "anchor_id").agg(F.max("overlap").alias("overlap"), F.bool_or((F.col("overlap") == F.col("most")) & (F.col("most") > 0)).alias("best"), F.max_by("gt_id", F.struct("overlap", -F.col("gt_id"))).alias("gt_id"))
    label = F.when(F.col("best") | (F.col("overlap") >= positive), 1).when(F.col("overlap") < negative, 0).otherwise(-1)
    return by.select(key, "anchor_id", "gt_id", "overlap", label.alias("label"))


def drawn(column: str, seed: int) -> Column:
    """A seeded order that any engine with MD5 gives."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(column).cast("string")).cast("binary"))


def sampled_anchors(labelled: DataFrame, key: str, batch: int = 256, share: float = 0.5, seed: int = 7) -> DataFrame:
    """Anchors' labels with those beyond the sample set to -1: at most ``share`` of the batch stays 1, 0 fills the rest."""
    w = Window.partitionBy(key, "label").orderBy(drawn("anchor_id", seed), "anchor_id")
    n_fg = F.least(F.count_if(F.col("label") == 1).over(Window.partitionBy(key)), F.lit(int(batch * share)))
    most = F.when(F.col("label") == 1, n_fg).when(F.col("label") == 0, batch - n_fg)
    return labelled.withColumns({"nth": F.row_number().over(w), "most": most}).withColumn("label", F.when(F.col("nth") <= F.col("most"), F.col("label")).otherwise(-1)).drop("nth", "most")


def proposal_targets(rois: DataFrame, truths: DataFrame, key: str, foreground: float = 0.5, low: float = 0.1, high: float = 0.5, batch: int = 128, share: float = 0.25, seed: int = 7) -> DataFrame:
    """Of each image's regions a sample of foreground (overlap >= .5) and background (in [low, high)), by a seeded hash."""
    by = with_truths(rois, truths, key).groupBy(key, "anchor_id").agg(F.max("overlap").alias("overlap"), F.max_by("gt_id", F.struct("overlap", -F.col("gt_id"))).alias("gt_id"))
    kind = F.when(F.col("overlap") >= foreground, "fg").when((F.col("overlap") >= low) & (F.col("overlap") < high), "bg")
    w = Window.partitionBy(key, "kind").orderBy(drawn("anchor_id", seed), "anchor_id")
    some = by.withColumn("kind", kind).where("kind is not null").withColumn("nth", F.row_number().over(w))
    n_fg = F.least(F.sum(F.when(F.col("kind") == "fg", 1).otherwise(0)).over(Window.partitionBy(key)), F.lit(int(batch * share)))
    return some.withColumn("n_fg", n_fg).where(F.col("nth") <= F.when(F.col("kind") == "fg", F.col("n_fg")).otherwise(batch - F.col("n_fg"))).drop("nth", "n_fg")


def with_flipped(df: DataFrame, w: Column) -> DataFrame:
    """All rows, and all rows mirrored."""
    b = boxes.flip(boxes.box(), w)
    return df.withColumn("flipped", F.lit(False)).unionByName(df.withColumns({"bbox_x1": b.x1, "bbox_x2": b.x2, "flipped": F.lit(True)}))


def unique_boxes(df: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """One row for each box after scaling and rounding: the first by row_id."""
    names = ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]
    rounded = [F.bround(F.col(c) * scale).alias(f"r_{c}") for c in names]
    first = df.select("*", *rounded).groupBy(*keys, *[f"r_{c}" for c in names]).agg(F.min("row_id").alias("row_id"))
    return df.join(first.select(*keys, "row_id"), [*keys, "row_id"], "left_semi")


def truth_classes(df: DataFrame, truths: DataFrame, key: str) -> DataFrame:
    """Each region with the class of its best truth; without overlap class 0."""
    by = with_truths(df, truths, key).groupBy(key, "anchor_id").agg(F.max(F.struct("overlap", -F.col("gt_id"), F.col("gt_class"))).alias("m"))
    return by.select(key, "anchor_id", F.when(F.col("m.overlap") > 0, F.col("m.gt_class")).otherwise(0).alias("gt_class"), "m.overlap")
