"""One contact label for each frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels

FRAME = ("video_id", "frame_number")


def condense(df: DataFrame, strategy: str = "no_contact_first") -> DataFrame:
    """Per frame the label of highest priority among unfiltered hands (none: No Contact), and whose hands had it.

    Hands are taken by frame number, also where several frame ids share it; frames are distinct (frame_id, number). One
    aggregation with map-side combining; sorting is left to the caller.
    """
    hand = (F.col("detection_type") == "hand") & (F.col("is_filtered") == False)  # noqa: E712
    label = labels.condensed(F.col("contact_label"))
    rank = labels.priority(label, strategy)
    side = lambda name: F.coalesce(F.bool_or(F.when(hand, F.col("hand_side") == name)), F.lit(False))
    agg = df.groupBy(*FRAME).agg(F.min(F.when(hand, rank)).alias("rank"), side("Left").alias("left"), side("Right").alias("right"), F.collect_set("frame_id").alias("ids"))
    names = F.array(*map(F.lit, labels.PRIORITIES[strategy]))
    source = F.when(F.col("left") & F.col("right"), "Both").when(F.col("left"), "Left").when(F.col("right"), "Right").otherwise("NA")
    return agg.select(*FRAME, F.explode("ids").alias("frame_id"), F.coalesce(F.get(names, F.col("rank") - 1), F.lit(labels.NO_CONTACT)).alias("contact_label"), source.alias("source_hand"))


def condense_legacy(df: DataFrame, order: tuple[str, ...] = ("Portable Object", "Stationary Object", "No Contact")) -> DataFrame:
    """The first row of each frame in order of the label's priority; a label without one sorts last."""
    rank = F.coalesce(F.get(F.array(*[F.lit(i) for i in range(len(order))]), F.array_position(F.array(*map(F.lit, order)), F.col("contact_label")).cast("int") - 1), F.lit(len(order)))
    w = Window.partitionBy(*FRAME).orderBy(rank, "row_id")
    hands = df.where("detection_type = 'hand'")
    return hands.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*FRAME, "row_id", "contact_label")
