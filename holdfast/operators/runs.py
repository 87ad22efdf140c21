"""Runs of equal labels: islands, representative frames, trimming and smoothing.

Everything is windows by sequence; a sequence's rows are sorted once and the windows share the order. Only the recurrences that
depend on what was kept last (``since_kept``) step through the sorted rows instead. Places in an order of a whole table come
from a range sort and sums over its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import shuffle_partitions, staged
from .streams import in_order


def number_runs(df: DataFrame, keys: list[str], order: str, label: str, step: int | None = 1) -> DataFrame:
    """``df`` with run: counts up whenever the label changes or, unless ``step`` is None, the order's value moves by other than it."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.lag(F.struct(F.col(label).alias("l"), F.col(order).alias("o"))).over(w)
    fresh = last.isNull() | ~F.col(label).eqNullSafe(last["l"])
    if step is not None:
        fresh = fresh | (F.col(order) - last["o"] != step)
    return df.withColumn("__fresh", fresh.cast("int")).withColumn("run", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def islands(df: DataFrame, keys: list[str], order: str, label: str, flag: str | None = None, step: int | None = 1) -> DataFrame:
    """One row for each run: keys, run, label, first, last, length, and any(flag)."""
    aggs = [F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")]
    if flag:
        aggs.append(F.coalesce(F.bool_or(flag), F.lit(False)).alias("has_" + flag))
    return number_runs(df, keys, order, label, step).groupBy(*keys, "run").agg(*aggs)


def pass_islands(found: DataFrame, least: Column, label: str, flag: str) -> DataFrame:
    """Islands of at least ``least`` frames; those of label 1 with any flag are vetoed."""
    return found.withColumns({"long_enough": F.col("length") >= least}).withColumn("selected", F.col("long_enough") & ~((F.col(label) == 1) & F.col(f"has_{flag}")))


def least_frames(seconds: float, fps: Column) -> Column:
    return F.ceil(F.lit(seconds) * fps)


def middle(first: str = "first", length: str = "length") -> Column:
    """The upper middle of consecutive frames."""
    return F.col(first) + F.floor(F.col(length) / 2)


def integer_segments(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive integers: first, last, length."""
    distinct = df.select(*keys, number).distinct()
    w = Window.partitionBy(*keys).orderBy(number)
    return distinct.withColumn("__at", F.col(number) - F.row_number().over(w)).groupBy(*keys, "__at").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("length")).drop("__at")


def last_of_runs(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """The last row of each run, with the next run's label (null at the end)."""
    w = Window.partitionBy(*keys).orderBy(order)
    following = F.lead(label).over(w)
    return df.withColumn("next_label", following).where(F.col("next_label").isNull() | (F.col("next_label") != F.col(label)))


def trimmed_runs(df: DataFrame, keys: list[str], order: str, label: str, target: int, least: int, share: float) -> DataFrame:
    """Rows of runs of ``target`` with at least ``least`` rows, without ``int(share * (length - 1))`` at either end."""
    w = Window.partitionBy(*keys, "run")
    numbered = number_runs(df, keys, order, label, None).withColumns({"n": F.count("*").over(w), "nth": F.row_number().over(w.orderBy(order)) - 1})
    cut = F.floor(F.lit(share) * (F.col("n") - 1))
    return numbered.where((F.col(label) == target) & (F.col("n") >= least) & (F.col("nth") >= cut) & (F.col("nth") < F.col("n") - cut))


def smoothed(df: DataFrame, keys: list[str], order: str, label: str, drop: int, fill: int) -> DataFrame:
    """1-runs of at most ``drop`` rows become 0; then 0-runs of at most ``fill`` rows become 1. Edges count as runs."""
    out = df
    for source, value, most, name in ((label, 1, drop, "__a"), ("__a", 0, fill, "smooth")):
        n = F.count("*").over(Window.partitionBy(*keys, "run"))
        out = number_runs(out, keys, order, source, None).withColumn(name, F.when((F.col(source) == value) & (n <= most), 1 - value).otherwise(F.col(source))).drop("run")
    return out.drop("__a")


def from_changepoints(points: DataFrame, keys: list[str], lengths: DataFrame) -> DataFrame:
    """Frames 0..n-1 with label 1 from each ``hold`` up to before its ``release`` (null: the end), 0 elsewhere."""
    frames = lengths.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("frame"))
    spans = points.join(lengths, keys).select(*keys, F.explode(F.expr("filter(sequence(hold, greatest(hold, coalesce(release, n) - 1)), f -> f < coalesce(release, n) and f < n)")).alias("frame")).distinct().withColumn("label", F.lit(1))
    return frames.join(spans, [*keys, "frame"], "left").fillna(0, ["label"])


def even_sample(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """At most k rows of each sequence at the integer parts of k evenly spaced places from first to last."""
    w = Window.partitionBy(*keys)
    numbered = df.withColumns({"nth": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w)})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(1, k - 1)))
    return numbered.where((F.col("n") <= k) | F.array_contains(places, F.col("nth").cast("bigint"))).drop("nth", "n")


def since_kept(df: DataFrame, keys: list[str], order: list[str], columns: list[str], keep: Callable[[tuple, tuple], bool]) -> DataFrame:
    """Rows kept by a rule that looks at the last kept one: the first, and those where ``keep(last, x)`` holds.

    Both are tuples of ``order`` and then the other ``columns``. A task steps through its sequences and holds the last kept row.
    """
    fields = [*order, *[c for c in columns if c not in order]]
    rows = df.select(*keys, *fields)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            take = []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if last is None or row[:n] != key or keep(last, row[n:]):
                    key, last = row[:n], row[n:]
                    take.append(i)
            yield batch.take(pa.array(take, pa.int64()))

    return in_order(rows, keys, fields).mapInArrow(run, rows.schema)


def similar_enough(gap: float, move: float, area_change: float) -> Callable[[tuple, tuple], bool]:
    """Whether a row (time_sec, frame_idx, row_id, cx, cy, area, width) differs enough from the last kept one."""

    def keep(last: tuple, x: tuple) -> bool:
        far = sqrt((x[3] - last[3]) ** 2 + (x[4] - last[4]) ** 2)
        return x[0] - last[0] >= gap and far > move * max(1, x[6]) and abs(x[5] - last[5]) / max(1e-6, last[5]) > area_change

    return keep


def similarity_filter(df: DataFrame, keys: list[str], gap: float = 1.0, move: float = 0.05, area_change: float = 0.1) -> DataFrame:
    """Keep a box if, against the last kept one, enough time has passed and centre and area have changed enough.

    Needs time_sec, frame_idx, cx, cy, area and width; rows without a time or a box aren't kept.
    """
    rows = df.dropna(subset=["time_sec", "cx", "cy", "area", "width"])
    return since_kept(rows, keys, ["time_sec", "frame_idx"], ["row_id", "cx", "cy", "area", "width"], similar_enough(gap, move, area_change))


def subsample(df: DataFrame, keys: list[str], interval: float = 2.0) -> DataFrame:
    """A row is kept if it comes ``interval`` or more after the last kept one; rows without a time aren't kept."""
    return since_kept(df.where("time_sec is not null"), keys, ["time_sec", "frame_idx"], ["row_id"], lambda last, x: x[0] - last[0] >= interval)


def by_ranges(df: DataFrame, by: list[str | Column]) -> DataFrame:
    """``df`` dealt by ranges of ``by`` and sorted there, written with __task and __at, a number that rises by one within a task.

    Ranges come from a sample of ``df``, which is computed for it once more: stage what is costly before.
    """
    rows = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    return staged(rows.withColumn("__task", F.shiftright("__at", 33)), "ranked")


def _earlier(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each of ``keys`` and task the sums over earlier tasks."""
    before = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.groupBy(*keys, "__task").agg(*[c.alias(k) for k, c in sums.items()])
    return part.select(*keys, "__task", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums])


def _with_base(rows: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``base`` of their keys, null or not, and task."""
    on = [*keys, "__task"]
    renamed = base.withColumnsRenamed({k: f"__of_{i}" for i, k in enumerate(on)})
    same = [rows[k].eqNullSafe(renamed[f"__of_{i}"]) for i, k in enumerate(on)]
    return rows.join(renamed, same).drop(*[f"__of_{i}" for i in range(len(on))])


def prefix_sums(df: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, str]) -> DataFrame:
    """``df`` with running sums (new name: column) within ``keys`` in ``order``, which no task needs to see whole; __task tells ranges.

    Null keys are keys like any other; a sum of nulls only is null, as in a window.
    """
    rows = by_ranges(df, [*keys, *order])
    upto = Window.partitionBy(*keys, "__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    base = _earlier(rows, keys, {f"__{k}": F.sum(v) for k, v in values.items()})
    out = _with_base(rows, base, keys).withColumns({k: F.sum(v).over(upto) + F.col(f"__{k}") for k, v in values.items()})
    return out.drop(*[f"__{k}" for k in values])


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in ``order`` within ``keys``, which no task needs to see whole.

    Rows are dealt by ranges and sorted there; what stands in earlier tasks shifts them. ``keys`` and ``order`` name each row; null keys are keys like any other.
    """
    rows = by_ranges(df, [*keys, *order])
    first = rows.groupBy(*keys, "__task").agg(F.min("__at").alias("__first"))
    base = _with_base(_earlier(rows, keys, {"__n": F.count("*")}), first, keys)
    return _with_base(rows, base, keys).withColumn(name, F.col("__at") - F.col("__first") + F.col("__n")).select(*df.columns, name)


def batches_by_shape(df: DataFrame, size: int, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Images in order of width / height clamped to [low, high], in batches with one target ratio each.

    Target: of a batch all below 1 the first, all above 1 the last, else 1. The rank is of the whole table.
    """
    ratio = F.col("width") / F.col("height")
    df = df.withColumns({"ratio": F.greatest(F.lit(low), F.least(F.lit(high), ratio)), "need_crop": (ratio < low) | (ratio > high)})
    df = ranked(df, [], ["ratio", "image_id"], "rank").withColumn("batch", F.floor(F.col("rank") / size))
    w = Window.partitionBy("batch")
    first, last = F.min("ratio").over(w), F.max("ratio").over(w)
    return df.withColumn("target_ratio", F.when(last < 1, first).when(first > 1, last).otherwise(1.0))


def weak_labels(df: DataFrame, keys: list[str], order: str, free: str, contact: str, least: int, share: float) -> DataFrame:
    """Weak labels of frames: 0 where ``free`` (no-contact-first) is 0, and 1 on trimmed runs of ``contact`` (portable-first)."""
    none = df.where(F.col(free) == 0).select(*keys, order, F.lit(0).alias("weak"))
    return none.unionByName(trimmed_runs(df, keys, order, contact, 1, least, share).select(*keys, order, F.lit(1).alias("weak")))
