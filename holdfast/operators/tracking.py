"""Tracking through detector misses: one pure step over a frame, wrapped for batch and for streams.

A track's state depends on every frame before, so a video's frames go to one task in order; they are stepped through as they
come, in Arrow batches, and a task holds one batch and a few numbers. Videos are independent, and other columns pass along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from itertools import groupby
from math import hypot
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import NO_CONTACT, PORTABLE, STATIONARY, threshold
from .streams import in_order, whole_groups

Box = tuple[float, float, float, float]


def iou(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    # Boxes that share something have sides above 0.
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def centre(b: Box) -> tuple[float, float]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def predicted(before: Box | None, last: Box) -> Box:
    """The last box moved on by its centre's latest step, its size kept."""
    if before is None:
        return last
    (ax, ay), (bx, by) = centre(before), centre(last)
    cx, cy, w, h = 2 * bx - ax, 2 * by - ay, (last[2] - last[0]) / 2, (last[3] - last[1]) / 2
    return cx - w, cy - h, cx + w, cy + h


def probability(confidence: float | None) -> float:
    c = 0.0 if confidence is None or confidence != confidence else float(confidence)
    return max(0.0, min(1.0, c if c <= 1 else c / 100))


@dataclass(frozen=True)
class BridgeConfig:
    max_missed: int = 8
    confirm: int = 2
    contact_iou: float = 0.15
    reassociate_iou: float = 0.10
    seed_confidence: float = 0.70
    promote_stationary: bool = False
    stationary_confirm: int = 2
    stationary_iou: float = 0.15

    def clamped(self) -> BridgeConfig:
        unit = lambda v: max(0.0, min(1.0, float(v)))
        return replace(
            self, max_missed=max(0, int(self.max_missed)), confirm=max(1, int(self.confirm)), stationary_confirm=max(1, int(self.stationary_confirm)), contact_iou=unit(self.contact_iou),
            reassociate_iou=unit(self.reassociate_iou), stationary_iou=unit(self.stationary_iou), seed_confidence=threshold(self.seed_confidence, 0.70),
        )


@dataclass(slots=True)
class Track:
    track_id: int
    last: Box
    before: Box | None = None
    missed: int = 0
    no_contact_streak: int = 0
    stationary_streak: int = 0


@dataclass(slots=True)
class BridgeState:
    track: Track | None = None
    next_id: int = 1


class Detection(NamedTuple):
    row_id: int
    is_hand: bool
    box: Box
    confidence: float | None
    label: str | None
    blue: bool


@dataclass(slots=True)
class FrameResult:
    """What a frame's rows get: state, track, box and its source; and which row is promoted."""

    state: str
    track_id: int | None = None
    missed: int | None = None
    box: Box | None = None
    source: str = "none"
    promoted: int | None = None
    overlap: float | None = None


def _seed(frame: list[Detection], least: float) -> Detection | None:
    hands = [d for d in frame if d.is_hand and d.label == PORTABLE and not d.blue]
    objects = [(p, d) for d in frame if not d.is_hand and (p := probability(d.confidence)) >= least] if hands else []
    most = max((p for p, _ in objects), default=0.0)
    likeliest = [d for p, d in objects if p == most]
    if len(likeliest) < 2:
        return likeliest[0] if likeliest else None
    key = lambda p: (hypot(*(x - y for x, y in zip(centre(p[0].box), centre(p[1].box), strict=True))), -iou(p[0].box, p[1].box), p[1].row_id, p[0].row_id)
    return min(((h, o) for h in hands for o in likeliest), key=key)[1]


def _associated(frame: list[Detection], box: Box, least: float) -> Detection | None:
    best, mark = None, (0.0, 0.0)
    for d in frame:
        if not d.is_hand and (over := iou(box, d.box)) >= mark[0] and (found := (over, probability(d.confidence))) > mark:
            best, mark = d, found
    return best if best and mark[0] >= least else None


def _touching(frame: list[Detection], box: Box, names: tuple[str, ...]) -> tuple[Detection | None, float]:
    best, most = None, 0.0
    for d in frame:
        if d.is_hand and d.label in names and not d.blue and (over := iou(box, d.box)) > most:
            best, most = d, over
    return best, most


def step(state: BridgeState, frame: list[Detection], config: BridgeConfig) -> tuple[BridgeState, FrameResult]:
    """One frame's unfiltered detections, in order of rows."""
    track = state.track
    if track is None:
        seed = _seed(frame, config.seed_confidence)
        if seed is None:
            return state, FrameResult("inactive")
        track = Track(state.next_id, seed.box)
        return BridgeState(track, state.next_id + 1), FrameResult("tracking", track.track_id, 0, track.last, "seed_detected")
    ahead = predicted(track.before, track.last)
    found = _associated(frame, ahead, config.reassociate_iou)
    if found is not None:
        track = Track(track.track_id, found.box, track.last)
        return BridgeState(track, state.next_id), FrameResult("tracking", track.track_id, 0, track.last, "associated_detected")
    track = Track(track.track_id, ahead, track.last, track.missed + 1, track.no_contact_streak, track.stationary_streak)
    if track.missed > config.max_missed:
        return BridgeState(None, state.next_id), FrameResult("lost", track.track_id, track.missed)
    result = FrameResult("tracking", track.track_id, track.missed, track.last, "predicted")
    if any(d.is_hand and d.blue for d in frame):
        return BridgeState(replace(track, no_contact_streak=0, stationary_streak=0), state.next_id), result
    chances = []
    kinds = [("no_contact_streak", (NO_CONTACT,), config.contact_iou, config.confirm, True), ("stationary_streak", (STATIONARY, STATIONARY + " Contact"), config.stationary_iou, config.stationary_confirm, config.promote_stationary)]
    for name, names, least, confirm, active in kinds:
        hand, over = _touching(frame, track.last, names) if active else (None, 0.0)
        hit = hand is not None and over >= least
        setattr(track, name, getattr(track, name) + 1 if hit else 0)
        if hit and getattr(track, name) >= confirm:
            chances.append((-over, hand.row_id))
    if chances:
        over, result.promoted = min(chances)
        result.overlap = -over
    return BridgeState(track, state.next_id), result


NEEDED = ["video_id", "frame_number", "frame_id", "row_id", "detection_type", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "confidence", "contact_label", "blue_glove_status", "is_filtered"]
ADDED = "tracking_promoted boolean, tracking_track_id bigint, tracking_iou double, tracking_missed_count bigint, tracking_state string, tracking_bbox_x1 double, tracking_bbox_y1 double, tracking_bbox_x2 double, tracking_bbox_y2 double, tracking_bbox_source string"
OUTPUT = f"video_id bigint, frame_number bigint, row_id bigint, {ADDED}"


def _frames(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    for _, group in groupby(rows, key=lambda r: (r[1], r[2])):
        yield list(group)


def annotate(rows: list[tuple], state: BridgeState, config: BridgeConfig) -> tuple[list[tuple], BridgeState]:
    """Annotations (OUTPUT) of a video's rows (NEEDED, by frame and row_id), from a state on."""
    out = []
    for frame in _frames(iter(rows)):
        seen = [Detection(r[3], r[4] == "hand", tuple(map(float, r[5:9])), r[9], r[10], r[11] == "experimenter") for r in frame if r[12] is not True]
        state, f = step(state, seen, config)
        for r in frame:
            mine = f.promoted == r[3]
            out.append((r[0], r[1], r[3], mine, f.track_id, f.overlap if mine else None, f.missed, f.state, *(f.box or (None,) * 4), f.source))
    return out, state


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count or not pa.types.is_primitive(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _words(column: pa.Array) -> list[str | None]:
    """Texts of which there are few."""
    codes = column.dictionary_encode(null_encoding="encode")
    words = codes.dictionary.to_pylist()
    return [words[i] for i in codes.indices.to_numpy().tolist()]


def annotated_batch(batch: pa.RecordBatch, state: BridgeState, video: object, config: BridgeConfig) -> tuple[list[pa.Array], BridgeState, object]:
    """What ``annotate`` gives for a batch of whole frames of several videos, as columns (ADDED): a step a frame, no tuple a row."""
    column, change = batch.column, np.zeros(batch.num_rows, bool)
    change[0] = True
    for name in ("video_id", "frame_number", "frame_id"):
        codes = column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change)
    stops = np.append(starts[1:], batch.num_rows)
    is_ = lambda name, value: pa.compute.fill_null(pa.compute.equal(column(name), value), False).to_numpy(zero_copy_only=False)
    seen = ~is_("is_filtered", True)
    corners = [column(f"bbox_{k}") for k in ("x1", "y1", "x2", "y2")]
    if any(c.null_count and (c.is_null().to_numpy(zero_copy_only=False) & seen).any() for c in corners):
        raise TypeError("a detection's box lacks a corner")
    numbers = lambda c: c.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).tolist()
    ids = _values(column("row_id"))
    rows = list(map(Detection, ids, is_("detection_type", "hand").tolist(), zip(*map(numbers, corners), strict=True), numbers(column("confidence")), _words(column("contact_label")), is_("blue_glove_status", "experimenter").tolist()))
    hidden = np.add.reduceat(~seen, starts, dtype=np.int64).tolist()
    seen, found, mine, overlap = seen.tolist(), [], np.zeros(len(rows), bool), [None] * len(rows)
    for v, begin, end, some in zip(column("video_id").take(pa.array(starts)).to_pylist(), starts.tolist(), stops.tolist(), hidden, strict=True):
        if v != video:
            state, video = BridgeState(), v
        frame = [rows[i] for i in range(begin, end) if seen[i]] if some else rows[begin:end]
        state, f = step(state, frame, config)
        found.append(f)
        if f.promoted is not None:
            for i in range(begin, end):
                if ids[i] == f.promoted:
                    mine[i], overlap[i] = True, f.overlap
    of = pa.array(np.repeat(np.arange(len(starts)), stops - starts))
    by_frame = lambda values, kind: pa.array(values, kind).take(of)
    boxes = zip(*(f.box or (None,) * 4 for f in found), strict=True)
    return [
        pa.array(mine), by_frame([f.track_id for f in found], pa.int64()), pa.array(overlap, pa.float64()), by_frame([f.missed for f in found], pa.int64()), by_frame([f.state for f in found], pa.string()),
        *[by_frame(b, pa.float64()) for b in boxes], by_frame([f.source for f in found], pa.string()),
    ], state, video


def tracking_bridge(df: DataFrame, config: BridgeConfig = BridgeConfig()) -> DataFrame:
    """``df`` with tracking columns; hands that a track promotes become Portable Object."""
    config = config.clamped()
    added = T.StructType.fromDDL(ADDED)
    df = df.drop(*[n for n in added.names if n in df.columns])
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, video = BridgeState(), None
        for batch in whole_groups(batches, ["video_id", "frame_number", "frame_id"]):
            columns, state, video = annotated_batch(batch, state, video, config)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    marked = in_order(df, ["video_id"], ["frame_number", "frame_id", "row_id"]).mapInArrow(run, schema)
    promoted = F.col("tracking_promoted")
    return marked.withColumns({"contact_label": F.when(promoted, PORTABLE).otherwise(F.col("contact_label")), "contact_state": F.when(promoted, 3).otherwise(F.col("contact_state"))})


def pick(candidates: list[tuple[Box, float]], before: Box | None) -> Box | None:
    """The valid box that overlaps the previous one most, then of highest score, then of smallest corners."""
    good = [(b, s) for b, s in candidates if b[2] > b[0] and b[3] > b[1]]
    key = (lambda c: (-c[1], c[0])) if before is None else (lambda c: (-iou(c[0], before), -c[1], c[0]))
    return min(good, key=key)[0] if good else None


@dataclass
class RegionState:
    last: Box | None = None
    missed: int = 0


Detect = Callable[[object, Box | None], list[tuple[Box, float]]]


def region_step(state: RegionState, image: object, detect: Detect, blue: Callable[[object, Box], bool], max_missed: int = 8) -> tuple[RegionState, list[tuple[Box, float]], str]:
    """One frame of temporal regions: on a miss the detector runs again with the last box as an extra region.

    Returns the new state, the detections in use and what happened.
    """
    found = detect(image, None)
    box = pick(found, state.last)
    if box is not None:
        return (state, found, "guarded") if blue(image, box) else (RegionState(box, 0), found, "picked")
    if max_missed <= 0 or state.last is None or state.missed >= max_missed:
        return state, found, "none"
    missed = RegionState(None, 0) if state.missed + 1 >= max_missed else RegionState(state.last, state.missed + 1)
    if blue(image, state.last):
        return missed, found, "missed"
    again = detect(image, state.last)
    box = pick(again, state.last)
    if box is None or blue(image, box):
        return missed, again, "missed"
    return RegionState(box, 0), again, "recovered"


def above_or_in_region(objects: list[tuple[Box, float]], region: Box | None) -> list[tuple[Box, float]]:
    """Objects over the detector's threshold, and those below it that overlap an extra region."""
    return [o for o in objects if o[1] >= 70 or (region is not None and iou(o[0], region) >= 0.1)]


def frame_region(state: RegionState, rows: list[tuple], detect: Detect, max_missed: int) -> tuple[RegionState, str]:
    """One frame's step from its rows (detection_type, box, confidence, blue_glove_status): the new state and what happened."""
    objects = [(tuple(map(float, r[1:5])), float(r[5])) for r in rows if r[0] != "hand"]
    gloves = [tuple(map(float, r[1:5])) for r in rows if r[0] == "hand" and r[6] == "experimenter"]
    state, _, what = region_step(state, objects, detect, lambda _, b: any(iou(b, x) > 0 for x in gloves), max_missed)
    return state, what


REGIONS = "video_id bigint, frame_number bigint, outcome string, missed int, x1 double, y1 double, x2 double, y2 double"


def temporal_regions(df: DataFrame, max_missed: int = 8, detect: Callable[[list[tuple[Box, float]], Box | None], list[tuple[Box, float]]] | None = None) -> DataFrame:
    """Per frame of a video the stimulus box and what became of it.

    A frame's objects over the detector's threshold (confidence >= 70) are what it finds; with an extra region it also finds
    those below it that overlap the region. ``detect(objects, region)`` replaces that. A frame is blue where an experimenter's hand touches the box.
    """
    find = detect or above_or_in_region
    needed = ["video_id", "frame_number", "row_id", "detection_type", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "confidence", "blue_glove_status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, video = RegionState(), None
        for batch in whole_groups(batches, ["video_id", "frame_number"]):
            out = []
            for (v, number), group in groupby(zip(*(batch.column(c).to_pylist() for c in needed), strict=True), key=lambda r: r[:2]):
                if v != video:
                    state, video = RegionState(), v
                state, what = frame_region(state, [r[3:] for r in group], find, max_missed)
                out.append((v, number, what, state.missed, *(state.last or (None,) * 4)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in REGIONS.split(", ")])

    return in_order(df.select(*needed), ["video_id"], ["frame_number", "row_id"]).mapInArrow(run, REGIONS)


STATE = T.StructType([T.StructField("state", T.StringType()), T.StructField("held", T.StringType())])


def packed(state: BridgeState) -> dict:
    return asdict(state)


def unpacked(d: dict) -> BridgeState:
    t = d["track"]
    box = lambda b: None if b is None else tuple(b)
    return BridgeState(None if t is None else Track(**{**t, "last": box(t["last"]), "before": box(t["before"])}), d["next_id"])
