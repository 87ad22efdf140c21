"""Sequences stepped through on a stream: typed state by key, event-time timers, and expiry.

Rows of a key wait in a list until the watermark has passed their time, so that they are complete and in order; a timer stands at
the earliest. When it fires, what is complete is stepped through as a batch run steps through it, and the state after it is kept.
A key that has had no rows for ``idle`` of event time after its last one is over: its state and timers go, so that a stream over
ever new videos holds those that are on, and a row that comes after that begins anew. A row that comes after the watermark is dropped, as by any windowed stream.

The state store must be RocksDB's, as for all of Spark's stateful processors:
``spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import tracking
from ..operators.runs import similar_enough

#: Milliseconds in each of the words that an interval may have.
_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def milliseconds(interval: str) -> int:
    """Of an interval like "2 seconds"."""
    number, unit = interval.split()
    return int(float(number) * _MS[unit.rstrip("s")])


class Stepper(Protocol):
    """How a sequence is stepped through: ``needed`` columns of a row (its key is left out), in whose first ``order`` it lies;
    the DDL of the state and of what a row or frame gives (without the key)."""

    needed: list[str]
    order: int
    state: str
    output: str

    def step(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]: ...


class Stepped(StatefulProcessor):
    """State of a key: what the stepper keeps; rows that wait; and a clock: the time of the one timer and of the last row stepped
    through, and whether rows wait. A key has few rows in a micro-batch, so that each call to the state and each value in it counts:
    rows come as they are, without a data frame for each key; thousands of them wait as one value; the clock is read and written once."""

    def __init__(self, stepper: Stepper, names: list[str], idle: int) -> None:
        self.stepper, self.idle = stepper, idle
        self.row = Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.stepper.state)
        self.held = handle.getListState("held", "rows binary")
        self.clock = handle.getValueState("clock", "timer bigint, last bigint, waiting boolean")

    def _set_timer(self, at: int, last: int | None, waiting: bool, old: int | None) -> None:
        if old != at:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
        self.clock.update((at, last, waiting))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        n = 1 + len(self.stepper.needed)
        # Rows without their first column only move the watermark. What isn't a number is missing.
        new = [tuple(None if v != v else v for v in row[-n:]) for row in rows if row[1 - n] is not None and row[1 - n] == row[1 - n]]
        if new:
            timer, last, waiting = self.clock.get() or (None, None, False)
            self.held.appendList(_packed(new))
            earliest = min(r[0] for r in new)
            self._set_timer(min(earliest, timer) if waiting else earliest, last, True, timer)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        _, last, waiting = self.clock.get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        rows = [r for part in self.held.get() for r in pickle.loads(part[0])] if waiting else []
        ready, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        out: list[tuple] = []
        if ready:
            ready.sort(key=lambda r: r[: 1 + self.stepper.order])
            state = self.kept.get() if last is not None else None
            for part in self._apart(ready):
                if last is not None and part[0][0] - last >= self.idle:
                    state = None
                state, found = self.stepper.step(key, state, [r[1:] for r in part])
                out += found
                last = part[-1][0]
            if state is not None:
                self.kept.update(state)
        if rest:
            self.held.put(_packed(rest))
            self._set_timer(min(r[0] for r in rest), last, True, None)
        elif last is not None and now < last + self.idle:
            if rows:
                self.held.clear()
            self._set_timer(last + self.idle, last, False, None if fired <= now else fired)
        else:
            for state in (self.held, self.kept, self.clock):
                state.clear()
        return iter([self.row(*key, *r) for r in out])

    def _apart(self, rows: list[tuple]) -> Iterator[list[tuple]]:
        """Rows between which no idle time passes. What begins anew doesn't depend on when the rows came."""
        part: list[tuple] = []
        for row in rows:
            if part and row[0] - part[-1][0] >= self.idle:
                yield part
                part = []
            part.append(row)
        yield part

    def close(self) -> None:
        pass


def _packed(rows: list[tuple], most: int = 4096) -> list[tuple]:
    return [(pickle.dumps(rows[i : i + most]),) for i in range(0, len(rows), most)]


def stepped(df: DataFrame, keys: list[str], time: str, stepper: Stepper, delay: str = "10 seconds", idle: str = "10 minutes") -> DataFrame:
    """What ``stepper`` gives for the sequences of ``keys`` in the stream ``df``, whose column ``time`` is a timestamp.

    ``delay`` is how late a row may come. Rows whose first needed column is null are heartbeats, which only move the watermark.
    """
    fields = StructType.fromDDL(stepper.output).fields
    output = StructType([df.schema[k] for k in keys] + fields)
    used = df.select(*keys, time, F.unix_millis(F.col(time).cast("timestamp")).alias("__at"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(stepper.needed)])
    processor = Stepped(stepper, [f.name for f in output.fields], milliseconds(idle))
    return used.withWatermark(time, delay).groupBy(*keys).transformWithState(processor, output, "Append", "EventTime")


_BOX = ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]


class BridgeStepper:
    """The tracking bridge: an annotation for each row, as ``tracking.tracking_bridge`` gives it."""

    needed = ["row_id", "frame_number", "frame_id", "detection_type", *_BOX, "confidence", "contact_label", "blue_glove_status", "is_filtered"]
    order = 1
    state = "next_id bigint, track_id bigint, missed int, no_contact_streak int, stationary_streak int, last array<double>, before array<double>"
    output = f"frame_number bigint, row_id bigint, {tracking.ADDED}"

    def __init__(self, config: tracking.BridgeConfig = tracking.BridgeConfig()) -> None:
        self.config = config.clamped()

    def step(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        before = tracking.BridgeState()
        if state is not None:
            next_id, track_id, missed, contact, stationary, last, previous = state
            track = None if track_id is None else tracking.Track(track_id, tuple(last), None if previous is None else tuple(previous), missed, contact, stationary)
            before = tracking.BridgeState(track, next_id)
        # In the order of ``tracking.NEEDED``, by frame.
        ordered = sorted(((key[0], r[1], r[2], r[0], *r[3:]) for r in rows), key=lambda r: (r[1], r[2], r[3]))
        out, after = tracking.annotate(ordered, before, self.config)
        t = after.track
        kept = (after.next_id, *((None,) * 6 if t is None else (t.track_id, t.missed, t.no_contact_streak, t.stationary_streak, list(t.last), None if t.before is None else list(t.before))))
        return kept, [r[1:] for r in out]


class RegionStepper:
    """Temporal regions: a row for each frame, as ``tracking.temporal_regions`` gives it."""

    needed = ["row_id", "frame_number", "detection_type", *_BOX, "confidence", "blue_glove_status"]
    order = 1
    state = "missed int, last array<double>"
    output = tracking.REGIONS.removeprefix("video_id bigint, ")

    def __init__(self, max_missed: int = 8, detect: object = None) -> None:
        self.max_missed, self.detect = max_missed, detect or tracking.above_or_in_region

    def step(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        now = tracking.RegionState() if state is None else tracking.RegionState(None if state[1] is None else tuple(state[1]), state[0])
        out = []
        for number, frame in groupby(sorted(rows, key=lambda r: (r[1], r[0])), key=lambda r: r[1]):
            now, what = tracking.frame_region(now, [r[2:] for r in frame], self.detect, self.max_missed)
            out.append((number, what, now.missed, *(now.last or (None,) * 4)))
        return (now.missed, None if now.last is None else list(now.last)), out


class KeptStepper:
    """Rows kept by a rule that looks at the last kept one, as ``runs.since_kept`` keeps them: the base of two filters."""

    def __init__(self, columns: dict[str, str], keep: object) -> None:
        self.needed, self.order, self.keep = list(columns), 2, keep
        self.state = self.output = ", ".join(f"{c} {t}" for c, t in columns.items())

    def step(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        last, out = state, []
        for row in rows:
            if last is None or self.keep(last, row):
                last = row
                out.append(row)
        return last, out


def stream_bridge(df: DataFrame, config: tracking.BridgeConfig = tracking.BridgeConfig(), time: str = "ts", delay: str = "10 seconds", idle: str = "10 minutes") -> DataFrame:
    """Annotations (``tracking.OUTPUT``) of a stream of detections with a timestamp, frame after frame."""
    return stepped(df, ["video_id"], time, BridgeStepper(config), delay, idle)


def stream_regions(df: DataFrame, max_missed: int = 8, time: str = "ts", delay: str = "10 seconds", idle: str = "10 minutes") -> DataFrame:
    """Stimulus regions (``tracking.REGIONS``) of a stream of detections with a timestamp."""
    return stepped(df, ["video_id"], time, RegionStepper(max_missed), delay, idle)


def stream_similarity_filter(df: DataFrame, keys: list[str], gap: float = 1.0, move: float = 0.05, area_change: float = 0.1, time: str = "ts", delay: str = "10 seconds", idle: str = "10 minutes") -> DataFrame:
    """``runs.similarity_filter`` of a stream; ``time`` is time_sec as a timestamp."""
    rows = df.where("time_sec is null or (cx is not null and cy is not null and area is not null and width is not null)")
    columns = {"time_sec": "double", "frame_idx": "bigint", "row_id": "bigint", "cx": "double", "cy": "double", "area": "double", "width": "double"}
    return stepped(_as(rows, columns), keys, time, KeptStepper(columns, similar_enough(gap, move, area_change)), delay, idle)


def stream_subsample(df: DataFrame, keys: list[str], interval: float = 2.0, time: str = "ts", delay: str = "10 seconds", idle: str = "10 minutes") -> DataFrame:
    """``runs.subsample`` of a stream; ``time`` is time_sec as a timestamp."""
    columns = {"time_sec": "double", "frame_idx": "bigint", "row_id": "bigint"}
    return stepped(_as(df, columns), keys, time, KeptStepper(columns, lambda last, x: x[0] - last[0] >= interval), delay, idle)


def _as(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in columns.items()})


#: Milliseconds of 2000-01-01, where seconds of sequences begin: a watermark begins at 1970, and what isn't later is late.
BEGIN = 946_684_800_000


def at_seconds(seconds: Column) -> Column:
    """Seconds of a sequence as a timestamp, to the millisecond."""
    return F.timestamp_millis(F.round(seconds * 1000).cast("bigint") + BEGIN)
