"""The tracking bridge on a stream: state by video, frames stepped in order as micro-batches bring them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import NEEDED, OUTPUT, STATE, BridgeConfig, BridgeState, annotate, packed, unpacked


def stream_bridge(df: DataFrame, config: BridgeConfig = BridgeConfig(), idle_ms: int = 60_000, forget_ms: int = 3_600_000) -> DataFrame:
    """Annotations (see ``operators.tracking.OUTPUT``) of a stream of detections.

    A video's last frame is held until a later one shows that it is complete, or nothing has come for ``idle_ms``; rows of a
    frame that comes after a later one was stepped through are dropped. Within a batch the order of rows doesn't matter. A video
    for which nothing has come for ``forget_ms`` after that is forgotten. Processing time decides; ``sequences.stream_bridge`` goes
    by the frames' own.
    """
    config = config.clamped()
    names = [x.split()[0] for x in OUTPUT.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        old = json.loads(group.get[0]) if group.exists else {"bridge": packed(BridgeState()), "done": None}
        rows = [tuple(r) for r in json.loads(group.get[1])] if group.exists else []
        for pdf in frames:
            rows += [tuple(None if v is None or v != v else (v.item() if hasattr(v, "item") else v) for v in r) for r in pdf[NEEDED].itertuples(index=False, name=None)]
        rows = sorted({(r[1], r[2], r[3]): r for r in rows}.values(), key=lambda r: (r[1], r[2], r[3]))
        if old["done"] is not None:
            rows = [r for r in rows if [r[1], r[2]] > old["done"]]
        last = (rows[-1][1], rows[-1][2]) if rows else None
        ready = rows if group.hasTimedOut else [r for r in rows if (r[1], r[2]) != last]
        held = rows[len(ready) :]
        out, state = annotate(ready, unpacked(old["bridge"]), config)
        done = [ready[-1][1], ready[-1][2]] if ready else old["done"]
        if group.hasTimedOut and not rows:
            group.remove()
            return
        group.update((json.dumps({"bridge": packed(state), "done": done}), json.dumps(held)))
        group.setTimeoutDuration(idle_ms if held else forget_ms)
        yield pd.DataFrame(out, columns=names)

    return df.select(*NEEDED).groupBy("video_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
