"""Images through a pluggable detector: one per Python worker, batches of bytes in, rows of detections out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

DETECTIONS = "path string, detection_type string, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, confidence double, contact_state int, hand_side int, offset_x double, offset_y double, offset_mag double, blue_prop double"
Detector = Callable[[bytes], list[tuple]]


def detect(images: DataFrame, factory: Callable[[], Detector]) -> DataFrame:
    """``images`` (path, content); ``factory`` is called once for each task and gives a function from bytes to rows.

    A row is DETECTIONS without the path. Confidence is a truncated percent, as everywhere in this engine.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory()
        names = [x.split()[0] for x in DETECTIONS.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([(p, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in detector(c)], columns=names)

    return images.select("path", "content").mapInPandas(run, DETECTIONS)
