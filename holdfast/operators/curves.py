"""Tasks' part of average precision: detections in order of confidence as blocks, each one row with its outcomes and their sums.

A block is a stretch of a sorted task's rows of one class; a detection is two bits of it. So once detections are sorted, what
stands before a block and the best precision after it are windows over blocks, and no detection is dealt again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext

Batches = Iterator[pa.RecordBatch]


def blocks(by: list[str], scored: bool) -> Callable[[Batches], Batches]:
    """Sorted rows (by, tp, fp, and confidence if ``scored``) to blocks: by, task, no, n, hit, miss, hits, misses, and confidences."""

    def run(batches: Batches) -> Batches:
        task, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            other = np.zeros(batch.num_rows - 1, bool)
            for c in by:
                other |= np.diff(batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)) != 0
            cut = np.array([0, *(np.flatnonzero(other) + 1), batch.num_rows])
            n = len(cut) - 1
            outcomes = [pa.compute.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) == 1 for c in ("tp", "fp")]
            bits = [pa.array([np.packbits(x[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for x in outcomes]
            sums = [pa.array(np.add.reduceat(x, cut[:-1], dtype=np.int64)) for x in outcomes]
            own = [batch.column(c).take(pa.array(cut[:-1])) for c in by]
            score = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), batch.column("confidence"))] if scored else []
            names = [*by, "task", "no", "n", "hit", "miss", "hits", "misses", *(["confidences"] if scored else [])]
            yield pa.RecordBatch.from_arrays([*own, pa.array([task] * n, pa.int32()), pa.array(np.arange(no, no + n)), pa.array(np.diff(cut)), *bits, *sums, *score], names=names)
            no += n

    return run


def _curves(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: recall and precision after each of its rows, and places of hits."""
    columns = [batch.column(c).to_pylist() for c in ("n", "hit", "miss", "hits_before", "misses_before", "npos")]
    for n, *bits, hits, misses, npos in zip(*columns, strict=True):
        hit, miss = (np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b in bits)
        tp, fp = np.cumsum(hit, dtype=np.int64) + hits, np.cumsum(miss, dtype=np.int64) + misses
        yield tp / npos, tp / np.maximum(tp + fp, 2.0**-52), np.flatnonzero(hit)


def _with(batch: pa.RecordBatch, keep: list[str], **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns.values()], names=[*keep, *columns])


def best(by: list[str]) -> Callable[[Batches], Batches]:
    """Blocks to (by, task, no, best): the best precision in each. It rises only at hits; 0 where there is none."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield _with(batch, [*by, "task", "no"], best=pa.array([precision[at].max(initial=0.0) for _, precision, at in _curves(batch)], pa.float64()))

    return run


def areas(by: list[str]) -> Callable[[Batches], Batches]:
    """Blocks with the best precision ``beyond`` each to (by, ap): a block's part of the area below the envelope."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            beyond, npos = (batch.column(c).to_pylist() for c in ("beyond", "npos"))
            envelopes = (np.maximum(np.maximum.accumulate(precision[at][::-1]), b) for b, (_, precision, at) in zip(beyond, _curves(batch), strict=True))
            yield _with(batch, by, ap=pa.array([float((e / n).sum()) for e, n in zip(envelopes, npos, strict=True)], pa.float64()))

    return run


def best_at_recalls(by: list[str], recalls: list[float]) -> Callable[[Batches], Batches]:
    """Blocks to (by, best): the best precision at or beyond each of ``recalls``; 0 where there is none."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [[precision[at][recall[at] >= r].max(initial=0.0) for r in recalls] for recall, precision, at in _curves(batch)]
            yield _with(batch, by, best=pa.array(found, pa.list_(pa.float64())))

    return run


def best_scores(by: list[str]) -> Callable[[Batches], Batches]:
    """Blocks to (by, npos, f, confidence): the greatest precision x recall / (precision + recall) and the first confidence that has it."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            f, place, begin = [], [], batch.column("confidences").offsets.to_numpy()
            for i, (recall, precision, _) in enumerate(_curves(batch)):
                both = precision + recall
                each = np.divide(precision * recall, both, out=np.zeros(len(both)), where=both > 0)
                f.append(each.max())
                place.append(int(begin[i] + each.argmax()))
            yield _with(batch, [*by, "npos"], f=pa.array(f, pa.float64()), confidence=batch.column("confidences").values.take(pa.array(place, pa.int64())))

    return run
