"""Rows of sequences in order, as Arrow batches: for steps that depend on every row before, without a whole sequence in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..staging import shuffle_partitions


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` dealt by ``keys`` and sorted within each task: a sequence is one stretch of rows of one task."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches none of which ends within a group of rows that agree in ``keys``."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        other = np.zeros(table.num_rows, bool)
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
            other |= codes != codes[-1]
        end = int(other.nonzero()[0][-1]) + 1 if other.any() else 0
        if end:
            yield table.slice(0, end).combine_chunks().to_batches()[0]
        held = table.slice(end)
    if held is not None:
        yield held.combine_chunks().to_batches()[0]
