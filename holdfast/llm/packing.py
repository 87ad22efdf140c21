"""Packing of tokenised documents into sequences of fixed length by minimum bin slack.

Which lengths go together depends only on how many pieces there are of each length, at most ``size`` counts however large the
corpus. On these counts the driver fills bin after bin: the longest piece left opens a bin, and a subset-sum over the
lengths still there, with bitsets, finds the fullest way to fill the rest. That combination is taken as often as the counts
allow, so that the number of combinations, not of bins, decides the time. Each piece then finds its bin from its rank among
the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, steps, text_or_empty
from .tokens import encoder, tokenizer_path

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


#: Runs of text whose ids a worker remembers: half as many as for token files, as workers that have served other operators pack, too.
KEPT_RUNS = 300_000


def pieces(docs: DataFrame, size: int, tokenizer: str, end_id: int) -> DataFrame:
    """Pieces of all documents; ``task`` and ``nth`` tell pieces of one length apart (once these rows are written)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer, kept=KEPT_RUNS).encode, TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in steps(batches):
            ids, offsets = encode(batch.column("text"))
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            total = np.diff(offsets)
            n = -(-total // size)
            row = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = total - (n - 1) * size
            length = np.where(piece == 0, first[row], size)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
            at = offsets[:-1][row] + start
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=size + 1)
            crc = np.fromiter((zlib.crc32(ids[a : a + k]) for a, k in zip(at, length, strict=True)), np.int64, len(row))
            doc = batch.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [doc, *map(pa.array, (piece.astype(np.int32), start, length, crc, np.full(len(row), task, np.int32), nth))], names=[x.split()[0] for x in PIECES.split(", ")]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty()).mapInArrow(run, PIECES)


def fullest(counts: Counter, room: int) -> list[int]:
    """Lengths from ``counts`` whose sum is the most that fits into ``room``; long ones are preferred."""
    target, reach, trail = 1 << room, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            trail.append((length, reach))
            reach = more
        if reach & target:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(trail):
        if not before >> total & 1:
            out.append(length)
            total -= length
    return out


def combinations(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how many bins, lengths in each of them), in order, until no piece is left."""
    left, out = Counter({k: v for k, v in counts.items() if v}), []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest(+left, size - longest)]
        left[longest] += 1
        need = Counter(chosen)
        times = min(left[k] // v for k, v in need.items())
        out.append((times, chosen))
        for k, v in need.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
    return out


def slots(plan: list[tuple[int, list[int]]], size: int) -> dict[int, np.ndarray]:
    """For each length rows of (first rank, first bin, offset in the bin): rank r of a run of bins is bin first + r - first rank."""
    taken, rows, first_bin = Counter(), {}, 0
    for times, chosen in plan:
        offset = 0
        for length in chosen:
            rows.setdefault(length, []).append((taken[length], first_bin, offset))
            taken[length] += times
            offset += length
        first_bin += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Places of all documents in sequences of at most ``size`` tokens.

    A document is its ids and ``end_id``. Only documents longer than ``size`` are cut: all pieces but the first have ``size``
    tokens. Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty: one token.
    A very long text is encoded whole by one task, which holds its ids, and gives as many pieces as it needs. Repeated rows are
    packed as often as they come; a null doc_id is kept; other columns are ignored, whatever their names; an empty table gives
    no rows. Needs, besides one pass over the texts, rows of a few numbers for each piece, shuffled once. The plan of bins is
    broadcast: it has at most ``size`` lengths with one row for each combination, 0.23 MB for five million pieces.
    """
    rows = staged(pieces(docs, size, tokenizer or tokenizer_path(), end_id), "pieces")
    of_task = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    of_task = staged(of_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")), "ranks")
    counts = {r["length"]: r["n"] for r in of_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    plan = docs.sparkSession.sparkContext.broadcast(slots(combinations(counts, size), size))
    # A row for each length and task grows with the corpus: it is dealt out, not broadcast. A key has one task's pieces at most.
    ranked = rows.join(of_task.select("length", "task", "before").hint("merge"), ["length", "task"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            bins, offsets = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                here = np.flatnonzero(length == k)
                first, first_bin, offset = where[k][np.searchsorted(where[k][:, 0], rank[here], side="right") - 1].T
                bins[here], offsets[here] = first_bin + rank[here] - first, offset
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kept = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return kept.mapInArrow(place, PIECES.rpartition(", task")[0] + ", sequence_id bigint, offset bigint")
