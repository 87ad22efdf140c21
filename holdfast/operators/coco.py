"""Tasks' part of the COCO-like scores: images folded, and curves summed, for all combinations of areas and thresholds at once.

An outcome is one bit a combination (kind of area, then threshold), packed in words of 64; a detection stays one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext

#: Detections and truths that one vectorised step folds, and pairs of them whose overlap is computed at once.
STEP, PAIRS = 50_000, 1 << 21
Batches = Iterator[pa.RecordBatch]


def packed(bits: np.ndarray) -> pa.Array:
    """Rows of booleans as lists of 64-bit words."""
    n, c = bits.shape
    words = -(-c // 64)
    out = np.zeros((n, words * 8), np.uint8)
    out[:, : -(-c // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * words + 1, words, dtype=np.int32)), pa.array(out.view(np.int64).ravel()))


def unpacked(words: np.ndarray, c: int) -> np.ndarray:
    """(rows, c) booleans of the words."""
    return np.unpackbits(words.view(np.uint8).reshape(-1, -(-c // 64) * 8), axis=1, bitorder="little", count=c).astype(bool)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten()


def _numbers(rows: pa.StructArray, *names: str) -> list[np.ndarray]:
    """Fields as doubles, null as NaN."""
    return [pa.compute.cast(rows.field(c), pa.float64()).to_numpy(zero_copy_only=False) for c in names]


def _near(of: np.ndarray, n: np.ndarray, first: np.ndarray, d: list[np.ndarray], g: list[np.ndarray], crowd: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(detection, truth, overlap) of pairs in one image that overlap by ``least``; a missing coordinate is left out of minima and maxima."""
    per, found = n[of], []
    upto = np.cumsum(per)
    begin = 0
    while begin < len(of):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        here = per[begin:end]
        i = np.repeat(np.arange(begin, end), here)
        j = np.arange(len(i)) - np.repeat(np.cumsum(here) - here, here) + first[of[i]]
        x, y, w, h = (c[i] for c in d)
        gx, gy, gw, gh = (c[j] for c in g)
        inter = np.fmax(0, np.fmin(x + w, gx + gw) - np.fmax(x, gx)) * np.fmax(0, np.fmin(y + h, gy + gh) - np.fmax(y, gy))
        over = inter / np.fmax(1e-300, np.where(crowd[j], w * h, w * h + gw * gh - inter))
        some = over >= least
        found.append((i[some], j[some], over[some]))
        begin = end
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _fold(ds: pa.Array, gs: pa.Array, low: np.ndarray, high: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, rank, matched, ignored) of all detections; the last two have a column a combination."""
    (d_at, d), (g_at, g) = _lists(ds), _lists(gs)
    of, n = np.repeat(np.arange(len(ds)), np.diff(d_at)), np.diff(g_at)
    rank = np.arange(len(d)) - d_at[of]
    box, (*truth, area) = _numbers(d, "x", "y", "w", "h"), _numbers(g, "x", "y", "w", "h", "area")
    crowd, out = (pa.compute.fill_null(g.field("crowd"), False).to_numpy(zero_copy_only=False), pa.compute.cast(g.field("ignored"), pa.int8()).fill_null(-1).to_numpy())
    # Whether a truth counts: 2 yes, 1 no, 0 unknown.
    beyond = (out == 1)[:, None] | (area[:, None] < low) | (area[:, None] > high)
    use = np.where(beyond, 1, np.where(((out == -1) | np.isnan(area))[:, None], 0, 2))
    size = (box[2] * box[3])[:, None]
    outside = (size < low) | (size > high) | np.isnan(size)
    shape = (len(d), len(low), len(thresholds))
    matched, ignored = np.zeros(shape, bool), np.repeat(outside[:, :, None], len(thresholds), axis=2)
    bound = np.minimum(thresholds, 1 - 1e-10)
    i, j, over = _near(of, n, g_at[:-1], box, truth, crowd, bound.min())
    order = np.lexsort((j, over, i, rank[i]))
    i, j, over = i[order], j[order], over[order]
    # A pair's worth: one that counts before one that doesn't, then by overlap, then the last; detections of one rank are of different images.
    p = max(1, len(i))
    worth = use[j] * p + np.arange(len(i))[:, None]
    taken = np.zeros((len(g), *shape[1:]), bool)
    cuts = np.flatnonzero(np.diff(rank[i], prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(i)], strict=True):
        own, truths = i[a:b], j[a:b]
        free = (over[a:b, None, None] >= bound) & (crowd[truths][:, None, None] | ~taken[truths])
        best = np.maximum.reduceat(np.where(free, worth[a:b, :, None], -1), starts := np.flatnonzero(np.diff(own, prepend=-1)), axis=0)
        row = own[starts]
        r, k, t = np.nonzero(best >= 0)
        pick, counts = j[best[r, k, t] % p], best[r, k, t] // p
        matched[row[r], k, t] = True
        ignored[row[r], k, t] = np.where(counts == 0, outside[row[r], k], counts == 1)
        taken[pick, k, t] = True
    return of, rank, matched.reshape(len(d), -1), ignored.reshape(len(d), -1)


def folding(low: list[float], high: list[float], thresholds: list[float]) -> Callable[[Batches], Batches]:
    """(image_id, category_id, ds, gs) to (.., det_id, score, rank, matched, ignored)."""
    low, high, thresholds = np.array(low), np.array(high), np.array(thresholds)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sizes = np.cumsum(np.diff(batch.column("ds").offsets) + np.diff(batch.column("gs").offsets)) if batch.num_rows else np.zeros(0)
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + STEP, "right")))
                part = batch.slice(begin, end - begin)
                of, rank, matched, ignored = _fold(part.column("ds"), part.column("gs"), low, high, thresholds)
                d, of = part.column("ds").flatten(), pa.array(of)
                yield pa.RecordBatch.from_arrays([part.column("image_id").take(of), part.column("category_id").take(of), d.field("det_id"), d.field("score"), pa.array(rank.astype(np.int32)), packed(matched), packed(ignored)], names=["image_id", "category_id", "det_id", "score", "rank", "matched", "ignored"])
                begin = end

    return run


def _by_category(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    coded = batch.column("category_id").dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _outcomes(batch: pa.RecordBatch, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Hits and misses among what isn't ignored."""
    matched, ignored = (unpacked(batch.column(k).flatten().to_numpy(), c) for k in ("matched", "ignored"))
    return matched & ~ignored, ~matched & ~ignored


def blocks(c: int) -> Callable[[Batches], Batches]:
    """Rows in order of a curve to runs of one category, each one row: its place (task, no), its outcomes and their sums."""

    def run(batches: Batches) -> Batches:
        task, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            _, code = _by_category(batch)
            cut = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            hit, miss = _outcomes(batch, c)
            sums = [np.add.reduceat(x, cut[:-1], axis=0, dtype=np.int64) for x in (hit, miss)]
            bits = [np.packbits(x, axis=1) for x in (hit, miss)]
            n = len(cut) - 1
            at = pa.array(np.arange(0, n * c + 1, c, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("category_id").take(pa.array(cut[:-1])), pa.array([task] * n, pa.int32()), pa.array(np.arange(no, no + n)), *(pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for x in bits), *(pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in sums)],
                names=["category_id", "task", "no", "hit", "miss", "hits", "misses"],
            )
            no += n

    return run


def best_of_blocks(c: int) -> Callable[[Batches], Batches]:
    """Blocks with what stands before them, [hits, misses] a combination, and the truths of each, to (category_id, combination, at, precision).

    Of rows with equally many hits the first, a hit, has the best precision; so only hits are looked at.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r in range(batch.num_rows):
                hit, miss = (np.unpackbits(np.frombuffer(batch.column(k)[r].as_py(), np.uint8).reshape(-1, -(-c // 8)), axis=1, count=c) for k in ("hit", "miss"))
                before, npos = (np.array(batch.column(k)[r].as_py(), np.int64) for k in ("before", "npos"))
                k, i = np.nonzero(hit.T)
                tp = (np.cumsum(hit, axis=0, dtype=np.int64) + before[:c])[i, k]
                fp = (np.cumsum(miss, axis=0, dtype=np.int64) + before[c:])[i, k]
                some = npos[k] > 0
                k, tp, fp = k[some], tp[some], fp[some]
                at = np.floor(tp / npos[k] * 100 + 1e-9).astype(np.int64)
                start = np.flatnonzero((np.diff(k, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
                best = np.maximum.reduceat(tp / (tp + fp), start) if len(start) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("category_id").take(pa.array([r] * len(start), pa.int64())), pa.array(k[start].astype(np.int32)), pa.array(at[start].astype(np.int32)), pa.array(best)], names=["category_id", "combination", "at", "precision"])

    return run


def hits_of_firsts(c: int, firsts: tuple[int, ...]) -> Callable[[Batches], Batches]:
    """Detections to (category_id, combination, hits_k ...), partial sums of a batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            of, code = _by_category(batch)
            hit, _ = _outcomes(batch, c)
            i, k = np.nonzero(hit)
            rank, key = batch.column("rank").to_numpy()[i], code[i] * c + k
            found, place = np.unique(key, return_inverse=True)
            sums = [np.bincount(place[rank < first], minlength=len(found)) for first in firsts]
            yield pa.RecordBatch.from_arrays([of.take(pa.array((found // c).astype(np.int64))), pa.array((found % c).astype(np.int32)), *(pa.array(s.astype(np.int64)) for s in sums)], names=["category_id", "combination", *(f"hits_{f}" for f in firsts)])

    return run
