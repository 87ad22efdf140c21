"""Run-length masks: column-major runs of zeros and ones in turn, as arrays of counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(mask: np.ndarray) -> list[int]:
    """Counts of a 0/1 mask (height, width)."""
    flat = np.asarray(mask, bool).ravel(order="F")
    edges = np.flatnonzero(np.diff(flat)) + 1
    counts = np.diff(np.concatenate([[0], edges, [len(flat)]])) if len(flat) else np.zeros(0, int)
    return [0, *counts.tolist()] if len(flat) and flat[0] else counts.tolist()


def decode(counts: list[int], height: int, width: int) -> np.ndarray:
    flat = np.repeat(np.arange(len(counts)) % 2, counts)
    return flat.reshape((height, width), order="F").astype(np.uint8)


def merge(runs: list[list[int]], height: int, width: int, intersect: bool = False) -> list[int]:
    """Union or intersection of masks of one size."""
    stack = np.stack([decode(c, height, width) for c in runs])
    return encode(stack.all(axis=0) if intersect else stack.any(axis=0))


def iou(a: list[int], b: list[int], crowd: bool = False) -> float:
    """Overlap of two masks of one size; against a crowd over a's own area."""
    ends = np.union1d(np.cumsum(a), np.cumsum(b))
    sizes = np.diff(np.concatenate([[0], ends]))
    inside = lambda c: (np.searchsorted(np.cumsum(c), ends, side="left") % 2) == 1
    x, y = inside(a), inside(b)
    inter = sizes[x & y].sum()
    union = sizes[x].sum() if crowd else sizes[x | y].sum()
    return float(inter / union) if union else 0.0


def to_string(counts: list[int]) -> str:
    """Text form: differences to the count two before, 5 bits a character from code 48 on, 32 marking that more follow."""
    out = []
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        more = True
        while more:
            low = x & 31
            x >>= 5
            more = x != (-1 if low & 16 else 0)
            out.append(chr((low | 32 if more else low) + 48))
    return "".join(out)


def from_string(text: str) -> list[int]:
    counts: list[int] = []
    x = shift = 0
    for c in text:
        v = ord(c) - 48
        x |= (v & 31) << shift
        shift += 5
        if not v & 32:
            if v & 16:
                x -= 1 << shift
            counts.append(x + counts[-2] if len(counts) > 2 else x)
            x = shift = 0
    return counts


def area(counts: Column) -> Column:
    """Sum of the runs of ones, in the JVM."""
    return F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, x: a + x)


def bounds(counts: list[int], height: int) -> tuple[int, int, int, int]:
    """(x, y, width, height) of the ones; zeros if there are none."""
    ends = np.cumsum(counts)
    starts, stops = ends[0::2][: len(counts) // 2], ends[1::2] - 1
    keep = stops >= starts
    starts, stops = starts[keep], stops[keep]
    if not len(starts):
        return 0, 0, 0, 0
    x1, x2 = int((starts // height).min()), int((stops // height).max())
    whole = (starts // height != stops // height).any()
    y1, y2 = (0, height - 1) if whole else (int((starts % height).min()), int((stops % height).max()))
    return x1, y1, x2 - x1 + 1, y2 - y1 + 1


# Columns: the same in the JVM, run by run, without a mask's pixels.

_LONGS = "array<bigint>"


def _nothing() -> Column:
    return F.array().cast(_LONGS)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often the lambdas in ``then`` use it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _together(a: Column, b: Column, start: dict[str, Column], each: Callable[[Column, Column, Column, Column], dict[str, Column]], finish: Callable[[Column], Column]) -> Column:
    """A fold over the stretches on which neither of two masks changes: ``each`` of (what was, length, in a, in b). Null where a
    mask is null or their sizes differ."""
    return _let(F.struct(a.cast(_LONGS).alias("a"), b.cast(_LONGS).alias("b")), lambda m: _stretches(m.a, m.b, start, each, finish))


def _stretches(a: Column, b: Column, start: dict[str, Column], each: Callable[[Column, Column, Column, Column], dict[str, Column]], finish: Callable[[Column], Column]) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.size(a) + F.size(b), F.lit(1)))

    def step(s: Column, _: Column) -> Column:
        c = F.coalesce(F.least(s.left_a, s.left_b), F.lit(0).cast("bigint"))
        done_a, done_b = s.left_a == c, s.left_b == c
        new = each(s, c, (s.i % 2 == 1) & s.left_a.isNotNull(), (s.j % 2 == 1) & s.left_b.isNotNull())
        i, j = s.i + F.coalesce(done_a, F.lit(False)).cast("int"), s.j + F.coalesce(done_b, F.lit(False)).cast("int")
        return F.struct(
            i.alias("i"), j.alias("j"), F.when(done_a, F.get(a, i)).otherwise(s.left_a - c).alias("left_a"), F.when(done_b, F.get(b, j)).otherwise(s.left_b - c).alias("left_b"),
            *[v.alias(k) for k, v in new.items()],
        )

    first = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.get(a, F.lit(0)).alias("left_a"), F.get(b, F.lit(0)).alias("left_b"), *[v.alias(k) for k, v in start.items()])
    return F.when(_total(a) == _total(b), F.aggregate(places, first, step, finish))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda n, x: n + x)


def merged(a: Column, b: Column, intersect: bool = False) -> Column:
    """Runs of the union (or intersection) of two masks of one size, without runs of length 0 but for the first."""

    def each(s: Column, c: Column, in_a: Column, in_b: Column) -> dict[str, Column]:
        value = (in_a & in_b) if intersect else (in_a | in_b)
        ends = (value != s.value) & (c > 0)
        return {"out": F.when(ends, F.concat(s.out, F.array(s.held))).otherwise(s.out), "held": F.when(ends, c).otherwise(s.held + c), "value": F.when(ends, value).otherwise(s.value)}

    zero = F.lit(0).cast("bigint")
    return _together(a, b, {"out": _nothing(), "held": zero, "value": F.lit(False)}, each, lambda s: F.when((s.held > 0) | (F.size(s.out) > 0), F.concat(s.out, F.array(s.held))).otherwise(s.out))


def merged_all(masks: Column, intersect: bool = False) -> Column:
    """Runs of the union (or intersection) of an array of masks of one size; null if there are none."""
    return F.aggregate(F.slice(masks.cast(f"array<{_LONGS}>"), 2, F.greatest(F.size(masks), F.lit(1))), F.get(masks, F.lit(0)).cast(_LONGS), lambda a, m: merged(a, m, intersect))


def overlap(a: Column, b: Column, crowd: Column | bool = False) -> Column:
    """Shared pixels of two masks of one size over those of either; over a's own where b is a crowd; 0 without shared ones."""
    zero = F.lit(0).cast("bigint")

    def each(s: Column, c: Column, in_a: Column, in_b: Column) -> dict[str, Column]:
        add = lambda name, some: s[name] + F.when(some, c).otherwise(zero)
        return {"inter": add("inter", in_a & in_b), "union": add("union", in_a | in_b), "own": add("own", in_a)}

    crowd = F.lit(crowd) if isinstance(crowd, bool) else F.coalesce(crowd, F.lit(False))
    return _together(a, b, dict.fromkeys(("inter", "union", "own"), zero), each, lambda s: F.when(s.inter > 0, s.inter.cast("double") / F.when(crowd, s.own).otherwise(s.union)).otherwise(0.0))


def box(counts: Column, height: Column, whole: bool = False) -> Column:
    """(x, y, w, h) of the ones; zeros without a run of ones.

    y and h are of the places where runs begin and end. With ``whole`` a run that goes on into another column counts as
    reaching from the top to the bottom, as it does.
    """
    counts, height = counts.cast(_LONGS), height.cast("bigint")
    far, zero = F.lit(1 << 60).cast("bigint"), F.lit(0).cast("bigint")

    def step(s: Column, n: Column) -> Column:
        end = s.at + n
        ones = s.nth % 2 == 1
        (x1, y1), (x2, y2) = ((F.floor(p / height).cast("bigint"), F.pmod(p, height)) for p in (s.at, end - 1))
        top, low = F.least(y1, y2), F.greatest(y1, y2)
        if whole:
            top, low = F.when(x1 == x2, top).otherwise(zero), F.when(x1 == x2, low).otherwise(height - 1)
            ones = ones & (n > 0)
        pick = lambda new, old: F.when(ones, new).otherwise(old)
        return F.struct(
            (s.nth + 1).alias("nth"), end.alias("at"), pick(F.least(s.x1, x1, x2), s.x1).alias("x1"), pick(F.greatest(s.x2, x1, x2), s.x2).alias("x2"),
            pick(F.least(s.y1, top), s.y1).alias("y1"), pick(F.greatest(s.y2, low), s.y2).alias("y2"),
        )

    first = F.struct(F.lit(0).alias("nth"), zero.alias("at"), far.alias("x1"), zero.alias("x2"), far.alias("y1"), zero.alias("y2"))
    some = lambda s, v: F.when(s.x1 < far, v).otherwise(zero)
    found = lambda s: F.struct(some(s, s.x1).alias("x"), some(s, s.y1).alias("y"), some(s, s.x2 - s.x1 + 1).alias("w"), some(s, s.y2 - s.y1 + 1).alias("h"))
    return F.aggregate(counts, first, step, found)


# Columns of whole Arrow batches: for many rows, as the JVM's lambdas take some tens of microseconds a fold.


def _ends(counts: pa.Array, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the kept rows: where their runs end, one after another; where each row's runs begin in that, and each mask's size."""
    rows = counts.filter(pa.array(keep))
    starts = rows.offsets.to_numpy().astype(np.int64)
    flat = np.concatenate([[0], np.cumsum(rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
    starts = starts - starts[0]
    sizes = np.diff(starts)
    return flat[1:] - np.repeat(flat[starts[:-1]], sizes), starts, flat[starts[1:]] - flat[starts[:-1]]


def _with_nulls(counts: pa.Array) -> np.ndarray:
    """Rows that are null or hold a null."""
    out = counts.is_null().to_numpy(zero_copy_only=False).copy()
    if counts.flatten().null_count:
        out |= np.array([r is not None and None in r for r in counts.to_pylist()])
    return out


def compare_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """Structs (united, shared_pixels, either_pixels, own_pixels) of rows' masks; null where one is null or their sizes differ.

    Places where a run ends are numbers that rise from row to row, so that one sort and two searches serve the batch.
    """
    keep = ~(_with_nulls(a) | _with_nulls(b))
    (ends_a, from_a, size), (ends_b, from_b, size_b) = _ends(a, keep), _ends(b, keep)
    same = size == size_b
    if not same.all():
        keep[np.flatnonzero(keep)[~same]] = False
        (ends_a, from_a, size), (ends_b, from_b, _) = _ends(a, keep), _ends(b, keep)
    n = len(size)
    base = np.concatenate([[0], np.cumsum(size + 1)])
    at_a, at_b = (e + np.repeat(base[:n], np.diff(f)) for e, f in ((ends_a, from_a), (ends_b, from_b)))
    # Each row also begins and ends a stretch, so that stretches tile it.
    places = np.unique(np.concatenate([at_a, at_b, base[:n], base[:n] + size]))
    row = np.searchsorted(base, places, "right") - 1
    in_a, in_b = (((np.searchsorted(at, places, "right") - f[row]) % 2 == 1) for at, f in ((at_a, from_a), (at_b, from_b)))
    inner = places < base[row] + size[row]
    length = np.where(inner, np.append(places[1:], 0) - places, 0)
    pixels = [np.bincount(row, np.where(some, length, 0), n).astype(np.int64) for some in (in_a & in_b, in_a | in_b, in_a)]
    either = in_a | in_b
    first = np.append(True, row[1:] != row[:-1])[: len(row)]
    turns = inner & (either != np.where(first, False, np.append(False, either[:-1])[: len(row)]))
    stops = np.sort(np.concatenate([places[turns], (base[:n] + size)[size > 0]]))
    of = np.searchsorted(base, stops, "right") - 1
    begins = np.append(True, of[1:] != of[:-1])[: len(of)]
    runs = stops - np.where(begins, base[of], np.append(0, stops[:-1])[: len(of)])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(runs, pa.int64())), *map(pa.array, pixels)], ["united", "shared_pixels", "either_pixels", "own_pixels"])
    return found.take(pa.array(np.where(keep, np.cumsum(keep) - 1, 0), pa.int64(), mask=~keep))


def compared(a: Column, b: Column) -> Column:
    """A struct for two masks of one size: runs of their union (as ``merged``), shared pixels, pixels of either, and a's own."""

    @F.arrow_udf("united array<bigint>, shared_pixels bigint, either_pixels bigint, own_pixels bigint")
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        return compare_batch(a, b)

    return compare(a.cast(_LONGS), b.cast(_LONGS))


#: Fixed value: corners are rounded to this part of a pixel.
FINE = 5


def polygon_batch(corners: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    """Runs of rows' polygons, as ``polygon`` says; null where something is null.

    A row of numpy's is an edge first, then a column of pixels that an edge crosses; one sort of places serves the batch.
    """
    flat = corners.flatten()
    x, y = (pa.compute.struct_field(flat, [i]) for i in (0, 1))
    bad = corners.is_null().to_numpy(zero_copy_only=False) | height.is_null().to_numpy(zero_copy_only=False) | width.is_null().to_numpy(zero_copy_only=False)
    if x.null_count or y.null_count:
        bad |= np.array([c is not None and any(p is None or p["x"] is None or p["y"] is None for p in c) for c in corners.to_pylist()], bool)
    kept = corners.filter(pa.array(~bad))
    flat, starts = kept.flatten(), kept.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    high, wide = (c.filter(pa.array(~bad)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (height, width))
    n, sizes = len(starts) - 1, np.diff(starts)
    x, y = ((pa.compute.struct_field(flat, [i]).to_numpy(zero_copy_only=False).astype(float) * FINE + 0.5).astype(np.int64) for i in (0, 1))
    row = np.repeat(np.arange(n), sizes)
    after = np.arange(1, len(x) + 1)
    after[starts[1:][sizes > 0] - 1] = starts[:-1][sizes > 0]
    bx, by = x[after], y[after]
    level = np.abs(bx - x) >= np.abs(by - y)
    # From left to right, or, of a steep edge, from top to bottom.
    turned = np.where(level, x > bx, y > by)
    x1, y1, x2, y2 = (np.where(turned, b, a) for a, b in ((x, bx), (y, by), (bx, x), (by, y)))
    middle = FINE // 2
    # The middle of column c is between the lattice's places FINE * c + 2 and the next.
    begin = np.maximum(-((middle - np.minimum(x1, x2)) // FINE), 0)
    end = np.minimum(-((middle - np.maximum(x1, x2)) // FINE), wide[row]) - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(level, (y2 - y1) / (x2 - x1), (x2 - x1) / (y2 - y1))
    count = np.maximum(end - begin + 1, 0)
    edge = np.repeat(np.arange(len(x)), count)
    column = begin[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count)
    u, x1, y1, slope, level, steps, of = column * FINE + middle, x1[edge], y1[edge], slope[edge], level[edge], (y2 - y1)[edge], row[edge]
    place = np.empty(len(edge), np.int64)
    i = np.flatnonzero(level)
    lines = [(y1[i] + slope[i] * t + 0.5).astype(np.int64) for t in (u[i] - x1[i], u[i] + 1 - x1[i])]
    place[i] = np.minimum(*lines)
    # A steep edge: the last row before it changes sides, near where it would by real numbers.
    i = np.flatnonzero(~level)
    low = np.maximum(np.floor((u[i] + 0.5 - x1[i]) / slope[i]).astype(np.int64) - 2, 0)
    found = np.full(len(i), -1)
    for t in (low + k for k in range(4, -1, -1)):
        left, right = ((x1[i] + slope[i] * v + 0.5).astype(np.int64) <= u[i] for v in (t, t + 1))
        found = np.where((t < steps[i]) & (left != right), t, found)
    place[i], lost = y1[i] + found, i[found < 0]
    at = column * high[of] + np.clip(-((middle - place) // FINE), 0, high[of])
    size = high * wide
    inside = at < size[of]
    inside[lost] = False
    # A place that comes an even number of times is none; each mask's end is one more.
    base = np.concatenate([[0], np.cumsum(size + 1)])
    places, times = np.unique(at[inside] + base[of[inside]], return_counts=True)
    stops = np.sort(np.concatenate([places[times % 2 == 1], base[:n] + size]))
    of = np.searchsorted(base, stops, "right") - 1
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    runs = stops - np.where(first, base[of], np.append(0, stops[:-1])[: len(of)])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(runs, pa.int64())).take(pa.array(np.where(bad, 0, np.cumsum(~bad) - 1), pa.int64(), mask=bad))


def polygon(corners: Column, height: Column, width: Column) -> Column:
    """Runs of a polygon's mask, from an array of its corners (x, y), for whole Arrow batches.

    Scan lines are the columns of pixels: each edge that crosses a column's middle says at which row the inside begins or ends
    there, by the lattice line of ``FINE`` steps a pixel that is nearest to the edge; two such places that are the same cancel.
    What is beyond the image is cut off. Fewer than three corners enclose nothing.
    """

    @F.arrow_udf(_LONGS)
    def runs(corners: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
        return polygon_batch(corners, height, width)

    return runs(corners.cast("array<struct<x:double,y:double>>"), height.cast("bigint"), width.cast("bigint"))
