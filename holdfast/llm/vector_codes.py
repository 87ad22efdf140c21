"""Vector code compression: each part of a vector becomes the number of the nearest entry of its codebook.

The nearest entry is found by segment-mean lower bounds. The means of a part's blocks and the norm of what the means leave
bound a squared distance from below (by Cauchy and Schwarz); from one block to ever finer ones, entries whose bound is above the
distance of the best entry so far go. Bounds are floating point with room for rounding, so no nearest entry is lost; what
survives gets exact integer distances.

Codebooks are the only thing that the driver holds: ``parts`` times ``entries`` entries. Sums for a round are made in the tasks
and added up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, numbered, staged

#: A component is this many times its value, rounded down.
SCALE = 1024
#: Vectors whose distances to all entries are bounded at once, and pairs whose exact distances are.
STEP, PAIRS = 2048, 1 << 16
#: Sums of so many components travel as one row.
WIDTH = 16
#: Room for rounding in a bound, relative to the squared norms: that of the residual norm's square root prevails, 1e-7.
SLACK = 1e-6


def cuts(length: int, n: int) -> list[int]:
    return [length * i // n for i in range(n + 1)]


class Book:
    """Entries (integers, one a row) with the block sums and residual norms of each level of blocks: 1, 2, 4, ... of them."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.width = entries, entries.shape[1]
        self.levels = [cuts(self.width, n) for n in (1 << k for k in range(self.width.bit_length())) if n < self.width or n == 1]
        self.energy = (entries.astype(float) ** 2).sum(axis=1)
        self.means = [self.blocks(entries, at) for at in self.levels]

    @staticmethod
    def blocks(rows: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Block means times the root of the block's length, so that squares of differences count as often as the block is long; residual norms."""
        lengths = np.diff(at)
        means = np.add.reduceat(rows, at[:-1], axis=1) / np.sqrt(lengths)
        return means, np.sqrt(np.maximum((rows.astype(float) ** 2).sum(axis=1) - (means**2).sum(axis=1), 0))

    def exact(self, rows: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Squared distances of pairs (row, entry)."""
        out = np.empty(len(row), np.int64)
        for i in range(0, len(row), PAIRS):
            apart = rows[row[i : i + PAIRS]] - self.entries[entry[i : i + PAIRS]]
            out[i : i + PAIRS] = (apart * apart).sum(axis=1)
        return out

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row (int64), the first of equally near ones, and its squared distance."""
        n = len(rows)
        if not self.width:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        code, error = np.empty(n, np.int64), np.empty(n, np.int64)
        for i in range(0, n, STEP):
            code[i : i + STEP], error[i : i + STEP] = self._nearest(rows[i : i + STEP])
        return code, error

    def _nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(rows), len(self.entries)
        room = SLACK * ((rows.astype(float) ** 2).sum(axis=1)[:, None] + self.energy)
        best = np.full(n, np.iinfo(np.int64).max)
        for level, at in enumerate(self.levels):
            (mean, norm), (means, norms) = self.blocks(rows, at), self.means[level]
            if not level:  # all pairs: one mean each
                bound = ((mean - means.T) ** 2 + (norm[:, None] - norms) ** 2 - room).ravel()
                row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
            else:
                bound = np.empty(len(row))
                for i in range(0, len(row), PAIRS):
                    r, e = row[i : i + PAIRS], entry[i : i + PAIRS]
                    bound[i : i + PAIRS] = ((mean[r] - means[e]) ** 2).sum(axis=1) + (norm[r] - norms[e]) ** 2 - room[r, e]
            # Every row still has an entry: that of the least distance so far has a bound below it.
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            least = _first_least(bound, row, first)
            best = np.minimum(best, self.exact(rows, row[least], entry[least]))
            stays = bound <= best[row]
            row, entry = row[stays], entry[stays]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        exact = self.exact(rows, row, entry)
        least = _first_least(exact, row, first)
        return entry[least], exact[least]


def _first_least(values: np.ndarray, group: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of the first least value of each group; groups lie together and begin at ``first``."""
    least = np.minimum.reduceat(values, first)
    hit = np.flatnonzero(values == np.repeat(least, np.diff(np.append(first, len(values)))))
    return hit[np.concatenate([[True], group[hit][1:] != group[hit][:-1]])]


def integers(vectors: DataFrame, column: str, to: str) -> DataFrame:
    """``vectors`` with the integers floor(``SCALE`` * x) of each vector in ``to``, in place of ``column``.

    Rows whose vector is null or has null or non-finite components go. ``to`` is null if a component is so large that squared
    distances might not fit a long.
    """
    given, (*names, v), own = numbered(vectors.select(*[named(c) for c in vectors.columns if c != column], named(column)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(v)
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
            row = np.repeat(np.arange(len(length)), length)
            keep = pc.is_valid(lists).to_numpy(zero_copy_only=False)
            keep = keep & (np.bincount(row[~np.isfinite(x)], minlength=len(length)) == 0)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * x)
            most = np.minimum(1 << 30, [isqrt(((1 << 63) - 1) // max(int(n), 1)) // 2 for n in length])
            fits = np.bincount(row[~(np.abs(x) <= most[row])], minlength=len(length)) == 0
            used = keep & fits
            offsets = np.concatenate([[0], np.cumsum(np.where(used, length, 0)[keep])]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[used[row]].astype(np.int32)), mask=pa.array(~fits[keep]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(keep)) for c in names), out], names=[*names, to])

    kinds = [f"{n} {given.schema[n].dataType.simpleString()}" for n in names]
    return own(given.where(F.col(v).isNotNull()).mapInArrow(run, ", ".join([*kinds, f"{to} array<int>"])))


@dataclass
class Codes:
    """``rows``: the other columns, code (array of entry numbers by part) and error (squared distances summed). ``books``: entries by part."""

    rows: DataFrame
    books: list[np.ndarray]


def compress(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4) -> Codes:
    """Codes of all vectors, by codebooks that ``rounds`` of means over all vectors have moved.

    The first entries are the parts of the ``entries`` vectors with the smallest keys (of equal keys those with the smaller
    vector; null keys last); with fewer vectors there are fewer entries. Rows whose vector is null or has null or non-finite components go. Codebooks
    are of one length, the commonest (the largest of equally common ones); vectors of another length, and those with components
    too large for integer distances, stay with a null code and error. A length that ``parts`` doesn't divide is cut as evenly as can be. Equal rows
    have equal codes. Columns named code or error are replaced, others stay whatever their names; an empty table gives no rows and no books.
    """
    of = vectors.drop("code", "error")
    (v,) = fresh(of, "v")
    kept = staged(integers(of, column, v), "integers")
    others = [named(c) for c in kept.columns if c != v]
    length = F.coalesce(F.size(v), F.lit(-1))
    common = kept.where(F.col(v).isNotNull()).groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    null = [F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("bigint").alias("error")]
    if not common:
        return Codes(kept.select(*others, *null), [])
    n = common[0].n
    used, at = kept.where(length == n), cuts(n, parts)
    seeds = np.array([r[0] for r in used.orderBy(named(key).asc_nulls_last(), v).select(v).limit(entries).collect()], np.int64).reshape(-1, n)
    books = [seeds[:, a:b] for a, b in zip(at, at[1:], strict=False)]
    for _ in range(rounds):
        books = _moved(used.select(F.col(v).alias("v")), books, n)
    rows, (*names, last), own = numbered(used.select(*others, v))
    kinds = [f"{x} {rows.schema[x].dataType.simpleString()}" for x in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Book(b) for b in books]
        for batch, x in _matrices(batches, last, n):
            codes = [book.nearest(x[:, a:b]) for book, a, b in zip(found, at, at[1:], strict=False)]
            code = np.stack([c for c, _ in codes], axis=1).astype(np.int32).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(code))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, pa.array(sum(e for _, e in codes))], names=[*names, "code", "error"])

    coded = own(rows.mapInArrow(run, ", ".join([*kinds, "code array<int>", "error bigint"])))
    return Codes(coded.unionAll(kept.where(length != n).select(*others, *null)), books)


def _matrices(batches: Iterator[pa.RecordBatch], column: str, n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, n)


def _moved(vectors: DataFrame, books: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Books whose entries are the means, rounded down, of the parts that are nearest to them; unused entries stay."""
    at = cuts(n, len(books))
    sums = [f"s{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Book(b) for b in books]
        total, count = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for _, x in _matrices(batches, "v", n):
            for p, book in enumerate(found):
                rows = x[:, at[p] : at[p + 1]]
                code, _ = book.nearest(rows)
                np.add.at(total[p], code, rows)
                count[p] += np.bincount(code, minlength=len(count[p]))
        for p, (t, c) in enumerate(zip(total, count, strict=True)):
            some = np.flatnonzero(c)
            for block in range(0, t.shape[1], WIDTH):
                held = np.zeros((len(some), WIDTH), np.int64)
                held[:, : min(WIDTH, t.shape[1] - block)] = t[some, block : block + WIDTH]
                same = lambda value: pa.array(np.full(len(some), value, np.int64))
                yield pa.RecordBatch.from_arrays([same(p), pa.array(some), same(block), pa.array(c[some]), *map(pa.array, held.T.copy())], names=["part", "entry", "block", "n", *sums])

    made = vectors.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("part", "entry", "block", "n", *sums)))
    out = [b.copy() for b in books]
    for r in made.groupBy("part", "entry", "block").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]).collect():
        wide = min(WIDTH, out[r.part].shape[1] - r.block)
        out[r.part][r.entry, r.block : r.block + wide] = [r[c] // r.n for c in sums[:wide]]
    return out
