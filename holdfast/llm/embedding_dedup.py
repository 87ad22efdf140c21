"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted on a bounded sample (``sample`` vectors with the smallest
hashes); every vector lies in a cell of their product grid. A query visits cells in the order of the multi-sequence traversal:
by the sum of its halves' distances to the two centroids. How many cells it visits is set from pairs: those that brute force
finds for ``probes`` vectors against all, and pairs made at similarities from the threshold to 1; both must reach the target
recall. Every vector is a query. What a visit finds is verified by cosines in double precision. Equal vectors are one class
with a count; links are counted and joined in the cell where they are found, never listed.

A vector goes to each cell that it visits with the largest sum of distances that it still visits, not with its list of cells:
whether it visits a cell follows from that and the codebooks, which every task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged
from .components import components, merge_labels


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vec): vectors as bytes of doubles and a hash of them; both null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                x = np.array([np.nan] if v is None or None in v else v, np.float64) + 0.0
                good = i is not None and np.isfinite(x).all() and np.abs(x).max(initial=0.0) > 0
                keys.append(xxhash.xxh3_128_digest(x.tobytes()) if good else None)
                # As floats where that loses nothing. Doubles come with a mark, so that the number of bytes tells them apart.
                small = x.astype(np.float32) if good and np.abs(x).max() < 1e38 else None
                vecs.append(None if not good else small.tobytes() if small is not None and (small == x).all() else x.tobytes() + b"d")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "vec"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "vec_id bigint, key binary, vec binary")


def _by_size(vecs: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places, unit vectors in double precision) of vectors of one length in bytes after another."""
    lengths = np.fromiter(map(len, vecs), np.int64, len(vecs))
    for n in np.unique(lengths):
        here = np.flatnonzero(lengths == n)
        double = n % 4 == 1
        raw = b"".join(vecs[i][:-1] if double else vecs[i] for i in here)
        x = np.frombuffer(raw, np.float64 if double else np.float32).reshape(len(here), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1)[:, None]
        yield x.shape[1], here, x / np.linalg.norm(x, axis=1)[:, None] + 0.0


def _units(vecs: list[bytes]) -> np.ndarray:
    """Vectors of as many dimensions, as unit vectors in rows."""
    parts = list(_by_size(vecs))
    out = np.empty((len(vecs), parts[0][0]))
    for _, here, x in parts:
        out[here] = x
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centre = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(x[i : i + 1024], centre).argmin(axis=1) for i in range(0, len(x), 1024)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre**2).sum(axis=1), 0)


#: Added to distances by number of centroid, so that no two cells are equally far, and what rounding may change in a sum.
APART, SLACK = 1e-10, 1e-12


@lru_cache
def _corner(a: int, b: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ranks that can be among the ``most`` smallest sums of an ascending row of a and one of b values."""
    pairs = [(i, j) for i in range(min(a, most)) for j in range(min(b, most // (i + 1)))]
    i, j = np.array(pairs).T
    return i, j


class Grid:
    """Codebooks for one number of dimensions."""

    def __init__(self, x: np.ndarray, k: int):
        self.half = x.shape[1] // 2
        self.k = max(1, min(k, len(x)))
        self.books = [k_means(np.ascontiguousarray(x[:, a:b]), self.k) for a, b in ((0, self.half), (self.half, x.shape[1]))]

    def _far(self, x: np.ndarray) -> list[np.ndarray]:
        """Distances of the halves to all their centroids."""
        parts = (x[:, : self.half], x[:, self.half :])
        return [distances(np.ascontiguousarray(p), c) + np.arange(self.k) * step for p, c, step in zip(parts, self.books, (APART, APART * self.k), strict=True)]

    def homes(self, x: np.ndarray) -> np.ndarray:
        a, b = self._far(x)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def visits(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the cells it visits, in order (the first is the one it lies in), and the largest sum that it visits."""
        most = min(most, self.k**2)
        d = self._far(x)
        order = [np.argsort(m, axis=1, kind="stable") for m in d]
        ranked = [np.take_along_axis(m, o, axis=1) for m, o in zip(d, order, strict=True)]
        i, j = _corner(self.k, self.k, most)
        total = ranked[0][:, i] + ranked[1][:, j]
        best = np.argsort(total, axis=1, kind="stable")[:, :most]
        cells = np.take_along_axis(order[0], i[best], axis=1) * self.k + np.take_along_axis(order[1], j[best], axis=1)
        return cells, np.take_along_axis(total, best[:, -1:], axis=1)[:, 0] + SLACK

    def reaches(self, x: np.ndarray, reach: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether rows (with the largest sums they visit) visit each of the cells."""
        a, b = self._far(x)
        return a[:, cells // self.k] + b[:, cells % self.k] <= reach[:, None]

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each row how many visits it takes to its cell: as many as there are cells not farther, counted by sorted halves."""
        a, b = self._far(x)
        row = np.arange(len(x))
        s = a[row, cells // self.k] + b[row, cells % self.k] + SLACK
        b = np.sort(b, axis=1)
        return np.array([np.searchsorted(b[i], s[i] - a[i], side="right").sum() for i in row], np.int64)


#: Visits are counted in steps of five hundredths, so that few counts come to the driver.
STEP = np.log(1.05)


def _needed(steps: dict[int, int], recall: float) -> int:
    """The fewest visits, by whole steps, that find the share ``recall`` of the pairs."""
    if not steps:
        return 1
    at = np.array(sorted(steps))
    found = np.cumsum([steps[i] for i in at])
    return int(np.ceil(np.exp(at[np.searchsorted(found, recall * found[-1] - 1e-9)] * STEP)))


def _steps(rank: np.ndarray) -> np.ndarray:
    return np.ceil(np.log(np.maximum(rank, 1)) / STEP - 1e-9).astype(np.int64)


def _first(grid: Grid, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of rows the visits it takes until one of them comes to the other's cell."""
    return np.minimum(grid.ranks(x, grid.homes(y)), grid.ranks(y, grid.homes(x)))


def fit(classes: DataFrame, total: int, threshold: float, recall: float, sample: int, probes: int, fill: int) -> tuple[dict[int, Grid], dict[int, int]]:
    """Grids and numbers of visits, by number of dimensions. Of a probe's pairs a task counts 64 of each batch of vectors at most."""
    rows = classes.orderBy(F.xxhash64("key"), "cls").limit(sample).select("vec").toArrow().column("vec").to_pylist()
    drawn: dict[int, np.ndarray] = {}
    for n, _, x in _by_size(rows):
        drawn[n] = np.concatenate([drawn[n], x]) if n in drawn else x
    k = max(1, round((total / fill) ** 0.5))
    grids = {n: Grid(x, min(k, max(1, len(x) // 8))) for n, x in drawn.items()}
    queries = {n: x[:probes] for n, x in drawn.items()}
    shared = classes.sparkSession.sparkContext.broadcast((grids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids, queries = shared.value
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            for n, _, x in _by_size(batch.column("vec").to_pylist()):
                if n not in grids:
                    continue
                s = queries[n] @ x.T
                q, y = np.nonzero((s >= threshold) & (s < 1 - 1e-12))  # without the probe itself
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                q, y = q[nth < 64], y[nth < 64]
                for i in range(0, len(q), 512):
                    step, m = np.unique(_steps(_first(grids[n], queries[n][q[i : i + 512]], x[y[i : i + 512]])), return_counts=True)
                    for r, c in zip(step.tolist(), m.tolist(), strict=True):
                        counts[n, r] = counts.get((n, r), 0) + c
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["size", "step", "n"])

    found = classes.select("vec").mapInArrow(run, "size int, step int, n bigint").groupBy("size", "step").agg(F.sum("n").alias("n")).collect()  # a few hundred steps
    visits = {}
    for n, grid in grids.items():
        real = {r["step"]: r["n"] for r in found if r["size"] == n}
        made: dict[int, int] = {}
        rng = np.random.default_rng(11)
        x = queries[n]
        if n > 1:
            noise = rng.normal(size=x.shape)
            noise -= (noise * x).sum(axis=1)[:, None] * x
            noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-300)[:, None]
            c = rng.uniform(threshold, 1, len(x))[:, None]
            step, m = np.unique(_steps(_first(grid, x, c * x + np.sqrt(1 - c**2) * noise)), return_counts=True)
            made = dict(zip(step.tolist(), m.tolist(), strict=True))
        visits[n] = max(1, _needed(real, recall), _needed(made, recall))
    return grids, visits


PLACED = "cls bigint, mult bigint, home bigint, reach double, vec binary"
DEALT = f"cell bigint, h int, v int, role int, {PLACED}"
_names = [x.split()[0] for x in DEALT.split(", ")]


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, sample: int = 16384, probes: int = 256, fill: int = 32, most: int = 1024) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id (smallest vec_id reachable by links).

    Vectors (vec_id, embedding) that are null, empty or zero, or hold a null or non-finite component, or have no vec_id, link with nothing;
    vectors of different lengths don't link; a vector of any length is compared whole. Equal vectors are linked, repeated rows too.
    Other columns are ignored, whatever their names; an empty table gives no rows. A cell with more than ``most`` vectors, or
    eight times as many visits, is worked on in blocks.

    Of all links the share ``recall`` is aimed at. A codebook has a centroid for eight vectors of the sample at most, 2,048: with
    ``fill`` vectors in a cell that is enough for 134 million vectors of one length, and a larger sample serves more.
    """
    spark = vectors.sparkSession
    rows = staged(keyed(vectors), "vectors")
    classes = staged(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("cls"), F.count("*").alias("mult"), F.first("vec").alias("vec")), "classes")
    total = classes.count()
    shared = spark.sparkContext.broadcast(fit(classes, total, threshold, recall, sample, probes, fill))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids, visits = shared.value
        for batch in batches:
            home, reach, visited = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), [b""] * batch.num_rows
            for n, here, x in _by_size(batch.column("vec").to_pylist()):
                for i in range(0, len(x), 1024):
                    if n in grids:
                        cells, most_far = grids[n].visits(x[i : i + 1024], visits[n])
                    else:  # no vector of the sample is as long: all those lie in one cell
                        cells, most_far = np.zeros((len(x[i : i + 1024]), 1), np.int64), np.full(len(x[i : i + 1024]), np.inf)
                    at = here[i : i + 1024]
                    home[at], reach[at] = cells[:, 0] + (n << 32), most_far
                    for j, row in zip(at.tolist(), cells + (n << 32), strict=True):
                        visited[j] = row.tobytes()
            columns = [batch.column("cls"), batch.column("mult"), pa.array(home), pa.array(reach), batch.column("vec"), pa.array(visited, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*_names[4:], "visited"])

    at = staged(classes.select("cls", "mult", "vec").mapInArrow(placed, f"{PLACED}, visited binary"), "placed")

    def visits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            visited = batch.column("visited").to_pylist()
            cell = np.frombuffer(b"".join(visited), np.int64)
            row = np.repeat(np.arange(len(visited)), [len(v) // 8 for v in visited])
            own = cell == batch.column("home").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(row)), pa.array(cell), pa.array(own)], names=["cls", "cell", "own"])

    # A cell with over ``most`` vectors, or eight times as many visits, is a grid of blocks: a host is in one row of them and all its
    # columns, a guest in one column and all its rows, so that each pair meets in one block. Which cells are so large stays distributed.
    slim = at.select("cls", "home", "visited").mapInArrow(visits_of, "cls bigint, cell bigint, own boolean")
    blocks = [F.greatest(F.ceil(F.col(n) / m), F.lit(1)).cast("int").alias(k) for k, n, m in (("rows", "hosts", most), ("columns", "guests", 8 * most))]
    large = slim.groupBy("cell").agg(F.count("*").alias("guests"), F.count_if("own").alias("hosts")).where((F.col("hosts") > most) | (F.col("guests") > 8 * most)).select("cell", *blocks)
    sized = slim.join(staged(large, "large"), "cell", "left").select("cls", "cell", "own", F.coalesce("rows", F.lit(1)).alias("rows"), F.coalesce("columns", F.lit(1)).alias("columns"))
    place = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    block = lambda h, v, role: F.struct(h.alias("h"), v.alias("v"), role.alias("role"))
    spans = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_guest = F.transform(spans("rows"), lambda h: block(h, place("columns"), F.when(F.col("own") & (h == place("rows")), 3).otherwise(2)))
    as_host = F.transform(F.filter(spans("columns"), lambda v: F.col("own") & (v != place("columns"))), lambda v: block(place("rows"), v, F.lit(1)))
    dealt = sized.select("cls", "cell", F.explode(F.concat(as_guest, as_host)).alias("b")).select("cls", "cell", "b.*").join(at.select(_names[4:]), "cls").select(*_names)

    def verify(block: pa.Table) -> pa.RecordBatch:
        """Of one block: classes, their links found here, and the smallest class that each is joined with here."""
        grids, _ = shared.value
        block = block.sort_by("cls").combine_chunks()
        role, cls, mult, home, reach = (block.column(k).to_numpy() for k in ("role", "cls", "mult", "home", "reach"))
        x, cell = _units(block.column("vec").to_pylist()), block.column("cell")[0].as_py()
        host, guest = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        links, label = np.zeros(len(cls), np.int64), np.arange(len(cls))
        grid = grids.get(x.shape[1])
        for i in range(0, len(guest), 512):
            g = guest[i : i + 512]
            near = x[g] @ x[host].T >= threshold
            some = near.any(axis=0)
            a, b = np.nonzero(near[:, some])
            away, of = np.unique(home[g], return_inverse=True)
            # If the host doesn't visit the guest's cell, nobody else counts this link for the host.
            with_host = host[some]
            visits = grid.reaches(x[with_host], reach[with_host], away - (x.shape[1] << 32)) if grid and len(with_host) else np.ones((len(with_host), len(away)), bool)
            once = ~visits[b, of[a]] & (home[g][a] != cell)
            a, b = g[a], with_host[b]
            other = a != b
            a, b, once = a[other], b[other], once[other]
            np.add.at(links, a, mult[b])
            np.add.at(links, b[once], mult[a[once]])
            label = merge_labels(label, a, b)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (cls[some], links[some], cls[label[some]])], names=["cls", "n", "root"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) > 1:
                yield verify(pa.Table.from_batches(held))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in ("cell", "h", "v")], axis=1)
            begins = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(begins, begins[1:], strict=False):
                if key != tuple(keys[a].tolist()):
                    yield from done()
                    key, held = tuple(keys[a].tolist()), []
                held.append(batch.slice(a, b - a))
        yield from done()

    dealt = dealt.repartition(shuffle_partitions(spark), "cell", "h", "v").sortWithinPartitions("cell", "h", "v")
    found = staged(dealt.mapInArrow(search, "cls bigint, n bigint, root bigint"), "found")
    joined = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    info = classes.select("key", "cls", "mult").join(found.groupBy("cls").agg(F.sum("n").alias("n")), "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    info = staged(info.select("key", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id")), "info")
    out = rows.select("vec_id", "key").join(info, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
