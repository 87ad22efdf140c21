"""Exact refinement of noisy binary sequences: a transition-constrained DP and a segment HSMM with posteriors.

Both are recurrences over whole sequences, so a sequence is one group. Within it a step handles all boundaries of one segment
number at once: candidates for the previous boundary are columns of a matrix, in bands of the longest allowed segment.
"""

from __future__ import annotations

import contextlib
import math
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import shuffle_partitions


@dataclass
class Refined:
    sequence: np.ndarray
    objective: float
    segments: list[tuple[int, int, int]]
    posteriors: np.ndarray | None = None
    metadata: dict = field(default_factory=dict)

    @property
    def transitions(self) -> int:
        return int((np.diff(self.sequence) != 0).sum())


class Infeasible(ValueError):
    """No segmentation satisfies the refiner's bounds; bad input is any other ValueError."""


class Refiner(Protocol):
    def predict(self, observations: np.ndarray) -> Refined: ...


def _probabilities(x: np.ndarray, eps: float) -> np.ndarray:
    x = np.asarray(x, float).ravel()
    if not x.size or not np.isfinite(x).all() or x.min() < 0 or x.max() > 1:
        raise ValueError("observations must be non-empty, finite and within 0 and 1")
    return np.clip(x, eps, 1 - eps)


def _binary(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).ravel()
    if not x.size or not np.isin(x, (0.0, 1.0)).all():
        raise ValueError("observations must be non-empty and 0 or 1")
    return x.astype(int)


@dataclass(frozen=True)
class Identity:
    """Observations at a threshold, unchanged."""

    threshold: float = 0.5

    def predict(self, observations: np.ndarray) -> Refined:
        seq = (_probabilities(observations, 0.0) >= self.threshold).astype(int)
        return Refined(seq, 0.0, [])


def _best_path(score, n: int, k: int, longest: int) -> tuple[float, list[tuple[int, int]]]:
    """Boundaries of k segments over n frames with the largest sum of ``score(m, u, t)``; the smallest earlier boundary wins ties."""
    best = np.full(n + 1, -np.inf)
    best[0] = 0.0
    back = np.full((k + 1, n + 1), -1, np.int32)
    for m in range(1, k + 1):
        new = np.full(n + 1, -np.inf)
        low, high = max(m, n - (k - m) * longest), min(n - (k - m), m * longest)
        for a in range(low, high + 1, 256):
            t = np.arange(a, min(high, a + 255) + 1)
            u = np.arange(max(m - 1, a - longest), t[-1])
            total = np.where((u < t[:, None]) & (u >= t[:, None] - longest), best[u] + score(m, u, t[:, None]), -np.inf)
            pick = total.argmax(axis=1)
            new[t], back[m, t] = total[np.arange(len(t)), pick], u[pick]
        best = new
    if not np.isfinite(best[n]):
        raise Infeasible("no feasible segmentation")
    cuts, t = [], n
    for m in range(k, 0, -1):
        u = int(back[m, t])
        cuts.append((u, t))
        t = u
    return float(best[n]), cuts[::-1]


#: Frames up to which a sequence's scores of all segments are held at once, 2 MB a state.
SHORT = 512


def _filled(cuts: list[tuple[int, int]], start: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    segments = [(u, t, (start + i) % 2) for i, (u, t) in enumerate(cuts)]
    return np.concatenate([np.full(t - u, s) for u, t, s in segments]), segments


@dataclass(frozen=True)
class Durations:
    """Means and spreads of contact (index 1) and no contact (0), in seconds; segments at the ends have their own spread."""

    mean: tuple[float, float]
    sigma: tuple[float, float]
    edge_sigma: tuple[float, float]
    fps: float

    def __post_init__(self) -> None:
        if min(*self.mean, *self.sigma, *self.edge_sigma, self.fps) <= 0:
            raise ValueError("means, spreads and fps must be positive")


@dataclass(frozen=True)
class TransitionDP:
    """Exactly ``transitions`` changes of state at the least cost of misfit and of unlikely durations."""

    transitions: int
    durations: Durations
    observation_weight: float = 1.0
    duration_weight: float = 1.0
    eps: float = 1e-6
    start_state: int | None = None

    def __post_init__(self) -> None:
        if self.transitions < 0 or self.observation_weight < 0 or self.duration_weight < 0 or not 0 < self.eps < 0.5 or self.start_state not in (None, 0, 1):
            raise ValueError("invalid configuration")

    def predict(self, observations: np.ndarray) -> Refined:
        p = _probabilities(observations, self.eps)
        n, k = len(p), self.transitions + 1
        if k > n:
            raise Infeasible(f"{self.transitions} transitions need more than {n} frames")
        cost = np.stack([np.concatenate([[0.0], np.cumsum(-np.log(q))]) for q in (1 - p, p)])

        def solve(start: int) -> Refined:
            def score(m: int, u: np.ndarray, t: np.ndarray) -> np.ndarray:
                state = (start + m - 1) % 2
                sigma = (self.durations.edge_sigma if m in (1, k) else self.durations.sigma)[state]
                z = (t - u - self.durations.mean[state] * self.durations.fps) / (sigma * self.durations.fps)
                return -(self.observation_weight * (cost[state][t] - cost[state][u]) + self.duration_weight * 0.5 * z * z)

            value, cuts = _best_path(score, n, k, n)
            seq, segments = _filled(cuts, start)
            return Refined(seq, -value, segments, metadata={"start_state": start})

        return min((solve(s) for s in ((0, 1) if self.start_state is None else (self.start_state,))), key=lambda r: r.objective)


@dataclass(frozen=True)
class SegmentHSMM:
    """The likeliest ``segments`` runs in turn from ``start_state``: gamma durations (shape, rate by state), noisy observations.

    ``posterior`` adds each frame's probability of contact over all segmentations.
    """

    segments: int
    shape: tuple[float, float]
    rate: tuple[float, float]
    fpr: float
    fnr: float
    start_state: int = 0
    emission_weight: float = 1.0
    duration_weight: float = 1.0
    longest: int | None = 540
    eps: float = 1e-6
    posterior: bool = False

    def log_likelihoods(self) -> tuple[tuple[float, float], tuple[float, float]]:
        """Of an observed 1 and of an observed 0, each in the states without and with contact."""
        clip = lambda v: min(1 - self.eps, max(self.eps, v))
        log = lambda *values: tuple(math.log(clip(v)) for v in values)
        return log(self.fpr, 1 - self.fnr), log(1 - self.fpr, self.fnr)

    def predict(self, observations: np.ndarray) -> Refined:
        x = _binary(observations)
        n, k = len(x), self.segments
        longest = min(n, self.longest or n)
        if not 1 <= k <= n or n > k * longest:
            raise Infeasible(f"no feasible segmentation of {n} frames in {k} segments of at most {longest}")
        hit, miss = self.log_likelihoods()
        emit = np.stack([np.concatenate([[0.0], np.cumsum(np.where(x == 1, hit[s], miss[s]))]) for s in (0, 1)])
        d = np.arange(1, longest + 1)
        last = np.stack([np.concatenate([[0.0], a * math.log(r) - math.lgamma(a) + (a - 1) * np.log(d) - r * d]) for a, r in zip(self.shape, self.rate, strict=True)])

        def score(m: int, u: np.ndarray, t: np.ndarray) -> np.ndarray:
            s = (self.start_state + m - 1) % 2
            return self.emission_weight * (emit[s][t] - emit[s][u]) + self.duration_weight * last[s][np.clip(t - u, 0, longest)]

        if n <= SHORT:
            # A short sequence's segments are scored once for each state, not for each number of a segment and pass.
            ends = np.arange(n + 1)
            whole = [score(1 + (s - self.start_state) % 2, ends, ends[:, None]) for s in (0, 1)]

            def score(m: int, u: np.ndarray, t: np.ndarray) -> np.ndarray:
                return whole[(self.start_state + m - 1) % 2][t, u]

        value, cuts = _best_path(score, n, k, longest)
        seq, parts = _filled(cuts, self.start_state)
        return Refined(seq, value, parts, self._posteriors(score, n, k, longest) if self.posterior else None)

    def _posteriors(self, score, n: int, k: int, longest: int) -> np.ndarray:
        """Sums over all segmentations by forward and backward passes; each segment adds its weight between its boundaries.

        Tables are k x n; the scores of segments are computed in bands of boundaries that a longest segment can join.
        """
        forward, backward = np.full((k + 1, n + 1), -np.inf), np.full((k + 1, n + 1), -np.inf)
        forward[0, 0], backward[k, n] = 0.0, 0.0

        def logsum(a: np.ndarray) -> np.ndarray:
            top = a.max(axis=1, keepdims=True)
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                return np.log(np.exp(a - top).sum(axis=1)) + top[:, 0]

        def band(m: int, low: int, back: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """256 boundaries from ``low`` on (rows), those that a segment m joins them to (columns), and its scores."""
            here = np.arange(low, min(n, low + 255) + 1)
            there = np.arange(here[0] + 1, min(n, here[-1] + longest) + 1) if back else np.arange(max(0, here[0] - longest), here[-1])
            u, t = (here[:, None], there) if back else (there, here[:, None])
            return here, there, np.where((u < t) & (t - u <= longest), score(m, u, t), -np.inf)

        for m in range(1, k + 1):
            for low in range(1, n + 1, 256):
                t, u, s = band(m, low)
                forward[m, t] = logsum(forward[m - 1, u] + s)
        for m in range(k - 1, -1, -1):
            for low in range(0, n, 256):
                u, t, s = band(m + 1, low, True)
                backward[m, u] = logsum(backward[m + 1, t] + s)
        change = np.zeros(n + 1)
        for m in range(1, k + 1):
            if (self.start_state + m - 1) % 2 == 1:
                for low in range(1, n + 1, 256):
                    t, u, s = band(m, low)
                    weight = np.exp(forward[m - 1, u] + s + backward[m, t][:, None] - forward[k, n])
                    change[u] += weight.sum(axis=0)
                    change[t] -= weight.sum(axis=1)
        return np.clip(np.cumsum(change)[:n], 0.0, 1.0)


OUTPUT = "video_id bigint, pos bigint, refined int, posterior double, objective double, n_segments int, status string"


def refine(df: DataFrame, refiner: Refiner, observation: str = "pred") -> DataFrame:
    """Each frame's refined label, and its sequence's objective. A sequence without a feasible segmentation gives null labels and
    the status "infeasible", else "ok"; observations that the refiner refuses are an error.

    Rows are (video_id, pos, observation).
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n, missing = rows.num_rows, pa.nulls(rows.num_rows)
        columns = {"refined": missing, "posterior": missing, "objective": missing, "n_segments": missing, "status": pa.repeat("infeasible", n)}
        with contextlib.suppress(Infeasible):
            r = refiner.predict(rows.column(observation).to_numpy())
            columns = {"refined": r.sequence, "objective": pa.repeat(float(r.objective), n), "n_segments": pa.repeat(r.transitions + 1, n), "status": pa.repeat("ok", n)}
            columns["posterior"] = missing if r.posteriors is None else r.posteriors
        kinds = {"refined": pa.int32(), "posterior": pa.float64(), "objective": pa.float64(), "n_segments": pa.int32(), "status": pa.string()}
        arrays = [(c if isinstance(c := columns[name], pa.Array) else pa.array(c)).cast(kind) for name, kind in kinds.items()]
        return pa.table([rows.column("video_id"), rows.column("pos"), *arrays], names=["video_id", "pos", *kinds])

    # Dealt by a given number of partitions: rows are few, steps many, so that small partitions aren't to be put together.
    dealt = df.select("video_id", "pos", observation).repartition(shuffle_partitions(df.sparkSession), "video_id")
    return dealt.select(*[F.col(c).cast("bigint") for c in ("video_id", "pos")], observation).groupBy("video_id").applyInArrow(run, OUTPUT)


def log_likelihood_sums(df: DataFrame, model: SegmentHSMM, keys: tuple[str, ...] = ("video_id",), order: str = "pos", observation: str = "pred") -> DataFrame:
    """``df`` with contact and free: the sums of the observations' log-likelihoods in either state up to each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    hit, miss = model.log_likelihoods()
    part = lambda s: F.sum(F.when(F.col(observation) == 1, hit[s]).otherwise(miss[s])).over(w)
    return df.withColumns({"contact": part(1), "free": part(0)})


def export(df: DataFrame, refined: DataFrame, folder: str) -> None:
    """Refined labels and posteriors as CSV by video below ``folder``/refined, and each video's accuracy before and after (``df``
    has pred and gt), its objective and status below ``folder``/metrics."""
    refined.repartition("video_id").sortWithinPartitions("video_id", "pos").write.mode("overwrite").option("header", True).partitionBy("video_id").csv(f"{folder.rstrip('/')}/refined")
    status = refined.groupBy("video_id").agg(F.count("*").alias("n_frames"), F.first("objective").alias("objective"), F.first("n_segments").alias("n_segments"), F.first("status").alias("status"))
    change_of_metrics(df, refined).join(status, "video_id").write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/metrics")


def change_of_metrics(df: DataFrame, refined: DataFrame) -> DataFrame:
    """Per sequence accuracy before and after, and the difference; df has pred and gt."""
    both = df.join(refined.select("video_id", "pos", "refined"), ["video_id", "pos"])
    before, after = F.avg((F.col("pred") == F.col("gt")).cast("int")), F.avg((F.col("refined") == F.col("gt")).cast("int"))
    return both.groupBy("video_id").agg(before.alias("before"), after.alias("after"), (after - before).alias("delta"))
