"""Linear heads fitted by gradient descent over a distributed table.

Each step is one pass: a task adds up the gradients of its rows, Spark adds up the tasks' by cell of the weights, and the driver
gets one number a weight, whatever the rows. Weights and velocity are written every few steps, and a fit that is called again goes
on from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FitConfig:
    """Stochastic descent's parameters, for a full pass a step: the rate falls by ``gamma`` after each of ``drops`` steps; the bias
    isn't decayed, and has ``bias_rate`` times the rate. ``every`` steps are written."""

    steps: int = 100
    rate: float = 0.1
    momentum: float = 0.9
    decay: float = 0.0005
    bias_rate: float = 2.0
    gamma: float = 0.1
    drops: tuple[int, ...] = ()
    sigma: float = 1.0
    every: int = 10


@dataclass
class Head:
    """``weights`` (outputs, features + 1; the bias last), after ``step`` steps; the mean ``losses`` before each."""

    weights: np.ndarray
    velocity: np.ndarray
    step: int
    losses: list[float]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights[:, :-1].T + self.weights[:, -1]


def softmax_gradient(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient by score, and loss, of each row; ``y`` holds labels."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    total = e.sum(axis=1)
    row, label = np.arange(len(y)), y[:, 0].astype(int)
    loss = np.log(total) + scores.max(axis=1) - scores[row, label]
    g = e / total[:, None]
    g[row, label] -= 1
    return g, loss


def smooth_l1_gradient(scores: np.ndarray, y: np.ndarray, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    d, near = scores - y, 1 / sigma**2
    small = np.abs(d) < near
    return np.where(small, d * sigma**2, np.sign(d)), np.where(small, d * d * sigma**2 / 2, np.abs(d) - near / 2).sum(axis=1)


def fit(df: DataFrame, n_features: int, n_outputs: int, kind: str = "softmax", chosen: FitConfig = FitConfig(), folder: str | None = None, features: str = "features", target: str = "target") -> Head:
    """A head from rows of ``features`` (array of doubles) and ``target``: a label from 0 on (softmax) or an array (smooth_l1).

    Rows with nulls, another number of features, or a label that isn't there take no part; without rows the weights stay 0.
    ``df`` is read once a step: stage what is costly before. With ``folder`` a fit goes on from the last step written there.
    """
    if kind not in ("softmax", "smooth_l1"):
        raise ValueError(f"unknown loss {kind!r}")
    x, y = F.col(features).cast("array<double>"), F.col(target)
    y = F.array(y.cast("double")) if kind == "softmax" else y.cast("array<double>")
    rows = df.select(x.alias("x"), y.alias("y")).where((F.size("x") == n_features) & ~F.exists("x", F.isnull) & ~F.exists("y", F.isnull))
    rows = rows.where(F.col("y")[0].between(0, n_outputs - 1) if kind == "softmax" else F.size("y") == n_outputs)
    head = _last(df.sparkSession, folder) if folder else None
    head = head or Head(np.zeros((n_outputs, n_features + 1)), np.zeros((n_outputs, n_features + 1)), 0, [])
    if head.weights.shape != (n_outputs, n_features + 1):
        raise ValueError(f"{folder} holds a head of another shape")
    while head.step < chosen.steps:
        g, loss, n = _gradient(rows, head.weights, kind, chosen.sigma)
        rate = chosen.rate * chosen.gamma ** sum(head.step >= s for s in chosen.drops)
        rates, decay = np.full(head.weights.shape, rate), np.full(head.weights.shape, chosen.decay)
        rates[:, -1], decay[:, -1] = rate * chosen.bias_rate, 0
        velocity = chosen.momentum * head.velocity + g / max(n, 1) + decay * head.weights
        head = Head(head.weights - rates * velocity, velocity, head.step + 1, [*head.losses, loss / max(n, 1)])
        if folder and (head.step % chosen.every == 0 or head.step == chosen.steps):
            _write(df.sparkSession, folder, head)
    return head


def _gradient(rows: DataFrame, weights: np.ndarray, kind: str, sigma: float) -> tuple[np.ndarray, float, int]:
    n_outputs, wide = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(weights.shape), 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, wide - 1)
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            x = np.column_stack([x, np.ones(len(x))])
            g, each = softmax_gradient(x @ weights.T, y) if kind == "softmax" else smooth_l1_gradient(x @ weights.T, y, sigma)
            total += g.T @ x
            loss, n = loss + each.sum(), n + len(x)
        # The cells of the gradient by place, then the loss and the number of rows.
        values = np.concatenate([total.ravel(), [loss, n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["cell", "value"])

    sums = rows.mapInArrow(run, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # one row a weight
    out = np.zeros(n_outputs * wide + 2)
    for r in sums:
        out[r.cell] = r.value
    return out[:-2].reshape(n_outputs, wide), float(out[-2]), int(out[-1])


def _write(spark: SparkSession, folder: str, head: Head) -> None:
    row = (head.step, *head.weights.shape, head.weights.ravel().tolist(), head.velocity.ravel().tolist(), head.losses)
    df = spark.createDataFrame([row], "step long, outputs long, wide long, weights array<double>, velocity array<double>, losses array<double>")
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/at={head.step:09d}")


def _last(spark: SparkSession, folder: str) -> Head | None:
    """The head of the last step that was written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    whole = [n for n in names if n.startswith("at=") and fs.exists(path(f"{folder.rstrip('/')}/{n}/_SUCCESS"))]
    if not whole:
        return None
    r = spark.read.parquet(f"{folder.rstrip('/')}/{whole[-1]}").first()
    shape = (r.outputs, r.wide)
    return Head(np.array(r.weights).reshape(shape), np.array(r.velocity).reshape(shape), r.step, list(r.losses))


def scored(df: DataFrame, head: Head, features: str = "features", to: str = "scores") -> DataFrame:
    """``df`` with a score for each output, in the JVM; null where the features are null."""
    parts = [F.aggregate(F.zip_with(features, F.lit(w[:-1].tolist()), lambda a, b: a * b), F.lit(float(w[-1])), lambda s, v: s + v) for w in head.weights]
    return df.withColumn(to, F.when(F.col(features).isNotNull(), F.array(*parts)))
