"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

The statistics come from whole texts. Trees are fitted on a bounded sample of labelled rows (``most`` rows, those with the
smallest hashes of doc_id) and flattened into arrays (tree, node) of features and thresholds, so that a batch of documents
goes down all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, numbered, steps

STATISTICS = (
    "log_bytes", "log_words", "word_mean", "word_std", "word_max", "distinct_words", "top_word", "top_pair", "distinct_pairs", "upper", "digit", "mark",
    "odd_mark", "bang", "bar", "blank", "beyond_ascii", "byte_entropy", "lines_per_byte", "distinct_lines", "line_mean", "ended_lines", "short_lines", "capital_words",
    "single_letters", "longest_repeat",
)
_byte = np.arange(256)
_kinds = {
    "upper": (_byte >= 65) & (_byte <= 90),
    "digit": (_byte >= 48) & (_byte <= 57),
    "mark": np.isin(_byte, list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")),
    "odd_mark": np.isin(_byte, list(b"#$%&*+<=>@[\\]^_`{|}~")),
    "bang": _byte == ord("!"),
    "bar": _byte == ord("|"),
    "blank": np.isin(_byte, list(b" \t\n\x0b\x0c\r")),
    "beyond_ascii": _byte >= 128,
}


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a text, in order. An empty text gives zeros."""
    words, lines = text.split(), text.split(b"\n")
    n, size = max(1, len(words)), max(1, len(text))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts[counts > 0] / size
    of_word, of_pair = Counter(words), Counter(zip(words, words[1:], strict=False))
    pairs = max(1, len(words) - 1)
    same = np.flatnonzero(np.concatenate([[True], [a != b for a, b in zip(words, words[1:], strict=False)], [True]])) if words else np.zeros(2)
    long_lines = [x for x in lines if x]
    m = max(1, len(long_lines))
    kinds = {k: counts[v].sum() / size for k, v in _kinds.items()}
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), lengths.max(), len(of_word) / n,
        max(of_word.values(), default=0) / n, max(of_pair.values(), default=0) / pairs, len(of_pair) / pairs,
        *kinds.values(), float(-(share * np.log2(share)).sum()), len(lines) / size, len(set(long_lines)) / m, sum(map(len, long_lines)) / m,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in long_lines) / m, sum(len(x) < 30 for x in long_lines) / m,
        sum(w[:1].isupper() for w in words) / n, sum(len(w) == 1 for w in words) / n, float(np.diff(same).max()) / n,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: feature and threshold of node i have children 2i + 1 (not above) and 2i + 2; value by leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees:
            node, tree, row = np.zeros((len(x), trees), np.int64), np.arange(trees), np.arange(len(x))[:, None]
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total = total + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 10, penalty: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows of both labels all scores are the (smoothed) share of label 1."""
    rows, columns = x.shape
    share = (y.sum() + 0.5) / (rows + 1)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if not 0 < y.sum() < rows:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    bounds = np.stack([np.append(e, np.full(bins - len(e), np.inf)) for e in edges])
    flat = binned + np.arange(columns) * bins
    total, out = np.full(rows, base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(rows, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (columns * bins) + flat).ravel()
            G, H, N = (np.bincount(at, np.repeat(v, columns), n * columns * bins).reshape(n, columns, bins).cumsum(axis=2) for v in (g, h, np.ones(rows)))
            g_all, h_all, n_all = G[:, :, -1:], H[:, :, -1:], N[:, :, -1:]
            gain = G**2 / (H + penalty) + (g_all - G) ** 2 / (h_all - H + penalty) - g_all**2 / (h_all + penalty)
            gain[(N < least) | (n_all - N < least)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            useful = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            f, b = best // bins, best % bins
            feature[first : first + n] = np.where(useful, f, 0)
            threshold[first : first + n] = np.where(useful, bounds[f, b], np.inf)
            mine = node - first
            node = 2 * node + 1 + (useful[mine] & (binned[np.arange(rows), f[mine]] > b[mine]))
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        total = total + value[leaf]
        for held, v in zip(out, (feature, threshold, value), strict=True):
            held.append(v)
    return Trees(base, *map(np.stack, out))


def held_out() -> Column:
    """Rows that no model learns from: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def _with_statistics(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in steps(batches, column):
        yield batch, np.array([statistics(t or b"") for t in batch.column(column).cast(pa.binary()).to_pylist()])


def train(docs: DataFrame, labels: DataFrame, most: int = 16384) -> Trees:
    """Trees from at most ``most`` labelled rows that aren't held out; ``labels`` are (doc_id, quality), others than 0 and 1 ignored.

    The bound is on rows of documents with a label, those with the smallest hashes of doc_id: rows that repeat a doc_id count each.
    """
    name = fresh(docs, "label")[0]
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").cast("double").alias(name))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", name).limit(most)  # so small that it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _with_statistics(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(name), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(run, "doc_id bigint, y double, x array<double>")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("x")).limit(most).toArrow()
    x = np.array(rows["x"].to_pylist()).reshape(-1, len(STATISTICS))
    y = rows["y"].to_numpy()
    order = np.lexsort([*x.T, y, rows["doc_id"].to_numpy()])
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1; higher: label 1 is likelier) and predicted (1 if score >= threshold, else 0).

    Only the text counts, whole, however long: a task holds the word counts of one text at a time. Null or empty texts have
    statistics of zeros and get a score too. Equal texts get equal scores. Columns of these names are replaced, all others stay,
    repeated rows and null doc_ids too. An empty table gives no rows.
    """
    kept = docs.drop("score", "predicted")
    given, names, own = numbered(kept)
    text = names[kept.columns.index("text")]
    schema = T.StructType([*given.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _with_statistics(batches, text):
            s = model.value.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return own(given.mapInArrow(run, schema))
