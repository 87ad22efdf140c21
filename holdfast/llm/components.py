"""Connected components of links between documents: by numpy within a task, by alternating stars across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b. A label is the smallest place of its group so far; labels[labels] == labels."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


#: A node with more than HUB links is joined to them by a broadcast, the HUBS largest of such nodes at the most.
HUB, HUBS = 100_000, 10_000


def _with_least(rows: DataFrame, node: str, least: DataFrame) -> DataFrame:
    """``rows`` with m, the least neighbour of their ``node``, from (x, m, n): the largest hubs' rows don't move."""
    hubs = least.where(F.col("n") > HUB).orderBy(F.desc("n"), "x").limit(HUBS).select(F.col("x").alias(node), F.col("m").alias("hub"))
    marked = rows.join(F.broadcast(hubs), node, "left")
    rest = marked.where("hub is null").drop("hub").join(least.select(F.col("x").alias(node), "m"), node)
    return marked.where("hub is not null").withColumnRenamed("hub", "m").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node that is not the smallest of its component, from links (a, b) of long ids.

    Large and small stars alternate until each node hangs on one smaller node that hangs on none. Minima are aggregated with
    map-side combining and written before they are joined; a star with very many links isn't gathered in one task.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("low").alias("low"))
        if ends.where("up > 1 or (up = 1 and low > 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select("v", "u"))
        least = staged(both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"), F.count("*").alias("n")), "minima")
        large = _with_least(both.where("y > x"), "x", least).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "edges")
        discard(edges, least)
        least = staged(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"), F.count("*").alias("n")), "minima")
        joined = _with_least(large, "u", least)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        edges = staged(small, "edges")
        discard(large, least)
