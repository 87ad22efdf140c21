"""SimHash near-dedup with BK-trees.

Fingerprints within ``radius`` bits agree in full on one of radius + 1 blocks of bits, so distinct fingerprints are dealt by
(block, its value), and each such bucket is a shard with its own BK-tree. The set of all fingerprints grows with the corpus:
the shards' trees meet their queries by a shuffle, not by a broadcast. A bucket with more than ``most`` fingerprints is dealt
again by blocks of its other bits, and once more if need be; its members still agree on one of those if they differ in at most
``radius`` bits.
Trees of many buckets are built and searched at once, level by level, following only edges within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, shuffle_partitions, staged, steps, whole_groups
from .components import components, merge_labels

#: Fingerprints whose trees are built at once, and pairs of query and node that those followed at once may lead to: each leads to
#: 2 * radius + 1 at the most, and as many wait at each level of the trees.
TREES, FRONT = 50_000, 9 << 17


def fingerprint(text: bytes, words: int = 4) -> int:
    """A bit is 1 if it is set in over half the XXH64 values (seed 42) of the text's shingles, repeats included."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    begin = np.cumsum([0, *map(len, found)]) + np.arange(len(found) + 1)
    ends = (begin[words:] - 1).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(begin.tolist(), ends, strict=False)), np.uint64, len(ends))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes())


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the 64 bits as a signed long. A null text counts as empty and gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = [fingerprint(t or b"", words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    cut = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _value(bits: list[int]) -> Column:
    """The bits of fp at these places, with the others 0."""
    return F.col("fp").bitwiseAND(F.lit(sum(1 << b for b in bits) - (1 << 64 if 63 in bits else 0)))


#: How often a bucket is dealt: after the third time its members agree on more than half of their bits.
LEVELS = 3


def _paths(n: int, level: int) -> list[tuple[int, list[int], list[int]]]:
    """(number, bits that are fixed, bits that remain) of the choices of one block of n at each of ``level`` levels."""
    out = [(0, [], list(range(64)))]
    for _ in range(level):
        out = [(p * n + j + 1, fixed + b, [x for x in rest if x not in b]) for p, fixed, rest in out for j, b in enumerate(_blocks(rest, n))]
    return out


def buckets(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """(fp, rep, block, value): each fingerprint in all its buckets; block tells which bits value holds."""
    n = radius + 1
    first = F.explode(F.array(*[F.struct(F.lit(p).alias("block"), _value(fixed).alias("value")) for p, fixed, _ in _paths(n, 1)]))
    dealt = rows.select("fp", "rep", first.alias("b")).select("fp", "rep", "b.block", "b.value")
    for level in range(2, LEVELS + 1):
        large = staged(dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > most).select("block", "value", F.lit(True).alias("large")), "large")
        if large.isEmpty():
            break
        again = F.lit(None).cast("array<struct<block:int,value:bigint>>")
        for p, _, _ in _paths(n, level - 1):
            own = [(q, fixed) for q, fixed, _ in _paths(n, level) if (q - 1) // n == p]
            again = F.when(F.col("block") == p, F.array(*[F.struct(F.lit(q).alias("block"), _value(fixed).alias("value")) for q, fixed in own])).otherwise(again)
        able = F.coalesce("large", F.lit(False)) & F.col("block").isin([p for p, _, _ in _paths(n, level - 1)])
        joined = dealt.join(large, ["block", "value"], "left")
        dealt = joined.select("fp", "rep", F.explode(F.when(able, again).otherwise(F.array(F.struct("block", "value")))).alias("b")).select("fp", "rep", "b.block", "b.value")
    return dealt


def grow(fps: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """BK-trees of fingerprints, rows of one ``tree`` number each in a run: child[i, d] is i's child at distance d, or -1."""
    n = len(fps)
    child = np.full((n, 65), -1, np.int32)
    root = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    at = np.repeat(root, np.diff(np.append(root, n)))
    left = np.flatnonzero(at != np.arange(n))
    while len(left):
        d = np.bitwise_count(fps[left] ^ fps[at[left]])
        free = child[at[left], d] < 0
        # Of those that come to a free edge together, the first becomes the child.
        edge = at[left[free]] * 65 + d[free]
        _, one = np.unique(edge, return_index=True)
        child.ravel()[edge[one]] = left[free][one]
        at[left] = child[at[left], d]
        left = left[at[left] != left]
    return child


def pairs_within(fps: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (query, node, distance) of one tree within ``radius`` bits, node before query; only edges that can lead to some are followed."""
    n = len(fps)
    child = grow(fps, tree)
    root = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    query, node = np.arange(n, dtype=np.int32), np.repeat(root, np.diff(np.append(root, n))).astype(np.int32)
    front = FRONT // (2 * radius + 1)
    stack = [(query[i : i + front // 16], node[i : i + front // 16]) for i in range(0, n, front // 16)]
    while stack:
        query, node = stack.pop()
        if len(query) > front:
            half = len(query) // 2
            stack += [(query[half:], node[half:])]
            query, node = query[:half], node[:half]
        d = np.bitwise_count(fps[query] ^ fps[node]).astype(np.int32)
        near = (d <= radius) & (node < query)
        yield query[near], node[near], d[near]
        follow = [], []
        for edge in range(-radius, radius + 1):
            inside = (d + edge > 0) & (d + edge <= 64)
            to = np.where(inside, child[node, np.clip(d + edge, 0, 64)], -1)
            follow[0].append(query[to >= 0])
            follow[1].append(to[to >= 0])
        if sum(map(len, follow[0])):
            stack.append((np.concatenate(follow[0]), np.concatenate(follow[1])))


def search(fps: np.ndarray, tree: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the first of its tree reachable by links of at most ``radius`` bits."""
    labels = np.arange(len(fps))
    for query, node, _ in pairs_within(fps, tree, radius):
        labels = merge_labels(labels, query, node)
    return labels


def links(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """(a, b): links between representatives that join what each bucket joins, at most one for each member of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, block, fps, rep in whole_groups(batches, ("value", "block", "fp", "rep"), 2, TREES):
            tree = np.cumsum(np.concatenate([[False], (value[1:] != value[:-1]) | (block[1:] != block[:-1])]))
            label = search(fps.view(np.uint64), tree, radius)
            far = label != np.arange(len(fps))
            yield pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[label[far]])], names=["a", "b"])

    dealt = buckets(rows, radius, most).repartition(shuffle_partitions(rows.sparkSession), "block", "value")
    return dealt.sortWithinPartitions("block", "value", "rep").mapInArrow(run, "a bigint, b bigint")


def near_copies(docs: DataFrame, words: int = 4, radius: int = 4, most: int = 1024) -> DataFrame:
    """One row for each document: doc_id, fp, component_id (smallest doc_id reachable by links of at most ``radius`` bits).

    Texts are lower-cased in A-Z; a text with fewer than ``words`` words is one shingle; null or empty texts have fingerprint
    0, linked like any other; a very long text is hashed whole, in its task, with counts of 64 bits in blocks of shingles.
    Repeated rows give repeated rows. Rows with a null doc_id are not supported by links: a fingerprint that only they have gives
    a null component_id. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(staged(links(distinct.where("rep is not null"), radius, most), "links"))
    group = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    group = staged(group, "groups")
    return rows.join(group, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows with a null doc_id stay."""
    gone = near_copies(docs.where("doc_id is not null"), **parameters).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(named, docs.columns))
