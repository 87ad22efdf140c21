"""SimHash near-dedup at a similarity of shingle sets, by wide fingerprints and BK-trees.

Bits of two SimHashes differ with a probability that follows from the similarity of the shingle sets: with A and B of Jaccard
similarity s, the share of differing bits is at most acos(2s / (1 + s)) / pi. Sixty-four bits are too few to tell 0.8 from 0.7;
a fingerprint here has ``LANES`` x 64, and two documents are linked if they differ in no more bits than that share and two
standard errors.

Candidates: tables of ``bits`` places each, drawn from the fingerprint; documents that agree on all places of a table are in one
bucket, a shard with a BK-tree over the first lane. With more documents a table has more places, so that buckets stay small, and
there are more tables, so that a pair at the similarity meets in one of them with the same probability. Buckets get 64 bits of
a document; the links that their trees find are verified over all lanes. Before buckets are dealt, each task gathers what is
close to a leader among its own rows: a group of any size leaves a task as links to a few leaders. That joins most of what
belongs together and may leave a link out; so buckets are dealt once more, whole, and what meets there from two groups is
compared row by row and verified. Every pair of a bucket within the radius is then in one group or was verified and isn't near.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, discard, named, shuffle_partitions, staged, steps, whole_groups
from .components import components, merge_labels
from .simhash import pairs_within

LANES = 16
BITS = 64 * LANES
#: A bucket's documents on average at the most, rows in a bucket of one task from which leaders are sought, and shingles whose bits are counted at once.
FILL, CROWD, SHINGLES = 64, 32, 1 << 16
#: Pairs of a bucket that are compared at once.
COMPARED = 1 << 16
#: The constants of SplitMix64.
_golden, _one, _two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_bytes = np.uint64(0x0101010101010101)
_white = np.isin(np.arange(256), list(WHITE.encode()))
_of_lane = np.arange(1, LANES + 1, dtype=np.uint64) * _golden


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _one
    x = (x ^ (x >> np.uint64(27))) * _two
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles, repeats included, and how many each text has.

    Words are what white space leaves, A-Z lower-cased. A text with fewer words is one shingle, one without words has none.
    """
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if not offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # Runs of white space and of other characters in turn, none across two texts; the latter are the words.
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]
    data = data + ((data >= ord("A")) & (data <= ord("Z"))) * np.uint8(32)
    white = _white[data]
    mark = np.zeros(len(white) + 1, bool)
    mark[1:-1] = white[1:] != white[:-1]
    mark[offsets] = True
    cut = np.flatnonzero(mark)
    runs = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(data)])
    is_word = ~white[cut[:-1]]
    coded = runs.filter(pa.array(is_word)).dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(is_word)])[np.searchsorted(cut, offsets)]
    known = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    m = np.diff(offsets)
    n = np.where(m >= words, m - words + 1, (m > 0).astype(np.int64))
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    size = np.repeat(np.minimum(m, words), n)
    h = np.zeros(len(first), np.uint64)
    for j in range(words):
        here = size > j
        h[here] = h[here] * _golden + word[first[here] + j]
    return _mixed(h + size.astype(np.uint64)), n


def wide_fingerprints(texts: pa.Array, words: int) -> np.ndarray:
    """(texts, LANES) of 64 bits: a bit is 1 if it is set in over half the values that a lane makes of the text's shingles."""
    hashes, n = shingle_hashes(texts, words)
    ones = np.zeros((len(n), LANES, 8, 8), np.int32)
    row = np.repeat(np.arange(len(n)), n)
    for a in range(0, len(hashes), SHINGLES):
        here, of = hashes[a : a + SHINGLES], row[a : a + SHINGLES]
        # Eight counters of a byte each lie in one word, so that up to 255 shingles of a text are added at once.
        fresh = np.concatenate([[True], of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        begin = np.flatnonzero(place % 255 == 0)
        first = np.flatnonzero(np.concatenate([[True], of[begin][1:] != of[begin][:-1]]))
        texts_here = of[begin][first]
        for lane in range(LANES):
            h = _mixed(here + _of_lane[lane])
            for bit in range(8):
                sums = np.add.reduceat((h >> np.uint64(bit)) & _bytes, begin).view(np.uint8).reshape(-1, 8)
                ones[texts_here, lane, bit] += np.add.reduceat(sums, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones.reshape(len(n), LANES, 64) > n[:, None, None], axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp): LANES x 8 bytes. A null text counts as empty and gives zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            wide = wide_fingerprints(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in wide], pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp binary")


def differing(similarity: float) -> tuple[float, int]:
    """The share of bits that differ at a similarity, and how many of all lanes' bits may: two standard errors more."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return share, round(BITS * (share + 2 * sqrt(share * (1 - share) / BITS)))


def tables(documents: int, similarity: float, recall: float) -> np.ndarray:
    """(tables, places) of bits: as many places as leave FILL documents in a bucket, as many tables as the recall asks for."""
    bits = max(8, ceil(log(max(1.0, documents / FILL), 2)))
    met = (1 - differing(similarity)[0]) ** bits
    rng = np.random.default_rng(17)
    n = max(1, ceil(log(1 - recall) / log(1 - met)))
    # Each draw goes through all bits beyond the first lane, which the trees use, before it takes one again.
    draws = np.concatenate([rng.permutation(np.arange(64, BITS)) for _ in range(ceil(n * bits / (BITS - 64)))])
    return draws[: n * bits].reshape(n, bits)


def _wide(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LANES)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def led(fps: np.ndarray, crowd: np.ndarray, close: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a crowd of rows the leaders, and links (row, leader).

    The first row that is left leads those within ``close`` bits of it, and is linked to one row of each earlier leader's within
    ``most`` bits, so that a leader's following is joined to another's by any of its rows.
    """
    leaders, links, of = [], [], np.full(len(crowd), -1)
    while (left := np.flatnonzero(of < 0)).size:
        lead = left[0]
        d = _apart(fps[crowd], fps[crowd[lead]])
        beside = np.flatnonzero((of >= 0) & (d <= most))
        _, one = np.unique(of[beside], return_index=True)
        own = left[d[left] <= close]
        of[own] = len(leaders)
        for rows in (beside[one], own[1:]):
            links.append(np.stack([crowd[rows], np.full(len(rows), crowd[lead])], axis=1))
        leaders.append(crowd[lead])
    return np.array(leaders), np.concatenate(links)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which pairs (a, b) of n rows, taken in order, join two groups."""
    labels, kept = np.arange(n), []
    for at in range(0, len(a), 4096):
        step = np.arange(at, min(at + 4096, len(a)))
        x, y = labels[a[step]], labels[b[step]]
        apart = x != y
        # Groups as they were before this step, joined one pair after another.
        root: dict[int, int] = {}

        def top(g: int, root: dict[int, int] = root) -> int:
            while (up := root.get(g, g)) != g:
                root[g] = root.get(up, up)
                g = up
            return g

        for i, g, h in zip(step[apart].tolist(), x[apart].tolist(), y[apart].tolist(), strict=True):
            g, h = top(g), top(h)
            if g != h:
                root[max(g, h)] = min(g, h)
                kept.append(i)
        labels = merge_labels(labels, a[step][apart], b[step][apart])
    return np.array(kept, np.int64)


def bucket_keys(fps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(rows, tables): the bucket of each row in each table."""
    powers = (1 << np.arange(places.shape[1], dtype=np.int64))[::-1]
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
    return np.stack([bits[:, p] @ powers for p in places], axis=1) + (np.arange(len(places), dtype=np.int64) << 40)


def dealt(distinct: DataFrame, places: np.ndarray, most: int) -> DataFrame:
    """(key, rep, sketch): documents in their buckets; and, with a null key, links (rep, sketch) that a task has found itself.

    A crowd of a bucket within a task sends only its leaders on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                fps, rep = _wide(part.column("fp")), part.column("rep").to_numpy()
                key = bucket_keys(fps, places)
                row = np.repeat(np.arange(len(fps)), len(places))
                order = np.argsort(key.ravel(), kind="stable")
                key, row = key.ravel()[order], row[order]
                begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
                crowded = np.flatnonzero(np.diff(begin) > CROWD)
                stay, found = np.ones(len(key), bool), []
                if len(crowded):
                    for i in crowded.tolist():
                        crowd = row[begin[i] : begin[i + 1]]
                        leaders, links = led(fps, crowd, most * 3 // 4, most)
                        stay[begin[i] : begin[i + 1]] = np.isin(crowd, leaders)
                        found.append(links)
                    found = np.concatenate(found)
                    found = found[forest(found[:, 0], found[:, 1], len(fps))]
                a, b = (rep[found[:, 0]], rep[found[:, 1]]) if len(found) else (rep[:0], rep[:0])
                keys = pa.array(np.concatenate([key[stay], np.zeros(len(a), np.int64)]), mask=np.arange(stay.sum() + len(a)) >= stay.sum())
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([rep[row[stay]], a])), pa.array(np.concatenate([fps[row[stay], 0].view(np.int64), b]))], names=["key", "rep", "sketch"])

    return distinct.select("rep", "fp").mapInArrow(run, "key bigint, rep bigint, sketch bigint")


def candidates(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs that the buckets' trees find within ``radius`` bits of the sketch, in each bucket two forests of them at the most."""

    def linked(key: np.ndarray, rep: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        tree = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        found = [p for p in pairs_within(sketch.view(np.uint64), tree, radius) if len(p[0])]
        a, b, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        # The closest pairs join first, as they are the likeliest to be verified; a second forest of other pairs serves where one isn't.
        order = np.lexsort((b, d))
        first = order[forest(a[order], b[order], len(key))]
        order = order[~np.isin(order, first)]
        some = np.concatenate([first, order[forest(a[order], b[order], len(key))]])
        pairs = np.unique(np.sort(np.stack([rep[a[some]], rep[b[some]]], axis=1), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ("key", "rep", "sketch"), 1, 50_000):
            yield linked(*part)

    rows = buckets.repartition(shuffle_partitions(buckets.sparkSession), "key").sortWithinPartitions("key", "rep")
    return rows.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, distinct: DataFrame, most: int) -> DataFrame:
    """The pairs whose fingerprints differ in ``most`` bits at the most."""
    fps = distinct.select("rep", "fp")
    both = pairs.distinct().join(fps.withColumnsRenamed({"rep": "a", "fp": "fp_a"}), "a").join(fps.withColumnsRenamed({"rep": "b", "fp": "fp_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pa.array(_apart(_wide(batch.column("fp_a")), _wide(batch.column("fp_b"))) <= most)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], names=["a", "b"])

    return both.select("a", "b", "fp_a", "fp_b").mapInArrow(run, "a bigint, b bigint")


def rest(distinct: DataFrame, joined: DataFrame, places: np.ndarray, radius: int, most: int) -> DataFrame:
    """(a, b): links between rows of a bucket that ``joined`` (node, component) leaves in two groups.

    Buckets are dealt whole, with all lanes. A row is compared with the rows of later groups in its bucket, ``COMPARED`` pairs at
    once, and with none of its own group, however large that is. Of links between groups that others join already none leaves.
    """
    lanes = [f"l{i}" for i in range(LANES)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = _wide(part.column("fp"))
                row = np.repeat(np.arange(len(fps)), len(places))
                rep, group = (part.column(c).to_numpy()[row] for c in ("rep", "group"))
                wide = fps.view(np.int64)[row]
                yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(fps, places).ravel()), pa.array(group), pa.array(rep), *(pa.array(wide[:, i]) for i in range(LANES))], names=["key", "group", "rep", *lanes])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group, rep, *wide in whole_groups(batches, ("key", "group", "rep", *lanes), 1, 20_000):
            n, fps = len(key), np.stack(wide, axis=1).view(np.uint64)
            last = np.concatenate([key[1:] != key[:-1], [True]])
            own_last = last | np.concatenate([group[1:] != group[:-1], [True]])
            end, own = (np.flatnonzero(x)[np.searchsorted(np.flatnonzero(x), np.arange(n))] + 1 for x in (last, own_last))
            labels = np.unique(own, return_index=True)[1][np.cumsum(np.concatenate([[0], own_last[:-1]]))]
            upto, begin = np.cumsum(end - own), 0
            while begin < n:
                stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + COMPARED, "right")))
                here = (end - own)[begin:stop]
                a = np.repeat(np.arange(begin, stop), here)
                b = np.arange(len(a)) - np.repeat(np.cumsum(here) - here, here) + own[a]
                near = (np.bitwise_count(fps[a, 0] ^ fps[b, 0]) <= radius) & (labels[a] != labels[b])
                a, b = a[near], b[near]
                near = _apart(fps[a], fps[b]) <= most
                if near.any():
                    a, b = a[near], b[near]
                    some = forest(labels[a], labels[b], n)
                    labels = merge_labels(labels, a[some], b[some])
                    yield pa.RecordBatch.from_arrays([pa.array(rep[a[some]]), pa.array(rep[b[some]])], names=["a", "b"])
                begin = stop

    labelled = distinct.join(joined, distinct.rep == joined.node, "left").select("rep", "fp", F.coalesce("component", "rep").alias("group"))
    rows = labelled.mapInArrow(deal, "key bigint, group bigint, rep bigint, " + ", ".join(f"{c} bigint" for c in lanes))
    rows = rows.repartition(shuffle_partitions(distinct.sparkSession), "key").sortWithinPartitions("key", "group")
    return rows.mapInArrow(meet, "a bigint, b bigint")


def groups(distinct: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(node, component) of the fingerprints (rep, fp) that a link joins to another one."""
    share, most = differing(similarity)
    places = tables(distinct.count(), similarity, recall)
    buckets = staged(dealt(distinct, places, most), "buckets")
    own = buckets.where("key is null").select(F.col("rep").alias("a"), F.col("sketch").alias("b"))
    radius = round(64 * share + 2.4 * sqrt(64 * share * (1 - share)))
    found = staged(verified(candidates(buckets.where("key is not null"), radius), distinct, most).unionAll(own), "links")
    discard(buckets)
    joined = staged(components(found), "joined")
    more = staged(rest(distinct, joined, places, radius, most), "more-links")
    return components(found.unionAll(more)) if more.take(1) else joined


def similar_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """One row for each document: doc_id, component_id (smallest doc_id reachable by links at ``similarity`` of shingle sets).

    A pair at the similarity meets in a bucket with the probability ``recall``, and its bits are within the bound with 0.97; closer
    pairs are found nearly always, and pairs well below (0.7 of 0.8) practically never. Texts are lower-cased in A-Z; a text with
    fewer than ``words`` words is one shingle; null or empty texts are alike. A very long text is hashed whole, in its task.
    Repeated rows give repeated rows. Rows with a null doc_id support no links: a fingerprint that only they have gives a null
    component_id. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    joined = groups(distinct, similarity, recall)
    group = distinct.join(joined, distinct.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    group = staged(group, "groups")
    return rows.join(group, "fp", "left").select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, held: int = 500_000, **parameters) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows with a null doc_id stay. All columns, whatever their names.

    Up to ``held`` doc_ids that go are broadcast, behind a check of their number; beyond that the rows are shuffled once to theirs.
    """
    out = similar_copies(docs.where("doc_id is not null"), **parameters)
    gone = staged(out.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= held else gone.hint("merge"), "doc_id", "left_anti").select(*map(named, docs.columns))
