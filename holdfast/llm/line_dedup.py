"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of descending doc_id. A batch's line hashes, counted with map-side combining, are merge-anti-joined
with the runs: hashes that a run already knows in enough documents are settled and need no more counting. What is left
is written as a new sorted run. Two runs of one level are compacted into one of the next, so there are as many runs as binary
digits in the number of batches. Runs hold 32 bytes for each distinct hash, never lines.

A run is a bucketed table: one sorted file for each of as many buckets as a shuffle has partitions then, by the same hash. So the
anti-join of a batch and the compaction of two runs are merges that read runs as they lie, without an exchange or a sort.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, again, numbered, scratch, shuffle_partitions, staged, steps

_white = WHITE.encode()


def _key(line: bytes, least: int) -> bytes | None:
    """The line stripped and with A-Z lower-cased, or None if it has fewer than ``least`` code points."""
    key = line.strip(_white).lower()
    return key if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least) else None


def _hashes(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (h1, h2) of each text's distinct line keys, and how many each text has."""
    found, n = [], []
    for text in texts.cast(pa.binary()).to_pylist():
        own = {key for line in text.split(b"\n") if (key := _key(line, least))} if text else ()
        n.append(len(own))
        found += map(xxhash.xxh3_128_digest, own)
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2), np.array(n, np.int64)


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, h1, h2): hashes of each row's distinct line keys; a null doc_id counts as the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            both, n = _hashes(batch.column("text"), least)
            doc = np.repeat(batch.column("doc_id").to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "h1", "h2"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint")


#: Rows of line hashes for each bucket of a run; there are as many buckets as a shuffle has partitions at the most.
BUCKET = 250_000


@contextmanager
def own_session(spark: SparkSession, buckets: int) -> Iterator[SparkSession]:
    """A session with the settings of ``spark`` and a database of its own, which is dropped at the end with all its tables.

    In it shuffles have as many partitions as runs have buckets, and a bucket that is one sorted file counts as sorted when it
    is read. Settings and catalogue of ``spark`` stay as they are.
    """
    own, database = spark.newSession(), f"holdfast_{uuid.uuid4().hex}"
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", str(buckets))
    own.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    own.sql(f"create database {database} location '{scratch(spark, 'runs')}'")
    try:
        own.sql(f"use {database}")
        yield own
    finally:
        own.sql("use default")
        own.sql(f"drop database if exists {database} cascade")


class Runs:
    """Levelled sorted runs (h1, h2, n, top): in how many documents a hash was found, and the largest doc_id among them."""

    def __init__(self, spark: SparkSession, enough: int):
        self.spark, self.enough, self.levels, self.names = spark, enough, {}, {}
        self.parts = shuffle_partitions(spark)

    def _write(self, rows: DataFrame) -> str:
        """The name of the run of ``rows``, which lie by the hash of (h1, h2): each bucket comes from one task, so it is one file."""
        name = f"run_{uuid.uuid4().hex}"
        self.names[name] = path = scratch(self.spark, "run")
        rows.select("h1", "h2", "n", "top").write.format("parquet").bucketBy(self.parts, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.names.pop(name))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def batch(self, hashes: DataFrame) -> DataFrame:
        """What a new run holds: the counts of the hashes (doc_id, h1, h2) that no run has settled."""
        own = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        for run in self.levels.values():
            own = own.join(self.spark.table(run).where(F.col("n") >= self.enough).hint("merge"), ["h1", "h2"], "left_anti")
        return own

    def merged(self, a: str, b: str) -> DataFrame:
        x, y = self.spark.table(a).alias("x"), self.spark.table(b).alias("y").hint("merge")
        n = F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))
        return x.join(y, ["h1", "h2"], "full").select("h1", "h2", n.alias("n"), F.greatest("x.top", "y.top").alias("top"))

    def _compacted(self, a: str, b: str) -> str:
        out = self._write(self.merged(a, b))
        self._drop(a, b)
        return out

    def add(self, hashes: DataFrame) -> None:
        """Count the hashes of a batch; its doc_ids are below all those before it."""
        level, run = 0, self._write(self.batch(hashes))
        while level in self.levels:
            run, level = self._compacted(self.levels.pop(level), run), level + 1
        self.levels[level] = run

    def frequent(self) -> DataFrame:
        """(h1, h2, n, top) of hashes found in enough documents; the runs are gone after that."""
        while len(self.levels) > 1:
            low, high = sorted(self.levels)[:2]
            self.levels[high] = self._compacted(self.levels.pop(low), self.levels.pop(high))
        out = staged(self.spark.table(next(iter(self.levels.values()))).where(F.col("n") >= self.enough), "frequent")
        self.close()
        return out

    def close(self) -> None:
        self._drop(*list(self.names))
        self.levels = {}


def _found(keys: np.ndarray, doc: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which rows (h1, h2) of ``keys`` are in ``known`` (h1, h2, top; sorted) with a top above the row's document."""
    out = np.zeros(len(keys), bool)
    at, live = np.searchsorted(known[:, 0], keys[:, 0]), np.arange(len(keys))
    while len(live):
        inside = at < len(known)
        live, at = live[inside], at[inside]
        row = known[at]
        same = row[:, 0] == keys[live, 0]
        out[live] |= same & (row[:, 1] == keys[live, 1]) & (row[:, 2] > doc[live])
        live, at = live[same], at[same] + 1
    return out


#: Frequent lines that every task may hold (24 bytes each); beyond that number documents are joined to theirs by a shuffle.
HELD = 500_000
#: In that case the most frequent lines are joined by a broadcast: no other line has over 1 in HOT of the rows.
HOT = 10_000


def drop_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 4, held: int = HELD) -> DataFrame:
    """``docs`` with each text's kept lines, and n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least ``least_chars`` code
    points found in at least ``least_docs`` rows lose all their lines except in the rows with the largest doc_id that holds
    them. Null or empty texts are one empty line. A very long text is split in its task, which holds its lines, and no other
    task sees it. Repeated rows count as documents each. A null doc_id counts as the smallest. Columns named n_lines and
    n_dropped are replaced, all others stay, whatever their names. An empty table gives no rows.

    Up to ``held`` frequent lines are broadcast and texts don't move. With more, texts are shuffled once, to their dropped lines.
    """
    spark = docs.sparkSession
    lines = staged(line_hashes(docs, least_chars), "lines")
    bounds = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    above = None
    with own_session(spark, max(1, min(shuffle_partitions(spark), -(-lines.count() // BUCKET)))) as apart:
        runs, hashes = Runs(apart, least_docs), again(lines, apart)
        try:
            for low in [*sorted(set(bounds), reverse=True), None]:
                batch = hashes if low is None else hashes.where(F.col("doc_id") >= low)
                runs.add(batch if above is None else batch.where(F.col("doc_id") < above))
                above = low
            frequent = again(runs.frequent(), spark)
        finally:
            runs.close()

    kept = docs.drop("n_lines", "n_dropped")
    given, names, named_again = numbered(kept)
    of_text, of_id = (names[kept.columns.index(c)] for c in ("text", "doc_id"))
    schema = T.StructType([*given.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    doc, gone = "doc", "gone"
    own = given.withColumn(doc, F.coalesce(F.col(of_id).cast("bigint"), F.lit(-(2**63))))

    def rewritten(batch: pa.RecordBatch, drops: dict[int, set[bytes]]) -> pa.RecordBatch:
        text = pc.fill_null(batch.column(of_text), "")
        n_lines, n_dropped = pc.add(pc.count_substring(text, "\n"), 1).cast(pa.int64()), np.zeros(len(text), np.int64)
        if drops:
            out = text.to_pylist()
            for i, drop in drops.items():
                old = out[i].encode().split(b"\n")
                new = [x for x in old if (key := _key(x, least_chars)) is None or xxhash.xxh3_128_digest(key) not in drop]
                n_dropped[i], out[i] = len(old) - len(new), b"\n".join(new).decode()
            text = pa.array(out, text.type)
        columns = [text if c == of_text else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*columns, n_lines, pa.array(n_dropped)], names=schema.names)

    if frequent.count() <= held:
        rows = frequent.select("h1", "h2", "top").toArrow()  # ``held`` rows at most
        table = np.stack([rows[c].to_numpy() for c in ("h1", "h2", "top")], axis=1).astype(np.int64)
        known = spark.sparkContext.broadcast(table[np.lexsort((table[:, 1], table[:, 0]))])

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, of_text):
                ids = batch.column(doc).to_numpy()
                keys, n = _hashes(batch.column(of_text), least_chars)
                row, drops = np.repeat(np.arange(len(ids)), n), {}
                for i in np.flatnonzero(_found(keys, ids[row], known.value)).tolist():
                    drops.setdefault(int(row[i]), set()).add(keys[i].tobytes())
                yield rewritten(batch, drops)

        return named_again(own.mapInArrow(in_place, schema))

    hot = frequent.orderBy(F.desc("n"), "h1", "h2").limit(HOT).select("h1", "h2", F.col("top").alias("hot_top"))
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    rest = frequent.join(F.broadcast(hot), ["h1", "h2"], "left_anti").select("h1", "h2", "top")
    dealt = marked.where("hot_top is null").join(rest, ["h1", "h2"]).where("doc_id < top")
    all_gone = marked.where("doc_id < hot_top").select("doc_id", "h1", "h2").unionAll(dealt.select("doc_id", "h1", "h2"))
    dropped = all_gone.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, of_text):
            pairs = batch.column(gone)
            here = np.flatnonzero(pairs.is_valid().to_numpy(zero_copy_only=False))
            found = pairs.take(pa.array(here)).to_pylist()
            yield rewritten(batch, {i: {np.array([p["h1"], p["h2"]], "<i8").tobytes() for p in x} for i, x in zip(here.tolist(), found, strict=True)})

    return named_again(own.join(dropped, doc, "left").mapInArrow(joined, schema))
