"""Tokenised corpora as files of Simple-8b words, in ascending doc_id order.

The container is Parquet: one row is a segment, with its shard and place, its documents' ids and lengths, words, block
starts and escapes. Spark's committer writes it, so a lost executor leaves no half file, on any file system Spark can reach.
Shards are ranges of doc_id; a shard's rows come from one task, which streams its documents and holds one segment at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import shuffle_partitions, steps, text_or_empty
from .tokens import encoder, tokenizer_path

SEGMENTS = "shard int, seq int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, block_starts binary, words binary, escapes binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 0, shards: int | None = None) -> None:
    """Encode ``text`` of all rows and write the files to ``path``.

    Null or empty texts give the end id alone (nothing without one). A very long text is encoded whole, alone in its segment.
    Repeated rows are documents each; rows that share a doc_id follow one another in the order of their texts; a null doc_id
    comes first. Other columns are ignored, whatever their names. An empty table gives files without rows.
    """
    tokenizer = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, seq = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        for batch in steps(batches):
            ids, offsets = encode(batch.column("text"))
            if end_id is not None:
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
            words, starts, escapes = simple8b.encode(ids)
            row = [shard, seq, batch.column("doc_id").to_pylist(), np.diff(offsets).tolist(), len(ids), starts.tobytes(), words.tobytes(), escapes.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _types, strict=True)], names=_names)
            seq += 1

    rows = docs.select("doc_id", text_or_empty())
    # The beginning of a text splits the rows of one doc_id, or of none, among shards; order is by whole texts.
    ordered = rows.repartitionByRange(shards or shuffle_partitions(docs.sparkSession), "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "zstd").mode("overwrite").parquet(path)


_names = [x.split()[0] for x in SEGMENTS.split(", ")]
_types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def segment_ids(row: dict) -> np.ndarray:
    """All ids of a segment, decoded."""
    parts = (np.frombuffer(row[k], np.uint64) for k in ("words", "block_starts", "escapes"))
    return simple8b.decode(*parts, row["n_ids"])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files at ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for."""
    files = spark.read.schema(SEGMENTS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = segment_ids(row).astype("<u4")
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - np.array(row["lengths"], np.int64)
                n = len(ends)
                parts = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                columns = [np.full(n, row["shard"], np.int32), np.full(n, row["seq"], np.int32), starts, row["doc_ids"], row["lengths"], np.array([zlib.crc32(p) for p in parts], np.int64)]
                out = [pa.array(c) for c in columns] + ([pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(out, names=["shard", "seq", "place", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(out)])

    docs = files.mapInArrow(run, "shard int, seq int, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
    # A shard's segments are few, and there is one row for each shard in the window over shards.
    of_shard = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("shard_start", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    inner = Window.partitionBy("shard").orderBy("seq")
    of_segment = files.select("shard", "seq", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("segment_start"))
    base = of_segment.join(of_shard, "shard").select("shard", "seq", (F.col("shard_start") + F.col("segment_start")).alias("base"))
    out = docs.join(base, ["shard", "seq"]).withColumn("start", F.col("base") + F.col("place"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
