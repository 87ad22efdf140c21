"""Exact dedup with a heavy-hitter split.

Misra-Gries counters over the digests of each task, merged, name the digests that may be frequent; there are at most ``heavy``
of them. Their exact sizes and winners are counted with map-side combining and broadcast (``heavy`` rows of about 60 bytes),
so their rows are decided where they lie. No digest of the other rows has more than about 1 in ``heavy`` of all rows; they are
grouped by an ordinary shuffle of digests. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CHAR, staged


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).alias("size"), F.unhex(F.sha2(F.regexp_replace(text, WHITE_CHAR, ""), 256)).alias("digest"))


def misra_gries(rows: DataFrame, column: str, counters: int) -> DataFrame:
    """(value, n): at most ``counters`` values for each task, with every value that has over 1 in ``counters`` of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                kept[x["values"]] = kept.get(x["values"], 0) + x["counts"]
            if len(kept) > counters:
                less = sorted(kept.values(), reverse=True)[counters]
                kept = {k: v - less for k, v in kept.items() if v > less}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["value", "n"])

    return rows.select(column).mapInArrow(run, "value binary, n bigint")


def mark_copies(docs: DataFrame, heavy: int = 1024) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, digest (SHA-256 of the text without white space).

    Of rows with equal texts the one with the most code points stays, then the one with the smallest doc_id. Null counts as
    empty; a very long text is hashed whole, in its task. Repeated rows with one doc_id count in group_size, and all of them are
    marked as kept if that doc_id stays. A null doc_id loses ties of
    length against any other. Other columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    rows = staged(digests(docs), "digests")
    win = [F.count("*").alias("group_size"), F.max_by("doc_id", F.struct("size", F.bitwise_not("doc_id"))).alias("keep_id")]
    frequent = misra_gries(rows, "digest", heavy).groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(heavy)
    # Misra-Gries may name values that are not frequent: the exact counts decide.
    named = rows.join(F.broadcast(frequent.select(F.col("value").alias("digest"))), "digest", "left_semi")
    winners = staged(named.groupBy("digest").agg(*win).where("group_size > 1"), "winners")
    found = rows.join(F.broadcast(winners), "digest", "left")
    light = found.where("group_size is null").select("doc_id", "size", "digest")
    grouped = light.join(light.groupBy("digest").agg(*win), "digest")
    both = found.where("group_size is not null").select("doc_id", "keep_id", "group_size", "digest").unionByName(grouped.select("doc_id", "keep_id", "group_size", "digest"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
