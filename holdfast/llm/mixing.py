"""Mixing of sources to target weights by systematic sampling, with DataFrame operations only.

Within a source every document is expected as often as target / size of the source. Documents are ordered by size, so
that each stretch of the prefix sum holds documents of like size and the words taken stay near the target; a document comes
once for each integer that its stretch, moved by the source's one random offset, crosses. Ranks within a source come from a range
sort of the whole table: the place in a task's sorted rows, and a sum over tasks. No source's rows are ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.runs import ranked
from .common import NOT_WHITE_RUN, fresh, named, place_in_files, shuffle_partitions, staged


def words() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NOT_WHITE_RUN)).cast("bigint")


#: Sources whose targets one task may reckon (a row of some 50 bytes each); with more they are reckoned by sums over all tasks.
HELD = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, held: int = HELD) -> DataFrame:
    """One row for each source of (source, size): source, source_size, target, and the offset of its prefix sum.

    Sources in code-point order, null last, have the weights in turn. Together the targets are ``share`` of all sizes; none is
    above ``most`` times its source's size, and what is above goes to the others by weight until none is.
    """
    n, table = len(weights), F.array(*map(F.lit, weights))
    of = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    few = of.count() <= held
    if few:
        of = of.withColumn("nth", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    else:
        named = ranked(of.where("source is not null"), [], ["source"], "nth")
        of = named.unionByName(of.where("source is null").withColumn("nth", F.lit(named.count())))
    of = of.withColumn("weight", F.element_at(table, (F.col("nth") % n + 1).cast("int")).cast("double")).withColumn("cap", most * F.col("source_size"))
    target = _filled_by_windows(of, share) if few else _filled_by_sums(of, share)
    offset = ((F.col("nth") * 40503 + seed * 9973) % 65536) / F.lit(65536.0)
    return target.select("source", "source_size", "target", offset.alias("offset"))


def _filled_by_windows(of: DataFrame, share: float) -> DataFrame:
    """In order of cap / weight the first sources are at their caps; the others share what these leave by weight."""
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    of = of.withColumns({"rest": share * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "heavy": F.sum("weight").over(after), "place": F.row_number().over(by_cap)})
    open_ = F.when(F.col("rest") * F.col("weight") <= F.col("cap") * F.col("heavy"), F.struct("place", "rest", "heavy"))
    of = of.withColumn("first", F.min(open_).over(everyone))
    # Where no source is open (the caps together are below what there is to share), all are at their caps.
    return of.withColumn("target", F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap")).otherwise(F.col("first.rest") * F.col("weight") / F.col("first.heavy")))


def _filled_by_sums(of: DataFrame, share: float) -> DataFrame:
    """Sources above their caps are set to them, and the rest is shared anew, until none is above: a sum over all sources each time."""
    of = staged(of, "weighted")
    total, heavy = of.agg(share * F.sum("source_size"), F.sum("weight")).first()
    rest = total
    while True:
        over = rest * F.col("weight") > F.col("cap") * heavy
        capped, free = of.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~over, F.col("weight")))).first()
        if free is None or (total - capped, free) == (rest, heavy):
            return of.withColumn("target", F.when(over, F.col("cap")).otherwise(rest * F.col("weight") / heavy))
        rest, heavy = total - capped, free


def _copies(rows: DataFrame, **parameters) -> DataFrame:
    """``rows`` (row, doc_id, source, size, tie), which are staged, with source_size, target and copies; row and tie only break ties."""
    spark = rows.sparkSession
    order = ["source", "size", "doc_id", "tie", "row"]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = staged(ordered.select("row", "doc_id", "source", "size", "at", F.shiftright("at", 33).alias("task")), "ordered")
    part = ordered.groupBy("source", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    shift = F.sum("n").over(Window.partitionBy("source").orderBy("task")) - F.col("n") - F.col("first")
    part = part.select("source", "task", shift.alias("shift")).alias("p")
    of = targets(rows, **parameters).alias("o")
    base = part.join(of, F.expr("p.source <=> o.source")).select("p.source", "p.task", "p.shift", "o.source_size", "o.target", "o.offset").alias("b")
    rank = F.col("at") + F.col("shift")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(each * (rank + 1) + F.col("offset")) - F.floor(each * rank + F.col("offset"))
    # A row for each source and task grows with both: it is dealt out, not broadcast. A key has one task's rows at most.
    out = ordered.alias("r").join(base.hint("merge"), F.expr("r.source <=> b.source and r.task = b.task"))
    return out.select("row", "doc_id", "r.source", "size", "source_size", "target", F.least(crossed, F.ceil(each)).alias("copies"))


def copies(docs: DataFrame, **parameters) -> DataFrame:
    """One row for each document: doc_id, source, size (words), source_size, target, copies, taken (copies x size).

    A null text has size 0; a very long text counts whole; null is a source of its own. No document comes more often than
    target / source_size rounded up. Documents without words in a source without words have 0 copies. Repeated rows are documents
    each; a null doc_id comes first among rows of its source and size. Reruns agree, whatever the partitions. Other columns are
    ignored, whatever their names. An empty table gives no rows. No task holds more than ``HELD`` sources' rows.
    """
    none = F.lit(0).cast("bigint")
    rows = staged(docs.select(none.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", words().alias("size"), none.alias("tie")), "sizes")
    return _copies(rows, **parameters).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as ``copies`` says, with all their columns, whatever their names.

    Rows are decided on by number, source and size; texts are joined to the decisions once. Rows that agree in doc_id, source
    and size go by a hash of their texts, so that reruns agree; equal rows are interchangeable. Rows of files are numbered by
    file and place, so that their texts aren't written once more; others are numbered in a written table.
    """
    row, n = fresh(docs, "row", "copies")
    if (place := place_in_files(docs)) is not None:
        numbered = docs.select("*", place.alias(row))
    else:
        numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    sizes = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", words().alias("size"), F.xxhash64("text").alias("tie"))
    taken = _copies(staged(sizes, "sizes"), **parameters).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(n))
    again = F.explode(F.array_repeat(F.lit(1), F.col(n))).alias(n)
    return numbered.join(taken, row).select(*map(named, docs.columns), again).drop(n)
