"""Corpus pipeline: documents in, packed sequences out. Each stage is one operator on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import line_dedup, mixing, packing, quality, wide_simhash
from holdfast.llm.common import named, staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that trees learned from the labels accept, with all their columns.

    Null and empty texts are scored like any other, very long ones whole; equal rows fare alike, null doc_ids and sources stay as
    they are, and columns of any name are kept. An empty table gives no rows.
    """
    trees = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score(docs, trees).where("predicted = 1").select(*map(named, docs.columns))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the long lines that another document with a larger doc_id keeps; n_chars follows.

    A null text becomes empty. A very long text is split in its task. Repeated rows count as documents each; of rows with the
    largest doc_id that holds a line all keep it; a null doc_id counts as the smallest. Columns of any name are kept but for
    n_lines and n_dropped, which documents don't have. An empty table gives no rows.
    """
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*map(named, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 join: that of the smallest doc_id.

    Null, empty and blank texts are one group. A very long text is hashed whole. Rows that repeat a doc_id stay or go together;
    rows with a null doc_id stay. Columns of any name are kept. An empty table gives no rows.
    """
    return wide_simhash.keep_one_similar(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, twice at the most.

    Null and empty texts have no words; a very long text counts whole. A null source is one. Repeated rows and null doc_ids are
    documents each; ties go by doc_id and a hash of the text, so that reruns agree. Columns of any name are kept. An empty table
    gives no rows.
    """
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 1024 tokens.

    A null or empty text is its end token alone; only a text longer than a sequence is cut. Repeated rows and null doc_ids are
    packed as often as they come; other columns are left out. An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no gradient-boosted trees, XXH64 or tokenizer; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
