"""What the training-data operators share: table access, text helpers, and staging in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import again, discard, place_in_files, scratch, shared_dir, shuffle_partitions, staged  # noqa: F401

#: The white space of every contract here: space and the five control characters tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
NOT_WHITE_RUN = r"[^\x20\x09-\x0D]+"
WHITE_CHAR = r"[\x20\x09-\x0D]"
#: Bytes of text that one vectorised step of a Python operator works on.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, each with one row or about ``most`` bytes of ``column`` at the most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(size) + 64
        yield batch.slice(begin)


def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], keys: int, least: int) -> Iterator[list[np.ndarray]]:
    """The columns (of numbers) in parts of about ``least`` rows or more, none of which ends within rows that agree in the first ``keys`` columns."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy() for c in columns]
        if n + batch.num_rows >= least:
            change = np.zeros(batch.num_rows, bool)
            for c, x in enumerate(new[:keys]):
                change[1:] |= x[1:] != x[:-1]
                change[0] |= bool(held) and x[0] != held[-1][c][-1]
            if change.any():
                end = int(change.nonzero()[0][-1])
                yield [np.concatenate(x) for x in zip(*held, [x[:end] for x in new], strict=True)]
                held, n, new = [], 0, [x[end:] for x in new]
        held.append(new)
        n += len(new[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def named(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def numbered(df: DataFrame) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns named by position, so that any name survives a Python function; those names; and what gives the
    columns their own names again, of a frame that may lack some, and leaves what was added."""
    names = [f"c{i}" for i in range(len(df.columns))]
    of = dict(zip(names, df.columns, strict=True))

    def own(made: DataFrame) -> DataFrame:
        return made.select(*[F.col(c).alias(of.get(c, c)) for c in made.columns])

    return df.select(*[named(c).alias(n) for n, c in of.items()]), names, own
