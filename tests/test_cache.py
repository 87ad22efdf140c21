"""Tables kept by plan, parameters and files."""

from __future__ import annotations

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holdfast.plans.cache import Cache, plan_text


def test_a_changed_file_makes_a_table_anew(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    cache, made = Cache(spark, f"{tmp_path}/cache"), []

    def build(factor=2):
        made.append(1)
        call = len(made)

        def stamped(batches):  # what a Python function does is no part of the plan: the number of the call shows what was made anew
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([call] * b.num_rows, pa.int64())], names=["v", "u"])

        return spark.read.parquet(f"{tmp_path}/in").select((F.col("id") * factor).alias("v")).mapInArrow(stamped, "v long, u long")

    def rows(factor=2, **parameters):
        return sorted((r.v, r.u) for r in cache.get("t", lambda: build(factor), **parameters).collect())

    first = rows()
    assert [v for v, _ in first] == [0, 2, 4, 6, 8] and rows() == first
    assert len(os.listdir(f"{tmp_path}/cache/t")) == 1
    other = rows(version=2)
    assert other != first and rows(version=2) == other and len(os.listdir(f"{tmp_path}/cache/t")) == 1
    assert [v for v, _ in rows(3)] == [0, 3, 6, 9, 12]
    again = rows()
    time.sleep(0.01)
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert len(rows()) == 6 and rows() != again
    os.utime(next(f"{tmp_path}/in/{f}" for f in os.listdir(f"{tmp_path}/in") if f.startswith("part")), (1, 1))
    before = rows()
    assert rows() == before
    os.utime(next(f"{tmp_path}/in/{f}" for f in os.listdir(f"{tmp_path}/in") if f.startswith("part")), (2, 2))
    assert rows() != before
    cache.clear("t")
    assert not os.path.exists(f"{tmp_path}/cache/t")
    with pytest.raises(ValueError, match="name"):
        cache.get("../t", build)


def test_half_written_tables_are_not_read(spark, tmp_path):
    cache = Cache(spark, f"{tmp_path}/cache")
    with pytest.raises(Exception, match="broken"):
        cache.get("t", lambda: spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id")), inputs=[])
    assert not [f for f in os.listdir(f"{tmp_path}/cache/t") if not f.startswith(".")] if os.path.exists(f"{tmp_path}/cache/t") else True
    assert cache.get("t", lambda: spark.range(3), inputs=[]).count() == 3
    assert plan_text(spark.range(3).select(F.col("id") + 1)) == plan_text(spark.range(3).select(F.col("id") + 1)) != plan_text(spark.range(3).select(F.col("id") + 2))
