"""Tables that a plan writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is set, a session of one JVM gets a temporary folder; on a cluster that is an error, as each executor would
    write to its own disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="holdfast-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/staged/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    The files are removed when the JVM ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def again(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A staged frame read by another session."""
    out = spark.read.schema(df.schema).parquet(df._staged_at)
    out._staged_at = df._staged_at
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of staged frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def place_in_files(df: DataFrame) -> Column | None:
    """A struct (file, place) that tells rows of ``df`` apart however often it is read; None unless ``df`` is a table of Parquet files as it is read."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "_metadata" in df.columns or not plan.toString().rstrip().endswith("parquet"):
        return None
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
