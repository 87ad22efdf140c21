"""Tables kept by what they are made of: the plan, parameters, and the names, sizes and times of input files.

A table that was kept for the same of these is read; a changed file, parameter or plan makes it anew, and older ones of its name go.
What a Python function in a plan does isn't seen: give a version as a parameter where it changes.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plan_text(df: DataFrame) -> str:
    """The analysed plan and schema, with the numbers of attributes, which differ from run to run, in order of appearance."""
    seen: dict[str, str] = {}
    text = df._jdf.queryExecution().analyzed().toString()
    return re.sub(r"#\d+L?", lambda m: seen.setdefault(m[0].rstrip("L"), f"#{len(seen)}"), text) + df.schema.json()


def files_state(spark: SparkSession, paths: list[str]) -> list[str]:
    """Of each folder or file the number of files below it, and sums over hashes of their names, sizes and times. No content is read."""
    out = []
    for path in paths:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
        # The sum of hashes doesn't depend on the order, and, unlike an exclusive or, isn't undone by a pair of equal ones.
        r = found.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s"), F.sum("length").alias("size")).first()
        out.append(f"{path} {r.n} {r.s} {r['size']}")
    return out


def read_folders(df: DataFrame) -> list[str]:
    """The folders that the plan's files lie in."""
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


class Cache:
    """Tables below ``folder``, which all executors share: <name>/<key>."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def key(self, df: DataFrame, inputs: list[str] | None = None, **parameters: object) -> str:
        parts = {"plan": plan_text(df), "files": files_state(self.spark, read_folders(df) if inputs is None else inputs), "parameters": parameters}
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=repr).encode()).hexdigest()[:32]

    def get(self, name: str, make: Callable[[], DataFrame], inputs: list[str] | None = None, **parameters: object) -> DataFrame:
        """What ``make`` gives, from the cache if it is there.

        ``inputs`` are the folders whose files count, by default those that the plan reads; what ``make`` stages on the way isn't
        an input, so name them where it does. A table is written aside and put in place by a rename: one that is half written is
        never read, and of two that make it at once one wins.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise ValueError(f"{name!r} can't name a table")
        df = make()
        path, fs = self._fs()
        at = f"{self.folder}/{name}/{self.key(df, inputs, **parameters)}"
        if not fs.exists(path(at)):
            written = f"{self.folder}/{name}/.writing-{uuid.uuid4().hex}"
            df.write.parquet(written)
            if fs.exists(path(at)) or not fs.rename(path(written), path(at)):
                fs.delete(path(written), True)
            self._forget(name, at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _forget(self, name: str, but: str) -> None:
        path, fs = self._fs()
        for status in fs.listStatus(path(f"{self.folder}/{name}")):
            own = status.getPath().getName()
            if not own.startswith(".") and own != but.rsplit("/", 1)[1]:
                fs.delete(status.getPath(), True)

    def clear(self, name: str) -> None:
        path, fs = self._fs()
        fs.delete(path(f"{self.folder}/{name}"), True)
