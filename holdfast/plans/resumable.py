"""Workflows over many datasets that go on where they stopped: a manifest says which stage of which dataset is done.

A stage runs for all datasets that it is due for in one plan. It writes into a folder of its own attempt; only then does a new
version of the manifest, put in place by one rename, name that folder. A run that is killed leaves at most a folder that nothing
names. If a stage fails, its datasets are halved and tried apart until what fails is known: those rows say why, and the others go on.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.tracking import BridgeConfig
from ..staging import again
from . import batch
from . import workflow as w

MANIFEST = "stage string, dataset_key string, status string, error string, attempt string, n_rows bigint, started timestamp, ended timestamp"

#: Named configurations of ``workflow.contact_labels``.
PROFILES = {
    "default": w.PipelineConfig(),
    "baseline": w.PipelineConfig(object_size=None, smaller_factor=None),
    "tracking": w.PipelineConfig(object_size=None, smaller_factor=None, bridge=BridgeConfig()),
}


def profile(name: str, **changes: object) -> w.PipelineConfig:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; choices: {sorted(PROFILES)}")
    return replace(PROFILES[name], **changes)


#: What a stage does: from the datasets that are due (dataset_key) and a function that reads an earlier stage's rows of them, its
#: rows, with dataset_key.
Work = Callable[[DataFrame, Callable[[str], DataFrame]], DataFrame]


@dataclass(frozen=True)
class Stage:
    """``needs`` are stages that must have succeeded for a dataset; a dataset for which ``work`` has no rows fails with ``nothing``."""

    name: str
    work: Work
    needs: tuple[str, ...] = ()
    nothing: str = "no rows"


class Workflow:
    """Stages in order, below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, stages: list[Stage]) -> None:
        self.spark, self.root, self.stages = spark, root.rstrip("/"), stages
        names = [s.name for s in stages]
        if len(set(names)) < len(names) or any(n not in names[:i] for i, s in enumerate(stages) for n in s.needs):
            raise ValueError("stages need names of their own, and may only need stages before them")

    # The manifest: folders v00000001, v00000002, ...; the last one counts.

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, fs = self._fs()
        at = path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def manifest(self) -> DataFrame:
        """MANIFEST: what became of each stage of each dataset, at last."""
        versions = self._versions()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{versions[-1]:08d}") if versions else self.spark.createDataFrame([], MANIFEST)

    def _record(self, rows: DataFrame) -> None:
        """A new version of the manifest with ``rows`` in place of those of the same stages and datasets."""
        path, fs = self._fs()
        versions = self._versions()
        old = self.manifest().join(rows.select("stage", "dataset_key"), ["stage", "dataset_key"], "left_anti")
        written = f"{self.root}/manifest/.writing-{uuid.uuid4().hex}"
        old.select(rows.columns).unionByName(rows).repartition(1 + rows.count() // 1_000_000).write.parquet(written)
        at = path(f"{self.root}/manifest/v{(versions[-1] if versions else 0) + 1:08d}")
        if fs.exists(at) or not fs.rename(path(written), at):
            raise RuntimeError(f"another run has written {at}")
        for v in versions[:-1]:  # the version before stays: a reader may hold it
            fs.delete(path(f"{self.root}/manifest/v{v:08d}"), True)

    def output(self, stage: str) -> DataFrame:
        """The rows of a stage that succeeded: of each dataset those of the attempt that the manifest names."""
        done = self.manifest().where((F.col("stage") == stage) & (F.col("status") == "success")).select("dataset_key", "attempt")
        read = self.spark.read.option("basePath", f"{self.root}/{stage}").parquet(f"{self.root}/{stage}")
        return read.join(done, ["dataset_key", "attempt"], "left_semi").drop("attempt")

    def run(self, keys: DataFrame, recompute: bool = False) -> DataFrame:
        """Run what is due for the datasets ``keys`` (dataset_key), and give the manifest of these.

        What succeeded before isn't done again unless ``recompute``; what failed is. A dataset whose needed stage failed is left
        out of the stages that need it, and has no rows for them.
        """
        keys = keys.select(F.col("dataset_key").cast("string")).where("dataset_key is not null").distinct()
        for stage in self.stages:
            known = self.manifest().where("status = 'success'").select("stage", "dataset_key")
            due = keys
            for need in stage.needs:
                due = due.join(known.where(F.col("stage") == need), "dataset_key", "left_semi")
            if not recompute:
                due = due.join(known.where(F.col("stage") == stage.name), "dataset_key", "left_anti")
            due = self._fixed(due)
            if not due.isEmpty():
                self._attempt(stage, due)
        return self.manifest().join(keys, "dataset_key", "left_semi")

    def _fixed(self, keys: DataFrame) -> DataFrame:
        """The keys as they are now: written, as the manifest that they come from is replaced meanwhile."""
        path = f"{self.root}/.due/{uuid.uuid4().hex}"
        keys.write.parquet(path)
        out = self.spark.read.schema("dataset_key string").parquet(path)
        out._staged_at = path
        return again(out, self.spark)

    def _attempt(self, stage: Stage, keys: DataFrame, halving: int = 0) -> None:
        attempt, began = uuid.uuid4().hex, datetime.datetime.now()
        out = f"{self.root}/{stage.name}/attempt={attempt}"

        def earlier(name: str) -> DataFrame:
            return self.output(name).join(keys, "dataset_key", "left_semi")

        try:
            stage.work(keys, earlier).write.parquet(out)
            found = self.spark.read.parquet(out).groupBy("dataset_key").agg(F.count("*").alias("n_rows"))
            result = keys.join(found, "dataset_key", "left")
            ok = F.col("n_rows").isNotNull()
            rows = result.select("dataset_key", F.when(ok, "success").otherwise("failed").alias("status"), F.when(~ok, stage.nothing).alias("error"), F.when(ok, attempt).alias("attempt"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        except Exception as e:
            path, fs = self._fs()
            fs.delete(path(out), True)
            if keys.count() > 1:
                side = F.pmod(F.xxhash64("dataset_key", F.lit(halving)), F.lit(2))
                for half in (0, 1):
                    part = self._fixed(keys.where(side == half))
                    if not part.isEmpty():
                        self._attempt(stage, part, halving + 1)
                return
            said = str(e).strip().split("\n")[0][:1000]
            rows = keys.select("dataset_key", F.lit("failed").alias("status"), F.lit(f"{type(e).__name__}: {said}").alias("error"), F.lit(None).cast("string").alias("attempt"), F.lit(0).cast("bigint").alias("n_rows"))
        times = [F.lit(t).cast("timestamp").alias(n) for n, t in (("started", began), ("ended", datetime.datetime.now()))]
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        self._record(rows.select(F.lit(stage.name).alias("stage"), "*", *times).select(names))


def contact_workflow(spark: SparkSession, detections: str, truth: DataFrame, root: str, frame_size: tuple[int, int], chosen: w.PipelineConfig = PROFILES["baseline"], folder: str = "{}") -> Workflow:
    """Detections of datasets (below ``detections``, each in the ``folder`` of its key) to labels, and labels against ``truth`` (dataset_key, frame, gt).

    Stages: ``labels`` (a row for each frame) and ``metrics`` (a row for each dataset, over frames that both have).
    """

    def labels(keys: DataFrame, _: Callable[[str], DataFrame]) -> DataFrame:
        # Each dataset is a folder: only those that are due are read.
        folders = [f"{detections.rstrip('/')}/{folder.format(r.dataset_key)}" for r in keys.toLocalIterator()]
        return batch.labelled(batch.detections(spark, folders), frame_size, chosen)

    def scores(keys: DataFrame, earlier: Callable[[str], DataFrame]) -> DataFrame:
        p = earlier("labels").groupBy("dataset_key", F.col("frame_number").alias("frame")).agg(F.min_by(w.as_binary("contact_label"), "frame_id").alias("pred"))
        return batch.intersection_metrics(p, truth, ["dataset_key"], "frame")

    return Workflow(spark, root, [Stage("labels", labels, nothing="no detections"), Stage("metrics", scores, ("labels",), "labels and truth share no frame")])


def summary(flow: Workflow) -> DataFrame:
    """The scores of all datasets that have some, and below them their mean and their mean by frames."""
    scores = flow.output("metrics").withColumnRenamed("dataset_key", "dataset")
    rates = [c for c in scores.columns if c == "accuracy" or c == "edit" or c.startswith("f1_")]
    return metrics.batch_summary(scores, "dataset", rates, ["tp", "fp", "tn", "fn"], "n_common")
