"""Command line: ``python -m holdfast MODE ...``. Modes: preprocess (videos to images), detect (with a detector
that is imported by name), postprocess, workflow (labels and scores of many datasets, resumed where it stopped), evaluate."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import parsing
from .plans import batch, config, resumable, workflow
from .sources import files, frames


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("holdfast")
    modes = p.add_subparsers(dest="mode", required=True)
    pre = modes.add_parser("preprocess", help="frames of a video, or of a folder of videos, to images")
    pre.add_argument("input")
    pre.add_argument("--output")
    pre.add_argument("--codec", help="module:opener; AVI files of images without")
    pre.add_argument("--fps", type=float, default=30.0, help="where a video has no rate")
    pre.add_argument("--extension", default="png")
    flow = modes.add_parser("workflow", help="detections of datasets below a folder to labels and scores")
    flow.add_argument("input")
    flow.add_argument("--output")
    flow.add_argument("--truth", required=True, help="folder of <dataset>.csv with frame_number and gt_binary")
    flow.add_argument("--profile", default="baseline", choices=sorted(resumable.PROFILES))
    flow.add_argument("--keys", nargs="*", help="all with a truth without")
    flow.add_argument("--frame-size", nargs=2, type=int, default=(1920, 1080))
    flow.add_argument("--recompute", action="store_true")
    det = modes.add_parser("detect", help="images of a folder to detections, by a detector")
    det.add_argument("input")
    det.add_argument("--output")
    det.add_argument("--detector", required=True, help="module:factory; the factory gives a function from an image's bytes to rows")
    det.add_argument("--key", required=True, help="the dataset's key")
    det.add_argument("--skip-existing", action="store_true")
    post = modes.add_parser("postprocess", help="detections of datasets below a folder to labels")
    post.add_argument("input")
    post.add_argument("--output")
    post.add_argument("--config")
    post.add_argument("--set", nargs="*", default=[], help="key value pairs that override the configuration")
    post.add_argument("--keys", nargs="*")
    post.add_argument("--frame-size", nargs=2, type=int, default=(1920, 1080))
    post.add_argument("--skip-existing", action="store_true")
    ev = modes.add_parser("evaluate", help="labels of one dataset against its truth")
    for name in ("--condensed", "--gt", "--root", "--key"):
        ev.add_argument(name)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("holdfast").getOrCreate()
    if a.mode == "preprocess":
        out = config.output_dir(a.output, a.input, "frames")
        frames.write(frames.read(spark, a.input, default_fps=a.fps, **({"codec": a.codec} if a.codec else {})), out, extension=a.extension)
        print(out)
        return 0
    if a.mode == "workflow":
        out = config.output_dir(a.output, a.input, "workflow")
        rows = files.table(spark, a.truth, ("frame_number", "gt_binary"))
        truth = rows.select(F.regexp_extract("row.file_path", r"([^/]+)\.csv$", 1).alias("dataset_key"), parsing.strict_int("frame_number").alias("frame"), parsing.strict_int("gt_binary").cast("int").alias("gt"))
        keys = spark.createDataFrame([(k,) for k in a.keys], "dataset_key string") if a.keys else truth.select("dataset_key")
        run = resumable.contact_workflow(spark, a.input, truth, out, tuple(a.frame_size), resumable.profile(a.profile))
        failed = run.run(keys, a.recompute).where("status = 'failed'").orderBy("dataset_key", "stage").limit(20).collect()
        for r in failed:
            print(f"{r.dataset_key}: {r.stage}: {r.error}", file=sys.stderr)
        print(out)
        return 1 if failed else 0
    if a.mode == "detect":
        module, _, name = a.detector.partition(":")
        out = config.output_dir(a.output, a.input, "detections")
        if not (a.skip_existing and a.key in batch.done_keys(spark, out)):
            batch.detect(spark, a.input, out, getattr(importlib.import_module(module), name), a.key)
        print(out)
        return 0
    if a.mode == "postprocess":
        plain = config.load(workflow.PipelineConfig, a.config) if a.config else workflow.PipelineConfig()
        chosen = config.from_dict(workflow.PipelineConfig, config.overridden(config.to_dict(plain), a.set))
        out = config.output_dir(a.output, a.input)
        batch.postprocess(spark, a.input, out, tuple(a.frame_size), chosen, a.keys, a.skip_existing)
        print(out)
        return 0
    labels, truth = batch.resolve(spark, a.condensed, a.gt, a.root, a.key)
    p = files.condensed(spark, labels).select(F.lit(1).alias("dataset"), "frame", "pred")
    g = files.ground_truth(spark, truth).select(F.lit(1).alias("dataset"), "frame", "gt")
    rows = [r.asDict() for r in batch.intersection_metrics(p, g, ["dataset"], "frame").collect()]  # one dataset
    if not rows:
        print("labels and truth share no frame", file=sys.stderr)
        return 1
    print(json.dumps(rows[0], indent=2, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
