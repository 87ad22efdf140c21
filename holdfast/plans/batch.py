"""Runs over many datasets as one DataFrame each: detections of a folder to labels, manifests, evaluation and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, parsing
from ..operators import metrics
from ..sources import files
from ..sources.detector import Detector
from ..sources.detector import detect as run_detector
from ..staging import staged
from . import workflow as w

#: The types of a full table of detections in CSV.
FULL = (
    "video_id bigint, frame_number bigint, frame_id string, row_id bigint, detection_type string, bbox_x1 bigint, bbox_y1 bigint, bbox_x2 bigint, bbox_y2 bigint, confidence double, contact_state int, contact_label string,"
    " hand_side string, offset_x double, offset_y double, offset_mag double, blue_prop double, blue_glove_status string, is_filtered boolean"
)


#: Columns that a table of detections must have; others may be absent.
MUST = ("frame_id", "detection_type", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")


#: Orders of columns that a plan spells out; with more, each row looks up its own file's.
LAYOUTS = 16


def detections(spark: SparkSession, root: str | list[str], chosen: Callable[[Column], Column] | None = None) -> DataFrame:
    """FULL rows of every detections_full.csv below ``root`` (a folder or several), with the folder's name as dataset_key.

    Such a file is one of that name, or a part that Spark wrote into a folder of that name or into dataset_key=...; others aren't
    read. Each file's own header says where its columns stand. Absent ones are null, but for video_id (0), frame_number (the
    first number in frame_id), row_id (the place in its frame, in the file's order) and is_filtered (false). Other columns are
    left out. A file without one of ``MUST``, and a value that isn't of its column's type, are errors.

    ``chosen`` says by dataset_key which datasets are wanted: the files of others are neither opened nor checked.
    """
    named = r"/(?:dataset_key=)?([^/]+?)(?:/detections_full\.csv)?/[^/]*$"
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    # Of the file's path alone, and right above the scan: Spark leaves out files by it.
    ours = F.rlike(path, F.lit(r"/detections_full\.csv$|/detections_full\.csv/part-[^/]*$|/dataset_key=[^/]*/part-[^/]*$"))
    wanted = ours if chosen is None else ours & chosen(F.regexp_extract(path, named, 1))
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{detections_full,part-*}.csv")
    at = [path.alias("path"), start.alias("start"), F.monotonically_increasing_id().alias("line")]
    text = reader.text(root)
    header = text.where(wanted).where(start == 0).select("value", *at).groupBy("path").agg(F.min_by("value", "line").alias("h"))
    names = F.transform(F.split(F.regexp_replace("h", "^\ufeff", ""), ","), lambda n: F.btrim(n, F.lit("\" \t\r")))
    headers = staged(header.select("path", names.alias("names")), "headers")
    missing = F.filter(F.array(*map(F.lit, MUST)), lambda n: ~F.array_contains("names", n))
    wide, bare, bad = headers.agg(F.max(F.size("names")), F.bool_or(~F.array_contains("names", "row_id")), F.min(F.when(F.size(missing) > 0, F.struct("path", missing.alias("missing"))))).first()
    if not wide and (chosen is None or text.where(ours).isEmpty()):
        raise FileNotFoundError(f"no detections_full.csv below {root}")
    if bad:
        raise ValueError(f"{bad.path} lacks columns: {bad.missing}")
    cells = [f"c{i}" for i in range(wide or 1)]
    rows = reader.schema(", ".join(f"{c} string" for c in cells)).csv(root).where(wanted).select(*cells, *(at if bare else at[:1]))
    layouts = [r.names for r in headers.select("names").distinct().limit(LAYOUTS + 1).collect()]
    if len(layouts) > LAYOUTS:
        rows = rows.join(headers, "path").withColumn("cells", F.array(*cells))
        first, filterable = F.get("names", F.lit(0)), F.array_contains("names", "is_filtered")

        def cell(name: str) -> Column:
            return F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1)

    else:
        if len(layouts) > 1:
            of = F.coalesce(*[F.when(F.col("names") == F.array(*map(F.lit, n)), i) for i, n in enumerate(layouts)])
            rows = rows.join(headers.select("path", of.alias("layout")), "path")

        def by_layout(values: list[Column]) -> Column:
            return values[0] if len(values) == 1 else F.coalesce(*[F.when(F.col("layout") == i, v) for i, v in enumerate(values)])

        def cell(name: str) -> Column:
            return by_layout([F.col(f"c{n.index(name)}") if name in n else F.lit(None).cast("string") for n in layouts] or [F.lit(None).cast("string")])

        first, filterable = (by_layout([F.lit(x) for x in values]) for values in ([n[0] for n in layouts] or [""], ["is_filtered" in n for n in layouts] or [False]))
    rows = rows.where(~(F.col("c0").eqNullSafe(first) & cell("detection_type").eqNullSafe("detection_type")))

    def typed(name: str, kind: str) -> Column:
        value = cell(name)
        number = value.try_cast("double")
        out = F.when(value.isNotNull(), parsing.tolerant_bool(value)) if kind == "boolean" else value if kind == "string" else number if kind == "double" else F.when(number == F.floor(number), number.cast(kind))
        return F.when(value.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit(f"{name} holds no {kind}: "), value))).otherwise(out)

    out = {name: typed(name, kind) for name, kind in (c.split() for c in FULL.split(", "))}
    out["video_id"] = F.coalesce(out["video_id"], F.lit(0).cast("bigint"))
    out["is_filtered"] = F.when(filterable, out["is_filtered"]).otherwise(False)
    out["frame_number"] = F.coalesce(out["frame_number"], parsing.first_number(out["frame_id"]))
    found = rows.select(*[c.alias(n) for n, c in out.items()], F.regexp_extract("path", named, 1).alias("dataset_key"), *(["path", "start", "line"] if bare else []))
    if bare:
        nth = F.row_number().over(Window.partitionBy("path", "video_id", "frame_number", "frame_id").orderBy("start", "line"))
        found = found.withColumn("row_id", F.coalesce("row_id", nth.cast("bigint")))
    return found.drop("path", "start", "line")


def full_table(found: DataFrame, frames: DataFrame) -> DataFrame:
    """FULL rows of what a detector found (``sources.detector.DETECTIONS``) in frames (path, frame_number), as one video.

    A frame's rows are numbered by type, box and confidence; labels follow from states and sides.
    """
    box = [F.col(f"bbox_{k}").cast("bigint").alias(f"bbox_{k}") for k in ("x1", "y1", "x2", "y2")]
    by = Window.partitionBy("path").orderBy("detection_type", *[f"bbox_{k}" for k in ("x1", "y1", "x2", "y2")], "confidence")
    rows = found.join(frames.select("path", "frame_number"), "path")
    hand = F.col("detection_type") == "hand"
    return rows.select(
        F.lit(0).cast("bigint").alias("video_id"), F.col("frame_number").cast("bigint").alias("frame_number"), F.regexp_extract("path", r"([^/]*)$", 1).alias("frame_id"), F.row_number().over(by).cast("bigint").alias("row_id"), "detection_type", *box, "confidence",
        F.when(hand, F.col("contact_state")).alias("contact_state"), F.when(hand, labels.state_label(F.col("contact_state"))).alias("contact_label"), F.when(hand, labels.side_label(F.col("hand_side"))).alias("hand_side"),
        "offset_x", "offset_y", "offset_mag", "blue_prop", F.lit("NA").alias("blue_glove_status"), F.lit(False).alias("is_filtered"),
    )


def detect(spark: SparkSession, folder: str, out: str, factory: Callable[[], Detector], dataset: str) -> None:
    """The detections of a folder's images as CSV below ``out``, as ``postprocess`` reads them. The detector is made once for each task."""
    ordered = files.images(spark, folder).select("path", (F.col("pos") + 1).alias("frame_number"))
    content = spark.read.format("binaryFile").load(folder).select("path", "content").join(ordered.select("path"), "path", "left_semi")
    rows = full_table(run_detector(content, factory), ordered).withColumn("dataset_key", F.lit(dataset))
    rows.sortWithinPartitions(*detection_order()).write.mode("append").option("header", True).partitionBy("dataset_key").csv(out)


def detection_order() -> list[Column]:
    """The order of a full table: frame, type, box, confidence; row_id tells rows apart."""
    return [F.col(c) for c in ("frame_number", "detection_type", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "confidence", "row_id")]


def done_keys(spark: SparkSession, out: str) -> list[str]:
    """The datasets that ``out`` already has; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(n.removeprefix("dataset_key=") for n in names if n.startswith("dataset_key="))


def labelled(df: DataFrame, frame_size: tuple[int, int], config: w.PipelineConfig) -> DataFrame:
    """Labels (dataset_key, video_id, frame_number, frame_id, contact_label, source_hand) of detections of many datasets, in one plan."""
    # Videos of two datasets may share numbers: the filters' key is a text of both, from which both are read again.
    kinds = df.schema
    both = F.concat(F.coalesce(F.col("video_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.concat(F.lit("="), F.col("dataset_key")), F.lit("")))
    found = w.contact_labels(df.withColumn("video_id", both), (F.lit(frame_size[0]), F.lit(frame_size[1])), config)
    at = F.locate("/", "video_id")
    video = F.when(at > 1, F.substring("video_id", F.lit(1), at - 1)).cast(kinds["video_id"].dataType)
    dataset = F.when(at < F.length("video_id"), F.substring("video_id", at + 2, F.length("video_id")))
    return found.select(dataset.alias("dataset_key"), video.alias("video_id"), "frame_number", "frame_id", "contact_label", "source_hand")


def postprocess(spark: SparkSession, root: str, out: str, frame_size: tuple[int, int], config: w.PipelineConfig = w.PipelineConfig(), keys: list[str] | None = None, skip_existing: bool = False) -> None:
    """Labels of all datasets below ``root`` (or of ``keys``) in one plan, written as CSV by dataset; those already there can be skipped."""
    done = done_keys(spark, out) if skip_existing else []

    def due(key: Column) -> Column:
        return (key.isin(keys) if keys else F.lit(True)) & (~key.isin(done) if done else F.lit(True))

    joined = labelled(detections(spark, root, due if keys or done else None), frame_size, config)
    writer = joined.repartition("dataset_key", "video_id").sortWithinPartitions("dataset_key", "video_id", "frame_number", "frame_id").write
    writer.mode("append" if skip_existing else "overwrite").option("header", True).partitionBy("dataset_key").csv(out)


def evaluation_manifest(runs: DataFrame, truths: DataFrame) -> DataFrame:
    """(dataset_key, selected_csv, gt_csv, status) of runs (dataset_key, selected_csv) and truths (dataset_key, gt_csv): what lacks a file is missing_gt."""
    both = runs.select("dataset_key", "selected_csv").join(truths.select("dataset_key", "gt_csv"), "dataset_key", "left")
    return both.withColumn("status", F.when(F.col("gt_csv").isNull(), "missing_gt").otherwise("ready"))


def run_summary(diagnostics: DataFrame, mismatches: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: how many datasets there are, succeeded and failed; mismatched and missing frames; errors and mean accuracy of those that succeeded."""
    ok = F.col("status") == "success"
    sums = [F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("bigint").alias(f"{c}_total") for c in ("fp", "fn")]
    out = diagnostics.agg(F.count("*").alias("n_datasets_total"), F.count_if(ok).alias("n_datasets_success"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_datasets_failed"), *sums, F.avg(F.when(ok, F.col("accuracy"))).alias("mean_accuracy_success"))
    for name, df in (("n_frame_mismatches", mismatches), ("n_selected_missing_gt_rows", missing)):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return out


def intersection_metrics(predictions: DataFrame, truth: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per dataset the scores over frames that both have, with the frames' range; a dataset without any isn't there."""
    both = predictions.join(truth, [*keys, order]).select(*keys, order, "pred", "gt")
    span = both.groupBy(*keys).agg(F.min(order).alias("frame_min"), F.max(order).alias("frame_max"), F.count("*").alias("n_common"))
    return metrics.evaluate(both, keys, order, (0.1, 0.25, 0.5, 0.75)).join(span, keys)


def resolve(spark: SparkSession, condensed: str | None = None, gt: str | None = None, root: str | None = None, key: str | None = None) -> tuple[str, str]:
    """Paths of a dataset's condensed labels and truth: given as they are, or looked up in a run's folder and its manifest by the key."""
    by_key = bool(root and key)
    if bool(condensed) == by_key:
        raise ValueError("give either the condensed labels' path, or a run's folder and a dataset's key")
    found = condensed or f"{root}/predictions/{key}/detections_condensed.csv"
    if not gt:
        if not by_key:
            raise ValueError("the truth is needed: give its path, or a run's folder and a dataset's key")
        rows = files.table(spark, f"{root}/run_manifest.csv", ("dataset_key", "gt_csv")).where(F.col("dataset_key") == key).select("gt_csv").limit(1).collect()
        if not rows or not rows[0][0]:
            raise ValueError(f"the manifest of {root} has no truth for {key!r}")
        gt = rows[0][0]
    for path in (found, gt):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(path)
    return found, gt
