"""Frame folders, videos and tables in files: readers with checks, and sinks.

Readers give DataFrames with explicit schemas; a value that breaks a contract is an error when the rows are used. Small things
that are a driver's by nature (a file's header, a manifest) are read there.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, parsing
from ..operators.runs import ranked

#: What counts as an image or a video.
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
VIDEOS = (".mp4", ".avi", ".mov", ".mkv", ".m4v", ".webm")


def paths(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """(path, length, modified) of files below ``root``; their contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select(F.col("path"), "length", F.col("modificationTime").alias("modified"))


def _kind(path: Column, suffixes: tuple[str, ...]) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return parsing.suffix(path).isin(*suffixes) & ~name.startswith(".")


def image_order() -> list[Column]:
    """Names with digits first, by their first number, then the stem; the others by name."""
    stem = parsing.stem(F.col("path"))
    number = parsing.first_number(stem)
    return [number.isNull().cast("int"), number, stem]


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder with their place in order (pos), without hidden files."""
    df = paths(spark, folder).where(_kind(F.col("path"), IMAGES))
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(F.regexp_extract("path", r"^(.*)/", 1)).orderBy(*image_order())) - 1)


def videos(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    return paths(spark, folder, recursive).where(_kind(F.col("path"), VIDEOS)).select("path").orderBy("path")


def sequences(spark: SparkSession, root: str) -> DataFrame:
    """(kind, path): all videos below ``root``, or else the folders that hold images."""
    files = paths(spark, root, True)
    found = files.where(_kind(F.col("path"), VIDEOS)).select(F.lit("video").alias("kind"), "path")
    folders = files.where(_kind(F.col("path"), IMAGES)).select(F.lit("frames").alias("kind"), F.regexp_extract("path", r"^(.*)/", 1).alias("path")).distinct()
    return folders.orderBy("path") if found.isEmpty() else found.orderBy("path")


def frame_records(spark: SparkSession, folder: str, fps: float = 30.0, pattern: str = r"(P\d+)") -> DataFrame:
    """One record for each image: 0-based frame_idx, time = idx / fps (30 if fps isn't positive), participant by path."""
    fps = fps if fps > 0 else 30.0
    df = images(spark, folder)
    return df.select(parsing.parent(F.col("path")).alias("video_id"), parsing.participant(F.col("path"), pattern).alias("participant_id"), F.col("pos").alias("frame_idx"), (F.col("pos") / fps).alias("frame_time_sec"), F.lit(fps).alias("fps"), F.col("path").alias("frame_path"))


def separator(spark: SparkSession, path: str) -> str:
    """Of comma, semicolon and tab the one that the header has most of."""
    header = spark.read.text(path).limit(1).collect()
    line = header[0][0] if header else ""
    return max((",", ";", "\t"), key=line.count)


def table(spark: SparkSession, path: str, required: tuple[str, ...] = (), sniff: bool = False) -> DataFrame:
    """A CSV file as strings, with row, which orders lines: by file name, block and line; missing columns are an error.

    Spark deals blocks to tasks by size, so that ids of tasks don't follow the files.
    """
    df = spark.read.option("header", True).option("sep", separator(spark, path) if sniff else ",").csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} lacks columns: {missing}")
    return df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("row"))


def _binary(name: str) -> Column:
    v = parsing.strict_int(name)
    return F.when(v.isin(0, 1), v.cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{name} is neither 0 nor 1: "), F.col(name).cast("string"))))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    df = table(spark, path, ("frame_id", "predicted_label"))
    return df.select(parsing.strict_int("frame_id").alias("frame_id"), _binary("predicted_label").alias("predicted_label"), "row")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    df = table(spark, path, ("frame_id", "blue_glove_detected"))
    flag = parsing.tolerant_bool(F.col("blue_glove_detected"))
    flag = F.when(flag.isNull(), F.raise_error(F.concat(F.lit("no boolean: "), F.col("blue_glove_detected")))).otherwise(flag)
    return df.select(parsing.strict_int("frame_id").alias("frame_id"), flag.alias("blue_glove_detected"), "row")


def prediction_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(video_id, predictions, metadata) for every predictions.csv below root; one without its metadata.csv is an error."""
    files = paths(spark, root, True).select("path", F.regexp_extract("path", r"^(.*)/", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    p = files.where("name = 'predictions.csv'").select("folder", F.col("path").alias("predictions"))
    m = files.where("name = 'metadata.csv'").select("folder", F.col("path").alias("metadata"))
    missing = F.when(F.col("metadata").isNull(), F.raise_error(F.concat(F.lit("no metadata.csv beside "), F.col("predictions")))).otherwise(F.col("metadata"))
    return p.join(m, "folder", "left").select(F.regexp_extract("folder", r"([^/]*)$", 1).alias("video_id"), "predictions", missing.alias("metadata"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(frame, gt) of either shape: frame_number and gt_binary, or frame_id with digits and label. Of duplicates the last wins."""
    df = table(spark, path, sniff=True)
    if {"frame_number", "gt_binary"} <= set(df.columns):
        df = df.select(parsing.strict_int("frame_number").alias("frame"), _binary("gt_binary").alias("gt"), "row")
    elif {"frame_id", "label"} <= set(df.columns):
        gt = labels.binary(F.col("label"))
        gt = F.when(gt.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null"))))).otherwise(gt)
        df = df.select(parsing.first_number(F.col("frame_id")).alias("frame"), gt.alias("gt"), "row")
    else:
        raise ValueError(f"{path} has neither frame_number and gt_binary nor frame_id and label")
    return df.groupBy("frame").agg(F.max_by("gt", "row").alias("gt"))


def truth_map(spark: SparkSession, path: str) -> DataFrame:
    """``ground_truth`` of which something is left: a table without a row with a frame is an error, as is a value that isn't binary."""
    out = ground_truth(spark, path).where("frame is not null")
    if out.isEmpty():
        raise ValueError(f"{path} gives no frame with a truth")
    return out


#: Columns that a table of datasets' scores must have.
METRICS = ("dataset_key", "status", "selected_csv", "gt_csv")


def dataset_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A table of datasets' scores: ``METRICS`` as strings, counts (n_*, tp, fp, tn, fn) as longs and other columns that hold only
    numbers as doubles; what isn't a number where others are is null. Keys and statuses that are missing are the text "nan"."""
    df = table(spark, path, METRICS).drop("row")
    rest = [c for c in df.columns if c not in (*METRICS, "error")]
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    some = df.agg(*[(F.count_if(number(c).isNotNull()) > 0).alias(f"v{i}") for i, c in enumerate(rest)]).first() if rest else []
    kinds = [(number(c).cast("bigint") if c.startswith("n_") or c in ("tp", "fp", "tn", "fn") else number(c)).alias(c) if is_number else F.col(f"`{c}`") for c, is_number in zip(rest, some, strict=True)]
    text = [F.coalesce(c, F.lit("nan")).alias(c) if c in ("dataset_key", "status") else F.col(c) for c in METRICS]
    return df.select(*text, *[F.col("error")] * ("error" in df.columns), *kinds)


def condensed(spark: SparkSession, path: str) -> DataFrame:
    """(frame, pred) of condensed detections: sorted by frame, the first of duplicates wins."""
    df = table(spark, path, ("frame_number", "contact_label"))
    return df.groupBy(parsing.strict_int("frame_number").alias("frame")).agg(F.min_by(labels.binary(F.col("contact_label"), "exact"), "row").alias("pred"))


def selected(spark: SparkSession, path: str, strict_duplicates: bool = False) -> DataFrame:
    """(frame_id, predicted_label): the first of duplicates in file order, or an error if ``strict_duplicates``."""
    df = predictions(spark, path)
    out = df.groupBy("frame_id").agg(F.min_by("predicted_label", "row").alias("predicted_label"), F.count("*").alias("n"))
    if strict_duplicates:
        out = out.withColumn("predicted_label", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate frame_id "), F.col("frame_id").cast("string")))).otherwise(F.col("predicted_label")))
    return out.drop("n")


def manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ("dataset_key",), keys: list[str] | DataFrame | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Rows of a manifest with one of ``keys`` (a few, or a frame of dataset_key) and statuses; none given restrict nothing."""
    df = table(spark, path, required)
    if isinstance(keys, DataFrame):
        df = df.join(keys.select("dataset_key"), "dataset_key", "left_semi")
    elif keys:
        df = df.where(F.col("dataset_key").isin(keys))
    if statuses and "status" in df.columns:
        df = df.where(F.col("status").isin(statuses))
    return df.drop("row").orderBy("dataset_key")


def frame_index(spark: SparkSession, folder: str) -> DataFrame:
    """(number, path): of names with one number the lowest wins."""
    df = images(spark, folder)
    return df.groupBy(parsing.first_number(parsing.stem(F.col("path"))).alias("number")).agg(F.min("path").alias("path")).where("number is not null")


Builder = Callable[[SparkSession], DataFrame]


def combined(spark: SparkSession, names: str, registry: dict[str, Builder]) -> DataFrame:
    """Datasets by name, several joined by +."""
    frames = []
    for name in names.split("+"):
        if name not in registry:
            raise KeyError(f"unknown dataset {name!r}; choices: {sorted(registry)}")
        frames.append(registry[name](spark).withColumn("dataset", F.lit(name)))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def same_tables(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> bool:
    """Whether both have the same columns and, whatever the order, the same rows; NaN equals NaN, numbers within the tolerance."""
    if sorted(left.columns) != sorted(right.columns) or left.count() != right.count():
        return False
    names = sorted(left.columns)

    def key(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        # Numbers are compared within the tolerance, so that they can't take part in the order before rounding.
        place = [F.round(F.col(c).cast("double"), 4) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in names]
        return ranked(df.select(*names), [], place, "__n")

    a, b = key(left), key(right)
    kinds = dict(left.dtypes)
    wrong = F.lit(False)
    for c in names:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        close = x.eqNullSafe(y) | (F.abs(x.cast("double") - y.cast("double")) <= tolerance) if kinds[c] in ("double", "float") else x.eqNullSafe(y)
        wrong = wrong | ~F.coalesce(close, F.lit(False))
    return a.alias("a").join(b.alias("b"), "__n").where(wrong).isEmpty()


def summary_markdown(rows: list[dict], title: str) -> str:
    """A small table as Markdown text."""
    names = list(rows[0]) if rows else []
    body = ["| " + " | ".join(str(r.get(n, "")) for n in names) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *body]) + "\n"


def to_json(value: dict) -> str:
    return json.dumps(value, indent=2, sort_keys=True)
