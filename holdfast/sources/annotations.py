"""Annotation formats: VOC XML and result lines, COCO JSON, scene graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The leaves of a VOC object with hand and contact fields, and how magnitudes are scaled.
_HAND = ("contactstate", "handside", "magnitude", "unitdx", "unitdy", "objxmin", "objymin", "objxmax", "objymax")
MAGNITUDE = 0.001
_OBJECT = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("difficult", T.StringType()), T.StructField("bndbox", T.StructType([T.StructField(k, T.StringType()) for k in ("xmin", "ymin", "xmax", "ymax")]))] + [T.StructField(k, T.StringType()) for k in _HAND]
)


def _number(name: str) -> Column:
    """Missing or "None" is 0."""
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def voc_objects(spark: SparkSession, path: str) -> DataFrame:
    """One row for each object of VOC XML files: image, place in no particular order, 0-based box clamped at 0, hand fields."""
    df = spark.read.format("xml").option("rowTag", "object").schema(_OBJECT).load(path).withColumn("image", F.regexp_extract(F.input_file_name(), r"([^/]*)\.xml$", 1))
    side = lambda k: F.greatest(F.lit(0.0), _number(f"bndbox.{k}") - 1)
    linked = [F.col(f"obj{k}").try_cast("double").alias(f"obj_{k}") for k in ("xmin", "ymin", "xmax", "ymax")]
    return df.select("image", F.lower(F.trim("name")).alias("name"), (_number("difficult") == 1).alias("difficult"), *[side(k).alias(f"bbox_{v}") for k, v in zip(("xmin", "ymin", "xmax", "ymax"), ("x1", "y1", "x2", "y2"), strict=True)],
        *[_number(k).alias(k) for k in ("contactstate", "handside", "unitdx", "unitdy")], (_number("magnitude") * MAGNITUDE).alias("magnitude"), *linked)


def result_lines(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Detections as lines "image score x1 y1 x2 y2 ..." with 1-based corners."""
    corners = [F.format_string("%.1f", F.col(f"bbox_{k}").cast("double") + 1) for k in ("x1", "y1", "x2", "y2")]
    return df.select(F.concat_ws(" ", F.col("image"), F.format_string("%.3f", F.col("score").cast("double")), *corners, *[F.col(c).cast("string") for c in extra]).alias("value"))


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    names = ("score", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    return spark.read.text(path).select(F.get(parts, 0).alias("image"), *[(F.get(parts, i).cast("double") - (1 if i > 1 else 0)).alias(n) for i, n in enumerate(names, 1)], F.slice(parts, 7, 100).alias("rest"))


_COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:bigint,name:string,supercategory:string>>"


def coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables images, annotations and categories of a COCO file."""
    df = spark.read.schema(_COCO).option("multiLine", True).json(path)
    return {k: df.select(F.explode(k).alias("x")).select("x.*") for k in ("images", "annotations", "categories")}


def coco_results(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """Results with derived area, id and iscrowd; an image that the dataset doesn't have is an error."""
    df = spark.read.schema("image_id bigint, category_id bigint, bbox array<double>, score double").option("multiLine", True).json(path)
    strange = df.join(images, df.image_id == images.id, "left_anti").limit(1).collect()
    if strange:
        raise ValueError(f"results name image {strange[0].image_id}, which isn't in the dataset")
    return df.select("*", (F.get("bbox", 2) * F.get("bbox", 3)).alias("area"), (F.monotonically_increasing_id() + 1).alias("id"), F.lit(0).alias("iscrowd"))


def write_coco(images: DataFrame, annotations: DataFrame, category: str, path: str, most: int = 100_000) -> None:
    """JSON documents of each split, below ``path``/split=...: one for each ``most`` image ids, so that none, and no task, holds a
    whole large split. Each has its images' annotations; ``coco`` reads a folder of them as one dataset. A null split is one."""
    shard = F.floor((F.col("image_id") - 1) / most).alias("shard")
    i = images.groupBy("split", shard).agg(F.array_sort(F.collect_list(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height"))).alias("images"))
    a = annotations.groupBy(F.col("split").alias("of"), shard.alias("of_shard")).agg(F.array_sort(F.collect_list(F.struct(F.col("annotation_id").alias("id"), "image_id", "category_id", "bbox", "area", "iscrowd"))).alias("annotations"))
    both = i.join(a, i["split"].eqNullSafe(a["of"]) & (i["shard"] == a["of_shard"]), "left")
    doc = F.to_json(F.struct("images", F.coalesce("annotations", F.expr("slice(annotations, 1, 0)")).alias("annotations"), F.array(F.struct(F.lit(1).alias("id"), F.lit(category).alias("name"))).alias("categories")))
    both.select("split", doc.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("split").text(path)


def scene_graphs(spark: SparkSession, path: str, attributes: int = 16) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of scene-graph JSON: boxes with a class and at most ``attributes`` attributes; distinct edges between known nodes."""
    schema = "image_id bigint, objects array<struct<object_id:bigint,names:array<string>,attributes:array<string>,x:int,y:int,w:int,h:int>>, relationships array<struct<subject_id:bigint,predicate:string,object_id:bigint>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    nodes = df.select("image_id", F.explode("objects").alias("o")).select("image_id", F.col("o.object_id").alias("node_id"), F.get("o.names", 0).alias("name"), F.slice(F.coalesce("o.attributes", F.array().cast("array<string>")), 1, attributes).alias("attributes"), "o.x", "o.y", "o.w", "o.h")
    edges = df.select("image_id", F.explode("relationships").alias("r")).select("image_id", F.col("r.subject_id").alias("subject"), F.lower(F.trim("r.predicate")).alias("predicate"), F.col("r.object_id").alias("object"))
    from ..operators.dataset import scene_edges

    return nodes, scene_edges(edges, nodes)
