"""Queries that write files in the shared folder and read them back through the sources, and functions that nothing else asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, masks, parsing
from ..operators import dataset, filters
from ..operators.runs import ranked
from ..plans import batch
from ..sources import annotations, files
from ..staging import scratch
from ..testdata import DET, GT, SEQ, cte
from .detections import det
from .registry import query
from .sequences import seq

_D, _S = cte(det=DET), cte(seq=SEQ)


def _csv(df: DataFrame, tag: str) -> str:
    path = scratch(df.sparkSession, tag)
    files.write_csv(df, path)
    return path


@query(f"{_S} select video_id * 100000 + pos as frame_id, pred as predicted_label from seq")
def predictions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv(seq(spark, sf_dir).select((F.col("video_id") * 100_000 + F.col("pos")).alias("frame_id"), F.col("pred").alias("predicted_label")), "predictions")
    return files.predictions(spark, path).select("frame_id", "predicted_label")


@query(f"{_S} select video_id * 100000 + pos as frame_id, case when pos % 3 = 2 then false else blue end as blue_glove_detected from seq")
def metadata_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as words, numbers and blanks."""
    word = F.when(F.col("pos") % 3 == 0, F.initcap(F.col("blue").cast("string"))).when(F.col("pos") % 3 == 1, F.col("blue").cast("int").cast("string")).otherwise("")
    path = _csv(seq(spark, sf_dir).select((F.col("video_id") * 100_000 + F.col("pos")).alias("frame_id"), word.alias("blue_glove_detected")), "metadata")
    return files.metadata(spark, path).select("frame_id", "blue_glove_detected")


@query(f"{_S} select video_id * 100000 + pos as frame, gt, 'number' as shape from seq union all select video_id * 100000 + pos, gt, 'label' from seq")
def ground_truth_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shapes of truth, the second one with semicolons."""
    frame = F.col("video_id") * 100_000 + F.col("pos")
    s = seq(spark, sf_dir)
    first = _csv(s.select(frame.alias("frame_number"), F.col("gt").alias("gt_binary")), "truth")
    second = scratch(spark, "truth")
    s.select(F.format_string("img_%d.jpg", frame).alias("frame_id"), F.when(F.col("gt") == 1, " Holding").otherwise("not_holding").alias("label"), F.lit(30).alias("fps")).write.option("header", True).option("sep", ";").csv(second)
    read = lambda path, shape: files.ground_truth(spark, path).select("frame", "gt", F.lit(shape).alias("shape"))
    return read(first, "number").unionByName(read(second, "label"))


@query(f"{_S} select video_id * 100000 + pos // 2 as frame_id, arg_min(pred, pos) as predicted_label from seq group by 1")
def selected_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of most frames: the first one counts."""
    rows = seq(spark, sf_dir).select((F.col("video_id") * 100_000 + F.floor(F.col("pos") / 2)).alias("frame_id"), F.col("pred").alias("predicted_label"), "pos")
    path = scratch(spark, "selected")
    rows.repartitionByRange("frame_id").sortWithinPartitions("frame_id", "pos").drop("pos").write.option("header", True).csv(path)
    return files.selected(spark, path)


@query(f"""{_S}, c as (select video_id, count(*) as n, count(*) filter (pred = 1 and gt = 1) as tp, avg((pred = gt)::int) as accuracy from seq group by 1)
select 'd' || video_id as dataset_key, case when video_id % 4 = 0 then 'failed' else 'success' end as status, case when video_id % 4 = 0 then null else n end as n_frames, case when video_id % 4 = 0 then null else tp end as tp, case when video_id % 4 = 0 then null else round(accuracy, 9) end as accuracy, case when video_id % 4 = 0 then 'no truth' end as error from c""")
def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of datasets written as CSV, some failed, and read with their types."""
    c = seq(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n_frames"), F.count_if((F.col("pred") == 1) & (F.col("gt") == 1)).alias("tp"), F.avg((F.col("pred") == F.col("gt")).cast("int")).alias("accuracy"))
    failed = F.col("video_id") % 4 == 0
    rows = c.select(F.format_string("d%d", "video_id").alias("dataset_key"), F.when(failed, "failed").otherwise("success").alias("status"), F.lit("s.csv").alias("selected_csv"), F.lit("g.csv").alias("gt_csv"), *[F.when(~failed, F.col(n)).alias(n) for n in ("n_frames", "tp", "accuracy")], F.when(failed, "no truth").alias("error"))
    return files.dataset_metrics(spark, _csv(rows, "metrics")).select("dataset_key", "status", "n_frames", "tp", F.round("accuracy", 9).alias("accuracy"), "error")


@query(f"{_D} select frame_number + video_id * 512 as frame, (contact_label = 'Portable Object')::int as pred from det where detection_type = 'hand' and row_id = (select min(d.row_id) from det d where d.video_id = det.video_id and d.frame_number = det.frame_number)")
def condensed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir).groupBy((F.col("frame_number") + F.col("video_id") * 512).alias("frame_number")).agg(F.min_by(F.struct("detection_type", "contact_label"), "row_id").alias("m")).where("m.detection_type = 'hand'")
    return files.condensed(spark, _csv(rows.select("frame_number", "m.contact_label"), "condensed"))


@query("""select 'd' || user_id as dataset_key, case when user_id % 3 = 0 then 'failed' else 'success' end as status, count(*)::varchar as n from events where user_id % 2 = 0 and user_id % 3 <> 0 group by 1, 2""")
def manifest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a manifest by key and status."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.groupBy("user_id").agg(F.count("*").alias("n")).select(F.format_string("d%d", "user_id").alias("dataset_key"), F.when(F.col("user_id") % 3 == 0, "failed").otherwise("success").alias("status"), "n")
    keys = e.where("user_id % 2 = 0").select(F.format_string("d%d", "user_id").alias("dataset_key")).distinct()
    return files.manifest(spark, _csv(rows, "manifest"), ("dataset_key", "status"), keys, ["success"])


@query(f"{_D} select frame_id as image, round(confidence / 100, 3) as score, bbox_x1::double as bbox_x1, bbox_y1::double as bbox_y1, bbox_x2::double as bbox_x2, bbox_y2::double as bbox_y2, coalesce(contact_state::varchar, '') as state from det")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    rows = det(spark, sf_dir).select(F.col("frame_id").alias("image"), (F.col("confidence") / 100).alias("score"), "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", F.col("contact_state").alias("state"))
    annotations.result_lines(rows, ("state",)).write.text(path)
    return annotations.read_result_lines(spark, path).select("image", "score", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", F.coalesce(F.get("rest", 0), F.lit("")).alias("state"))


@query(f"""{_D}, l as (select *, case when video_id % 5 = 0 then 'val' else 'train' end as split from det where detection_type = 'object'), f as (select distinct split, video_id, frame_number from l),
i as (select *, row_number() over (partition by split order by video_id, frame_number) as image_id, concat(video_id, '_', lpad(frame_number::varchar, 6, '0'), '.png') as file_name from f)
select split, i.file_name, count(*) as n, sum((bbox_x2 - bbox_x1) * (bbox_y2 - bbox_y1))::double as area from l join i using (split, video_id, frame_number) group by 1, 2""")
def coco_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets written as COCO files, a document for each split, and read again."""
    path = scratch(spark, "coco")
    objects = det(spark, sf_dir).where("detection_type = 'object'")
    rows = objects.withColumns({"split": F.when(F.col("video_id") % 5 == 0, "val").otherwise("train"), "width": F.lit(440), "height": F.lit(300)}).withColumnRenamed("frame_number", "frame_idx")
    images, ann = dataset.coco_tables(rows)
    annotations.write_coco(images, ann, "stimulus", path)
    out = None
    for split in ("train", "val"):
        t = annotations.coco(spark, f"{path}/split={split}")
        joined = t["annotations"].join(t["images"].select(F.col("id").alias("image_id"), "file_name"), "image_id")
        part = joined.groupBy("file_name").agg(F.count("*").alias("n"), F.sum("area").alias("area")).select(F.lit(split).alias("split"), "file_name", "n", "area")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""{_D}, d as (select *, video_id % 3 as ds from det), b as (select 'd' || ds as dataset_key, video_id, frame_number, contact_label, hand_side, detection_type, is_filtered, blue_prop, case when detection_type = 'hand' and is_filtered is not null and not is_filtered and blue_prop >= 0.5 then 'No Contact' else contact_label end as label from d)
select dataset_key, video_id, frame_number, case min(case when detection_type = 'hand' and not is_filtered then case when label in ('Portable Object', 'Portable Object Contact') then 2 when label in ('Stationary Object', 'Stationary Object Contact') then 3 else 1 end end)
  when 2 then 'Portable Object' when 3 then 'Stationary Object' else 'No Contact' end as contact_label from b where dataset_key <> 'd2' group by 1, 2, 3""")
def batch_of_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets from CSV to labels in CSV, in two calls of which the second skips what is there; one dataset is left out.

    Columns stand in another order in each of two tables, one of which lacks frame_number; another table lies beside them.
    """
    from ..plans.workflow import PipelineConfig

    root, out = scratch(spark, "runs"), scratch(spark, "labels")
    names = [c.split()[0] for c in batch.FULL.split(", ")]
    rows = det(spark, sf_dir).select(F.format_string("d%d", F.col("video_id") % 3).alias("dataset_key"), *[c.strip() for c in names])
    rows.where("dataset_key <> 'd1'").select("dataset_key", *sorted(names)).write.option("header", True).partitionBy("dataset_key").csv(f"{root}/some")
    rows.where("dataset_key = 'd1'").select(*sorted(set(names) - {"frame_number"}, reverse=True)).write.option("header", True).csv(f"{root}/d1/detections_full.csv")
    rows.select("frame_id", "contact_label").write.option("header", True).csv(f"{root}/d1/detections_condensed.csv")
    chosen = PipelineConfig(object_size=None, smaller_factor=None)
    batch.postprocess(spark, root, out, (440, 300), chosen, ["d0"])
    batch.postprocess(spark, root, out, (440, 300), chosen, ["d0", "d1"], skip_existing=True)
    return spark.read.option("header", True).schema("video_id bigint, frame_number bigint, frame_id string, contact_label string, source_hand string, dataset_key string").csv(out).select("dataset_key", "video_id", "frame_number", "contact_label")


@query(f"""{_D} select video_id, row_id, row_number() over (partition by video_id order by frame_number, detection_type, bbox_x1, bbox_y1, bbox_x2, bbox_y2, confidence, row_id) - 1 as place from det""")
def sorted_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a full table, as each row's place in its video."""
    return ranked(det(spark, sf_dir), ["video_id"], batch.detection_order(), "place").select("video_id", "row_id", "place")


@query("""with v as (select l_orderkey, l_linenumber, ['True', ' no ', '', '1.0', 'maybe', 'NaN', 'y', '0', 'T', 'f', '-3.7', '12', '1e3', 'x1', '2.5'][(l_partkey % 15 + 1)::bigint] as v from lineitem), t as (select *, lower(trim(v)) as t from v)
select l_orderkey, l_linenumber, case when t in ('true', '1', '1.0', 'yes', 'y', 't') then true when t in ('false', '0', '0.0', 'no', 'n', 'f', '', 'nan', 'none') then false end as flag,
  coalesce(floor(case when lower(v) <> 'nan' then try_cast(v as double) end)::bigint, 0) as whole, case when lower(v) <> 'nan' then try_cast(v as double) end as number from t""")
def tolerant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ["True", " no ", "", "1.0", "maybe", "NaN", "y", "0", "T", "f", "-3.7", "12", "1e3", "x1", "2.5"]))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.get(words, (F.col("l_partkey") % 15).cast("int")).alias("v"))
    return li.select("l_orderkey", "l_linenumber", parsing.tolerant_bool(F.col("v")).alias("flag"), parsing.safe_int(F.col("v")).alias("whole"), parsing.safe_float(F.col("v")).alias("number"))


@query(f"""{_S}, v as (select *, case pos % 4 when 0 then '' when 1 then '-5' when 2 then 'x' else ((video_id % 3) * 10 + pos)::varchar end as fps from seq where video_id % 7 <> 3 or pos % 4 <> 3)
select video_id, coalesce(arg_min(try_cast(fps as double), pos) filter (try_cast(fps as double) > 0), 30.0)::double as fps from v group by 1""")
def dataset_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset's rate: the first positive number in its truth's file, or a default."""
    p = F.col("pos") % 4
    word = F.when(p == 0, "").when(p == 1, "-5").when(p == 2, "x").otherwise(((F.col("video_id") % 3) * 10 + F.col("pos")).cast("string"))
    return seq(spark, sf_dir).where("video_id % 7 <> 3 or pos % 4 <> 3").withColumn("fps", word).groupBy("video_id").agg(parsing.fps(F.col("fps"), F.col("pos"), 30.0).alias("fps"))


@query(f"""{_D}, b as (select row_id, video_id, bbox_x1 as x, bbox_y1 as y, bbox_x2 - bbox_x1 as w, bbox_y2 - bbox_y1 as h, frame_number from det)
select row_id, video_id, x, y, x + w - 1 as x2, y + h - 1 as y2, floor((w - 20) / 2)::bigint as cx1, floor((h - 20) / 2)::bigint as cy1, floor((w - 20) / 2)::bigint + 20 as cx2, floor((h - 20) / 2)::bigint + 20 as cy2 from b""")
def box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner and size to corners, and the centred crop of a frame as large as the box."""
    d = det(spark, sf_dir)
    own = boxes.box()
    b = boxes.to_xyxy(boxes.to_xywh(own), 1)
    c = boxes.centre_crop(boxes.width(own), boxes.height(own), 20, 20)
    return d.select("row_id", "video_id", b.x1.alias("x"), b.y1.alias("y"), b.x2.alias("x2"), b.y2.alias("y2"), *[v.cast("bigint").alias(f"c{k}") for k, v in zip(("x1", "y1", "x2", "y2"), c, strict=True)])


@query(f"""{_D}, a as (select row_id, video_id % 4 as image_id, contact_state as category_id, (bbox_x2 - bbox_x1) * (bbox_y2 - bbox_y1) as area, (row_id % 9 = 0)::int as iscrowd from det where detection_type = 'hand')
select row_id, image_id from a where image_id in (0, 2) and category_id in (0, 3) and area > 5000 and area < 20000 and iscrowd = 0""")
def annotations_by_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = det(spark, sf_dir).where("detection_type = 'hand'").selectExpr("row_id", "video_id % 4 as image_id", "contact_state as category_id", "(bbox_x2 - bbox_x1) * (bbox_y2 - bbox_y1) as area", "cast(row_id % 9 = 0 as int) as iscrowd")
    return filters.ids(a, {"image_id": [0, 2], "category_id": [0, 3], "supercategory": []}, (5000, 20_000), False).select("row_id", "image_id")


@query(f"""{_D}, t as (select row_id, video_id, frame_number, detection_type, bbox_x1, bbox_y1, bbox_x2, bbox_y2, row_number() over w as n, lag(bbox_x1) over w as px1, lag(bbox_y1) over w as py1, lag(bbox_x2) over w as px2, lag(bbox_y2) over w as py2
  from det where detection_type = 'object' window w as (partition by video_id order by frame_number, row_id))
select video_id, row_id, bbox_x1 + coalesce((bbox_x1 + bbox_x2 - px1 - px2) / 2.0::double, 0) as x1, bbox_y1 + coalesce((bbox_y1 + bbox_y2 - py1 - py2) / 2.0::double, 0) as y1, bbox_x2 + coalesce((bbox_x1 + bbox_x2 - px1 - px2) / 2.0::double, 0) as x2, bbox_y2 + coalesce((bbox_y1 + bbox_y2 - py1 - py2) / 2.0::double, 0) as y2 from t""")
def boxes_moved_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where linear motion puts each object of a video next."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("frame_number", "row_id")
    names = ("x1", "y1", "x2", "y2")
    df = det(spark, sf_dir).where("detection_type = 'object'").withColumns({f"p_{k}": F.lag(f"bbox_{k}").over(w) for k in names})
    b = boxes.moved_on(boxes.box("p_"), boxes.box())
    return df.select("video_id", "row_id", *[c.cast("double").alias(k) for k, c in zip(names, b, strict=True)])


@query("""with c as (select l_orderkey, l_linenumber, [l_partkey % 50, l_suppkey % 7, l_linenumber, l_partkey % 13, l_suppkey % 3] as counts from lineitem) select l_orderkey, l_linenumber, (counts[2] + counts[4])::bigint as area from c""")
def mask_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of run-length masks."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "array(l_partkey % 50, l_suppkey % 7, cast(l_linenumber as bigint), l_partkey % 13, l_suppkey % 3) as counts")
    return li.select("l_orderkey", "l_linenumber", masks.area(F.col("counts")).alias("area"))


@query(f"""{_S}, f as (select *, ln(case when pred = 1 then 0.9 else 0.1 end::double) as one, ln(case when pred = 1 then 0.2 else 0.8 end::double) as zero from seq)
select video_id, pos, round(sum(one) over w, 6) as contact, round(sum(zero) over w, 6) as free from f window w as (partition by video_id order by pos rows unbounded preceding)""")
def log_likelihood_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running log-likelihoods of the two states, as refinement uses them."""
    from ..operators import refine

    sums = refine.log_likelihood_sums(seq(spark, sf_dir), refine.SegmentHSMM(1, (1.0, 1.0), (1.0, 1.0), fpr=0.2, fnr=0.1))
    return sums.select("video_id", "pos", F.round("contact", 6).alias("contact"), F.round("free", 6).alias("free"))


@query(f"""{_S}, b as (select video_id, pos, pred, gt from seq where pos % 3 <> 1), c as (select video_id, count(*) as n_common, min(pos) as frame_min, max(pos) as frame_max, round(avg((pred = gt)::int), 6) as accuracy from b group by 1) select * from c""")
def intersection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over the frames that predictions and truth share."""
    s = seq(spark, sf_dir)
    out = batch.intersection_metrics(s.select("video_id", "pos", "pred"), s.where("pos % 3 <> 1").select("video_id", "pos", "gt"), ["video_id"], "pos")
    return out.select("video_id", "n_common", "frame_min", "frame_max", F.round("accuracy", 6).alias("accuracy"))


@query(f"""{cte(det=DET, gt=GT)}, l as (select video_id, frame_number, case when min(case when detection_type = 'hand' and not is_filtered then case when blue_prop >= 0.5 then 1 when contact_label in ('Portable Object', 'Portable Object Contact') then 2 when contact_label in ('Stationary Object', 'Stationary Object Contact') then 3 else 1 end end) = 2 then 1 else 0 end as pred from det group by all),
b as (select l.video_id, l.pred, g.gt, l.frame_number from l join gt g on l.video_id = g.video_id and l.frame_number = g.frame_number where l.frame_number % 3 <> 0)
select 'd' || video_id as dataset_key, count(*)::bigint as n_common, sum(pred * gt)::bigint as tp, sum(pred * (1 - gt))::bigint as fp, sum((1 - pred) * (1 - gt))::bigint as tn, sum((1 - pred) * gt)::bigint as fn, min(frame_number) as frame_min, max(frame_number) as frame_max, round(avg((pred = gt)::int), 9) as accuracy from b group by video_id""")
def resumed_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset for each video, from CSV to scores, in two runs: of the even ones, and then of all, which goes on."""
    from ..plans import resumable
    from ..testdata import view

    root, out = scratch(spark, "datasets"), scratch(spark, "workflow")
    names = [c.split()[0] for c in batch.FULL.split(", ")]
    rows = det(spark, sf_dir).select(F.format_string("d%d", "video_id").alias("dataset_key"), *names)
    rows.repartition("dataset_key").write.option("header", True).partitionBy("dataset_key").csv(root)
    truth = view(spark, sf_dir, GT).where("frame_number % 3 <> 0").select(F.format_string("d%d", "video_id").alias("dataset_key"), F.col("frame_number").alias("frame"), "gt")
    flow = resumable.contact_workflow(spark, root, truth, out, (440, 300), resumable.profile("baseline"), "dataset_key={}")
    keys = rows.select("dataset_key").distinct()
    flow.run(keys.where("cast(substr(dataset_key, 2) as int) % 2 = 0"))
    flow.run(keys)
    return flow.output("metrics").select("dataset_key", "n_common", "tp", "fp", "tn", "fn", "frame_min", "frame_max", F.round("accuracy", 9).alias("accuracy"))
