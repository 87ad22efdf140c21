"""Queries on average precision, suppression, anchors and their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection_eval as e
from ..operators import proposals as p
from ..testdata import DET, cte
from .detections import det
from .registry import query

_X = "greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1) + 1)::double * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1) + 1)"
_IOU = f"({_X} / ((d.x2 - d.x1 + 1)::double * (d.y2 - d.y1 + 1) + (g.x2 - g.x1 + 1)::double * (g.y2 - g.y1 + 1) - {_X}))"
_VOC = f"""{cte(det=DET)}, d as (select video_id, frame_number, video_id % 3 as class, row_id as det_id, bbox_x1 + row_id % 9 * 4 as x1, bbox_y1 as y1, bbox_x2 + row_id % 9 * 4 as x2, bbox_y2 as y2, confidence + row_id % 1009 / 10000.0::double as confidence, hand_side from det),
g as (select video_id, frame_number, video_id % 3 as class, row_id as gt_id, bbox_x1 as x1, bbox_y1 as y1, bbox_x2 as x2, bbox_y2 as y2, row_id % 10 = 0 as difficult, hand_side from det where row_id % 3 = 0),
o as (select d.video_id, d.frame_number, d.det_id, g.gt_id, {_IOU} as overlap, g.difficult, g.hand_side as gt_side from d join g using (video_id, frame_number) qualify row_number() over (partition by d.video_id, d.frame_number, d.det_id order by {_IOU} desc, g.gt_id) = 1),
m as (select d.video_id, d.frame_number, d.class, d.det_id, d.confidence, d.hand_side, o.gt_id, coalesce(o.overlap > 0.5, false) as ok, coalesce(o.overlap > 0.5, false) and coalesce(o.difficult, false) as hard, o.gt_side from d left join o using (video_id, frame_number, det_id)),
q as (select *, ok and coalesce({{c}}, false) as good from m), r as (select *, good and row_number() over (partition by video_id, frame_number, gt_id, good order by confidence desc, det_id) = 1 as first from q),
h as (select *, (first and not hard)::int as tp, (not hard and not (first and not hard))::int as fp from r), np as (select class, count(*) as npos from g where not difficult group by 1),
c as (select h.*, npos, sum(tp) over w as ctp, sum(fp) over w as cfp from h join np using (class) window w as (partition by class order by confidence desc, det_id rows unbounded preceding)),
v as (select *, ctp / npos::double as recall, ctp / greatest((ctp + cfp)::double, 2.220446049250313e-16) as prec from c),
cv as (select *, max(prec) over (partition by class order by confidence desc, det_id rows between current row and unbounded following) as env from v)"""


def _voc(spark: SparkSession, sf_dir: str, side: bool = False) -> tuple[DataFrame, DataFrame]:
    df = det(spark, sf_dir).withColumn("class", F.col("video_id") % 3)
    shift = F.col("row_id") % 9 * 4
    d = df.withColumns({"det_id": F.col("row_id"), "bbox_x1": F.col("bbox_x1") + shift, "bbox_x2": F.col("bbox_x2") + shift, "confidence": F.col("confidence") + F.col("row_id") % 1009 / F.lit(10000.0)})
    d = d.select("video_id", "frame_number", "class", "det_id", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "confidence", "hand_side")
    g = df.where("row_id % 3 = 0").select("video_id", "frame_number", "class", F.col("row_id").alias("gt_id"), *[F.col(f"bbox_{k}").alias(f"gt_{k}") for k in ("x1", "y1", "x2", "y2")], (F.col("row_id") % 10 == 0).alias("gt_difficult"), F.col("hand_side").alias("gt_side"))
    return e.voc_hits(d, g.drop("class"), ["video_id", "frame_number"], 0.5, F.col("hand_side") == F.col("gt_side") if side else None), g


@query(f"{_VOC.format(c='true')} select class, round(sum(case when tp = 1 then env / npos else 0 end), 9) as ap from cv group by 1")
def voc_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.average_precision_of_hits(*_voc(spark, sf_dir), ["class"]).select("class", F.round("ap", 9).alias("ap"))


@query(f"{_VOC.format(c='true')} select class, round(({' + '.join(f'coalesce(max(prec) filter (recall >= {i * 0.1}::double), 0)' for i in range(11))}) / 11, 9) as ap from cv group by 1")
def voc_eleven_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.average_precision_of_hits(*_voc(spark, sf_dir), ["class"], True).select("class", F.round("ap", 9).alias("ap"))


@query(f"{_VOC.format(c='hand_side = gt_side')} select class, round(sum(case when tp = 1 then env / npos else 0 end), 9) as ap from cv group by 1")
def voc_hand_side_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.average_precision_of_hits(*_voc(spark, sf_dir, True), ["class"]).select("class", F.round("ap", 9).alias("ap"))


@query(f"{_VOC.format(c='true')}, a as (select class, sum(case when tp = 1 then env / npos else 0 end) as ap from cv group by 1) select round(avg(ap), 9) as mean_ap from a")
def voc_mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.average_precision_of_hits(*_voc(spark, sf_dir), ["class"]).agg(F.round(F.avg("ap"), 9).alias("mean_ap"))


@query(f"""{_VOC.format(c='true')} select class, max(npos) as npos, round(arg_max(confidence, struct_pack(f := case when prec + recall > 0 then prec * recall / (prec + recall) else 0 end, s := confidence)), 6) as threshold from cv group by 1""")
def score_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.best_threshold_of_hits(*_voc(spark, sf_dir), ["class"]).select("class", "npos", F.round("threshold", 6).alias("threshold"))


def _coco(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = det(spark, sf_dir).withColumns({"image_id": F.col("video_id") * 512 + F.col("frame_number"), "category_id": F.col("video_id") % 3})
    size = {"w": F.col("bbox_x2") - F.col("bbox_x1"), "h": F.col("bbox_y2") - F.col("bbox_y1")}
    df = df.withColumns(size)
    d = df.select("image_id", "category_id", F.col("row_id").alias("det_id"), (F.col("bbox_x1") + F.col("row_id") % 9 * 4).alias("x"), F.col("bbox_y1").alias("y"), "w", "h", (F.col("confidence") / 100 + F.col("row_id") % 1009 / 1e6).alias("score"))
    g = df.where("row_id % 3 = 0").select("image_id", "category_id", F.col("row_id").alias("gt_id"), F.col("bbox_x1").alias("x"), F.col("bbox_y1").alias("y"), "w", "h", (F.col("w") * F.col("h")).cast("double").alias("area"), (F.col("row_id") % 20 == 0).cast("int").alias("iscrowd"), F.lit(0).alias("gt_ignore"))
    return d, g


#: Detections take truths one after another, for each range of areas and threshold: table r has what became of each detection.
_MATCHED = f"""with recursive det as (select {DET[1]} from {DET[0]}),
e as (select *, video_id * 512 + frame_number as image_id, video_id % 3 as category_id, bbox_x2 - bbox_x1 as w, bbox_y2 - bbox_y1 as h from det),
d as (select image_id, category_id, row_id as det_id, bbox_x1 + row_id % 9 * 4 as x, bbox_y1 as y, w, h, confidence / 100 + row_id % 1009 / 1000000.0::double as score, row_number() over (partition by image_id, category_id order by confidence / 100 + row_id % 1009 / 1000000.0::double desc, row_id) as n from e),
g as (select image_id, category_id, row_id as gt_id, bbox_x1 as x, bbox_y1 as y, w, h, (w * h)::double as area, row_id % 20 = 0 as crowd from e where row_id % 3 = 0),
areas as (select * from (values ('all', 0.0::double, 1e10::double), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 1e10)) v(kind, low, high)),
thresholds as (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::double as threshold),
i as (select d.image_id, d.n, g.gt_id, g.crowd, g.area, greatest(0, least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x))::double * greatest(0, least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y)) as inter, (d.w * d.h)::double as own, (g.w * g.h)::double as other from d join g using (image_id, category_id)),
p as (select image_id, n, gt_id, crowd, area, inter / greatest(1e-300::double, case when crowd then own else own + other - inter end) as over from i where inter > 0),
walk as (select image_id, kind, low, high, threshold, 0::bigint as n, []::bigint[] as taken, null::bigint as pick, null::boolean as used from (select distinct image_id from d), areas, thresholds
  union all select w.image_id, w.kind, w.low, w.high, w.threshold, w.n + 1, case when x.gt_id is null then w.taken else list_append(w.taken, x.gt_id) end, x.gt_id, x.used from walk w join d on d.image_id = w.image_id and d.n = w.n + 1
  left join lateral (select p.gt_id, not p.crowd and p.area >= w.low and p.area <= w.high as used from p where p.image_id = w.image_id and p.n = w.n + 1 and p.over >= w.threshold and (p.crowd or not list_contains(w.taken, p.gt_id))
    order by not p.crowd and p.area >= w.low and p.area <= w.high desc, p.over desc, p.gt_id desc limit 1) x on true),
r as (select w.kind, w.threshold, d.image_id, d.category_id, d.n, d.score, w.pick is not null as matched, coalesce(not w.used, d.w * d.h < w.low or d.w * d.h > w.high) as ignored from walk w join d on d.image_id = w.image_id and d.n = w.n where w.n between 1 and 100),
np as (select kind, category_id, count(*) as npos from g, areas where not crowd and area between low and high group by 1, 2),
c as (select r.*, npos, sum(matched::int) over v as tp, sum((not matched)::int) over v as fp from r join np using (kind, category_id) where not ignored window v as (partition by kind, threshold, category_id order by score desc, image_id, n)),
q as (select kind, threshold, category_id, floor(tp / npos::double * 100 + 1e-9)::int as at_recall, max(tp / (tp + fp)::double) as precision from c group by 1, 2, 3, 4),
grid as (select kind, category_id, threshold, unnest(range(0, 101)) as recall from np, thresholds),
f as (select grid.*, coalesce((select max(precision) from q where q.kind = grid.kind and q.threshold = grid.threshold and q.category_id = grid.category_id and q.at_recall >= grid.recall), 0) as precision from grid)"""
_MEAN = "coalesce(avg(precision) filter ({0}), -1)"


@query(f"""{_MATCHED}, k as (select unnest([1, 10, 100]) as most), hits as (select kind, threshold, category_id, most, count(*) as hits from r, k where matched and not ignored and n <= most group by 1, 2, 3, 4),
ar as (select np.kind, most, avg(coalesce(hits, 0) / npos::double) as recall from np join thresholds on true join k on true left join hits using (kind, threshold, category_id, most) group by 1, 2),
m as (select {_MEAN.format("kind = 'all'")} as ap, {_MEAN.format("kind = 'all' and threshold = 0.5")} as ap50, {_MEAN.format("kind = 'all' and threshold = 0.75")} as ap75, {", ".join(f"{_MEAN.format(f"kind = '{x}'")} as ap_{x}" for x in ("small", "medium", "large"))} from f)
select {", ".join(f"round({x}, 9) as {x}" for x in ("ap", "ap50", "ap75", "ap_small", "ap_medium", "ap_large"))}, {", ".join(f"round(coalesce((select recall from ar where kind = 'all' and most = {x}), -1), 9) as ar_{x}" for x in (1, 10, 100))},
  {", ".join(f"round(coalesce((select recall from ar where kind = '{x}' and most = 100), -1), 9) as ar_{x}" for x in ("small", "medium", "large"))} from m""")
def coco_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, g = _coco(spark, sf_dir)
    out = e.coco_means(d, g)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(f"""{_MATCHED} select category_id, {", ".join(f"round({_MEAN.format(f"kind = '{x}'")}, 9) as ap{'' if x == 'all' else '_' + x}" for x in ("all", "small", "medium", "large"))} from f group by 1 having count(*) filter (kind = 'all') > 0""")
def coco_precision_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, g = _coco(spark, sf_dir)
    out = e.coco_means_by_category(d, g)
    return out.select("category_id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


_NX = "greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1) + 1)::double * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1) + 1)"
_NIOU = f"({_NX} / ((k.x2 - k.x1 + 1)::double * (k.y2 - k.y1 + 1) + (b.x2 - b.x1 + 1)::double * (b.y2 - b.y1 + 1) - {_NX}))"


_SUPPRESSED = f"""with recursive det as (select {DET[1]} from {DET[0]}),
s as (select video_id, frame_number, row_id, {{box}}, row_number() over (partition by video_id, frame_number order by confidence desc, row_id) as n from det),
p as (select k.video_id, k.frame_number, k.n as a, b.n as b from s k join s b on k.video_id = b.video_id and k.frame_number = b.frame_number and k.n < b.n and {_NIOU} >= {{t}}),
walk as (select video_id, frame_number, 1::bigint as n, [1::bigint] as kept from s where n = 1 union all
  select w.video_id, w.frame_number, w.n + 1, case when exists (select 1 from p where p.video_id = w.video_id and p.frame_number = w.frame_number and p.b = w.n + 1 and list_contains(w.kept, p.a)) then w.kept else list_append(w.kept, w.n + 1) end
  from walk w join s on s.video_id = w.video_id and s.frame_number = w.frame_number and s.n = w.n + 1),
f as (select video_id, frame_number, arg_max(kept, n) as kept from walk group by 1, 2)
select s.video_id, s.frame_number, {{out}} from s join f using (video_id, frame_number) where list_contains(f.kept, s.n)"""


@query(_SUPPRESSED.format(t=0.3, box="bbox_x1 as x1, bbox_y1 as y1, bbox_x2 as x2, bbox_y2 as y2", out="s.row_id"))
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.suppressed(det(spark, sf_dir), ["video_id", "frame_number"], 0.3).select("video_id", "frame_number", "row_id")


@query(_SUPPRESSED.format(t=0.7, box="greatest(0, least(bbox_x1, 439))::double as x1, greatest(0, least(bbox_y1, 299))::double as y1, greatest(0, least(bbox_x2, 439))::double as x2, greatest(0, least(bbox_y2, 299))::double as y2",
    out="s.row_id, (list_position(f.kept, s.n) - 1)::int as rank") + " and list_position(f.kept, s.n) <= 3")
def proposal_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.proposals(det(spark, sf_dir), ["video_id", "frame_number"], F.lit(440), F.lit(300), 6000, 3).select("video_id", "frame_number", "row_id", "rank")


_ANCHORS = """r as (select unnest([0.5, 1.0, 2.0]) as ratio, unnest([0, 1, 2]) as i), s as (select unnest([8, 16, 32]) as scale, unnest([0, 1, 2]) as j),
b as (select i * 3 + j as anchor, scale, round_even(sqrt(256.0::double / ratio), 0) as w, ratio from r, s), b2 as (select anchor, w * scale as w, round_even(w * ratio, 0) * scale as h from b),
base as (select anchor, 7.5 - (w - 1) / 2 as x1, 7.5 - (h - 1) / 2 as y1, 7.5 + (w - 1) / 2 as x2, 7.5 + (h - 1) / 2 as y2 from b2)"""


_STRIPS = f"{cte(det=DET)}, v as (select video_id, ceil((max(bbox_y2) + 1) / 16.0)::bigint as rows, ceil((max(bbox_x2) + 1) / 16.0)::bigint as cols from det group by video_id)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 16 pixels that each video's boxes reach over."""
    cells = lambda c: F.ceil((F.max(c) + 1) / 16)
    return det(spark, sf_dir).groupBy("video_id").agg(cells("bbox_y2").alias("rows"), cells("bbox_x2").alias("cols"))


@query(f"{_STRIPS}, {_ANCHORS} select video_id, anchor, x1 + cols as x1, y1 + rows as y1, x2 + cols as x2, y2 + rows as y2 from v, base")
def base_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base anchors, moved by the size of each video's feature map."""
    b = _sizes(spark, sf_dir).select("video_id", "rows", "cols", F.explode(p.base_anchors()).alias("a"))
    return b.select("video_id", "a.anchor", *[(F.col(f"a.{k}") + F.col(d)).alias(k) for k, d in (("x1", "cols"), ("y1", "rows"), ("x2", "cols"), ("y2", "rows"))])


@query(f"""{_STRIPS}, {_ANCHORS} select video_id, (y * cols + x) * 9 + anchor as anchor_id, x1 + x * 16 as x1, y1 + y * 16 as y1, x2 + x * 16 as x2, y2 + y * 16 as y2
from v, base, lateral (select unnest(range(0, rows)) as y), lateral (select unnest(range(0, cols)) as x)""")
def shifted_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of anchors over each video's feature map, whose size is that of its boxes."""
    out = p.shifted_anchors(_sizes(spark, sf_dir), F.col("rows"), F.col("cols"))
    return out.select("video_id", "anchor_id", *[F.col(f"bbox_{k}").alias(k) for k in ("x1", "y1", "x2", "y2")])


def _truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir).where("detection_type = 'object'")
    return df.select((F.col("video_id") * 512 + F.col("frame_number")).alias("image_id"), F.col("row_id").alias("gt_id"), *[F.col(f"bbox_{k}").alias(f"gt_{k}") for k in ("x1", "y1", "x2", "y2")], (F.col("row_id") % 5 + 1).alias("gt_class"))


def _rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir)
    return df.select((F.col("video_id") * 512 + F.col("frame_number")).alias("image_id"), F.col("row_id").alias("anchor_id"), *[F.col(f"bbox_{k}") for k in ("x1", "y1", "x2", "y2")])


_TARGETS = f"""{cte(det=DET)}, d as (select video_id * 512 + frame_number as image_id, row_id as anchor_id, bbox_x1 as x1, bbox_y1 as y1, bbox_x2 as x2, bbox_y2 as y2 from det),
g as (select video_id * 512 + frame_number as image_id, row_id as gt_id, bbox_x1 as x1, bbox_y1 as y1, bbox_x2 as x2, bbox_y2 as y2, row_id % 5 + 1 as gt_class from det where detection_type = 'object'),
o as (select d.image_id, d.anchor_id, g.gt_id, g.gt_class, coalesce({_IOU}, 0) as overlap from d left join g using (image_id)), m as (select *, max(overlap) over (partition by image_id, gt_id) as most from o)"""
_LABELS = """ select image_id, anchor_id, arg_max(gt_id, struct_pack(o := overlap, g := -gt_id)) as gt_id, round(max(overlap), 9) as overlap,
  case when bool_or(overlap = most and most > 0) or max(overlap) >= 0.7 then 1 when max(overlap) < 0.3 then 0 else -1 end as label from m group by 1, 2"""


@query(_TARGETS + _LABELS)
def anchor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.anchor_targets(_rois(spark, sf_dir), _truths(spark, sf_dir), "image_id").select("image_id", "anchor_id", "gt_id", F.round("overlap", 9).alias("overlap"), "label")


@query(f"""{_TARGETS}, l as ({_LABELS}), n as (select *, row_number() over (partition by image_id, label order by md5('7-' || anchor_id), anchor_id) as nth, least(count(*) filter (label = 1) over (partition by image_id), 2) as fg from l)
select image_id, anchor_id, case when (label = 1 and nth <= fg) or (label = 0 and nth <= 4 - fg) then label else -1 end as label from n""")
def sampled_anchor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = p.anchor_targets(_rois(spark, sf_dir), _truths(spark, sf_dir), "image_id")
    return p.sampled_anchors(labelled, "image_id", 4).select("image_id", "anchor_id", "label")


@query(_TARGETS + """ select image_id, anchor_id, case when max(overlap) > 0 then arg_max(gt_class, struct_pack(o := overlap, g := -gt_id)) else 0 end as gt_class, round(max(overlap), 9) as overlap from m group by 1, 2""")
def region_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.truth_classes(_rois(spark, sf_dir), _truths(spark, sf_dir), "image_id").select("image_id", "anchor_id", F.col("gt_class").cast("bigint").alias("gt_class"), F.round("overlap", 9).alias("overlap"))


@query(f"""{_TARGETS}, b as (select image_id, anchor_id, max(overlap) as overlap, arg_max(gt_id, struct_pack(o := overlap, g := -gt_id)) as gt_id from m group by 1, 2),
k as (select *, case when overlap >= 0.5 then 'fg' when overlap >= 0.1 and overlap < 0.5 then 'bg' end as kind from b),
n as (select *, row_number() over (partition by image_id, kind order by md5('7-' || anchor_id), anchor_id) as nth, least(count(*) filter (kind = 'fg') over (partition by image_id), 2) as fg from k where kind is not null)
select image_id, anchor_id, kind, gt_id from n where nth <= case when kind = 'fg' then fg else 8 - fg end""")
def proposal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.proposal_targets(_rois(spark, sf_dir), _truths(spark, sf_dir), "image_id", batch=8).select("image_id", "anchor_id", "kind", "gt_id")


@query(f"""{cte(det=DET)} select row_id, video_id, bbox_x1 as x1, bbox_x2 as x2, false as flipped from det union all select row_id, video_id, 440 - bbox_x2 - 1, 440 - bbox_x1 - 1, true from det""")
def flipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.with_flipped(det(spark, sf_dir), F.lit(440)).select("row_id", "video_id", F.col("bbox_x1").alias("x1"), F.col("bbox_x2").alias("x2"), "flipped")


@query(f"""{cte(det=DET)} select video_id, min(row_id) as row_id from det group by video_id, round_even(bbox_x1 / 32.0, 0), round_even(bbox_y1 / 32.0, 0), round_even(bbox_x2 / 32.0, 0), round_even(bbox_y2 / 32.0, 0)""")
def unique_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.unique_boxes(det(spark, sf_dir), ["video_id"], 1 / 32).select("video_id", "row_id")


_CLASS_AP = f"""{cte(det=DET)}, d as (select video_id * 512 + frame_number as image_id, video_id * 100000000000000 + row_id as det_id, {{dc}} as class, bbox_x1 + row_id % 9 * 4 as x1, bbox_y1 as y1, bbox_x2 + row_id % 9 * 4 as x2, bbox_y2 as y2, confidence + row_id % 1009 / 10000.0::double as confidence from det),
t as (select video_id * 512 + frame_number as image_id, row_id, bbox_x1 as x1, bbox_y1 as y1, bbox_x2 as x2, bbox_y2 as y2 from det where row_id % 3 = 0),
g as ({{gs}}), o as (select d.det_id, g.gt_id, {_IOU} as overlap from d join g using (image_id, class) qualify row_number() over (partition by d.image_id, d.class, d.det_id order by {_IOU} desc, g.gt_id) = 1),
m as (select d.*, o.gt_id, coalesce(o.overlap > {{t}}, false) as ok from d left join o using (det_id)), r as (select *, (ok and row_number() over (partition by image_id, class, gt_id, ok order by confidence desc, det_id) = 1)::int as tp from m),
np as (select class, count(*) as npos from g group by 1), c as (select r.*, npos, sum(tp) over w as ctp, sum(1 - tp) over w as cfp from r join np using (class) window w as (partition by class order by confidence desc, det_id rows unbounded preceding)),
v as (select *, max(ctp / (ctp + cfp)::double) over (partition by class order by confidence desc, det_id rows between current row and unbounded following) as env from c),
a as (select class, sum(case when tp = 1 then env / npos else 0 end) as ap from v group by 1)
select class, coalesce(npos, 0)::bigint as npos, round(coalesce(ap, 0), 9) as ap from (select class from d union select class from g) left join np using (class) left join a using (class)"""


#: More than any row_id (512 frames of 8 lines, 10**10 each, and what keys add), so that ids of 219,000 videos are bigints in the SQL's order.
_ROWS = 42_000_000_000_000


def _class_truths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = det(spark, sf_dir).withColumn("image_id", F.col("video_id") * 512 + F.col("frame_number"))
    shift = F.col("row_id") % 9 * 4
    d = df.withColumns({"det_id": F.col("video_id") * _ROWS + F.col("row_id"), "bbox_x1": F.col("bbox_x1") + shift, "bbox_x2": F.col("bbox_x2") + shift, "confidence": F.col("confidence") + F.col("row_id") % 1009 / F.lit(10000.0)})
    g = df.where("row_id % 3 = 0").select("image_id", F.col("row_id").alias("gt_id"), *[F.col(f"bbox_{k}").alias(f"gt_{k}") for k in ("x1", "y1", "x2", "y2")])
    return d.select("image_id", "det_id", "row_id", *[f"bbox_{k}" for k in ("x1", "y1", "x2", "y2")], "confidence"), g


def _numbered(letter: str, n: Column) -> Column:
    return F.concat(F.lit(letter), n.cast("string"))  # format_string builds a formatter a row


@query(_CLASS_AP.format(dc="'c' || row_id % 4", gs="select *, row_id as gt_id, 'c' || row_id % 5 as class from t", t=0.5))
def scene_graph_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by class; c4 has truths and no detections."""
    d, g = _class_truths(spark, sf_dir)
    out = e.class_average_precision(d.withColumn("class", _numbered("c", F.col("row_id") % 4)), g.withColumn("class", _numbered("c", F.col("gt_id") % 5)), "image_id")
    return out.select("class", "npos", F.round("ap", 9).alias("ap"))


@query(_CLASS_AP.format(dc="'a' || row_id % 4", gs="select *, row_id as gt_id, unnest(['a' || row_id % 5, 'a' || (row_id + 1) % 5]) as class from t", t=0.5))
def scene_graph_attribute_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths have two attributes each."""
    d, g = _class_truths(spark, sf_dir)
    truths = g.withColumn("class", F.explode(F.array(_numbered("a", F.col("gt_id") % 5), _numbered("a", (F.col("gt_id") + 1) % 5))))
    return e.class_average_precision(d.withColumn("class", _numbered("a", F.col("row_id") % 4)), truths, "image_id").select("class", "npos", F.round("ap", 9).alias("ap"))


_CASES = "case when {0} % 2 = 0 then 'Hand' else 'hand' end"


@query(_CLASS_AP.format(dc="'hand'", gs=f"select *, row_id as gt_id, {_CASES.format('row_id')} as class from t", t=0.7))
def voc_same_case_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names as they stand, at an overlap of .7."""
    d, g = _class_truths(spark, sf_dir)
    out = e.class_average_precision(d.withColumn("class", F.lit("hand")), g.withColumn("class", F.expr(_CASES.format("gt_id"))), "image_id", 0.7, True)
    return out.select("class", "npos", F.round("ap", 9).alias("ap"))


_LINKED = "case when contact_state in (3, 4) then bbox_{k}{s} end as {p}{k}"
_LINKS = lambda p, s: ", ".join(_LINKED.format(k=k, s=s if k[0] == "x" else "", p=p) for k in ("x1", "y1", "x2", "y2"))
_OBJ_X = "greatest(0, least(lx2, gx2) - greatest(lx1, gx1))::double * greatest(0, least(ly2, gy2) - greatest(ly1, gy1))"
_OBJ_IOU = f"({_OBJ_X}) / ((lx2 - lx1)::double * (ly2 - ly1) + (gx2 - gx1)::double * (gy2 - gy1) - {_OBJ_X})"
_SAME_OBJECT = f"case when lx1 is null and gx1 is null then true when lx1 is null or gx1 is null then false else {_OBJ_IOU} > 0.5 end"
_HANDS = f"""{cte(det=DET)}, h as (select * from det where detection_type = 'hand'),
d as (select video_id, frame_number, video_id % 3 as class, row_id as det_id, bbox_x1 + row_id % 9 * 4 as x1, bbox_y1 as y1, bbox_x2 + row_id % 9 * 4 as x2, bbox_y2 as y2, confidence + row_id % 1009 / 10000.0::double as confidence, (contact_state + (row_id % 4 = 0)::int) % 5 as state, case when row_id % 7 = 0 then 'Left' else hand_side end as side, {_LINKS('l', ' + row_id % 6 * 20')} from h),
g as (select video_id, frame_number, video_id % 3 as class, row_id as gt_id, bbox_x1 as x1, bbox_y1 as y1, bbox_x2 as x2, bbox_y2 as y2, contact_state as gt_state, hand_side as gt_side, {_LINKS('g', '')} from h where row_id % 3 = 0),
o as (select d.video_id, d.frame_number, d.det_id, g.gt_id, {_IOU} as overlap, gt_state, gt_side, gx1, gy1, gx2, gy2 from d join g using (video_id, frame_number) qualify row_number() over (partition by d.video_id, d.frame_number, d.det_id order by {_IOU} desc, g.gt_id) = 1),
m as (select d.*, o.gt_id, coalesce(o.overlap > 0.5, false) as ok, coalesce(state = gt_state, false) as s, coalesce(side = gt_side, false) as i, coalesce({_SAME_OBJECT}, false) as b from d left join o using (video_id, frame_number, det_id)),
k as (select *, unnest([{{names}}]) as name, unnest([{{tests}}]) as fits from m), q as (select *, ok and fits as good from k),
r as (select *, (good and row_number() over (partition by name, video_id, frame_number, gt_id, good order by confidence desc, det_id) = 1)::int as tp from q),
np as (select class, count(*) as npos from g group by 1), c as (select r.*, npos, sum(tp) over w as ctp, sum(1 - tp) over w as cfp from r join np using (class) window w as (partition by name, class order by confidence desc, det_id rows unbounded preceding)),
v as (select *, max(ctp / (ctp + cfp)::double) over (partition by name, class order by confidence desc, det_id rows between current row and unbounded following) as env from c)
select name, class, round(sum(case when tp = 1 then env / npos else 0 end), 9) as ap from v group by 1, 2"""


@query(_HANDS.format(names="'', 'handstate', 'handside', 'objectbbox', 'all'", tests="true, s, i, b, s and i and b"))
def voc_hand_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hands under every constraint, by class."""
    df = det(spark, sf_dir).where("detection_type = 'hand'").withColumn("class", F.col("video_id") % 3)
    names, linked = ("x1", "y1", "x2", "y2"), F.col("contact_state").isin(3, 4)
    shift, far = F.col("row_id") % 9 * 4, F.col("row_id") % 6 * 20
    g = df.where("row_id % 3 = 0").select("video_id", "frame_number", "class", F.col("row_id").alias("gt_id"), *[F.col(f"bbox_{k}").alias(f"gt_{k}") for k in names], F.lit(False).alias("gt_difficult"),
        F.col("contact_state").alias("gt_state"), F.col("hand_side").alias("gt_side"), *[F.when(linked, F.col(f"bbox_{k}")).alias(f"gt_object_{k}") for k in names])
    d = df.select(
        "video_id", "frame_number", "class", F.col("row_id").alias("det_id"), (F.col("bbox_x1") + shift).alias("bbox_x1"), "bbox_y1", (F.col("bbox_x2") + shift).alias("bbox_x2"), "bbox_y2", (F.col("confidence") + F.col("row_id") % 1009 / F.lit(10000.0)).alias("confidence"),
        ((F.col("contact_state") + (F.col("row_id") % 4 == 0).cast("int")) % 5).alias("contact_state"), F.when(F.col("row_id") % 7 == 0, "Left").otherwise(F.col("hand_side")).alias("hand_side"),
        *[F.when(linked, F.col(f"bbox_{k}") + (far if k[0] == "x" else 0)).alias(f"object_{k}") for k in names],
    )
    out = e.average_precision_of_tests(d, g, ["video_id", "frame_number"], ["class"], {name: e.constraint(name) for name in e.CONSTRAINTS})
    return out.select("name", "class", F.round("ap", 9).alias("ap"))


@query(f"""{cte(det=DET)}, s as (select row_id, [(row_id % 17)::double, (row_id % 13)::double, (row_id % 11)::double, (row_id % 7)::double, (row_id % 5)::double] as scores, row_id % 9 - 4 as logit from det)
select row_id, list_position(scores, list_max(scores))::bigint - 1 as contact_state, logit > 0 as is_right, case when logit > 0 then 'Right' else 'Left' end as side from s""")
def head_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact state and side from a detector's scores."""
    from ..functions import labels

    df = det(spark, sf_dir).select("row_id", F.array(*[(F.col("row_id") % n).cast("double") for n in (17, 13, 11, 7, 5)]).alias("scores"), (F.col("row_id") % 9 - 4).alias("logit"))
    right = labels.likely(F.col("logit"))
    return df.select("row_id", labels.best_class(F.col("scores")).alias("contact_state"), right.alias("is_right"), labels.side_label(right.cast("int")).alias("side"))


@query("""with o as (select distinct o_orderkey from orders), r as (select *, row_number() over (order by o_orderkey) - 1 as n, (count(*) over ()) // 64 as whole from o),
b as (select distinct n // 64 as batch, case when n // 64 < max(whole) over () then md5('5-' || (n // 64)) else '~' end as draw from r), p as (select batch, row_number() over (order by draw, batch) - 1 as nth from b)
select o_orderkey, p.nth * 64 + n % 64 as place from r join p on r.n // 64 = p.batch""")
def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import dataset

    return dataset.training_order(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").distinct(), ["o_orderkey"], 64, 5)
