"""Queries on detections: geometry, labels, filters, matching, condensing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, labels, parsing
from ..operators import condense as c
from ..operators import filters as f
from ..operators import matching as m
from ..testdata import DET, cte, view
from .registry import query

_D = cte(det=DET)
_AREA = "greatest(0, {0}x2 - {0}x1)::double * greatest(0, {0}y2 - {0}y1)"
_H, _O = _AREA.format("h.bbox_"), _AREA.format("o.bbox_")
_INTER = "greatest(0, least(h.bbox_x2, o.bbox_x2) - greatest(h.bbox_x1, o.bbox_x1))::double * greatest(0, least(h.bbox_y2, o.bbox_y2) - greatest(h.bbox_y1, o.bbox_y1))"
_IOU = f"case when {_INTER} > 0 then {_INTER} / ({_H} + {_O} - {_INTER}) else 0 end"
_CX, _CY = "(o.bbox_x1 + o.bbox_x2) / 2 - (h.bbox_x1 + h.bbox_x2) / 2", "(o.bbox_y1 + o.bbox_y2) / 2 - (h.bbox_y1 + h.bbox_y2) / 2"
_FAR = (
    "(power((o.bbox_x1 + o.bbox_x2) / 2 - ((h.bbox_x1 + h.bbox_x2) / 2 + coalesce(h.offset_mag, 0) * 10000 * coalesce(h.offset_x, 0)), 2)"
    " + power((o.bbox_y1 + o.bbox_y2) / 2 - ((h.bbox_y1 + h.bbox_y2) / 2 + coalesce(h.offset_mag, 0) * 10000 * coalesce(h.offset_y, 0)), 2))"
)
#: Rows of (hand, best object) for hands that satisfy {0} and objects that satisfy {1}.
_BEST = f"""select h.video_id, h.frame_number, h.row_id, o.row_id as m_row_id, o.confidence as m_confidence, {_O} as m_area, {_IOU} as m_iou
  from {{t}} h join {{t}} o on h.video_id = o.video_id and h.frame_number = o.frame_number
  where h.detection_type = 'hand' and o.detection_type = 'object' and {{0}} and {{1}}
  qualify row_number() over (partition by h.video_id, h.frame_number, h.row_id order by o.confidence desc, {_FAR}, {_IOU} desc, {_O} desc, o.bbox_x1, o.bbox_y1, o.bbox_x2, o.bbox_y2, o.row_id) = 1"""


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DET)


def frames() -> tuple[Column, Column]:
    """Width and height of every frame of these views."""
    return F.lit(440), F.lit(300)


#: The filters' SQL, one after another; each reads the one before it.
_BLUE = """blue as (select * replace (
    case when k and blue_prop >= 0.5 then 'No Contact' else contact_label end as contact_label, case when k and blue_prop >= 0.5 then 0 else contact_state end as contact_state,
    case when k and blue_prop >= 0.5 then 'experimenter' when k then 'participant' else blue_glove_status end as blue_glove_status) from (select *, detection_type = 'hand' and is_filtered is not null and not is_filtered as k from det))"""
_SIZE = f"""size as (select * exclude (k), case when {_AREA.format("bbox_")} / (440 * 300) > 0.2 and detection_type = 'object' and not coalesce(is_filtered, true) then true end as large from blue),
sized as (select * exclude (large, is_filtered), coalesce(large, is_filtered) as is_filtered, large is true as too_large from size)"""


def _ratio_sql(src: str, out: str, factor: float) -> str:
    best = _BEST.format("h.contact_label = 'Portable Object' and not coalesce(h.is_filtered, true)", "not coalesce(o.is_filtered, true)", t=src)
    return f"""{out}_m as ({best}),
{out} as (select h.* replace (case when m.m_area > {factor} * ({_H}) then 'No Contact' else h.contact_label end as contact_label, case when m.m_area > {factor} * ({_H}) then 0 else h.contact_state end as contact_state),
  m.m_confidence as {out}_conf, m.m_area as {out}_area from {src} h left join {out}_m m using (video_id, frame_number, row_id))"""


_CHAIN = f"{_D},\n{_BLUE},\n{_SIZE},\n{_ratio_sql('sized', 'small', 2.0)},\n{_ratio_sql('small', 'big', 1.0)}"
_CONDENSE = """select video_id, frame_number, frame_id,
  case min(case when detection_type = 'hand' and not is_filtered then case when contact_label in ('Portable Object', 'Portable Object Contact') then {p} when contact_label in ('Stationary Object', 'Stationary Object Contact') then {s} else {n} end end)
    when {p} then 'Portable Object' when {s} then 'Stationary Object' else 'No Contact' end as contact_label,
  case when bool_or(detection_type = 'hand' and not is_filtered and hand_side = 'Left') and bool_or(detection_type = 'hand' and not is_filtered and hand_side = 'Right') then 'Both'
    when bool_or(detection_type = 'hand' and not is_filtered and hand_side = 'Left') then 'Left' when bool_or(detection_type = 'hand' and not is_filtered and hand_side = 'Right') then 'Right' else 'NA' end as source_hand
from {t} group by video_id, frame_number, frame_id"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir)
    return f.bigger_than_hand(f.smaller_factor(f.object_size(f.blue_glove(df), frames(), 0.2)))


@query(f"{_CHAIN}\n" + _CONDENSE.format(n=1, p=2, s=3, t="big"))
def contact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: detections through all relabelling filters to one label for each frame."""
    return c.condense(cleaned(spark, sf_dir))


@query(f"{_D}\n" + _CONDENSE.format(p=1, s=2, n=3, t="det"))
def condense_portable_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.condense(det(spark, sf_dir), "portable_first")


@query(f"{_D}\n" + """select video_id, frame_number, row_id, contact_label from det where detection_type = 'hand'
qualify row_number() over (partition by video_id, frame_number order by case contact_label when 'Portable Object' then 0 when 'Stationary Object' then 1 when 'No Contact' then 2 else 3 end, row_id) = 1""")
def condense_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.condense_legacy(det(spark, sf_dir))


@query(f"""{_D}
select h.row_id as h_row_id, o.row_id as o_row_id, {_H} as area, {_O} as other_area, {_INTER} as inter, round({_IOU}, 9) as iou,
  round((greatest(0, least(h.bbox_x2, o.bbox_x2) - greatest(h.bbox_x1, o.bbox_x1) + 1)::double * greatest(0, least(h.bbox_y2, o.bbox_y2) - greatest(h.bbox_y1, o.bbox_y1) + 1)) / ((o.bbox_x2 - o.bbox_x1 + 1)::double * (o.bbox_y2 - o.bbox_y1 + 1)), 9) as coverage,
  round((greatest(0, least(h.bbox_x2, o.bbox_x2) - greatest(h.bbox_x1, o.bbox_x1) + 1)::double * greatest(0, least(h.bbox_y2, o.bbox_y2) - greatest(h.bbox_y1, o.bbox_y1) + 1)) / ((h.bbox_x2 - h.bbox_x1 + 1)::double * (h.bbox_y2 - h.bbox_y1 + 1) + (o.bbox_x2 - o.bbox_x1 + 1)::double * (o.bbox_y2 - o.bbox_y1 + 1)
    - greatest(0, least(h.bbox_x2, o.bbox_x2) - greatest(h.bbox_x1, o.bbox_x1) + 1)::double * greatest(0, least(h.bbox_y2, o.bbox_y2) - greatest(h.bbox_y1, o.bbox_y1) + 1)), 9) as iou_pixels,
  round({_INTER} / case when o.confidence > 80 then {_H} else {_H} + {_O} - {_INTER} end, 9) as iou_xywh,
  round(sqrt(power({_CX}, 2) + power({_CY}, 2)), 9) as far, round({_FAR}, 9) as offset_far,
  round((h.bbox_x2 - h.bbox_x1) / greatest((h.bbox_y2 - h.bbox_y1)::double, 0.000001), 9) as aspect, h.bbox_x2 > h.bbox_x1 and h.bbox_y2 > h.bbox_y1 as valid
from det h join det o on h.video_id = o.video_id and h.frame_number = o.frame_number where h.detection_type = 'hand' and o.detection_type = 'object'""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, o = boxes.box("h_bbox_"), boxes.box("o_bbox_")
    df = m.pairs(det(spark, sf_dir), F.lit(True), F.lit(True))
    r = lambda col, name: F.round(col, 9).alias(name)
    return df.select(
        "h_row_id", "o_row_id", boxes.area(h).alias("area"), boxes.area(o).alias("other_area"), boxes.intersection(h, o).alias("inter"), r(boxes.iou(h, o), "iou"), r(boxes.coverage(h, o), "coverage"),
        r(boxes.iou_pixels(h, o), "iou_pixels"), r(boxes.iou_xywh(boxes.to_xywh(h), boxes.to_xywh(o), F.col("o_confidence") > 80), "iou_xywh"), r(boxes.centre_distance(h, o), "far"),
        r(boxes.offset_distance(h, o, F.col("h_offset_mag"), F.col("h_offset_x"), F.col("h_offset_y")), "offset_far"), r(boxes.aspect_ratio(h), "aspect"), boxes.valid(h).alias("valid"),
    )


@query(f"""{_D}, p as (select row_id, bbox_x1 as x1, bbox_y1 as y1, bbox_x2 as x2, bbox_y2 as y2, bbox_x2 - bbox_x1 + 1.0::double as w, bbox_y2 - bbox_y1 + 1.0::double as h from det)
select row_id, round(12 / w, 6) as dx, round(-6 / h, 6) as dy, round(ln((w + 8) / w), 6) as dw, round(ln((h + 4) / h), 6) as dh,
  greatest(0, least(x1, 399))::double as cx1, greatest(0, least(y1, 249))::double as cy1, greatest(0, least(x2, 400))::double as cx2, greatest(0, least(y2, 250))::double as cy2,
  440 - x2 - 1 as fx1, 440 - x1 - 1 as fx2, greatest((x1 + x2) / 2 - (x2 - x1) * 0.75, 0)::double as ex1, least((x1 + x2) / 2 + (x2 - x1) * 0.75, 299)::double as ex2,
  round(x1 + 12.5 / 1 - 0.5 + 0, 6)::double as shifted from p""")
def box_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of a box moved by (8, -8) and grown by (8, 4); clipping, flipping, enlarging; decoding gives the box back."""
    b = boxes.box()
    t = boxes.Box(b.x1 + 8, b.y1 - 8, b.x2 + 16, b.y2 - 4)
    dx, dy, dw, dh = boxes.encode(b, t)
    back = boxes.decode(b, dx, dy, dw, dh)
    cl, fl, en = boxes.clip(b, F.lit(400), F.lit(250)), boxes.flip(b, F.lit(440)), boxes.enlarge(b, 1.5, F.lit(300), F.lit(440))
    r = lambda col, name: F.round(col, 6).alias(name)
    return det(spark, sf_dir).select(
        "row_id", r(dx, "dx"), r(dy, "dy"), r(dw, "dw"), r(dh, "dh"), cl.x1.alias("cx1"), cl.y1.alias("cy1"), cl.x2.alias("cx2"), cl.y2.alias("cy2"),
        fl.x1.alias("fx1"), fl.x2.alias("fx2"), en.x1.cast("double").alias("ex1"), en.x2.cast("double").alias("ex2"), r(back.x1 + 4, "shifted"),
    )


@query(f"""{_D}, l as (select row_id, contact_state, contact_label, confidence, case when row_id % 3 = 0 then ' Holding ' when row_id % 3 = 1 then contact_label end as raw from det where detection_type = 'hand')
select row_id, case contact_state when 0 then 'No Contact' when 1 then 'Self Contact' when 2 then 'Other Person Contact' when 3 then 'Portable Object' when 4 then 'Stationary Object Contact' end as state_name,
  case when raw in ('Portable Object', 'Portable Object Contact') then 'Portable Object' when raw in ('Stationary Object', 'Stationary Object Contact') then 'Stationary Object' else 'No Contact' end as condensed,
  case when raw = 'No Contact' then 'No Contact' when raw in ('Portable Object', 'Portable Object Contact') then 'Portable Object' when raw in ('Stationary Object', 'Stationary Object Contact') then 'Stationary Object' end as strict,
  coalesce(lower(trim(raw)) in ('holding', 'contact', '1', 'true', 'yes'), false)::int as timeline, (coalesce(raw, '') = 'Portable Object')::int as exact,
  case when lower(trim(raw)) in ('holding', 'contact', '1', 'portable object') then 1 when lower(trim(raw)) in ('not_holding', 'not holding', 'no_contact', 'no contact', '0') then 0 end as evaluator, round(confidence / 100, 6) as prob from l""")
def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("row_id") % 3 == 0, " Holding ").when(F.col("row_id") % 3 == 1, F.col("contact_label"))
    df = det(spark, sf_dir).where("detection_type = 'hand'").withColumn("raw", raw)
    return df.select(
        "row_id", labels.state_label(F.col("contact_state")).alias("state_name"), labels.condensed(F.col("raw")).alias("condensed"), labels.strict(F.col("raw")).alias("strict"),
        labels.binary(F.col("raw"), "timeline").alias("timeline"), labels.binary(F.col("raw"), "exact").alias("exact"), labels.binary(F.col("raw")).alias("evaluator"), F.round(labels.probability(F.col("confidence")), 6).alias("prob"),
    )


@query("""select page_id, try_cast(regexp_extract(url, '([0-9]+)', 1) as bigint) as number, regexp_extract(url, '([^/]*)$', 1) as last_part,
  trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_') as token, concat(lpad(page_id::varchar, 6, '0'), '.png') as frame,
  coalesce(nullif(regexp_extract(url, '(P[0-9]+)', 1), ''), nullif(regexp_extract(url, '([^/]+)/[^/]*$', 1), ''), 'unknown') as participant,
  array_to_string(list_filter([case when length(html) > 1500 then 'long' end, case when page_id % 2 = 0 then 'even' end, case when contains(url, '?') then 'query' end], lambda x: x is not null), '|') as reasons from pages""")
def name_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, url = spark.read.parquet(f"{sf_dir}/pages.parquet"), F.col("url")
    return df.select(
        "page_id", parsing.first_number(url).alias("number"), F.regexp_extract(url, r"([^/]*)$", 1).alias("last_part"), parsing.token(url).alias("token"), parsing.padded(F.col("page_id")).alias("frame"),
        parsing.participant(url).alias("participant"), parsing.joined(("long", F.length("html") > 1500), ("even", F.col("page_id") % 2 == 0), ("query", F.contains(url, F.lit("?")))).alias("reasons"),
    )


@query(f"{_D},\n{_BLUE}\nselect video_id, frame_number, row_id, contact_label, contact_state, blue_glove_status from blue")
def blue_glove_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.blue_glove(det(spark, sf_dir)).select("video_id", "frame_number", "row_id", "contact_label", "contact_state", "blue_glove_status")


@query(f"""{_D},\n{_BLUE},\n{_SIZE}\nselect row_id, video_id, is_filtered, case when too_large then 'object_size_filter' end as filtered_by from sized""")
def object_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir)
    return f.object_size(f.blue_glove(df), frames(), 0.2).select("row_id", "video_id", "is_filtered", "filtered_by")


@query(f"""{_CHAIN}
select video_id, frame_number, row_id, contact_label, contact_state, coalesce(big_conf, small_conf) as conf, round(coalesce(big_area, small_area), 6) as obj_area from big""")
def object_ratio_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ratio filters; the second one's match overwrites the first's where it has one."""
    df = det(spark, sf_dir)
    first = f.smaller_factor(f.object_size(f.blue_glove(df), frames(), 0.2)).withColumnsRenamed({"matched_object_conf": "c1", "matched_object_area": "a1"})
    out = f.bigger_than_hand(first)
    return out.select("video_id", "frame_number", "row_id", "contact_label", "contact_state", F.coalesce("matched_object_conf", "c1").alias("conf"), F.round(F.coalesce("matched_object_area", "a1"), 6).alias("obj_area"))


@query(f"{_D}\nselect video_id, frame_number, row_id, m_row_id, m_confidence, m_area, round(m_iou, 6) as m_iou from ({_BEST.format('true', 'true', t='det')})")
def best_object_of_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.best_object(det(spark, sf_dir), F.lit(True), F.lit(True)).where("m_row_id is not null")
    return out.select("video_id", "frame_number", "row_id", "m_row_id", "m_confidence", "m_area", F.round("m_iou", 6).alias("m_iou"))


@query(f"""{_D}, b as (select h.video_id, h.frame_number, h.row_id, o.row_id as object_row_id from det h join det o on h.video_id = o.video_id and h.frame_number = o.frame_number
  where h.detection_type = 'hand' and o.detection_type = 'object' and h.contact_state in (3, 4) qualify row_number() over (partition by h.video_id, h.frame_number, h.row_id order by {_FAR}, o.row_id) = 1)
select h.video_id, h.frame_number, h.row_id, coalesce(b.object_row_id, -1) as object_row_id from det h left join b using (video_id, frame_number, row_id) where h.detection_type = 'hand'""")
def nearest_object_of_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.nearest_object(det(spark, sf_dir), F.col("contact_state").isin(3, 4))


#: A tracked box for every third frame, in one row of it.
_TRACKED = "case when frame_number % 3 = 0 and row_id % 2 = 0 then bbox_{k} + 7 end::double as tracking_bbox_{k}"
_TR = ", ".join(_TRACKED.format(k=k) for k in ("x1", "y1", "x2", "y2"))
_TIOU = _IOU.replace("o.bbox_", "tb.t_")


@query(f"""{_D}, tracked as (select *, {_TR}, case when frame_number % 3 = 0 and row_id % 2 = 0 then 'predicted' end as tracking_bbox_source from det),
tb as (select video_id, frame_number, arg_min(tracking_bbox_x1, row_id) filter (tracking_bbox_x1 is not null) as t_x1, arg_min(tracking_bbox_y1, row_id) filter (tracking_bbox_y1 is not null) as t_y1,
  arg_min(tracking_bbox_x2, row_id) filter (tracking_bbox_x2 is not null) as t_x2, arg_min(tracking_bbox_y2, row_id) filter (tracking_bbox_y2 is not null) as t_y2 from tracked group by 1, 2),
m as ({_BEST.format("h.contact_label like 'Portable Object%' and h.blue_glove_status <> 'experimenter' and not coalesce(h.is_filtered, false)", "not coalesce(o.is_filtered, false)", t="tracked")}),
j as (select h.*, m.m_iou, m.m_confidence, not coalesce(h.is_filtered, false) as judged, h.contact_label like 'Portable Object%' and not coalesce(h.is_filtered, false) as portable,
  case when tb.t_x1 is not null then {_TIOU} end as t_iou from tracked h left join m using (video_id, frame_number, row_id) left join tb using (video_id, frame_number) where h.detection_type = 'hand'),
e as (select *, portable and blue_glove_status = 'experimenter' as blue, portable and blue_glove_status <> 'experimenter' as asked, coalesce(m_iou >= 0.05, false) as by_object, coalesce(t_iou >= 0.15, false) as by_track from j)
select video_id, frame_number, row_id, case when blue or (asked and not by_object and not by_track) then 'No Contact' else contact_label end as contact_label,
  case when not judged then null when asked and by_object then 'detected' when asked and by_track then 'tracked' else 'none' end as evidence,
  case when asked and by_object then round(m_iou, 6) when asked and by_track then round(t_iou, 6) end as evidence_iou,
  case when blue then 'blue_experimenter' when asked and not by_object and not by_track then concat(case when m_iou is null then 'no_detected_match' else 'detected_iou_below_threshold' end, '|', case when t_iou is null then 'no_tracked_match' else 'tracked_iou_below_threshold' end)
    when judged then '' end as reason from e""")
def strict_portable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = (F.col("frame_number") % 3 == 0) & (F.col("row_id") % 2 == 0)
    df = det(spark, sf_dir).withColumns({f"tracking_bbox_{k}": F.when(some, F.col(f"bbox_{k}") + 7).cast("double") for k in ("x1", "y1", "x2", "y2")} | {"tracking_bbox_source": F.when(some, "predicted")})
    out = f.strict_portable(df).where("detection_type = 'hand'")
    return out.select("video_id", "frame_number", "row_id", "contact_label", F.col("portable_evidence_source").alias("evidence"), F.round("portable_evidence_iou", 6).alias("evidence_iou"), F.col("strict_demote_reason").alias("reason"))


_BH = f"""bh as (select o.video_id, o.frame_number, o.row_id, h.row_id as hand_row_id, {_H} as hand_area, {_IOU} as iou, {_INTER} as inter from det o join det h on h.video_id = o.video_id and h.frame_number = o.frame_number
  where h.detection_type = 'hand' and o.detection_type = 'object' qualify row_number() over (partition by o.video_id, o.frame_number, o.row_id order by {_IOU} desc, sqrt(power({_CX}, 2) + power({_CY}, 2)), h.row_id) = 1)"""


@query(f"""{_D}, {_BH}
select o.video_id, o.row_id, bh.hand_row_id, round(bh.hand_area, 6) as hand_area, case when bh.hand_row_id is not null then round({_O} / greatest(bh.hand_area, 0.000001), 6) end as ratio,
  array_to_string(list_filter([case when o.confidence < 60 then 'low_confidence' end, case when not (o.bbox_x2 - o.bbox_x1) / greatest((o.bbox_y2 - o.bbox_y1)::double, 0.000001) between 0.5 and 2 then 'aspect_ratio_out_of_range' end, case when bh.hand_row_id is null then 'no_hand_in_frame' end,
    case when bh.hand_row_id is not null and {_O} / greatest(bh.hand_area, 0.000001) >= 1.5 then 'object_too_large_relative_to_hand' end, case when bh.inter / greatest({_O}, 0.000001) > 0.4 then 'object_too_occluded_by_hand' end], lambda x: x is not null), '|') as reasons
from det o left join bh using (video_id, frame_number, row_id) where o.detection_type = 'object'""")
def pseudo_label_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir)
    out = f.heuristics(df.where("detection_type = 'object'"), df.where("detection_type = 'hand'"), 60, (0.5, 2.0), True, 1.5, 0.4)
    area = F.when(F.col("hand_row_id").isNotNull(), boxes.area(boxes.box("hand_")))
    return out.select("video_id", "row_id", "hand_row_id", F.round(area, 6).alias("hand_area"), F.round("object_to_hand_area_ratio", 6).alias("ratio"), F.col("heuristics_fail_reasons").alias("reasons"))


@query(f"""{_D} select video_id, frame_number, row_id, rank from (select *, row_number() over (partition by video_id, frame_number, detection_type order by confidence desc, row_id) as rank from det
  where confidence >= case when detection_type = 'hand' then 50 else 60 end) where rank <= 2""")
def best_detections_of_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.best_of_frame(det(spark, sf_dir), 50, 60, 2).select("video_id", "frame_number", "row_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""{_D} select video_id, frame_number, row_id, rank() over (partition by video_id, frame_number order by confidence desc) as rank from det qualify rank() over (partition by video_id, frame_number order by confidence desc) <= 3""")
def best_detections_of_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.best_of_image(det(spark, sf_dir), 3).select("video_id", "frame_number", "row_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""{_D} select row_id, video_id, bbox_x2 - bbox_x1 >= 100 or bbox_y2 - bbox_y1 >= 100 as large, bbox_x2 < 440 and bbox_y2 < 300 as inside from det where bbox_x2 - bbox_x1 >= 100 or bbox_y2 - bbox_y1 >= 100""")
def box_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = f.large_boxes(det(spark, sf_dir), 100).withColumn("large", F.lit(True))
    within = f.inside(df, F.lit(440), F.lit(300)).select("video_id", "row_id", F.lit(True).alias("inside"))
    return df.join(within, ["video_id", "row_id"], "left").select("row_id", "video_id", "large", F.coalesce("inside", F.lit(False)).alias("inside"))


@query(f"""{_D}, a as (select video_id * 1000 + frame_number as image_id, contact_state as category_id from det where detection_type = 'hand')
select image_id from a where category_id in (1, 3) group by 1 having count(distinct category_id) = 2""")
def images_with_all_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = det(spark, sf_dir).where("detection_type = 'hand'").select((F.col("video_id") * 1000 + F.col("frame_number")).alias("image_id"), F.col("contact_state").alias("category_id"))
    return f.with_all_categories(a, [1, 3])


@query(f"""{_D}, a as (select video_id, bbox_x1::double as x1, bbox_y1::double as y1, bbox_x2::double as x2, bbox_y2::double as y2, false as is_extra from det where detection_type = 'object'),
b as (select video_id, greatest(0, least(bbox_x1 * 1.5::double, 439)) as x1, greatest(0, least(bbox_y1 * 1.5::double, 299)) as y1, greatest(0, least(bbox_x2 * 1.5::double, 439)) as x2, greatest(0, least(bbox_y2 * 1.5::double, 299)) as y2, true as is_extra from det where detection_type = 'hand' and contact_state = 3)
select * from a union all select * from b where x2 > x1 and y2 > y1""")
def extra_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir)
    out = f.extra_regions(df.where("detection_type = 'object'"), df.where("detection_type = 'hand' and contact_state = 3"), "video_id", F.lit(1.5), F.lit(440), F.lit(300))
    return out.withColumnsRenamed({f"bbox_{k}": k for k in ("x1", "y1", "x2", "y2")})


@query("with n as (select l_orderkey as image_id, l_shipdate::varchar[1:1] || (l_partkey % 50)::varchar as name from lineitem), v as (select '1' || (l_partkey % 50)::varchar as name from lineitem where l_partkey % 50 < 3) select distinct image_id from n where name in (select name from v)".replace("l_shipdate::varchar[1:1]", "'1'"))
def images_with_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("1"), (F.col("l_partkey") % 50).cast("string")).alias("name")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return f.with_vocabulary(li.select(F.col("l_orderkey").alias("image_id"), name), li.where("l_partkey % 50 < 3").select(name))


@query(f"""{_D}, b as (select row_id, video_id, bbox_x1 - 60 as x, bbox_y1 - 60 as y, bbox_x2 - bbox_x1 - 80 as w, bbox_y2 - bbox_y1 - 60 as h from det),
c as (select *, greatest(0, x)::double as x1, greatest(0, y)::double as y1, least(399, greatest(0, x) + greatest(0, w - 1))::double as x2, least(249, greatest(0, y) + greatest(0, h - 1))::double as y2 from b)
select row_id, video_id, x1, y1, x2, y2 from c where w * h > 0 and x2 >= x1 and y2 >= y1""")
def sane_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir).selectExpr("row_id", "video_id", "bbox_x1 - 60 as x", "bbox_y1 - 60 as y", "bbox_x2 - bbox_x1 - 80 as w", "bbox_y2 - bbox_y1 - 60 as h")
    return f.sane_boxes(df, F.lit(400), F.lit(250)).select("row_id", "video_id", "x1", "y1", "x2", "y2")


@query(f"""{_D}, b as (select row_id, video_id, bbox_x1 as x1, bbox_y1 as y1, bbox_x2 - 80 as x2, bbox_y2 - 60 as y2, x2 <= x1 or y2 <= y1 as bad from det)
select row_id, video_id, case when bad then 0 else x1 end as fixed_x1, case when bad then 0 else y1 end as fixed_y1, case when bad then 439 else x2 end as fixed_x2, case when bad then 439 else y2 end as fixed_y2 from b""")
def repaired_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir).selectExpr("row_id", "video_id", "bbox_x1 as x1", "bbox_y1 as y1", "bbox_x2 - 80 as x2", "bbox_y2 - 60 as y2")
    return f.repaired_boxes(df, F.lit(440), F.lit(300)).select("row_id", "video_id", "fixed_x1", "fixed_y1", "fixed_x2", "fixed_y2")
