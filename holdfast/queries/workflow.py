"""Queries on tracking, refinement and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset, metrics, refine, tracking
from ..plans import workflow as w
from ..streaming import events as ev
from ..testdata import DET, SEQ, cte
from .detections import _BEST, _BH, _BLUE, _CONDENSE, _O, _SIZE, _TIOU, _ratio_sql, det, frames
from .registry import query
from .sequences import _CONF, _GAPPY, _ISLANDS, SIMILAR, TIMED, gappy, seq

_S = cte(seq=SEQ)
K = ["video_id"]
BRIDGE = tracking.BridgeConfig(max_missed=4, confirm=1, contact_iou=0.05, reassociate_iou=0.3, seed_confidence=70, promote_stationary=True, stationary_confirm=1, stationary_iou=0.05)


def _size(b: str) -> str:
    return f"(greatest(0, {b}x2 - {b}x1)::double * greatest(0, {b}y2 - {b}y1))"


def _over(a: str, b: str) -> str:
    """Overlap of two boxes with these prefixes."""
    w, h = (f"(least({a}{k}2, {b}{k}2) - greatest({a}{k}1, {b}{k}1))::double" for k in "xy")
    return f"(case when {w} > 0 and {h} > 0 then {w} * {h} / ({_size(a)} + {_size(b)} - {w} * {h}) else 0 end)"


_STEPS = f"""with recursive det as (select {DET[1]} from {DET[0]}),
fr as (select *, row_number() over (partition by video_id order by frame_number) as n from (select distinct video_id, frame_number from det)),
un as (select video_id, frame_number, row_id, detection_type = 'hand' as hand, bbox_x1::double as x1, bbox_y1::double as y1, bbox_x2::double as x2, bbox_y2::double as y2, confidence, least(1, confidence / 100) as prob, contact_label as label, blue_glove_status = 'experimenter' as blue, is_filtered is not true as seen from det)"""
_AT = "{0}.video_id = fr.video_id and {0}.frame_number = fr.frame_number"
_AHEAD = ", ".join(f"case when w.bx1 is null then w.l{k}{i} else 2 * ((w.l{k}1 + w.l{k}2) / 2) - (w.b{k}1 + w.b{k}2) / 2 {'-' if i == 1 else '+'} (w.l{k}2 - w.l{k}1) / 2 end as {k}{i}" for k, i in (("x", 1), ("y", 1), ("x", 2), ("y", 2)))
_SIDES = ("x1", "y1", "x2", "y2")


def _touch(names: str) -> str:
    return f"(select o.row_id, {_over('o.', 'a.')} as over from un o where {_AT.format('o')} and o.seen and o.hand and not o.blue and o.label in ({names}) and {_over('o.', 'a.')} >= 0.05 order by over desc, o.row_id limit 1)"


#: The bridge with the parameters of BRIDGE: a confirmation of one frame needs no streaks.
_BRIDGE = f"""{_STEPS}, walk as (select video_id, 0::bigint as n, null::bigint as frame_number, null::bigint as tid, 1::bigint as next_id, {", ".join(f"null::double as l{k}, null::double as b{k}" for k in _SIDES)}, 0::bigint as missed,
    null::varchar as state, null::bigint as r_id, null::bigint as r_missed, {", ".join(f"null::double as r{k}" for k in _SIDES)}, null::varchar as source, null::bigint as promoted, null::double as overlap from (select distinct video_id from det)
  union all select w.video_id, fr.n, fr.frame_number, case when w.tid is null then case when s.row_id is null then null else w.next_id end when f.row_id is not null or w.missed < 4 then w.tid end, w.next_id + (w.tid is null and s.row_id is not null)::int,
    {", ".join(f"case when w.tid is null then s.{k} when f.row_id is not null then f.{k} else a.{k} end, case when w.tid is null then null else w.l{k} end" for k in _SIDES)},
    case when w.tid is null or f.row_id is not null then 0 else w.missed + 1 end,
    case when w.tid is null and s.row_id is null then 'inactive' when w.tid is not null and f.row_id is null and w.missed >= 4 then 'lost' else 'tracking' end,
    case when w.tid is not null then w.tid when s.row_id is not null then w.next_id end, case when w.tid is null then case when s.row_id is not null then 0 end when f.row_id is not null then 0 else w.missed + 1 end,
    {", ".join(f"case when w.tid is null then s.{k} when f.row_id is not null then f.{k} when w.missed < 4 then a.{k} end" for k in _SIDES)},
    case when w.tid is null then case when s.row_id is null then 'none' else 'seed_detected' end when f.row_id is not null then 'associated_detected' when w.missed < 4 then 'predicted' else 'none' end,
    case when w.tid is not null and f.row_id is null and w.missed < 4 and not c.blue then case when t2.over > coalesce(t1.over, 0) or (t2.over = t1.over and t2.row_id < t1.row_id) then t2.row_id else t1.row_id end end,
    case when w.tid is not null and f.row_id is null and w.missed < 4 and not c.blue then greatest(t1.over, t2.over) end
  from walk w join fr on fr.video_id = w.video_id and fr.n = w.n + 1
  left join lateral (select {_AHEAD}) a on true
  left join lateral (select o.* from un o join un h on h.video_id = o.video_id and h.frame_number = o.frame_number where {_AT.format('o')} and o.seen and h.seen and not o.hand and h.hand and h.label = 'Portable Object' and not h.blue and o.prob >= 0.7
    order by o.prob desc, sqrt(power((h.x1 + h.x2) / 2 - (o.x1 + o.x2) / 2, 2) + power((h.y1 + h.y2) / 2 - (o.y1 + o.y2) / 2, 2)), {_over('h.', 'o.')} desc, o.row_id, h.row_id limit 1) s on true
  left join lateral (select o.* from un o where {_AT.format('o')} and o.seen and not o.hand and {_over('a.', 'o.')} >= 0.3 order by {_over('a.', 'o.')} desc, o.prob desc, o.row_id limit 1) f on true
  left join lateral (select count(*) > 0 as blue from un o where {_AT.format('o')} and o.seen and o.hand and o.blue) c on true
  left join lateral {_touch("'No Contact'")} t1 on true left join lateral {_touch("'Stationary Object', 'Stationary Object Contact'")} t2 on true)
select d.video_id, d.frame_number, d.row_id, case when w.promoted = d.row_id then 'Portable Object' else d.contact_label end as contact_label, coalesce(w.promoted = d.row_id, false) as tracking_promoted, w.r_id as tracking_track_id,
  case when w.promoted = d.row_id then round(w.overlap, 6) end as tracking_iou, w.r_missed as tracking_missed_count, w.state as tracking_state, w.source as tracking_bbox_source, round(w.rx1, 6) as x1 from det d join walk w on w.video_id = d.video_id and w.frame_number = d.frame_number"""


@query(_BRIDGE)
def tracking_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracking.tracking_bridge(det(spark, sf_dir).select(*tracking.NEEDED, "contact_state"), BRIDGE)
    return out.select("video_id", "frame_number", "row_id", "contact_label", "tracking_promoted", "tracking_track_id", F.round("tracking_iou", 6).alias("tracking_iou"), "tracking_missed_count", "tracking_state", "tracking_bbox_source", F.round("tracking_bbox_x1", 6).alias("x1"))


def _pick(found: str) -> str:
    """The box that overlaps the last one most, then the highest score, then the smallest corners."""
    return f"(select o.* from un o where {_AT.format('o')} and not o.hand and o.x2 > o.x1 and o.y2 > o.y1 and ({found}) order by case when w.x1 is null then 0 else {_over('o.', 'w.')} end desc, o.confidence desc, o.x1, o.y1, o.x2, o.y2 limit 1)"


def _blue(b: str) -> str:
    return f"(select count(*) > 0 as blue from un o where {_AT.format('o')} and o.hand and o.blue and {_over('o.', b)} > 0)"


_REGIONS = f"""{_STEPS}, walk as (select video_id, 0::bigint as n, null::bigint as frame_number, null::varchar as outcome, 0 as missed, {", ".join(f"null::double as {k}" for k in _SIDES)} from (select distinct video_id from det)
  union all select w.video_id, fr.n, fr.frame_number, v.outcome, case when v.outcome in ('picked', 'recovered') then 0 when v.outcome = 'missed' then case when w.missed + 1 >= 4 then 0 else w.missed + 1 end else w.missed end,
    {", ".join(f"case v.outcome when 'picked' then a.{k} when 'recovered' then b.{k} when 'missed' then case when w.missed + 1 < 4 then w.{k} end else w.{k} end" for k in _SIDES)}
  from walk w join fr on fr.video_id = w.video_id and fr.n = w.n + 1
  left join lateral {_pick("o.confidence >= 70")} a on true left join lateral {_blue("a.")} ab on true left join lateral {_blue("w.")} wb on true
  left join lateral {_pick(f"o.confidence >= 70 or {_over('o.', 'w.')} >= 0.1")} b on true left join lateral {_blue("b.")} bb on true
  left join lateral (select case when a.row_id is not null then case when ab.blue then 'guarded' else 'picked' end when w.x1 is null or w.missed >= 4 then 'none' when wb.blue or b.row_id is null or bb.blue then 'missed' else 'recovered' end as outcome) v on true)
select video_id, frame_number, outcome, missed, x1, y1, x2, y2 from walk where n > 0"""


@query(_REGIONS)
def temporal_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.temporal_regions(det(spark, sf_dir), 4)


_WALK = _BRIDGE[_BRIDGE.index("walk as (") : _BRIDGE.index("\nselect d.video_id")]
_UN = _STEPS[_STEPS.index("fr as (") :].replace("from det)", "from big)")
#: All filters, the bridge, strict evidence and one label for each frame.
_FULL = f"""with recursive det as (select {DET[1]} from {DET[0]}), {_BLUE}, {_SIZE.replace("> 0.2", "> 0.3")}, {_ratio_sql("sized", "small", 2.0)}, {_ratio_sql("small", "big", 1.0)}, {_UN}, {_WALK},
tracked as (select b.* replace (case when w.promoted = b.row_id then 'Portable Object' else b.contact_label end as contact_label) from big b join walk w on w.video_id = b.video_id and w.frame_number = b.frame_number),
tb as (select video_id, frame_number, {", ".join(f"r{k} as t_{k}" for k in _SIDES)} from walk where source <> 'none' and rx2 > rx1 and ry2 > ry1),
sm as ({_BEST.format("h.contact_label like 'Portable Object%' and h.blue_glove_status <> 'experimenter' and not coalesce(h.is_filtered, false)", "not coalesce(o.is_filtered, false)", t="tracked")}),
j as (select h.*, sm.m_iou, h.contact_label like 'Portable Object%' and h.detection_type = 'hand' and not coalesce(h.is_filtered, false) as portable, case when tb.t_x1 is not null then {_TIOU} end as t_iou
  from tracked h left join sm using (video_id, frame_number, row_id) left join tb using (video_id, frame_number)),
strict as (select * replace (case when portable and (blue_glove_status = 'experimenter' or not (coalesce(m_iou >= 0.05, false) or coalesce(t_iou >= 0.15, false))) then 'No Contact' else contact_label end as contact_label) from j)
{_CONDENSE.format(n=1, p=2, s=3, t="strict")}"""


@query(_FULL)
def full_contact_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir)
    return w.contact_labels(df, frames(), w.PipelineConfig(object_size=0.3, bigger_factor=1.0, bridge=BRIDGE, strict=True))


@query(f"{_S} select video_id, pos, case when pred >= 0.5 then 1 else 0 end as refined, 1 + sum(case when pred <> lag_pred then 1 else 0 end) over (partition by video_id)::bigint as n_segments from (select *, lag(pred) over (partition by video_id order by pos) as lag_pred from seq)")
def refine_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.refine(seq(spark, sf_dir), refine.Identity()).select("video_id", "pos", "refined", F.col("n_segments").cast("bigint").alias("n_segments"))


@query()
def refine_transition_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = refine.TransitionDP(9, refine.Durations((1.0, 1.5), (0.5, 0.5), (1.0, 1.0), 5.0))
    return refine.refine(seq(spark, sf_dir), r).select("video_id", "pos", "refined", F.round("objective", 6).alias("objective"), "n_segments")


#: Observations by place from 1, their prefix sums of two states' log-likelihoods, and the pairs of boundaries u < t.
_PREFIX = """o as (select video_id, pos + 1 as t, {one} as one, {zero} as zero, count(*) over (partition by video_id) as n from seq),
pre as (select video_id, t, n, sum(one) over w as one, sum(zero) over w as zero from o window w as (partition by video_id order by t rows unbounded preceding) union all select distinct video_id, 0, n, 0, 0 from o),
pairs as (select a.video_id, a.t as u, b.t, b.n, b.one - a.one as one, b.zero - a.zero as zero, b.t - a.t as d from pre a join pre b on a.video_id = b.video_id and a.t < b.t)"""
_DP = f"""with recursive seq as (select {SEQ[1]} from {SEQ[0]}), {_PREFIX.format(one="-ln(case when pred = 1 then 0.999999 else 0.000001 end::double)", zero="-ln(case when pred = 1 then 0.000001 else 0.999999 end::double)")},
dp as (select video_id, start, 0 as m, 0::bigint as t, 0.0::double as cost from (select distinct video_id from seq), (select unnest([0, 1]) as start) v
  union all select dp.video_id, start, m + 1, pairs.t, min(cost + case when (start + m) % 2 = 1 then one else zero end + 0.5 * power((d - case when (start + m) % 2 = 1 then 7.5 else 5.0 end) / case when m in (0, 9) then 5.0 when (start + m) % 2 = 1 then 2.5 else 2.5 end, 2))
  from dp join pairs on pairs.video_id = dp.video_id and pairs.u = dp.t where m < 10 group by dp.video_id, start, m + 1, pairs.t)
select dp.video_id, round(min(cost), 6) as objective from dp join (select distinct video_id, n from o) z on z.video_id = dp.video_id and dp.t = z.n where m = 10 group by 1"""


@query(_DP)
def transition_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost of exactly nine changes of state."""
    r = refine.TransitionDP(9, refine.Durations((1.0, 1.5), (0.5, 0.5), (1.0, 1.0), 5.0))
    return refine.refine(seq(spark, sf_dir), r).where("objective is not null").groupBy("video_id").agg(F.round(F.first("objective"), 6).alias("objective"))


_GAMMA = "case when odd then 3.0 * ln(0.4::double) - lgamma(3.0::double) + 2.0 * ln(d) - 0.4 * d else 2.0 * ln(0.3::double) - lgamma(2.0::double) + 1.0 * ln(d) - 0.3 * d end"
_HSMM = f"""with recursive seq as (select {SEQ[1]} from {SEQ[0]}), {_PREFIX.format(one="ln(case when pred = 1 then 0.7 else 0.3 end::double)", zero="ln(case when pred = 1 then 0.2 else 0.8 end::double)")},
w as (select video_id, u, t, n, odd, case when odd then one else zero end + {_GAMMA} as score from pairs, (select unnest([false, true]) as odd) v where d <= 540),
best as (select video_id, 0 as m, 0::bigint as t, 0.0::double as score from (select distinct video_id from seq) union all
  select b.video_id, m + 1, w.t, max(b.score + w.score) from best b join w on w.video_id = b.video_id and w.u = b.t and w.odd = (b.m % 2 = 1) where m < 9 group by b.video_id, m + 1, w.t),
fw as (select video_id, 0 as m, 0::bigint as t, 1.0::double as p from (select distinct video_id from seq) union all
  select b.video_id, m + 1, w.t, sum(b.p * exp(w.score)) from fw b join w on w.video_id = b.video_id and w.u = b.t and w.odd = (b.m % 2 = 1) where m < 9 group by b.video_id, m + 1, w.t),
bw as (select distinct video_id, 9 as m, n as t, 1.0::double as p from o union all
  select b.video_id, m - 1, w.u, sum(b.p * exp(w.score)) from bw b join w on w.video_id = b.video_id and w.t = b.t and w.odd = (b.m % 2 = 0) where m > 0 group by b.video_id, m - 1, w.u),
z as (select fw.video_id, fw.p as total, best.score as objective from fw join (select distinct video_id, n from o) e on e.video_id = fw.video_id and e.n = fw.t join best on best.video_id = fw.video_id and best.m = 9 and best.t = fw.t where fw.m = 9),
seg as (select w.video_id, w.u, w.t, sum(fw.p * exp(w.score) * bw.p / z.total) as p from w join fw on fw.video_id = w.video_id and fw.t = w.u and fw.m % 2 = 1 join bw on bw.video_id = w.video_id and bw.t = w.t and bw.m = fw.m + 1 join z on z.video_id = w.video_id where w.odd group by 1, 2, 3),
change as (select video_id, place, sum(p) as p from (select video_id, u as place, p from seg union all select video_id, t, -p from seg) group by 1, 2)
select o.video_id, o.t - 1 as pos, round(least(1, greatest(0, sum(coalesce(change.p, 0)) over (partition by o.video_id order by o.t rows unbounded preceding))), 6) as posterior, round(z.objective, 6) as objective
from o join z using (video_id) left join change on change.video_id = o.video_id and change.place = o.t - 1"""


@query(_HSMM)
def hsmm_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's probability of contact over all segmentations, and the likeliest one's score."""
    r = refine.SegmentHSMM(9, (2.0, 3.0), (0.3, 0.4), 0.2, 0.3, posterior=True)
    return refine.refine(seq(spark, sf_dir), r).where("status = 'ok'").select("video_id", "pos", F.round("posterior", 6).alias("posterior"), F.round("objective", 6).alias("objective"))


@query()
def refine_segment_hsmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = refine.SegmentHSMM(9, (2.0, 3.0), (0.3, 0.4), 0.2, 0.3, posterior=True)
    return refine.refine(seq(spark, sf_dir), r).select("video_id", "pos", "refined", F.round("posterior", 6).alias("posterior"), F.round("objective", 6).alias("objective"))


@query()
def refinement_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seq(spark, sf_dir)
    out = refine.change_of_metrics(s, refine.refine(s, refine.SegmentHSMM(9, (2.0, 3.0), (0.3, 0.4), 0.2, 0.3)))
    return out.select("video_id", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


@query(f"""{cte(det=DET)}, flags as (select video_id, frame_number, coalesce(bool_or(blue_glove_status = 'experimenter'), false) as blue from det where row_id % 2 = 0 group by 1, 2),
p as (select distinct video_id, frame_number from det) select p.*, coalesce(f.blue, false) as blue from p left join flags f using (video_id, frame_number)""")
def flags_onto_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["video_id", "frame_number"]
    df = det(spark, sf_dir)
    return w.with_metadata(df.select(*keys).distinct(), w.frame_flags(df.where("row_id % 2 = 0"), keys), keys, "left")


_SEL = f"""{_S}, {_GAPPY}, {_ISLANDS.format(src='gappy')}, sel as (select video_id, (first + length // 2)::bigint as pos, pred from isl where length >= 2 and not (pred = 1 and has_blue)),
t as (select video_id, pos, gt from seq where pos % 5 <> 2), a as (select sel.*, t.gt from sel left join t using (video_id, pos))"""


def _selected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return w.extract_timestamps(gappy(spark, sf_dir), K, "pos", "pred", 0.05, 40), seq(spark, sf_dir).where("pos % 5 <> 2").select("video_id", "pos", "gt")


@query(f"""{_SEL}, c as (select video_id, count(*) as n_selected_total, count(gt) as n_selected_with_gt, count(*) - count(gt) as n_selected_missing_gt, {_CONF.format(p='pred')} from a group by 1), n as (select video_id, count(*) as n_gt_total from t group by 1)
select video_id, n_selected_total, n_selected_with_gt, n_selected_missing_gt, n_gt_total, tp, fp, tn, fn, case when n_selected_with_gt > 0 then 'success' else 'failed' end as status, round(n_selected_with_gt / n_gt_total::double, 6) as coverage,
  round(case when tp + fp + tn + fn > 0 then (tp + tn) / (tp + fp + tn + fn)::double else 0 end, 6) as accuracy from c join n using (video_id)""")
def selected_frames_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _selected(spark, sf_dir)
    out = w.evaluate_selected(s, t, K, "pos")
    return out.select("video_id", "n_selected_total", "n_selected_with_gt", "n_selected_missing_gt", "n_gt_total", "tp", "fp", "tn", "fn", "status", F.round("coverage_selected_over_gt", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


@query(f"{_SEL} select video_id, pos, pred, gt, case when gt is null then 'missing_gt' when pred > gt then 'fp' else 'fn' end as kind from a where gt is null or pred <> gt")
def selected_frame_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _selected(spark, sf_dir)
    return w.errors(s, t, K, "pos").select("video_id", "pos", "pred", "gt", "kind")


@query(f"""{_S}, {_GAPPY}, {_ISLANDS.format(src='gappy')}, cells as (select s.s as seconds, f.f as fps from (values (0.02::double), (0.05), (0.1)) s(s), (values (20.0::double), (40.0)) f(f)),
sel as (select seconds, fps, video_id, (first + length // 2)::bigint as pos, pred from isl, cells where length >= ceil(seconds * fps) and not (pred = 1 and has_blue)), a as (select sel.*, gt from sel join seq s using (video_id, pos)),
a2 as (select seconds, fps, sel.pred as pred, s.gt as gt from sel join (select video_id, pos, gt from seq) s using (video_id, pos))
select seconds, fps, count(*) filter (pred = 1 and gt = 1) as tp, count(*) filter (pred = 1 and gt = 0) as fp, count(*) filter (pred = 0 and gt = 0) as tn, count(*) filter (pred = 0 and gt = 1) as fn, round(avg((pred = gt)::int), 6) as accuracy from a2 group by 1, 2""".replace(" a as (select sel.*, gt from sel join seq s using (video_id, pos)),\n", "\n"))
def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = w.sweep(gappy(spark, sf_dir), seq(spark, sf_dir).select("video_id", "pos", "gt"), K, "pos", "pred", [0.02, 0.05, 0.1], [20.0, 40.0])
    return out.select("seconds", "fps", "tp", "fp", "tn", "fn", F.round("accuracy", 6).alias("accuracy"))


_SPLIT = """parts as (select video_id, row_number() over (order by md5('42-' || video_id), video_id) - 1 as nth, count(*) over () as n from (select distinct video_id from det)),
splits as (select video_id, case when nth < case when n < 2 then 0 else greatest(1, least(n - 1, round_even(n * 0.2, 0))) end then 'val' else 'train' end as split from parts)"""
_PSEUDO = f"""with recursive det as (select {DET[1]} from {DET[0]}), {_BH}, good as (select o.* from det o join bh using (video_id, frame_number, row_id) where o.detection_type = 'object' and o.confidence >= 60
  and (o.bbox_x2 - o.bbox_x1) / greatest((o.bbox_y2 - o.bbox_y1)::double, 0.000001) between 0.5 and 2 and {_O} / greatest(bh.hand_area, 0.000001) < 1.5 and bh.inter / greatest({_O}, 0.000001) <= 0.4),
b as (select {TIMED} from good), {SIMILAR.format(src='b', gap=0.2, move=0.02, change=0.05)}, {_SPLIT},
chosen as (select good.*, split from good join kept using (video_id, row_id) join splits using (video_id)), f as (select distinct split, video_id, frame_number as frame_idx from chosen)"""


@query(f"""{_PSEUDO} select split, video_id, frame_idx, 440 as width, 300 as height, row_number() over (partition by split order by video_id, frame_idx)::int as image_id, concat(video_id, '_', lpad(frame_idx::varchar, 6, '0'), '.png') as file_name from f""")
def pseudo_label_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir)
    splits = dataset.split_by_rank(df, "video_id", 0.2, 42)
    videos = df.select("video_id").distinct().select("video_id", F.lit(440).alias("width"), F.lit(300).alias("height"), F.lit(30.0).alias("fps"))
    chosen = w.DatasetConfig(min_confidence=60, aspect=(0.5, 2.0), max_area_ratio=1.5, max_hand_overlap=0.4, gap_sec=0.2, move=0.02, area_change=0.05)
    images, _ = w.pseudo_labels(df.where("detection_type = 'object'"), df.where("detection_type = 'hand'"), splits, videos, chosen)
    return images


@query(f"""{cte(det=DET)}, {_SPLIT}, l as (select *, round(case when frame_number % 3 = 0 then 29.97 else 24.9999 end::double, 3) as fps from det where detection_type = 'object')
select 'participant' as kind, video_id::varchar as name, split, count(*) as n from l join splits using (video_id) group by 2, 3 union all select 'fps', fps::varchar, null, count(*) from l group by 2""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = det(spark, sf_dir)
    labels = df.where("detection_type = 'object'").withColumn("fps", F.when(F.col("frame_number") % 3 == 0, 29.97).otherwise(24.9999))
    by = dataset.counts_by_participant(labels, dataset.split_by_rank(df, "video_id", 0.2, 42), "video_id").select(F.lit("participant").alias("kind"), F.col("video_id").cast("string").alias("name"), "split", F.col("selected_frames").alias("n"))
    return by.unionByName(dataset.counts_by_fps(labels).select(F.lit("fps").alias("kind"), F.col("fps").cast("string").alias("name"), F.lit(None).cast("string").alias("split"), "n"))


@query(f"""{_S}, st as (select video_id, avg((pred = gt)::int) as accuracy from seq group by 1), b as (select video_id, avg(((pred = 1 and not blue)::int = gt)::int) as accuracy from seq where video_id % 4 <> 1 group by 1)
select video_id, round(st.accuracy, 6) as accuracy, round(b.accuracy, 6) as baseline_accuracy, round(st.accuracy - b.accuracy, 6) as delta_accuracy, b.accuracy is not null as has_baseline from st left join b using (video_id)""")
def strict_against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seq(spark, sf_dir)
    strict = s.groupBy("video_id").agg(metrics.accuracy())
    base = s.where("video_id % 4 <> 1").withColumn("pred", ((F.col("pred") == 1) & ~F.col("blue")).cast("int")).groupBy("video_id").agg(metrics.accuracy())
    out = metrics.with_baseline(strict, base, "video_id", ["accuracy"])
    return out.select("video_id", *[F.round(c, 6).alias(c) for c in ("accuracy", "baseline_accuracy", "delta_accuracy")], "has_baseline")


_MODES = f"""{_S}, {_GAPPY}, grp as (select distinct video_id, case when video_id % 2 = 0 then 20.0::double else 40.0::double end as fps from seq where video_id % 5 <> 4),
x as (select g.video_id, g.pos, g.pred, grp.fps, m.mode, case when g.pos % 6 <> 2 then g.blue end as flag from gappy g join grp using (video_id), (select unnest(['inner', 'left']) as mode) m),
y as (select video_id, pos, pred, fps, mode, coalesce(flag, false) as blue from x where mode = 'left' or flag is not null),
z as (select *, case when lag(pos) over w is null or lag(pred) over w <> pred or pos - lag(pos) over w <> 1 then 1 else 0 end as fresh from y window w as (partition by video_id, mode order by pos)),
rr as (select *, sum(fresh) over (partition by video_id, mode order by pos) as run from z),
isl as (select video_id, mode, fps, run, min(pred) as pred, min(pos) as first, count(*) as length, bool_or(blue) as has_blue from rr group by 1, 2, 3, 4), cells as (select unnest([0.02, 0.05, 0.1])::double as seconds),
sel as (select seconds, mode, video_id, (first + length // 2)::bigint as pos, pred from isl, cells where length >= ceil(seconds * fps) and not (pred = 1 and has_blue)),
a as (select sel.*, s.gt from sel join (select video_id, pos, gt from seq where pos % 4 <> 3) s using (video_id, pos)),
c as (select seconds, mode, count(distinct video_id) as n, {_CONF.format(p='pred')} from a group by 1, 2), grid as (select seconds, unnest(['inner', 'left']) as mode from cells),
f as (select grid.seconds, grid.mode, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(tn, 0) as tn, coalesce(fn, 0) as fn, (select count(*) from grp) - coalesce(n, 0) as n_failed from grid left join c using (seconds, mode)),
h as (select *, mode || '_' || seconds as name, case when tp + fp + tn + fn > 0 then (tp + tn) / (tp + fp + tn + fn)::double else 0 end as accuracy from f)
select name, seconds, mode, tp, fp, tn, fn, n_failed::bigint as n_failed, round(accuracy, 6) as accuracy, row_number() over (order by accuracy desc, n_failed, name) as rank from h"""


@query(_MODES)
def sweep_of_join_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gappy(spark, sf_dir)
    groups = seq(spark, sf_dir).where("video_id % 5 <> 4").select("video_id", F.when(F.col("video_id") % 2 == 0, 20.0).otherwise(40.0).alias("fps")).distinct()
    out = w.sweep_modes(s.drop("blue"), s.where("pos % 6 <> 2"), seq(spark, sf_dir).where("pos % 4 <> 3").select("video_id", "pos", "gt"), "video_id", "pos", "pred", [0.02, 0.05, 0.1], ["inner", "left"], groups)
    return out.select("name", "seconds", "mode", *metrics.COUNTS, F.col("n_failed").cast("bigint").alias("n_failed"), F.round("accuracy", 6).alias("accuracy"), F.col("rank").cast("bigint").alias("rank"))


_COCO = f"""{cte(det=DET)}, l as (select *, case when video_id % 5 = 0 then 'val' else 'train' end as split from det where detection_type = 'object'), f as (select distinct split, video_id, frame_number as frame_idx from l),
i as (select *, row_number() over (partition by split order by video_id, frame_idx) as image_id from f)"""


@query(f"""{_COCO} select l.split, i.image_id, row_number() over (partition by l.split order by i.image_id, l.row_id) as annotation_id, [l.bbox_x1::double, l.bbox_y1::double, (l.bbox_x2 - l.bbox_x1)::double, (l.bbox_y2 - l.bbox_y1)::double] as bbox,
  (l.bbox_x2 - l.bbox_x1)::double * (l.bbox_y2 - l.bbox_y1) as area from l join i on l.split = i.split and l.video_id = i.video_id and l.frame_number = i.frame_idx""")
def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = det(spark, sf_dir).where("detection_type = 'object'")
    rows = objects.withColumns({"split": F.when(F.col("video_id") % 5 == 0, "val").otherwise("train"), "width": F.lit(440), "height": F.lit(300)}).withColumnRenamed("frame_number", "frame_idx")
    return dataset.coco_tables(rows)[1].select("split", F.col("image_id").cast("bigint").alias("image_id"), F.col("annotation_id").cast("bigint").alias("annotation_id"), "bbox", "area")


@query("""with n as (select distinct l_orderkey % 500 as image_id, l_partkey % 40 as node_id from lineitem where l_partkey % 40 % 5 <> 3), e as (select l_orderkey % 500 as image_id, l_partkey % 40 as subject, l_shipdate::date::varchar[1:4] as predicate, l_suppkey % 40 as object from lineitem)
select distinct e.* from e where exists (select 1 from n where n.image_id = e.image_id and n.node_id = e.subject) and exists (select 1 from n where n.image_id = e.image_id and n.node_id = e.object)""".replace("l_shipdate::date::varchar[1:4]", "year(l_shipdate)::varchar"))
def scene_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    nodes = li.selectExpr("l_orderkey % 500 as image_id", "l_partkey % 40 as node_id").where("node_id % 5 <> 3").distinct()
    return dataset.scene_edges(li.selectExpr("l_orderkey % 500 as image_id", "l_partkey % 40 as subject", "cast(year(l_shipdate) as string) as predicate", "l_suppkey % 40 as object"), nodes)


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.windowed(ev.read_events(spark, sf_dir, False))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with f as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from f) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(ev.read_events(spark, sf_dir, False)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
