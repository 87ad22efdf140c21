"""Queries on label sequences: runs, representative frames, smoothing, scores, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as k
from ..operators import runs as r
from ..testdata import DET, GT, SEQ, cte, view
from .registry import query

_S = cte(seq=SEQ)
K = ["video_id"]


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SEQ)


def _runs(label: str, src: str, out: str) -> str:
    """{out}: {src} with run, counting up where the label changes."""
    return f"""{out}_f as (select *, case when lag({label}) over w is null or lag({label}) over w <> {label} then 1 else 0 end as fresh from {src} window w as (partition by video_id order by pos)),
{out} as (select * exclude (fresh), sum(fresh) over (partition by video_id order by pos)::bigint as run from {out}_f)"""


_ISLANDS = """isl_f as (select *, case when lag(pos) over w is null or lag(pred) over w <> pred or pos - lag(pos) over w <> 1 then 1 else 0 end as fresh from {src} window w as (partition by video_id order by pos)),
isl_r as (select *, sum(fresh) over (partition by video_id order by pos)::bigint as run from isl_f),
isl as (select video_id, run, min(pred) as pred, min(pos) as first, max(pos) as last, count(*) as length, bool_or(blue) as has_blue from isl_r group by 1, 2)"""
#: Every eleventh frame is missing, so that islands also end at gaps.
_GAPPY = "gappy as (select * from seq where pos % 11 <> 7)"


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq(spark, sf_dir).where("pos % 11 <> 7")


@query(f"{_S}, {_GAPPY}, {_ISLANDS.format(src='gappy')} select * from isl")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.islands(gappy(spark, sf_dir), K, "pos", "pred", "blue")


@query(f"""{_S}, {_GAPPY}, {_ISLANDS.format(src='gappy')}
select video_id, run, pred, first + length // 2 as frame, first, last, length from isl where length >= ceil(0.05 * 40) and not (pred = 1 and has_blue)""")
def representative_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.islands(gappy(spark, sf_dir), K, "pos", "pred", "blue")
    out = r.pass_islands(found, r.least_frames(0.05, F.lit(40)), "pred", "blue").where("selected")
    return out.select("video_id", "run", "pred", r.middle().alias("frame"), "first", "last", "length")


@query(f"""{_S}, {_GAPPY}, {_ISLANDS.format(src='gappy')}
select video_id, count(*) as found, count(*) filter (length >= 2) as passed, count(*) filter (length >= 2 and pred = 1 and has_blue) as vetoed, count(*) filter (length >= 2 and not (pred = 1 and has_blue)) as selected from isl group by 1""")
def island_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = r.pass_islands(r.islands(gappy(spark, sf_dir), K, "pos", "pred", "blue"), F.lit(2), "pred", "blue")
    veto = (F.col("pred") == 1) & F.col("has_blue")
    return out.groupBy("video_id").agg(F.count("*").alias("found"), F.count_if("long_enough").alias("passed"), F.count_if(F.col("long_enough") & veto).alias("vetoed"), F.count_if("selected").alias("selected"))


@query(f"""{_S}, {_GAPPY}, n as (select distinct video_id, pos from gappy), d as (select *, pos - row_number() over (partition by video_id order by pos) as gap from n)
select video_id, min(pos) as first, max(pos) as last, count(*) as length from d group by video_id, gap""")
def integer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.integer_segments(gappy(spark, sf_dir), K, "pos")


@query(f"""{_S} select video_id, pos, pred, next_label from (select *, lead(pred) over (partition by video_id order by pos) as next_label from seq) where next_label is null or next_label <> pred""")
def run_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.last_of_runs(seq(spark, sf_dir), K, "pos", "pred").select("video_id", "pos", "pred", "next_label")


@query(f"""{_S}, {_runs('pred', 'seq', 'rr')}, t as (select *, count(*) over (partition by video_id, run) as n, row_number() over (partition by video_id, run order by pos) - 1 as nth from rr)
select video_id, pos, run from t where pred = 1 and n >= 3 and nth >= floor(0.25 * (n - 1)) and nth < n - floor(0.25 * (n - 1))""")
def trimmed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.trimmed_runs(seq(spark, sf_dir), K, "pos", "pred", 1, 3, 0.25).select("video_id", "pos", "run")


@query(f"""{_S}, {_runs('pred', 'seq', 'r1')}, a as (select * exclude (run), case when pred = 1 and count(*) over (partition by video_id, run) <= 1 then 0 else pred end as a from r1),
{_runs('a', 'a', 'r2')} select video_id, pos, pred, case when a = 0 and count(*) over (partition by video_id, run) <= 2 then 1 else a end as smooth from r2""")
def smoothed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.smoothed(seq(spark, sf_dir), K, "pos", "pred", 1, 2).select("video_id", "pos", "pred", "smooth")


_CHANGEPOINTS = """with p as (select l_orderkey % 100 as video_id, l_partkey % 200 as hold, case when l_linenumber = 7 then null else l_partkey % 200 + l_suppkey % 5 end as release from lineitem),
len as (select distinct video_id, 120 + video_id as n from p), f as (select video_id, unnest(generate_series(0, n - 1)) as frame from len)
select f.video_id, f.frame, max(case when p.hold <= f.frame and f.frame < coalesce(p.release, l.n) then 1 else 0 end) as label from f join len l using (video_id) left join p on p.video_id = f.video_id group by 1, 2"""


@query(_CHANGEPOINTS)
def changepoint_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = li.selectExpr("l_orderkey % 100 as video_id", "l_partkey % 200 as hold", "case when l_linenumber = 7 then null else l_partkey % 200 + l_suppkey % 5 end as release")
    return r.from_changepoints(p, K, p.select("video_id").distinct().withColumn("n", 120 + F.col("video_id")))


@query(f"""{_S}, n as (select video_id, pos, row_number() over (partition by video_id order by pos) - 1 as nth, count(*) over (partition by video_id) as n from seq)
select video_id, pos from n where n <= 7 or list_contains([floor(i * (n - 1) / 6)::bigint for i in range(0, 7)], nth)""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.even_sample(seq(spark, sf_dir), K, "pos", 7).select("video_id", "pos")


@query("""with recursive o as (select row_number() over (partition by user_id order by ts, event_id) as nth, user_id as video_id, event_id, epoch_us(ts) / 1000000.0::double as t from events),
kept as (select video_id, nth, event_id, t from o where nth = 1 union all select x.video_id, x.nth, x.event_id, x.t from kept k, lateral (select o.* from o where o.video_id = k.video_id and o.nth > k.nth and o.t - k.t >= 90000 order by o.nth limit 1) x)
select video_id, event_id from kept""")
def subsampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as video_id", "unix_micros(cast(ts as timestamp)) / 1000000D as time_sec", "event_id as frame_idx", "event_id as row_id")
    return r.subsample(e, K, 90000.0).select("video_id", F.col("row_id").alias("event_id"))


#: The last-kept rule of ``similarity_filter`` over {src} (video_id, t, row_id, cx, cy, area), as table kept.
SIMILAR = """o as (select *, row_number() over (partition by video_id order by t, row_id) as nth from {src}),
kept as (select * from o where nth = 1 union all select x.* from kept k, lateral (select o.* from o where o.video_id = k.video_id and o.nth > k.nth and o.t - k.t >= {gap} and sqrt(power(o.cx - k.cx, 2) + power(o.cy - k.cy, 2)) > {move} * 440
  and abs(o.area - k.area) / greatest(0.000001, k.area) > {change} order by o.nth limit 1) x)"""
TIMED = "video_id, frame_number / 30.0::double as t, row_id, (bbox_x1 + bbox_x2) / 2.0::double as cx, (bbox_y1 + bbox_y2) / 2.0::double as cy, greatest(0, bbox_x2 - bbox_x1)::double * greatest(0, bbox_y2 - bbox_y1) as area"


@query(f"with recursive det as (select {DET[1]} from {DET[0]}), b as (select {TIMED} from det where detection_type = 'object'), {SIMILAR.format(src='b', gap=0.5, move=0.05, change=0.1)} select video_id, row_id from kept")
def similarity_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import boxes
    from .detections import det

    b = boxes.box()
    cx, cy = boxes.centre(b)
    df = det(spark, sf_dir).where("detection_type = 'object'").select("video_id", (F.col("frame_number") / 30).alias("time_sec"), F.col("row_id").alias("frame_idx"), "row_id", cx.alias("cx"), cy.alias("cy"), boxes.area(b).alias("area"), F.lit(440).alias("width"))
    return r.similarity_filter(df, K, 0.5, 0.05, 0.1).select("video_id", "row_id")


_SHAPES = """with i as (select l_orderkey * 8 + l_linenumber as image_id, min(l_partkey % 300 + 50) as width, min(l_suppkey % 90 + 60) as height from lineitem group by 1),
r as (select *, greatest(0.5::double, least(2.0::double, width::double / height)) as ratio, width::double / height < 0.5 or width::double / height > 2 as need_crop from i),
n as (select *, row_number() over (order by ratio, image_id) - 1 as rank from r), b as (select *, rank // 16 as batch from n)
select image_id, batch, need_crop, round(case when max(ratio) over w < 1 then min(ratio) over w when min(ratio) over w > 1 then max(ratio) over w else 1 end, 6) as target_ratio from b window w as (partition by batch)"""


@query(_SHAPES)
def shape_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    images = li.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("image_id")).agg(F.min(F.col("l_partkey") % 300 + 50).alias("width"), F.min(F.col("l_suppkey") % 90 + 60).alias("height"))
    return r.batches_by_shape(images, 16).select("image_id", F.col("batch").cast("bigint").alias("batch"), "need_crop", F.round("target_ratio", 6).alias("target_ratio"))


_CONF = "count(*) filter ({p} = 1 and gt = 1) as tp, count(*) filter ({p} = 1 and gt = 0) as fp, count(*) filter ({p} = 0 and gt = 0) as tn, count(*) filter ({p} = 0 and gt = 1) as fn"
_DIV = "case when {b} > 0 then {a} / ({b}) else 0 end"


def _rates_sql(src: str, out: str) -> str:
    d = lambda a, b: _DIV.format(a=f"({a})::double", b=b)
    return f"""{out}_1 as (select *, {d('tp', '(tp + fp)')} as positive_precision, {d('tp', '(tp + fn)')} as positive_recall, {d('tn', '(tn + fn)')} as negative_precision, {d('tn', '(tn + fp)')} as negative_recall,
  tp + fn as positive_support, tn + fp as negative_support, {d('tp + tn', '(tp + fp + tn + fn)')} as accuracy from {src}),
{out}_2 as (select *, {d('2 * positive_precision * positive_recall', '(positive_precision + positive_recall)')} as positive_f1, {d('2 * negative_precision * negative_recall', '(negative_precision + negative_recall)')} as negative_f1 from {out}_1),
{out} as (select *, (positive_f1 + negative_f1) / 2 as macro_f1 from {out}_2)"""


_ROUNDED = ", ".join(f"round({x}, 6) as {x}" for x in k.RATES)


@query(f"{_S}, c as (select video_id, {_CONF.format(p='pred')} from seq group by 1), {_rates_sql('c', 'm')} select video_id, tp, fp, tn, fn, positive_support, negative_support, {_ROUNDED} from m")
def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.by_dataset(seq(spark, sf_dir), K).select("video_id", *k.COUNTS, "positive_support", "negative_support", *[F.round(x, 6).alias(x) for x in k.RATES])


@query(f"""{_S}, c as (select video_id, {_CONF.format(p='pred')} from seq group by 1), s as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(tn)::bigint as tn, sum(fn)::bigint as fn from c), {_rates_sql('s', 'm')},
{_rates_sql('c', 'd')} select 'micro' as kind, tp, fp, tn, fn, {_ROUNDED} from m union all
select 'macro', sum(tp)::bigint, sum(fp)::bigint, sum(tn)::bigint, sum(fn)::bigint, {", ".join(f"round(avg({x}), 6)" for x in k.RATES)} from d""")
def global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = k.by_dataset(seq(spark, sf_dir), K)
    show = lambda df, kind: df.select(F.lit(kind).alias("kind"), *[F.col(c).cast("bigint").alias(c) for c in k.COUNTS], *[F.round(x, 6).alias(x) for x in k.RATES])
    return show(k.micro(d), "micro").unionByName(show(k.macro(d), "macro"))


_SEG = """{o}_x as (select video_id, run, min({l}) as label, min(pos) as s, max(pos) + 1 as e from {o} group by 1, 2),
{o}_s as (select *, row_number() over (partition by video_id order by s) - 1 as nth from {o}_x where label <> 0)"""
_F1 = f"""{_runs('pred', 'seq', 'p')}, {_runs('gt', 'seq', 'g')}, {_SEG.format(o='p', l='pred')}, {_SEG.format(o='g', l='gt')},
o as (select p_s.video_id, p_s.nth, g_s.nth as gn, greatest(0, least(p_s.e, g_s.e) - greatest(p_s.s, g_s.s))::double / (greatest(p_s.e, g_s.e) - least(p_s.s, g_s.s)) as iou from p_s join g_s on p_s.video_id = g_s.video_id and p_s.label = g_s.label),
b as (select * from o qualify row_number() over (partition by video_id, nth order by iou desc, gn) = 1),
h as (select video_id, count(distinct gn) filter (iou >= 0.1) as t10, count(distinct gn) filter (iou >= 0.25) as t25, count(distinct gn) filter (iou >= 0.5) as t50 from b group by 1),
n as (select video_id, (select count(*) from p_s where p_s.video_id = v.video_id) as n_pred, (select count(*) from g_s where g_s.video_id = v.video_id) as n_gt from (select distinct video_id from seq) v)"""


@query(f"""{_S}, {_F1} select n.video_id, n_pred, n_gt, {", ".join(f"round(200.0::double * coalesce(t{t}, 0) / (n_pred + n_gt), 6) as f1_{t}" for t in (10, 25, 50))} from n left join h using (video_id) where n_pred + n_gt > 0""")
def segmental_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seq(spark, sf_dir)
    out = k.segmental_f1(k.segments(s, K, "pos", "pred"), k.segments(s, K, "pos", "gt"), K)
    return out.select("video_id", "n_pred", "n_gt", *[F.round(f"f1_{t}", 6).alias(f"f1_{t}") for t in (10, 25, 50)])


@query(f"""{_S}, {_runs('pred', 'seq', 'p')}, {_runs('gt', 'seq', 'g')}, a as (select video_id, string_agg(label, '' order by run) as a from (select video_id, run, min(pred)::varchar as label from p group by 1, 2) group by 1),
b as (select video_id, string_agg(label, '' order by run) as b from (select video_id, run, min(gt)::varchar as label from g group by 1, 2) group by 1)
select video_id, round((1 - levenshtein(a, b)::double / greatest(length(a), length(b))) * 100, 6) as edit from a join b using (video_id)""")
def edit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With no background class, so that both labels' segments count."""
    s = seq(spark, sf_dir)
    return k.edit_score(k.segments(s, K, "pos", "pred", ()), k.segments(s, K, "pos", "gt", ()), K).select("video_id", F.round("edit", 6).alias("edit"))


@query(f"""{_S}, {_F1}, c as (select video_id, avg((pred = gt)::int) as acc, count(*) as n_frames, {_CONF.format(p='pred')} from seq group by 1)
select c.video_id, round(acc, 6) as accuracy, n_frames, tp, fp, tn, fn, round(coalesce(200.0::double * t50 / (n_pred + n_gt), 0), 6) as f1_50,
  round(case when greatest(n_pred, n_gt) > 0 then (1 - abs(n_pred - n_gt)::double / greatest(n_pred, n_gt)) * 100 else 0 end, 6) as edit from c join n using (video_id) left join h using (video_id)""")
def evaluation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seq(spark, sf_dir).withColumn("pred", F.when(F.col("pred") == 1, 0.7).otherwise(0.3))
    return k.evaluate(s, K, "pos").select("video_id", F.round("accuracy", 6).alias("accuracy"), "n_frames", *k.COUNTS, F.round("f1_50", 6).alias("f1_50"), F.round("edit", 6).alias("edit"))


@query(f"""{_S}, c as (select video_id::varchar as dataset_key, count(*) as n_frames, round(avg((pred = gt)::int), 4) as mof, {_CONF.format(p='pred')} from seq group by 1)
select dataset_key, n_frames, mof, tp, fp, tn, fn from c union all
select '__macro__', sum(n_frames)::bigint, round(avg(mof), 4), sum(tp)::bigint, sum(fp)::bigint, sum(tn)::bigint, sum(fn)::bigint from c union all
select '__weighted__', sum(n_frames)::bigint, round(sum(mof * n_frames) / sum(n_frames)::double, 4), sum(tp)::bigint, sum(fp)::bigint, sum(tn)::bigint, sum(fn)::bigint from c""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seq(spark, sf_dir).groupBy(F.col("video_id").alias("dataset_key")).agg(F.count("*").alias("n_frames"), k.accuracy().alias("mof"), *k.confusion())
    return k.batch_summary(d, "dataset_key", ["mof"], list(k.COUNTS), "n_frames")


@query("""select l_returnflag, l_linestatus, count(*)::bigint as count, min(l_quantity) as min, max(l_quantity) as max, round(avg(l_quantity), 6) as mean, median(l_quantity) as median, round(stddev_pop(l_quantity), 6) as std from lineitem group by 1, 2""")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = k.summary_stats(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return out.select("l_returnflag", "l_linestatus", "count", "min", "max", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"))


_CELLS = f"""{cte(det=DET)}, c as (select video_id, least(floor((bbox_x1 + bbox_x2) / 2 / 440.0::double * 8), 7)::int as bin_x, least(floor((bbox_y1 + bbox_y2) / 2 / 300.0::double * 6), 5)::int as bin_y from det
  where (bbox_x1 + bbox_x2) / 2 / 440.0::double between 0 and 1 and (bbox_y1 + bbox_y2) / 2 / 300.0::double between 0 and 1), n as (select video_id, bin_x, bin_y, count(*) as n from c group by 1, 2, 3)"""


@query(f"{_CELLS.replace('* 6), 5)', '* 8), 7)')} select * from n")
def centre_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heat(spark, sf_dir)


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .detections import det

    x, y = (F.col("bbox_x1") + F.col("bbox_x2")) / 2 / F.lit(440.0), (F.col("bbox_y1") + F.col("bbox_y2")) / 2 / F.lit(300.0)
    return k.heatmap(det(spark, sf_dir), K, x, y, 8)


@query(f"{_CELLS.replace('* 6), 5)', '* 8), 7)')} select video_id, round(-sum(n / t * log2(n / t)), 6) as entropy_bits, count(*) as occupied from (select *, sum(n) over (partition by video_id)::double as t from n) group by 1")
def heatmap_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.entropy(_heat(spark, sf_dir), K).select("video_id", F.round("entropy_bits", 6).alias("entropy_bits"), "occupied")


_COV = f"""{cte(det=DET, gt=GT)}, p as (select distinct video_id, frame_number as f from det where row_id % 3 = 0), g as (select distinct video_id, frame_number as f from gt where frame_number % 7 <> 3 and frame_number < 480),
b as (select coalesce(p.video_id, g.video_id) as video_id, coalesce(p.f, g.f) as f, p.f is not null as p, g.f is not null as g from p full join g on p.video_id = g.video_id and p.f = g.f),
a as (select video_id, count(*) filter (p) as pred_n, count(*) filter (g) as gt_n, count(*) filter (p and g) as overlap_n, count(*) filter (p and not g) as missing_gt, count(*) filter (g and not p) as missing_pred,
  min(f) filter (p) as pred_min, max(f) filter (p) as pred_max, min(f) filter (g) as gt_min, max(f) filter (g) as gt_max, min(f) filter (p and not g) as fm from b group by 1),
audit as (select * exclude (fm), case when pred_n > 0 then round(overlap_n / pred_n::double, 6) end as gt_over_pred, case when gt_n > 0 then round(overlap_n / gt_n::double, 6) end as pred_over_gt, coalesce(fm > gt_max, false) as missing_tail_only from a)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, DET).where("row_id % 3 = 0")
    return k.coverage(p, view(spark, sf_dir, GT).where("frame_number % 7 <> 3 and frame_number < 480"), "video_id", "frame_number")


@query(f"""{_COV}, m as (select video_id, p, f, f - row_number() over (partition by video_id, p order by f) as run from b where p <> g), s as (select video_id, p, min(f) as first, max(f) as last, count(*) as n from m group by video_id, p, run),
t as (select video_id, string_agg('[' || first || ',' || last || ',' || n || ']', ',' order by first) filter (p) as x, string_agg('[' || first || ',' || last || ',' || n || ']', ',' order by first) filter (not p) as y from s group by 1)
select a.video_id, '[' || coalesce(x, '') || ']' as missing_gt_segments, '[' || coalesce(y, '') || ']' as missing_pred_segments from (select distinct video_id from b) a left join t on a.video_id = t.video_id""")
def missing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames that only one side has, as JSON."""
    p = view(spark, sf_dir, DET).where("row_id % 3 = 0")
    return k.missing_segments(p, view(spark, sf_dir, GT).where("frame_number % 7 <> 3 and frame_number < 480"), "video_id", "frame_number")


@query(f"{_COV} select * from audit")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, sf_dir)


@query(f"{_COV} select count(*) as n, sum(pred_n)::bigint as pred_n, sum(overlap_n)::bigint as overlap_n, round(avg(gt_over_pred), 6) as macro, round(sum(overlap_n) / sum(pred_n)::double, 6) as weighted, count(*) filter (missing_tail_only) as n_tail_only from audit")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.coverage_summary(audit(spark, sf_dir))


@query(f"{_COV} select video_id from audit where coalesce(gt_over_pred < 0.8, true) or (missing_gt > 0 and not missing_tail_only)")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.coverage_gates(audit(spark, sf_dir), 0.8).select("video_id")


_DIAG = f"""{_S}, c as (select video_id::varchar as dataset_key, count(*) as n_selected, count(*) filter (pos % 5 <> 0) as n_aligned, count(*) * 3 as n_gt,
  count(*) filter (pos % 5 <> 0 and pred = 1 and gt = 1) as tp, count(*) filter (pos % 5 <> 0 and pred = 1 and gt = 0) as fp, count(*) filter (pos % 5 <> 0 and pred = 0 and gt = 0) as tn, count(*) filter (pos % 5 <> 0 and pred = 0 and gt = 1) as fn from seq group by 1),
d as (select *, fp + fn as mismatch, tp + fp as pred_pos, tp + fn as gt_pos, case when tp + fp > 0 then fp / (tp + fp)::double end as fp_rate, case when tp + fn > 0 then fn / (tp + fn)::double end as fn_rate, n_aligned / n_gt::double as density,
  case when n_selected > 0 then n_aligned / n_selected::double end as aligned_share, case when n_aligned > 0 then (tp + fn) / n_aligned::double end as gt_pos_rate, case when n_aligned > 0 then (tp + tn) / n_aligned::double end as accuracy, case when n_aligned > 50 then 'success' else 'failed' end as status from c)"""


def _diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.col("pos") % 5 != 0
    s = seq(spark, sf_dir).withColumn("pred", F.when(some, F.col("pred")))
    c = s.groupBy(F.col("video_id").cast("string").alias("dataset_key")).agg(F.count("*").alias("n_selected"), F.count_if(some).alias("n_aligned"), (F.count("*") * 3).alias("n_gt"), *k.confusion())
    d = k.diagnostics(c)
    return d.withColumns({"accuracy": F.when(F.col("n_aligned") > 0, (F.col("tp") + F.col("tn")) / F.col("n_aligned")), "status": F.when(F.col("n_aligned") > 50, "success").otherwise("failed")})


_DCOLS = ("fp_rate", "fn_rate", "density", "aligned_share", "gt_pos_rate")


@query(f"{_DIAG} select dataset_key, mismatch, pred_pos, gt_pos, {', '.join(f'round({c}, 6) as {c}' for c in _DCOLS)} from d")
def error_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diag(spark, sf_dir).select("dataset_key", "mismatch", "pred_pos", "gt_pos", *[F.round(c, 6).alias(c) for c in _DCOLS])


@query(f"""{_DIAG}, s as (select dataset_key, case when status <> 'success' then 1000.0::double else 0 end + coalesce((1 - accuracy) * 50, 50) + (fp + fn) * 10.0::double + case when n_aligned < 5 then 20.0::double else 0 end + coalesce((1 - aligned_share) * 20, 0) as score from d)
select dataset_key, round(score, 6) as priority_score, row_number() over (order by round(score, 9) desc, dataset_key) as priority_rank from s""")
def dataset_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.priorities(_diag(spark, sf_dir)).select("dataset_key", F.round("priority_score", 6).alias("priority_score"), F.col("priority_rank").cast("bigint").alias("priority_rank"))


@query(f"""{_S}, {_runs('pred', 'seq', 'p')}, {_runs('gt', 'seq', 'g')}, a as (select video_id, label, row_number() over (partition by video_id, label order by s) as k, e - s as a from (select video_id, run, min(pred) as label, min(pos) as s, max(pos) + 1 as e from p group by 1, 2)),
b as (select video_id, label, row_number() over (partition by video_id, label order by s) as k, e - s as b from (select video_id, run, min(gt) as label, min(pos) as s, max(pos) + 1 as e from g group by 1, 2)),
x as (select coalesce(a.video_id, b.video_id) as video_id, coalesce(a.label, b.label) as label, a, b from a full join b on a.video_id = b.video_id and a.label = b.label and a.k = b.k)
select video_id, label, round(avg(abs(a - b)), 6) as maed, round(avg(a - b), 6) as msde, count(*) filter (a is null) as missed, count(*) filter (b is null) as extra from x group by 1, 2""")
def segment_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seq(spark, sf_dir)
    out = k.segment_durations(k.segments(s, K, "pos", "pred", ()), k.segments(s, K, "pos", "gt", ()), K)
    return out.select("video_id", "label", F.round("maed", 6).alias("maed"), F.round("msde", 6).alias("msde"), "missed", "extra")


def _aligned_sql(kind: str) -> str:
    join, gt = {"drop": ("join", "g.gt"), "zero": ("left join", "coalesce(g.gt, 0)"), "count": ("left join", "g.gt")}[kind]
    return f"""{cte(det=DET, gt=GT)}, p as (select distinct video_id, frame_number from det where row_id % 2 = 0), g as (select * from gt where frame_number % 4 <> 1)
select p.video_id, p.frame_number, {gt} as gt from p {join} g on p.video_id = g.video_id and p.frame_number = g.frame_number"""


def _aligned(spark: SparkSession, sf_dir: str, missing: str) -> DataFrame:
    from ..operators.matching import aligned

    p = view(spark, sf_dir, DET).where("row_id % 2 = 0").select("video_id", "frame_number").distinct()
    return aligned(p, view(spark, sf_dir, GT).where("frame_number % 4 <> 1"), ["video_id", "frame_number"], missing)


@query(_aligned_sql("drop"))
def aligned_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, "drop")


@query(_aligned_sql("zero"))
def aligned_missing_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, "zero")


@query(_aligned_sql("count"))
def aligned_missing_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, "count")


@query(f"""{_S}, w0 as (select *, case when pred = 1 or gt = 1 then 1 else 0 end as any_contact, case when pred = 1 and gt = 1 then 1 else 0 end as both_contact from seq), {_runs('both_contact', 'w0', 'wr')},
t as (select *, count(*) over (partition by video_id, run) as n, row_number() over (partition by video_id, run order by pos) - 1 as nth from wr),
l as (select video_id, pos, 0 as weak from w0 where any_contact = 0 union all select video_id, pos, 1 from t where both_contact = 1 and n >= 2 and nth >= floor(0.2 * (n - 1)) and nth < n - floor(0.2 * (n - 1)))
select weak, count(*) as n, count(*) filter (weak = gt) as "right", round(count(*) filter (weak = gt) / count(*)::double, 6) as precision from l join seq using (video_id, pos) group by 1""")
def weak_label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = F.col("pred") == 1, F.col("gt") == 1
    s = seq(spark, sf_dir).withColumns({"any_contact": (p | g).cast("int"), "both_contact": (p & g).cast("int")})
    weak = r.weak_labels(s, K, "pos", "any_contact", "both_contact", 2, 0.2)
    out = k.label_precision(weak.join(s.select("video_id", "pos", "gt"), ["video_id", "pos"]), "weak", "gt")
    return out.select("weak", "n", "right", F.round("precision", 6).alias("precision"))


@query(f"{_DIAG}, s as (select dataset_key, case when status <> 'success' then 1000.0::double else 0 end + coalesce((1 - accuracy) * 50, 50) + (fp + fn) * 10.0::double + case when n_aligned < 5 then 20.0::double else 0 end + coalesce((1 - aligned_share) * 20, 0) as score from d) select dataset_key, round(score, 6) as priority_score from s order by round(score, 9) desc, dataset_key limit 5")
def top_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is its point."""
    return k.top(k.priorities(_diag(spark, sf_dir)), 5, F.desc(F.round("priority_score", 9)), F.col("dataset_key")).select("dataset_key", F.round("priority_score", 6).alias("priority_score"))


@query("""with i as (select distinct l_partkey % 900 + 100 as width, l_suppkey % 80 * 10 + 100 as height from lineitem)
select width, height, round(case when round(600 / least(width, height)::double * greatest(width, height)) > 1000 then 1000 / greatest(width, height)::double else 600 / least(width, height)::double end, 9) as scale, floor(width * 640 / 1000.0::double)::bigint as edge from i""")
def image_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import images

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_partkey % 900 + 100 as width", "l_suppkey % 80 * 10 + 100 as height").distinct()
    return li.select("width", "height", F.round(images.image_scale(F.col("width"), F.col("height")), 9).alias("scale"), images.timeline_edge(F.col("width"), F.lit(1000), 640).alias("edge"))
