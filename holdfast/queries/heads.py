"""Queries on losses, on a head fitted over a table, and on features of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import losses
from ..operators import heads, pooling
from ..staging import staged
from ..testdata import DET, cte
from .detections import det
from .registry import query

_P = ["(bbox_x1 - 200) / 100.0", "(bbox_y1 - 100) / 50.0", "confidence / 25.0 - 3"]
_T = ["(bbox_x2 - 240) / 100.0", "(bbox_y2 - 140) / 50.0", "row_id % 4 - 2.0"]
_ROW = " + ".join(f"case when abs({p.replace('.0', '.0::double')} - ({t.replace('.0', '.0::double')})) < 1 / 9.0::double then 4.5 * power({p.replace('.0', '.0::double')} - ({t.replace('.0', '.0::double')}), 2) else abs({p.replace('.0', '.0::double')} - ({t.replace('.0', '.0::double')})) - 0.5 / 9 end" for p, t in zip(_P, _T, strict=True))
_E = [f"exp(({p.replace('.0', '.0::double')}))" for p in _P]


@query(f"""{cte(det=DET)} select video_id, round(avg({_ROW}), 6) as boxes, round(avg(ln({' + '.join(_E)}) - case row_id % 3 when 0 then {_P[0]} when 1 then {_P[1]} else {_P[2]} end), 6) as states from det group by video_id""")
def head_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean losses of each video: smooth L1 of three values with sigma 3, and cross entropy of three scores."""
    d = det(spark, sf_dir)
    p, t = (F.array(*[F.expr(f"cast({x} as double)") for x in some]) for some in (_P, _T))
    rows = d.select("video_id", losses.smooth_l1(p, t, sigma=3.0).alias("b"), losses.cross_entropy(p, F.col("row_id") % 3).alias("s"))
    return rows.groupBy("video_id").agg(F.round(F.avg("b"), 6).alias("boxes"), F.round(F.avg("s"), 6).alias("states"))


def _fit_sql(steps: int, rate: float) -> str:
    """Each step written out: scores, softmax, the gradient's sums by class, velocity and weights."""
    out = []
    for k in range(steps):
        out.append(f"""s{k} as (select d.*, w.*, w1 * x1 + w2 * x2 + b as s from d, w{k} w), p{k} as (select *, exp(s - max(s) over (partition by id)) as e from s{k}),
g{k} as (select c, sum(g * x1) / count(*) as g1, sum(g * x2) / count(*) as g2, sum(g) / count(*) as gb from (select *, e / sum(e) over (partition by id) - (c = y)::int as g from p{k}) group by c),
u{k} as (select w.c, w1, w2, b, 0.9 * v1 + g1 + 0.0005 * w1 as v1, 0.9 * v2 + g2 + 0.0005 * w2 as v2, 0.9 * vb + gb as vb from w{k} w join g{k} g on w.c = g.c),
w{k + 1} as materialized (select c, w1 - {rate} * v1 as w1, w2 - {rate} * v2 as w2, b - {2 * rate} * vb as b, v1, v2, vb from u{k})""")
    return ",\n".join(out)


@query(f"""{cte(det=DET)}, d as materialized (select row_number() over () as id, (bbox_x2 - bbox_x1) / 100.0::double as x1, (bbox_y2 - bbox_y1) / 100.0::double as x2, coalesce(contact_state, 5) // 2 as y from det),
w0 as (select unnest([0, 1, 2]) as c, 0.0::double as w1, 0.0::double as w2, 0.0::double as b, 0.0::double as v1, 0.0::double as v2, 0.0::double as vb),
{_fit_sql(4, 0.5)} select c as state, round(w1, 6) as width, round(w2, 6) as height, round(b, 6) as bias from w4""")
def fitted_contact_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four steps of a head that tells three groups of contact states by a box's size."""
    d = det(spark, sf_dir)
    rows = d.select(F.array((F.col("bbox_x2") - F.col("bbox_x1")) / 100.0, (F.col("bbox_y2") - F.col("bbox_y1")) / 100.0).alias("features"), F.floor(F.coalesce("contact_state", F.lit(5)) / 2).cast("int").alias("target"))
    head = heads.fit(staged(rows, "features"), 2, 3, "softmax", heads.FitConfig(steps=4, rate=0.5))
    return spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(head.weights.round(6))], "state int, width double, height double, bias double")


_SAMPLE = "({low} + ({i} // 2 + ({i} % 2 + 0.5) / 2) * {size} / 2)"


@query(f"""{cte(det=DET)}, f as (select video_id, frame_number % 48 as cell, avg(confidence) as v from det group by all),
r as (select video_id, row_id, bbox_x1 / 50.0::double as x1, bbox_y1 / 50.0::double as y1, greatest((bbox_x2 - bbox_x1) / 50.0::double, 1) as w, greatest((bbox_y2 - bbox_y1) / 50.0::double, 1) as h from det where detection_type = 'object'),
s as (select *, {_SAMPLE.format(low="y1", i="i", size="h")} as y, {_SAMPLE.format(low="x1", i="j", size="w")} as x from r, (select unnest(range(4)) as i), (select unnest(range(4)) as j)),
n as (select *, greatest(0, y) as py, greatest(0, x) as px, least(floor(greatest(0, y))::int, 5) as yl, least(floor(greatest(0, x))::int, 7) as xl, y >= -1 and y <= 6 and x >= -1 and x <= 8 as inside from s),
q as (select *, case when yl = 5 then 0 else py - yl end as ly, case when xl = 7 then 0 else px - xl end as lx, unnest([0, 0, 1, 1]) as a, unnest([0, 1, 0, 1]) as b from n),
z as (select video_id, row_id, (i // 2) * 2 + j // 2 as bin, i, j, inside, case when a = 1 then ly else 1 - ly end * case when b = 1 then lx else 1 - lx end as weight, least(yl + a, 5) * 8 + least(xl + b, 7) as cell from q)
select z.video_id, row_id, bin, round(sum(case when inside then weight * coalesce(v, 0) else 0 end) / 4 + 0.000000003, 5) as value from z left join f on z.video_id = f.video_id and z.cell = f.cell group by all""")
def aligned_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's four bins in a feature map of 6 x 8 cells, one for each video."""
    d = det(spark, sf_dir)
    cells = d.groupBy("video_id", (F.col("frame_number") % 48).alias("cell")).agg(F.avg("confidence").alias("v"))
    known = F.map_from_entries(F.collect_list(F.struct("cell", "v")))
    maps = cells.groupBy(F.col("video_id").alias("image_id")).agg(known.alias("m")).select("image_id", F.lit(1).alias("channels"), F.lit(6).alias("height"), F.lit(8).alias("width"), F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(47).cast("bigint")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("features"))
    rois = d.where("detection_type = 'object'").select(F.col("video_id").alias("image_id"), F.col("row_id").alias("roi_id"), *[F.col(f"bbox_{k}").alias(k) for k in ("x1", "y1", "x2", "y2")])
    found = pooling.region_features(maps, rois, (2, 2), 1 / 50, sampling=2)
    return found.select(F.col("image_id").alias("video_id"), F.col("roi_id").alias("row_id"), F.posexplode("pooled").alias("bin", "v")).select("video_id", "row_id", F.col("bin").cast("bigint").alias("bin"), F.round(F.col("v") + 0.000000003, 5).alias("value"))


_CHOICE = "{low} + (('0x' || substr(md5('7-' || image_id), 1, 12))::bigint % greatest({high} - ({low}), 1))"
_START = f"""case when {{first}} = 0 then 0 when {{last}} - {{first}} + 1 < {{trim}} then case when greatest({{last}} - {{trim}}, 0) = least({{first}}, {{length}} - {{trim}}) then greatest({{last}} - {{trim}}, 0) else {_CHOICE.format(low='greatest({last} - {trim}, 0)', high='least({first}, {length} - {trim})')} end
  when floor(({{last}} - {{first}} + 1 - {{trim}}) / 2.0) = 0 then {{first}} else {_CHOICE.format(low='{first}', high='({first} + floor(({last} - {first} + 1 - {trim}) / 2.0)::bigint)')} end"""


@query(f"""{cte(det=DET)}, f as (select video_id * 512 + frame_number as image_id, 300 + frame_number % 7 * 100 as w, 250 + video_id % 5 * 90 as h, bbox_x1 as x1, bbox_y1 as y1, bbox_x2 as x2, bbox_y2 as y2, row_id % 5 as cls from det where detection_type = 'object'),
i as (select image_id, w, h, min(x1) as fx, min(y1) as fy, max(x2) as lx, max(y2) as ly, least(2.0::double, greatest(0.5::double, w / h::double)) as ratio, w / h::double < 0.5 or w / h::double > 2 as crop from f group by all),
t as (select *, least(floor(w / ratio)::bigint, h) as tall, least(ceil(h * ratio)::bigint, w) as wide from i),
c as (select *, case when crop and ratio < 1 then {_START.format(first='fy', last='ly', trim='tall', length='h')} else 0 end as top, case when crop and ratio >= 1 then {_START.format(first='fx', last='lx', trim='wide', length='w')} else 0 end as lft from t),
o as (select *, case when ratio < 1 then ceil(w / ratio)::bigint when ratio = 1 then least(w, h) else h end as out_height, case when ratio < 1 then w when ratio = 1 then least(w, h) else ceil(h * ratio)::bigint end as out_width from c),
m as (select f.image_id, md5('7-' || f.image_id || '-' || x1 || '-' || y1 || '-' || x2 || '-' || y2 || '-' || cls) as k, case when crop and ratio >= 1 then greatest(0, least(x1 - lft, wide - 1)) else x1 - lft end as x1, case when crop and ratio < 1 then greatest(0, least(y1 - top, tall - 1)) else y1 - top end as y1,
  case when crop and ratio >= 1 then greatest(0, least(x2 - lft, wide - 1)) else x2 - lft end as x2, case when crop and ratio < 1 then greatest(0, least(y2 - top, tall - 1)) else y2 - top end as y2, ratio = 1 as even, least(c.w, c.h) as square from f join c on f.image_id = c.image_id),
e as (select image_id, k, case when even then greatest(0, least(x1, square)) else x1 end as x1, case when even then greatest(0, least(y1, square)) else y1 end as y1, case when even then greatest(0, least(x2, square)) else x2 end as x2, case when even then greatest(0, least(y2, square)) else y2 end as y2 from m),
n as (select image_id, count(*)::bigint as n_boxes, sum(x1 + 3 * y1 + 7 * x2 + 11 * y2)::bigint as corners from (select * from e where not (x2 - x1 < 10 and y2 - y1 < 10) qualify row_number() over (partition by image_id order by k, x1, y1, x2, y2) <= 2) group by 1)
select o.image_id, lft::bigint as cut_left, top::bigint as cut_top, out_width, out_height, coalesce(n_boxes, 0) as n_boxes, coalesce(corners, 0) as corners from o left join n on o.image_id = n.image_id""")
def padded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each frame's image is cut, how large it is padded, and its first two boxes in it; sizes from a third to four times as wide as high."""
    from ..operators import minibatch

    d = det(spark, sf_dir).where("detection_type = 'object'")
    sides = [F.col(f"bbox_{k}").alias(k) for k in ("x1", "y1", "x2", "y2")]
    images = d.groupBy((F.col("video_id") * 512 + F.col("frame_number")).alias("image_id"), (F.col("frame_number") % 7 * 100 + 300).alias("width"), (F.col("video_id") % 5 * 90 + 250).alias("height")).agg(F.collect_list(F.struct(*sides, (F.col("row_id") % 5).alias("class"))).alias("boxes"))
    ratio = F.col("width") / F.col("height")
    shaped = images.withColumns({"target_ratio": F.least(F.lit(2.0), F.greatest(F.lit(0.5), ratio)), "need_crop": (ratio < 0.5) | (ratio > 2)})
    out = minibatch.geometry(shaped, most=2)
    corners = F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b.x1 + 3 * b.y1 + 7 * b.x2 + 11 * b.y2).cast("bigint")
    return out.select("image_id", F.col("left").alias("cut_left"), F.col("top").alias("cut_top"), "out_width", "out_height", F.col("n_boxes").cast("bigint").alias("n_boxes"), corners.alias("corners"))
