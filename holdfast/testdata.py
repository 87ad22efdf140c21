"""Views of the engine's kind over the driver's tables, by arithmetic that Spark and DuckDB do alike.

Each view is a list of SQL expressions that both engines read; the queries select them, the SQL beside them repeats them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (name, table, columns). A video is 512 order keys; a frame is one.
DET = ("lineitem", """
cast(floor(l_orderkey / 512) as bigint) as video_id,
l_orderkey % 512 as frame_number,
concat(lpad(cast(l_orderkey % 512 as string), 6, '0'), '.png') as frame_id,
((l_orderkey % 512) * 8 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey as row_id,
case when l_linenumber <= 4 then 'hand' else 'object' end as detection_type,
cast((l_partkey * 7 + l_linenumber * 31) % 400 as bigint) as bbox_x1,
cast((l_suppkey * 13 + l_linenumber * 17) % 250 as bigint) as bbox_y1,
cast((l_partkey * 7 + l_linenumber * 31) % 400 + 40 + (l_partkey + cast(l_quantity as bigint) * 5) % 200 as bigint) as bbox_x2,
cast((l_suppkey * 13 + l_linenumber * 17) % 250 + 40 + (l_suppkey + cast(l_quantity as bigint) * 3) % 180 as bigint) as bbox_y2,
cast(40 + floor(l_discount * 100 + 0.5) * 6 as double) as confidence,
case when l_linenumber <= 4 then cast(l_partkey % 5 as int) end as contact_state,
case when l_linenumber <= 4 then case cast(l_partkey % 5 as int) when 0 then 'No Contact' when 1 then 'Self Contact' when 2 then 'Portable Object' when 3 then 'Portable Object' else 'Stationary Object Contact' end end as contact_label,
case when l_linenumber <= 4 then case when l_suppkey % 2 = 0 then 'Left' else 'Right' end end as hand_side,
case when l_linenumber <= 4 then cast((l_suppkey % 5) - 2 as double) / 4 end as offset_x,
case when l_linenumber <= 4 then cast((l_partkey % 5) - 2 as double) / 4 end as offset_y,
case when l_linenumber <= 4 then cast(l_partkey % 3 as double) / 256 end as offset_mag,
case when l_linenumber <= 4 then cast(l_suppkey % 10 as double) / 10 end as blue_prop,
case when l_linenumber > 4 then 'NA' when l_suppkey % 11 = 0 then 'experimenter' else 'participant' end as blue_glove_status,
case when l_tax > 0.075 then true when l_tax < 0.005 then null else false end as is_filtered
""")  # fmt: skip
GT = ("orders", """
cast(floor(o_orderkey / 512) as bigint) as video_id,
o_orderkey % 512 as frame_number,
case when o_orderstatus = 'F' then 1 else 0 end as gt
""")  # fmt: skip
#: Per-user sequences; pos is the rank of (ts, event_id) within the user.
SEQ = ("events", """
user_id as video_id,
cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as pos,
case when event_type in ('click', 'purchase', 'view') then 1 else 0 end as pred,
case when value >= 30 then 1 else 0 end as gt,
event_type = 'error' as blue,
event_id
""")  # fmt: skip


def view(spark: SparkSession, sf_dir: str, which: tuple[str, str]) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/{which[0]}.parquet").createOrReplaceTempView(f"holdfast_{which[0]}")
    return spark.sql(f"select {which[1]} from holdfast_{which[0]}")


def cte(**views: tuple[str, str]) -> str:
    """with-clause that defines the views for DuckDB."""
    return "with " + ",\n".join(f"{k} as (select {v[1]} from {v[0]})" for k, v in views.items())
