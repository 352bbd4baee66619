"""Tables of tiles, points, pixels, profiles, metadata and log lines, made from the driver's tables.

Each is one SQL text that Spark and the SQL check read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import load

TABLES = "region nation customer supplier part orders lineitem events documents".split()

VIEWS = {
    "fx_tiles": """select z as zoom_level, l_orderkey % pow2 as tile_column, l_partkey % pow2 as tile_row,
  l_suppkey as tile_data_id, cast(l_quantity as bigint) * 100 as nbytes,
  case when l_linestatus = 'F' then 'a' else 'b' end as build
  from (select *, cast(l_linenumber + 4 as int) as z, cast(power(2, l_linenumber + 4) as bigint) as pow2 from lineitem) q""",
    "fx_blobs": "select s_suppkey + case when s_suppkey % 5 = 0 then 1000000 else 0 end as tile_data_id, s_name as tile_data from supplier where s_suppkey % 7 <> 0",
    "fx_points": """select event_id as point_id,
  cast((event_id * 7919) % 360000 as double) / 1000 - 180.0 as lon,
  cast((event_id * 104729) % 170000 as double) / 1000 - 85.0 as lat from events""",
    "fx_boxes": """select n_nationkey as box_id, n_name as name,
  cast((n_nationkey * 13) % 160 - 80 as double) + 0.1 as west, cast((n_nationkey * 7) % 70 - 35 as double) + 0.1 as south,
  cast((n_nationkey * 13) % 160 - 80 as double) + 2.9 as east, cast((n_nationkey * 7) % 70 - 35 as double) + 1.9 as north from nation""",
    "fx_ring": """select ring_id, is_hole, seq, cast(lon as double) as lon, cast(lat as double) as lat from (values
  (0,0,0,-40.0,-30.0),(0,0,1,-40.0,30.0),(0,0,2,40.0,30.0),(0,0,3,40.0,-30.0),(0,0,4,-40.0,-30.0),
  (1,1,0,-10.0,-10.0),(1,1,1,-10.0,10.0),(1,1,2,10.0,10.0),(1,1,3,10.0,-10.0),(1,1,4,-10.0,-10.0)) t(ring_id,is_hole,seq,lon,lat)""",
    "fx_pixels": """select cast(l_orderkey % 64 as int) as gx, cast(l_partkey % 64 as int) as gy, cast(l_linenumber as int) as priority,
  cast(min(floor(l_extendedprice / 20.0)) as bigint) as elev from lineitem group by 1,2,3""",
    "fx_archive": """select distinct zoom_level, tile_column, tile_row from
  (select z as zoom_level, l_orderkey % pow2 as tile_column, l_partkey % pow2 as tile_row
  from (select *, cast(l_linenumber as int) as z, cast(power(2, l_linenumber) as bigint) as pow2 from lineitem) q) r""",
    "fx_profile": """select user_id as line_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as seq,
  1000.0 + value as elevation_m, cast((user_id * 7919) % 360000 as double) / 1000 - 180.0 as lon0 from events""",
    "fx_meta": """select build, name, max(value) as value from (
  select case when o_orderkey % 2 = 0 then 'a' else 'b' end as build, concat('k', cast(o_custkey as string)) as name, o_orderstatus as value
  from orders) q group by build, name""",
    "fx_fields": """select case when p_partkey % 2 = 0 then 'a' else 'b' end as build, p_type as layer, p_brand as field,
  p_size as value_id, p_partkey as feature_id from part""",
    "fx_log": """select event_id as line_no, case event_id % 12
  when 0 then concat('0:00:02 INF [stage', cast(user_id % 5 as string), '] -  read: [  22 ', cast(event_id % 101 as string), '%  53/s ]')
  when 1 then concat('0:00:01 INF [stage', cast(user_id % 5 as string), '] - Starting...')
  when 2 then concat('0:00:09 INF [stage', cast(user_id % 5 as string), '] - Finished in ', cast(event_id % 60 as string), 's cpu:3s avg:2.7')
  when 3 then concat('0:00:50 INF [archive:write] - Finished z', cast(event_id % 300 as string), ' in 1s cpu:20s, now starting z1')
  when 4 then '0:00:54 INF - FINISHED!'
  when 5 then '0:00:54 INF - FINISHED! at last'
  when 6 then concat('0:00:01 INF [stage', cast(user_id % 5 as string), '] - Starting... soon')
  when 7 then concat('0:00:07 DEB  [stage', cast(user_id % 5 as string), '] - tiles: [ 21k 3.6k/s ] write x: [ ', cast(event_id % 400 as string), '% 3/s ] then: [ 7%]   ')
  when 8 then concat('0:00:01 INF [stage', cast(user_id % 5 as string), '] - ', chr(27), '[32mStarting...', chr(27), '[0m')
  when 9 then concat('1:01:03 TRACE [stage', cast(user_id % 5 as string), '] - Finished in ', cast(event_id % 3 as string), 'h1m3s cpu:2m')
  when 10 then '0:00:01 INF - Starting...'
  else '    cpus: 0.7 gc:  0% heap: 67M/34G read 1x(19% 0.2s)' end as line from events""",
    "fx_files": """select c_custkey as file_id, 'rhone-alpes' as area, concat(
  case when c_custkey % 11 = 0 then 'corsica' else 'rhone-alpes' end,
  case c_custkey % 5 when 0 then '' when 1 then '_routes' when 2 then '_terrain' when 3 then '_hillshade' else '_mlt' end,
  case when c_nationkey % 3 = 0 then '.vtiles' else '.mbtiles' end,
  case when c_nationkey % 4 = 0 then '.old' else '' end) as file_name, cast(c_custkey as bigint) * 1000 + 17 as size_bytes from customer""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in TABLES if re.search(rf"\bfrom {t}\b", VIEWS[name])]
    text = VIEWS[name]
    for t in used:
        text = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", text)
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def checked(sql: str) -> str:
    """The SQL with the views it names put in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    if not head:
        return sql
    body = sql.strip()
    if m := re.match(r"WITH( RECURSIVE)?\s", body):
        return f"WITH{m[1] or ''} {head}, {body[m.end():]}"
    return f"WITH {head} {body}"
