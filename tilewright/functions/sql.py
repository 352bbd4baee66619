"""Scalars as SQL functions, for users who write SQL: ``register(spark)`` makes them temporary functions of a session.

They are SQL bodies that Catalyst inlines, not UDFs. Each has the name and the meaning of the column function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_N = "shiftleft(1L, zoom)"
#: name -> (arguments, result, body)
FUNCTIONS = {
    "tile_x": ("lon double, zoom int", "bigint", f"least(greatest(cast(floor((lon + 180) / 360 * {_N}) as bigint), 0L), {_N} - 1)"),
    "tile_y": ("lat double, zoom int", "bigint", f"least(greatest(cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {_N}) as bigint), 0L), {_N} - 1)"),
    "tile_west": ("x bigint, zoom int", "double", f"x / {_N} * 360.0D - 180"),
    "tile_north": ("y bigint, zoom int", "double", f"degrees(atan(sinh(pi() * (1 - 2.0D * y / {_N}))))"),
    "flip_row": ("zoom int, y bigint", "bigint", f"case when y >= 0 and y < {_N} then {_N} - 1 - y end"),
    "tile_number": ("zoom int, x bigint, y bigint", "bigint", f"({_N} * {_N} - 1) div 3 + {_N} * y + x"),
    "haversine_m": (
        "lon1 double, lat1 double, lon2 double, lat2 double",
        "double",
        "2 * 6371008.8D * asin(sqrt(least(1, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "mercator_x": ("lon double", "double", "6378137.0D * radians(lon)"),
    "mercator_y": ("lat double", "double", "6378137.0D * ln(tan(pi() / 4 + radians(lat) / 2))"),
    "ground_resolution": ("y bigint, zoom int, size int", "double", f"40075016.686D * cos(atan(sinh(pi() * (1 - 2 * (y + 0.5D) / {_N})))) / ({_N} * size)"),
    "degree_name": (
        "lon double, lat double",
        "string",
        "concat(if(floor(lat) < 0, 'S', 'N'), lpad(cast(abs(floor(lat)) as string), 2, '0'), if(floor(lon) < 0, 'W', 'E'), lpad(cast(abs(floor(lon)) as string), 3, '0'))",
    ),
    "decode_terrarium": ("r int, g int, b int", "double", "r * 256.0D + g + b / 256.0D - 32768"),
    "decode_mapbox": ("r int, g int, b int", "double", "-10000 + (r * 65536.0D + g * 256 + b) * 0.1D"),
    "contour_band": (
        "elevation bigint",
        "int",
        "case when elevation % 1000 = 0 then 1000 when elevation % 500 = 0 then 500 when elevation % 250 = 0 then 250 when elevation % 200 = 0 then 200 "
        "when elevation % 100 = 0 then 100 when elevation % 50 = 0 then 50 when elevation % 20 = 0 then 20 else 10 end",
    ),
    "is_gzip": ("blob binary", "boolean", "coalesce(substring(blob, 1, 2) = X'1F8B', false)"),
    "is_md5": ("token string", "boolean", "token rlike '^[0-9a-fA-F]{32}$'"),
    "strip_ansi": ("line string", "string", "regexp_replace(line, concat(chr(27), '[[][0-9;]*[A-Za-z]'), '')"),
    "human_seconds": (
        "n bigint",
        "string",
        "case when n >= 3600 then concat(n div 3600, 'h', lpad((n div 60) % 60, 2, '0'), 'm', lpad(n % 60, 2, '0'), 's') when n >= 60 then concat(n div 60, 'm', lpad(n % 60, 2, '0'), 's') else concat(n, 's') end",
    ),
}


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
