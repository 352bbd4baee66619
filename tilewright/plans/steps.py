"""The build's steps and what depends on what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: A step and the steps it needs.
NEEDS = {
    "download": (),
    "elevation": (),
    "basemap": ("download",),
    "routes": ("download",),
    "terrain": ("elevation",),
    "hillshade": ("elevation",),
    "valhalla_tiles": ("download", "elevation"),
    "valhalla_package": ("valhalla_tiles",),
}


def needs_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, n) for s, needs in NEEDS.items() for n in needs], "step string, needs string")


#: Rounds that lengthen ways by one step; after them, ways double, so that deep needs take few rounds.
_BY_ONE = 16


def closure(spark: SparkSession, needs: DataFrame | None = None) -> DataFrame:
    """(step, needs) for everything a step needs, directly or not, at any depth.

    Each round keeps only the pairs that no round before has found, so a pair costs one row however many ways lead to it,
    and circles end. The joins are by merging: small files may hold too many pairs for a table on the driver.
    """
    needs = needs_table(spark) if needs is None else needs
    direct = written(needs.select("step", "needs").where("step <> needs").distinct())
    known = last = direct
    rounds = 0
    while not last.isEmpty():
        rounds += 1
        ahead = (direct if rounds <= _BY_ONE else known).select(F.col("step").alias("needs"), F.col("needs").alias("_next"))
        longer = last.join(ahead.hint("merge"), "needs").where("step <> _next").select("step", F.col("_next").alias("needs")).distinct()
        last = written(longer.join(known.hint("merge"), ["step", "needs"], "left_anti"))
        known = known.unionByName(last)
    return known


def in_order(wanted: list[str]) -> list[str]:
    """The wanted steps and all they need, each after what it needs, once."""
    out: list[str] = []

    def visit(step: str, path: tuple[str, ...] = ()) -> None:
        if step in out or step in path:
            return
        for n in NEEDS[step]:
            visit(n, (*path, step))
        out.append(step)

    for step in wanted:
        visit(step)
    return out


#: What each step writes for an area, by folder and name.
OUTPUTS = {
    "basemap": ("area", "{area}.mbtiles"),
    "routes": ("area", "{area}_routes.mbtiles"),
    "terrain": ("area", "{area}_terrain.mbtiles"),
    "hillshade": ("area", "{area}_hillshade.mbtiles"),
    "valhalla_package": ("area", "{area}.vtiles"),
    "download": ("data", "{area_}.osm.pbf"),
    "elevation": ("elevation", ""),
    "valhalla_tiles": ("graph", ""),
}


def outputs(areas: DataFrame, folders: dict[str, str]) -> DataFrame:
    """``(area, step, path)`` of what every step writes for each area; an area's own folder is below ``folders['area']``."""
    spark = areas.sparkSession
    rows = [(step, folders[folder].rstrip("/"), folder == "area", name) for step, (folder, name) in OUTPUTS.items()]
    table = F.broadcast(spark.createDataFrame(rows, "step string, folder string, own boolean, name string"))  # eight rows
    name = F.replace(F.replace("name", F.lit("{area}"), F.col("area")), F.lit("{area_}"), F.replace("area", F.lit("-"), F.lit("_")))
    path = F.concat_ws("/", "folder", F.when(F.col("own"), F.col("area")), F.nullif(name, F.lit("")))
    return areas.select("area").distinct().join(table, F.lit(True)).select("area", "step", path.alias("path"))
