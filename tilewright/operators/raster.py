"""Elevation grids as tables of pixels: priorities, pyramids, blending, windows.

A grid has a row for each pixel (gx, gy, elev); sources add a priority, the highest winning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The ring of eight around a point, in units of the radius.
RING = ((1, 0), (0.7071067811865476, 0.7071067811865476), (0, 1), (-0.7071067811865476, 0.7071067811865476), (-1, 0), (-0.7071067811865476, -0.7071067811865476), (0, -1), (0.7071067811865476, -0.7071067811865476))


def highest_priority(pixels: DataFrame, value: str = "elev") -> DataFrame:
    """Each pixel's value from the source of highest priority that covers it."""
    return pixels.where(F.col(value).isNotNull()).groupBy("gx", "gy").agg(F.max_by(value, "priority").alias(value), F.max("priority").alias("priority"))


def finite(rows: DataFrame, value: str = "elev") -> DataFrame:
    """The rows whose value is a finite number."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def pyramid_level(pixels: DataFrame, value: str = "elev", by: tuple[str, ...] = ()) -> DataFrame:
    """The grid at half the size: the mean of the covered pixels among four."""
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    return pixels.groupBy(*by, half("gx"), half("gy")).agg(F.avg(value).alias(value), F.count(value).alias("covered"))


def pyramid(pixels: DataFrame, levels: int, value: str = "elev") -> DataFrame:
    """All levels from the full grid (0) to the smallest; each averages the one before it."""
    level = pixels.select("gx", "gy", F.col(value).cast("double").alias(value))
    out = level.withColumn("level", F.lit(0))
    for n in range(1, levels + 1):
        level = pyramid_level(level, value).drop("covered")
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out


def composite(values: Column) -> Column:
    """Blend of an array of structs (value, weight, least), lowest priority first.

    The first value covers; each later one is mixed in by its weight; values below ``least`` are raised.
    """

    def step(acc: Column, s: Column) -> Column:
        v = F.when(s["least"].isNull(), s["value"]).otherwise(F.greatest(s["value"], s["least"]))
        return F.when(s["value"].isNull(), acc).when(acc.isNull(), v).otherwise(acc * (1 - s["weight"]) + v * s["weight"])

    return F.aggregate(values, F.lit(None).cast("double"), step)


def box_blur(grid: DataFrame, radius: int, value: str = "w", passes: int = 2) -> DataFrame:
    """Separable moving average with the edges repeated, ``passes`` times, of a full grid."""
    for _ in range(passes):
        for axis, other in (("gx", "gy"), ("gy", "gx")):
            rows = Window.partitionBy(other)
            near = rows.orderBy(axis).rowsBetween(-radius, radius)
            first = F.first(value).over(rows.orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            last = F.last(value).over(rows.orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            at, size = F.row_number().over(rows.orderBy(axis)), F.count(F.lit(1)).over(rows)
            low, high = F.greatest(radius - at + 1, F.lit(0)), F.greatest(at + radius - size, F.lit(0))
            grid = grid.withColumn(value, (F.sum(value).over(near) + low * first + high * last) / (2 * radius + 1))
    return grid


def ring_coverage(points: DataFrame, covered: DataFrame, radius: int) -> DataFrame:
    """The share of a point and the ring of eight around it that ``covered (gx, gy)`` has: the weight of a feathered source."""
    probes = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy")), *[F.struct(F.lit(int(round(x * radius))).alias("dx"), F.lit(int(round(y * radius))).alias("dy")) for x, y in RING])
    asked = points.select("gx", "gy", F.explode(probes).alias("p")).select("gx", "gy", (F.col("gx") + F.col("p.dx")).alias("x"), (F.col("gy") + F.col("p.dy")).alias("y"))
    has = covered.select(F.col("gx").alias("x"), F.col("gy").alias("y"), F.lit(1.0).alias("has")).distinct()
    return asked.join(has, ["x", "y"], "left").groupBy("gx", "gy").agg(F.avg(F.coalesce("has", F.lit(0.0))).alias("weight"))


def window_maximum(points: DataFrame, grid: DataFrame, radius: int, value: str = "elev") -> DataFrame:
    """The highest value within ``radius`` pixels of each point, joined on grid cells of that size."""
    side = 2 * radius + 1
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    asked = points.select(F.col("gx").alias("px"), F.col("gy").alias("py")).distinct()
    near = asked.withColumn("cx", F.explode(F.sequence(F.floor((F.col("px") - radius) / side), F.floor((F.col("px") + radius) / side)))).withColumn(
        "cy", F.explode(F.sequence(F.floor((F.col("py") - radius) / side), F.floor((F.col("py") + radius) / side)))
    )
    both = near.join(grid.withColumn("cx", cell("gx")).withColumn("cy", cell("gy")), ["cx", "cy"])
    close = both.where((F.abs(F.col("gx") - F.col("px")) <= radius) & (F.abs(F.col("gy") - F.col("py")) <= radius))
    return close.groupBy(F.col("px").alias("gx"), F.col("py").alias("gy")).agg(F.max(value).alias("highest"))


def level_choice(levels: DataFrame, target: Column) -> DataFrame:
    """The overview (level, scale) with the largest scale not above the target, else the full resolution, level 0."""
    return levels.agg(F.coalesce(F.max_by("level", F.when(F.col("scale") <= target, F.col("scale"))), F.lit(0)).alias("level"))


def bilinear_sample(points: DataFrame, grid: DataFrame, value: str = "elev") -> DataFrame:
    """Elevation of fractional grid points (x, y) from their four neighbours; null outside or without the first."""
    from ..functions.elevation import bilinear

    base = points.withColumn("gx", F.floor("x").cast("long")).withColumn("gy", F.floor("y").cast("long"))
    for name, dx, dy in (("v00", 0, 0), ("v10", 1, 0), ("v01", 0, 1), ("v11", 1, 1)):
        side = grid.select((F.col("gx") - dx).cast("long").alias("gx"), (F.col("gy") - dy).cast("long").alias("gy"), F.col(value).cast("double").alias(name))
        base = base.join(side, ["gx", "gy"], "left")
    made = bilinear(F.col("v00"), F.col("v10"), F.col("v01"), F.col("v11"), F.col("x") - F.col("gx"), F.col("y") - F.col("gy"))
    return base.withColumn(value, made).drop("v00", "v10", "v01", "v11", "gx", "gy")
