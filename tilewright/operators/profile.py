"""Elevation profiles along lines: distance, ascent, gaps, densifying."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tiles import haversine


def with_distance(points: DataFrame, line: str = "line_id", seq: str = "seq") -> DataFrame:
    """``distance_m`` from the start of each line of points (lon, lat)."""
    order = Window.partitionBy(line).orderBy(seq)
    step = haversine(F.lag("lon").over(order), F.lag("lat").over(order), F.col("lon"), F.col("lat"))
    return points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("distance_m", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def summary(profile: DataFrame, line: str = "line_id", elevation: str = "elevation_m", distance: str = "distance_m") -> DataFrame:
    """Lowest, highest, gaps (points without elevation) and length of each line."""
    return profile.groupBy(line).agg(
        F.min(elevation).alias("min_m"), F.max(elevation).alias("max_m"), F.sum(F.col(elevation).isNull().cast("long")).alias("gaps"), F.max(distance).alias("length_m")
    )


def naive_ascent(profile: DataFrame, line: str = "line_id", seq: str = "seq", elevation: str = "elevation_m") -> DataFrame:
    """Sum of all rises and falls between neighbours that have an elevation."""
    order = Window.partitionBy(line).orderBy(seq)
    rise = F.col(elevation) - F.lag(elevation).over(order)
    steps = profile.where(F.col(elevation).isNotNull()).select(line, rise.alias("rise"))
    return steps.groupBy(line).agg(F.coalesce(F.sum(F.greatest("rise", F.lit(0.0))), F.lit(0.0)).alias("ascent_m"), F.coalesce(F.sum(F.greatest(-F.col("rise"), F.lit(0.0))), F.lit(0.0)).alias("descent_m"))


def hysteresis_ascent(profile: DataFrame, threshold: float = 3.0, line: str = "line_id", seq: str = "seq", elevation: str = "elevation_m") -> DataFrame:
    """Ascent and descent of each line: only moves of ``threshold`` or more from the last anchor count, and move it.

    Points without elevation are skipped. The lines of a partition are folded as they stream past in order, three
    numbers at a time, so a line may have any length.
    """
    kind = profile.schema[line].dataType
    rows = profile.where(F.col(elevation).isNotNull()).select(F.col(line), F.col(seq), F.col(elevation).cast("double").alias("_e"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, anchor, up, down = None, 0.0, 0.0, 0.0
        for f in frames:
            done = []
            for key, e in zip(f[line], f["_e"]):
                if key != own:
                    if own is not None:
                        done.append((own, up, down))
                    own, anchor, up, down = key, e, 0.0, 0.0
                elif abs(e - anchor) >= threshold:
                    up, down, anchor = up + max(e - anchor, 0.0), down + max(anchor - e, 0.0), e
            yield pd.DataFrame(done, columns=[line, "ascent_m", "descent_m"])
        if own is not None:
            yield pd.DataFrame([(own, up, down)], columns=[line, "ascent_m", "descent_m"])

    return rows.repartition(line).sortWithinPartitions(line, seq).mapInPandas(fold, f"`{line}` {kind.simpleString()}, ascent_m double, descent_m double")


def segments(points: DataFrame, columns: list[str], line: str = "line_id", seq: str = "seq") -> DataFrame:
    """``points`` with the ``columns`` of the next point of their line as ``next_<column>``; null for the last."""
    order = Window.partitionBy(line).orderBy(seq)
    return points.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})


def manoeuvre_points(manoeuvres: DataFrame, points: DataFrame, line: str = "line_id", seq: str = "seq", at: str = "spot") -> DataFrame:
    """``manoeuvres (line, at, ...)`` with the point of their line that ``at`` numbers, the last one beyond the end."""
    last = points.groupBy(line).agg(F.max(seq).alias("_last"))
    placed = manoeuvres.join(last, line).withColumn(seq, F.least(F.col(at), F.col("_last")).cast(points.schema[seq].dataType)).drop("_last")
    return placed.join(points, [line, seq])


def densify(points: DataFrame, metres: float, line: str = "line_id", seq: str = "seq") -> DataFrame:
    """The points of each line and evenly spaced ones between, floor(segment / metres) pieces a segment; (line, seq, part, lon, lat)."""
    order = Window.partitionBy(line).orderBy(seq)
    both = points.select(line, seq, "lon", "lat", F.lead("lon").over(order).alias("lon2"), F.lead("lat").over(order).alias("lat2"))
    pieces = F.coalesce(F.floor(haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) / metres), F.lit(0)).cast("int")
    parts = F.when(pieces > 1, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.lit(0)))
    made = both.withColumn("pieces", pieces).withColumn("part", F.explode(parts))
    at = lambda a, b: F.when(F.col("part") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col("part") / F.greatest("pieces", F.lit(1)))
    return made.select(line, seq, "part", at("lon", "lon2").alias("lon"), at("lat", "lat2").alias("lat"))


def accuracy(pairs: DataFrame, a: str, b: str, near: float = 5.0) -> DataFrame:
    """Mean and worst absolute difference, and the percentage within ``near``."""
    d = F.abs(F.col(a) - F.col(b))
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.avg(d).alias("mean_abs"), F.max(d).alias("worst"), (F.avg((d <= near).cast("double")) * 100).alias("near_pct"))


def running_offset(legs: DataFrame, size: str = "size", by: str = "trip_id", order: str = "leg") -> DataFrame:
    """Where each leg's points begin in the joined line, when legs share their end points."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return legs.withColumn("offset", F.coalesce(F.sum(F.col(size) - 1).over(before), F.lit(0)))


def of_lines(points: DataFrame, tiles: DataFrame, zoom: int, side: int, metres: float, threshold: float = 3.0, line: str = "line_id", seq: str = "seq") -> DataFrame:
    """``(line, distance_m, ascent_m, descent_m, min_m, max_m, gaps, points)`` of lines of points (lon, lat).

    Lines get points in between every ``metres`` or so, each is sampled from decoded tiles (see :func:`blocks.sample_tiles`), and
    ascents and descents count from ``threshold`` on. ``gaps`` are points that no tile has an elevation for; a line of
    nothing else climbs nothing. Lines of one point have no profile.
    """
    from . import blocks

    count = F.count(F.lit(1)).over(Window.partitionBy(line))
    many = points.where(F.col(line).isNotNull()).withColumn("_n", count).where("_n > 1").drop("_n")
    dense = densify(many, metres, line, seq)
    placed = dense.select(line, (F.col(seq).cast("long") * (1 << 32) + F.col("part")).alias("at"), "lon", "lat")
    found = blocks.sample_tiles(placed, tiles, zoom, side, [line, "at", "lon", "lat"], "elevation_m")
    return _folded(with_distance(found.repartition(line).sortWithinPartitions(line, "at"), line, "at"), threshold, line)


def _folded(profile: DataFrame, threshold: float, line: str) -> DataFrame:
    """The figures of :func:`of_lines` from ``profile (line, distance_m, elevation_m)`` whose partitions hold whole lines in order.

    All are taken in one pass, since joining them by line would make the profile anew for each and gather lines on the driver.
    """
    kind = profile.schema[line].dataType.simpleString()
    columns = [line, "distance_m", "ascent_m", "descent_m", "min_m", "max_m", "gaps", "points"]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, row = None, None
        for f in frames:
            done = []
            for key, far, e in zip(f[line].tolist(), f["distance_m"].tolist(), f["elevation_m"].tolist()):
                if row is None or key != own:
                    if row is not None:
                        done.append((own, *row))
                    own, row, anchor = key, [far, 0.0, 0.0, None, None, 0, 0], None
                row[0] = max(row[0], far)
                row[6] += 1
                if e is None or e != e:
                    row[5] += 1
                    continue
                if anchor is None:
                    anchor = row[3] = row[4] = e
                elif abs(e - anchor) >= threshold:
                    row[1 if e > anchor else 2] += abs(e - anchor)
                    anchor = e
                row[3], row[4] = min(row[3], e), max(row[4], e)
            yield pd.DataFrame(done, columns=columns)
        if row is not None:
            yield pd.DataFrame([(own, *row)], columns=columns)

    rows = profile.select(line, "distance_m", F.col("elevation_m").cast("double").alias("elevation_m"))
    return rows.mapInPandas(fold, f"`{line}` {kind}, distance_m double, ascent_m double, descent_m double, min_m double, max_m double, gaps long, points long")
