"""Grids in blocks: halos, samples and warps give what the pixel by pixel versions give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import blocks, profile, sampling
from tilewright.sources import rasters


def grid(seed, width, height, holes=0.1):
    r = random.Random(seed)
    return {(x, y): r.uniform(-50, 900) for x in range(width) for y in range(height) if r.random() > holes}


def pixels_of(spark, values):
    return spark.createDataFrame([(x, y, v) for (x, y), v in values.items()], "gx long, gy long, elev double")


@pytest.mark.parametrize("before, after", [(0, 1), (1, 1), (2, 0), (4, 3)])
def test_halos(spark, before, after):
    values = grid(1, 19, 11) | {(-3, 2): 5.0}
    side, whole = 4, 4 + before + after
    made = blocks.with_halo(blocks.from_pixels(pixels_of(spark, values), side), side, before, after).collect()
    assert {(b.bx, b.by) for b in made} == {(x // side, y // side) for x, y in values}
    for b in made:
        got = np.frombuffer(b.data).reshape(whole, whole)
        want = [[values.get((b.bx * side - before + x, b.by * side - before + y), np.nan) for x in range(whole)] for y in range(whole)]
        assert np.array_equal(got, np.array(want), equal_nan=True)


def test_blocks_and_pixels(spark):
    values = grid(2, 13, 9)
    back = blocks.to_pixels(blocks.from_pixels(pixels_of(spark, values), 5), 5).collect()
    assert {(r.gx, r.gy): r.elev for r in back} == values
    assert blocks.from_pixels(pixels_of(spark, {}), 5).collect() == []
    with pytest.raises(ValueError):
        blocks.with_halo(blocks.from_pixels(pixels_of(spark, values), 5), 5, 6, 0)


LEVEL = {"width": 40.0, "height": 24.0, "origin_x": -100.0, "origin_y": 60.0, "scale_x": 5.0, "scale_y": 5.0}


def close(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v)), k


@pytest.mark.parametrize("at_once", [7, 4096])
def test_raster_samples(spark, at_once, monkeypatch):
    """Points inside, on the edges and outside, and most of all in one block."""
    monkeypatch.setattr(blocks, "AT_ONCE", at_once)
    r = random.Random(3)
    rows = [(i, r.uniform(-110, 110), r.uniform(-70, 70)) for i in range(400)] + [(1000 + i, r.uniform(-60, -50), r.uniform(20, 30)) for i in range(300)]
    rows += [(2000, -97.5, 57.5), (2001, 97.5, -57.5), (2002, 99.9, -59.9), (2003, -100.0, 60.0), (2004, 97.4, 0.0), (2005, 0.0, -57.4)]
    points = spark.createDataFrame(rows, "id long, easting double, northing double")
    pixels = pixels_of(spark, grid(4, 40, 24))
    got = {x.id: x.elev for x in blocks.sample_raster(points, blocks.from_pixels(pixels, 8), 8, LEVEL, ["id"]).collect()}
    close(got, {x.id: x.elev for x in sampling.sample_raster(points, pixels, LEVEL, ["id"]).collect()})
    assert sum(v is None for v in got.values()) > 50


def test_tile_samples(spark):
    """Over the seams between tiles, some of which are missing."""
    size, zoom, r = 8, 2, random.Random(5)
    have = {(x, y) for x in range(4) for y in range(4) if (x + y) % 4}
    values = {k: v for k, v in grid(6, 32, 32).items() if (k[0] // size, k[1] // size) in have}
    points = spark.createDataFrame([(i, r.uniform(-180, 179.9), r.uniform(-84, 84)) for i in range(500)], "id long, lon double, lat double")
    pixels = pixels_of(spark, values | {(size * x + size - 1, size * y + size - 1): 1.0 for x, y in have})
    tiles = blocks.from_pixels(pixels, size).withColumnsRenamed({"bx": "tile_column", "by": "tile_row"})
    rows = pixels.selectExpr(f"{zoom} AS zoom_level", f"gx div {size} AS tile_column", f"gy div {size} AS tile_row", f"gx % {size} AS gx", f"gy % {size} AS gy", "elev")
    close(
        {x.id: x.elev for x in blocks.sample_tiles(points, tiles, zoom, size, ["id"]).collect()},
        {x.id: x.elev for x in sampling.sample_archive(points, rows, zoom, ["id"]).collect()},
    )


def test_warped_tiles(spark, tmp_path):
    """From a raster file's blocks to tiles of several zooms, as the samples of every pixel have it."""
    values = grid(7, 40, 24)
    array = np.array([[values.get((x, y), -9999.0) for x in range(40)] for y in range(24)])
    (tmp_path / "a.tif").write_bytes(rasters.write_tiff(array, 16, (-100.0, 60.0), 5.0, -9999.0))
    read = rasters.read_blocks(spark, str(tmp_path / "a.tif"))
    tiles = spark.createDataFrame([(0, 0, 0), (2, 1, 1), (2, 2, 2), (3, 0, 0), (2, 1, 1)], "zoom_level int, tile_column long, tile_row long")
    made = blocks.warp(tiles, 8, blocks.from_raster(read), 16, (40, 24), blocks.affine(LEVEL))
    got = {tuple(x[:5]): x.elev for x in blocks.tile_pixels(made, 8).collect()}

    def sample(points, by):
        return sampling.sample_raster(points.withColumns({"easting": F.col("lon"), "northing": F.col("lat")}), rasters.block_pixels(read).select("gx", "gy", "elev"), LEVEL, by)

    close(got, {tuple(x[:5]): x.elev for x in sampling.warp(tiles, 8, sample).where("elev IS NOT NULL").collect()})
    assert made.count() == 4 and len(got) > 60
    # A tile that nothing covers is there, without a pixel.
    assert {tuple(x[:3]) for x in made.collect()} - {k[:3] for k in got} == {(3, 0, 0)}


def shuffled(spark, run):
    """Bytes that stages wrote to shuffles while ``run`` ran."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(store.stageAttempt(i, 0, False, None, False, None)._1().shuffleWriteBytes() for i in range(first, spark.sparkContext._jsc.sc().dagScheduler().nextStageId()) if not store.stageAttempt(i, 0, False, None, False, None)._1().status().toString() == "SKIPPED")
    first = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total()


def test_a_grid_moves_once(spark):
    """A warp shuffles less than twice the bytes of the grid and the tiles together, though it samples four pixels for each."""
    side, n, size = 64, 8, 64
    r = np.random.default_rng(1)
    rows = [(x, y, r.random((side, side)).tobytes()) for x in range(n) for y in range(n)]
    source = spark.createDataFrame(rows, "bx long, by long, data binary")
    level = {"origin_x": -180.0, "origin_y": 85.0, "scale_x": 360.0 / (n * side), "scale_y": 170.0 / (n * side)}
    tiles = spark.range(64).selectExpr("3 AS zoom_level", "id % 8 AS tile_column", "id div 8 AS tile_row")
    made = blocks.warp(tiles, size, source, side, (n * side, n * side), blocks.affine(level))
    moved = shuffled(spark, lambda: made.write.format("noop").mode("overwrite").save())
    assert 0 < moved < 2 * 8 * (n * side) ** 2 + 12 * 64 * size * size


def test_whole_profiles(spark):
    """A ramp of 10 m a pixel with a void, walked to and fro; a line of one point has no profile."""
    size, zoom = 16, 0
    pixels = pixels_of(spark, {(x, y): 10.0 * x for x in range(16) for y in range(16) if x != 12})
    tiles = blocks.from_pixels(pixels, size).withColumnsRenamed({"bx": "tile_column", "by": "tile_row"})
    lon = lambda x: (x + 0.5) / 16 * 360 - 180
    rows = [("there", 0, lon(2), 0.0), ("there", 1, lon(6), 0.0), ("back", 0, lon(6), 0.0), ("back", 1, lon(2), 0.0), ("void", 0, lon(10), 0.0), ("void", 1, lon(12), 0.0), ("one", 0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "line_id string, seq int, lon double, lat double")
    got = {r.line_id: r for r in profile.of_lines(points, tiles, zoom, size, 500_000.0).collect()}
    assert set(got) == {"there", "back", "void"}
    there, back, void = got["there"], got["back"], got["void"]
    far = 4 * 2 * np.pi * 6371008.8 / 16
    assert there.distance_m == pytest.approx(far) and there.points == int(far // 500_000) + 1
    assert (there.ascent_m, there.descent_m, there.min_m, there.max_m, there.gaps) == pytest.approx((40.0, 0.0, 20.0, 60.0, 0))
    assert (back.ascent_m, back.descent_m) == pytest.approx((0.0, 40.0))
    assert void.gaps == 1 and void.min_m == pytest.approx(100.0)


def test_profiles_are_not_joined_by_line(spark):
    """The figures of a line come from one pass over its points: only blocks are joined, and a point's place travels with it."""
    rows = [(k, i, float(i % 7), float(k % 5)) for k in range(40) for i in range(1 + k % 4)] + [(None, 0, 1.0, 1.0), (None, 1, 2.0, 2.0)]
    points = spark.createDataFrame(rows, "line_id long, seq int, lon double, lat double")
    tiles = blocks.from_pixels(pixels_of(spark, {(x, y): 10.0 * x for x in range(16) for y in range(16)}), 16).withColumnsRenamed({"bx": "tile_column", "by": "tile_row"})
    made = profile.of_lines(points, tiles, 0, 16, 500_000.0)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "line_id" not in "".join(x for x in plan.splitlines() if "Join " in x)
    assert {r.line_id: r.points for r in made.collect()} == {k: 1 + k % 4 for k in range(40) if k % 4}
