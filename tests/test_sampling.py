"""Sampling, shapes, writers and documents: cases that the queries do not have."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import geometry, masks, options, sampling, tiling
from tilewright.sources import catalog, grids, mbtiles, rasters, vectors


def test_samples_across_tile_seams(spark):
    """Two tiles of four pixels a side, flat at 100 and 200: half way over the seam it is 150; beyond the archive neighbours borrow."""
    pixels = spark.createDataFrame([(1, x, 0, gx, gy, 100.0 * (x + 1)) for x in (0, 1) for gx in range(4) for gy in range(4)], "zoom_level int, tile_column long, tile_row long, gx int, gy int, elev double")
    points = spark.createDataFrame([("seam", 0.0, 40.0), ("west", -90.0, 40.0), ("east", 90.0, 40.0), ("south", 10.0, -40.0), ("edge", 90.0, 0.001)], "id string, lon double, lat double")
    got = {r.id: r.elev for r in sampling.sample_archive(points, pixels, 1, ["id"]).collect()}
    assert got == pytest.approx({"seam": 150.0, "west": 100.0, "east": 200.0, "south": None, "edge": 200.0})
    assert sampling.clamped_zoom(F.lit(0), pixels).first()[0] == 1


def test_degree_squares(spark):
    grid = [[100, 100, 100], [150, None, 150], [200, 200, 200]]
    pixels = spark.createDataFrame([(6, 44, x, y, grid[y][x]) for x in range(3) for y in range(3)], "lon_deg long, lat_deg long, gx int, gy int, elev int")
    points = spark.createDataFrame([("north", 6.5, 45.0), ("south", 6.0, 44.0), ("mid", 6.25, 44.75), ("void", 6.5, 44.5), ("none", 9.0, 44.5)], "id string, lon double, lat double")
    got = {r.id: r.elev for r in sampling.sample_squares(points, pixels, ["id"]).collect()}
    # The middle's void neighbour borrows from the one before it.
    assert got == pytest.approx({"north": 100.0, "south": 200.0, "mid": 112.5, "void": None})


def test_blending(spark):
    rows = [("a", 0, p, 100.0) for p in range(9)] + [("a", 1, p, 200.0 if p < 3 else None) for p in range(9)] + [("b", 1, 0, 50.0), ("c", 0, 0, None)]
    samples = spark.createDataFrame(rows, "id string, priority int, probe int, elev double")
    assert {r.id: r.elev for r in sampling.blend_sources(samples, ["id"]).collect()} == pytest.approx({"a": 100 + 100 / 3, "b": 50.0})
    assert {r.id: r.elev for r in sampling.blend_sources(samples, ["id"], feathered=False).collect()} == {"a": 200.0, "b": 50.0}
    probes = sampling.ring_probes(spark.createDataFrame([("a", 5.0, 60.0)], "id string, lon double, lat double"), ["id"], 1113.2).collect()
    assert len(probes) == 9 and probes[1].lon - 5 == pytest.approx(0.02) and probes[3].lat - 60 == pytest.approx(0.01)


def test_shape_of_many_vertices(spark):
    """A ring of 10,000 vertices: no nested loop in the plan, and a circle's answers."""
    turn = np.linspace(0, 2 * np.pi, 10_000)
    ring = spark.createDataFrame([(0, 0, i, float(30 * np.cos(t)), float(30 * np.sin(t))) for i, t in enumerate(turn)], "ring_id int, is_hole int, seq int, lon double, lat double")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(-35, 36, 5) for y in range(-35, 36, 5))], "id int, lon double, lat double")
    inside = geometry.points_in_shape(points, ring)
    plan = inside._jdf.queryExecution().executedPlan().toString() + geometry.boxes_touching_shape(points.selectExpr("lon AS west", "lat AS south", "lon + 1 AS east", "lat + 1 AS north"), ring)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {r.id for r in points.collect() if r.lon**2 + r.lat**2 < 899}
    assert {r.id for r in inside.collect() if r.lon**2 + r.lat**2 < 899} == want


def test_broken_rasters(tmp_path):
    """A chain of directories that points back to itself ends; what is no image is an error."""
    raw = bytearray(rasters.write_tiff(np.zeros((4, 4)), 4, (0.0, 4.0), 1.0, -1.0))
    own = rasters.levels(bytes(raw))
    assert len(own) == 1 and own[0].nodata == -1
    start = int.from_bytes(raw[4:8], "little")
    entries = int.from_bytes(raw[start : start + 2], "little")
    raw[start + 2 + 12 * entries : start + 6 + 12 * entries] = raw[4:8]
    assert len(rasters.levels(bytes(raw))) == 1
    with pytest.raises(ValueError):
        rasters.levels(b"GIF89a..........")


def test_masks_by_size(spark):
    t = spark.createDataFrame([(z, x, 0) for z in (2, 5) for x in range(1 << z)], "zoom_level int, tile_column long, tile_row long")
    assert masks.mask_zoom(t, range(2, 6), 8).first().zoom == 2
    assert masks.mask_zoom(t, range(2, 6), 10_000).first().zoom == 5
    # No ancestors are needed among the tiles, and a tile above the last zoom counts by itself.
    some = spark.createDataFrame([(1, 1, 1), (3, 0, 0)], "zoom_level int, tile_column long, tile_row long")
    text = masks.mask_of(some, 9).first().mask
    assert set(masks.walk(masks.text_to_bits(text), 3)) == {(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (1, 1, 1)}


def test_compact_archive_changes(spark, tmp_path):
    path = str(tmp_path / "own.mbtiles")
    db = mbtiles.new_archive(path, "compact")
    mbtiles.add_compact(db, [(1, 0, 0, b"a"), (1, 1, 0, b"a"), (1, 0, 1, b"b")])
    mbtiles.add_compact(db, [(1, 0, 1, b"c")])
    mbtiles.delete_compact(db, [(1, 1, 0)])
    db.commit()
    assert sorted(db.execute("SELECT tile_column, tile_row, tile_data FROM tiles")) == [(0, 0, b"a"), (0, 1, b"c")]
    assert db.execute("SELECT count(*) FROM tiles_data").fetchone() == (2,)
    db.close()


def test_package_tree(spark, tmp_path):
    tiles = spark.createDataFrame([("0/000/001.gph", bytearray(b"x" * 500)), ("0/000/002.gph", None)], "path string, tile_data binary")
    packed, report = grids.recompress(tiles)
    row = report.first()
    assert row.before_bytes == 500 > row.after_bytes and 0 < row.saved < 1
    grids.write_tree(packed, str(tmp_path)).collect()
    assert (tmp_path / "0/000/001.gph").read_bytes() == b"x" * 500 and (tmp_path / "0/000/002.gph").read_bytes() == b""


def test_documents(spark, tmp_path):
    path = str(tmp_path / "state.json")
    catalog.write_document(spark, path, {"b": 1, "a": "x"})
    assert json.loads((tmp_path / "state.json").read_text()) == {"a": "x", "b": 1}
    assert tuple(catalog.read_document(spark, path, "a string, b int").first()) == ("x", 1)
    (tmp_path / "other.json").write_text("{broken")
    assert tuple(catalog.read_document(spark, str(tmp_path / "other.json"), "a string, b int").first()) == (None, None)
    assert catalog.list_files(spark, str(tmp_path / "none")).collect() == []


def test_errors_are_raised(spark):
    from tilewright.operators.catalog import wanted_archives

    names = spark.createDataFrame([("dem_N44E006.7z",), ("whole.zip",)], "name string")
    with pytest.raises(Exception, match="full download"):
        wanted_archives(names, (6.0, 44.0, 7.0, 45.0)).collect()
    assert {r.stem for r in wanted_archives(names, (0.0, 0.0, 1.0, 1.0), True).collect()} == {"whole"}
    none = spark.createDataFrame([(1, None)], "box_id int, bounds string")
    with pytest.raises(Exception, match="no bounds"):
        options.chosen_bounds(none, none, none, "box_id").collect()


def test_halo(spark):
    one = spark.range(1).select(tiling.halo(F.lit(11), 512, F.lit(0.0))[0], tiling.world_file(F.lit(0))).first()
    assert one[0] == 0 and [float(v) for v in one[1].split("\n")] == pytest.approx([40075016.685578, 0, 0, -40075016.685578, 0, 0])


def test_holes_in_geojson(spark):
    square = lambda a, b: [(a, a), (a, b), (b, b), (b, a), (a, a)]
    rows = [(0, k, s, float(x), float(y)) for k, ring in ((0, square(0, 9)), (1, square(3, 6))) for s, (x, y) in enumerate(ring)]
    ring = spark.createDataFrame([("p", k, k, s, x, y) for _, k, s, x, y in rows], "path string, ring_id int, is_hole int, seq int, lon double, lat double")
    feature = json.loads(vectors.poly_geojson(ring).first().feature)
    assert [len(r) for r in feature["geometry"]["coordinates"][0]] == [5, 5]


def test_sharded_archives(spark, tmp_path):
    t = spark.range(20).select(F.lit(4).alias("zoom_level"), (F.col("id") % 16).alias("tile_column"), F.floor(F.col("id") / 16).alias("tile_row"), F.lit(bytearray(b"x")).alias("tile_data"))
    files = mbtiles.write_shards(t, str(tmp_path), 8).collect()
    assert sum(r.tiles for r in files) == 20 and len(files) == 2
    with sqlite3.connect(files[0].path) as db:
        assert db.execute("SELECT count(*) FROM tiles").fetchone()[0] == files[0].tiles
