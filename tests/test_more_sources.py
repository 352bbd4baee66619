"""Catalogues, rasters and tiling."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import tiling
from tilewright.sources import catalog, grids, rasters


def test_catalogue(spark, tmp_path):
    area = tmp_path / "alps"
    area.mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.mbtiles").write_bytes(b"x")
    with sqlite3.connect(area / "alps.mbtiles") as db:
        db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
        db.execute("INSERT INTO metadata VALUES ('format', 'pbf')")
        db.execute("CREATE TABLE tiles (zoom_level INT, tile_column INT, tile_row INT, tile_data BLOB)")
        db.executemany("INSERT INTO tiles VALUES (?, 0, 0, x'00')", [(3,), (7,)])
    (area / "alps_routes.mbtiles").write_bytes(b"broken")
    (area / ".DS_Store").write_bytes(b"")
    got = {r.file_name: r for r in catalog.probe(catalog.list_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"alps.mbtiles", "alps_routes.mbtiles"} and {r.area for r in got.values()} == {"alps"}
    assert (got["alps.mbtiles"].min_zoom, got["alps.mbtiles"].max_zoom, got["alps.mbtiles"].metadata) == (3, 7, {"format": "pbf"})
    assert got["alps_routes.mbtiles"].error and got["alps_routes.mbtiles"].metadata is None


def test_listings(spark, tmp_path):
    html = '<a href="alps-240101.osm.pbf">x</a><a href="alps-latest.osm.pbf">y</a><a href="alps-240101.osm.pbf.md5">z</a>'
    got = {r.href: (r.name, str(r.date)) for r in catalog.hrefs(spark.createDataFrame([(html,)], "html string")).collect()}
    assert got == {"alps-240101.osm.pbf": ("alps", "2024-01-01"), "alps-latest.osm.pbf": ("alps", "None")}
    (tmp_path / "s.tsv").write_text("a\tb\tc\td\te\tlayer\tbytes\n" + "1\t1\t1\t1\t1\troad\t10\n" * 3)
    assert catalog.layer_stats(spark, str(tmp_path / "s.tsv")).collect() == [("road", 30)]
    for text in ('[{"name":"low"},{"name":"high","clamp_min":-10}]', '{"sources":[{"name":"low"},{"name":"high","clamp_min":-10}]}'):
        (tmp_path / "l.json").write_text(text)
        assert [(r.priority, r.name, r.clamp_min) for r in catalog.source_list(spark, str(tmp_path / "l.json")).orderBy("priority").collect()] == [(0, "low", None), (1, "high", -10.0)]
    assert tuple(spark.range(1).select(catalog.bounds_of_header(F.lit("minlon: 1.5\nminlat: 2\nmaxlon: 3\nmaxlat: 4"))).first()[0]) == (1.5, 2, 3, 4)


@pytest.mark.parametrize("deflate", [True, False])
def test_raster(spark, tmp_path, deflate):
    grid = np.arange(40 * 50, dtype="f4").reshape(40, 50)
    grid[3, 7] = -9999
    (tmp_path / "a.tif").write_bytes(rasters.write_tiff(grid, 16, (700000.0, 6600000.0), 25.0, -9999.0, deflate))
    (level,) = rasters.levels((tmp_path / "a.tif").read_bytes())
    assert (level.width, level.height, level.origin, level.scale) == (50, 40, (700000.0, 6600000.0), (25.0, 25.0))
    blocks = rasters.read_blocks(spark, str(tmp_path))
    assert blocks.count() == 12
    got = {(r.gx, r.gy): r.elev for r in rasters.block_pixels(blocks).collect()}
    assert got == {(x, y): float(grid[y, x]) for y in range(40) for x in range(50) if (x, y) != (7, 3)}
    with pytest.raises(ValueError):
        rasters.levels(b"RIFF")


def test_shape_to_tiles(spark):
    ring = spark.createDataFrame([(0, 0, i, x, y) for i, (x, y) in enumerate([(-40.0, -30.0), (-40.0, 30.0), (40.0, 30.0), (40.0, -30.0), (-40.0, -30.0)])], "ring_id int, is_hole int, seq int, lon double, lat double")
    got = {tuple(r) for r in tiling.tiles_of_shape(ring, 3).collect()}
    assert {t for t in got if t[0] == 0} == {(0, 0, 0)} and {t for t in got if t[0] == 3} == {(3, x, y) for x in (3, 4) for y in (3, 4)}
    tile = spark.createDataFrame([(12, 2100, 1500), (9, 0, 0)], "zoom_level int, tile_column long, tile_row long")
    assert tiling.mask_to_graph_tiles(tile, (1,)).count() == 1


def test_render(spark):
    pixels = spark.createDataFrame([(5, 1, 2, x, y, 500.0 if (x, y) != (3, 3) else None) for x in range(8) for y in range(8)] + [(5, 9, 9, 0, 0, None)], "zoom_level int, tile_column long, tile_row long, px long, py long, elev double")
    tiles = tiling.render(pixels, 8, 1.0)
    assert tiles.count() == 1
    got = {(r.gx, r.gy): r.elev for r in grids.tile_pixels(tiles).collect()}
    assert got[0, 0] == 500 and got[3, 3] == 0
    addresses, blobs = tiling.compact(tiles.unionByName(tiles.withColumn("tile_row", F.lit(7).cast("long"))))
    assert addresses.count() == 2 and blobs.count() == 1


def test_exports(spark):
    t = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "zoom_level int, tile_column long, tile_row long")
    features = [json.loads(r.feature) for r in tiling.geojson_grid(t, 1).collect()]
    assert len(features) == 1 and features[0]["properties"]["label"] == "1/0/0" and len(features[0]["geometry"]["coordinates"][0]) == 5
    line = spark.createDataFrame([(1, 1, 6.0, 45.0), (1, 0, 5.0, 45.0)], "line_id int, seq int, lon double, lat double")
    assert json.loads(tiling.geojson_line(line).first().feature)["geometry"]["coordinates"] == [[5, 45], [6, 45]]
    m = spark.createDataFrame([("a", "1")], "name string, value string")
    assert sorted(map(tuple, tiling.set_metadata(tiling.set_metadata(m, "a", "2"), "b", "3").collect())) == [("a", "2"), ("b", "3")]
