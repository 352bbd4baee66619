"""Formats of elevation squares, rasters and polygons: what filters leave out is not read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.sources import formats, mbtiles, rasters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def squares(tmp_path_factory):
    folder, r, want = tmp_path_factory.mktemp("dem"), random.Random(1), {}
    for lon, lat, name in ((6, 44, "N44/N44E006"), (7, 44, "N44E007"), (-2, -1, "S01W002")):
        grid = np.array([[r.choice([-32768, 5, 900, -7]) for _ in range(11)] for _ in range(11)], ">i2")
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / f"{name}.hgt").write_bytes(grid.tobytes())
        want |= {(lon, lat, x, y): None if grid[y, x] == -32768 else int(grid[y, x]) for x in range(11) for y in range(11)}
    (folder / "N45E006.hgt.part").write_bytes(b"x")
    (folder / "readme.hgt").write_bytes(b"x")
    return str(folder), want


@pytest.mark.parametrize(
    "where, holds",
    [
        ("true", lambda lon, lat, x, y: True),
        ("lon_deg = 6", lambda lon, lat, x, y: lon == 6),
        ("lat_deg IN (44, 50) AND gy BETWEEN 3 AND 5", lambda lon, lat, x, y: lat == 44 and 3 <= y <= 5),
        ("gy IN (0, 7, 8) AND gx > 8", lambda lon, lat, x, y: y in (0, 7, 8) and x > 8),
        ("lon_deg < 0 AND gx <= 2 AND gy >= 9", lambda lon, lat, x, y: lon < 0 and x <= 2 and y >= 9),
        ("lon_deg > 100", lambda lon, lat, x, y: False),
    ],
)
def test_squares(spark, squares, where, holds):
    formats.register(spark)
    folder, want = squares
    got = mbtiles.pushed(spark, "hgt", folder).where(where)
    assert {tuple(x)[:4]: x.elev for x in got.collect()} == {k: v for k, v in want.items() if holds(*k)}
    assert "Filter (" not in plan(got)
    assert {r.elev for r in spark.read.format("hgt").load(folder).where("elev > 100").collect()} == {900}


def test_squares_that_are_not_asked_are_not_opened(spark, squares, tmp_path):
    formats.register(spark)
    (tmp_path / "N10E010.hgt").write_bytes(np.zeros((5, 5), ">i2").tobytes())
    (tmp_path / "N11E010.hgt").write_bytes(b"broken")
    assert mbtiles.pushed(spark, "hgt", str(tmp_path)).where("lat_deg = 10").count() == 25
    table = spark.read.format("hgt").load(str(tmp_path))
    with pytest.raises(Exception, match="no square grid"):
        table.count()
    reader = formats._Squares(squares[0])
    assert len(reader.partitions()) == 1 and len(reader.partitions()[0].parts) == 3


def test_a_table_is_used_with_other_filters(spark, squares):
    """Without being asked to, readers take no filters: one loaded table answers any number of plans, also in one."""
    formats.register(spark)
    folder, want = squares
    table = spark.read.format("hgt").load(folder)
    assert table.where("lon_deg = 6").count() == 121 and table.count() == 363 and table.where("lon_deg = 6").unionByName(table).count() == 484


def test_many_parts(squares, monkeypatch):
    monkeypatch.setattr(formats, "PIXELS", 150)
    assert [len(p.parts) for p in formats._Squares(squares[0]).partitions()] == [1, 1, 1]


def test_rasters(spark, tmp_path):
    formats.register(spark)
    values = np.random.default_rng(1).uniform(0, 100, (40, 70)).astype(np.float32)
    values[3, 5] = -9999.0
    (tmp_path / "a.tif").write_bytes(rasters.write_tiff(values, 16, (0.0, 40.0), 1.0, -9999.0))
    table = spark.read.format("raster").load(str(tmp_path))
    want = {(x, y): float(values[y, x]) for x in range(70) for y in range(40) if (x, y) != (5, 3)}
    assert {(r.gx, r.gy): r.elev for r in table.collect()} == want
    some = mbtiles.pushed(spark, "raster", str(tmp_path)).where("gx BETWEEN 20 AND 33 AND gy < 9 AND level = 0")
    assert {(r.gx, r.gy): r.elev for r in some.collect()} == {k: v for k, v in want.items() if 20 <= k[0] <= 33 and k[1] < 9}
    assert "Filter (" not in plan(some) and table.where("level = 3").count() == 0
    reader = formats._Rasters(str(tmp_path))
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

    assert list(reader.pushFilters([GreaterThanOrEqual(("gx",), 20), LessThanOrEqual(("gx",), 33), LessThanOrEqual(("gy",), 8)])) == []
    assert sum(len(p.parts) for p in reader.partitions()) == 2  # blocks, of 15
    assert {(r.gx, r.gy): r.elev for r in spark.createDataFrame(rasters.block_pixels(rasters.read_blocks(spark, str(tmp_path / "a.tif"))).collect()).collect()} == pytest.approx(want)


def test_polygons(spark, tmp_path):
    formats.register(spark)
    ring = lambda head, a: f"{head}\n" + "".join(f"  {a + x} {a + y}\n" for x, y in ((0, 0), (1, 0), (1, 1))) + "END\n"
    for k in range(3):
        (tmp_path / f"p{k}.poly").write_text(f"shape {k}\n" + ring("1", k) + ring("!2", k + 10) + "END\n")
    (tmp_path / "broken.poly").write_text("x\n1\n 0 0\n")
    table = mbtiles.pushed(spark, "poly", str(tmp_path)).where("file IN ('p0', 'p2')")
    got = table.groupBy("file", "name", "ring_id", "is_hole").agg(F.count(F.lit(1)).alias("n"), F.min("lon").alias("w")).collect()
    assert sorted(map(tuple, got)) == [("p0", "shape 0", 0, 0, 3, 0.0), ("p0", "shape 0", 1, 1, 3, 10.0), ("p2", "shape 2", 0, 0, 3, 2.0), ("p2", "shape 2", 1, 1, 3, 12.0)]
    with pytest.raises(Exception, match="END"):
        spark.read.format("poly").load(str(tmp_path)).count()
