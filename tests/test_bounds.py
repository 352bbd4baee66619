"""The bounds index opens what is new or changed and nothing else."""

import os

import numpy as np
import pytest

from tilewright.sources import bounds, rasters


def refreshed(spark, folder):
    opened = bounds.refresh(spark, bounds.listed(spark, f"{folder}/in"), f"{folder}/index", bounds.raster_bounds)
    return sorted(p.path.rpartition("/")[2] for p in opened.collect())


def names(rows):
    return sorted(r.path.rpartition("/")[2] for r in rows.collect())


def write(folder, name, west, north):
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / name).write_bytes(rasters.write_tiff(np.zeros((8, 16)), 16, (west, north), 0.5, -9999.0))


def test_index_is_kept(spark, tmp_path):
    for i in range(6):
        write(tmp_path, f"{i}.tif", 10.0 * i, 40.0)
    (tmp_path / "in" / "broken.tif").write_bytes(b"no raster")
    assert refreshed(spark, tmp_path) == [f"{i}.tif" for i in range(6)] + ["broken.tif"]
    assert refreshed(spark, tmp_path) == []
    box = (19.0, 37.0, 31.0, 39.0)
    assert names(bounds.touching(spark, f"{tmp_path}/index", box)) == ["2.tif", "3.tif", "broken.tif"]
    write(tmp_path, "7.tif", 20.0, 39.0)
    write(tmp_path, "2.tif", 100.0, 10.0)
    os.utime(tmp_path / "in" / "2.tif", (1, 1))  # the size is as before
    os.remove(tmp_path / "in" / "5.tif")
    assert refreshed(spark, tmp_path) == ["2.tif", "7.tif"]
    rows = {r.path.rpartition("/")[2]: tuple(r)[3:7] for r in bounds.read_index(spark, f"{tmp_path}/index").collect()}
    assert set(rows) == {"0.tif", "1.tif", "2.tif", "3.tif", "4.tif", "7.tif", "broken.tif"}
    assert rows["2.tif"] == (100.0, 6.0, 108.0, 10.0) and rows["broken.tif"] == (None,) * 4
    assert names(bounds.touching(spark, f"{tmp_path}/index", box)) == ["3.tif", "7.tif", "broken.tif"]


def test_a_version_that_is_not_whole_is_passed_over(spark, tmp_path):
    write(tmp_path, "a.tif", 0.0, 0.0)
    refreshed(spark, tmp_path)
    (tmp_path / "index" / "v2").mkdir()
    assert names(bounds.read_index(spark, f"{tmp_path}/index")) == ["a.tif"]
    assert refreshed(spark, tmp_path) == []
    assert bounds.read_index(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("x, y, want", [(-180.0, -90.0, 0), (180.0, 90.0, (1 << 30) - 1), (-180.0, 90.0, int("10" * 15, 2))])
def test_places_on_the_curve(spark, x, y, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(bounds.curve_place(F.lit(x), F.lit(y), F.lit(x), F.lit(y))).first()[0] == want


def test_near_places_are_in_few_files(spark, tmp_path, monkeypatch):
    """A box of a hundredth of the area is answered from a small share of the index's files."""
    monkeypatch.setattr(bounds, "_FILE", 100)
    rows = [(f"/x/{i}-{j}", 1, "2024-01-01 00:00:00") for i in range(40) for j in range(40)]
    files = spark.createDataFrame(rows, "path string, size long, modified string").selectExpr("path", "size", "cast(modified AS timestamp) AS modified")

    def of(path):
        i, j = map(int, path.rpartition("/")[2].split("-"))
        return -180 + 9.0 * i, -90 + 4.5 * j, -171 + 9.0 * i, -85.5 + 4.5 * j

    assert bounds.refresh(spark, files, f"{tmp_path}/index", of).count() == 1600
    index = bounds.read_index(spark, f"{tmp_path}/index")
    from pyspark.sql import functions as F

    named = index.withColumn("file", F.input_file_name())
    box = (-170.0, -80.0, -134.0, -62.0)
    w, s, e, n = box
    near = named.where((F.col("west") < e) & (F.col("east") > w) & (F.col("south") < n) & (F.col("north") > s))
    assert near.count() == 20 or near.count() == 25
    assert near.select("file").distinct().count() <= 4 and named.select("file").distinct().count() >= 14
    assert bounds.touching(spark, f"{tmp_path}/index", box).count() == near.count()
