"""Fixed answers of the table operators."""

import pytest
from pyspark.sql import functions as F

from tilewright.operators import archive, catalog, geometry, masks, options, profile, raster
from tilewright.plans import steps

SQUARE = [(0, 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)])] + [(1, 1, i, x, y) for i, (x, y) in enumerate([(4, 4), (4, 6), (6, 6), (6, 4), (4, 4)])]


@pytest.fixture(scope="module")
def ring(spark):
    return spark.createDataFrame([(a, b, c, float(x), float(y)) for a, b, c, x, y in SQUARE], "ring_id int, is_hole int, seq int, lon double, lat double")


def tiles(spark, *rows):
    return spark.createDataFrame(rows, "zoom_level int, tile_column long, tile_row long, nbytes long")


def test_archive_totals(spark):
    t = tiles(spark, (5, 0, 0, 100), (5, 1, 0, 100), (6, 0, 0, 200), (6, 1, 0, 100))
    blobs = spark.createDataFrame([(1, 100), (2, 200)], "tile_data_id int, nbytes long")
    assert tuple(archive.archive_totals(t, blobs).first()) == (4, 500, 2, 300, 0.5)
    assert tuple(archive.archive_totals(t, None).first()) == (4, 500, None, None, 0.0)
    assert tuple(archive.archive_totals(t.where("false"), None).first()) == (0, 0, None, None, 0.0)
    assert sorted(map(tuple, archive.zoom_stats(t).collect())) == [(5, 2, 200), (6, 2, 300)]


def test_zoom_delta(spark):
    got = {r.zoom_level: (r.bytes_a, r.bytes_b, r.change_pct) for r in archive.zoom_delta(tiles(spark, (5, 0, 0, 100)), tiles(spark, (5, 0, 0, 50), (6, 0, 0, 200))).collect()}
    assert got == {5: (100, 50, -50.0), 6: (0, 200, None)}


def test_diffs(spark):
    m = lambda *r: spark.createDataFrame(r, "name string, value string")
    got = sorted(map(tuple, archive.map_diff(m(("githash", "aaa"), ("json", "1"), ("x", "1")), m(("githash", "bbb"), ("json", "2"), ("y", "1"))).collect()))
    assert got == [("githash", "changed", "aaa", "bbb"), ("x", "only_in_a", "1", None), ("y", "only_in_b", None, "1")]
    f = lambda *r: spark.createDataFrame(r, "layer string, field string")
    assert [tuple(r) for r in archive.field_diff(f(("place", "name"), ("place", "name_int")), f(("place", "name"))).collect()] == [("place", ["name_int"], [])]


def test_replace_merge(spark):
    got = archive.replace_merge(tiles(spark, (1, 0, 0, 1), (1, 0, 1, 2)), tiles(spark, (1, 0, 1, 9))).collect()
    assert sorted((r.tile_row, r.nbytes) for r in got) == [(0, 1), (1, 9)]


def test_shape(spark, ring):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 20.0, 5.0)], "id int, lon double, lat double")
    assert [r.id for r in geometry.points_in_shape(p, ring).collect()] == [1]
    boxes = [("band", -5, 4, 15, 6), ("far", 20, 20, 30, 30), ("around", -50, -50, 50, 50), ("in", 1, 1, 2, 2)]
    b = spark.createDataFrame([(n, *map(float, v)) for n, *v in boxes], "name string, west double, south double, east double, north double")
    assert sorted(r.name for r in geometry.boxes_touching_shape(b, ring).collect()) == ["around", "band", "in"]


def test_points_on_edges(spark):
    """Strictly, a point on an outer edge or corner is out, and one on a hole's is in."""
    box = lambda ring, hole, a: [(ring, hole, i, x, y) for i, (x, y) in enumerate([(-a, -a), (-a, a), (a, a), (a, -a), (-a, -a)])]
    shape = spark.createDataFrame(box(0, 0, 10.0) + box(1, 1, 5.1), "ring_id int, is_hole int, seq int, lon double, lat double")
    rows = [(float(x), float(y)) for x in (-10, -5.1, 0, 5.1, 7, 10) for y in (-10, -5.1, 0, 5.1, 7, 10)]
    found = geometry.points_in_shape(spark.createDataFrame(rows, "lon double, lat double"), shape, strict=True)
    assert {tuple(r) for r in found.collect()} == {(x, y) for x, y in rows if max(abs(x), abs(y)) < 10 and not max(abs(x), abs(y)) < 5.1}


def test_touching_is_not_overlap(spark):
    a, b = [[F.lit(float(v)) for v in box] for box in ((0, 0, 1, 1), (1, 0, 2, 1))]
    assert tuple(spark.range(1).select(geometry.boxes_overlap_open(a, b), geometry.boxes_overlap_closed(a, b)).first()) == (False, True)


def test_hysteresis(spark):
    rows = [("wave", i, 1000.0 + i % 2) for i in range(100)] + [("climb", i, 10.0 * 5 * i) for i in range(11)]
    p = spark.createDataFrame(rows, "line_id string, seq int, elevation_m double")
    get = lambda df: {r.line_id: (r.ascent_m, r.descent_m) for r in df.collect()}
    assert get(profile.hysteresis_ascent(p, 3.0)) == {"wave": (0, 0), "climb": (500, 0)}
    assert get(profile.hysteresis_ascent(p, 0.0))["wave"][0] == 50 == get(profile.naive_ascent(p))["wave"][0]


def test_densify(spark):
    p = spark.createDataFrame([(1, 0, 5.0, 45.0), (1, 1, 5.0, 45.1)], "line_id int, seq int, lon double, lat double")
    d = profile.densify(p, 1000.0).orderBy("seq", "part")
    assert d.count() > 5
    length = profile.with_distance(d.withColumn("n", F.col("seq") * 1000 + F.col("part")), seq="n").agg(F.max("distance_m")).first()[0]
    assert abs(length - 11119) < 200


def test_masks(spark):
    assert len(list(masks.walk([0, 1], 1))) == 5
    with pytest.raises(ValueError):
        list(masks.walk([1, 1], 1))
    t = spark.createDataFrame([(2, 0, 0), (2, 1, 0), (2, 0, 1), (2, 1, 1), (2, 3, 3)], "zoom_level int, tile_column long, tile_row long")
    bits = masks.mask_bits(t, 2).first()[0]
    assert bits == "11" + "01" + "00" + "00" + "11" + "00" + "00" + "00" + "01"
    text = masks.bits_to_text([int(b) for b in bits])
    assert {x for x in masks.walk(masks.text_to_bits(text), 2) if x[0] == 2} == {tuple(r) for r in t.collect()}
    assert masks.full_parents(t).collect() == [(1, 0, 0)]


def test_raster(spark):
    s = F.array(*[F.struct(F.lit(v).cast("double").alias("value"), F.lit(w).alias("weight"), F.lit(None).cast("double").alias("least")) for v, w in ((100.0, 1.0), (None, 1.0), (200.0, 0.25))])
    assert spark.range(1).select(raster.composite(s)).first()[0] == 125
    g = spark.createDataFrame([(x, y, float(x == 2)) for x in range(5) for y in range(3)], "gx int, gy int, w double")
    blurred = {r.gx: r.w for r in raster.box_blur(g, 1, passes=1).where("gy = 1").collect()}
    assert blurred == pytest.approx({0: 0, 1: 1 / 3, 2: 1 / 3, 3: 1 / 3, 4: 0})
    covered = spark.createDataFrame([(x, y) for x in range(10) for y in range(10)], "gx int, gy int")
    w = {(r.gx, r.gy): r.weight for r in raster.ring_coverage(spark.createDataFrame([(5, 5), (0, 5)], "gx int, gy int"), covered, 2).collect()}
    assert w[5, 5] == 1 and 0 < w[0, 5] < 1


def test_status(spark):
    df = spark.createDataFrame
    outputs = df([("a", "fa"), ("b", "fb"), ("c", "fc"), ("d", "fd")], "step string, path string")
    listing = df([("fa", 1), ("fb", 0), ("fd", 1)], "path string, size long")
    record = df([("d", "maxzoom", "14")], "step string, name string, value string")
    current = df([("d", "maxzoom", "13")], "step string, name string, value string")
    assert {r.step: r.status for r in options.step_status(outputs, listing, record, current).collect()} == {"a": "untracked", "b": "missing", "c": "missing", "d": "options_changed"}


def test_plan():
    assert steps.in_order(["valhalla_package"]) == ["download", "elevation", "valhalla_tiles", "valhalla_package"]
    assert steps.in_order(["basemap", "routes"]) == ["download", "basemap", "routes"]


def test_extract_paths(spark):
    e = spark.createDataFrame([("europe", None), ("france", "europe"), ("alps", "france"), ("x", "y"), ("y", "x")], "id string, parent string")
    got = {r.id: r.path for r in catalog.extract_paths(e).collect()}
    assert got["alps"] == "europe/france/alps" and got["europe"] == "europe" and got["x"] is None


def test_options(spark):
    schema = spark.createDataFrame([(1, "simplify_tolerance", "simplify-tolerance", "float"), (2, "languages", "languages", "text")], "seq int, key string, flag string, kind string")
    values = spark.createDataFrame([("simplify_tolerance", "0.7"), ("languages", ""), ("other", "1")], "key string, value string")
    assert options.rendered(values, schema).first().flags == ["--simplify-tolerance=0.7", "--languages="]
    assert [r.key for r in options.unknown_keys(values, schema).collect()] == ["other"]
