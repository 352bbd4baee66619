"""Fixed answers of the column functions."""

import pytest
from pyspark.sql import functions as F

from tilewright.functions import elevation as E
from tilewright.functions import text as X
from tilewright.functions import tiles as G


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(*values):
    return [F.lit(v) for v in values]


def test_tiles(spark):
    assert one(spark, G.flip_row(*lits(2, 1)), G.flip_row(*lits(0, 1)), G.tile_id(*lits(0, 0, 0)), G.tile_id(*lits(2, 1, 3))) == (2, None, 0, 18)
    assert one(spark, *G.tile_of(F.lit(6.0), F.lit(45.0), F.lit(10))) == (529, 368)
    w, s, e, n = one(spark, *G.tile_box(*lits(0, 0, 0)))
    assert (w, e) == (-180, 180) and n == pytest.approx(85.0511, abs=1e-4) and s == pytest.approx(-85.0511, abs=1e-4)
    assert abs(one(spark, G.haversine(*lits(5.0, 45.0, 5.0, 46.0)))[0] - 111195) < 200


def test_degree_squares(spark):
    names = [one(spark, G.degree_name(*lits(float(x), float(y))))[0] for x, y in ((6, 44), (-3, -9), (0, 0))]
    assert names == ["N44E006", "S09W003", "N00E000"]
    assert [tuple(one(spark, *G.parse_degree_name(F.lit(n)))) for n in names] == [(6, 44), (-3, -9), (0, 0)]
    assert one(spark, *G.parse_degree_name(F.lit("readme"))) == (None, None)
    cover = lambda *b: len(one(spark, G.degree_cover(*lits(*map(float, b))))[0])
    assert [cover(5.9, 45.1, 6.2, 45.4), cover(6, 45, 7, 46), cover(3.68, 44.11, 7.19, 46.52)] == [2, 1, 15]


def test_graph_tiles(spark):
    paths = [one(spark, G.graph_path(*[F.lit(v).cast("long") for v in (x, y)], F.lit(z)))[0] for x, y, z in ((45, 33, 0), (5, 3, 1), (0, 720, 2), (0, 0, 2))]
    assert paths == ["0/003/015.gph", "1/001/085.gph", "2/001/036/800.gph", "2/000/000/000.gph"]
    assert one(spark, *G.graph_box(*lits(185, 135, 1))) == (5, 45, 6, 46)


def test_lambert93_round_trip(spark):
    x, y = G.to_lambert93(F.col("lon"), F.col("lat"))
    lon, lat = G.from_lambert93(x, y)
    for r in spark.createDataFrame([(6.0, 45.0), (3.0, 46.5), (-4.5, 48.2)], "lon double, lat double").select("lon", "lat", lon.alias("a"), lat.alias("b"), x.alias("x"), y.alias("y")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-7) and r.b == pytest.approx(r.lat, abs=1e-7)
    centre = one(spark, *G.to_lambert93(*lits(3.0, 46.5)))
    assert centre == pytest.approx((700000.0, 6600000.0), abs=0.01)


def test_elevation(spark):
    t = lambda r, g, b: one(spark, E.decode_terrarium(*lits(r, g, b)))[0]
    assert [t(128, 0, 0), t(128, 100, 0), t(128, 100, 128), t(127, 0, 0)] == [0, 100, 100.5, -256]
    assert one(spark, E.decode_mapbox(*lits(0, 0, 0)))[0] == -10000 and abs(one(spark, E.decode_mapbox(*lits(1, 134, 160)))[0]) < 0.01
    assert [one(spark, *E.encode_terrarium(F.lit(float(v)), F.lit(1.0))) for v in (0, 100, 500)] == [(128, 0, 0), (128, 100, 0), (129, 244, 0)]
    ramp = lambda digits, most: [one(spark, E.quantisation_digits(*lits(z, 13, digits, most)))[0] for z in range(13, 8, -1)]
    assert ramp(8, 11) == [8, 9, 10, 11, 11] and ramp(8, 0) == [8] * 5
    clamp = lambda v, m: one(spark, E.clamp_min(F.lit(v), F.lit(m).cast("double")))[0]
    assert [clamp(-40.0, -10.0), clamp(120.0, -10.0), clamp(-40.0, None), clamp(None, -10.0)] == [-10, 120, -40, None]


def test_names(spark):
    parts = lambda n: one(spark, *X.file_name_parts(F.lit(n), F.lit(n[:11] if n.startswith("rhone") else "rhone-alpes")))
    assert parts("rhone-alpes_hillshade.mbtiles.old") == ("hillshade", "mbtiles", "old")
    assert parts("corsica.mbtiles") == (None, None, None)
    assert [one(spark, X.java_major(F.lit(v)))[0] for v in ("21.0.11", "25", "1.8.0_452", "none")] == [21, 25, 8, None]
    assert [one(spark, X.shell_quote(F.lit(v)))[0] for v in ("a/b", "a b", "it's")] == ["a/b", "'a b'", "'it'\\''s'"]
    assert one(spark, X.gzip_magic(F.lit(bytearray(b"\x1f\x8b\x08\x00"))), X.gzip_magic(F.lit(bytearray(b"RIFF"))), X.gzip_magic(F.lit(bytearray(b"\x1f")))) == (True, False, False)


def test_metadata(spark):
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    none = F.array().cast("array<struct<id:string>>")
    assert one(spark, X.kind_of_metadata(m({"round-digits": "8"}), none, F.lit("basemap")))[0] == "terrain"
    assert one(spark, X.dem_encoding(m({"round-digits": "8"})), X.dem_encoding(m({"encoding": "terrarium", "round-digits": "8"})), X.dem_encoding(m({"a": "b"}))) == ("mapbox", "terrarium", None)
    layers = X.layers_of_json(F.lit('{"vector_layers":[{"id":"route","minzoom":5,"fields":{"name":"String"}}]}'))
    assert one(spark, X.kind_of_metadata(m({"a": "b"}), layers, F.lit("basemap")))[0] == "routes"
    assert one(spark, F.size(X.layers_of_json(F.lit("{broken"))), F.size(X.layers_of_json(F.lit(None).cast("string")))) == (0, 0)


@pytest.mark.parametrize(
    "line, event, stage, percent",
    [
        ("0:00:02 INF [osm_pass1] -  read: [  22 100%  53/s ]", "progress", "osm_pass1", 100),
        ("0:00:02 INF [osm_pass1] - Finished in 2s cpu:3s", "phase_end", "osm_pass1", None),
        ("0:00:50 INF [archive:write] - Finished z12 in 1s cpu:20s", "zoom_end", "archive:write", None),
        ("0:00:01 INF [a] - \x1b[32mStarting...\x1b[0m", "phase_start", "a", None),
        ("0:00:54 INF - FINISHED!", "run_end", None, None),
        ("    cpus: 0.7 gc:  0%", "log", None, None),
        ("", "log", None, None),
        (None, "log", None, None),
        ("0:00:02 INF [a] -  x: [ 300% ] y z: [ 5 / 6 12% ] w: [ 90% ]", "progress", "a", 12),
        ("0:00:02 INF [a] -  x: [ 1234% ]", "progress", "a", 100),
        ("0:00:02 INF [a] -  x: [ 999% ]", "log", "a", None),
        ("0:00:53 INF [archive] -  features: [  22M 100% 3.7M/s ] 1.7G  tiles: [  21k 3.6k/s ] 296M", "progress", "archive", 100),
        ("0:00:02 INF [a] -   read     1x(19% 0.2s)", "log", "a", None),
        ("0:00:02 INF [a-b] -Starting...", "phase_start", "a-b", None),
        ("0:00:02 INF [a]- Starting...", "log", None, None),
        ("0:00:02 INF [] - Starting...", "log", None, None),
        ("0:00:02 inf [a] - Starting...", "log", None, None),
        ("0:0:02 INF [a] - Starting...", "log", None, None),
        ("0:00:02\tINF - Starting...", "log", None, None),
        ("0:00:02 INF - Finished in 5s", "phase_end", "", None),
        ("0:00:02 INF [a] - Finished z300 in 5s", "phase_end", "a", None),
        ("0:00:02 INF [a] - Finished  in 5s", "log", "a", None),
        ("0:00:02 INF [a] - Finished in", "log", "a", None),
        ("0:00:02 INF [a] - 12: [ 5% ]", "log", "a", None),
    ],
)
def test_log_lines(spark, line, event, stage, percent):
    e = one(spark, X.log_event(F.lit(line)))[0]
    assert (e.event, e.stage, e.percent) == (event, stage, percent)


def test_large_sizes(spark):
    """Nothing above GiB, no exponents, halves up."""
    sizes = (1023, 1536, 1126, 1 << 40, 37 * 600_000**2, 37 * 36_000_000**2, (1 << 63) - 1)
    want = ("1023 B", "1.5 KiB", "1.1 KiB", "1024.0 GiB", "12405.2 GiB", "44658780.1 GiB", "8589934592.0 GiB")
    assert one(spark, *[X.human_size(F.lit(n)) for n in sizes]) == want
    assert one(spark, X.human_size(F.lit(None).cast("long"))) == (None,)
