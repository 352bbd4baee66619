"""Shapes as cells against plain ray casting and plain boxes; pictures and dependencies against plain versions."""

import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import cover
from tilewright.plans import steps
from tilewright.sources import grids, vectors

RING = "ring_id int, is_hole int, seq int, lon double, lat double"


def star(ring, hole, n, cx, cy, radius, wild, seed):
    r = random.Random(seed)
    return [(ring, hole, i, cx + radius * (1 + wild * r.uniform(-1, 1)) * math.cos(2 * math.pi * i / n), cy + radius * (1 + wild * r.uniform(-1, 1)) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def plain_inside(rings, x, y):
    """Even-odd for each ring: in an outer one and in no hole."""
    odd = {}
    for (ring, hole), way in rings.items():
        k = 0
        for (ax, ay), (bx, by) in zip(way, way[1:] + way[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                k += 1
        odd[ring, hole] = k % 2
    return any(v for (_, h), v in odd.items() if not h) and not any(v for (_, h), v in odd.items() if h)


def by_ring(rows):
    out = {}
    for ring, hole, _, x, y in rows:
        out.setdefault((ring, hole), []).append((x, y))
    return out


SHAPE = star(0, 0, 400, -20.0, 10.0, 30.0, 0.3, 1) + star(1, 1, 60, -22.0, 9.0, 10.0, 0.2, 2) + star(2, 0, 50, -5.0, 20.0, 25.0, 0.1, 3) + [(3, 0, i, x, y) for i, (x, y) in enumerate([(60.0, -40.0), (90.0, -40.0), (90.0, 0.0), (60.0, 0.0)])]


@pytest.mark.parametrize("most, step", [(4, 1), (32, 2)])
def test_points_by_cells(spark, most, step):
    r = random.Random(7)
    rows = [(i, r.uniform(-70, 100), r.uniform(-60, 60)) for i in range(1500)] + [(5000, -180.0, -90.0), (5001, 180.0, 90.0), (5002, 75.0, -20.0)]
    rows += [(6000 + i, v[3] + 1e-7, v[4]) for i, v in enumerate(SHAPE[:200])]
    cells = cover.shape_cells(spark.createDataFrame(SHAPE, RING), 14, most, step)
    points = spark.createDataFrame(rows, "id long, lon double, lat double")
    got = {p.id for p in cover.points_in_cells(points, cells, 14, step).collect()}
    rings = by_ring(SHAPE)
    assert got == {i for i, x, y in rows if plain_inside(rings, x, y)}
    inside, boundary = (c.collect() for c in cells)
    assert max(len(b.edges) for b in boundary) <= most
    whole = [(c.zoom_level, c.tile_column, c.tile_row) for c in inside + boundary]
    assert len(set(whole)) == len(whole) and not any((z - k, x >> k, y >> k) in set(whole) for z, x, y in whole for k in range(1, z + 1))


def test_a_ring_of_many_vertices(spark):
    """20,000 vertices: no row holds more than a few edges, and a point meets one row's at most."""
    n = 20_000
    ring = spark.range(n).select(F.lit(0).alias("ring_id"), F.lit(0).alias("is_hole"), F.col("id").cast("int").alias("seq"), (40 * F.cos(F.col("id") * (2 * math.pi / n))).alias("lon"), (40 * F.sin(F.col("id") * (2 * math.pi / n))).alias("lat"))
    cells = cover.shape_cells(ring, 20, 64)
    assert cells[1].agg(F.max(F.size("edges"))).first()[0] <= 64
    points = spark.range(4000).select("id", (F.rand(3) * 120 - 60).alias("lon"), (F.rand(4) * 120 - 60).alias("lat"))
    points = spark.createDataFrame(points.collect(), points.schema)
    found = cover.points_in_cells(points, cells, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {p.id for p in found.collect()} == {p.id for p in points.collect() if p.lon**2 + p.lat**2 < 1600}


def test_tiles_of_a_shape(spark):
    """Every tile that has a point of the shape, by sampling; none that has not, by the shape's boxes."""
    square = [(0, 0, i, x, y) for i, (x, y) in enumerate([(-50.0, -30.0), (50.0, -30.0), (50.0, 40.0), (-50.0, 40.0)])] + [(1, 1, i, x, y) for i, (x, y) in enumerate([(-20.0, -10.0), (20.0, -10.0), (20.0, 10.0), (-20.0, 10.0)])]
    got = {tuple(t) for t in cover.shape_tiles(spark.createDataFrame(square, RING), 6).collect()}
    lat = lambda y, n: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n))))
    want = set()
    for z in range(7):
        n = 1 << z
        for x in range(n):
            for y in range(n):
                w, e, s, t = x / n * 360 - 180, (x + 1) / n * 360 - 180, lat(y + 1, n), lat(y, n)
                if w <= 50 and e >= -50 and s <= 40 and t >= -30 and not (w > -20 and e < 20 and s > -10 and t < 10):
                    want.add((z, x, y))
    assert got == want
    assert cover.shape_tiles(spark.createDataFrame(square, RING).where("false"), 3).collect() == []


# --- pictures ----------------------------------------------------------------


def filtered_png(pixels, kinds):
    """A PNG whose lines have the given filters, made pixel by pixel."""
    h, w, c = pixels.shape
    flat = pixels.reshape(h, w * c).astype(int)
    raw = b""
    for y in range(h):
        raw += bytes([kinds[y]])
        for x in range(w * c):
            left, up = (flat[y, x - c] if x >= c else 0), (flat[y - 1, x] if y else 0)
            corner = flat[y - 1, x - c] if x >= c and y else 0
            p = left + up - corner
            guess = [0, left, up, (left + up) // 2, min((left, up, corner), key=lambda v: abs(p - v))][kinds[y]]
            raw += bytes([(flat[y, x] - guess) % 256])
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("h, w, c", [(1, 1, 1), (7, 5, 3), (5, 9, 4), (16, 1, 2), (1, 12, 3)])
def test_filtered_pictures(h, w, c):
    r = np.random.default_rng(h * w)
    pixels = r.integers(0, 256, (h, w, c)).astype(np.uint8)
    for kinds in ([k] * h for k in range(5)):
        assert np.array_equal(grids.decode_png(filtered_png(pixels, kinds)), pixels)
    mixed = [int(k) for k in r.integers(0, 5, h)]
    assert np.array_equal(grids.decode_png(filtered_png(pixels, mixed)), pixels)


def test_a_large_filtered_picture_is_quick():
    kind, line = np.full(512, 4, np.uint8), np.random.default_rng(1).integers(0, 256, (512, 512, 3)).astype(np.int32)
    began = time.process_time()
    grids._unfiltered(kind, line)
    assert time.process_time() - began < 1.0


# --- lines and steps ---------------------------------------------------------


def test_polylines():
    points = [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252), (0.0, 0.0), (179.999999, -89.999999)]
    assert [p[1:] for p in vectors.decode_polyline(vectors.encode_polyline(points))] == points
    assert vectors.encode_polyline(points[:3], 5) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert vectors.encode_polyline([]) == ""


def test_deep_and_circular_needs(spark):
    needs = [(f"s{i}", f"s{i + 1}") for i in range(40)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("d", "a")]
    got = {tuple(r) for r in steps.closure(spark, spark.createDataFrame(needs, "step string, needs string")).collect()}
    want = {(f"s{i}", f"s{j}") for i in range(41) for j in range(i + 1, 41)} | {(x, y) for x in "abc" for y in "abc" if x != y} | {("d", x) for x in "abc"}
    assert got == want


def test_many_ways_to_what_is_needed(spark, monkeypatch):
    """Layers of two steps that each need both of the next, and a way back: millions of ways, each pair found once."""
    n = 42
    needs = [(a, b) for a in range(n) for b in range(n) if b // 2 == a // 2 + 1] + [(n - 2, 6)]
    want, new = set(), set(needs)
    while new:
        want |= new
        new = {(a, d) for a, b in new for c, d in needs if b == c} - want
    for by_one in (16, 1):
        monkeypatch.setattr(steps, "_BY_ONE", by_one)
        got = [tuple(r) for r in steps.closure(spark, spark.createDataFrame(needs, "step long, needs long")).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if a != b}


def test_points_on_cell_edges(spark):
    """Strictly, a point on an outer edge or corner is out, and one on a hole's is in."""
    box = lambda ring, hole, w, s, e, n: [(ring, hole, i, x, y) for i, (x, y) in enumerate([(w, s), (e, s), (e, n), (w, n)])]
    shape = box(0, 0, -20.0, -10.0, 20.0, 10.0) + box(1, 1, -5.1, -5.1, 5.1, 5.1) + [(2, 0, 0, 40.0, 0.0), (2, 0, 1, 48.0, 8.0), (2, 0, 2, 40.0, 8.0)]
    rows = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in (-20.0, -5.1, 0.0, 5.1, 20.0, 19.999999) for y in (-10.0, -5.1, 0.0, 5.1, 10.0, 9.999999))]
    rows += [(100, 40.0, 4.0), (101, 44.0, 4.0), (102, 43.0, 4.0), (103, 44.0, 8.0), (104, 48.0, 8.0)]
    want = {i for i, x, y in rows if i < 100 and abs(x) < 20 and abs(y) < 10 and not (abs(x) < 5.1 and abs(y) < 5.1)} | {102}
    points = spark.createDataFrame(rows, "id long, lon double, lat double")
    for most in (1, 32):
        cells = cover.shape_cells(spark.createDataFrame(shape, RING), 8, most)
        assert {p.id for p in cover.points_in_cells(points, cells, 8, strict=True).collect()} == want
