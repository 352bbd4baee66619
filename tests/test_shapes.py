"""Contour lines, polygons of masks and chains against plain versions, whatever the blocks."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tilewright.operators import chains, contours, order, polygons, simplify

# --- chains ------------------------------------------------------------------


def plain_chains(links):
    prev = {i: (p, s) for i, p, s in links}
    out = {}
    for i in prev:
        seen, at, steps = {}, i, 0
        while at not in seen and prev[at][0] is not None:
            seen[at] = steps
            at, steps = prev[at][0], steps + prev[at][1]
        if prev[at][0] is None:
            out[i] = (at, steps, False)
        else:
            low = min(seen)
            out[i] = (low, seen[low], True)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_chains(spark, seed):
    r = random.Random(seed)
    ids = r.sample(range(10_000), 400)
    links, at = [], 0
    while at < len(ids):
        part = ids[at : at + r.choice([1, 2, 3, 5, 64, 100])]
        at += len(part)
        closed = r.random() < 0.5
        links += [(i, part[k - 1] if k or closed else None, r.randrange(1, 9)) for k, i in enumerate(part)]
    got = chains.ranked(spark.createDataFrame(links, "id long, prev long, step int")).collect()
    assert {g.id: (g.chain, g.before, g.closed) for g in got} == plain_chains(links)


def test_trees_and_nothing(spark):
    links = [(1, None, 0), (2, 1, 1), (3, 1, 1), (4, 3, 1), (5, 4, 1), (6, 5, 2), (9, None, 0)]
    got = chains.ranked(spark.createDataFrame(links, "id long, prev long, step int")).collect()
    assert {g.id: (g.chain, g.before) for g in got} == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (1, 2), 5: (1, 3), 6: (1, 5), 9: (9, 0)}
    assert chains.ranked(spark.createDataFrame([], "id long, prev long, step int")).collect() == []


# --- contour lines -----------------------------------------------------------


def plain_lines(elev, step):
    """Sets of lines as (level, closed, points), closed ones turned to start at their smallest point; cell by cell."""
    after = defaultdict(dict)
    for (x, y), a in elev.items():
        corners = [((x, y), a)] + [((x + dx, y + dy), elev.get((x + dx, y + dy))) for dx, dy in ((1, 0), (1, 1), (0, 1))]
        if any(v is None or not math.isfinite(v) for _, v in corners):
            continue
        values = [v for _, v in corners]
        for k in range(math.floor(min(values) / step) + 1, math.floor(max(values) / step) + 1):
            level = k * step
            starts, ends = [], []
            for n in range(4):
                (p, u), (q, v) = corners[n], corners[(n + 1) % 4]
                if (u >= level) != (v >= level):
                    (starts if u >= level else ends).append((n, tuple(sorted((p, q)))))
            for n, edge in starts:
                turn = 1 if sum(values) / 4 >= level else -1
                after[k][edge] = ends[0][1] if len(ends) == 1 else dict(ends)[(n + turn) % 4]
    lines = []
    for k, follow in after.items():
        left = dict(follow)

        def point(edge, level=k * step):
            p, q = edge
            t = (level - elev[p]) / (elev[q] - elev[p])
            return round(p[0] + t * (q[0] - p[0]), 6), round(p[1] + t * (q[1] - p[1]), 6)

        for head in [*(e for e in follow if e not in set(follow.values())), *follow]:
            if head in left:
                way = [head]
                while way[-1] in left:
                    way.append(left.pop(way[-1]))
                closed = way[0] == way[-1]
                points = [point(e) for e in (way[:-1] if closed else way)]
                if closed:
                    points = min(points[i:] + points[:i] for i in range(len(points)))
                lines.append((k * step, closed, tuple(points)))
    return sorted(lines)


def got_lines(pieces):
    by_line = defaultdict(list)
    for r in contours.contour_vertices(pieces).collect():
        by_line[r.level, tuple(r.line), r.closed, r.length].append((r.seq, round(r.x, 6), round(r.y, 6)))
    lines = []
    for (level, _, closed, length), rows in by_line.items():
        assert [s for s, _, _ in sorted(rows)] == list(range(length + (not closed)))
        points = [(x, y) for _, x, y in sorted(rows)]
        if closed:
            points = min(points[i:] + points[:i] for i in range(len(points)))
        lines.append((level, closed, tuple(points)))
    return sorted(lines)


def bumpy(seed, size=24):
    r = random.Random(seed)
    elev = {(x, y): 40 * math.sin(x / 3) + 30 * math.cos(y / 4) + r.uniform(-3, 3) for x in range(size) for y in range(size)}
    for _ in range(12):
        elev.pop((r.randrange(size), r.randrange(size)), None)
    elev[5, 5], elev[6, 9] = float("nan"), float("inf")
    elev |= {(x, y): 10.0 for x in range(10, 14) for y in range(10, 14)}  # at a level
    return elev


@pytest.mark.parametrize("shift", [0, -11])
def test_contour_lines_whatever_the_blocks(spark, shift):
    elev = bumpy(1)
    rows = [(x + shift, y + shift, v) for (x, y), v in elev.items()] + [(shift, shift - 1, None)]
    pixels = spark.createDataFrame(rows, "gx int, gy int, elev double")
    want = plain_lines({(x, y): v for x, y, v in rows}, 10.0)
    assert {c for _, c, _ in want} == {True, False} and max(len(p) for _, _, p in want) > 40
    found = {block: got_lines(contours.contour_pieces(pixels, 10.0, block)) for block in (8, 64)}
    assert found[64] == want and found[8] == want
    named = [sorted(contours.contour_vertices(contours.contour_pieces(pixels, 10.0, b)).select("level", "line", "seq", "x", "y").collect()) for b in (8, 64)]
    assert named[0] == named[1]


def test_saddles_and_flat_ground(spark):
    saddle = {(0, 0): 10.0, (1, 0): 0.0, (0, 1): 0.0, (1, 1): 10.0}
    for mean in (0.0, 4.0):
        elev = saddle | {(1, 1): 10.0 + mean, (0, 0): 6.0 - mean}
        pixels = spark.createDataFrame([(*k, v) for k, v in elev.items()], "gx int, gy int, elev double")
        assert got_lines(contours.contour_pieces(pixels, 5.0)) == plain_lines(elev, 5.0)
    flat = spark.createDataFrame([(x, y, 20.0) for x in range(5) for y in range(5)], "gx int, gy int, elev double")
    assert contours.contour_pieces(flat, 10.0).collect() == []
    assert contours.contour_pieces(flat.where("false"), 10.0).collect() == []


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_lines_in_parts(spark, most):
    pixels = spark.createDataFrame([(x, y, v) for (x, y), v in bumpy(2).items()], "gx int, gy int, elev double")
    vertices = contours.contour_vertices(contours.contour_pieces(pixels, 10.0, 8)).cache()
    whole = defaultdict(list)
    for r in sorted(contours.lines_in_parts(vertices, most).collect(), key=lambda r: r.part):
        assert 2 <= len(r.points) <= most + 1
        line = whole[r.level, tuple(r.line), r.closed]
        assert not line or line[-1][1:] == tuple(r.points[0])[1:]
        line += [tuple(p) for p in r.points[bool(line) :]]
    for key, length in {(r.level, tuple(r.line), r.closed): r.length for r in vertices.collect()}.items():
        assert [p[0] for p in whole[key]] == list(range(length + 1))
        assert (whole[key][0][1:] == whole[key][-1][1:]) == key[2]


# --- polygons of masks -------------------------------------------------------


def plain_components(cells):
    left, out = set(cells), []
    while left:
        stack, found = [left.pop()], set()
        while stack:
            x, y = stack.pop()
            found.add((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.discard(n)
                    stack.append(n)
        out.append(found)
    return out


def holes_of(component):
    """Groups of empty cells that the component surrounds; empty cells that touch at a corner go together."""
    xs, ys = zip(*component)
    empty = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)} - component
    out = []
    while empty:
        stack, found = [empty.pop()], set()
        while stack:
            x, y = stack.pop()
            found.add((x, y))
            for n in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in empty:
                    empty.discard(n)
                    stack.append(n)
        if (min(xs) - 1, min(ys) - 1) not in found:
            out.append(len(found))
    return out


def check_polygons(spark, cells, block):
    rings, corners = polygons.polygons(spark.createDataFrame(list(cells), "x long, y long"), block)
    rings, points = rings.collect(), defaultdict(list)
    for c in corners.collect():
        points[tuple(c.ring)].append((c.seq, c.x, c.y))
    assert len({r.ring for r in rings}) == len(rings)
    for r in rings:
        way = sorted(points[tuple(r.ring)])
        assert [s for s, _, _ in way] == list(range(r.length))
        ends = list(zip(way, way[1:] + way[:1]))
        assert all((a[1] == b[1]) != (a[2] == b[2]) for a, b in ends)
        turned = [a[1] == b[1] for a, b in ends]
        assert all(a != b for a, b in zip(turned, turned[1:] + turned[:1]))
        assert sum(a[2] * b[1] - a[1] * b[2] for a, b in ends) == 2 * r.area
        assert r.is_hole == (r.area < 0)
    got = defaultdict(list)
    for r in rings:
        got[tuple(r.polygon)].append(r.area)
    want = sorted((len(c), sorted(holes_of(c))) for c in plain_components(cells))
    assert sorted((sum(a), sorted(-x for x in a if x < 0)) for a in got.values()) == want
    return sorted((tuple(r.ring), tuple(r.polygon), r.area, tuple(sorted(points[tuple(r.ring)]))) for r in rings)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.8])
def test_polygons_whatever_the_blocks(spark, share):
    r = random.Random(share)
    cells = {(x, y) for x in range(-9, 20) for y in range(30) if r.random() < share}
    found = [check_polygons(spark, cells, block) for block in (5, 64)]
    assert found[0] == found[1]


def test_nested_rings(spark):
    cells = {(x, y) for x in range(40) for y in range(40) if min(x, y, 39 - x, 39 - y) % 4 < 2}
    assert len(check_polygons(spark, cells, 7)) == 10
    snake = {(x, y) for y in range(0, 30, 2) for x in range(30)} | {(29 if y % 4 == 1 else 0, y) for y in range(1, 29, 2)}
    check_polygons(spark, snake, 6)
    assert polygons.polygons(spark.createDataFrame([], "x long, y long"))[0].collect() == []


def test_mask_polygons_in_metres(spark):
    tiles = spark.createDataFrame([(1, 0, 0), (2, 2, 0), (2, 0, 1), (5, 9, 9)], "zoom_level int, tile_column long, tile_row long")
    rings, corners = polygons.mask_polygons(tiles, 2)
    assert [(r.area, r.is_hole) for r in rings.collect()] == [(5, False)]
    assert corners.agg(F.min("easting"), F.max("easting"), F.max("northing"), F.min("northing")).first() == pytest.approx((-20037508.342789244, 10018754.171394622, 20037508.342789244, 0.0))


# --- simplification and union ------------------------------------------------


def rings_of(regions):
    """Rings of regions of cells, each vertex moved a little: (shape, ring, seq, x, y), the region on the left."""
    r = random.Random(5)
    moved = {}
    rows = []
    for shape, cells in regions.items():
        after = defaultdict(list)
        for x, y in cells:
            for a, b, n in (((x, y), (x + 1, y), (x, y - 1)), ((x + 1, y), (x + 1, y + 1), (x + 1, y)), ((x + 1, y + 1), (x, y + 1), (x, y + 1)), ((x, y + 1), (x, y), (x - 1, y))):
                if n not in cells:
                    after[a].append((b, (x, y)))
        ring = 0
        while after:
            at, (nxt, cell) = next((a, after[a][0]) for a in sorted(after))
            first, way = at, []
            while True:
                after[at].remove((nxt, cell))
                if not after[at]:
                    del after[at]
                way.append(at)
                at = nxt
                if at == first and not any(c == cell for _, c in after.get(at, [])):
                    break
                nxt, cell = min(after[at], key=lambda o: o[1] != cell) if at in after else (None, None)
                if nxt is None:
                    break
            for seq, p in enumerate(way):
                x, y = moved.setdefault(p, (p[0] + r.uniform(-0.4, 0.4), p[1] + r.uniform(-0.4, 0.4)))
                rows.append((shape, ring, seq, x, y))
            ring += 1
    return rows


RING = "shape string, ring int, seq int, x double, y double"


def blobs(seed, size=24):
    r = random.Random(seed)
    seeds = {s: (r.uniform(0, size), r.uniform(0, size)) for s in "abcdefg"}
    label = {(x, y): min(seeds, key=lambda s: math.dist(seeds[s], (x + math.sin(y), y))) for x in range(size) for y in range(size)}
    label |= {(x, y): "island" for x in range(3, 6) for y in range(3, 6)}
    regions = defaultdict(set)
    for c, s in label.items():
        regions[s].add(c)
    return regions


def sides_of(rows):
    rings = defaultdict(list)
    for shape, ring, seq, x, y in rows:
        rings[shape, ring].append((seq, (x, y)))
    out = []
    for v in rings.values():
        way = [p for _, p in sorted(v)]
        out += zip(way, way[1:] + way[:1])
    return out


def plain_simplified(rows, area):
    """Arcs between points where not two sides meet, the smallest triangle out of all of an arc taken again and again."""
    near = defaultdict(set)
    for a, b in sides_of(rows):
        near[a].add(b)
        near[b].add(a)
    fixed = {p for p, n in near.items() if len(n) != 2}
    rings, out = defaultdict(list), set()
    for shape, ring, seq, x, y in sorted(rows):
        rings[shape, ring].append((x, y))
    for key, way in rings.items():
        if not fixed & set(way):
            fixed_here = {min(way)}
        else:
            fixed_here = fixed
        at = next(i for i, p in enumerate(way) if p in fixed_here)
        way = way[at:] + way[: at + 1]
        kept, arc = [], [way[0]]
        for p in way[1:]:
            arc.append(p)
            if p in fixed_here:
                floor = {}
                while len(arc) > (4 if arc[0] == arc[-1] else 2):
                    size = {}
                    for i in range(1, len(arc) - 1):
                        (ax, ay), (bx, by), (cx, cy) = sorted(arc[i - 1 : i + 2])
                        size[i] = max(abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2, floor.get(arc[i], 0))
                    i = min(size, key=lambda i: (size[i], arc[i]))
                    if size[i] >= area:
                        break
                    floor[arc[i - 1]] = floor[arc[i + 1]] = size[i]
                    del arc[i]
                kept += arc[:-1]
                arc = [p]
        if len(kept) > 2:
            out |= {(key, p) for p in kept}
    return out


@pytest.mark.parametrize("area", [0.3, 1.5])
def test_simplified_neighbours_keep_their_borders(spark, area):
    rows = rings_of(blobs(3))
    got = simplify.simplified(spark.createDataFrame(rows, RING), area, 1 << 62)
    got = [tuple(r) for r in got.collect()]
    assert {((s, k), (x, y)) for s, k, _, x, y in got} == plain_simplified(rows, area)
    assert len(got) < 0.75 * len(rows)
    left = {}
    for a, b in sides_of(got):
        left[a, b] = left.get((a, b), 0) + 1
    alone = [s for s in left if (s[1], s[0]) not in left]
    assert set(left.values()) == {1}
    around = [p for p, _ in alone]
    assert len(around) == len(set(around)) == len({q for _, q in alone})  # what is alone goes once around all
    span = lambda sides: sum(a[0] * b[1] - b[0] * a[1] for a, b in sides) / 2
    assert span(left) == pytest.approx(span(alone)) and span(alone) > 500


def test_arcs_are_of_bounded_length(spark):
    n = 3000
    circle = [("s", 0, i, math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    other = [("t", 7, i, x, y) for i, (_, _, _, x, y) in enumerate(reversed(circle))]
    table = spark.createDataFrame(circle + other, RING)
    arcs = simplify.in_arcs(simplify.fixed_vertices(table, 50)).groupBy("shape", "ring", "arc").count().collect()
    assert len(arcs) > 60 and max(a["count"] for a in arcs) < 600
    got = simplify.simplified(table, 1e-3, 50).collect()
    points = [{(r.x, r.y) for r in got if r.shape == s} for s in "st"]
    assert points[0] == points[1] and 60 < len(points[0]) < 400
    whole = simplify.simplified(table, 1e9, 1 << 62)
    assert whole.groupBy("shape").count().collect() == [] or {r["count"] for r in whole.groupBy("shape").count().collect()} == {3}
    assert simplify.simplified(table.where("false"), 1.0).collect() == []


def test_union_and_small_ones(spark):
    regions = blobs(4)
    rows = rings_of(regions)
    table = spark.createDataFrame(rows, RING)
    whole = simplify.united(table)
    sides = sides_of(rows)
    assert sorted(sides_of([(None, tuple(r.ring), r.seq, r.x, r.y) for r in whole.collect()])) == sorted(s for s in sides if (s[1], s[0]) not in set(sides))
    assert whole.select("ring").distinct().count() == 1
    apart = simplify.united(table.where("shape IN ('island', 'a')"))
    assert apart.groupBy("ring").count().count() >= 1
    areas = {(r.shape, r.ring): r.area for r in simplify.ring_areas(table).collect()}
    large = simplify.without_small(table, 6.0).select("shape", "ring").distinct().collect()
    assert {tuple(r) for r in large} == {k for k, a in areas.items() if abs(a) >= 36.0}
    assert ("island", 0) in areas and areas["island", 0] < 36
    again = simplify.renumbered(table.where("seq % 3 <> 0")).groupBy("shape", "ring").agg(F.max("seq").alias("m"), F.count("*").alias("n"), F.countDistinct("seq").alias("d")).collect()
    assert all(r.m + 1 == r.n == r.d for r in again)


def test_union_of_squares_that_touch_at_corners(spark):
    squares = [(0, 0), (1, 1), (2, 0), (1, -1), (5, 5), (6, 5)]
    rows = [(f"s{i}", 0, k, float(x + dx), float(y + dy)) for i, (x, y) in enumerate(squares) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    rings = simplify.united(spark.createDataFrame(rows, RING))
    areas = sorted(r.area for r in simplify.ring_areas(rings).collect())
    assert areas == [1.0, 1.0, 1.0, 1.0, 2.0]


# --- numbers in order --------------------------------------------------------


def test_numbers_over_ranges(spark):
    r = random.Random(2)
    values = [(r.randrange(40), i) for i in range(500)]
    rows = spark.createDataFrame(values, "cost long, tie long").repartition(7)
    got = order.numbered(rows, "rank", F.desc("cost"), F.col("tie")).collect()
    want = {v: i + 1 for i, v in enumerate(sorted(values, key=lambda v: (-v[0], v[1])))}
    assert {(g.cost, g.tie): g["rank"] for g in got} == want
    assert order.numbered(rows.where("false"), "rank", "tie").collect() == []
