"""Distances, overlaps, dissolved polygons, clusters and tiles against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from acreflow.functions import geo
from acreflow.operators import spatial, tiles

RING = "array<struct<x:double,y:double>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def star(rng, cx, cy, n=9, low=0.3, high=1.0):
    """A simple, mostly concave ring around a point."""
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in ((2 * math.pi * i / n, rng.uniform(low, high)) for i in range(n))]


def edges(points):
    return list(zip(points, [*points[1:], points[0]], strict=True))


def inside(points, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges(points)) % 2 == 1


def plain_distance(one, two):
    def to_edge(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def side(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    if inside(one, *two[0]) or inside(two, *one[0]):
        return 0.0
    if any(side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0 for a, b in edges(one) for c, d in edges(two)):
        return 0.0
    return min(min(to_edge(p, a, b) for p in x for a, b in edges(y)) for x, y in ((one, two), (two, one)))


def test_distances(spark):
    rng = random.Random(4)
    shapes = [(star(rng, 0, 0), star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3))) for _ in range(60)]
    frame = spark.createDataFrame([(i, [ring(a)], [ring(b)]) for i, (a, b) in enumerate(shapes)], f"i int, a array<{RING}>, b array<{RING}>")
    got = {r.i: r.d for r in frame.select("i", geo.distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == pytest.approx({i: plain_distance(a, b) for i, (a, b) in enumerate(shapes)}, abs=1e-9)


def test_middles(spark):
    frame = spark.createDataFrame([(ring([(0, 0), (4, 0), (4, 1), (0, 3)]),)], f"r {RING}")
    r = frame.select(geo.vertex_mean(F.col("r")).alias("m"), geo.box_centre(F.col("r")).alias("c")).first()
    assert (r.m.x, r.m.y, r.c.x, r.c.y) == (2, 1, 2, 1.5)


def test_touches(spark):
    box = lambda x, y, w=1, h=1: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    pairs = [(box(0, 0), box(1, 0), True), (box(0, 0), box(1, 1), True), (box(0, 0), box(1, 0.5), True), (box(0, 0), box(0.5, 0), False), (box(0, 0), box(2, 0), False), (box(0, 0, 4, 4), box(1, 1), False), (box(0, 0), [(0, 2), (1, 1), (2, 2)], True)]
    frame = spark.createDataFrame([([ring(a)], [ring(b)], want) for a, b, want in pairs], f"a array<{RING}>, b array<{RING}>, want boolean")
    assert frame.filter(geo.touches(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_overlaps_of_concave_rings(spark):
    """Against a count of the middles of small squares."""
    rng = random.Random(7)
    shapes = [(star(rng, 0, 0, 7), star(rng, rng.uniform(-1, 1), rng.uniform(-1, 1), 8)[:: rng.choice((1, -1))]) for _ in range(12)]
    frame = spark.createDataFrame([(i, ring(a), ring(b)) for i, (a, b) in enumerate(shapes)], f"i int, a {RING}, b {RING}")
    got = {r.i: (r.ab, r.ba) for r in frame.select("i", geo.overlap_area(F.col("a"), F.col("b")).alias("ab"), geo.overlap_area(F.col("b"), F.col("a")).alias("ba")).collect()}
    step = 0.02
    for i, (a, b) in enumerate(shapes):
        at = [(-1 + (x + 0.5) * step, -1 + (y + 0.5) * step) for x in range(int(2 / step)) for y in range(int(2 / step))]
        want = sum(inside(a, *p) and inside(b, *p) for p in at) * step * step
        assert got[i][0] == pytest.approx(want, abs=0.03) and got[i][1] == pytest.approx(got[i][0], abs=1e-9)


def flood(squares, corners=False):
    """The pieces of a set of unit squares."""
    left, out = set(squares), []
    while left:
        todo = [left.pop()]
        piece = set(todo)
        while todo:
            x, y = todo.pop()
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    if (corners or not dx or not dy) and (q := (x + dx, y + dy)) in left:
                        left.remove(q)
                        piece.add(q)
                        todo.append(q)
        out.append(piece)
    return out


def test_dissolved_polygons_with_holes(spark):
    """Squares of a raster, some joined to long boxes so that neighbours share parts of edges; holes are the squares left out inside."""
    rng = random.Random(2)
    squares = {(x, y) for x in range(18) for y in range(18) if rng.random() < 0.68}
    rows, left = [], set(squares)
    for x, y in sorted(squares):
        if (x, y) in left:
            wide = 1
            while rng.random() < 0.5 and (x, y + wide) in left:
                wide += 1
            left -= {(x, y + k) for k in range(wide)}
            rows.append(("g", ring([(x, y), (x + 1, y), (x + 1, y + wide), (x, y + wide)][:: rng.choice((1, -1))])))
    found = spatial.dissolve(spark.createDataFrame(rows, f"g string, ring {RING}"), "g", cell=4.0).collect()
    pieces = flood(squares)
    outside = {(x, y) for x in range(-1, 19) for y in range(-1, 19)} - squares
    # empty places that meet at a corner are one hole, as the squares between them do not
    holes = [h for h in flood(outside, corners=True) if (-1, -1) not in h]
    area = lambda r: sum(a.x * b.y - b.x * a.y for a, b in zip(r[:-1], r[1:], strict=True)) / 2
    assert len(found) == len(pieces)
    assert sorted(area(r.polygon[0]) + sum(area(h) for h in r.polygon[1:]) for r in found) == sorted(map(len, pieces))
    assert sum(len(r.polygon) - 1 for r in found) >= len(holes) > 0
    for r in found:
        assert area(r.polygon[0]) > 0 and all(area(h) < 0 and inside([(p.x, p.y) for p in r.polygon[0]], (h[0].x + h[1].x) / 2, (h[0].y + h[1].y) / 2) for h in r.polygon[1:])


def test_clusters_by_polygons(spark):
    """Boxes of triangles touch across a diagonal, the triangles do not; a very large parcel changes nothing for the others."""
    tri = lambda x, y: [(x, y), (x + 1, y), (x, y + 1)]
    shapes = {1: tri(0, 0), 2: tri(1, 1), 3: tri(2, 1), 4: [(-50, 10), (50, 10), (50, 60), (-50, 60)]}
    frame = spark.createDataFrame([(i, "A", [ring(p)]) for i, p in shapes.items()], f"id int, owner string, polygon array<{RING}>").withColumn("e", geo.envelope(F.get("polygon", 0))).select("*", "e.*")
    by_box = {r.id: r.cluster for r in spatial.adjacent_clusters(frame, ["owner"], cell=2.0).collect()}
    by_shape = {r.id: r.cluster for r in spatial.adjacent_clusters(frame, ["owner"], cell=2.0, polygon="polygon").collect()}
    assert by_box == {1: 1, 2: 1, 3: 1, 4: 4} and by_shape == {1: 1, 2: 2, 3: 2, 4: 4}
    pairs = spatial.near_pairs(frame, ["owner"], eps=0.8, cell=2.0, polygon="polygon").collect()
    assert sorted((r.a, r.b, round(r.distance, 6)) for r in pairs) == [(1, 2, 0.707107), (2, 3, 0.0)]


def decode(data):
    """The fields of a protocol buffer: (number, value) with numbers or bytes."""
    at, out = 0, []

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        head = varint()
        if head & 7 == 0:
            out.append((head >> 3, varint()))
        else:
            size = 8 if head & 7 == 1 else varint()
            out.append((head >> 3, bytes(data[at : at + size])))
            at += size
    return out


def numbers(data):
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def layers(mvt):
    """name -> {id: (ring, properties)} of a tile."""
    found = {}
    for number, layer in decode(mvt):
        assert number == 3
        fields = decode(layer)
        of = lambda k: [v for n, v in fields if n == k]
        keys = [k.decode() for k in of(3)]
        values = []
        for v in of(4):
            ((n, x),) = decode(v)
            values.append(x.decode() if n == 1 else (x >> 1) ^ -(x & 1) if n == 6 else x)
        rows = {}
        for feature in of(2):
            parts = dict(decode(feature))
            assert parts[3] == 3
            tags, moves = numbers(parts[2]), numbers(parts[4])
            step = [(n >> 1) ^ -(n & 1) for n in moves]
            assert moves[0] == 9 and moves[3] & 7 == 2 and moves[-1] == 15 and len(moves) == 5 + 2 * (moves[3] >> 3)
            x = y = 0
            points = []
            for dx, dy in zip([step[1], *step[4:-1:2]], [step[2], *step[5:-1:2]], strict=True):
                x, y = x + dx, y + dy
                points.append((x, y))
            rows[parts[1]] = (points, {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)})
        (name,) = of(1)
        assert name.decode() not in found and of(5) == [4096] and of(15) == [2]
        found[name.decode()] = rows
    return found


def boxes(spark, rows):
    d = spark.createDataFrame(rows, "id long, owner string, size long, xmin double, ymin double, xmax double, ymax double")
    return d.withColumn("ring", geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


def test_tiles_decode(spark):
    rows = [(7, "A", -3, 0.0, 0.0, 1e5, 1e5), (8, "B", 5, 1e6, 1e6, 1.1e6, 1.1e6), (9, None, 5, -geo.WORLD, -geo.WORLD, geo.WORLD, geo.WORLD), (10, "C", 1, 5e5, 5e5, 5e5 + 1, 5e5 + 1)]
    got = {(r.x, r.y): (r.n, layers(r.mvt)) for r in tiles.tiles(boxes(spark, rows), 3, "ownership", "id", ["owner", "size"]).collect()}
    assert len(got) == 64 and all(set(names) == {"ownership"} for _, names in got.values())
    n, found = got[4, 3]
    rows_of = found["ownership"]
    # the last is too small to be seen, the third is clipped to the tile and what lies around it
    assert n == len(rows_of) == 3 and {i: p for i, (_, p) in rows_of.items()} == {7: {"owner": "A", "size": -3}, 8: {"owner": "B", "size": 5}, 9: {"size": 5}}
    assert sorted(rows_of[9][0]) == [(-256, -256), (-256, 4352), (4352, -256), (4352, 4352)]
    side = round(1e5 / (2 * geo.WORLD / 8) * 4096)
    assert sorted(rows_of[7][0]) == sorted([(0, 4096), (side, 4096), (side, 4096 - side), (0, 4096 - side)])
    for points, _ in rows_of.values():
        assert sum(a[0] * b[1] - b[0] * a[1] for a, b in edges(points)) > 0


def test_two_layers_in_a_tile(spark):
    rows = [(i, "A", i, 1e5 * i, 1e5, 1e5 * (i + 1), 2e5) for i in range(40)]
    frame = boxes(spark, rows)
    both = tiles.layered(tiles.tiles(frame, 6, "parcels", "id", ["owner"]), tiles.tiles(frame.filter("size = 3"), 6, "large", "id", ["size"]))
    got = [(r.n, layers(r.mvt)) for r in both.collect()]
    assert all(n == sum(map(len, names.values())) for n, names in got)
    assert {i for _, names in got for i in names["parcels"]} == set(range(40)) and [set(names) for _, names in got if "large" in names] and {i for _, names in got for i in names.get("large", ())} == {3}


def test_simplified_and_clipped():
    assert tiles.simplified([(0, 0), (1, 0.1), (2, 0), (2, 2)], 0.5) == [(0, 0), (2, 0), (2, 2)]
    assert tiles.clipped([(-9000, 0), (9000, 0), (9000, 10), (-9000, 10), (-9000, 0)]) and not tiles.clipped([(9000, 0), (9001, 0), (9001, 9), (9000, 0)])
    assert tiles.encode_ring([(0, 0), (0.2, 0.2), (0.1, 0.4), (0, 0)]) is None
