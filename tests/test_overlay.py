"""Unions, intersections and differences against areas counted on a raster and against sums over rings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreflow.functions import geo
from acreflow.operators import overlay

from .test_geometry import RING

POLYGON = f"array<{RING}>"


def closed(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def box(x0, y0, x1, y1):
    return closed([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def inside(polygons, x, y):
    """Which raster points lie in a multipolygon, by counting crossings."""
    odd = np.zeros(x.shape, bool)
    for polygon in polygons:
        for ring in polygon:
            for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
                if ay != by:
                    odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def area(polygons):
    ring_area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r[:-1], r[1:], strict=True)) / 2
    for polygon in polygons:  # outsides turn left, holes right
        assert ring_area(polygon[0]) > 0 and all(ring_area(r) < 0 for r in polygon[1:])
    return sum(ring_area(r) for polygon in polygons for r in polygon)


def told(frame, by):
    out = {}
    for r in frame.collect():
        out.setdefault(r[by], []).append([[(p.x, p.y) for p in ring] for ring in r.polygon])
    return out


def star(rng, x, y, size):
    n = rng.integers(3, 9)
    angle = (np.arange(n) + 0.8 * rng.random(n)) / n * 2 * np.pi  # the middle lies inside, so no edges of a star cross
    r = size * (0.3 + 0.7 * rng.random(len(angle)))
    return closed(list(zip(x + r * np.cos(angle), y + r * np.sin(angle), strict=True)))


GRID = np.meshgrid((np.arange(400) + 0.5) / 40, (np.arange(400) + 0.5) / 40)


@pytest.mark.parametrize("rule", ["union", "intersection", "difference"])
def test_random_shapes(spark, rule):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g in range(6):
        sides = [[], []]
        for i in range(3 + 3 * g):
            x, y = rng.uniform(2, 8, 2)
            outer = star(rng, x, y, 2) if i % 2 else box(x - 1.5, y - 1, x + 1, y + 1.5)
            polygon = [outer] if i % 3 else [box(x - 1.5, y - 1, x + 1, y + 1.5), box(x - 0.5, y - 0.5, x + 0.5, y + 0.5)]
            if i % 4 == 1:  # turned the other way
                polygon = [r[::-1] for r in polygon]
            sides[i % 2].append(polygon)
            rows.append((f"g{g}", i % 2, i, polygon))
        a, b = (np.any([inside([p], *GRID) for p in s], axis=0) for s in sides)
        want[f"g{g}"] = {"union": a | b, "intersection": a & b, "difference": a & ~b}[rule]
    shapes = spark.createDataFrame(rows, f"g string, side int, shape long, polygon {POLYGON}")
    found = told(overlay.combined(shapes, "g", rule, cell=1.0), "g")
    for g, raster in want.items():
        got = inside(found.get(g, []), *GRID)
        assert (got != raster).sum() <= 2, g
        assert area(found.get(g, [])) == pytest.approx(raster.sum() / 1600, abs=0.15)


def test_squares_that_overlap_cross_touch_and_repeat(spark):
    groups = {
        "plus": ([box(1, 0, 2, 3), box(0, 1, 3, 2)], 5, 1, 0),
        "frame": ([box(0, 0, 4, 1), box(0, 3, 4, 4), box(0, 0, 1, 4), box(3, 0, 4, 4)], 12, 1, 1),
        "inside": ([box(0, 0, 4, 4), box(1, 1, 2, 2), box(1, 1, 2, 2), box(0, 0, 4, 4)], 16, 1, 0),
        "neighbours": ([box(0, 0, 1, 1), box(1, 0.25, 2, 0.75), box(1, 0, 2, 0.25), box(5, 5, 6, 6)], 2.75, 2, 0),
        "corner": ([box(0, 0, 1, 1), box(1, 1, 2, 2)], 2, None, 0),
        "partly": ([box(0, 0, 2, 1), box(1, 0, 3, 1), box(2.5, -1, 4, 0.5)], 5, 1, 0),
        "island": ([box(0, 0, 6, 1), box(0, 5, 6, 6), box(0, 0, 1, 6), box(5, 0, 6, 6), box(2, 2, 3, 3)], 21, 2, 1),
    }
    rows = [(g, [r]) for g, (rings, *_) in groups.items() for r in rings] + [("none", None), ("flat", [box(0, 0, 1, 0)]), (None, [box(0, 0, 1, 1)])]
    frame = spark.createDataFrame(rows, f"g string, polygon {POLYGON}").withColumns({c: F.lit("x") for c in ("side", "shape", "lo", "hi", "cx", "own", "xmin")})
    found = told(overlay.union_polygons(frame, "g", cell=0.7), "g")
    assert found.keys() == groups.keys()
    for g, (_, size, polygons, holes) in groups.items():
        assert area(found[g]) == pytest.approx(size), g
        assert polygons in (None, len(found[g])) and sum(len(p) - 1 for p in found[g]) == holes, g
    assert overlay.union_polygons(frame.limit(0), "g").count() == 0


def test_intersections_of_polygons_with_holes(spark):
    rng = np.random.default_rng(9)
    kind = f"k string, polygon {POLYGON}"
    shape = lambda: (lambda x, y: [box(x, y, x + 3, y + 2), box(x + 1, y + 0.5, x + 2, y + 1.5)])(*rng.uniform(0, 6, 2))
    areas = spark.createDataFrame([(f"a{i // 2}", shape() if i % 2 else [star(rng, 20 + i, 20, 2)]) for i in range(8)], kind)
    units = spark.createDataFrame([(f"u{i}", shape() if i % 3 else [star(rng, 20 + i, 20, 3)]) for i in range(9)], kind)
    found = {(r.a, r.u): r.common for r in overlay.intersections(areas.toDF("a", "polygon"), units.toDF("u", "polygon"), "a", "u", cell=1.5).collect()}
    pairs = areas.toDF("a", "p").crossJoin(units.toDF("u", "q")).groupBy("a", "u").agg(F.sum(geo.polygon_overlap_area(F.col("p"), F.col("q"))).alias("common"))
    want = {(r.a, r.u): r.common for r in pairs.collect() if r.common > 1e-9}
    assert found.keys() == want.keys() and len(want) > 8
    assert all(found[k] == pytest.approx(want[k], abs=1e-6) for k in want)
