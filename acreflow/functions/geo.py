"""Geometry as columns: points are x, y; a ring is array<struct<x,y>>; a polygon
is an array of rings, the first its outside; a multipolygon an array of polygons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

EARTH = 6378137.0
WORLD = math.pi * EARTH
RING = "array<struct<x:double,y:double>>"


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH


def to_mercator(polygons: Column) -> Column:
    """Polygons of lon and lat in web-mercator metres."""
    point = lambda p: F.struct(mercator_x(p["x"]).alias("x"), mercator_y(p["y"]).alias("y"))
    return F.transform(polygons, lambda polygon: F.transform(polygon, lambda r: F.transform(r, point)))


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180) / 360 * F.pow(F.lit(2.0), zoom))


def tile_y(lat: Column, zoom: Column) -> Column:
    rad = F.radians(lat)
    return F.floor((1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * F.pow(F.lit(2.0), zoom))


def tile_envelope(zoom: Column, x: Column, y: Column) -> Column:
    """struct of xmin, ymin, xmax, ymax in web-mercator metres."""
    size = F.lit(2 * WORLD) / F.pow(F.lit(2.0), zoom)
    return F.struct((x * size - WORLD).alias("xmin"), (WORLD - (y + 1) * size).alias("ymin"), ((x + 1) * size - WORLD).alias("xmax"), (WORLD - y * size).alias("ymax"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    """Metres between two points on a sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * 2 * radius


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(xmin, ymin), at(xmax, ymin), at(xmax, ymax), at(xmin, ymax), at(xmin, ymin))


def _edges(ring: Column) -> Column:
    """Each point with the one after it."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    """Signed planar area: positive if counter-clockwise."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def polygon_area(polygon: Column) -> Column:
    """Planar area of the outside less the holes."""
    return F.aggregate(polygon, F.lit(None).cast("double"), lambda s, r: F.when(s.isNull(), F.abs(ring_area(r))).otherwise(s - F.abs(ring_area(r))))


def geodesic_area(ring: Column) -> Column:
    """Square metres on a sphere."""
    part = lambda e: (F.radians(e["b"]["x"]) - F.radians(e["a"]["x"])) * (2 + F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"])))
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + part(e))) * (EARTH * EARTH / 2)


def ring_centroid(ring: Column) -> Column:
    """struct of x, y: the area centroid."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    edges = _edges(ring)
    area = ring_area(ring) * 6
    x = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["a"]["x"] + e["b"]["x"]) * cross(e)) / area
    y = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["a"]["y"] + e["b"]["y"]) * cross(e)) / area
    return F.struct(x.alias("x"), y.alias("y"))


def envelope(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside a ring, by ray casting; points on an edge may go either way."""
    def flips(e: Column) -> Column:
        crosses = (e["a"]["y"] > y) != (e["b"]["y"] > y)
        return crosses & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])

    return F.aggregate(_edges(ring), F.lit(False), lambda s, e: s != F.when((e["a"]["y"] > y) != (e["b"]["y"] > y), flips(e)).otherwise(False))


def in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    return F.aggregate(polygon, F.lit(False), lambda s, r: s != in_ring(r, x, y))


def vertex_mean(ring: Column) -> Column:
    """struct of x, y: the mean of a ring's points, the closing one left out."""
    points = F.slice(ring, F.lit(1), F.size(ring) - 1)
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def box_centre(ring: Column) -> Column:
    """struct of x, y: the middle of a ring's box."""
    e = envelope(ring)
    return F.struct(((e["xmin"] + e["xmax"]) / 2).alias("x"), ((e["ymin"] + e["ymax"]) / 2).alias("y"))


def _side(a: Column, b: Column, p: Column) -> Column:
    """Positive if ``p`` lies to the left of the line from ``a`` to ``b``."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _point_gap2(p: Column, e: Column) -> Column:
    """Squared distance of a point and an edge."""
    a, b = e["a"], e["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    along = ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return F.pow(p["x"] - a["x"] - t * dx, F.lit(2)) + F.pow(p["y"] - a["y"] - t * dy, F.lit(2))


def _edge_gap2(e: Column, f: Column) -> Column:
    """Squared distance of two edges, 0 if they cross."""
    cross = (_side(e["a"], e["b"], f["a"]) * _side(e["a"], e["b"], f["b"]) < 0) & (_side(f["a"], f["b"], e["a"]) * _side(f["a"], f["b"], e["b"]) < 0)
    return F.when(cross, F.lit(0.0)).otherwise(F.least(_point_gap2(e["a"], f), _point_gap2(e["b"], f), _point_gap2(f["a"], e), _point_gap2(f["b"], e)))


def distance(one: Column, two: Column) -> Column:
    """Planar distance of two polygons, 0 if they touch or overlap.  Each edge meets each of the other: for pairs that are near by their boxes."""

    def gap(a: Column, b: Column) -> Column:
        edges = lambda polygon: F.flatten(F.transform(polygon, _edges))
        both = F.struct(edges(a).alias("a"), edges(b).alias("b"))
        nearest = let(both, lambda x: F.array_min(F.transform(x["a"], lambda e: F.array_min(F.transform(x["b"], lambda f: _edge_gap2(e, f))))))
        inside = lambda q, r: in_polygon(q, F.get(F.get(r, 0), 0)["x"], F.get(F.get(r, 0), 0)["y"])
        return F.when(inside(a, b) | inside(b, a), F.lit(0.0)).otherwise(F.sqrt(nearest))

    return let(F.struct(one.alias("one"), two.alias("two")), lambda x: gap(x["one"], x["two"]))


def _cut(points: Column, a: Column, b: Column) -> Column:
    """The part of an open ring of points to the left of the line from ``a`` to ``b``, by one step of polygon clipping."""
    n = F.size(points)

    def at(p: Column, i: Column) -> Column:
        q = F.get(points, (i + n - 1) % n)
        s, t = _side(a, b, p), _side(a, b, q)
        f = t / F.nullif(t - s, F.lit(0.0))
        meets = F.struct((q["x"] + (p["x"] - q["x"]) * f).alias("x"), (q["y"] + (p["y"] - q["y"]) * f).alias("y"))
        return F.concat(F.when((s >= 0) != (t >= 0), F.array(meets)).otherwise(F.array().cast(RING)), F.when(s >= 0, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y")))).otherwise(F.array().cast(RING)))

    return F.flatten(F.transform(points, at))


def overlap_area(one: Column, two: Column) -> Column:
    """Planar area that two rings have in common; either may be concave.

    ``two`` is the sum of the triangles from its first point to its edges, each
    with the sign of its turn; ``one`` is clipped by each triangle.
    """

    def in_triangle(ring: Column, o: Column, e: Column) -> Column:
        turn = F.signum(_side(o, e["a"], e["b"]))
        left = F.when(turn > 0, F.struct(o.alias("p"), e["a"].alias("q"), e["b"].alias("r"))).otherwise(F.struct(o.alias("p"), e["b"].alias("q"), e["a"].alias("r")))
        corners = lambda t: F.array(F.struct(t["p"].alias("a"), t["q"].alias("b")), F.struct(t["q"].alias("a"), t["r"].alias("b")), F.struct(t["r"].alias("a"), t["p"].alias("b")))
        open_ring = F.slice(ring, F.lit(1), F.size(ring) - 1)
        clipped = let(left, lambda t: F.aggregate(corners(t), open_ring, lambda points, line: _cut(points, line["a"], line["b"])))
        area = let(clipped, lambda points: F.when(F.size(points) > 2, ring_area(F.concat(points, F.slice(points, 1, 1)))).otherwise(F.lit(0.0)))
        return F.when(turn == 0, F.lit(0.0)).otherwise(turn * area)

    def total(x: Column) -> Column:
        o = F.get(x["two"], 0)
        return F.abs(F.aggregate(_edges(x["two"]), F.lit(0.0), lambda s, e: s + in_triangle(x["one"], o, e)))

    return let(F.struct(one.alias("one"), two.alias("two")), total)


def polygon_overlap_area(one: Column, two: Column) -> Column:
    """Planar area that two polygons with holes have in common: rings count with the sign of outside or hole."""

    def total(x: Column) -> Column:
        sign = lambda i, j: F.when((i == 0) == (j == 0), F.lit(1.0)).otherwise(F.lit(-1.0))
        inner = lambda r, i: F.aggregate(F.transform(x["two"], lambda q, j: sign(i, j) * overlap_area(r, q)), F.lit(0.0), lambda s, v: s + v)
        return F.aggregate(F.transform(x["one"], inner), F.lit(0.0), lambda s, v: s + v)

    return let(F.struct(one.alias("one"), two.alias("two")), total)


def outline_length(polygon: Column) -> Column:
    """Planar length of all rings."""
    step = lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], F.lit(2)) + F.pow(e["b"]["y"] - e["a"]["y"], F.lit(2)))
    return F.aggregate(F.flatten(F.transform(polygon, _edges)), F.lit(0.0), lambda s, e: s + step(e))


def touches(one: Column, two: Column, tolerance: float = 1e-9) -> Column:
    """Whether two polygons meet, and have no area in common.  Holes are not filled by the other's area."""
    least = lambda p: F.abs(ring_area(F.get(p, 0)))
    apart = overlap_area(F.get(one, 0), F.get(two, 0)) <= tolerance * F.least(least(one), least(two))
    return (distance(one, two) <= tolerance) & apart


def parse_wkt(wkt: Column) -> Column:
    """The rings of a POLYGON text, or one ring of one point for a POINT; null for anything else."""
    body = F.regexp_extract(wkt, r"(?i)^\s*(?:POINT|POLYGON)\s*\((.*)\)\s*$", 1)
    inner = F.regexp_replace(F.regexp_replace(body, r"^\s*\(", ""), r"\)\s*$", "")
    point = lambda p: F.struct(F.split(F.btrim(p), r"\s+")[0].try_cast("double").alias("x"), F.get(F.split(F.btrim(p), r"\s+"), 1).try_cast("double").alias("y"))
    rings = F.transform(F.split(inner, r"\)\s*,\s*\("), lambda r: F.transform(F.split(r, ","), point))
    return F.when(body != "", rings)


def to_wkt(polygon: Column) -> Column:
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")"))
    return F.concat(F.lit("POLYGON("), F.array_join(F.transform(polygon, ring), ","), F.lit(")"))


def circle(lon: Column, lat: Column, metres: float = 500, sides: int = 32) -> Column:
    """The ring of a circle by equirectangular offsets; its first point stands at the end twice, as in the source."""
    def at(i: Column) -> Column:
        angle = i / sides * (2 * math.pi)
        dx, dy = F.cos(angle) * metres, F.sin(angle) * metres
        return F.struct((lon + dx / EARTH * (180 / math.pi) / F.cos(lat * math.pi / 180)).alias("x"), (lat + dy / EARTH * (180 / math.pi)).alias("y"))

    points = F.transform(F.sequence(F.lit(0), F.lit(sides)), at)
    return F.concat(points, F.slice(points, 1, 1))


def feature(geometry: Column, **properties: Column) -> Column:
    """A GeoJSON feature of a polygon as text."""
    pairs = F.transform(geometry, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), pairs.alias("coordinates")).alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))
