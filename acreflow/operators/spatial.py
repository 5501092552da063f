"""Spatial joins on a grid, nearest places, overlays, clusters of adjacent parcels, dissolves, tiles.

A polygon is listed under each grid cell that its box touches, and meets only
what lies in those cells: an equi-join, with the exact test on what it finds.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreflow.functions import geo, shapes

from .graph import components
from .storage import materialize


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def with_cells(boxes: DataFrame, cell: float, pad: float = 0.0) -> DataFrame:
    """Rows with xmin, ymin, xmax, ymax, once for each grid cell (cx, cy) that the box touches."""
    wide = boxes.withColumn("cx", F.explode(_cells(F.col("xmin") - pad, F.col("xmax") + pad, cell)))
    return wide.withColumn("cy", F.explode(_cells(F.col("ymin") - pad, F.col("ymax") + pad, cell)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Pairs of points (x, y, ...) and polygons (polygon, xmin.., ...) that hold them."""
    placed = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    met = placed.join(with_cells(polygons, cell), ["cx", "cy"]).drop("cx", "cy")
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return met.filter(inside & geo.in_polygon(F.col("polygon"), F.col("x"), F.col("y")))


def within_distance(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (x, y, ...) and others (ox, oy, ...) at most ``radius`` apart in the plane."""
    around = points.withColumns({"xmin": F.col("x"), "xmax": F.col("x"), "ymin": F.col("y"), "ymax": F.col("y")})
    placed = with_cells(around, radius, radius).drop("xmin", "xmax", "ymin", "ymax")
    o = others.withColumn("cx", F.floor(F.col("ox") / radius)).withColumn("cy", F.floor(F.col("oy") / radius))
    return placed.join(o, ["cx", "cy"]).drop("cx", "cy").filter(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2) <= radius * radius)


#: Nearest places: a cell with more places is cut into 8 x 8, down to ``FINEST`` times.
CROWDED, FINEST = 64, 4


def _level(lon: Column, lat: Column, degrees: float, k: int) -> Column:
    side = degrees / 8**k
    return F.struct(F.lit(k).alias("k"), F.floor(lon / side).alias("cx"), F.floor(lat / side).alias("cy"))


def _reach(cells: DataFrame, degrees: float) -> DataFrame:
    """Pairs of points and cells with ``least`` and ``most``, metres to the nearest and the farthest spot of the cell's box; no most if the box reaches out of the point's.

    The nearest spot lies on the box's nearer meridian, where the perpendicular
    meets it or at its end nearer to that; the farthest one is a corner of the other.
    """
    lon, lat = F.col("lon"), F.col("lat")
    within = lambda v, lo, hi: F.greatest(F.col(lo), F.least(F.col(hi), v))
    far = lambda v, lo, hi: F.greatest(F.abs(F.col(lo) - v), F.abs(F.col(hi) - v))
    near_lon = within(lon, "west", "east")
    foot = F.degrees(F.atan(F.tan(F.radians(lat)) / F.cos(F.radians(near_lon - lon))))
    least = geo.haversine(lon, lat, near_lon, within(foot, "south", "north"))
    far_lon = F.when(F.abs(F.col("west") - lon) > F.abs(F.col("east") - lon), F.col("west")).otherwise(F.col("east"))
    most = F.greatest(geo.haversine(lon, lat, far_lon, F.col("south")), geo.haversine(lon, lat, far_lon, F.col("north")))
    met = cells.filter((F.abs(near_lon - lon) <= degrees) & (F.abs(within(lat, "south", "north") - lat) <= degrees))
    inside = (far(lon, "west", "east") <= degrees) & (far(lat, "south", "north") <= degrees)
    return met.withColumns({"least": least, "most": F.when(inside, most).otherwise(F.lit(float("inf")))})


def nearest_candidates(points: DataFrame, places: DataFrame, degrees: float = 0.5, most_metres: float = 50_000) -> DataFrame:
    """Pairs of points (lon, lat) and places (plon, plat, ...), distinct both, that hold every point's nearest place.

    Places lie in the cells of a tree: squares of ``degrees``, and where one is
    crowded its 64 parts, and so on.  A point begins with the squares around it
    and goes down into those that are crowded, one level a round.  A cell is
    given up when its nearest edge is farther than some other cell's places can
    be at most, so a point keeps a few small cells however dense the places lie.
    """
    levels = F.array(*[_level(F.col("plon"), F.col("plat"), degrees, k) for k in range(FINEST + 1)])
    each = places.select("plon", "plat", F.explode(levels).alias("c")).select("plon", "plat", "c.*")
    stats = each.groupBy("k", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("plon").alias("west"), F.min("plat").alias("south"), F.max("plon").alias("east"), F.max("plat").alias("north"))
    crowd = (F.col("n") > CROWDED) & (F.col("k") < FINEST)
    up = lambda c: F.floor(F.col(c) / 8)
    cells = materialize(stats.withColumns({"crowded": crowd, "px": up("cx"), "py": up("cy")}))
    split = cells.filter("crowded").select(F.col("k").alias("pk"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    under = cells.join(split.withColumn("k", F.col("pk") + 1).drop("pk"), ["k", "px", "py"], "left_semi")
    used = materialize(cells.filter("k = 0").unionByName(under))  # cells at whose place the tree is that deep

    around = F.sequence(F.lit(-1), F.lit(1))
    at = points.select("lon", "lat", F.explode(around).alias("i"), F.floor(F.col("lon") / degrees).alias("x"), F.floor(F.col("lat") / degrees).alias("y"))
    at = at.select("lon", "lat", (F.col("x") + F.col("i")).alias("cx"), F.explode(F.transform(around, lambda j: F.col("y") + j)).alias("cy"))
    own = Window.partitionBy("lon", "lat")

    def pruned(met: DataFrame) -> DataFrame:
        bound = F.least(F.min("most").over(own), F.lit(float(most_metres)))
        return met.withColumn("bound", bound).filter(F.col("least") <= F.col("bound") + 0.001).drop("bound")

    names = ["lon", "lat", "k", "cx", "cy", "crowded", "least", "most"]
    live = materialize(pruned(_reach(at.join(used.filter("k = 0"), ["cx", "cy"]), degrees)).select(*names))
    for _ in range(FINEST):
        deeper = live.filter("crowded").select("lon", "lat", (F.col("k") + 1).alias("k"), F.col("cx").alias("px"), F.col("cy").alias("py"))
        if deeper.isEmpty():
            break
        inner = _reach(deeper.join(used, ["k", "px", "py"]), degrees).select(*names)
        live = materialize(pruned(live.filter("NOT crowded").union(inner)))
    leaves = used.filter("NOT crowded").select("k", "cx", "cy")
    held = places.withColumn("c", F.explode(levels)).select(*places.columns, "c.*").join(leaves, ["k", "cx", "cy"])
    return live.select("lon", "lat", "k", "cx", "cy").join(held, ["k", "cx", "cy"]).filter((F.abs(F.col("lon") - F.col("plon")) <= degrees) & (F.abs(F.col("lat") - F.col("plat")) <= degrees))


def nearest(points: DataFrame, places: DataFrame, key: str, place: str, degrees: float = 0.5, most_metres: float = 50_000) -> DataFrame:
    """key, place, metres of the nearest place (plon, plat) to each point (lon, lat) inside a box of ``degrees`` around it; of equally near ones the least.

    Points and places in one spot are looked at once.
    """
    spots = points.select("lon", "lat").distinct()
    one_each = places.groupBy("plon", "plat").agg(F.min(place).alias("place"))
    met = nearest_candidates(spots, one_each, degrees, most_metres)
    far = met.withColumn("metres", geo.haversine(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat")))
    best = far.groupBy("lon", "lat").agg(F.min(F.struct("metres", "place")).alias("b")).filter(F.col("b.metres") < most_metres)
    found = points.select(key, "lon", "lat").join(best, ["lon", "lat"]).groupBy(key).agg(F.min("b").alias("b"))
    return found.select(key, F.col("b.place").alias(place), "b.metres")


def _overlaid(areas: DataFrame, units: DataFrame, cell: float) -> DataFrame:
    """Pairs of areas (box) and units (box as uxmin..) whose boxes meet, each once."""
    u = units.select("*", *[F.col(f"u{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    u = with_cells(u, cell).drop("xmin", "ymin", "xmax", "ymax")
    met = with_cells(areas, cell).join(u, ["cx", "cy"])
    touch = (F.col("xmin") < F.col("uxmax")) & (F.col("uxmin") < F.col("xmax")) & (F.col("ymin") < F.col("uymax")) & (F.col("uymin") < F.col("ymax"))
    # a pair is kept in the one cell that holds the corner where both boxes begin
    home = (F.floor(F.greatest("xmin", "uxmin") / cell) == F.col("cx")) & (F.floor(F.greatest("ymin", "uymin") / cell) == F.col("cy"))
    return met.filter(touch & home).drop("cx", "cy")


def _with_common(met: DataFrame, one: str, two: str) -> DataFrame:
    """``met`` with ``common``: the area that two rings or polygons of each row have in common."""

    def measure(batches):
        for batch in batches:
            sides = [batch.column(c) for c in (one, two)]
            missing = np.logical_or(*(pc.is_null(v).to_numpy(zero_copy_only=False) for v in sides))
            if "ring" in two:
                sides = [pa.ListArray.from_arrays(pa.array(range(len(v) + 1), pa.int32()), v) for v in sides]
            common, _ = shapes.common_areas(*map(shapes.edges, sides))
            yield batch.append_column("common", pa.array(common, mask=missing | np.isnan(common)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema)
    return met.mapInArrow(measure, f"{schema}, common double")


def overlays(areas: DataFrame, units: DataFrame, cell: float) -> DataFrame:
    """Pairs of areas (ring, box, ...) and units (unit_ring, box as uxmin.., ...) with their common area."""
    return _with_common(_overlaid(areas, units, cell), "unit_ring", "ring")


def polygon_overlays(areas: DataFrame, units: DataFrame, cell: float) -> DataFrame:
    """Pairs of areas (polygon, box, ...) and units (unit_polygon, box as uxmin.., ...), either with holes, with their common area.
    A multipolygon has a row for each of its polygons, whose areas add up."""
    return _with_common(_overlaid(areas, units, cell), "unit_polygon", "polygon")


def _measured(pairs: DataFrame, most: float, touching: bool = False) -> DataFrame:
    """a, b, distance of pairs (a, b, polygons ``one`` and ``two``) at most ``most`` apart; with lon and lat, of
    polygons in degrees on a plane that touches the earth there.  ``touching`` as by ``geo.touches``."""
    ground = "lon" in pairs.columns

    def measure(batches):
        for batch in batches:
            one, two = shapes.edges(batch.column("one")), shapes.edges(batch.column("two"))
            if ground:
                one, two = (shapes.on_plane(e, batch.column("lon").to_numpy(), batch.column("lat").to_numpy(), DEGREE) for e in (one, two))
            far = shapes.distances(one, two)
            out = [batch.column("a"), batch.column("b"), pa.array(far)]
            if touching:
                common, least = shapes.common_areas(shapes.edges(batch.column("one"), outer=True), shapes.edges(batch.column("two"), outer=True))
                out.append(pa.array((far <= 1e-9) & (common <= 1e-9 * least)))
            yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(far <= most))

    names = ["a", "b", "distance", *(["touching"] if touching else [])]
    kind = lambda c: pairs.schema[c].dataType.simpleString()
    return pairs.mapInArrow(measure, f"a {kind('a')}, b {kind('b')}, distance double" + (", touching boolean" if touching else ""))


def near_pairs(parcels: DataFrame, by: list[str], key: str = "id", eps: float = 1e-4, cell: float = 0.01, polygon: str | None = None, touching: bool = False) -> DataFrame:
    """a, b (the lesser key first) of parcels of one group at most ``eps`` apart, and ``distance``; if asked, whether their polygons are ``touching``.

    Distances are those of the boxes, or of the polygons in column ``polygon``,
    which then only are compared where the boxes are near.  A parcel is listed
    under each cell of a fixed grid that its box touches, so a large one makes
    more rows and no larger cells; a pair counts in one cell only.
    """
    shape = ["xmin", "ymin", "xmax", "ymax", *([polygon] if polygon else [])]
    boxes = parcels.filter(F.col("xmin").isNotNull()).select(*by, key, *shape)
    a = with_cells(boxes, cell, eps).select(*by, "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in (key, *shape)])
    b = with_cells(boxes, cell).select(*by, "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in (key, *shape)])
    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.col(f"b_{lo}") - F.col(f"a_{hi}"))
    apart = F.sqrt(F.pow(gap("xmin", "xmax"), 2) + F.pow(gap("ymin", "ymax"), 2))
    home = lambda axis, c: F.floor(F.greatest(F.col(f"a_{axis}") - eps, F.col(f"b_{axis}")) / cell) == F.col(c)
    most = eps * (1 + 1e-9)
    met = a.join(b, [*by, "cx", "cy"]).filter((F.col(f"a_{key}") < F.col(f"b_{key}")) & home("xmin", "cx") & home("ymin", "cy")).withColumn("distance", apart).filter(F.col("distance") <= most)
    if polygon:
        return _measured(met.select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), F.col(f"a_{polygon}").alias("one"), F.col(f"b_{polygon}").alias("two")), most, touching)
    return met.select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), "distance")


#: Metres of a degree of latitude.
DEGREE = math.pi / 180 * 6371008.8


def near_pairs_metres(parcels: DataFrame, by: list[str], key: str = "id", metres: float = 10.0, cell: float = 0.01, polygon: str | None = None) -> DataFrame:
    """a, b (the lesser key first) of parcels (degrees) of one group at most ``metres`` apart on the ground, and ``distance`` in metres.

    Cells are of the fixed grid in degrees; boxes are widened by the metres, east
    and west by as many degrees as they make at the box's latitude.  Distances of
    polygons, or of boxes if there are none, are taken in metres on a plane that
    touches the earth between the two, which is exact enough for neighbours.
    """
    has = [c for c in (polygon,) if c]
    boxes = parcels.filter(F.col("xmin").isNotNull()).select(*by, key, "xmin", "ymin", "xmax", "ymax", *has)
    if not polygon:
        polygon = "__box"
        boxes = boxes.withColumn(polygon, F.array(geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))))
    up = F.lit(metres / DEGREE * 1.001)
    across = up / F.cos(F.radians(F.least(F.greatest(F.abs("ymin"), F.abs("ymax")) + up, F.lit(89.9))))
    wide = boxes.withColumns({"xmin": F.col("xmin") - across, "xmax": F.col("xmax") + across, "ymin": F.col("ymin") - up, "ymax": F.col("ymax") + up})
    shape = ["xmin", "ymin", "xmax", "ymax", polygon]
    a = with_cells(wide, cell).select(*by, "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in (key, *shape)])
    b = with_cells(boxes, cell).select(*by, "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in (key, *shape)])
    home = lambda axis, c: F.floor(F.greatest(F.col(f"a_{axis}"), F.col(f"b_{axis}")) / cell) == F.col(c)
    meet = (F.col("a_xmin") <= F.col("b_xmax")) & (F.col("b_xmin") <= F.col("a_xmax")) & (F.col("a_ymin") <= F.col("b_ymax")) & (F.col("b_ymin") <= F.col("a_ymax"))
    met = a.join(b, [*by, "cx", "cy"]).filter((F.col(f"a_{key}") < F.col(f"b_{key}")) & home("xmin", "cx") & home("ymin", "cy") & meet)
    lon, lat = (F.col("a_xmin") + F.col("a_xmax")) / 2, (F.greatest("a_ymin", "b_ymin") + F.least("a_ymax", "b_ymax")) / 2
    return _measured(met.select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), F.col(f"a_{polygon}").alias("one"), F.col(f"b_{polygon}").alias("two"), lon.alias("lon"), lat.alias("lat")), metres)


def adjacent_clusters(parcels: DataFrame, by: list[str], key: str = "id", eps: float = 1e-4, cell: float = 0.01, polygon: str | None = None, metres: float | None = None) -> DataFrame:
    """key, cluster (the least key) of parcels at most ``eps`` apart inside each group, by ``near_pairs``; with ``metres``, so far apart on the ground.

    A parcel near any member joins a cluster, which is the same as being near the
    members' merged outline.
    """
    pairs = near_pairs(parcels, by, key, eps, cell, polygon) if metres is None else near_pairs_metres(parcels, by, key, metres, cell, polygon)
    label = components(pairs.select("a", "b")).toDF("node", "component")
    mapped = parcels.filter(F.col("xmin").isNotNull()).select(key)
    return mapped.join(label, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("cluster"))


_P = "struct<x:double,y:double>"


def _directed_edges(parcels: DataFrame, by: str, ring: str, cell: float | None) -> DataFrame:
    """by, p, q: the edges of all rings, counter-clockwise, cut where a corner of the group lies on them."""
    r = F.col(ring)
    turned = F.when(geo.ring_area(r) < 0, F.reverse(r)).otherwise(r)
    edges = F.zip_with(F.slice(turned, F.lit(1), F.size(r) - 1), F.slice(turned, F.lit(2), F.size(r) - 1), lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    flat = parcels.select(by, F.explode(edges).alias("e")).select(by, "e.p", "e.q").filter("p != q")
    if cell is None:
        return flat
    corners = flat.select(by, F.col("p").alias("c")).distinct()
    placed = corners.withColumns({"cx": F.floor(F.col("c.x") / cell), "cy": F.floor(F.col("c.y") / cell)})
    ends = {f"{axis}{end}": pick(f"p.{axis}", f"q.{axis}") for axis in ("x", "y") for end, pick in (("min", F.least), ("max", F.greatest))}
    boxes = with_cells(flat.distinct().withColumns(ends), cell)
    between = F.col("c.x").between(F.col("xmin"), F.col("xmax")) & F.col("c.y").between(F.col("ymin"), F.col("ymax")) & (F.col("c") != F.col("p")) & (F.col("c") != F.col("q"))
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    across = F.abs(dx * (F.col("c.y") - F.col("p.y")) - dy * (F.col("c.x") - F.col("p.x")))
    on = boxes.join(placed, [by, "cx", "cy"]).filter(between & (across <= 1e-12 * (dx * dx + dy * dy)))
    along = F.pow(F.col("c.x") - F.col("p.x"), 2) + F.pow(F.col("c.y") - F.col("p.y"), 2)
    cuts = on.groupBy(by, "p", "q").agg(F.transform(F.array_sort(F.collect_set(F.struct(along.alias("d"), "c"))), lambda x: x["c"]).alias("cuts"))
    walk = F.concat(F.array("p"), F.coalesce("cuts", F.array().cast(f"array<{_P}>")), F.array("q"))
    pieces = F.zip_with(F.slice(walk, F.lit(1), F.size(walk) - 1), F.slice(walk, F.lit(2), F.size(walk) - 1), lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    return flat.join(cuts, [by, "p", "q"], "left").select(by, F.explode(pieces).alias("e")).select(by, "e.p", "e.q")


def dissolve_edges(parcels: DataFrame, by: str, ring: str = "ring", cell: float | None = None) -> DataFrame:
    """The outline of each group of rings that do not overlap, as directed edges p, q with the inside on their left:
    those that no neighbour has the other way round.  With ``cell``, the size of a grid, neighbours may share parts of edges."""
    edges = _directed_edges(parcels, by, ring, cell)
    forth = F.struct("p.x", "p.y") < F.struct("q.x", "q.y")
    both = edges.select(by, F.when(forth, F.col("p")).otherwise(F.col("q")).alias("lo"), F.when(forth, F.col("q")).otherwise(F.col("p")).alias("hi"), F.when(forth, 1).otherwise(-1).alias("way"))
    left = both.groupBy(by, "lo", "hi").agg(F.sum("way").alias("way")).filter("way != 0")
    ahead = F.col("way") > 0
    return left.select(by, F.when(ahead, F.col("lo")).otherwise(F.col("hi")).alias("p"), F.when(ahead, F.col("hi")).otherwise(F.col("lo")).alias("q"))


def _turn(to: tuple, at: tuple, back: float) -> float:
    """How far right of the way back an edge leaves a corner, clockwise: the least is the sharpest turn to the left."""
    return (back - math.atan2(to[1] - at[1], to[0] - at[0])) % (2 * math.pi) or 2 * math.pi


def _traced(group) -> list[list[tuple[float, float]]]:
    """The closed rings of directed edges; where several leave a corner, the sharpest turn to the left is taken, so rings touch and do not cross."""
    leave: dict[tuple, list] = {}
    for px, py, qx, qy in group:
        leave.setdefault((px, py), []).append((qx, qy))
    rings = []
    for begin in sorted(leave):
        while leave[begin]:
            ring, at = [begin], leave[begin].pop()
            while at != begin:
                back = math.atan2(ring[-1][1] - at[1], ring[-1][0] - at[0])
                ways = leave[at]
                to = min(ways, key=lambda to, at=at, back=back: _turn(to, at, back))
                ways.remove(to)
                ring.append(at)
                at = to
            rings.append([*ring, begin])
    return rings


def _straight(ring: list) -> list:
    """A ring without the points inside straight lines."""
    body = ring[:-1]
    kept = [b for a, b, c in zip(body[-1:] + body[:-1], body, body[1:] + body[:1], strict=True) if abs((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])) > 1e-12 * ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 * ((c[0] - b[0]) ** 2 + (c[1] - b[1]) ** 2) ** 0.5]
    return [*kept, kept[0]] if kept else ring


def dissolve(parcels: DataFrame, by: str, ring: str = "ring", cell: float = 0.01) -> DataFrame:
    """by, polygon: a row for each polygon of the union of each group's rings, which may share edges or parts of them but not overlap.

    Outlines are traced apart for each ring, found as components of edges that
    follow one another, so a task holds no more than one ring.  A hole
    belongs to the least outside that holds it, met in the cells of a grid.
    """
    return trace_polygons(materialize(dissolve_edges(parcels, by, ring, cell)), by, cell)


def _groups(batches, keys: int):
    """Runs of sorted rows that begin with the same values: (those, the rows' other values)."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    plain = lambda row: tuple(None if v != v else v for v in row[:keys])
    for key, run in itertools.groupby(rows, plain):
        yield key, (row[keys:] for row in run)


#: Rows and points that are put in one batch.
BATCH = 10_000


def _next_edges(outline: DataFrame, by: str) -> DataFrame:
    """a, b: the number of each edge (``edge``) and of the one that goes on from its end, by the sharpest turn to the left."""
    ray = lambda at, to, comes: outline.select(by, F.col(f"{at}.x").alias("x"), F.col(f"{at}.y").alias("y"), F.lit(comes).alias("comes"), F.col(f"{to}.x").alias("tx"), F.col(f"{to}.y").alias("ty"), "edge")
    rays = ray("q", "p", True).union(ray("p", "q", False))

    def link(batches):
        found: list[tuple[int, int]] = []
        for (_, x, y), run in _groups(batches, 3):
            run = list(run)
            leaving = [((tx, ty), edge) for comes, tx, ty, edge in run if not comes]
            for comes, tx, ty, edge in run:
                if comes and leaving:
                    back = math.atan2(ty - y, tx - x)
                    best = leaving[0] if len(leaving) == 1 else min(leaving, key=lambda way, x=x, y=y, back=back: _turn(way[0], (x, y), back))
                    leaving.remove(best)
                    found.append((edge, best[1]))
            if len(found) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["a", "b"])

    return rays.repartition(by, "x", "y").sortWithinPartitions(by, "x", "y", "comes", "tx", "ty").mapInArrow(link, "a long, b long")


def trace_polygons(outline: DataFrame, by: str, cell: float) -> DataFrame:
    """by, polygon of a written outline: directed edges p, q with the inside on their left.

    Edges are linked at each corner, so a task holds one ring and not all rings that touch one another.
    """
    outline = outline.withColumn("edge", F.xxhash64(by, "p.x", "p.y", "q.x", "q.y"))
    pieces = components(_next_edges(outline, by))
    flat = outline.join(pieces, F.col("edge") == F.col("node"), "left").select(F.coalesce("component", "edge").alias("piece"), by, F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("q.x").alias("qx"), F.col("q.y").alias("qy"))
    names = [by, "ring", "area", "xmin", "ymin", "xmax", "ymax"]

    def trace(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kind, shape = first.schema.field(1).type, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        made: list[tuple] = []
        points = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], shape), *(pa.array(c, pa.float64()) for c in columns[2:])], names=names)

        for (_, group), run in _groups(itertools.chain([first], batches), 2):
            for ring in map(_straight, _traced(run)):
                area = 0.0
                for (ax, ay), (bx, by_) in itertools.pairwise(ring):
                    area += ax * by_ - bx * ay
                xs, ys = [x for x, _ in ring], [y for _, y in ring]
                made.append((group, [{"x": x, "y": y} for x, y in ring], area / 2, min(xs), min(ys), max(xs), max(ys)))
                points += len(ring)
            if points >= BATCH:
                yield batch()
                made, points = [], 0
        if made:
            yield batch()

    kind = outline.schema[by].dataType.simpleString()
    box = ", ".join(f"{c} double" for c in names[2:])
    sized = materialize(flat.repartition(by, "piece").sortWithinPartitions("piece", by, "px", "py", "qx", "qy").mapInArrow(trace, f"`{by}` {kind}, ring {geo.RING}, {box}"))
    sized = sized.withColumn("id", F.xxhash64(F.lit(by), by, "ring"))
    outer, holes = sized.filter("area > 0"), sized.filter("area < 0")
    # a point of the hole that no outside passes through: the middle of its first edge
    middle = lambda axis: ((F.get("ring", 0)[axis] + F.get("ring", 1)[axis]) / 2).alias(axis)
    inside = holes.select(by, F.col("ring").alias("hole"), middle("x"), middle("y"), (-F.col("area")).alias("hole_area"))
    placed = inside.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    met = placed.join(with_cells(outer.select(by, "ring", "area", "id", "xmin", "ymin", "xmax", "ymax"), cell), [by, "cx", "cy"]).filter((F.col("area") >= F.col("hole_area")) & geo.in_ring(F.col("ring"), F.col("x"), F.col("y")))
    held = met.groupBy(by, "hole").agg(F.min(F.struct("area", "id")).alias("of")).groupBy("of.id").agg(F.sort_array(F.collect_list("hole")).alias("holes"))
    return outer.join(held, "id", "left").select(by, F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(f"array<{geo.RING}>"))).alias("polygon"))
