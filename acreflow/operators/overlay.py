"""Union, intersection and difference of polygons that may overlap, have holes and come in several parts.

A planar arrangement as joins: all edges of a group are cut where they meet
others, found in the cells of a grid; equal pieces become one row, which knows
how many shapes lie to its left and to its right and which others cover it.  A
piece belongs to the outline of the result if just one of its sides is inside.
Every step is an equi-join or an aggregate by group and cell, so neither a group
nor a large polygon has to fit in a task.

Shapes are rows of ``by`` (the group), ``side`` (0 or 1), ``shape`` (a number of
its own in its group) and ``polygon`` (array of rings, the first the outside,
turned either way); a shape of several polygons has several rows.  Coordinates
are rounded to ``digits`` decimals, as are the points where edges cross.
A ring must not cross itself.  Polygons without area or with null parts are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreflow.functions import geo
from acreflow.functions.binding import let

from .spatial import trace_polygons, with_cells
from .storage import materialize

_P = "struct<x:double,y:double>"


def _snapped(v: Column, digits: int) -> Column:
    return F.rint(v * float(10**digits)) / float(10**digits) + 0.0


def _turned(polygon: Column) -> Column:
    """The outside counter-clockwise, holes clockwise; rings without area go."""
    rings = F.transform(polygon, lambda r, i: let(geo.ring_area(r), lambda a: F.when(a == 0, F.lit(None).cast(geo.RING)).when((a > 0) == (i == 0), r).otherwise(F.reverse(r))))
    return let(rings, lambda x: F.when(F.get(x, 0).isNotNull(), F.filter(x, lambda r: r.isNotNull())))


def prepared(shapes: DataFrame, by: str, digits: int) -> DataFrame:
    """by, side, shape, polygon, each polygon of a group and side once."""
    whole = ~F.exists("polygon", lambda r: r.isNull() | F.exists(r, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull()))
    snapped = F.transform("polygon", lambda r: F.transform(r, lambda p: F.struct(_snapped(p["x"], digits).alias("x"), _snapped(p["y"], digits).alias("y"))))
    plain = shapes.filter(F.col(by).isNotNull() & F.col("polygon").isNotNull() & whole).select(by, "side", "shape", _turned(snapped).alias("polygon"))
    return plain.filter("polygon IS NOT NULL").groupBy(by, "side", "polygon").agg(F.min("shape").alias("shape"))


def _ordered(p: Column, q: Column) -> list[Column]:
    """The ends in order, and whether that is the edge's own direction."""
    forth = p < q
    return [F.when(forth, p).otherwise(q).alias("lo"), F.when(forth, q).otherwise(p).alias("hi"), forth.alias("forth")]


def _edges(polygons: DataFrame, by: str) -> DataFrame:
    """by, side, shape, lo, hi, forth of every edge; inside lies on its left."""
    pairs = lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    flat = polygons.select(by, "side", "shape", F.explode(F.flatten(F.transform("polygon", pairs))).alias("e")).filter("e.p != e.q")
    return flat.select(by, "side", "shape", *_ordered(F.col("e.p"), F.col("e.q")))


def _cuts(edges: DataFrame, by: str, cell: float, digits: int) -> DataFrame:
    """by, lo, hi, cuts: the points, in order from lo, where an edge meets others of its group."""
    one = edges.select(by, "lo", "hi").distinct()
    ends = {f"{axis}{end}": pick(F.col(f"lo.{axis}"), F.col(f"hi.{axis}")) for axis in ("x", "y") for end, pick in (("min", F.least), ("max", F.greatest))}
    placed = with_cells(one.withColumns(ends), cell)
    names = ["lo", "hi", *ends]
    met = placed.join(placed.select(by, "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in names]), [by, "cx", "cy"])
    near = (F.col("xmin") <= F.col("o_xmax")) & (F.col("o_xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("o_ymax")) & (F.col("o_ymin") <= F.col("ymax"))
    met = met.filter(near & ((F.col("lo") != F.col("o_lo")) | (F.col("hi") != F.col("o_hi"))))
    p, q, r, s = F.col("lo"), F.col("hi"), F.col("o_lo"), F.col("o_hi")
    cross = lambda o, a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])
    length = lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
    on_line = lambda c, a, b: F.abs(cross(a, b, c)) <= 0.75 * 10.0**-digits * length(a, b)

    def touched(c: Column) -> Column:
        """An end of the other edge that lies on this one."""
        along = (c["x"] - p["x"]) * (q["x"] - p["x"]) + (c["y"] - p["y"]) * (q["y"] - p["y"])
        return F.when((c != p) & (c != q) & (along > 0) & (along < F.pow(length(p, q), 2)) & on_line(c, p, q), c)

    # both edges of a pair compute the same point: from the lesser one of the two
    first = F.struct("lo", "hi") < F.struct("o_lo", "o_hi")
    pick = lambda x, y: F.when(first, x).otherwise(y)
    met = met.withColumns({"ea": pick(p, r), "eb": pick(q, s), "ec": pick(r, p), "ed": pick(s, q)})
    a, b, c, d = (F.col(f"e{x}") for x in "abcd")
    # plain columns, each in a step of its own, are compiled; the functions of arrays are not
    met = met.withColumns({"of_a": cross(a, c, d), "of_b": cross(b, c, d), "of_c": cross(a, b, c), "of_d": cross(a, b, d), "one": length(a, b), "two": length(c, d)})
    least = 0.75 * 10.0**-digits
    over = (F.signum("of_c") * F.signum("of_d") < 0) & (F.signum("of_a") * F.signum("of_b") < 0)
    clear = (F.least(F.abs("of_c"), F.abs("of_d")) > least * F.col("one")) & (F.least(F.abs("of_a"), F.abs("of_b")) > least * F.col("two"))
    t = F.col("of_a") / F.nullif(F.col("of_a") - F.col("of_b"), F.lit(0.0))
    at = F.struct(_snapped(a["x"] + t * (b["x"] - a["x"]), digits).alias("x"), _snapped(a["y"] + t * (b["y"] - a["y"]), digits).alias("y"))
    points = F.array(touched(r), touched(s), F.when(over & clear, at))
    found = met.select(by, "lo", "hi", F.explode(points).alias("c")).filter("c IS NOT NULL AND c != lo AND c != hi").distinct()
    away = F.pow(F.col("c.x") - F.col("lo.x"), 2) + F.pow(F.col("c.y") - F.col("lo.y"), 2)
    return found.groupBy(by, "lo", "hi").agg(F.transform(F.array_sort(F.collect_list(F.struct(away.alias("d"), "c"))), lambda x: x["c"]).alias("cuts"))


def arrangement(shapes: DataFrame, by: str, cell: float, digits: int = 9) -> DataFrame:
    """by, lo, hi and, for each side, how many shapes lie left and right of that piece of an edge (l0, r0, l1, r1)."""
    polygons = materialize(prepared(shapes, by, digits))
    edges = materialize(_edges(polygons, by))
    cut = edges.join(_cuts(edges, by, cell, digits), [by, "lo", "hi"], "left")
    walk = F.concat(F.array("lo"), F.coalesce("cuts", F.array().cast(f"array<{_P}>")), F.array("hi"))
    steps = F.zip_with(F.slice(walk, F.lit(1), F.size(walk) - 1), F.slice(walk, F.lit(2), F.size(walk) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = cut.select(by, "side", "shape", "forth", F.explode(steps).alias("e")).filter("e.a != e.b")
    onward = F.when(F.col("forth"), F.col("e.a")).otherwise(F.col("e.b")), F.when(F.col("forth"), F.col("e.b")).otherwise(F.col("e.a"))
    each = each.select(by, "side", "shape", *_ordered(*onward))
    own = lambda side, forth: F.count_if((F.col("side") == side) & (F.col("forth") == forth))
    pieces = each.groupBy(by, "lo", "hi").agg(own(0, True).alias("f0"), own(0, False).alias("b0"), own(1, True).alias("f1"), own(1, False).alias("b1"), F.collect_set("shape").alias("own"))
    pieces = materialize(pieces)

    middle = lambda axis: (F.col(f"lo.{axis}") + F.col(f"hi.{axis}")) / 2
    points = pieces.select(by, "lo", "hi", "own", middle("x").alias("mx"), middle("y").alias("my")).withColumns({"cx": F.floor(F.col("mx") / cell), "cy": F.floor(F.col("my") / cell)})
    e = geo.envelope(F.get("polygon", 0))
    boxes = with_cells(polygons.select(by, "side", "shape", "polygon", e.alias("e")).select(by, "side", "shape", "polygon", "e.*"), cell)
    inside = F.col("mx").between(F.col("xmin"), F.col("xmax")) & F.col("my").between(F.col("ymin"), F.col("ymax")) & ~F.array_contains("own", F.col("shape")) & geo.in_polygon(F.col("polygon"), F.col("mx"), F.col("my"))
    covered = points.join(boxes, [by, "cx", "cy"]).filter(inside).groupBy(by, "lo", "hi").agg(F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1"))
    full = pieces.join(covered, [by, "lo", "hi"], "left").fillna(0, ["c0", "c1"])
    return full.select(by, "lo", "hi", *[(F.col(f"{way}{s}") + F.col(f"c{s}")).alias(f"{name}{s}") for s in (0, 1) for way, name in (("f", "l"), ("b", "r"))])


def outline(pieces: DataFrame, by: str, inside) -> DataFrame:
    """by, p, q: the pieces of an arrangement between in and out, with the inside on their left; ``inside`` takes the two counts of a side."""
    left, right = inside(F.col("l0"), F.col("l1")), inside(F.col("r0"), F.col("r1"))
    return pieces.filter(left != right).select(by, F.when(left, F.col("lo")).otherwise(F.col("hi")).alias("p"), F.when(left, F.col("hi")).otherwise(F.col("lo")).alias("q"))


RULES = {"union": lambda a, b: (a > 0) | (b > 0), "intersection": lambda a, b: (a > 0) & (b > 0), "difference": lambda a, b: (a > 0) & (b == 0)}


def combined(shapes: DataFrame, by: str, rule: str = "union", cell: float = 0.01, digits: int = 9) -> DataFrame:
    """by, polygon: a row for each polygon of each group's union, of what its sides have in common, or of side 0 without side 1."""
    edges = outline(arrangement(shapes, by, cell, digits), by, RULES[rule])
    return trace_polygons(materialize(edges), by, cell)


def union_polygons(parcels: DataFrame, by: str, polygon: str = "polygon", cell: float = 0.01, digits: int = 9) -> DataFrame:
    """by, polygon: a row for each polygon of the union of each group's polygons, which may overlap."""
    shapes = parcels.select(by, F.lit(0).alias("side"), F.xxhash64(polygon).alias("shape"), F.col(polygon).alias("polygon"))
    return combined(shapes, by, "union", cell, digits)


def intersections(areas: DataFrame, units: DataFrame, area: str, unit: str, cell: float = 0.01, digits: int = 9) -> DataFrame:
    """area, unit, polygons, common: the polygons that an area and a unit (keys; ``polygon`` each) have in common, and their area, for each pair that has any.

    A key may have several rows, one for each of its polygons.
    """
    boxed = lambda d, key, name: d.select(F.col(key).alias(name), "polygon", geo.envelope(F.get("polygon", 0)).alias("e")).select(name, "polygon", "e.*")
    a, u = boxed(areas, area, "area"), boxed(units, unit, "unit")
    met = with_cells(a, cell).join(with_cells(u, cell).toDF("unit", "u_polygon", "uxmin", "uymin", "uxmax", "uymax", "cx", "cy"), ["cx", "cy"])
    touch = (F.col("xmin") < F.col("uxmax")) & (F.col("uxmin") < F.col("xmax")) & (F.col("ymin") < F.col("uymax")) & (F.col("uymin") < F.col("ymax"))
    pairs = met.filter(touch).select("area", "unit").distinct()
    pairs = materialize(pairs.withColumn("pair", F.to_json(F.struct("area", "unit"))))
    side = lambda d, key, n: pairs.join(d, key).select("pair", F.lit(n).alias("side"), F.xxhash64(F.lit(n), "polygon").alias("shape"), "polygon")
    found = combined(side(a, "area", 0).union(side(u, "unit", 1)), "pair", "intersection", cell, digits)
    whole = found.groupBy("pair").agg(F.collect_list("polygon").alias("polygons"), F.sum(geo.polygon_area(F.col("polygon"))).alias("common"))
    return pairs.join(whole, "pair").select(F.col("area").alias(area), F.col("unit").alias(unit), "polygons", "common")
