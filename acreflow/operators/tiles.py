"""Vector tiles: features laid on tiles, simplified, clipped, quantised and encoded.

A feature's geometry is its column ``polygons`` (array of polygons), or else
``polygon`` (array of rings, the first the outside), or else ``ring``.  It is
simplified once for each tolerance, not for each tile, and features too small to
be seen at a zoom go before they are laid on tiles.  The geometry on each tile
is encoded row by row, wherever the row stands; what is grouped by tile is only
what the tile's one layer holds, which is one value in any case.
"""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreflow.functions import geo

from .storage import materialize

EXTENT, BUFFER = 4096, 256


def on_tiles(features: DataFrame, zoom: int, world: bool = True) -> DataFrame:
    """Features (ring in web-mercator metres, xmin.., ...) once for each tile z, x, y of ``zoom`` that their box touches.

    What lies beyond the world's square is on no tile; without ``world`` the tiles
    go on beyond it, numbered by the same grid.
    """
    size = 2 * geo.WORLD / 2**zoom
    last = 2**zoom - 1

    def spans(lo, hi):
        if not world:
            return F.sequence(F.floor(lo), F.floor(hi))
        # the last tile holds its outer border too
        first, end = F.greatest(F.lit(0), F.when(lo == last + 1, last).otherwise(F.floor(lo))), F.least(F.lit(last), F.floor(hi))
        return F.when((first <= end) & lo.isNotNull() & hi.isNotNull(), F.sequence(first, F.greatest(first, end)))

    xs = spans((F.col("xmin") + geo.WORLD) / size, (F.col("xmax") + geo.WORLD) / size)
    ys = spans((geo.WORLD - F.col("ymax")) / size, (geo.WORLD - F.col("ymin")) / size)
    return features.withColumn("z", F.lit(zoom)).withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _zigzag(n: int) -> int:
    return n * 2 if n >= 0 else -n * 2 - 1


def simplified(points: list, tolerance: float) -> list:
    """Douglas-Peucker."""
    at = np.asarray(points, float)
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        inner, (dx, dy) = at[a + 1 : b] - at[a], at[b] - at[a]
        length = np.hypot(dx, dy)
        away = np.abs(dx * inner[:, 1] - dy * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        far = int(away.argmax())
        if away[far] > tolerance:
            far += a + 1
            keep.add(far)
            todo += [(a, far), (far, b)]
    return [points[i] for i in sorted(keep)]


def clipped(ring: list, low: float = -BUFFER, high: float = EXTENT + BUFFER) -> list:
    """The part of a closed ring of tile coordinates inside a square, closed; empty if there is none."""
    out = ring[:-1]
    for axis, bound, sign in ((0, low, 1), (0, high, -1), (1, low, 1), (1, high, -1)):
        points, out = out, []
        for i, p in enumerate(points):
            q = points[i - 1]
            inside, before = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if inside != before:
                f = (bound - q[axis]) / (p[axis] - q[axis])
                out.append((q[0] + (p[0] - q[0]) * f, q[1] + (p[1] - q[1]) * f))
            if inside:
                out.append(p)
    return [*out, out[0]] if out else []


def _quantised(ring: list, outside: bool) -> list[tuple[int, int]] | None:
    """The open ring of whole coordinates, clockwise as seen (y points down), a hole the other way; None if nothing is left."""
    points: list[tuple[int, int]] = []
    for x, y in ring:
        at = (round(x), round(y))
        if not points or at != points[-1]:
            points.append(at)
    points = points[:-1] if len(points) > 1 and points[0] == points[-1] else points
    turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))
    if len(points) < 3 or not turn:
        return None
    return points[::-1] if (turn > 0) != outside else points


def encode_polygons(polygons: list) -> bytes | None:
    """The commands of polygons of closed rings, each ring from where the one before ended; None if nothing is left."""
    x = y = 0
    moves: list[int] = []
    for polygon in polygons:
        for i, ring in enumerate(polygon):
            points = _quantised(ring, i == 0)
            if points is None:
                if i == 0:
                    break
                continue
            steps = []
            for px, py in points:
                steps.append((_zigzag(px - x), _zigzag(py - y)))
                x, y = px, py
            moves += [9, *steps[0], len(steps[1:]) << 3 | 2, *(n for s in steps[1:] for n in s), 15]
    return b"".join(map(_varint, moves)) or None


def encode_ring(ring: list) -> bytes | None:
    """A closed ring's commands; None if nothing is left."""
    return encode_polygons([[ring]])


def encode_layer(name: str, rows: list[tuple[int, bytes, dict]]) -> bytes:
    """A layer of (id, commands of a ring, properties)."""
    keys: dict[str, int] = {}
    values: dict[object, int] = {}
    body = _field(1, name.encode())
    for fid, moves, properties in rows:
        # equal numbers of different kinds are different values
        tags = b"".join(_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault((type(v), v), len(values))) for k, v in properties.items() if v is not None)
        body += _field(2, _varint(1 << 3) + _varint(fid) + _field(2, tags) + _varint(3 << 3) + _varint(3) + _field(4, moves))
    for k in keys:
        body += _field(3, k.encode())
    for _, v in values:
        if isinstance(v, bool):
            value = _varint(7 << 3) + _varint(int(v))
        elif isinstance(v, str):
            value = _field(1, v.encode())
        elif isinstance(v, int):
            value = _varint(6 << 3) + _varint(_zigzag(v))
        else:
            value = _varint(3 << 3 | 1) + struct.pack("<d", v)
        body += _field(4, value)
    body += _varint(5 << 3) + _varint(EXTENT) + _varint(15 << 3) + _varint(2)
    return _field(3, body)


_SHAPE = f"array<array<{geo.RING}>>"


def tolerance_of(zoom: int) -> int:
    """Metres by which an outline may be simplified."""
    return 100 if zoom <= 10 else 50 if zoom <= 12 else 10


def _shaped(features: DataFrame, key: str, properties: list[str], tolerance: float | None) -> DataFrame:
    """The features with their box and their geometry as ``shape``, simplified if there is a tolerance; rings of four points at most stay."""
    has = features.columns
    shape = F.col("polygons") if "polygons" in has else F.array("polygon") if "polygon" in has else F.array(F.array("ring"))
    plain = features.select(key, *[c for c in properties if c != key], "xmin", "ymin", "xmax", "ymax", shape.cast(_SHAPE).alias("shape")).filter("xmin IS NOT NULL AND shape IS NOT NULL")
    if tolerance is None:
        return plain

    def simplify(batches):
        for batch in batches:
            shapes = []
            for polygons in batch.column("shape").to_pylist():
                lines = [[[(p["x"], p["y"]) for p in ring] for ring in polygon or ()] for polygon in polygons]
                lines = [[simplified(ring, tolerance) if len(ring) > 4 else ring for ring in polygon] for polygon in lines]
                shapes.append([[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in lines])
            at = batch.schema.get_field_index("shape")
            yield batch.set_column(at, batch.schema.field(at), pa.array(shapes, batch.schema.field(at).type))

    return plain.mapInArrow(simplify, plain.schema)


def _drawn(shaped: DataFrame, zoom: int, layer: str, key: str, properties: list[str]) -> DataFrame:
    """z, x, y, n, mvt of features with ``shape``."""
    size = 2 * geo.WORLD / 2**zoom
    unit = size / EXTENT
    step = lambda v, more: F.rint((v + geo.WORLD) / unit + more)
    spans = lambda lo, hi: step(F.col(hi), 1e-6) > step(F.col(lo), -1e-6)
    seen = shaped.filter(spans("xmin", "xmax") & spans("ymin", "ymax"))  # of the others whole coordinates leave no area
    own = [key, *[c for c in properties if c != key]]
    placed = on_tiles(seen, zoom).select("z", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "shape", *[F.col(c).alias(f"p_{c}") for c in own])

    def draw(batches):
        for batch in batches:
            moves = []
            for x, y, polygons in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("shape").to_pylist(), strict=True):
                west, north = x * size - geo.WORLD, geo.WORLD - y * size
                on_tile = [[clipped([((p["x"] - west) / unit, (north - p["y"]) / unit) for p in ring]) if ring else [] for ring in polygon or ()] for polygon in polygons]
                moves.append(encode_polygons(on_tile))
            kept = batch.drop_columns(["shape"]).append_column("moves", pa.array(moves, pa.binary()))
            yield kept.filter(pc.is_valid(kept.column("moves")))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "shape")
    drawn = placed.mapInArrow(draw, f"{schema}, moves binary")

    def assemble(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(f"p_{key}")
        plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
        rows = [(int(fid), moves, {p: plain(v) for p, v in zip(properties, row, strict=True)}) for fid, moves, *row in zip(group[f"p_{key}"], group["moves"], *(group[f"p_{p}"] for p in properties), strict=True)]
        return pd.DataFrame({"z": group["z"].iloc[:1], "x": group["x"].iloc[:1], "y": group["y"].iloc[:1], "n": [len(rows)], "mvt": [encode_layer(layer, rows)]})

    return drawn.groupBy("z", "x", "y").applyInPandas(assemble, "z int, x long, y long, n long, mvt binary")


def tiles(features: DataFrame, zoom: int, layer: str, key: str, properties: list[str], simplify: bool = True) -> DataFrame:
    """z, x, y, n, mvt: the encoded tiles of one zoom, each with one layer; features that vanish are left out."""
    return _drawn(_shaped(features, key, properties, tolerance_of(zoom) if simplify else None), zoom, layer, key, properties)


def pyramid(features: DataFrame, zooms: list[int], layer: str, key: str, properties: list[str]) -> DataFrame:
    """The tiles of several zooms; outlines are simplified and written once for each tolerance, and all its zooms are drawn from them."""
    shaped = {t: materialize(_shaped(features, key, properties, t)) for t in sorted({tolerance_of(z) for z in zooms})}
    return reduce(DataFrame.union, [_drawn(shaped[tolerance_of(z)], z, layer, key, properties) for z in sorted(set(zooms))])


def layered(one: DataFrame, two: DataFrame) -> DataFrame:
    """z, x, y, n, mvt of tiles that hold the layers of both, whose names must differ: layers follow one another in a tile's bytes."""
    part = lambda t, k: t.select("z", "x", "y", F.col("n").alias(f"n{k}"), F.col("mvt").alias(f"mvt{k}"))
    met = part(one, 1).join(part(two, 2), ["z", "x", "y"], "full_outer")
    empty = F.lit(b"")
    return met.select("z", "x", "y", (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.concat(F.coalesce("mvt1", empty), F.coalesce("mvt2", empty)).alias("mvt"))
