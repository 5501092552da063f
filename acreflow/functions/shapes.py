"""Distances and common areas of pairs of polygons, for the rows of an Arrow batch at once.

The same measures as ``distance`` and ``overlap_area`` of ``geo``, whose column
expressions are walked edge by edge; here all edges of one polygon of each row
meet all of the other in arrays of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of edges that are looked at together, unless a single edge has more.
TOGETHER = 250_000


class Edges(NamedTuple):
    """Edges by row: ends, the number of each edge's row, whether its ring is a hole, and how many each row has."""

    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray
    row: np.ndarray
    hole: np.ndarray
    ring: np.ndarray
    count: np.ndarray


def edges(polygons: pa.Array, outer: bool = False) -> Edges:
    """The edges of a column of polygons (lists of rings of x, y), or of their outsides only."""
    polygons = polygons.combine_chunks() if isinstance(polygons, pa.ChunkedArray) else polygons
    rings, of_row = polygons.flatten(), pc.list_parent_indices(polygons).to_numpy(zero_copy_only=False)
    points, of_ring = rings.flatten(), pc.list_parent_indices(rings).to_numpy(zero_copy_only=False)
    parts = dict(zip([f.name for f in points.type], points.flatten(), strict=True))
    x, y = (parts[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    hole = np.zeros(len(of_row), bool)
    hole[1:] = of_row[1:] == of_row[:-1]
    start = np.flatnonzero(of_ring[:-1] == of_ring[1:])
    if outer:
        start = start[~hole[of_ring[start]]]
    row = of_row[of_ring[start]]
    return Edges(x[start], y[start], x[start + 1], y[start + 1], row, hole[of_ring[start]], of_ring[start], np.bincount(row, minlength=len(polygons)))


def on_plane(e: Edges, lon: np.ndarray, lat: np.ndarray, degree: float) -> Edges:
    """Edges in degrees as metres on a plane that touches the earth at a spot of each row."""
    lon, lat, wide = lon[e.row], lat[e.row], np.cos(np.radians(lat))[e.row]
    return e._replace(ax=(e.ax - lon) * wide * degree, bx=(e.bx - lon) * wide * degree, ay=(e.ay - lat) * degree, by=(e.by - lat) * degree)


def _meetings(one: Edges, two: Edges) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of edges of both, each of the first with all of its row's of the second, in bounded parts; those of one edge stand together."""
    first = np.cumsum(two.count) - two.count
    times = two.count[one.row]
    end = np.cumsum(times)
    lo = 0
    while lo < len(times):
        before = end[lo] - times[lo]
        hi = max(lo + 1, int(np.searchsorted(end, before + TOGETHER, side="right")))
        n = times[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        if len(i):
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[one.row[i]]
        lo = hi


def _side(ax, ay, bx, by, px, py):
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _gap2(px, py, ax, ay, bx, by):
    """Squared distances of points and edges."""
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = np.clip(np.divide((px - ax) * dx + (py - ay) * dy, long, out=np.zeros_like(long), where=long != 0), 0, 1)
    return (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2


def _holds(e: Edges, other: Edges) -> np.ndarray:
    """Whether each row's polygon holds the first point of the other, by ray casting."""
    begin = np.cumsum(other.count) - other.count
    some = other.count > 0
    px, py = np.full(len(some), np.nan), np.full(len(some), np.nan)
    px[some], py[some] = other.ax[begin[some]], other.ay[begin[some]]
    px, py = px[e.row], py[e.row]
    over = (e.ay > py) != (e.by > py)
    slope = np.divide(e.bx - e.ax, e.by - e.ay, out=np.zeros_like(e.ax), where=over)
    flips = over & (px < slope * (py - e.ay) + e.ax)
    return np.bincount(e.row, weights=flips, minlength=len(e.count)) % 2 == 1


def distances(one: Edges, two: Edges) -> np.ndarray:
    """Planar distance of each row's polygons, 0 if they touch or overlap; not a number if one has no edge."""
    best = np.full(len(one.count), np.inf)
    for i, j in _meetings(one, two):
        e, f = [v[i] for v in one[:4]], [v[j] for v in two[:4]]
        cross = (_side(*e, *f[:2]) * _side(*e, *f[2:]) < 0) & (_side(*f, *e[:2]) * _side(*f, *e[2:]) < 0)
        # a point without a coordinate is no point
        gap = np.fmin(np.fmin(_gap2(*e[:2], *f), _gap2(*e[2:], *f)), np.fmin(_gap2(*f[:2], *e), _gap2(*f[2:], *e)))
        gap[cross] = 0
        begin = np.flatnonzero(np.r_[True, one.row[i][1:] != one.row[i][:-1]])
        np.fmin.at(best, one.row[i][begin], np.fmin.reduceat(gap, begin))
    best[_holds(one, two) | _holds(two, one)] = 0
    best[(one.count == 0) | (two.count == 0)] = np.nan
    return np.sqrt(best)


def _weights(e: Edges, x0: np.ndarray, y0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each ring's sign, which counts what its edges have below them as inside (-1: in a hole, as outside), and each row's signed area."""
    ax, ay, bx, by = e.ax - x0[e.row], e.ay - y0[e.row], e.bx - x0[e.row], e.by - y0[e.row]
    area = np.bincount(e.ring, weights=(ax * by - bx * ay) / 2, minlength=e.ring.max() + 1 if len(e.ring) else 0)
    sign = np.sign(area[e.ring]) * np.where(e.hole, -1, 1)
    return sign, np.bincount(e.row, weights=sign * (ax * by - bx * ay) / 2, minlength=len(e.count))


def common_areas(one: Edges, two: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Planar area that each row's polygons have in common, not a number where a coordinate is missing; and the lesser of their own.

    A polygon is the sum of what lies below its edges, down to a line under both,
    with the sign of the edge's direction; so their common area is the sum, over pairs
    of edges, of what lies below both: the lesser of two straight lines over a common width.
    """
    n = len(one.count)
    low = np.full((2, n), np.inf)
    for e in (one, two):
        for k, v in ((0, e.ax), (0, e.bx), (1, e.ay), (1, e.by)):
            np.minimum.at(low[k], e.row, v)
    low[~np.isfinite(low)] = 0
    sign_one, area_one = _weights(one, *low)
    sign_two, area_two = _weights(two, *low)
    total = np.zeros(n)
    for i, j in _meetings(one, two):
        row = one.row[i]
        x0, y0 = low[0][row], low[1][row]
        (ax, ay, bx, by), (cx, cy, dx, dy) = ([v[k] - o for v, o in zip(e[:4], (x0, y0, x0, y0), strict=True)] for e, k in ((one, i), (two, j)))
        lo, hi = np.maximum(np.minimum(ax, bx), np.minimum(cx, dx)), np.minimum(np.maximum(ax, bx), np.maximum(cx, dx))
        k = np.flatnonzero(hi > lo)
        ax, ay, bx, by, cx, cy, dx, dy, lo, hi = (v[k] for v in (ax, ay, bx, by, cx, cy, dx, dy, lo, hi))
        up, down = (by - ay) / (bx - ax), (dy - cy) / (dx - cx)
        e0, e1, f0, f1 = ay + up * (lo - ax), ay + up * (hi - ax), cy + down * (lo - cx), cy + down * (hi - cx)
        d0, d1 = np.abs(e0 - f0), np.abs(e1 - f1)
        crossed = (e0 - f0) * (e1 - f1) < 0
        apart = np.where(crossed, np.divide(d0 * d0 + d1 * d1, d0 + d1, out=np.zeros_like(d0), where=crossed), d0 + d1)
        below = (hi - lo) * (e0 + e1 + f0 + f1 - apart) / 4
        # an edge that goes left has the inside of a ring turned to the left below it
        way = np.sign(ax - bx) * np.sign(cx - dx) * sign_one[i[k]] * sign_two[j[k]]
        total += np.bincount(row[k], weights=way * below, minlength=n)
    for e in (one, two):
        total[e.row[np.isnan(e.ax + e.ay + e.bx + e.by)]] = np.nan
    return np.abs(total), np.minimum(np.abs(area_one), np.abs(area_two))
