"""The nearest place on adaptive cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreflow.operators import spatial


def haversine(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * np.arcsin(np.sqrt(np.minimum(a, 1)))


def towns(rng, n):
    """Points thinly all over, densely in two towns, and many in one spot."""
    thin = np.stack([rng.uniform(-96, -92, n), rng.uniform(40, 44, n)], 1)
    dense = np.concatenate([c + rng.normal(0, s, (n, 2)) for c, s in (((-93.6, 41.6), 0.002), ((-95.01, 43.49), 0.02))])
    return np.concatenate([thin, dense, np.tile([[-93.6, 41.6]], (n, 1))])


def frames(spark, points, places):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, lon double, lat double")
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "place long, plon double, plat double")
    return p, q


@pytest.mark.parametrize("most", [50_000, 900])
def test_equals_brute_force(spark, most):
    rng = np.random.default_rng(8)
    points, places = towns(rng, 250), towns(rng, 900)
    got = {r.id: (r.place, r.metres) for r in spatial.nearest(*frames(spark, points, places), "id", "place", most_metres=most).collect()}
    want = {}
    for i, (x, y) in enumerate(points):
        box = np.flatnonzero((np.abs(places[:, 0] - x) <= 0.5) & (np.abs(places[:, 1] - y) <= 0.5))
        d = haversine(x, y, places[box, 0], places[box, 1])
        if len(d) and d.min() < most:
            want[i] = (int(box[np.argmin(d)]), d.min())
    assert got.keys() == want.keys()
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)
    assert sum(got[i][0] == want[i][0] for i in want) >= len(want) - 2  # but for places equally near


def test_pairs_in_proportion(spark):
    """Where all places stand in one town, a point meets a few of them."""
    rng = np.random.default_rng(2)
    counts = []
    for n in (2000, 8000):
        town = np.array([-93.6, 41.6]) + rng.normal(0, 0.01, (n, 2))
        points = np.concatenate([np.array([-93.6, 41.6]) + rng.normal(0, 0.01, (n // 4, 2)), np.stack([rng.uniform(-93.9, -93.3, n // 4), rng.uniform(41.3, 41.9, n // 4)], 1)])
        p, q = frames(spark, points, town)
        counts.append(spatial.nearest_candidates(p, q).count() / len(points))
    assert counts[0] < 300 and counts[1] < 1.5 * counts[0]


def test_odd_rows(spark):
    p, q = frames(spark, [(-93.0, 41.0), (-93.0, 41.0), (10.0, 10.0)], [(-93.0, 41.0), (-93.0, 41.0), (-92.6, 41.4)])
    assert sorted(tuple(r) for r in spatial.nearest(p, q, "id", "place").collect()) == [(0, 0, 0.0), (1, 0, 0.0)]
    assert spatial.nearest(p.limit(0), q, "id", "place").count() == spatial.nearest(p, q.limit(0), "id", "place").count() == 0
    nulls = p.withColumn("lon", F.lit(None).cast("double"))
    assert spatial.nearest(nulls, q, "id", "place").count() == 0
