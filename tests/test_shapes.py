"""Distances and common areas of batches of polygons, against plain versions and the column expressions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acreflow.functions import geo, shapes
from acreflow.operators import spatial

from .test_geometry import plain_distance, ring, star

KIND = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


def column(polygons):
    return shapes.edges(pa.array(polygons, KIND))


@pytest.mark.parametrize("together", [1, 40, 250_000])
def test_batches_against_plain_versions(spark, monkeypatch, together):
    monkeypatch.setattr(shapes, "TOGETHER", together)
    rng = random.Random(7)
    pairs = [(star(rng, 0, 0, rng.randint(3, 12)), star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.randint(3, 12))) for _ in range(60)]
    one, two = [[ring(a)] for a, _ in pairs], [[ring(b)[:: rng.choice((1, -1))]] for _, b in pairs]
    assert shapes.distances(column(one), column(two)) == pytest.approx([plain_distance(a, b) for a, b in pairs], abs=1e-9)
    frame = spark.createDataFrame(list(zip(range(60), one, two, strict=True)), f"i int, a array<{geo.RING}>, b array<{geo.RING}>")
    want = [r.c for r in frame.select("i", geo.overlap_area(F.get("a", 0), F.get("b", 0)).alias("c")).orderBy("i").collect()]
    assert shapes.common_areas(column(one), column(two))[0] == pytest.approx(want, abs=1e-9)


def test_holes_and_missing_parts():
    hole = [ring(SQUARE), ring([(1, 1), (3, 1), (3, 3), (1, 3)])]
    inner, outer = [ring([(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5)])], [ring([(2, 0), (6, 0), (6, 4), (2, 4)])]
    nothing = [None, [], [ring(SQUARE)]]
    one, two = column([hole, hole, hole, None, [], nothing[2]]), column([inner, outer, hole, hole, hole, [[*ring(SQUARE)[:2], {"x": None, "y": 9.0}, *ring(SQUARE)[2:]]]])
    assert shapes.distances(one, two)[:3] == pytest.approx([0.5, 0, 0]) and np.isnan(shapes.distances(one, two)[3:5]).all() and shapes.distances(one, two)[5] == 0
    common, least = shapes.common_areas(one, two)
    assert common[:5] == pytest.approx([0, 6, 12, 0, 0]) and np.isnan(common[5]) and least[:3] == pytest.approx([1, 12, 12])
    assert shapes.common_areas(shapes.edges(pa.array([hole], KIND), outer=True), column([inner]))[0] == pytest.approx([1])


def test_distances_are_taken_once_and_only_of_pairs_whose_boxes_are_near(spark):
    squares = [(i, "o", [ring([(x, 0), (x + 1, 0), (x + 1, 1), (x, 1)])], float(x), 0.0, x + 1.0, 1.0) for i, x in enumerate((0, 1, 2.5, 9))]
    d = spark.createDataFrame(squares, f"id long, owner string, polygon array<{geo.RING}>, xmin double, ymin double, xmax double, ymax double")
    frame = spatial.near_pairs(d, ["owner"], eps=0.6, cell=2.0, polygon="polygon", touching=True)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
    assert sorted(map(tuple, frame.collect())) == [(0, 1, 0.0, True), (1, 2, 0.5, False)]
