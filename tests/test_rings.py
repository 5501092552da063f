"""Rings that touch one another are traced apart, and components in parts of a task."""

import pyarrow as pa
from pyspark.sql import functions as F

from acreflow.operators import graph, spatial

from .test_geometry import ring


def test_squares_that_touch_at_corners_are_pieces_of_their_own(spark):
    n = 6
    squares = [("g", ring([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)])) for x in range(n) for y in range(n) if (x + y) % 2 == 0]
    d = spark.createDataFrame(squares, f"g string, ring {spatial.geo.RING}")
    outline = spatial.dissolve_edges(d, "g", cell=4.0).withColumn("edge", F.xxhash64("g", "p.x", "p.y", "q.x", "q.y"))
    sizes = graph.components(spatial._next_edges(outline, "g")).groupBy("component").count().collect()
    # the least edge of each is the component, and no node of it
    assert [r["count"] for r in sizes] == [3] * len(squares)
    assert spatial.dissolve(d, "g", cell=4.0).count() == len(squares)


def test_a_task_passes_on_its_edges_in_parts(monkeypatch):
    monkeypatch.setattr(graph, "NODES", 4)
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 99)]
    batches = [pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*pairs[i : i + 3], strict=True)], names=["a", "b"]) for i in range(0, len(pairs), 3)]
    out = [tuple(r.values()) for b in graph._thin(iter(batches)) for r in b.to_pylist()]
    reached = {0}
    for _ in range(40):
        reached |= {x for e in out for x in e if reached & set(e)}
    assert reached == set(range(31)) and {x for e in out for x in e} - reached == {99, 100, 101}
