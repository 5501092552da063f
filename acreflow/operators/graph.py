"""Connected components of an edge table by union-find and star contraction.

Edges are first thinned inside each task by union-find, which leaves at most
one edge per node and task; then rounds of large-star and small-star, each
one aggregate and one join on the node, pull every node to the least label of
its component.  Each round is written to the shared folder; the loop ends
when a round changes nothing or nothing is left.  Only two sums reach the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

_EDGES = "a long, b long"

#: Nodes that a task holds; beyond them it passes on what it has and begins anew.
NODES = 500_000


def _thin(batches):
    """One edge to the root for each node of this task's edges, or of each part of them that has ``NODES``."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def edges():
        nodes = [(x, find(x)) for x in list(root)]
        nodes = [(x, y) for x, y in nodes if x != y]
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([y for _, y in part], pa.int64()), pa.array([x for x, _ in part], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > NODES:
            yield from edges()
            root.clear()
    yield from edges()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's greater neighbours go to the least node near it.
    Small: its lesser neighbours and itself do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = both.join(least, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = met.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select("m", "u"))
    out = out.filter(F.col("a") != F.col("b"))
    return out if large else out.distinct()  # the large star has as many edges as before it


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in the edges (a, b: long)."""
    edges = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_thin, _EDGES))
    before = None
    while True:
        edges = materialize(_star(_star(edges, large=True), large=False))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = state
