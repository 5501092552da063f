import os
from types import SimpleNamespace

import pytest

from acreflow.operators import graph, storage


def test_folder_without_a_setting():
    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(applicationId="app-x", master=master))

    folder = storage.shared_folder(session("local[4]"))
    assert os.path.isdir(folder) and storage.shared_folder(session("local")) == folder
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            storage.shared_folder(session(master))


def test_release_deletes_what_was_written(spark):
    storage.materialize(spark.range(5)).count()
    folder = storage._job_folder(spark)
    assert os.listdir(folder)
    storage.release(spark)
    assert not os.path.exists(folder) and storage.materialize(spark.range(5)).count() == 5


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 9: 7} | {101 + i: 100 for i in range(60)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_tables_only_are_broadcast(spark):
    big = storage.materialize(spark.range(50))
    assert "broadcast" in storage.broadcast_if_small(big, 50)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in storage.broadcast_if_small(big, 49)._jdf.queryExecution().logical().toString()
