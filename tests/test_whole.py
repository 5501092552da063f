"""Queries over whole tables, on tables larger than the subsets that other queries read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreflow.plans import registry

from .conftest import SMALL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("whole")
    spark.range(200).toDF("s_suppkey").write.parquet(f"{to}/supplier.parquet")
    spark.range(3000).toDF("c_custkey").write.parquet(f"{to}/customer.parquet")
    return str(to)


def test_nearest_of_all_places(spark, folder):
    got = {r.id: r.sid for r in registry.QUERIES["nearest_whole"](spark, folder).collect()}
    c, s = np.arange(3000), np.arange(200)
    lon, lat, plon, plat = (np.radians(x) for x in (-170 + c * 0.025, np.full(3000, -60.0), -169.963 + s * 0.1, np.full(200, -59.963)))
    a = np.sin((plat - lat[:, None]) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(plat) * np.sin((plon - lon[:, None]) / 2) ** 2
    d = 2 * 6371008.8 * np.arcsin(np.sqrt(a))
    want = {i: int(d[i].argmin()) for i in range(3000) if d[i].min() < 50_000 and abs(np.degrees(lon[i] - plon[d[i].argmin()])) <= 0.5}
    assert got == want and max(got.values()) == 199


def test_circles_of_all_places(spark, folder):
    got = registry.QUERIES["circle_poly_whole"](spark, folder).groupBy("s_suppkey").count().collect()
    assert len(got) == 200 and {r["count"] for r in got} == {33}


@pytest.mark.parametrize("name", ["insert_ignore_whole", "upsert_whole", "set_diff_whole", "anti_both_whole", "point_stats_whole"])
def test_both_sides_grow_with_the_tables(spark, tmp_path, name):
    """Three times the rows, under new ids far above the old ones, give three times the result."""
    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"], "events": ["event_id", "user_id"]}
    for table, ids in keys.items():
        frame = spark.read.parquet(f"{SMALL}/{table}.parquet")
        frame.write.parquet(f"{small}/{table}.parquet")
        wide = frame.crossJoin(spark.range(3).toDF("copy"))
        wide.withColumns({c: F.col(c) + F.col("copy") * 100_000 for c in ids}).drop("copy").write.parquet(f"{large}/{table}.parquet")
    one, three = (registry.QUERIES[name](spark, x) for x in (small, large))
    if name == "point_stats_whole":
        assert three.first().n == 3 * one.first().n > 0
    else:
        assert three.count() == 3 * one.count() > 0
