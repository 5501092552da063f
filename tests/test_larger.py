"""Queries on keys and groups as larger tables have them, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from acreflow.functions import geo
from acreflow.operators import relational, tiles
from acreflow.plans import registry

from .conftest import normal


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Compares a query over given tables with its SQL."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, frame in tables.items():
            frame.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        ours, theirs = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(registry.ORACLES[name]).df()
        assert len(ours) > 0 and sorted(ours.columns) == sorted(theirs.columns)
        assert normal(ours) == normal(theirs)

    return check


def parts(spark, first, n):
    """Parts with keys from ``first``."""
    k = F.col("id") + first
    return spark.range(n).select(k.alias("p_partkey"), F.concat(F.lit("T"), F.floor(k / 5) % 2).alias("p_type"), F.concat(F.lit("B"), F.floor(k / 2) % 2).alias("p_brand"), (1 + F.pmod(F.xxhash64(k), F.lit(50))).cast("int").alias("p_size"))


def test_pairs_of_repeated_and_missing_keys(same_as_sql, spark):
    rows = [(1, "A", "x", 5), (1, "A", "x", 5), (1, "A", "x", 6), (2, "A", "x", 5), (3, "A", "x", None), (None, "A", "x", 5), (4, "A", None, 5), (5, "A", None, 5), (6, None, "x", 5), (7, "B", "x", 5), (7, "B", "x", 5), (8, "C", "x", 1), (9, "C", "x", 2)]
    same_as_sql("pair_selfjoin", part=spark.createDataFrame(rows, "p_partkey long, p_type string, p_brand string, p_size int"))


def test_pairs_are_counted_without_being_made(spark, tmp_path):
    spark.range(200_000).select(F.col("id").alias("p_partkey"), F.lit("A").alias("p_type"), F.lit("x").alias("p_brand"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    frame = registry.QUERIES["pair_selfjoin"](spark, str(tmp_path))
    joins = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "p_brand" not in joins[0]
    assert [tuple(r) for r in frame.collect()] == [("A", 200_000 * 199_999 // 2, 200_000 * 199_999 // 2)]


def test_pairs_between(spark):
    counted = spark.createDataFrame([("g", 1, 3), ("g", 2, 2), ("g", 2, 2), ("h", 1, 4)], "g string, k long, n long")
    assert sorted(map(tuple, relational.pairs_between(counted, ["g"], "k", "n").collect())) == [("g", 12), ("h", 0)]


def test_lots_stay_at_their_latitudes(same_as_sql, spark):
    # rows of lots around 17,600 and 60,000, which lay at 35 degrees and beyond the pole
    same_as_sql("metre_cluster", part=parts(spark, 398_900, 300).union(parts(spark, 1_199_800, 200)).coalesce(1))


def test_tiles_beyond_the_world(same_as_sql, spark):
    # 30,000 km north, where the rows of the world's last tile would have been
    same_as_sql("tile_count", part=parts(spark, 0, 100).union(parts(spark, 60_000, 100)).coalesce(1))
    w, size = geo.WORLD, 2 * geo.WORLD / 2**3
    boxes = [(1, -w, w - 1, -w + 1, w), (2, w, 0.5, w, 0.5), (3, w + 1, 0.5, w + 2, 0.5), (4, -w - 9, w + 1, w, w + 9), (5, -w - size * 1.5, -w, -w + size * 1.5, -w), (6, None, 0.0, 1.0, 1.0)]
    d = spark.createDataFrame(boxes, "id int, xmin double, ymin double, xmax double, ymax double")
    got = sorted((r.id, r.x, r.y) for r in tiles.on_tiles(d, 3).collect())
    assert got == [(1, 0, 0), (2, 7, 3), (5, 0, 7), (5, 1, 7)]
    free = sorted((r.id, r.x, r.y) for r in tiles.on_tiles(d.filter("id IN (2, 3, 5)"), 3, world=False).collect())
    assert free == [(2, 8, 3), (3, 8, 3), *[(5, x, 8) for x in (-2, -1, 0, 1)]]
