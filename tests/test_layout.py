"""Tables laid out along a curve: same rows, few files and row groups."""

import pytest
from pyspark.sql import functions as F

from acreflow.functions import geo
from acreflow.operators import layout


def test_curve_visits_each_cell_once_and_never_jumps(spark):
    order = 4
    cells = spark.range(1 << 2 * order).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    at = {r.d: (r.x, r.y) for r in cells.select("x", "y", layout.hilbert(F.col("x"), F.col("y"), order).alias("d")).collect()}
    assert sorted(at) == list(range(256))
    assert all(abs(at[d][0] - at[d + 1][0]) + abs(at[d][1] - at[d + 1][1]) == 1 for d in range(255))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """40,000 boxes all over Iowa, a third of them in one place, some without a box; in an order that mixes them."""
    i = F.col("id")
    lon, lat = F.lit(-96.6) + (i * 7919 % 6500) / 1000, F.lit(40.4) + (i * 104729 % 3100) / 1000
    rows = spark.range(40_000).select("id", F.when(i % 3 == 0, F.lit(-93.6)).otherwise(lon).alias("xmin"), F.when(i % 3 == 0, F.lit(41.6)).otherwise(lat).alias("ymin"))
    rows = rows.withColumns({"xmax": F.col("xmin") + 0.001, "ymax": F.col("ymin") + 0.001}).withColumns({c: F.when(i % 1000 != 1, F.col(c)) for c in layout.BOX})
    path = f"{tmp_path_factory.mktemp('layout')}/parcels"
    layout.write_spatial(rows, path, files=32, extent=(-97.0, 40.0, -90.0, 44.0), group_rows=200)
    return rows, path


def scanned_rows(frame):
    """The rows and files that the scan of a frame has read."""
    frame = frame.select("*")  # a frame's second run does not count files
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    leaf = leaf.plan() if leaf.getClass().getSimpleName() == "ShuffleQueryStageExec" else leaf
    metrics = leaf.metrics()
    return metrics.apply("numOutputRows").value(), metrics.apply("numFiles").value()


@pytest.mark.parametrize("box", [(-95.0, 41.0, -94.8, 41.2), (-93.65, 41.55, -93.55, 41.65), (-91.0, 43.0, -90.99, 43.01)])
def test_same_rows_from_few_files_and_row_groups(spark, table, box):
    rows, path = table
    found = layout.read_box(spark, path, *box)
    want = rows.filter(layout.meets(*box))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect())
    n = want.count()
    read, files = scanned_rows(found)
    all_files = len(spark.read.parquet(path).inputFiles())
    assert all_files >= 24
    if n < 2000:
        assert files <= all_files / 4 and read <= 8000
    else:  # the crowded place: its rows lie in several files, and little else is read
        assert 4 <= files <= all_files / 2 and read <= 1.5 * n


def test_row_groups_are_skipped_inside_files(spark, table):
    _, path = table
    box = (-95.0, 41.0, -94.9, 41.1)
    found = layout.read_box(spark, path, *box)
    in_files = spark.read.parquet(*found.inputFiles()).count()
    assert scanned_rows(found)[0] < in_files / 2


def test_nothing_and_everything(spark, table):
    rows, path = table
    assert layout.read_box(spark, path, 0, 0, 1, 1).count() == 0
    assert layout.read_box(spark, path, -180, -90, 180, 90).count() == rows.filter("xmin IS NOT NULL").count()
    assert spark.read.parquet(path).count() == 40_000


def test_tile(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(400).select("id", (i % 20 * 1000.0).alias("xmin"), (F.floor(i / 20) * 1000.0).alias("ymin")).withColumns({"xmax": F.col("xmin") + 10, "ymax": F.col("ymin") + 10})
    layout.write_spatial(rows, f"{tmp_path}/t", files=8, extent=(-geo.WORLD, -geo.WORLD, geo.WORLD, geo.WORLD))
    z, side = 13, 2 * geo.WORLD / 2**13
    got = {r.id for r in layout.read_tile(spark, f"{tmp_path}/t", z, 4096, 4095, geo.WORLD).collect()}
    assert got == {y * 20 + x for x in range(20) for y in range(20) if x * 1000 <= side and y * 1000 <= side}
