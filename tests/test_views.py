"""Views kept up by changes, sizes and statistics of tables, adjacency in metres."""

import os
import random

import pytest
from pyspark.sql import functions as F

from acreflow.operators import spatial
from acreflow.sources import stats
from acreflow.streaming import views

from .conftest import SMALL

KIND = "county string, mukey string, acres double, sign int"


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_view_equals_a_rebuild(spark, tmp_path):
    rng, path, held = random.Random(3), str(tmp_path / "view"), []
    put = views.view_batches(path, ["county"], ["acres"], buckets=8)
    plain = lambda rows: spark.createDataFrame(rows, KIND)
    for batch in range(5):
        changes = []
        for _ in range(60):
            row = (rng.choice("ABCDEFGHIJ") if rng.random() > 0.05 else None, "m", rng.choice([None, 0.1, 0.2, 1e6, -3.7]))
            held.append(row)
            changes.append((*row, 1))
        for _ in range(rng.randrange(40)):
            gone = held.pop(rng.randrange(len(held)))
            changes.append((*gone, -1))
        if batch == 3:  # all of one key go
            changes += [(*r, -1) for r in held if r[0] == "A"]
            held = [r for r in held if r[0] != "A"]
        frame = plain(changes)
        put(frame, batch)
        put(frame, batch)  # again, as after a crash
        got = rows_of(views.read_view(spark, path, ["county"], ["acres"]).select(F.coalesce("county", F.lit("-")), "n", F.round("sum_acres", 6), F.round("mean_acres", 6)))
        want = plain([(*r, 1) for r in held]).groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.sum("acres").alias("s"), F.avg("acres").alias("m"))
        assert got == rows_of(want.select(F.coalesce("county", F.lit("-")), "n", F.round("s", 6), F.round("m", 6))), batch
    before = files_of(path)
    put(plain([("B", "m", 1.0, 1)]), 9)
    after = files_of(path)
    assert len(set(before.items()) & set(after.items())) >= len(before) - 1
    put(plain([]), 10)
    assert files_of(path) == after


def test_changes_of_a_join(spark, tmp_path):
    rng = random.Random(5)
    a = [(rng.randrange(6), f"c{rng.randrange(3)}") for _ in range(40)]
    b = [(rng.randrange(6), float(rng.randrange(9))) for _ in range(30)]
    frame_a, frame_b = (lambda rows: spark.createDataFrame(rows, "k int, county string")), (lambda rows: spark.createDataFrame(rows, "k int, acres double"))
    path = str(tmp_path / "joined")
    put = views.view_batches(path, ["county"], ["acres"], buckets=4)
    none_a, none_b = frame_a([]), frame_b([])
    put(views.join_changes(none_a, views.signed(frame_a(a)), none_b, views.signed(frame_b(b)), ["k"]), 0)
    new_a, gone_a, new_b, gone_b = [(1, "c0"), (2, "c9")], a[:5], [(1, 100.0), (5, 7.0)], b[:4]
    da = views.signed(frame_a(new_a)).union(views.signed(frame_a(gone_a), -1))
    db = views.signed(frame_b(new_b)).union(views.signed(frame_b(gone_b), -1))
    put(views.join_changes(frame_a(a), da, frame_b(b), db, ["k"]), 1)
    whole = frame_a(a[5:] + new_a).join(frame_b(b[4:] + new_b), "k").groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.sum("acres").alias("s"))
    assert rows_of(views.read_view(spark, path, ["county"], ["acres"]).select("county", "n", "sum_acres")) == rows_of(whole)


def test_a_stream_of_changes(spark, tmp_path):
    src = str(tmp_path / "in")
    for sign in (1, 1, -1):
        spark.createDataFrame([("A", "m", 2.0, sign), ("B", "m", 1.0, 1)], KIND).coalesce(1).write.mode("append").parquet(src)
    put = views.view_batches(str(tmp_path / "v"), ["county"], ["acres"])
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    assert rows_of(views.read_view(spark, str(tmp_path / "v"), ["county"], ["acres"])) == [("A", 1, 2.0, 2.0), ("B", 3, 3.0, 1.0)]


def test_sizes_of_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(3).write.parquet(path)
    tables = {"region": spark.read.parquet(f"{SMALL}/region.parquet"), "own": spark.read.parquet(path)}
    files = {r.file.removeprefix("file://").removeprefix("file:"): (r.bytes, r.rows) for r in stats.file_sizes(tables).filter("table = 'own'").collect()}
    on_disk = {f: os.path.getsize(f) for f in files_of(path)}
    assert {f: b for f, (b, _) in files.items()} == on_disk and sum(n for _, n in files.values()) == 1000
    got = {r.table: r for r in stats.table_sizes(tables).collect()}
    assert (got["own"].files, got["own"].bytes, got["own"].rows) == (3, sum(on_disk.values()), 1000)
    assert got["region"].bytes == os.path.getsize(f"{SMALL}/region.parquet") and got["region"].rows == 5


def test_statistics_of_columns(spark):
    rows = [(1, "é", [1.0, None], {"a": 1}, (True, b"xyz")), (2, None, None, None, None), (2, "bb", [], {}, (None, b""))]
    d = spark.createDataFrame(rows, "i int, s string, a array<double>, m map<string,int>, st struct<b:boolean,y:binary>")
    got = {r.column: r for r in stats.column_stats(d).collect()}
    assert {c: (r.n, r.nulls, r.bytes) for c, r in got.items()} == {"i": (3, 0, 12), "s": (3, 1, 4), "a": (3, 1, 8), "m": (3, 1, 5), "st": (3, 1, 4)}
    assert (got["i"].least, got["i"].most, got["i"].distinct, got["s"].most, got["a"].least) == ("1", "2", 2, "é", None)
    assert stats.column_stats(d.limit(0)).select(F.sum("n")).first()[0] == 0


def test_statistics_kept_with_a_table(spark):
    spark.range(50).select("id", (F.col("id") % 7).alias("k")).write.mode("overwrite").saveAsTable("stats_of_fifty")
    try:
        got = {r.column: tuple(r)[1:] for r in stats.analyzed(spark, "stats_of_fifty").collect()}
        assert got["k"] == (0, 7, "0", "6") and got["id"][0] == 0
    finally:
        spark.sql("DROP TABLE stats_of_fifty")


def test_metres_and_degrees_differ(spark):
    kind = "id long, owner string, xmin double, ymin double, xmax double, ymax double"
    lot = lambda i, x, y: (i, "a", x, y, x + 0.001, y + 0.001)
    rows = [lot(1, 10.0, 0.0), lot(2, 10.00111, 0.0), lot(3, 10.0, 60.0), lot(4, 10.00111, 60.0), lot(5, 20.0, 41.0), lot(6, 20.0, 41.001 + 0.00008), lot(7, 20.0, 41.002 + 0.00008 + 0.00010), lot(8, -179.0, 89.0)]
    d = spark.createDataFrame(rows, kind)
    near = {(r.a, r.b): r.distance for r in spatial.near_pairs_metres(d, ["owner"], metres=10.0).collect()}
    assert near.keys() == {(3, 4), (5, 6)} and near[3, 4] == pytest.approx(0.00011 * spatial.DEGREE / 2, rel=1e-3) and near[5, 6] == pytest.approx(0.00008 * spatial.DEGREE, rel=1e-3)
    assert {(r.a, r.b) for r in spatial.near_pairs(d, ["owner"], eps=0.000115).collect()} == {(1, 2), (3, 4), (5, 6), (6, 7)}
    assert {r.id: r.cluster for r in spatial.adjacent_clusters(d, ["owner"], metres=10.0).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8}
