import datetime as dt
import time

from pyspark.sql import functions as F

from acreflow.streaming import listings as streams


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def stream_of(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def at(seconds):
    return dt.datetime(2025, 1, 1, 12) + dt.timedelta(seconds=seconds)


def test_limiter(spark, tmp_path):
    rows = [("a", at(s)) for s in (0, 1, 2, 61, 62)] + [("b", at(0))]
    got = run(streams.limited(stream_of(spark, tmp_path / "r", rows, "client string, at timestamp"), 2, 60), "limits")
    assert sorted((r.client, r["at"].second + 60 * r["at"].minute, r.allowed) for r in got.collect()) == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 61, True), ("a", 62, True), ("b", 0, True)]


def test_windows_and_first_seen(spark, tmp_path):
    rows = [("x", at(s)) for s in (0, 10, 400, 2000)]
    src = stream_of(spark, tmp_path / "e", rows, "k string, at timestamp")
    got = run(streams.windowed_counts(src, "at", "k"), "windows")
    assert sorted(r.n for r in got.collect()) == [1, 2]
    assert run(streams.first_seen(src, "k", "at"), "firsts").count() == 1


def test_alerts(spark, tmp_path):
    schema = "source string, discovered int, processed int, failed int, region_found int, region_saved int"
    past = spark.createDataFrame([("a", 20, 0, 0, 0, 0)], schema)
    src = stream_of(spark, tmp_path / "runs", [("a", 9, 6, 4, 3, 0), ("new", 1, 1, 0, 0, 0)], schema)
    assert sorted(tuple(r) for r in run(streams.alerts(src, past), "alerts").collect()) == [("a", "drop"), ("a", "failures"), ("a", "region")]


def test_upserts(spark, tmp_path):
    path, kind = str(tmp_path / "table"), "url string, title string, n int, at int"
    put = streams.upsert_batches(path, "url", ["n"], last="at", buckets=4)
    put(spark.createDataFrame([(f"u{i}", "a", 1, 0) for i in range(20)], kind), 0)
    before = {f.path: f.modificationTime for f in spark.read.format("binaryFile").load(path).select("path", "modificationTime").collect()}
    rows = [("u1", "b", 2, 1), ("u1", "c", 3, 9), ("u1", "d", 9, 5), ("new", "c", 3, 0)]
    src = stream_of(spark, tmp_path / "in", rows, kind)
    src.writeStream.foreachBatch(put).trigger(availableNow=True).start().awaitTermination(120)
    put(spark.createDataFrame(rows, kind), 1)  # again
    got = {r.url: (r.title, r.n) for r in spark.read.parquet(path).collect()}
    assert got == {f"u{i}": ("a", 1) for i in range(20)} | {"u1": ("a", 3), "new": ("c", 3)}
    after = {f.path: f.modificationTime for f in spark.read.format("binaryFile").load(path).select("path", "modificationTime").collect()}
    assert set(before.items()) & set(after.items())  # buckets that no row touched stand as they were
    put(spark.createDataFrame([], kind), 2)


def test_ticks_and_progress(spark, tmp_path):
    listener = streams.Progress()
    spark.streams.addListener(listener)
    try:
        seen = []
        src = stream_of(spark, tmp_path / "r", [(i,) for i in range(7)], "n int")
        for _ in range(2):
            streams.on_tick(src, lambda d, i: seen.append(d.count()), str(tmp_path / "c"), every=None).awaitTermination(120)
        assert sum(seen) == 7  # a second run finds nothing new
        run(src, "told")
        for _ in range(100):
            if "told" in listener.ended:
                break
            time.sleep(0.1)
        assert listener.rows["told"] == 7 and listener.batches["told"] >= 1
    finally:
        spark.streams.removeListener(listener)


def test_work_queue(spark, tmp_path):
    out = str(tmp_path / "done")
    src = stream_of(spark, tmp_path / "q", [(1, "low"), (1, "high"), (2, "normal"), (3, "low")], "id int, priority string")
    handle = lambda rows: rows.select("id", (F.col("id") != 2).alias("ok"))
    work = streams.work_batches(handle, lambda d: d.write.mode("append").parquet(out))
    src.writeStream.foreachBatch(work).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "completed", 1), (2, "failed", 3), (3, "completed", 1)]
