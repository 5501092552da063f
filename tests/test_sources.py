import json

import pytest
from pyspark.sql import functions as F

from acreflow.functions import geo
from acreflow.sources import files


def test_run_log(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"scrapeId":"r1","sourceName":"s","discoveredUrls":3}\nnot json\n{"scrapeId":"r2"}\n')
    assert sorted(r.scrapeId for r in files.run_log(spark, str(tmp_path / "a.jsonl")).collect()) == ["r1", "r2"]
    files.append_log(spark.createDataFrame([("r3",)], "scrapeId string"), str(tmp_path / "log"))
    files.append_log(spark.createDataFrame([("r4",)], "scrapeId string"), str(tmp_path / "log"))
    assert files.run_log(spark, str(tmp_path / "log")).count() == 2


def test_geojson_round_trip(spark, tmp_path):
    box = [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": box}, "properties": {"name": "n"}}]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc, indent=1))
    got = files.geojson(spark, str(tmp_path / "f.geojson"), "name:string")
    assert got.select("name", "xmax", "ymax").first()[:] == ("n", 2.0, 1.0)
    files.write_features(got.select("name", "polygon"), str(tmp_path / "out"), "name")
    line = spark.read.text(str(tmp_path / "out")).first()
    assert json.loads(line.value)["geometry"]["coordinates"] == [[[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 1.0], [0.0, 0.0]]] and line.name == "n"


def test_paged_features(spark, tmp_path):
    for offset in (0, 2):
        rows = [{"attributes": {"id": offset + i, "owner": None}, "geometry": {"x": i}} for i in range(2)]
        (tmp_path / f"p{offset}.json").write_text(json.dumps({"features": rows[: 1 if offset else 2]}))
    spark.dataSource.register(files.PagedFeatures)
    got = spark.read.format("paged_features").options(url=f"file://{tmp_path}/p{{offset}}.json", total="3", page="2", fields="id,owner,geometry", delay="0").load()
    assert sorted(tuple(r) for r in got.collect()) == [("0", None, '{"x": 0}'), ("1", None, '{"x": 1}'), ("2", None, '{"x": 0}')]
    assert got.rdd.getNumPartitions() == 2


def test_count_is_asked_and_loads_go_on(spark, tmp_path):
    for offset in range(0, 10, 2):
        (tmp_path / f"p{offset}.json").write_text(json.dumps({"features": [{"attributes": {"id": offset + i}} for i in range(2) if offset + i < 9]}))
    (tmp_path / "count.json").write_text(json.dumps({"count": 9}))
    spark.dataSource.register(files.PagedFeatures)
    options = {"url": f"file://{tmp_path}/p{{offset}}.json", "count_url": f"file://{tmp_path}/count.json", "page": "2", "fields": "id", "delay": "0", "retries": "0"}
    assert spark.read.format("paged_features").options(**options).load().count() == 9
    hidden = (tmp_path / "p6.json").rename(tmp_path / "hidden")
    path = str(tmp_path / "table")
    with pytest.raises(Exception, match="p6.json"):
        files.load_pages(spark, path, options, pages=2)
    hidden.rename(tmp_path / "p6.json")
    assert files.load_pages(spark, path, options, pages=2) == 2 and files.load_pages(spark, path, options, pages=2) == 0
    assert sorted(int(r.id) for r in spark.read.parquet(path).collect()) == list(range(9))


def test_multipolygons_and_exports(spark, tmp_path):
    box = lambda x: [[[x, 0], [x + 2, 0], [x + 2, 1], [x + 1, 1], [x, 1], [x, 0]]]
    features = [("Polygon", box(0), "Polk County"), ("MultiPolygon", [box(5), box(9)], "Story"), ("Point", [1, 2], "x")]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"name": n}} for k, c, n in features]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    got = {r.name: r for r in files.geojson(spark, str(tmp_path / "f.geojson"), "name:string").collect()}
    assert [len(got[n].polygons or []) for n in ("Polk County", "Story", "x")] == [1, 2, 0] and (got["Story"].xmin, got["Story"].xmax) == (5, 11)
    rows = spark.createDataFrame([(r.name, r.polygon[0]) for r in got.values() if r.polygon], f"county string, ring {geo.RING}")
    files.write_county_features(rows, str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert {r.slug for r in lines} == {"polk-county", "story"} and all(len(json.loads(r.value)["geometry"]["coordinates"][0]) == 5 for r in lines)
    groups = spark.createDataFrame([("A", 3, 1.0), ("B", 2, 9.0), ("C", 1, 1.0)], "owner string, parcel_count int, total_acres double")
    polygons = spark.createDataFrame([(o, [got["Story"].polygon[0]]) for o in "AABC"], f"owner string, polygon array<{geo.RING}>")
    files.write_top_owners(groups, polygons, str(tmp_path / "top"), 2)
    assert sorted(json.loads(r.value)["properties"]["owner"] for r in spark.read.text(str(tmp_path / "top")).collect()) == ["A", "A", "B"]
    files.write_report(groups, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def test_simplified_rings_stay_rings():
    comb = [(0, 0)] + [p for i in range(10) for p in ((i, 1 + 0.01 * (i % 2)), (i + 0.5, 0.1), (i + 0.6, 0.1))] + [(10, 0), (0, 0)]
    for tolerance in (0.001, 0.05, 2, 100):
        out = files._simple(comb, tolerance)
        assert out[0] == out[-1] and len(out) > 3 and not files._crosses(out) and set(out) <= set(comb)
    assert files._crosses([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])


def test_tables_are_rebuilt_and_told(spark):
    files.rebuild(spark.range(5), "rebuilt_parcels")
    files.rebuild(spark.range(2), "rebuilt_parcels")
    try:
        assert spark.table("rebuilt_parcels").count() == 2
        assert ("rebuilt_parcels", "id", "bigint") in {r[:3] for r in files.catalog(spark).collect()}
    finally:
        spark.sql("DROP TABLE rebuilt_parcels")


def test_rings_to_polygons(spark):
    clockwise = F.reverse(geo.box_ring(F.lit(0), F.lit(0), F.lit(4), F.lit(4)))
    hole = geo.box_ring(F.lit(1), F.lit(1), F.lit(2), F.lit(2))
    got = spark.range(1).select(files.polygons_of_rings(F.array(clockwise, hole, clockwise)).alias("p")).first().p
    assert [len(p) for p in got] == [2, 1]
