import json

import pytest
from pyspark.sql import functions as F

from acreflow.functions import geo
from acreflow.operators import owners, relational, spatial, tiles
from acreflow.plans import products


def parcels(spark):
    rows = [(1, "A", 0.0, 0.0, 4046.86, "ADAIR"), (2, "A", 0.001, 0.0, 4046.86, "ADAIR"), (3, "A", 0.00205, 0.0, 8093.72, "ADAIR"), (4, "A", 0.01, 0.0, 4046.86, "ADAIR"), (5, "B", 0.0, 0.001, 4046.86, "ADAIR"), (6, "A", 0.0, 0.001, 4046.86, "HARRISON"), (7, "A", None, None, 4046.86, "ADAIR")]
    d = spark.createDataFrame(rows, "id long, owner string, xmin double, ymin double, area_sqm double, county string")
    return d.withColumn("xmax", F.col("xmin") + 0.001).withColumn("ymax", F.col("ymin") + 0.001).withColumn("deed_holder", F.col("owner"))


def test_parcel_groups_and_clusters(spark):
    got = products.owner_groups(parcels(spark)).collect()
    assert [(r.owner, r.parcel_count, round(r.total_acres, 6), r.parcel_ids) for r in got] == [("A", 5, 6.0, [1, 2, 3, 4, 6])]
    got = products.county_clusters(parcels(spark)).collect()
    assert sorted((r.owner, r.county, r.parcel_ids, r.parcel_count, round(r.total_acres, 6)) for r in got) == [("A", "ADAIR", [1, 2, 3], 3, 4.0), ("A", "ADAIR", [4], 1, 1.0)]
    got = products.clusters_in_box(parcels(spark), -1, -1, 0.005, 1)
    assert sorted((r.owner, r.parcel_ids, r.counties) for r in got.collect()) == [("A", [1, 2, 3, 6], "ADAIR, HARRISON"), ("B", [5], "ADAIR")]


def test_clusters_of_nothing(spark):
    assert products.county_clusters(parcels(spark).limit(0)).count() == 0


def test_long_chain_is_one_cluster(spark):
    d = spark.range(300).select("id", F.lit("A").alias("owner"), F.col("id").cast("double").alias("xmin"), F.lit(0.0).alias("ymin"))
    d = d.withColumn("xmax", F.col("xmin") + 1).withColumn("ymax", F.col("ymin") + 1)
    assert spatial.adjacent_clusters(d, ["owner"]).agg(F.countDistinct("cluster"), F.max("cluster")).first()[:] == (1, 0)


def test_similar_owners(spark):
    names = spark.createDataFrame([("JON SMITH",), ("JOHN SMYTHE",), ("MARY SMITH",), ("JOHN SMITH",), (None,)], "n string")
    assert sorted(r.name for r in owners.similar(names, "n", "JOHN SMITH", 3).collect()) == ["JOHN SMYTHE", "JON SMITH"]


def test_soil(spark):
    c = spark.createDataFrame([("m1", 90, 60), ("m1", 70, 40), ("m2", 50, 80), ("m3", 50, 0)], "mukey string, rating int, percent int")
    r = products.rating_means(c).first()
    assert (r["mean"], r.low, r.high, r.n) == (66.0, 50.0, 82.0, 2)
    area = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 5.0, 5.0, 6.0, 6.0)], "area_id string, xmin double, ymin double, xmax double, ymax double")
    area = area.withColumn("ring", geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))
    units = spark.createDataFrame([("m1", 0.0, 0.0, 0.75, 1.0), ("m2", 0.75, 0.0, 2.0, 1.0)], "mukey string, xmin double, ymin double, xmax double, ymax double")
    units = units.withColumn("ring", geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))
    samples = spark.createDataFrame([(5.1, 5.1, 40.0), (5.9, 5.9, 60.0), (5.5, 5.5, -128.0)], "sx double, sy double, value double")
    got = {r.area_id: r for r in products.area_ratings(area, units, c.filter("percent > 0"), samples, 0.5).collect()}
    assert got["a"]["mean"] == pytest.approx(75.2631, abs=1e-3) and (got["a"].low, got["a"].high, got["a"].n) == (50, 90, 3)
    assert (got["b"]["mean"], got["b"].n, got["b"].origin) == (50.0, 2, "samples")


def test_soil_profiles(spark):
    mapunit = spark.createDataFrame([("m1", "Clarion")], "mukey string, muname string")
    comp = spark.createDataFrame([("c1", "m1", "Webster", 30), ("c2", "m1", "Clarion", 70)], "cokey string, mukey string, compname string, comppct_r int")
    hor = spark.createDataFrame([("h1", "c2", 0, "loam"), ("h2", "c2", 20, "clay")], "chkey string, cokey string, hzdept_r int, texture string")
    r = products.soil_profiles(mapunit, comp, hor).first()
    assert (r.top_name, r.surface, [c.compname for c in r.components]) == ("Clarion", "loam", ["Clarion", "Webster"])


def test_saved_auctions(spark):
    schema = "url string, title string, description string, status string, auction_date date, needs_review boolean"
    stored = spark.createDataFrame([("u1", "Old", "d", "active", None, True)], schema)
    new = spark.createDataFrame([("u1", "New", "sale closed", None, ["bad", "2025-09-01"]), ("u2", "Land", "bids due: October 24, 2025", "open", [None]), ("u2", "Again", "x", "open", None)], "url string, title string, description string, sold_status string, date_texts array<string>")
    got = {r.url: r for r in products.saved(stored, new, F.lit("2025-06-01").cast("date")).collect()}
    assert (got["u1"].title, got["u1"].status, str(got["u1"].auction_date), got["u1"].needs_review) == ("Old", "sold", "2025-09-01", False)
    assert (got["u2"].title, got["u2"].status, str(got["u2"].auction_date)) == ("Land", "active", "2025-10-24")


ADDRESS = "address string, lat double, lon double, lat2 double, lon2 double, inside boolean, inside2 boolean"


def test_geocode_cascades(spark):
    a = spark.createDataFrame([(1, "x", "Polk County", "Iowa"), (2, None, "Story", "Iowa"), (3, "y", "story", "Iowa"), (4, None, None, "Iowa"), (5, "y", "Polk", "Iowa"), (6, "z", "Polk", "Ohio"), (7, None, "Story", "Ohio")], "id int, address string, county string, state string")
    address = spark.createDataFrame([("x", 1.0, 2.0, None, None, False, None), ("y", None, None, 6.0, 6.0, None, True), ("z", 7.0, 7.0, 8.0, 8.0, False, True)], ADDRESS)
    legal = spark.createDataFrame([(1, 5.0, 5.0, "section"), (2, 5.5, 5.5, "township")], "id int, lat double, lon double, level string")
    centroid = spark.createDataFrame([("Polk", 3.0, 3.0), ("Story", 4.0, 4.0)], "county string, lat double, lon double")
    got = {r.id: (r.latitude, r.method, r.confidence) for r in products.geocoded(a, address, legal, centroid).collect()}
    assert got == {1: (1.0, "address", 95), 2: (5.5, "legal", 60), 3: (6.0, "address_2", 90), 4: (None, None, None), 5: (6.0, "address_2", 90), 6: (7.0, "address", 95), 7: (4.0, "centroid", 50)}
    got = {r.id: (r.latitude, r.method, r.confidence) for r in products.geocoded_farmland(a, address, legal, centroid).collect()}
    assert got == {1: (5.0, "legal", "high"), 2: (5.5, "legal", "high"), 3: (6.0, "address_2", "medium"), 4: (None, None, None), 5: (6.0, "address_2", "medium"), 6: (8.0, "address_2", "medium"), 7: (None, None, None)}
    places = spark.createDataFrame([("in", 0.1, 0.0), ("out", 3.0, 0.0)], "key string, lon double, lat double")
    assert [r.key for r in products.near_parcels(places, parcels(spark)).collect()] == ["in"]


def test_placed_auctions(spark):
    stored = spark.createDataFrame([], "url string, title string, description string, status string, auction_date date, needs_review boolean")
    scraped = [("a", "x", "Polk", "Iowa"), ("b", None, "Story County", "Iowa"), ("c", None, "Story", "Ohio"), ("d", "y", None, None), ("e", None, None, "Iowa")]
    new = spark.createDataFrame([(u, u, "d", "open", [None], x, c, s) for u, x, c, s in scraped], "url string, title string, description string, sold_status string, date_texts array<string>, address string, county string, state string")
    address = spark.createDataFrame([("x", 1.0, 1.0, "Dallas", "Iowa"), ("y", 2.0, 2.0, "Linn", "Iowa")], "address string, lat double, lon double, county string, state string")
    centroids = spark.createDataFrame([("Polk", 3.0, 3.0), ("Story", 4.0, 4.0)], "county string, lat double, lon double")
    counties = spark.createDataFrame([("Story", "Ohio", 5.0, 5.0)], "county string, state string, lat double, lon double")
    got = {r.url: (r.county, r.latitude, r.county_level) for r in products.placed_auctions(stored, new, F.lit("2025-06-01").cast("date"), address, centroids, counties).collect()}
    assert got == {"a": ("Polk", 1.0, False), "b": ("Story County", 4.0, True), "c": ("Story", 5.0, True), "d": ("Linn", 2.0, False), "e": (None, None, False)}


AUCTION = "id int, county string, state string, latitude double, longitude double, raw_data string, source string"


def auctions(spark):
    return spark.createDataFrame([(1, "Polk County", "Iowa", None, None, '{"k": "v", "geocodingMethod": "old"}', "s"), (2, "Polk", "Iowa", 1.0, 1.0, None, "s"), (3, "Nowhere", "Iowa", None, None, None, "s"), (4, "Polk", "Ohio", None, None, None, "t")], AUCTION)


def test_counties_and_backfill(spark):
    places = spark.createDataFrame([(2, "Story"), (1, "Story"), (4, "Polk")], "id int, county string")
    assert {r.id: r.county for r in products.counties_fixed(auctions(spark), places).collect()} == {1: "Polk County", 2: "Story", 3: "Nowhere", 4: "Polk"}
    centroids = spark.createDataFrame([("Polk", 3.0, 4.0)], "county string, lat double, lon double")
    got = {r.id: r for r in products.backfilled(auctions(spark), centroids).collect()}
    assert {i: r.latitude for i, r in got.items()} == {1: 3.0, 2: 1.0, 3: None, 4: None}
    assert json.loads(got[1].raw_data) == {"k": "v", "isCountyLevel": "true", "geocodingMethod": "county-centroid"} and got[2].raw_data is None
    assert sorted(tuple(r) for r in products.investigated(auctions(spark), centroids).collect()) == [("s", 3, 1, 2, 1), ("t", 1, 0, 1, 1)]


def test_auction_lists(spark):
    rows = [(1, "active", 100.0, "2025-06-10", 41.5, -93.0, None, 5.0, "Farm", "Polk"), (2, "active", 10.0, "2025-06-05", None, None, 80.0, None, "Farm", "Story"), (3, "sold", 100.0, "2025-06-10", 41.5, -93.0, 80.0, 5.0, "Farm", "Polk"), (4, "active", 100.0, "2026-06-10", 41.5, -93.0, 50.0, 5.0, "Timber", "Polk"), (5, "active", 100.0, None, 10.0, 10.0, 80.0, 5.0, "Farm", "Polk")]
    a = spark.createDataFrame(rows, "id int, status string, acreage double, d string, latitude double, longitude double, csr2_mean double, estimated_value double, land_type string, county string").withColumn("auction_date", F.col("d").cast("timestamp"))
    as_of, box = F.lit("2025-06-01").cast("timestamp"), (40.0, 44.0, -97.0, -90.0)
    ids = lambda d: [r.id for r in products.auction_page(d).collect()]
    assert ids(products.auction_list(a, box, {}, as_of)) == [1, 4]
    listed = products.auction_list(a, box, {"min_csr2": 60}, as_of, without_place=True)
    assert ids(listed) == [2, 1] and products.auction_count(listed).first()[:] == (2, 1)
    assert ids(products.auction_list(a, box, {"days": 30, "min_acreage": 50, "land_types": ["Farm"], "counties": None}, as_of)) == [1]
    assert len(relational.page(a, [F.col("id")], 5000, most=3, offset=-1).collect()) == 3


def test_request_rules(spark):
    kind = "id int, county string, state string, land_type string, acreage double, tillable_acres double, cash_rent double, cap_rate double, non_tillable string"
    rows = [(1, "Polk", "Iowa", "CRP", 10.0, 5.0, None, None, None), (2, None, "", "Desert", 0.0, 5.0, 2000.0, 0.5, "x"), (3, "Polk", "Iowa", "CRP", None, -1.0, 0.0, 0.01, "CRP")]
    good, bad = products.valid_requests(spark.createDataFrame(rows, kind))
    assert [r.id for r in good.collect()] == [1] and good.columns == [c.split()[0] for c in kind.split(", ")]
    errors = {r.id: r.errors for r in bad.collect()}
    assert len(errors[2]) == 8 and errors[3] == ["Acreage must be greater than 0", "Tillable acres must be non-negative", "Tillable acres cannot exceed total acres"]


def test_runs_that_are_due(spark):
    d = spark.createDataFrame([(None,), ("2025-01-01 10:00:00",), ("2025-01-01 09:59:59",), ("2025-01-01 11:00:00",)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r[0] for r in d.select(relational.is_due(F.col("t"), F.lit("2025-01-01 12:00:00").cast("timestamp"))).collect()] == [True, True, True, False]


def test_one_row_of_each_key(spark):
    d = spark.createDataFrame([(1, "a", 5), (1, "b", 1), (2, None, None)], "k int, v string, at int")
    assert sorted(map(tuple, relational.one_each(d, "k").collect())) == [(1, "b", 1), (2, None, None)]
    assert sorted(map(tuple, relational.one_each(d, "k", "at").collect())) == [(1, "a", 5), (2, None, None)]
    assert relational.upsert(d.limit(0), d, "k", ["v"]).count() == 2


def test_auction_values_and_point_ratings(spark):
    box = lambda rows: spark.createDataFrame(rows, "mukey string, xmin double, ymin double, xmax double, ymax double").withColumn("ring", geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))
    units, ratings = box([("m1", -1.0, -1.0, 0.0, 1.0), ("m2", 0.0, -1.0, 1.0, 1.0)]), spark.createDataFrame([("m1", 60, 100), ("m2", 80, 50), ("m2", 40, 50)], "mukey string, rating int, percent int")
    a = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, None, 0.0, 1.0), (3, 0.0, 0.5, 0.0)], "id int, latitude double, longitude double, acreage double")
    samples = spark.createDataFrame([], "sx double, sy double, value double")
    got = {r.id: r for r in products.auction_values(a, units, ratings, samples).collect()}
    assert set(got) == {1, 3} and got[1].csr2_mean == pytest.approx(60.0) and (got[1].csr2_low, got[1].csr2_high) == (40, 80)
    assert got[1].estimated_value == pytest.approx(60 * 174) and got[1].estimated_total == pytest.approx(60 * 1740) and got[3].estimated_total is None
    points = spark.createDataFrame([(1, -0.5, 0.0), (2, 0.5, 0.5), (3, 5.0, 5.0)], "id int, x double, y double")
    assert {r.id: r["mean"] for r in products.point_ratings(points, units, ratings).collect()} == {1: 60, 2: 60}


def test_clusters_with_polygons(spark):
    """Triangles whose boxes touch stand apart; those that touch have one outline."""
    tri = lambda x, y: [{"x": p, "y": q} for p, q in ((x, y), (x + 0.001, y), (x, y + 0.001), (x, y))]
    rows = [(1, "A", "ADAIR", tri(0.0, 0.0)), (2, "A", "ADAIR", tri(0.001, 0.001)), (3, "A", "ADAIR", [{"x": 0.001, "y": 0.0}, {"x": 0.001, "y": 0.001}, {"x": 0.0, "y": 0.001}, {"x": 0.001, "y": 0.0}][:4])]
    d = spark.createDataFrame(rows, f"id long, deed_holder string, county string, ring {geo.RING}").withColumns({"owner": F.col("deed_holder"), "area_sqm": F.lit(4046.86)})
    d = d.withColumn("e", geo.envelope(F.col("ring"))).select("*", "e.*")
    two = products.county_clusters(d.filter("id < 3"), eps=1e-5).collect()
    assert sorted((r.parcel_ids, len(r.polygons)) for r in two) == [([1], 1), ([2], 1)]
    (one,) = products.county_clusters(d.filter("id != 2"), eps=1e-5).collect()
    assert one.parcel_ids == [1, 3] and [len(p[0]) for p in one.polygons] == [5]
    assert [r.parcel_ids for r in products.clusters_in_box(d.filter("id != 2"), -1, -1, 1, 1).collect()] == [[1, 3]]
    assert products.owner_polygons(d.filter("id != 2")).count() == 1


def test_audit_and_anomalies(spark):
    d = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b")], "source string, url string")
    s = spark.createDataFrame([("s", "b"), ("s", "c")], "source string, url string")
    assert products.coverage_audit(d, s).first()[:] == ("s", 2, 2, 1, 1, 50)
    run = "source string, discovered int, processed int, failed int, region_found int, region_saved int"
    now = spark.createDataFrame([("a", 9, 6, 4, 3, 0), ("b", 10, 5, 5, 0, 0), ("c", 1, 0, 0, 0, 0)], run)
    past = spark.createDataFrame([("a", 20, 0, 0, 0, 0), ("b", 20, 0, 0, 0, 0), ("c", 5, 0, 0, 0, 0)], run)
    assert sorted(tuple(r) for r in relational.anomalies(now, past).collect()) == [("a", "drop"), ("a", "failures"), ("a", "region")]


def test_valuations(spark):
    req = spark.createDataFrame([(1, "Dryland", 100.0, 80.0, 300.0, 0.0, 85.0, "CRP", [("Barn", "ai", None), ("Well", "manual", 700.0)])], "id int, land_type string, acreage double, tillable_acres double, cash_rent double, cap_rate double, rating double, non_tillable string, improvements array<struct<type:string,method:string,manual:double>>")
    market = spark.createDataFrame([(1, 9000.0, 12000.0, 0.05, [5000.0, 7000.0])], "id int, base double, reasoned double, adjustment double, comps array<double>")
    r = products.valuations(req, market).first()
    assert (r.rating_value, r.rating_label, r.blended.total, r.improvements, r.comps.used, r.final.per_acre, r.final.total) == (14790, "excellent", 1_300_200, 15_700, 1, 12_600, 1_275_700)
    r = products.valuations(req, market.limit(0)).first()
    assert r.base == 2800 and r.final.per_acre == 2856


def test_features_are_json(spark):
    row = spark.range(1).select(geo.feature(F.array(geo.box_ring(F.lit(0), F.lit(0), F.lit(1), F.lit(1))), id=F.col("id")).alias("f")).first()
    assert json.loads(row.f)["properties"] == {"id": 0}


def test_overlapping_parcels_and_soil_with_holes(spark):
    box = lambda a, b, c, d: [{"x": x, "y": y} for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]
    rows = [(1, "A", "ADAIR", [box(0.0, 0.0, 0.004, 0.004), box(0.001, 0.001, 0.003, 0.003)]), (2, "A", "ADAIR", [box(0.002, 0.003, 0.006, 0.006)]), (3, "B", "ADAIR", [box(0.0, 0.0, 1.0, 1.0)])]
    d = spark.createDataFrame(rows, f"id long, deed_holder string, county string, polygon array<{geo.RING}>").withColumns({"owner": F.col("deed_holder"), "area_sqm": F.lit(4046.86)})
    d = d.withColumn("e", geo.envelope(F.get("polygon", 0))).select("*", "e.*")
    (one,) = products.county_clusters(d).collect()
    assert one.parcel_ids == [1, 2] and [len(p) for p in one.polygons] == [2]
    area = products.owner_polygons(d).select(F.sum(geo.polygon_area(F.col("polygon")))).first()[0]
    assert area * 1e6 == pytest.approx(16 - 4 + 12 - 2 * 1)
    soil = spark.createDataFrame([("m1", [box(0.0, 0.0, 4.0, 4.0), box(1.0, 1.0, 3.0, 3.0)]), ("m2", [box(1.0, 1.0, 3.0, 3.0)])], f"mukey string, polygon array<{geo.RING}>")
    soil = soil.withColumn("e", geo.envelope(F.get("polygon", 0))).select("mukey", "polygon", "e.*")
    ratings = spark.createDataFrame([("m1", 60, 100), ("m2", 90, 100)], "mukey string, rating int, percent int")
    area = spark.createDataFrame([(7, 0.0, 0.0, 2.0, 2.0)], "area_id int, xmin double, ymin double, xmax double, ymax double").withColumn("ring", geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))
    (r,) = products.area_ratings(area, soil, ratings, spark.createDataFrame([], "sx double, sy double, value double"), cell=1.0).collect()
    assert r["mean"] == pytest.approx((60 * 3 + 90) / 4) and r.n == 2
