import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from acreflow.functions import geo, listings, owners, values


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "service", "loader", "bbox", "compare"),
    [
        ("Smith, John", "JOHN SMITH", "JOHN SMITH", "SMITH JOHN", "SMITH JOHN"),
        ("Smith Family Trust", "SMITH FAMILY", "SMITH FAMILY", "SMITH FAMILY TRUST", "SMITH FAMILY"),
        ("ACME FARMS, LLC", "ACME FARMS", "ACME FARMS", "ACME FARMS LLC", "ACME FARMS"),
        ("Jones & Sons L.L.C.", "JONES SONS", "JONES SONS", "JONES & SONS L L C", "JONES SONS"),
        ("Miller, Ann Trust", "ANN MILLER", "ANN MILLER", "MILLER ANN TRUST", "MILLER ANN"),
        ("Polk Co", "POLK", "POLK CO", "POLK CO", "POLK"),
        ("O'Brien Ltd.", "OBRIEN", "OBRIEN LTD", "O'BRIEN LTD", "OBRIEN"),
        ("Anderson, Sandy", "SANDY ANDERSON", "SANDY ANDERSON", "ANDERSON SANDY", "ANDERSON SANDY"),
        (None, None, None, "UNKNOWN", None),
    ],
)
def test_owner_names(spark, name, service, loader, bbox, compare):
    n = F.lit(name).cast("string")
    got = [one(spark, owners.normalize_owner(n, v)) for v in ("service", "loader", "bbox", "compare")]
    assert got == [service, loader, bbox, compare]


def test_land_values(spark):
    b = one(spark, values.blended(F.lit(100.0), F.lit(80.0), F.lit(85.0), F.lit(9000.0), F.lit("CRP")))
    assert (b.tillable, b.non_tillable, b.total, b.blended) == (14790, 5850, 1_300_200, 13_002)
    f = one(spark, values.final_value(F.lit(12000.0), F.lit(0.05), F.lit(100.0), F.lit(25000.0)))
    assert (f.adjustment, f.per_acre, f.total) == (600, 12_600, 1_285_000)
    assert one(spark, values.final_value(F.lit(100.0), F.lit(0.9), F.lit(1.0), F.lit(0.0))).adjustment == 50
    assert one(spark, values.final_value(F.lit(100.0), F.lit(-0.5), F.lit(1.0), F.lit(0.0))).adjustment == -20
    assert one(spark, values.rating_value(F.lit(80.0), F.lit(13000.0), F.lit(65.0))) == 16_000
    assert one(spark, values.rating_value(F.lit(0.0), F.lit(13000.0), F.lit(65.0))) == 0
    c = one(spark, values.comps(F.array(F.lit(5000.0), F.lit(7000.0), F.lit(9000.0))))
    assert (c.used, c.excluded, c.average, c.all_filtered) == (2, 1, 8000, False)
    assert one(spark, values.half_up(F.lit(-2.5))) == -2 and one(spark, values.half_up(F.lit(2.5))) == 3
    assert one(spark, values.income_value(F.lit(300.0), F.lit(0.0))) == pytest.approx(10_000)


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2025-09-09", "2025-09-09"), ("September 9, 2025", "2025-09-09"), ("Sept. 9th, 2025", "2025-09-09"), ("12/15/2025", "2025-12-15"), ("25/12/2025", "2025-12-25"),
        ("31-01-2025", "2025-01-31"), ("4/5/2025", "2025-04-05"), ("nonsense", None), ("", None), (None, None),
    ],
)
def test_dates(spark, text, day):
    got = one(spark, listings.parse_date(F.lit(text).cast("string")))
    assert got == (dt.date.fromisoformat(day) if day else None)


def test_dates_in_texts(spark):
    as_of = F.lit("2025-06-01").cast("date")
    find = lambda t: one(spark, listings.extract_date(F.lit(t), as_of))
    assert find("Sale Date: Nov 30, 2025 at ten") == dt.date(2025, 11, 30)
    assert find("old 1/2/1999, new 2025-12-15.") == dt.date(2025, 12, 15)
    assert find("nothing 1/2/1999") is None


def test_archive_reasons(spark):
    rows = [
        (1, "active", "2025-11-12", False, None, "pending"), (2, "active", "2025-11-12", True, None, "pending"), (3, "sold", None, False, None, "pending"), (4, "active", "2025-12-01", False, "Property SOLD", "completed"),
        (5, "active", "2025-12-01", False, "Sale closed", "completed"), (6, "active", "2025-12-01", False, "Property SOLD", "pending"), (7, "active", "2025-11-13", False, None, "pending"),
    ]
    d = spark.createDataFrame(rows, "id int, status string, d string, review boolean, text string, enrichment string").withColumn("d", F.col("d").cast("timestamp"))
    reason = listings.archive_reason(F.col("status"), F.col("d"), F.col("review"), F.col("text"), F.col("enrichment"), F.lit(None).cast("string"), F.lit("2025-11-13").cast("timestamp"))
    got = {r.id: r.v for r in d.select("id", reason.alias("v")).collect()}
    assert got == {1: "past_auction_date", 2: None, 3: "marked_sold", 4: "ai_detected_sold", 5: "ai_detected_closed", 6: None, 7: None}


def test_projection_and_tiles(spark):
    lon, lat = F.lit(-93.65), F.lit(41.59)
    assert one(spark, geo.mercator_x(lon)) == pytest.approx(-10425070.3128, abs=1e-3)
    assert one(spark, geo.mercator_y(lat)) == pytest.approx(5099759.9232, abs=1e-3)
    for z, x, y in ((10, 245, 381), (11, 491, 763), (14, 3929, 6107)):
        assert (one(spark, geo.tile_x(lon, F.lit(z))), one(spark, geo.tile_y(lat, F.lit(z)))) == (x, y)


def test_geometry(spark):
    ring = geo.box_ring(F.lit(0), F.lit(0), F.lit(2), F.lit(3))
    assert one(spark, geo.polygon_area(F.array(ring))) == 6
    hole = geo.box_ring(F.lit(0.5), F.lit(0.5), F.lit(1), F.lit(1))
    assert one(spark, geo.polygon_area(F.array(ring, hole))) == 5.75
    assert one(spark, geo.in_polygon(F.array(ring, hole), F.lit(1.5), F.lit(0.7))) is True
    assert one(spark, geo.in_polygon(F.array(ring, hole), F.lit(0.7), F.lit(0.7))) is False
    c = one(spark, geo.ring_centroid(ring))
    assert (c.x, c.y) == (1, 1.5)
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111195, rel=1e-3)
    assert one(spark, geo.geodesic_area(geo.box_ring(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))) == pytest.approx(1.2391e10, rel=1e-3)
    wkt = one(spark, geo.to_wkt(geo.parse_wkt(F.lit("POLYGON((0 0, 2 0,2 3,0 0))"))))
    assert wkt == "POLYGON((0.0 0.0,2.0 0.0,2.0 3.0,0.0 0.0))"
    assert one(spark, geo.parse_wkt(F.lit("LINESTRING(0 0,1 1)"))) is None
    circle = one(spark, geo.circle(F.lit(0.0), F.lit(0.0), 1000.0))
    assert len(circle) == 34 and all(math.isclose(math.hypot(p.x, p.y), math.degrees(1000 / geo.EARTH), rel_tol=1e-9) for p in circle)


def test_surname_and_tiers(spark):
    assert one(spark, owners.surname(F.lit(" JOHN Q SMITH "))) == "SMITH"
    assert [one(spark, owners.match_tier(F.lit(d), F.lit("AB"), F.lit("ABC"))) for d in (1, 3, 5, 7)] == [0.98, 0.92, 0.88, None]
