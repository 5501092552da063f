"""Queries of the data products: places, counties, lists, requests, audits, ratings and clusters of auctions and parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreflow.functions import geo
from acreflow.operators import relational

from . import products
from .base import Tables, register
from .spatial import BOXES, GRID, _boxes, _grid, _ring

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

#: Customers as auctions: some have coordinates, and a county by their nation; the last nations have no centroid.
AUCTIONS = """(SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN n_name || ' County' ELSE n_name END AS county, n_name AS bare, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Ohio' ELSE 'Iowa' END AS state, c_mktsegment AS source,
 c_name AS address, CASE WHEN c_acctbal < 5000 THEN c_acctbal END AS latitude, CASE WHEN c_acctbal < 5000 THEN 1.0::DOUBLE * c_nationkey END AS longitude, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
CENTROIDS = "(SELECT n_name AS county, 1.0::DOUBLE * n_nationkey AS lat, 2.0::DOUBLE * n_nationkey AS lon FROM nation WHERE n_name < 'NATION_5')"


def _auctions(t: Tables) -> DataFrame:
    placed = F.col("c_acctbal") < 5000
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.concat("n_name", F.lit(" County"))).otherwise(F.col("n_name")).alias("county"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "Ohio").otherwise("Iowa").alias("state"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("address"),
        F.when(placed, F.col("c_acctbal")).alias("latitude"), F.when(placed, F.col("c_nationkey").cast("double")).alias("longitude"), F.col("c_acctbal").alias("balance"),
    )


def _centroids(t: Tables) -> DataFrame:
    return t.nation.filter("n_name < 'NATION_5'").select(F.col("n_name").alias("county"), F.col("n_nationkey").cast("double").alias("lat"), (F.col("n_nationkey") * 2).cast("double").alias("lon"))


#: What two geocoders found for addresses, and what legal descriptions say, by balance and segment.
_FOUND = {"first": "balance > 8000", "second": "balance BETWEEN 6000 AND 8000", "section": "source = 'BUILDING'", "township": "source = 'MACHINERY'"}


def _addresses(a: DataFrame) -> DataFrame:
    one, two = F.expr(_FOUND["first"]), F.expr(_FOUND["second"])
    at = lambda cond: F.when(cond, F.col("balance"))
    return a.select("address", at(one).alias("lat"), at(one).alias("lon"), at(two).alias("lat2"), at(two).alias("lon2"), (F.col("balance") < 9000).alias("inside"), (F.col("balance") < 7000).alias("inside2"))


def _legal(a: DataFrame) -> DataFrame:
    level = F.when(F.expr(_FOUND["section"]), "section").when(F.expr(_FOUND["township"]), "township")
    return a.select("id", F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), level.alias("level")).filter("level IS NOT NULL")


@query(f"""SELECT id, CASE WHEN {_FOUND["first"]} THEN 'address' WHEN {_FOUND["second"]} THEN 'address_2' WHEN source IN ('BUILDING', 'MACHINERY') THEN 'legal' WHEN c.county IS NOT NULL THEN 'centroid' END AS method,
CASE WHEN {_FOUND["first"]} THEN 95 WHEN {_FOUND["second"]} THEN 90 WHEN source = 'BUILDING' THEN 80 WHEN source = 'MACHINERY' THEN 60 WHEN c.county IS NOT NULL THEN 50 END AS confidence,
CASE WHEN {_FOUND["first"]} OR {_FOUND["second"]} THEN balance WHEN source IN ('BUILDING', 'MACHINERY') THEN 1.5 ELSE c.lat END AS latitude FROM {AUCTIONS} a LEFT JOIN {CENTROIDS} c ON c.county = a.bare""")
def geocode_cascade(t: Tables) -> DataFrame:
    a = _auctions(t)
    return products.geocoded(a.drop("latitude", "longitude"), _addresses(a), _legal(a), _centroids(t)).select("id", "method", "confidence", "latitude")


@query(f"""SELECT id, CASE WHEN source IN ('BUILDING', 'MACHINERY') THEN 'legal' WHEN {_FOUND["first"]} AND balance < 9000 THEN 'address' WHEN {_FOUND["second"]} AND balance < 7000 THEN 'address_2' WHEN c.county IS NOT NULL AND state = 'Iowa' THEN 'centroid' END AS method,
CASE WHEN source IN ('BUILDING', 'MACHINERY') THEN 'high' WHEN {_FOUND["first"]} AND balance < 9000 THEN 'high' WHEN {_FOUND["second"]} AND balance < 7000 THEN 'medium' WHEN c.county IS NOT NULL AND state = 'Iowa' THEN 'low' END AS confidence FROM {AUCTIONS} a LEFT JOIN {CENTROIDS} c ON c.county = a.bare""")
def geocode_farmland(t: Tables) -> DataFrame:
    a = _auctions(t)
    return products.geocoded_farmland(a.drop("latitude", "longitude"), _addresses(a), _legal(a), _centroids(t)).select("id", "method", "confidence")


@query(f"SELECT id, CASE WHEN latitude IS NOT NULL AND source = 'HOUSEHOLD' THEN 'NATION_0' ELSE county END AS county FROM {AUCTIONS} WHERE bare <> 'NATION_0' UNION ALL SELECT id, county FROM {AUCTIONS} WHERE bare = 'NATION_0'")
def county_fix(t: Tables) -> DataFrame:
    """Coordinates of households turn out to lie in the first county."""
    a = _auctions(t)
    return products.counties_fixed(a, a.filter("source = 'HOUSEHOLD'").select("id", F.lit("NATION_0").alias("county"))).select("id", "county")


@query(f"SELECT id, CASE WHEN fill THEN lat ELSE latitude END AS latitude, CASE WHEN fill THEN lon ELSE longitude END AS longitude, fill AS filled FROM (SELECT a.*, lat, lon, latitude IS NULL AND state = 'Iowa' AND c.county IS NOT NULL AS fill FROM {AUCTIONS} a LEFT JOIN {CENTROIDS} c ON c.county = a.bare)")
def backfill(t: Tables) -> DataFrame:
    a = _auctions(t).withColumn("raw_data", F.lit(None).cast("string"))
    return products.backfilled(a, _centroids(t)).select("id", "latitude", "longitude", F.col("raw_data").isNotNull().alias("filled"))


@query(f"SELECT source, count(*) AS total, count(latitude) AS with_place, count(*) - count(latitude) AS without_place, count(*) FILTER (WHERE latitude IS NULL AND c.county IS NOT NULL) AS fixable FROM {AUCTIONS} a LEFT JOIN {CENTROIDS} c ON c.county = a.bare GROUP BY source")
def investigate(t: Tables) -> DataFrame:
    return products.investigated(_auctions(t), _centroids(t))


#: Orders as listed auctions.
LISTED = """(SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'sold' END AS status, o_totalprice AS acreage, o_orderdate AS auction_date, o_orderpriority AS land_type, CASE WHEN o_totalprice > 100000 THEN o_totalprice / 5000 END AS csr2_mean,
 CASE WHEN o_totalprice < 400000 THEN o_totalprice / 10000 END AS latitude, CASE WHEN o_totalprice < 400000 THEN -93.0::DOUBLE END AS longitude FROM orders)"""
_LISTED = "status = 'active' AND acreage >= 50000 AND land_type IN ('1-URGENT', '2-HIGH') AND auction_date <= TIMESTAMP '1999-01-01' + INTERVAL 90 DAY AND coalesce(csr2_mean >= 30, true) AND coalesce(latitude BETWEEN 8 AND 35, true)"


def _listed(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    orders = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("sold").alias("status"), price.alias("acreage"), F.col("o_orderdate").alias("auction_date"), F.col("o_orderpriority").alias("land_type"), F.lit(None).cast("string").alias("county"),
        F.when(price > 100000, price / 5000).alias("csr2_mean"), F.lit(None).cast("double").alias("estimated_value"), F.when(price < 400000, price / 10000).alias("latitude"), F.when(price < 400000, F.lit(-93.0)).alias("longitude"),
    )
    return products.auction_list(orders, (8.0, 35.0, -97.0, -90.0), {"min_acreage": 50000, "min_csr2": 30, "days": 90, "land_types": ["1-URGENT", "2-HIGH"], "min_value": 1}, F.lit("1999-01-01").cast("timestamp"), without_place=True)


@query(f"SELECT id FROM {LISTED} WHERE {_LISTED} ORDER BY auction_date, id LIMIT 200")
def auction_page(t: Tables) -> DataFrame:
    """A page of 200 at most, though 500 are asked for."""
    return products.auction_page(_listed(t), 500).select("id")


@query(f"SELECT count(*) AS n, count(latitude) AS with_place FROM {LISTED} WHERE {_LISTED}")
def auction_count(t: Tables) -> DataFrame:
    return products.auction_count(_listed(t))


_LAND = "CASE WHEN l_returnflag = 'A' THEN 'CRP' WHEN l_returnflag = 'R' THEN 'Pasture' ELSE 'Swamp' END"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, errors FROM (SELECT *, concat_ws('|', CASE WHEN {_LAND} = 'Swamp' THEN 'Land type must be known' END, CASE WHEN l_quantity < 3 THEN 'Acreage must be greater than 0' END,
CASE WHEN l_quantity < 3 THEN 'Tillable acres cannot exceed total acres' WHEN l_tax * 100 > l_quantity THEN 'Tillable acres cannot exceed total acres' END, CASE WHEN l_discount * 12000 > 1000 THEN 'Cash rent must be between 0 and 1000' END) AS errors FROM lineitem) WHERE errors <> ''""")
def quarantine(t: Tables) -> DataFrame:
    """Lines as valuation requests: those that break a rule, with what they break."""
    land = F.when(F.col("l_returnflag") == "A", "CRP").when(F.col("l_returnflag") == "R", "Pasture").otherwise("Swamp")
    requests = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.lit("Polk").alias("county"), F.lit("Iowa").alias("state"), land.alias("land_type"), F.when(F.col("l_quantity") >= 3, F.col("l_quantity")).alias("acreage"),
        (F.col("l_tax") * 100).alias("tillable_acres"), (F.col("l_discount") * 12000).alias("cash_rent"), F.lit(None).cast("double").alias("cap_rate"), F.lit(None).cast("string").alias("non_tillable"),
    )
    return products.valid_requests(requests)[1].select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("errors", "|").alias("errors"))


@query("SELECT user_id, max(ts) IS NULL OR max(ts) <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 2 HOUR AS due FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def due_runs(t: Tables) -> DataFrame:
    last = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", relational.is_due(F.col("last"), F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("due"))


@query("""SELECT source, count(d) AS discovered, count(s) AS stored, count(*) FILTER (WHERE s IS NULL) AS missing, count(*) FILTER (WHERE d IS NULL) AS stale, CASE WHEN count(d) > 0 THEN floor(100.0 * count(*) FILTER (WHERE d IS NOT NULL AND s IS NOT NULL) / count(d) + 0.5) ELSE 0 END::BIGINT AS coverage
FROM (SELECT DISTINCT o_orderpriority AS source, o_custkey AS url, 1 AS d FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT DISTINCT o_orderpriority AS source, o_custkey AS url, 1 AS s FROM orders WHERE o_orderstatus = 'O') USING (source, url) GROUP BY source""")
def audit(t: Tables) -> DataFrame:
    of = lambda status: t.orders.filter(F.col("o_orderstatus") == status).select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("url"))
    return products.coverage_audit(of("F"), of("O"))


@query(f"SELECT g.id, CAST(sum(30 + bid % 60) AS DOUBLE) / count(*) AS mean FROM {GRID} g JOIN {BOXES} b ON gx + 0.5 > x0 AND gx + 0.5 < x1 AND gy + 0.25 > y0 AND gy + 0.25 < y1 GROUP BY g.id")
def point_ratings(t: Tables) -> DataFrame:
    """Ratings at points in map units that overlap."""
    points = _grid(t).select("id", (F.col("gx") + 0.5).alias("x"), (F.col("gy") + 0.25).alias("y"))
    units = _ring(_boxes(t)).withColumn("mukey", F.col("bid"))
    return products.point_ratings(points, units, units.select("mukey", (30 + F.col("bid") % 60).alias("rating"), F.lit(100).alias("percent")), 4.0)


@query(f"""WITH RECURSIVE g AS (SELECT id, owner, size % 3 AS county, gx, gy FROM {GRID}), e AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.owner = b.owner AND a.county = b.county AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1),
w AS (SELECT id AS a, id AS l FROM g UNION SELECT e.b, w.l FROM w JOIN e ON e.a = w.a)
SELECT owner, county, count(DISTINCT l) AS clusters, count(*) AS parcels, count(*)::DOUBLE AS area FROM (SELECT g.owner, g.county, w.a, min(w.l) AS l FROM w JOIN g ON g.id = w.a WHERE g.county <> 2 GROUP BY ALL) GROUP BY owner, county HAVING count(*) > 1""")
def county_parcels(t: Tables) -> DataFrame:
    """Each owner's clusters in each county, and the area of their polygons."""
    d = _ring(_grid(t)).withColumns({"county": F.col("size") % 3, "area_sqm": F.lit(1.0)})
    found = products.county_clusters(d, (2,), eps=0.1, cell=4.0)
    area = F.aggregate(F.transform("polygons", geo.polygon_area), F.lit(0.0), lambda s, x: s + x)
    return found.groupBy("owner", "county").agg(F.count(F.lit(1)).alias("clusters"), F.sum("parcel_count").alias("parcels"), F.sum(area).alias("area"))


_STATUS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'pending' WHEN 'MACHINERY' THEN 'processing' WHEN 'HOUSEHOLD' THEN 'completed' WHEN 'FURNITURE' THEN 'failed' END"
_WANTED = "CASE WHEN c_acctbal < 2000 THEN 'processing' WHEN c_acctbal < 5000 THEN 'completed' WHEN c_acctbal < 8000 THEN 'pending' ELSE 'failed' END"


@query(f"""SELECT c_custkey, CASE WHEN moved THEN wanted ELSE status END AS status, moved FROM (SELECT *, coalesce((status IS NULL AND wanted = 'pending') OR (status = 'pending' AND wanted = 'processing') OR (status = 'processing' AND wanted IN ('completed', 'failed')) OR (status = 'failed' AND wanted = 'pending'), false) AS moved
FROM (SELECT c_custkey, {_STATUS} AS status, {_WANTED} AS wanted FROM customer))""")
def status_machine(t: Tables) -> DataFrame:
    """Rows of a work queue that go on where a step of the status machine leads there."""
    d = t.customer.select("c_custkey", F.expr(_STATUS).alias("status"), F.expr(_WANTED).alias("wanted"))
    return relational.transitioned(d, F.col("wanted")).select("c_custkey", "status", "moved")
