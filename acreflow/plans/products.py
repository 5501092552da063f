"""The data products: parcels, soil, auctions, diagnostics, valuations.

Results of outside services (geocoders, soil rasters, language models) come in
as tables; what is done before and after them is here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreflow.functions import geo, listings, values
from acreflow.functions.owners import normalize_owner
from acreflow.operators import overlay, owners, relational, spatial, tiles
from acreflow.operators.storage import materialize

# --- parcels: id, county, deed_holder, area_sqm, ring or polygon (rings with holes), xmin, ymin, xmax, ymax


def with_owner(parcels: DataFrame, variant: str = "loader") -> DataFrame:
    return parcels.withColumn("owner", normalize_owner(F.col("deed_holder"), variant))


def owner_groups(parcels: DataFrame) -> DataFrame:
    """owner, parcel_count, total_acres, parcel_ids of owners of several mapped parcels."""
    return owners.rollup(parcels.filter("xmin IS NOT NULL"))


def owner_polygons(parcels: DataFrame, cell: float = 0.01) -> DataFrame:
    """owner, polygon: the union of the parcels of owners of several, a row for each of its polygons."""
    mapped = parcels.filter(F.col("xmin").isNotNull() & F.col("owner").isNotNull())
    several = mapped.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return overlay.union_polygons(_shaped(mapped.join(several, "owner", "left_semi")), "owner", cell=cell)


def _shaped(parcels: DataFrame) -> DataFrame:
    """Parcels with ``polygon``: their own, with holes, or the one ring they have."""
    return parcels if "polygon" in parcels.columns else parcels.withColumn("polygon", F.when(F.col("ring").isNotNull(), F.array("ring")))


def _with_geometry(found: DataFrame, cell: float) -> DataFrame:
    """cluster, polygons of clustered parcels with rings; a cluster's parcels may stand up to the cluster's gap apart, so there may be several."""
    return overlay.union_polygons(_shaped(found), "cluster", cell=cell).groupBy("cluster").agg(F.collect_list("polygon").alias("polygons"))


def county_clusters(parcels: DataFrame, skip: tuple[str, ...] = ("HARRISON",), eps: float = 1e-4, cell: float = 0.01) -> DataFrame:
    """owner, county, parcel_ids, parcel_count, total_acres of adjacent parcels of owners with several in a
    county; if parcels have rings, by their distance, and with the polygons of each cluster's union."""
    mapped = parcels.filter(F.col("xmin").isNotNull() & F.col("owner").isNotNull() & ~F.col("county").isin(*skip))
    several = mapped.groupBy("owner", "county").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kept = mapped.join(several, ["owner", "county"], "left_semi")
    found = _clustered(kept, ["owner", "county"], eps, cell)
    acres = values.acres(F.sum(F.col("area_sqm").cast("decimal(28,4)")).cast("double"))
    grouped = found.groupBy("owner", "county", "cluster").agg(F.sort_array(F.collect_list("id")).alias("parcel_ids"), F.count(F.lit(1)).alias("parcel_count"), acres.alias("total_acres"))
    return (grouped.join(_with_geometry(found, cell), "cluster", "left") if "polygon" in found.columns else grouped).drop("cluster")


def _clustered(parcels: DataFrame, by: list[str], eps: float, cell: float, metres: float | None = None) -> DataFrame:
    has_shape = bool({"ring", "polygon"} & set(parcels.columns))
    shaped = _shaped(parcels) if has_shape else parcels
    return materialize(spatial.adjacent_clusters(shaped, by, eps=eps, cell=cell, polygon="polygon" if has_shape else None, metres=metres).join(shaped, "id"))


def clusters_in_box(parcels: DataFrame, west: float, south: float, east: float, north: float, metres: float = 10.0, cell: float = 0.01) -> DataFrame:
    """owner, parcel_ids, parcel_count, counties of the clusters in a box, single parcels too, of parcels at most
    ``metres`` apart on the ground (1 m for outlines on the map); polygons too if parcels have rings."""
    seen = parcels.filter((F.col("xmax") >= west) & (F.col("xmin") <= east) & (F.col("ymax") >= south) & (F.col("ymin") <= north))
    seen = seen.withColumn("owner", normalize_owner(F.col("deed_holder"), "bbox"))
    found = _clustered(seen, ["owner"], 0.0, cell, metres)
    grouped = found.groupBy("owner", "cluster").agg(F.sort_array(F.collect_list("id")).alias("parcel_ids"), F.count(F.lit(1)).alias("parcel_count"), F.array_join(F.sort_array(F.collect_set("county")), ", ").alias("counties"))
    return (grouped.join(_with_geometry(found, cell), "cluster", "left") if "polygon" in found.columns else grouped).drop("cluster")


#: The last zoom that shows clusters; beyond it stand single parcels.
LAST_CLUSTER_ZOOM = 14


def _on_map(rows: DataFrame, polygons: Column) -> DataFrame:
    """Rows with polygons and their box in web-mercator metres."""
    drawn = rows.withColumn("polygons", geo.to_mercator(polygons)).filter("polygons IS NOT NULL")
    return drawn.withColumn("e", geo.envelope(F.flatten(F.flatten("polygons")))).select(*[c for c in drawn.columns if c not in ("xmin", "ymin", "xmax", "ymax")], "e.*")


def parcel_tiles(parcels: DataFrame, clusters: DataFrame, zooms: list[int], skip: tuple[str, ...] = ("HARRISON",)) -> DataFrame:
    """z, x, y, n, mvt: up to zoom 14 tiles of the clusters of ``county_clusters``, layer "ownership", above it of
    the parcels (id, county, parcel_number, parcel_class, deed_holder, owner, area_sqm, ring or polygon), layer "parcels"; counties in ``skip`` in none."""
    low, high = sorted({z for z in zooms if z <= LAST_CLUSTER_ZOOM}), sorted({z for z in zooms if z > LAST_CLUSTER_ZOOM})
    found = []
    if low:
        own = clusters.filter(~F.col("county").isin(*skip)).withColumns({"id": F.get("parcel_ids", 0), "acres": F.round("total_acres", 1)})
        found.append(tiles.pyramid(_on_map(own, F.col("polygons")), low, "ownership", "id", ["owner", "parcel_count", "acres", "county"]))
    if high:
        own = _shaped(parcels.filter(~F.col("county").isin(*skip))).withColumns({"owner_norm": F.col("owner"), "acres": F.round(values.acres(F.col("area_sqm")), 2)})
        own = _on_map(own.withColumn("owner", F.col("deed_holder")).withColumnRenamed("parcel_class", "class"), F.when(F.col("polygon").isNotNull(), F.array("polygon")))
        own = own.drop("ring", "polygon")
        found += [tiles.tiles(own, z, "parcels", "id", ["id", "county", "parcel_number", "class", "owner", "owner_norm", "acres"], simplify=False) for z in high]
    return reduce(DataFrame.union, found)


# --- soil: component(cokey, mukey, compname, comppct_r), mapunit(mukey, muname), horizon(chkey, cokey, hzdept_r, texture), ratings(cokey, mukey, rating, percent)


def soil_profiles(mapunit: DataFrame, component: DataFrame, horizon: DataFrame) -> DataFrame:
    """mukey, muname, dominant component and its surface texture, and all components."""
    top = relational.dominant(component, "mukey", "comppct_r", "cokey").select("mukey", F.col("cokey").alias("top_key"), F.col("compname").alias("top_name"))
    all_of = component.groupBy("mukey").agg(F.sort_array(F.collect_list(F.struct(F.col("comppct_r").alias("percent"), "compname")), False).alias("components"))
    surface = horizon.filter("hzdept_r = 0").groupBy("cokey").agg(F.min("texture").alias("surface"))
    met = mapunit.join(all_of, "mukey").join(top, "mukey")
    return met.join(surface, F.col("top_key") == F.col("cokey"), "left").select("mukey", "muname", "top_name", "surface", "components")


def rating_means(component: DataFrame) -> DataFrame:
    """mean, low, high, n over map units of the weighted means of their components (mukey, rating, percent)."""
    each = relational.weighted_means(component, "mukey", "rating", "percent")
    return each.agg(F.avg("mean").alias("mean"), F.min("mean").alias("low"), F.max("mean").alias("high"), F.count(F.lit(1)).alias("n"))


def area_ratings(areas: DataFrame, units: DataFrame, ratings: DataFrame, samples: DataFrame, cell: float = 0.05, side: int = 5) -> DataFrame:
    """area_id, mean, low, high, n, origin for areas (polygon or ring, box): ratings weighed by common area with
    map units, or where none is rated, the mean of point samples (sx, sy, value over 0) in the cells
    of a grid over the area's box."""
    u = _shaped(units).select("mukey", F.col("polygon").alias("unit_polygon"), *[F.col(c).alias(f"u{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    met = spatial.polygon_overlays(_shaped(areas), u, cell).filter("common > 0").join(ratings, "mukey").withColumn("w", F.col("common") * F.coalesce("percent", F.lit(100)))
    mean = F.sum(F.col("rating") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))
    local = met.groupBy("area_id").agg(mean.alias("mean"), F.min("rating").cast("double").alias("low"), F.max("rating").cast("double").alias("high"), F.count(F.lit(1)).alias("n")).filter("mean IS NOT NULL")
    rest = areas.join(local, "area_id", "left_anti")
    boxes = rest.select("area_id", "xmin", "ymin", "xmax", "ymax", ((F.col("xmax") - F.col("xmin")) / side).alias("dx"), ((F.col("ymax") - F.col("ymin")) / side).alias("dy"))
    p = samples.filter("value > 0").withColumn("cx", F.floor(F.col("sx") / cell)).withColumn("cy", F.floor(F.col("sy") / cell))
    held = spatial.with_cells(boxes, cell).join(p, ["cx", "cy"]).filter((F.col("sx") >= F.col("xmin")) & (F.col("sx") < F.col("xmax")) & (F.col("sy") >= F.col("ymin")) & (F.col("sy") < F.col("ymax")))
    at = [F.floor((F.col("sx") - F.col("xmin")) / F.col("dx")).alias("i"), F.floor((F.col("sy") - F.col("ymin")) / F.col("dy")).alias("j")]
    cells = held.groupBy("area_id", *at).agg(F.min("value").alias("value"))
    sampled = cells.groupBy("area_id").agg(F.avg("value").alias("mean"), F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"), F.count(F.lit(1)).alias("n"))
    return local.withColumn("origin", F.lit("overlay")).unionByName(sampled.withColumn("origin", F.lit("samples")))


def point_ratings(points: DataFrame, units: DataFrame, ratings: DataFrame, cell: float = 0.05) -> DataFrame:
    """id, mean of the ratings, by percent, of the map unit that holds each point (id, x, y)."""
    polygons = _shaped(units).select("mukey", "polygon", "xmin", "ymin", "xmax", "ymax")
    met = spatial.points_in_polygons(points, polygons, cell).join(ratings, "mukey")
    return relational.weighted_means(met.withColumn("percent", F.coalesce("percent", F.lit(100))), "id", "rating", "percent")


# --- auctions


def county_key(county: Column) -> Column:
    return F.regexp_replace(F.btrim(county), " County$", "")


def _place(lat: Column, lon: Column, method: str, confidence) -> Column:
    """A place of one method, null if it has no coordinates."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")))


def _candidates(auctions: DataFrame, addresses: DataFrame, legal: DataFrame, centroids: DataFrame) -> DataFrame:
    """Auctions with ``first``, ``second`` (the two geocoders' places of their address), ``described`` and ``county_place``; the tables have one row a key."""
    a = addresses.select(F.col("address").alias("__a"), F.struct(*[c for c in addresses.columns if c != "address"]).alias("__address"))
    b = legal.select(F.col("id").alias("__b"), F.struct(*[c for c in legal.columns if c != "id"]).alias("__legal"))
    c = centroids.select(F.col("county").alias("__c"), F.struct("lat", "lon").alias("__centroid"))
    return auctions.join(a, F.col("address") == F.col("__a"), "left").join(b, F.col("id") == F.col("__b"), "left").join(c, county_key(F.col("county")) == F.col("__c"), "left")


def _located(met: DataFrame, columns: list[str], *places: Column) -> DataFrame:
    best = met.withColumn("__s", F.coalesce(*places))
    return best.select(*columns, F.col("__s.lat").alias("latitude"), F.col("__s.lon").alias("longitude"), F.col("__s.method").alias("method"), F.col("__s.confidence").alias("confidence"))


def geocoded(auctions: DataFrame, addresses: DataFrame, legal: DataFrame, centroids: DataFrame) -> DataFrame:
    """Auctions (id, address, county, ...) with latitude, longitude, method, confidence of the first place they have:
    the first geocoder's (95), the second's (90), that of their legal description if a section was found (80) or a
    township (60), their county's (50).  addresses: address, lat, lon, lat2, lon2; legal: id, lat, lon, level
    (section or township); centroids: county, lat, lon."""
    met = _candidates(auctions, addresses, legal, centroids)
    x, y, z = F.col("__address"), F.col("__legal"), F.col("__centroid")
    legal_place = F.when(y["level"] == "section", _place(y["lat"], y["lon"], "legal", 80)).otherwise(_place(y["lat"], y["lon"], "legal", 60))
    return _located(met, auctions.columns, _place(x["lat"], x["lon"], "address", 95), _place(x["lat2"], x["lon2"], "address_2", 90), legal_place, _place(z["lat"], z["lon"], "centroid", 50))


def geocoded_farmland(auctions: DataFrame, addresses: DataFrame, legal: DataFrame, centroids: DataFrame, state: str = "iowa") -> DataFrame:
    """The other order, for farmland: the legal description (if the county is known), then the first and the second
    geocoder's place if it is in the state (``inside`` and ``inside2`` of addresses, as ``near_parcels`` tells), then
    the county's if the auction is in the state; confidence is a word."""
    met = _candidates(auctions, addresses, legal, centroids)
    x, y, z = F.col("__address"), F.col("__legal"), F.col("__centroid")
    return _located(
        met, auctions.columns,
        F.when(F.col("county").isNotNull(), _place(y["lat"], y["lon"], "legal", "high")),
        F.when(x["inside"], _place(x["lat"], x["lon"], "address", "high")),
        F.when(x["inside2"], _place(x["lat2"], x["lon2"], "address_2", "medium")),
        F.when(F.lower("state") == state, _place(z["lat"], z["lon"], "centroid", "low")),
    )


def near_parcels(places: DataFrame, parcels: DataFrame, metres: float = 50_000) -> DataFrame:
    """key of the places (key, lon, lat) at most ``metres`` from the middle of some parcel's box."""
    middles = parcels.filter("xmin IS NOT NULL").select(F.col("id").alias("parcel"), ((F.col("xmin") + F.col("xmax")) / 2).alias("plon"), ((F.col("ymin") + F.col("ymax")) / 2).alias("plat"))
    return spatial.nearest(places, middles, "key", "parcel", most_metres=metres).select("key")


def saved(stored: DataFrame, scraped: DataFrame, as_of: Column) -> DataFrame:
    """The auction table (url, title, description, status, auction_date, needs_review) after scraped rows
    (url, title, description, sold_status, date_texts) are put in by url; titles of stored rows stay."""
    read = F.get(F.filter(F.transform("date_texts", listings.parse_date), lambda d: d.isNotNull()), 0)
    told = F.coalesce(read, listings.extract_date(F.concat_ws(" ", "title", "description"), as_of))
    # of rows with one url the last by title stands
    last = Window.partitionBy("url").orderBy(F.col("title").desc_nulls_last())
    one = scraped.withColumn("__n", F.row_number().over(last)).filter("__n = 1")
    new = one.select("url", "title", "description", listings.listing_status(F.col("sold_status"), F.col("title"), F.col("description")).alias("status"), told.alias("auction_date"), told.isNull().alias("needs_review"))
    return relational.upsert(stored, new, "url", ["description", "status", "auction_date", "needs_review"])


def placed_auctions(stored: DataFrame, scraped: DataFrame, as_of: Column, addresses: DataFrame, centroids: DataFrame, counties: DataFrame, state: str = "Iowa") -> DataFrame:
    """``saved`` with county, latitude, longitude, county_level.  Scraped rows also have address, county and state.

    addresses (address, lat, lon, county, state: those of the coordinates) come first; the county is the
    listing's, also where that of the coordinates is another, or else theirs.  Without coordinates the
    county's centroid stands (centroids: county, lat, lon; in ``state`` only), then what a search for the
    county found (counties: county, state, lat, lon).  Rows whose url is not scraped anew have no places here.
    """
    last = Window.partitionBy("url").orderBy(F.col("title").desc_nulls_last())
    one = scraped.withColumn("__n", F.row_number().over(last)).filter("__n = 1").select("url", "address", F.col("county").alias("told"), F.col("state").alias("told_state"))
    a = addresses.select("address", F.struct("lat", "lon").alias("__at"), F.col("county").alias("__actual"), F.col("state").alias("__state"))
    met = one.join(a, "address", "left").select("url", "__at", F.coalesce("told", "__actual").alias("county"), F.coalesce("__state", "told_state").alias("state"))
    met = met.withColumn("key", county_key(F.col("county")))
    met = met.join(centroids.select(F.col("county").alias("key"), F.struct("lat", "lon").alias("__centre")), "key", "left")
    met = met.join(counties.select(F.col("county").alias("key"), "state", F.struct("lat", "lon").alias("__search")), ["key", "state"], "left")
    place = F.coalesce("__at", F.when(F.col("state") == state, F.col("__centre")), "__search")
    located = met.select("url", "county", "state", place["lat"].alias("latitude"), place["lon"].alias("longitude"), (F.col("__at").isNull() & place.isNotNull()).alias("county_level"))
    return saved(stored, scraped, as_of).join(located, "url", "left")


def county_mismatches(auctions: DataFrame, places: DataFrame) -> DataFrame:
    """id, county, actual: auctions whose county is not that of their coordinates (id, county)."""
    actual = places.select(F.col("id"), F.col("county").alias("actual"))
    return auctions.join(actual, "id").filter(F.lower(county_key(F.col("county"))) != F.lower(county_key(F.col("actual")))).select("id", "county", "actual")


def counties_fixed(auctions: DataFrame, places: DataFrame) -> DataFrame:
    """Auctions with the county of their coordinates where it is another than their own: here coordinates win."""
    wrong = county_mismatches(auctions.filter("latitude IS NOT NULL AND longitude IS NOT NULL"), places).select("id", F.col("actual").alias("__actual"))
    return auctions.join(wrong, "id", "left").withColumn("county", F.coalesce("__actual", "county")).select(*auctions.columns)


def backfilled(auctions: DataFrame, centroids: DataFrame, state: str = "Iowa") -> DataFrame:
    """Auctions of a state without coordinates get those of their county, and ``raw_data`` (JSON) says so."""
    c = centroids.select(F.col("county").alias("__c"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    met = auctions.join(c, county_key(F.col("county")) == F.col("__c"), "left")
    fill = (F.col("latitude").isNull() | F.col("longitude").isNull()) & (F.col("state") == state) & F.col("__c").isNotNull()
    raw = F.coalesce(F.from_json("raw_data", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    told = F.to_json(F.map_concat(F.map_filter(raw, lambda k, _: ~k.isin("isCountyLevel", "geocodingMethod")), F.create_map(F.lit("isCountyLevel"), F.lit("true"), F.lit("geocodingMethod"), F.lit("county-centroid"))))
    new = {"latitude": F.col("__lat"), "longitude": F.col("__lon"), "raw_data": told}
    return met.select(*[F.when(fill, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in auctions.columns])


def investigated(auctions: DataFrame, centroids: DataFrame) -> DataFrame:
    """source, total, with_place, without_place, fixable (no coordinates, but a county that has some)."""
    c = centroids.select(F.col("county").alias("__c")).distinct()
    met = auctions.join(c, county_key(F.col("county")) == F.col("__c"), "left")
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return met.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("with_place"), F.count_if(~has).alias("without_place"), F.count_if(~has & F.col("__c").isNotNull()).alias("fixable"))


#: Criteria of an auction list that have no effect where an auction lacks the value.
LENIENT = {"csr2": "csr2_mean", "value": "estimated_value"}


def auction_list(auctions: DataFrame, box: tuple[float, float, float, float], criteria: dict, as_of: Column, without_place: bool = False) -> DataFrame:
    """Active auctions in a box (south, north, west, east) by date: criteria min_acreage, max_acreage, min_csr2,
    max_csr2, min_value, max_value, days (from ``as_of``), land_types, counties; None is no criterion."""
    c = {k: v for k, v in criteria.items() if v is not None}
    kept = relational.matching(auctions.filter("status = 'active'"), {"min_acreage": c.get("min_acreage"), "max_acreage": c.get("max_acreage"), "land_type_in": c.get("land_types"), "county_in": c.get("counties")})
    if "days" in c:
        kept = kept.filter(F.col("auction_date") <= as_of + F.make_interval(days=F.lit(c["days"])))
    for name, column in LENIENT.items():
        kept = kept.filter(relational.passes_if_missing(F.col(column), c.get(f"min_{name}"), c.get(f"max_{name}")))
    return kept.filter(relational.in_box(F.col("latitude"), F.col("longitude"), *box, without_place))


def auction_page(listed: DataFrame, size: int = 200, offset: int = 0) -> DataFrame:
    return relational.page(listed, [F.col("auction_date").asc_nulls_last(), F.col("id")], size, 200, offset)


def auction_count(listed: DataFrame) -> DataFrame:
    """n, with_place of a list before any page is cut from it."""
    return listed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("with_place"))


def coverage_audit(discovered: DataFrame, stored: DataFrame) -> DataFrame:
    """source, discovered, stored, missing, stale, coverage from distinct (source, url) of both."""
    d, s = discovered.select("source", "url").distinct().withColumn("d", F.lit(1)), stored.select("source", "url").distinct().withColumn("s", F.lit(1))
    both = d.join(s, ["source", "url"], "full_outer")
    n = lambda cond, name: F.count_if(cond).alias(name)
    met = both.groupBy("source").agg(n(F.col("d").isNotNull(), "discovered"), n(F.col("s").isNotNull(), "stored"), n(F.col("s").isNull(), "missing"), n(F.col("d").isNull(), "stale"))
    return met.withColumn("coverage", relational.percent(F.col("discovered") - F.col("missing"), F.col("discovered")))


# --- valuations


def request_rules() -> dict[str, Column]:
    """What a valuation request must be like, by message."""
    x = F.col
    return {
        "County is required": F.length("county") >= 1,
        "State is required": F.length("state") >= 1,
        "Land type must be known": x("land_type").isin("Irrigated", "Dryland", "Pasture", "CRP"),
        "Acreage must be greater than 0": x("acreage") >= 0.1,
        "Tillable acres must be non-negative": x("tillable_acres").isNull() | (x("tillable_acres") >= 0),
        "Tillable acres cannot exceed total acres": x("tillable_acres").isNull() | (x("tillable_acres") <= x("acreage")),
        "Cash rent must be between 0 and 1000": x("cash_rent").isNull() | x("cash_rent").between(0, 1000),
        "Cap rate must be between 1% and 20%": x("cap_rate").isNull() | x("cap_rate").between(0.01, 0.2),
        "Non-tillable type must be known": x("non_tillable").isNull() | x("non_tillable").isin("CRP", "Timber", "Other"),
    }


def valid_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid valuation requests, the others with their errors)"""
    return relational.validated(requests, request_rules())


def auction_values(auctions: DataFrame, units: DataFrame, ratings: DataFrame, samples: DataFrame, metres: float = 500) -> DataFrame:
    """id, csr2_mean, csr2_low, csr2_high, estimated_value (an acre), estimated_total of auctions (id, latitude, longitude, acreage) by the ratings in a circle."""
    areas = circle_requests(auctions.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat")), metres)
    found = area_ratings(areas, units, ratings, samples)
    value = F.col("mean") * values.DOLLARS_PER_POINT
    valued = found.filter("mean > 0").select(F.col("area_id").alias("id"), F.col("mean").alias("csr2_mean"), F.col("low").alias("csr2_low"), F.col("high").alias("csr2_high"), value.alias("estimated_value"))
    return valued.join(auctions.select("id", "acreage"), "id").withColumn("estimated_total", F.when(F.col("acreage") != 0, F.col("estimated_value") * F.col("acreage"))).drop("acreage")



def valuations(requests: DataFrame, market: DataFrame) -> DataFrame:
    """Values of requests (id, land_type, acreage, tillable_acres, cash_rent, cap_rate, rating, non_tillable,
    improvements array<struct<type, method, manual>>) with market rows (id, base, reasoned, adjustment, comps array<double>)."""
    met = requests.join(market, "id", "left").withColumn("base", F.coalesce("base", values.lookup(F.col("land_type"), values.LAND_PRICES, values.LAND_PRICE).cast("double")))
    total = F.coalesce(values.improvements_total(F.col("improvements")), F.lit(0.0))
    reasoned = values.gated(F.col("reasoned"), F.col("base"))
    return met.select(
        "id", "base", values.income_value(values.missing_zero(F.col("cash_rent"), None), F.col("cap_rate")).alias("income_value"),
        F.when(F.col("rating") > 0, F.col("rating") * values.DOLLARS_PER_POINT).alias("rating_value"), values.rating_label(F.col("rating")).alias("rating_label"),
        values.blended(F.col("acreage"), F.coalesce(values.missing_zero(F.col("tillable_acres"), None), F.col("acreage")), F.col("rating"), F.col("base"), F.col("non_tillable")).alias("blended"),
        total.alias("improvements"), values.comps(F.coalesce("comps", F.array().cast("array<double>"))).alias("comps"),
        values.final_value(reasoned, F.col("adjustment"), F.col("acreage"), total).alias("final"),
    )


def circle_requests(places: DataFrame, metres: float = 500) -> DataFrame:
    """Areas (area_id, ring, box) of circles around places (id, lon, lat)."""
    ring = places.select(F.col("id").alias("area_id"), geo.circle(F.col("lon"), F.col("lat"), metres).alias("ring"))
    return ring.withColumn("e", geo.envelope(F.col("ring"))).select("area_id", "ring", "e.*")
