"""Tiles of polygons with holes and several parts, decoded; pyramids; the rule by zoom."""

from pyspark.sql import functions as F

from acreflow.functions import geo
from acreflow.operators import tiles
from acreflow.plans import products

from .test_geometry import decode, numbers

BOX = "xmin double, ymin double, xmax double, ymax double"


def ring(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def drawn(mvt):
    """layer name -> {id: (signed areas of its rings, properties)}; clockwise as seen is positive."""
    found = {}
    for _, layer in decode(mvt):
        fields = decode(layer)
        of = lambda k: [v for n, v in fields if n == k]
        keys, values = [k.decode() for k in of(3)], [v for (v,) in map(decode, of(4))]
        rows = {}
        for feature in of(2):
            parts = dict(decode(feature))
            moves, i, x, y, areas, points = numbers(parts[4]), 0, 0, 0, [], []
            while i < len(moves):
                kind, n = moves[i] & 7, moves[i] >> 3
                i += 1
                if kind == 7:
                    areas.append(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2)
                    continue
                points = [] if kind == 1 else points
                for _ in range(n):
                    x, y = x + ((moves[i] >> 1) ^ -(moves[i] & 1)), y + ((moves[i + 1] >> 1) ^ -(moves[i + 1] & 1))
                    points.append((x, y))
                    i += 2
            tags = numbers(parts[2])
            rows[parts[1]] = (areas, {keys[a]: values[b][1] for a, b in zip(tags[::2], tags[1::2], strict=True)})
        found[of(1)[0].decode()] = rows
    return found


def test_holes_and_further_polygons(spark):
    unit = 2 * geo.WORLD / 2**10 / 4096
    at = lambda *v: ring(*[x * unit for x in v])
    shape = [[at(10, 10, 110, 110), at(20, 20, 60, 60)[::-1], at(70, 70, 70.2, 70.2)], [at(200, 10, 260, 50)[::-1]], [at(300, 300, 300.1, 300.1), at(300, 300, 300.05, 300.05)]]
    d = spark.createDataFrame([(1, shape, 10 * unit, 10 * unit, 400 * unit, 400 * unit)], f"id long, polygons array<array<{geo.RING}>>, {BOX}")
    (r,) = tiles.tiles(d, 10, "l", "id", []).collect()
    assert drawn(r.mvt)["l"][1][0] == [100 * 100, -40 * 40, 60 * 40]
    # on the border between tiles each has its part; a hole is cut with its outside
    wide = spark.createDataFrame([(1, [[at(-2000, 10, 2000, 2010), at(-1000, 510, 1000, 1510)]], -2000 * unit, 10 * unit, 2000 * unit, 2010 * unit)], f"id long, polygons array<array<{geo.RING}>>, {BOX}")
    got = {t.x: drawn(t.mvt)["l"][1][0] for t in tiles.tiles(wide, 10, "l", "id", []).collect()}
    assert got == {x: [(2000 + 256) * 2000, -(1000 + 256) * 1000] for x in (511, 512)}


def test_odd_features(spark):
    kind = f"id long, name string, polygons array<array<{geo.RING}>>, {BOX}"
    rows = [(1, None, None, 0.0, 0.0, 1e6, 1e6), (2, "b", [], 0.0, 0.0, 1e6, 1e6), (3, "c", [[ring(0, 0, 1e6, 1e6)]], None, None, None, None), (4, "d", [[]], 0.0, 0.0, 1e6, 1e6), (5, None, [[ring(0, 0, 1e6, 1e6)]] * 2, 0.0, 0.0, 1e6, 1e6)]
    d = spark.createDataFrame(rows, kind).withColumns({c: F.lit("q") for c in ("z", "x", "y", "moves", "shape", "p_id")})
    assert {i for t in tiles.tiles(d, 4, "l", "id", ["name"]).collect() for i in drawn(t.mvt)["l"]} == {5}
    assert tiles.tiles(d.limit(0), 4, "l", "id", ["name"]).count() == 0


def test_pyramid_equals_single_zooms(spark):
    point = lambda i, r: F.struct((r * F.cos(i / 60 * 6.283185307179586)).alias("x"), (r * F.sin(i / 60 * 6.283185307179586)).alias("y"))
    d = spark.range(12).select("id", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: point(i, (F.col("id") + 1) * 700.0)).alias("ring")).withColumn("e", geo.envelope(F.col("ring"))).select("id", "ring", "e.*")
    d = d.withColumn("polygon", F.array("ring"))
    whole = {(r.z, r.x, r.y): (r.n, bytes(r.mvt)) for r in tiles.pyramid(d, [9, 10, 12, 13], "l", "id", ["id"]).collect()}
    single = {(r.z, r.x, r.y): (r.n, bytes(r.mvt)) for z in (9, 10, 12, 13) for r in tiles.tiles(d, z, "l", "id", ["id"]).collect()}
    assert whole == single and {z for z, *_ in whole} == {9, 10, 12, 13}


def test_clusters_up_to_fourteen_and_parcels_beyond(spark):
    kind = f"id long, deed_holder string, county string, parcel_number string, parcel_class string, area_sqm double, polygon array<{geo.RING}>"
    lot = lambda i: [ring(-93 + 0.001 * i, 41, -93 + 0.001 * (i + 1), 41.001)]
    rows = [(1, "Smith, John", "ADAIR", "n1", "A", 4046.86, lot(0)), (2, "Smith, John", "ADAIR", "n2", "A", 8093.72, lot(1)), (3, "Lee", "ADAIR", "n3", "R", 4046.86, lot(2)), (4, "Lee", "HARRISON", "n4", "R", 4046.86, lot(3)), (5, "Lee", "HARRISON", "n5", "R", 4046.86, lot(4))]
    parcels = products.with_owner(spark.createDataFrame(rows, kind)).withColumn("e", geo.envelope(F.get("polygon", 0))).select("*", "e.*").drop("e")
    clusters = products.county_clusters(parcels, skip=())
    assert clusters.count() == 2
    found = products.parcel_tiles(parcels, clusters, [13, 14, 15]).collect()
    seen = {}
    for t in found:
        for name, features in drawn(t.mvt).items():
            seen.setdefault((t.z, name), {}).update({i: p for i, (_, p) in features.items()})
    assert seen.keys() == {(13, "ownership"), (14, "ownership"), (15, "parcels")}
    assert seen[14, "ownership"].keys() == {1} and seen[15, "parcels"].keys() == {1, 2, 3}
    assert seen[14, "ownership"][1]["owner"] == b"JOHN SMITH" and seen[14, "ownership"][1]["county"] == b"ADAIR" and seen[14, "ownership"][1]["parcel_count"] == 4
    assert seen[15, "parcels"][2]["owner"] == b"Smith, John" and seen[15, "parcels"][2]["owner_norm"] == b"JOHN SMITH" and seen[15, "parcels"][2]["class"] == b"A"


def test_long_outline_in_time():
    import time

    line = [(i * 10.0, 50.0 * (i % 2)) for i in range(20_000)]
    began = time.time()
    assert len(tiles.simplified(line, 10)) > 19_000
    assert time.time() - began < 10
