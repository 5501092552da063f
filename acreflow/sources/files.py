"""Sources of land data: run logs, GeoJSON, landed REST pages."""

from __future__ import annotations

import json
import time
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from acreflow.functions import geo
from acreflow.operators.tiles import simplified

RUN_LOG = "scrapeId string, sourceName string, discoveredUrls int, processedUrls int, successfulSaves int, failedScrapes int, failedSaves int, iowaDiscovered int, iowaSaved int, duration bigint, timestamp timestamp, missingUrls array<string>"
_POINTS = "array<array<array<double>>>"


def run_log(spark: SparkSession, path: str, schema: str = RUN_LOG) -> DataFrame:
    """A log with a JSON object a line; lines that aren't are left out."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(parsed.alias("r")).filter("r._bad IS NULL").select("r.*").drop("_bad")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A row for each feature: its properties, ``polygons`` (those of a Polygon or MultiPolygon, else null), the first as ``polygon``, and the box of all."""
    schema = f"features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:struct<{properties}>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    points = F.when(kind == "Polygon", F.array(F.from_json(text, _POINTS))).when(kind == "MultiPolygon", F.from_json(text, f"array<{_POINTS}>"))
    shaped = F.transform(points, lambda polygon: F.transform(polygon, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    found = rows.select("f.properties.*", shaped.alias("polygons")).withColumn("polygon", F.get("polygons", 0))
    return found.withColumn("e", geo.envelope(F.flatten(F.transform("polygons", lambda p: F.get(p, 0))))).select("*", "e.*").drop("e")


def write_features(rows: DataFrame, path: str, by: str, geometry: str = "polygon") -> None:
    """A feature a line, in a folder for each value of ``by``."""
    properties = {c: F.col(c) for c in rows.columns if c != geometry}
    rows.select(F.col(by), geo.feature(F.col(geometry), **properties).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def slug(name):
    """A file name's part: lower case, spaces as hyphens."""
    return F.regexp_replace(F.lower(name), r"\s+", "-")


def write_county_features(rows: DataFrame, path: str, county: str = "county", ring: str = "ring", tolerance: float = 1e-4) -> None:
    """A feature a line, simplified, in a folder ``slug=...`` for each county."""
    simple = rows.withColumn("polygon", F.array(simplified_ring(ring, F.lit(tolerance)))).drop(ring)
    properties = {c: F.col(c) for c in simple.columns if c != "polygon"}
    simple.select(slug(F.col(county)).alias("slug"), geo.feature(F.col("polygon"), **properties).alias("value")).write.mode("overwrite").partitionBy("slug").text(path)


def write_top_owners(groups: DataFrame, polygons: DataFrame, path: str, most: int = 1000) -> None:
    """The ``most`` owners with the most parcels (owner, parcel_count, total_acres), a feature for each of their polygons (owner, polygon)."""
    top = groups.select("owner", "parcel_count", "total_acres").orderBy(F.desc("parcel_count"), "owner").limit(most)
    rows = polygons.join(top, "owner")
    rows.select(geo.feature(F.col("polygon"), owner=F.col("owner"), parcels=F.col("parcel_count"), acres=F.col("total_acres")).alias("value")).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report with one JSON object a line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def rebuild(rows: DataFrame, table: str) -> None:
    """A table that only holds what it is rebuilt from now."""
    rows.write.mode("overwrite").format("parquet").saveAsTable(table)


def catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """table, column, type, nullable, partition of the tables of a database: its metadata, which the driver holds."""
    database = database or spark.catalog.currentDatabase()
    rows = [(t.name, c.name, c.dataType, c.nullable, c.isPartition) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{database}.{t.name}")]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, partition boolean")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def simplified_ring(ring: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Rings with fewer points, which stay rings: of four points at least and without crossings, else with a lesser tolerance."""
    return pd.Series([[{"x": x, "y": y} for x, y in _simple([(p["x"], p["y"]) for p in r], t)] if r is not None else None for r, t in zip(ring, tolerance, strict=True)])


def _simple(points: list, tolerance: float) -> list:
    for _ in range(8):
        out = simplified(points, tolerance)
        if len(out) > 3 and not _crosses(out):
            return out
        tolerance /= 2
    return points


def _crosses(ring: list) -> bool:
    """Whether two edges of a ring cross; edges are swept by their least x."""
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    edges = sorted((min(a, b), max(a, b)) for a, b in zip(ring[:-1], ring[1:], strict=True))
    for i, (a, b) in enumerate(edges):
        for c, d in edges[i + 1 :]:
            if c[0] > b[0]:
                break
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def polygons_of_rings(rings):
    """Rings as polygons: clockwise ones are outsides, the others holes of the outside before them."""
    def add(done, ring):
        outside = geo.ring_area(ring) < 0
        last = F.element_at(done, -1)
        rest = F.slice(done, F.lit(1), F.size(done) - 1)
        return F.when(outside | (F.size(done) == 0), F.concat(done, F.array(F.array(ring)))).otherwise(F.concat(rest, F.array(F.concat(last, F.array(ring)))))

    return F.aggregate(rings, F.array().cast("array<array<array<struct<x:double,y:double>>>>"), add)


def _fetched(url: str, options: dict) -> dict:
    """The JSON at an address, tried again after a while."""
    retries, delay, timeout = int(options.get("retries", "3")), float(options.get("delay", "5")), float(options.get("timeout", "60"))
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as got:
                return json.load(got)
        except OSError:
            if attempt == retries:
                raise
            time.sleep(delay)
    raise AssertionError


class _Page(InputPartition):
    def __init__(self, offset: int) -> None:
        self.offset = offset


class _PageReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.options, self.names, self.size = options, names, int(options.get("page", "2000"))

    def _total(self) -> int:
        if "total" in self.options:
            return int(self.options["total"])
        return int(_fetched(self.options["count_url"], self.options)["count"])

    def partitions(self):
        first = int(self.options.get("first", "0"))
        last = min(self._total(), int(self.options.get("last", str(1 << 62))))
        return [_Page(i) for i in range(first, last, self.size)] or [_Page(-1)]

    def read(self, partition: _Page):
        if partition.offset < 0:
            return
        page = _fetched(self.options["url"].replace("{offset}", str(partition.offset)).replace("{size}", str(self.size)), self.options)
        for feature in page["features"]:
            values = feature.get("attributes") or feature.get("properties") or {}
            yield tuple(json.dumps(feature.get("geometry")) if n == "geometry" else None if values.get(n) is None else str(values[n]) for n in self.names)


class PagedFeatures(DataSource):
    """Features of a paged service, a partition for each page.

    Options: url (with {offset} and {size}), count_url (whose ``count`` is the
    number of features, asked when a read is planned) or total, page, fields
    (comma-separated), first and last (offsets to begin and end at), retries,
    delay, timeout.  All columns are strings; geometry is JSON.  Register with
    ``spark.dataSource.register(PagedFeatures)``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n in self.options["fields"].split(","))

    def reader(self, schema):
        return _PageReader(dict(self.options), schema.fieldNames())


def load_pages(spark: SparkSession, path: str, options: dict, pages: int = 100) -> int:
    """Load a paged service into a table of parts, ``pages`` pages each; parts that are there already are not asked
    for again, so a load that broke off goes on where it was.  Gives the number of parts that were loaded now."""
    size = int(options.get("page", "2000"))
    total = int(options["total"]) if "total" in options else int(_fetched(options["count_url"], options)["count"])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    loaded = 0
    for first in range(0, total, size * pages):
        part = hadoop(f"{path}/first={first}")
        if part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(part, "_SUCCESS")):
            continue
        read = spark.read.format("paged_features").options(**options | {"total": str(total), "first": str(first), "last": str(first + size * pages)}).load()
        read.write.mode("overwrite").parquet(f"{path}/first={first}")
        loaded += 1
    return loaded
