"""Tables laid out in space, so that a read of a box opens few files and few row groups.

Rows are keyed by the place of their box's middle on a Hilbert curve over a fixed
extent, range-partitioned by that key (and by a hash, so that one crowded place
is cut over many files) and sorted.  Each file then covers a small area, and its
row groups smaller ones.  An index beside the files holds one row a file: its
box and rows.  A read first picks the files whose box meets the wanted one, then
pushes the comparisons of the box columns into the scan, which skips row groups
by their least and greatest values.

Boxes outside the extent count as at its edge; rows without a box lie in the
first file and are found by no box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps of the curve: cells of 360 degrees / 2 ** 20, about 40 metres.
ORDER = 20
WORLD_BOX = (-180.0, -90.0, 180.0, 90.0)
BOX = ("xmin", "ymin", "xmax", "ymax")
_INDEX = "_boxes"


def hilbert(x: Column, y: Column, order: int = ORDER) -> Column:
    """The place of a cell (x, y under 2 ** order) on the Hilbert curve."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(at: Column, i: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(order) - 1 - i)
        right, upper = at["x"].bitwiseAND(side) > 0, at["y"].bitwiseAND(side) > 0
        quarter = F.when(right, F.when(upper, 2).otherwise(3)).otherwise(F.when(upper, 1).otherwise(0))
        x, y = at["x"].bitwiseAND(side - 1), at["y"].bitwiseAND(side - 1)
        # the lower quarters are turned: swapped, and on the right mirrored too
        across = F.when(upper, x).when(right, side - 1 - y).otherwise(y)
        up = F.when(upper, y).when(right, side - 1 - x).otherwise(x)
        return F.struct(across.alias("x"), up.alias("y"), (at["d"] + quarter * side * side).alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), start, step)["d"]


def place(extent: tuple[float, float, float, float] = WORLD_BOX, order: int = ORDER) -> Column:
    """The place on the curve of the middle of a row's box."""
    west, south, east, north = extent
    cells = 2**order

    def cell(lo: str, hi: str, least: float, most: float) -> Column:
        share = ((F.col(lo) + F.col(hi)) / 2 - least) / (most - least)
        return F.least(F.greatest(F.floor(share * cells), F.lit(0)), F.lit(cells - 1))

    return F.when(F.col("xmin").isNotNull() & F.col("ymin").isNotNull(), hilbert(cell("xmin", "xmax", west, east), cell("ymin", "ymax", south, north), order))


def write_spatial(rows: DataFrame, path: str, files: int, extent: tuple[float, float, float, float] = WORLD_BOX, group_rows: int = 100_000) -> None:
    """Write rows with a box (xmin, ymin, xmax, ymax) in about ``files`` files along the curve, and the index of their boxes."""
    spark = rows.sparkSession
    key = place(extent)
    spread = F.xxhash64(*BOX, *[c for c in rows.columns if c not in BOX and rows.schema[c].dataType.simpleString() in ("bigint", "int", "string")])
    keyed = rows.withColumns({"__place": key, "__spread": spread}).repartitionByRange(files, "__place", "__spread").sortWithinPartitions("__place", "__spread").drop("__place", "__spread")
    keyed.write.option("parquet.block.row.count.limit", group_rows).parquet(path)
    laid = spark.read.schema(rows.schema).parquet(path)
    found = laid.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count(F.lit(1)).alias("n"))
    found.write.parquet(f"{path}/{_INDEX}")


def meets(west: float, south: float, east: float, north: float) -> Column:
    """Whether a row's box meets this one; edges count."""
    return (F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south)


def read_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """The rows of a table of ``write_spatial`` whose box meets this one.  Only the names of the files that may hold some reach the driver."""
    wanted = meets(west, south, east, north)
    names = [r.file for r in spark.read.parquet(f"{path}/{_INDEX}").filter(wanted).select("file").collect()]
    schema = spark.read.parquet(path).schema
    return spark.read.schema(schema).parquet(*names).filter(wanted) if names else spark.createDataFrame([], schema)


def read_tile(spark: SparkSession, path: str, z: int, x: int, y: int, world: float, buffer: float = 0.0) -> DataFrame:
    """The rows, boxes in web-mercator metres, that a tile needs; ``buffer`` is a share of its side, ``world`` half the side of the world."""
    side = 2 * world / 2**z
    west, north, more = x * side - world, world - y * side, buffer * side
    return read_box(spark, path, west - more, north - side - more, west + side + more, north + more)
