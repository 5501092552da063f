"""Sizes and statistics of tables, from the files that hold them and one pass over the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """table, file, bytes, rows of each file of tables read from files; only their metadata column and counts are read."""

    def one(name: str, rows: DataFrame) -> DataFrame:
        of = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return of.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "file", "bytes", "rows")

    return reduce(DataFrame.union, [one(n, d) for n, d in tables.items()])


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """table, files, bytes, rows, row_bytes (mean), largest table first."""
    sums = file_sizes(tables).groupBy("table").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return sums.withColumn("row_bytes", F.col("bytes") / F.nullif(F.col("rows"), F.lit(0))).orderBy(F.desc("bytes"), "table")


_FIXED = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def value_bytes(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value as it is, not compressed; 0 of null."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(F.transform(column, lambda x: value_bytes(x, kind.elementType).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    elif isinstance(kind, T.MapType):
        return value_bytes(F.map_keys(column), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(column), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [value_bytes(column[f.name], f.dataType) for f in kind], F.lit(0).cast("long"))
    else:
        size = F.when(column.isNotNull(), F.lit(_FIXED.get(type(kind), 8)))
    return F.coalesce(size.cast("long"), F.lit(0).cast("long"))


def column_stats(rows: DataFrame) -> DataFrame:
    """column, kind, n, nulls, distinct (from a sketch), least, most (as text; of kinds that have an order), bytes: one aggregate over the table, a row for each column."""
    parts = []
    for f in rows.schema:
        c = F.col(f"`{f.name}`")
        plain = not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)
        none = F.lit(None).cast("string")
        least, most = (F.min(c).cast("string"), F.max(c).cast("string")) if plain else (none, none)
        distinct = F.approx_count_distinct(c if plain else F.xxhash64(c) if not isinstance(f.dataType, T.MapType) else F.xxhash64(F.map_entries(c)))
        parts.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("nulls"), distinct.alias("distinct"), least.alias("least"), most.alias("most"), F.coalesce(F.sum(value_bytes(c, f.dataType)), F.lit(0).cast("long")).alias("bytes")))
    return rows.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def analyzed(spark, table: str) -> DataFrame:
    """column, n, nulls, distinct, least, most of a catalog table by its own statistics, which are computed and kept with it for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    names = [f.name for f in spark.table(table).schema]
    told = lambda c: dict(tuple(r) for r in spark.sql(f"DESCRIBE EXTENDED {table} `{c}`").collect())  # noqa: E731  # a few rows for each column, from the catalog
    number = lambda v: None if v in (None, "NULL") else int(v)
    rows = [(c, number(d.get("num_nulls")), number(d.get("distinct_count")), None if d.get("min") == "NULL" else d.get("min"), None if d.get("max") == "NULL" else d.get("max")) for c in names for d in [told(c)]]
    return spark.createDataFrame(rows, "column string, nulls long, distinct long, least string, most string")
