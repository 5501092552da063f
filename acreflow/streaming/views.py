"""Aggregate views that are kept up by changes instead of being computed anew.

A change is a row with ``sign``: 1 for a row that came, -1 for one that went; an
update is both.  A view holds counts and sums by key, so a batch of changes is
summed by key and added to what stands there.  The table lies in buckets by the
key's hash; a batch reads and writes only the buckets that it touches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.operators.storage import materialize

_SUM = "decimal(38,9)"


def signed(rows: DataFrame, sign: int = 1) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign))


def join_changes(a_before: DataFrame, a_changes: DataFrame, b_before: DataFrame, b_changes: DataFrame, on: list[str]) -> DataFrame:
    """The changes of ``a JOIN b`` from those of both sides: changed rows of each side meet the other side as it was, and each other.

    What only changed on one side never makes the other side move whole against
    itself: three joins, each with a side as small as the changes.
    """
    names = list(dict.fromkeys([*a_before.columns, *b_before.columns]))
    both = lambda a, b: a.join(b.withColumnRenamed("sign", "__other"), on).withColumn("sign", F.col("sign") * F.col("__other")).select(*names, "sign")
    return reduce(DataFrame.union, [both(a_changes, signed(b_before)), both(signed(a_before), b_changes), both(a_changes, b_changes)])


def view_batches(path: str, keys: list[str], sums: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch of changes (keys, sums, sign) to the view at ``path``.

    Sums are exact decimals, so what goes takes away just what came.  A bucket
    remembers the last batch that it has taken, and a batch that runs again is
    not added twice; keys without rows stay as empty ones for that, and
    ``read_view`` leaves them out.
    """

    def put(changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        value = lambda c: F.coalesce(F.col(c).cast(_SUM), F.lit(0).cast(_SUM))
        told = lambda c: F.when(F.col(c).isNotNull(), F.col("sign")).otherwise(0)
        added = changes.groupBy(*keys).agg(F.sum(F.col("sign").cast("long")).alias("n"), *[F.sum(value(c) * F.col("sign")).cast(_SUM).alias(f"sum_{c}") for c in sums], *[F.sum(told(c).cast("long")).alias(f"n_{c}") for c in sums])
        added = materialize(added.withColumn("bucket", bucket))
        touched = [r[0] for r in added.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        numbers = ["n", *[f"sum_{c}" for c in sums], *[f"n_{c}" for c in sums]]
        try:
            old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        except AnalysisException:
            old = added.limit(0).withColumn("batch", F.lit(0).cast("long"))
        old = old.select(*keys, *numbers, "batch", "bucket")
        done = [r[0] for r in old.groupBy("bucket").agg(F.max("batch").alias("b")).filter(F.col("b") >= batch_id).select("bucket").collect()]
        new = added.filter(~F.col("bucket").isin(done)).withColumn("batch", F.lit(batch_id).cast("long"))
        whole = old.filter(~F.col("bucket").isin(done)).unionByName(new).groupBy(*keys, "bucket").agg(*[F.sum(c).cast(dict(added.dtypes)[c]).alias(c) for c in numbers])
        after = materialize(whole.withColumn("batch", F.lit(batch_id).cast("long")))
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return put


def read_view(spark: SparkSession, path: str, keys: list[str], sums: list[str]) -> DataFrame:
    """keys, n, and sum and mean of each summed column, of the keys that have rows; nulls count in neither, as in SQL."""
    found = spark.read.parquet(path).filter("n > 0")
    sum_of = lambda c: F.when(F.col(f"n_{c}") > 0, F.col(f"sum_{c}").cast("double"))
    return found.select(*keys, "n", *[x for c in sums for x in (sum_of(c).alias(f"sum_{c}"), (sum_of(c) / F.nullif(F.col(f"n_{c}"), F.lit(0))).alias(f"mean_{c}"))])
