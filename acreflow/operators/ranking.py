"""Places of rows in the order of their group, where a few groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, materialize


def ranks(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place, from 1, in their group by ``order``; an empty ``by`` is one group of all.

    Rows are range-partitioned by group and order, so a large group is cut over
    many tasks, sorted and numbered along each partition.  One row for each group
    of a partition tells how many rows of the group lie in the partitions before.
    """
    columns = rows.columns
    keys = [F.col(c) for c in by]
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = materialize(ranged.withColumns({"__part": F.spark_partition_id(), "__seq": F.monotonically_increasing_id()}))
    ends = numbered.groupBy("__part", *by).agg(F.min("__seq").alias("__least"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(ends.select(F.col("__part").alias("__of"), *[F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)], "__least", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")))
    same = F.col("__part") == F.col("__of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__of_{i}"))
    met = numbered.join(broadcast_if_small(before), same)
    return met.select(*columns, (F.col("__before") + F.col("__seq") - F.col("__least") + 1).alias(name))
