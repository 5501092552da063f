"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a share of a common budget by weight.  A target never passes
``max_epochs`` times the size of its source; what is over is shared again by
weight.  Which documents a source gives is decided by the hash of the
document's key: those under a threshold.  The threshold comes from nested
histograms: sizes summed by source and hash bucket, then only the bucket that
holds the budget's boundary is refined, so nothing is sorted and each level
moves one row per source, bucket and task.  The thresholds are one row per
source.

Defined results: a null text has size 0; null is a source of its own, last in
order; rows of a source with one key share one hash and are taken or left
together; where the rows of a last bucket tie, all of them are taken if that
comes nearer to the target; texts of any length count whole; an empty table
gives an empty table; sources without words get target 0 and are left.  Extra
columns, whatever their names, are ignored by ``mix`` and kept by
``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_BITS, LEVELS = 12, 3
WEIGHTS = (3, 1, 2)
BUDGET, MAX_EPOCHS = 1.5, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS) -> DataFrame:
    """source, source_size, target of a table of source and size.

    ``target = min(max_epochs * size, lam * weight)`` with one ``lam`` for all
    sources, which is where sharing the excess again by weight ends.  With the
    sources in order of cap over weight, the first k are full, and k is the
    least number for which the share of the next is not above its cap.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    weighted = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("double"))
    weighted = weighted.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    lam = (
        weighted.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("lam", (F.col("total") - F.col("full")) / F.sum("w").over(after))
        .withColumn("lam", F.when(F.col("lam") * F.col("w") <= F.col("cap"), F.col("lam")))
        .withColumn("lam", F.first("lam", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least("cap", F.coalesce(F.col("lam") * F.col("w"), F.col("cap")))
    return lam.select("source", "source_size", target.alias("target"))


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole (copies of every document) and
    under: documents whose hash is less give one copy more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("whole", whole.cast("long")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = materialize(state.withColumn("under", F.lit(0).cast("long")).withColumn("open", F.lit(True)))
    for level in range(1, LEVELS + 1):
        width = 1 << (BUCKET_BITS * (LEVELS - level))
        small = broadcast_if_small(state.filter("open").select(F.col("source").alias("s"), "under"))
        inside = sized.join(small, sized.source.eqNullSafe(small.s) & ((F.col("h") >= F.col("under")) & ((F.col("h") - F.col("under")) < width << BUCKET_BITS)))
        bucket = F.shiftright(F.col("h"), BUCKET_BITS * (LEVELS - level))
        sums = inside.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = (
            sums.withColumnRenamed("source", "s")
            .withColumn("cum", F.sum("n").over(run))
            .join(broadcast_if_small(state.select(F.col("source").alias("s2"), "left")), F.col("s").eqNullSafe(F.col("s2")))
            .filter(F.col("cum") > F.col("left"))
            .groupBy("s")
            .agg(F.min(F.struct("b", "cum", "n")).alias("edge"))
        )
        keep = F.col("edge.cum") - F.col("edge.n")
        state = state.join(over, state.source.eqNullSafe(over.s), "left").select(
            "source", "source_size", "target", "whole",
            F.when(F.col("edge").isNull(), F.col("left")).otherwise(F.col("left") - keep).alias("left"),
            # an open source whose budget lies beyond all its documents: everything is under
            F.when(F.col("edge").isNotNull(), F.col("edge.b") * width).otherwise(F.when(F.col("open"), F.lit(1 << 62)).otherwise(F.col("under"))).cast("long").alias("under"),
            (F.col("open") & F.col("edge").isNotNull()).alias("open"),
            F.col("edge.n").alias("n"),
        )
        if level == LEVELS:  # the last bucket goes in if that comes nearer to the target
            state = state.withColumn("under", F.when(F.col("open") & (F.col("left") * 2 > F.col("n")), F.col("under") + 1).otherwise(F.col("under")))
        state = materialize(state.drop("n"))
    return state


def _hashed(key: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 64 - BUCKET_BITS * LEVELS)


def _sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    return materialize(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), _hashed(F.col(key), seed).alias("h")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of ``docs``."""
    sized = _sized(docs, key, text, source, seed)
    state = broadcast_if_small(_thresholds(sized, source_targets(sized, weights, budget, max_epochs)).withColumnRenamed("source", "s"))
    copies = F.least(F.col("whole") + (F.col("h") < F.col("under")).cast("long"), F.lit(max_epochs))
    return sized.join(state, sized.source.eqNullSafe(state.s)).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """The rows that the mix takes, a row taken twice being there twice.

    A filter of the rows by their hash and their source's threshold: no text is
    shuffled, as long as the sources' table is small enough to be broadcast.
    """
    sized = _sized(docs, key, text, source, seed)
    s, whole, under, copy = fresh(docs, "of_source", "whole", "under", "copy")
    state = _thresholds(sized, source_targets(sized, weights, budget, max_epochs)).select(F.col("source").alias(s), F.col("whole").alias(whole), F.col("under").alias(under))
    copies = F.least(F.col(whole) + (_hashed(F.col(key), seed) < F.col(under)).cast("long"), F.lit(max_epochs))
    taken = docs.join(broadcast_if_small(state), F.col(source).eqNullSafe(F.col(s))).filter(copies > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*docs.columns)
