"""Table operators: upserts, archives, filters from criteria, caps, run logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranks


def one_each(df: DataFrame, key: str, last: str | None = None) -> DataFrame:
    """One row of each key, the same in any run: the greatest by column ``last``, then by all columns in order (which must have an order)."""
    others = [c for c in df.columns if c != key]
    order = F.struct(*([F.col(last).alias("__last")] if last else []), *others)
    return df.groupBy(key).agg(F.max(order).alias("__row")).select(*[F.col(c) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, ``update`` columns are the new row's and the others the old one's.  Of new rows with one key ``one_each`` stands."""
    n = one_each(new.select(*old.columns), key).select(*[F.col(c).alias(f"__new_{c}") for c in old.columns]).withColumn("__new", F.lit(True))
    met = old.withColumn("__old", F.lit(True)).join(n, F.col(key) == F.col(f"__new_{key}"), "full_outer")

    def pick(c: str) -> Column:
        fresh = F.col("__new").isNotNull() if c in update else F.col("__old").isNull()
        return F.when(fresh, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)

    return met.select(*[pick(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows and those new ones whose key is not there; of equal new keys ``one_each``."""
    return old.unionByName(one_each(new, key).join(old.select(key), key, "left_anti").select(*old.columns))


def conditional_update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


#: The status machine of a work queue: from what to what a row may go.
QUEUE_STEPS = {"pending": ("processing",), "processing": ("completed", "failed"), "failed": ("pending",)}


def transitioned(df: DataFrame, to: Column, status: str = "status", steps: dict[str, tuple[str, ...]] = QUEUE_STEPS, first: str = "pending") -> DataFrame:
    """Rows whose status goes to ``to`` where a step leads there (from null only to ``first``), and ``moved``; others stay as they are."""
    now = F.col(status)
    ok = reduce(lambda a, b: a | b, [(now == a) & to.isin(*b) for a, b in steps.items()], now.isNull() & (to == first))
    moved = F.coalesce(ok, F.lit(False))
    return df.withColumn("moved", moved).withColumn(status, F.when(F.col("moved"), to).otherwise(now))


def archive_split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(archived rows with archived_reason, remaining rows)"""
    told = df.withColumn("archived_reason", reason)
    return told.filter("archived_reason IS NOT NULL"), told.filter("archived_reason IS NULL").drop("archived_reason")


def validated(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows in quarantine with ``errors``, the messages of the rules they break in order).

    A rule that is null is broken; for an optional value write ``x IS NULL OR ...``.
    """
    broken = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(message)) for message, ok in rules.items()]))
    told = df.withColumn("errors", broken)
    return told.filter(F.size("errors") == 0).drop("errors"), told.filter(F.size("errors") > 0)


def page(df: DataFrame, order: list[Column], size: int, most: int = 1000, offset: int = 0) -> DataFrame:
    """A page of ordered rows; a size over ``most`` is cut to it."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(max(min(size, most), 0))


def is_due(last_run: Column, now: Column, hours: float = 2) -> Column:
    """Whether a run may begin: there was none, or it is ``hours`` ago at least."""
    return last_run.isNull() | ((now.cast("timestamp").cast("double") - last_run.cast("timestamp").cast("double")) >= hours * 3600)


def retained(df: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    return df.filter(F.col(at) >= as_of - F.make_interval(days=F.lit(days)))


def matching(df: DataFrame, criteria: dict) -> DataFrame:
    """Rows that meet optional criteria: min_x, max_x (bounds of column x), x_like (substring), x_in (a list), x (equality).  None is no criterion."""

    def one(name: str, value) -> Column:
        if name.startswith("min_"):
            return F.col(name[4:]) >= value
        if name.startswith("max_"):
            return F.col(name[4:]) <= value
        if name.endswith("_like"):
            return F.contains(F.col(name[:-5]), F.lit(value))
        if name.endswith("_in"):
            return F.col(name[:-3]).isin(*value)
        return F.col(name) == value

    return df.filter(reduce(lambda a, b: a & b, [one(n, v) for n, v in criteria.items() if v is not None], F.lit(True)))


def passes_if_missing(x: Column, low=None, high=None) -> Column:
    """A range that a null or a zero passes."""
    inside = F.lit(True)
    if low is not None:
        inside &= x >= low
    if high is not None:
        inside &= x <= high
    return x.isNull() | (x == 0) | inside


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float, without_place: bool) -> Column:
    inside = lat.between(south, north) & lon.between(west, east)
    missing = F.coalesce(lat, F.lit(0.0)) == 0
    return (inside | missing) if without_place else F.coalesce(inside, F.lit(False))


def priority_cap(df: DataFrame, by: str, first: Column, order: list[Column], most: int) -> DataFrame:
    """Each group's rows with their place when ``first`` ones come first, and whether they are beyond ``most``."""
    placed = ranks(df, [by], [first.desc(), *order], "place")
    return placed.withColumn("place", F.col("place").cast("int")).withColumn("missing", F.col("place") > most)


def latest_run(log: DataFrame, run: str, at: str) -> DataFrame:
    """The rows of the run that the log's newest row belongs to."""
    newest = log.agg(F.max_by(run, F.struct(at, run)).alias("__run"))
    return log.join(F.broadcast(newest), F.col(run) == F.col("__run"), "left_semi")


def positional_rows(df: DataFrame, rows: str, names: list[str]) -> DataFrame:
    """A row for each inner array of a JSON array of arrays, its places named."""
    inner = F.explode(F.from_json(rows, "array<array<string>>"))
    return df.select(*[c for c in df.columns if c != rows], inner.alias("__r")).select(*[c for c in df.columns if c != rows], *[F.get("__r", i).alias(n) for i, n in enumerate(names)])


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, halves up; 0 of nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5)).otherwise(F.lit(0)).cast("long")


def coverage(stats: DataFrame) -> DataFrame:
    """Rates of a run log with discovered, processed, saved, region_found, region_saved."""
    return stats.withColumns({
        "coverage": percent(F.col("saved"), F.col("discovered")), "processed_rate": percent(F.col("processed"), F.col("discovered")),
        "region_coverage": percent(F.col("region_saved"), F.col("region_found")),
    })


def anomalies(current: DataFrame, history: DataFrame) -> DataFrame:
    """source, alert: drops to under half of a mean over 5, region finds without saves, failure rates over a half of more than 5."""
    mean = history.groupBy("source").agg(F.avg("discovered").alias("mean"))
    met = current.join(mean, "source", "left")
    alerts = F.array(
        F.when((F.col("discovered") < F.col("mean") * 0.5) & (F.col("mean") > 5), "drop"),
        F.when((F.col("region_found") > 0) & (F.col("region_saved") == 0), "region"),
        F.when((F.col("processed") > 5) & (F.col("failed") > F.col("processed") * 0.5), "failures"),
    )
    return met.select("source", F.explode(F.array_compact(alerts)).alias("alert"))


def weighted_means(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """The weighted mean of each group, groups without weight left out."""
    return df.groupBy(by).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("mean")).filter("mean IS NOT NULL")


def dominant(df: DataFrame, by: str, share: str, key: str) -> DataFrame:
    """The row of the greatest share of each group, ties by key; a null share counts as greatest."""
    w = Window.partitionBy(by).orderBy(F.col(share).desc_nulls_first(), key)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def pairs_between(counted: DataFrame, by: list[str], key: str, n: str) -> DataFrame:
    """by, pairs: how many pairs of rows of one group have different keys, where a row of ``counted`` stands for ``n``.

    Each of two rows with keys a < b is paired once, as a self-join would; the rows
    of one key make no pairs.  Two aggregates, no join: all pairs less those of equal keys.
    """
    each = counted.groupBy(*by, key).agg(F.sum(n).alias("__n"))
    whole = each.groupBy(*by).agg(F.sum("__n").alias("__all"), F.sum(F.col("__n") * F.col("__n")).alias("__own"))
    return whole.select(*by, F.expr("(__all * __all - __own) div 2").alias("pairs"))
