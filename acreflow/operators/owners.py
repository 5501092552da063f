"""Owner rollups and fuzzy owner matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreflow.functions.owners import match_tier, surname
from acreflow.functions.values import SQUARE_METRES_PER_ACRE

from .ranking import ranks
from .storage import materialize


def rollup(parcels: DataFrame, owner: str = "owner", parcel: str = "id", area: str = "area_sqm", least: int = 2) -> DataFrame:
    """owner, parcel_count, total_acres, parcel_ids of owners with ``least`` parcels or more."""
    total = F.sum(F.col(area).cast("decimal(28,4)")).cast("double") / SQUARE_METRES_PER_ACRE
    grouped = parcels.filter(F.col(owner).isNotNull()).groupBy(F.col(owner).alias("owner"))
    return grouped.agg(F.count(F.lit(1)).alias("parcel_count"), total.alias("total_acres"), F.sort_array(F.collect_list(parcel)).alias("parcel_ids")).filter(F.col("parcel_count") >= least)


def top_owners(parcels: DataFrame, most: int, owner: str = "owner", parcel: str = "id", area: str = "area_sqm", least: int = 2) -> DataFrame:
    """``rollup`` of the ``most`` owners of the largest areas: ranked by sums alone, then only their parcels are collected."""
    total = F.sum(F.col(area).cast("decimal(28,4)")).cast("double") / SQUARE_METRES_PER_ACRE
    sums = parcels.filter(F.col(owner).isNotNull()).groupBy(F.col(owner).alias("owner")).agg(F.count(F.lit(1)).alias("parcel_count"), total.alias("total_acres"))
    top = sums.filter(F.col("parcel_count") >= least).orderBy(F.desc("total_acres"), "owner").limit(most)
    ids = parcels.select(F.col(owner).alias("owner"), F.col(parcel).alias("id")).join(F.broadcast(top), "owner").groupBy("owner", "parcel_count", "total_acres")  # at most ``most`` rows
    return ids.agg(F.sort_array(F.collect_list("id")).alias("parcel_ids"))


def similar(names: DataFrame, name: str, probe: str, threshold: int = 3) -> DataFrame:
    """Distinct names within an edit distance of one, itself left out."""
    distinct = names.select(F.col(name).alias("name")).distinct()
    return distinct.withColumn("distance", F.levenshtein("name", F.lit(probe), threshold)).filter("distance > 0")


#: Names of one surname from which on they are matched by segments.
MANY_NAMES = 200


def _rest(own: DataFrame) -> DataFrame:
    """Names with what stands before their surname, and its length: a common end changes no edit distance."""
    return own.withColumn("x", F.expr("substring(n, 1, length(n) - length(s))")).withColumn("l", F.length("x"))


def _by_length(own: DataFrame, most: int) -> DataFrame:
    """Pairs a, b of names with one surname whose lengths differ by ``most`` at most."""
    step = F.floor(F.col("l") / (most + 1))
    a = own.select("n", "s", "l", step.alias("step")).toDF("a", "s", "la", "step")
    b = own.select("n", "s", "l", F.explode(F.array(step - 1, step, step + 1))).toDF("b", "s", "lb", "step")
    return a.join(b, ["s", "step"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= most)).select("a", "b")


def _segment(length: Column, i: Column, most: int) -> tuple[Column, Column]:
    """Start (from 0) and length of part ``i`` of ``most + 1`` about equal ones."""
    base, longer = F.floor(length / (most + 1)), length % (most + 1)
    short = most + 1 - longer
    return i * base + F.greatest(i - short, F.lit(0)), base + F.when(i >= short, 1).otherwise(0)


def _by_segments(own: DataFrame, most: int) -> DataFrame:
    """Pairs a, b of names with one surname that can be within ``most`` edits.

    A name cut into ``most + 1`` parts keeps one of them unchanged in any name
    within ``most`` edits; it stands there shifted by no more than the edits
    before it, and by no more than those that are left behind it.  Names too
    short to cut are near to most others of their length, and are compared so.
    """
    parts = F.sequence(F.lit(0), F.lit(most))
    long_ones = own.filter(F.col("l") > most)

    def own_part(i: Column) -> Column:
        start, size = _segment(F.col("l"), i, most)
        return F.struct(F.col("l").alias("length"), i.alias("i"), F.substring(F.col("x"), (start + 1).cast("int"), size.cast("int")).alias("part"))

    def shifted(length: Column, i: Column) -> Column:
        start, size = _segment(length, i, most)
        more = F.col("l") - length
        lo = F.greatest(start - i, start + more - (most - i), F.lit(0))
        hi = F.least(start + i, start + more + (most - i), F.col("l") - size)
        at = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(at, lambda p: F.struct(length.alias("length"), i.alias("i"), F.substring(F.col("x"), (p + 1).cast("int"), size.cast("int")).alias("part")))

    lengths = F.sequence(F.greatest(F.col("l") - most, F.lit(most + 1)), F.col("l"))
    probes = F.flatten(F.transform(lengths, lambda length: F.flatten(F.transform(parts, lambda i: shifted(length, i)))))
    index = long_ones.select("n", "s", F.explode(F.transform(parts, own_part)).alias("k")).select(F.col("n").alias("b"), "s", "k.*")
    asked = long_ones.select("n", "s", F.explode(F.array_distinct(probes)).alias("k")).select(F.col("n").alias("a"), "s", "k.*")
    met = asked.join(index, ["s", "length", "i", "part"]).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    short = own.filter(F.col("l") <= most).select(F.col("n").alias("a"), "s", F.col("l").alias("la"))
    near = short.join(own.filter(F.col("l") <= 2 * most).select(F.col("n").alias("b"), "s", F.col("l").alias("lb")), "s").filter((F.abs(F.col("la") - F.col("lb")) <= most) & (F.col("a") != F.col("b")))
    return met.union(near.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def candidate_pairs(names: DataFrame, name: str, most: int = 6, many: int = MANY_NAMES) -> DataFrame:
    """a, b (a < b) of different names with one surname that can be within ``most`` edits: for surnames of more than ``many`` names by segments, else by length."""
    own = _rest(materialize(names.select(F.btrim(F.col(name)).alias("n")).filter("n IS NOT NULL").distinct().withColumn("s", surname(F.col("n")))))
    common = own.groupBy("s").agg(F.count(F.lit(1)).alias("names")).filter(F.col("names") > many).select("s")
    return _by_length(own.join(common, "s", "left_anti"), most).union(_by_segments(own.join(common, "s", "left_semi"), most))


def name_pairs(names: DataFrame, name: str, most: int = 6, many: int = MANY_NAMES) -> DataFrame:
    """a, b, distance, confidence of different names, trimmed, with one surname within ``most`` edits."""
    met = candidate_pairs(names, name, most, many).withColumn("distance", F.levenshtein("a", "b", most)).filter("distance >= 0")
    return met.select("a", "b", "distance", match_tier(F.col("distance"), F.col("a"), F.col("b")).alias("confidence")).filter("confidence IS NOT NULL")


def greedy_groups(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """head, members (by rank; a struct of name and confidence), mean confidence of the groups that names form
    when they are taken in the order of ``rank`` and each one that is in no group gathers all later ones that are in none and paired with it.

    ``pairs`` has a, b, confidence, ``ranked`` has name, rank (no two alike).  A
    name is a head if no name paired with it and before it is a head, so names
    without an undecided one before them are heads at once, and what is paired
    with a head is a member; rounds go on with the rest.  A member belongs to its
    first head.  This equals the sequential result; no task sees a whole surname.
    """
    one, two = ranked.select(F.col("name").alias("a"), F.col("rank").alias("ra")), ranked.select(F.col("name").alias("b"), F.col("rank").alias("rb"))
    met = pairs.join(one, "a").join(two, "b")
    first = F.col("ra") < F.col("rb")
    edges = materialize(met.select(F.when(first, F.col("ra")).otherwise(F.col("rb")).alias("u"), F.when(first, F.col("rb")).otherwise(F.col("ra")).alias("v"), "confidence"))
    left, members = edges.select("u", "v"), edges.select("v").limit(0)
    while not left.isEmpty():
        now = left.select("u").distinct().join(left.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        near = left.join(now, "u", "left_semi").select("v").distinct()
        decided = materialize(now.select(F.col("u").alias("x"), F.lit(True).alias("head")).union(near.select("v", F.lit(False))))
        members = members.union(decided.filter("NOT head").select("x"))
        left = materialize(left.join(decided, F.col("u") == F.col("x"), "left_anti").join(decided, F.col("v") == F.col("x"), "left_anti"))
    heads = edges.select("u").distinct().join(members, F.col("u") == F.col("v"), "left_anti")  # also those whose later ones were all taken before they were decided
    joined = edges.join(heads, "u", "left_semi").groupBy("v").agg(F.min(F.struct("u", "confidence")).alias("x")).select(F.col("x.u").alias("u"), "v", "x.confidence")
    named = joined.join(ranked.select(F.col("rank").alias("v"), F.col("name").alias("member")), "v")
    grouped = named.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("v", F.col("member").alias("name"), "confidence"))).alias("m"), F.avg("confidence").alias("confidence"))
    members = F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence")))
    return grouped.join(ranked.select(F.col("rank").alias("u"), F.col("name").alias("head")), "u").select("head", members.alias("members"), "confidence")


def owner_variants(owners: DataFrame, name: str = "owner", count: str = "parcel_count", most: int = 6) -> DataFrame:
    """head, members, confidence, names, parcels: owners that look like variants of one, the one of most parcels first.

    Owners (name, count) count once each; equal counts go by name.
    """
    each = materialize(owners.select(F.btrim(F.col(name)).alias("name"), F.col(count).alias("n")).filter("name IS NOT NULL").groupBy("name").agg(F.sum("n").alias("n")))
    # places in that order, from one row for each count and its names' order inside it, without one sorted task
    ranked = materialize(ranks(each, [], [F.desc("n"), F.asc("name")]).select("name", "rank"))
    groups = greedy_groups(name_pairs(each, "name", most), ranked)
    whole = groups.select("head", "members", "confidence", F.explode(F.concat(F.array("head"), F.transform("members", lambda m: m["name"]))).alias("name")).join(each, "name")
    return whole.groupBy("head").agg(F.first("members").alias("members"), F.first("confidence").alias("confidence"), F.count(F.lit(1)).alias("names"), F.sum("n").alias("parcels"))
