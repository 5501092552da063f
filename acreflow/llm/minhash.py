"""Near-duplicate documents: SuperMinHash signatures, banding, verification on
full shingle sets and union-find grouping.

1. One Python pass gives each document its number of distinct shingles, a
   128-bit fingerprint of its shingle set and one key per band of its
   signature.  In SuperMinHash an element's rank in slot p is its place in a
   random order of the slots plus a random fraction; slots are filled in
   rounds over all elements of a text, and a text is done as soon as no slot
   can get less (the early stop).
2. Documents with equal sets are one class under their least id, so copies
   never meet each other in pairs.
3. In each band bucket every class meets only the bucket's centre, the member
   that shares most buckets with others (of several the greatest id).  These
   pairs are confirmed on full sets and grouped.
4. Where a bucket still holds several groups, members outside the centre's
   group meet one member of it, another in each bucket and each of two rounds.
   What is found links groups, and only what is still apart is renamed.
5. What is still apart looks for partners in the other groups of its buckets
   by prefix filtering: two similar sets share one of the rarest shingles of
   both, of so many that the rest could not reach the threshold.  This finds
   every remaining link between members of a bucket, and no group of copies is
   spelled out in pairs.

32 bands of 4 slots miss a pair of similarity 0.75 once in 200,000 times.

Defined results: no text or words: no shingles, own component, kept.  A null
id: null component, kept.  Rows of one id are linked with each other.  Texts of
any length count whole, in tasks that hold one of them and its shingles.  An
empty table gives an empty table.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreflow.operators.graph import components

from .common import materialize
from .textvec import distinct, mix64, pieces, shingle_sets

WORDS, PERCENT, BANDS, ROWS, ROUNDS = 5, 75, 32, 4, 2


def super_minhash(h: np.ndarray, r: np.ndarray, n: int, slots: int) -> np.ndarray:
    """[n, slots] signatures of sets given as hash and row, rows in order."""
    sig = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    order = None  # of the slots, for each element, once it takes part in a second round
    for j in range(slots):
        if not len(h):
            break
        x = mix64(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + ((x >> np.uint64(32)) % np.uint64(slots - j)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            each = np.arange(len(h))
            slot = order[each, k].astype(np.int64)
            order[each, k] = order[:, j]
        value = (np.uint64(j) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF))
        np.minimum.at(sig, r * slots + slot, value)
        full = sig.reshape(n, slots).max(axis=1) < np.uint64(j + 1) << np.uint64(32)
        go = ~full[r]
        if j == 0:
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(go.sum()), 1))
            order[np.arange(len(order)), k[go]] = 0
        elif not go.all():
            order = order[go]
        h, r = h[go], r[go]
    return sig.reshape(n, slots)


def signature_batches(k: int, bands: int, rows: int):
    """mapInArrow: id, text -> id, n_shingles, f1, f2, bands"""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, n, h, r in shingle_sets(batch.column(1), k):
                count = np.bincount(r, minlength=n)
                prints = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    run_sum = np.r_[np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(salt)), dtype=np.uint64)]
                    edge = np.r_[0, np.cumsum(count)]
                    prints.append(mix64(run_sum[edge[1:]] - run_sum[edge[:-1]]).view(np.int64))
                sig = super_minhash(h, r, n, bands * rows)
                key = np.zeros((n, bands), np.uint64)
                for x in range(rows):
                    key = mix64(key * np.uint64(3) + sig[:, x::rows])
                key = mix64(key + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                some = count > 0
                ends = np.r_[0, np.cumsum(some * bands)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[some].ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(count.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), lists], names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    return run


def confirm_batches(k: int, percent: int):
    """mapInArrow: two texts and any columns -> those columns of the rows with percent * union <= 100 * intersection"""

    def sets(column, at, n):
        hs, rs = [], []
        for i, _, h, r in shingle_sets(column.slice(at, n), k):
            hs.append(h)
            rs.append(r + i)
        return np.concatenate(hs), np.concatenate(rs)

    def run(batches):
        for batch in batches:
            size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            for at, end in pieces(np.r_[0, np.cumsum(size)]):
                n = end - at
                ha, ra = sets(batch.column(0), at, n)
                hb, rb = sets(batch.column(1), at, n)
                na, nb = np.bincount(ra, minlength=n), np.bincount(rb, minlength=n)
                _, r = distinct(np.r_[ha, hb], np.r_[ra, rb])
                union = np.bincount(r, minlength=n)
                both = na + nb - union
                yes = pa.array((100 * both >= percent * union) & (both > 0))
                yield pa.RecordBatch.from_arrays([c.slice(at, n).filter(yes) for c in batch.columns[2:]], names=batch.schema.names[2:])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of pairs (a, b, their groups) of class ids whose full sets are similar, as links (a, b) of groups.

    The links are written: one stage with two Python functions would keep twice as many workers.
    """
    one, two = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    met = pairs.join(one, "a").join(two, "b").select("ta", "tb", F.col("ga").alias("a"), F.col("gb").alias("b"))
    return materialize(met.mapInArrow(confirm_batches(k, percent), "a long, b long").distinct())


def shingle_batches(k: int):
    """mapInArrow: id, group, apart, text -> id, group, apart, size of the set, and a row for each shingle's hash"""

    def run(batches):
        for batch in batches:
            for i, n, h, r in shingle_sets(batch.column(3), k):
                size = np.bincount(r, minlength=n)
                own = [c.take(pa.array(r + i)) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size[r]), pa.array(h.view(np.int64))], names=["doc_id", "group", "apart", "n", "h"])

    return run


def _pair(one: str, two: str, group_one: str, group_two: str) -> list:
    """a, b and their groups, the lesser id first."""
    first = F.col(one) < F.col(two)
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), F.when(first, F.col(group_one)).otherwise(F.col(group_two)).alias("ga"), F.when(first, F.col(group_two)).otherwise(F.col(group_one)).alias("gb")]


def _renamed(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Rows with the groups in ``columns`` under the names of the greater groups they now belong to."""
    for c in columns:
        now = names.select(F.col("node").alias(c), F.col("component").alias("__now"))
        rows = rows.join(now, c, "left").withColumn(c, F.coalesce("__now", c)).drop("__now")
    return rows


def _partners(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different groups, one of them apart, that prefix filtering leaves.

    Sets of x and y elements are similar if they share at least
    ``percent / (100 + percent) * (x + y)``; in one order of all elements, the
    first shared one then has at least that many from it on in both sets.
    """
    rows = materialize(members.mapInArrow(shingle_batches(k), "doc_id long, group long, apart boolean, n long, h long"))
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = Window.partitionBy("doc_id").orderBy("df", "h")
    ranked = rows.join(common, "h").withColumn("r", F.row_number().over(by_rarity) - 1)
    prefix = materialize(ranked.filter((F.col("df") > 1) & (100 * (F.col("n") - F.col("r")) >= percent * F.col("n"))).select("doc_id", "group", "apart", "n", "r", "h"))
    # what only one group holds, as a passage of near copies, links nothing new
    mixed = prefix.groupBy("h").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.max("apart").alias("some")).filter("g0 != g1 AND some").select("h")
    prefix = prefix.join(mixed, "h", "left_semi")
    one = prefix.filter("apart").select(F.col("doc_id").alias("x"), F.col("group").alias("gx"), F.col("n").alias("nx"), F.col("r").alias("rx"), "h")
    two = prefix.select(F.col("doc_id").alias("y"), F.col("group").alias("gy"), F.col("n").alias("ny"), F.col("r").alias("ry"), "h")
    enough = (100 + percent) * F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry")) >= percent * (F.col("nx") + F.col("ny"))
    sized = (100 * F.col("ny") >= percent * F.col("nx")) & (100 * F.col("nx") >= percent * F.col("ny"))
    met = one.join(two, "h").filter((F.col("gx") != F.col("gy")) & enough & sized)
    return met.select(*_pair("x", "y", "gx", "gy")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(plain.mapInArrow(signature_batches(k, bands, rows), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"))
    print_of = ["f1", "f2", "n_shingles"]
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(usable.groupBy(*print_of).agg(F.min("doc_id").alias("rep")))
    reps = usable.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    slots = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("slot")).distinct()
    sizes = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = materialize(slots.join(sizes, "slot"))
    popular = crowded.groupBy("rep").agg(F.sum("n").alias("pop"))
    centres = crowded.join(popular, "rep").groupBy("slot").agg(F.max(F.struct("pop", "rep")).alias("c")).select("slot", F.col("c.rep").alias("centre"))
    crowded = materialize(crowded.join(centres, "slot").select("slot", "rep", "centre"))
    texts = plain.filter("doc_id IS NOT NULL")
    pairs = crowded.filter("rep != centre").select(*_pair("rep", "centre", "rep", "centre")).distinct()
    groups = components(_confirmed(pairs, texts, k, percent))

    label = groups.toDF("rep", "group")
    met = crowded.join(label, "rep", "left").join(label.toDF("centre", "main"), "centre", "left")
    grouped = materialize(met.select("slot", "rep", F.coalesce("group", "rep").alias("group"), F.coalesce("main", "centre").alias("main")))
    # Groups only grow, so what is in its centre's group stays there: each round renames what is apart, and nothing else.
    apart, later = grouped.filter("group != main"), []
    for salt in range(ROUNDS):
        among = grouped.filter("group = main").groupBy("slot").agg(F.min(F.struct(F.xxhash64(F.lit(salt), "slot", "rep").alias("h"), F.col("rep").alias("pivot"))).alias("p"))
        tried = apart.join(among.select("slot", "p.pivot"), "slot").select(*_pair("rep", "pivot", "group", "main")).distinct()
        later.append(components(_confirmed(tried, texts, k, percent)))
        apart = materialize(_renamed(apart, later[-1], "group", "main").filter("group != main"))
    members = grouped.join(apart.select("slot").distinct(), "slot", "left_semi").groupBy("rep").agg(F.min("group").alias("group"))
    for names in later:
        members = _renamed(members, names, "group")
    members = members.join(apart.select("rep", F.lit(True).alias("apart")).distinct(), "rep", "left").select("rep", "group", F.coalesce("apart", F.lit(False)).alias("apart"))
    rest = materialize(_partners(texts.join(members, texts.doc_id == members.rep).select("doc_id", "group", "apart", "text"), k, percent))
    later.append(components(_confirmed(rest, texts, k, percent)))

    named = classes.join(groups.toDF("rep", "of_class"), "rep", "left").withColumn("of_class", F.coalesce("of_class", "rep"))
    for names in later:
        named = _renamed(named, names, "of_class")
    found = signed.drop("bands").join(named.select(*print_of, "of_class"), print_of, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
