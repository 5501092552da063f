"""Document fingerprints by SpotSigs, with DataFrame functions only.

At each common word of a text, the antecedent, starts a signature: the chain of
the next ``CHAIN`` content words.  A text's fingerprint is the set of its
signatures, 64-bit hashes.  Fingerprints are compared by Jaccard similarity,
pruned by set lengths: sets whose lengths differ too much can't reach the
threshold, so pairs are only sought inside a length partition and its upper
neighbour, and there only through the rarest signatures of each set (a prefix
that two similar sets must share), equal sets being one class.

Defined results: a null text is empty; a text with no antecedent that a chain
of content words follows has its sequence of words, hashed, as its one
signature; equal texts have equal fingerprints; very long texts have all their
signatures; every row gives a row, repeated rows and null ids too; of sets that
tie in length or rarity none is preferred; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize

CHAIN, PERCENT = 3, 75
#: Common words of English, German, French and Spanish.
ANTECEDENTS = """a an and are as at be by for from in is it of on or that the this to was with
als auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie und von zu
au aux avec ce dans de du elle en est et il la le les ou par pas pour que qui sur un une
al como con del el las lo los más no para por se su una y""".split()


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """array<long> of a text's distinct signatures, in order."""

    def of_words(words: Column) -> Column:
        # antecedents become marks before the content word that follows
        marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(ANTECEDENTS), F.lit("#")).otherwise(F.concat(w, F.lit(" ")))), "")
        whole = F.array(F.xxhash64(F.lit(1), F.array_join(words, " ")))
        return let(F.split(F.rtrim(marked, F.lit("# ")), " "), lambda content: of_content(content, whole))

    def of_content(content: Column, whole: Column) -> Column:
        hashed = F.transform(content, lambda w: F.xxhash64(F.ltrim(w, F.lit("#"))))
        starts = F.filter(F.transform(content, lambda w, i: F.when(F.startswith(w, F.lit("#")) & (i <= F.size(content) - chain), i)), lambda i: i.isNotNull())
        chains = let(hashed, lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(chain)])))
        return F.when(F.size(starts) > 0, F.array_sort(F.array_distinct(chains))).otherwise(whole)

    return let(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), of_words)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def digest(fingerprint: Column) -> Column:
    """A fingerprint as a short string: equal for equal sets only."""
    return F.concat_ws(":", F.size(fingerprint), F.sha2(F.array_join(F.transform(fingerprint, lambda x: x.cast("string")), ","), 256))


def successors(docs: DataFrame) -> DataFrame:
    """doc_id, n, next_id of the distinct ids of (doc_id, n) with their largest n;
    the last one's next is the first.

    Rows are range-partitioned and numbered within partitions; only counts per
    partition are summed over all.
    """
    rows = docs.groupBy("doc_id").agg(F.max("n").alias("n")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    placed = materialize(rows.withColumn("m", F.monotonically_increasing_id()))
    part, within = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("part", F.coalesce(F.sum("c").over(run), F.lit(0)).alias("offset"), F.sum("c").over(Window.partitionBy()).alias("total"))
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + within)
    after = ranked.select(F.col("rank").alias("of"), F.col("doc_id").alias("next_id"))
    return materialize(ranked.join(after, (F.col("rank") + 1) % F.col("total") == F.col("of")).select("doc_id", "n", "next_id"))


def neighbour_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the beginning of the next
    document.  One row for each row; of the texts of one next id that of the
    least hash counts; a row without an id has no next document, so its edited
    text is cut.
    """
    # no aliases where the names are these: with them the two uses below would not share an exchange
    plain = docs.select(*[F.col(c) if c == to else F.col(c).alias(to) for c, to in ((key, "doc_id"), (text, "text"))])
    known = plain.filter("doc_id IS NOT NULL")  # both joins use it as it is, by doc_id alone, and so share one exchange of the texts
    whole = F.coalesce("text", F.lit(""))
    order = successors(known.select("doc_id", F.char_length(whole).alias("n")))
    # what each document gives to the one before it
    given = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to_id"), F.floor(F.col("n") / 2).cast("int").alias("want"))
    taken = known.join(given.hint("shuffle_hash"), "doc_id")
    part = F.struct(F.xxhash64(whole).alias("th"), F.substring(whole, F.lit(1), F.col("want")).alias("head"), signatures(F.col("text")).alias("next_sigs"))
    parts = taken.select(F.col("to_id").alias("doc_id"), part.alias("p")).groupBy("doc_id").agg(F.min("p").alias("p"))
    met = known.join(parts, "doc_id").select("doc_id", whole.alias("text"), "p.head", "p.next_sigs")
    alone = plain.filter("doc_id IS NULL").select("doc_id", whole.alias("text"), F.lit("").alias("head"), F.array().cast("array<long>").alias("next_sigs"))
    return _digests(met).unionByName(_digests(alone))


def _digests(met: DataFrame) -> DataFrame:
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("head", F.lit(1), half))
    done = met.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "text", "next_sigs")
    # one expression binds the sets, so they are computed once
    made = F.struct(signatures(F.col("text")).alias("a"), signatures(F.col("edited")).alias("b"), F.col("next_sigs").alias("c"))
    out = let(
        made,
        lambda s: F.struct(digest(s["a"]).alias("fingerprint"), digest(s["b"]).alias("edited_fingerprint"), likeness(s["a"], s["b"]).alias("near_edited"), likeness(s["a"], s["c"]).alias("near_next")),
    )
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), out.alias("o")).select("doc_id", "n_chars", "edited_sha256", "o.*")


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, s, n and two hashes of the set, of the rows with an id."""
    sets = docs.select(F.col(key).alias("doc_id"), signatures(F.col(text)).alias("s")).filter("doc_id IS NOT NULL")
    return materialize(sets.select("doc_id", "s", F.size("s").alias("n"), F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(3), "s").alias("h2")))


def _classes(sets: DataFrame) -> DataFrame:
    """h1, h2, n, rep: the least id of each class of equal sets."""
    return materialize(sets.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")))


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """a, b, likeness of classes of equal fingerprints, by their least ids, that are at least ``percent`` alike.

    Sets fall into partitions by length, each ``100 / percent`` times as long
    as the one before: two similar sets lie in one or in neighbours.  In a
    partition a set is listed under those of its signatures, rarest first,
    among which it must share one with any similar set.
    """
    sets = _sets(docs, key, text)
    return _near_pairs(sets, _classes(sets), percent)


def _near_pairs(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    reps = materialize(sets.join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2", "n"), ["doc_id", "h1", "h2", "n"]).groupBy("doc_id", "h1", "h2", "n").agg(F.min("s").alias("s")).drop("h1", "h2"))
    flat = reps.select("doc_id", "n", F.explode("s").alias("g"))
    common = flat.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # signatures that no other set has are the rarest, and match nothing: only their number counts
    by_rarity = Window.partitionBy("doc_id").orderBy("df", "g")
    shared = flat.join(common, "g")
    ranked = shared.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).withColumn("r", F.col("alone") + F.row_number().over(by_rarity) - 1)
    step = F.lit(100 / percent)
    prefix = ranked.filter(100 * (F.col("n") - F.col("r")) >= percent * F.col("n"))
    prefix = materialize(prefix.select("doc_id", "n", "g", "r", F.floor(F.log("n") / F.log(step)).cast("int").alias("part")))
    one = prefix.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("r").alias("rx"), "g", "part")
    two = prefix.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("r").alias("ry"), "g", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    need = percent * (F.col("nx") + F.col("ny"))
    fits = (F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry")) * (100 + percent) >= need) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    met = one.join(two, ["g", "part"]).filter((F.col("x") != F.col("y")) & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left, right = reps.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), reps.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    scored = met.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return scored.filter(F.col("likeness") * 100 >= percent)


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, class_id, n_links, nearest of each row with an id: the least id with an equal fingerprint, how many
    other classes are at least ``percent`` alike, and the greatest likeness among them (null if there are none)."""
    sets = _sets(docs, key, text)
    classes = _classes(sets)
    pairs = materialize(_near_pairs(sets, classes, percent))
    ends = pairs.select(F.col("a").alias("rep"), "likeness").union(pairs.select("b", "likeness"))
    links = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"), F.max("likeness").alias("nearest"))
    named = classes.join(links, "rep", "left")
    return sets.join(named, ["h1", "h2", "n"]).select("doc_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "nearest")
