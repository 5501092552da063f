"""Line dedup: lines that many documents share go, except in one of them.

The key of a line is the line with white space stripped at both ends and A-Z
lower-cased, carried as two independent 64-bit hashes.  The lines are
range-partitioned by key and document (largest first): split points are taken
from a sample, each row's partition is found among them, and one exchange moves
the rows there.  So a line that stands in a third of all documents is cut over
many partitions; within them lines are sorted by key, document and position.  One pass along each partition then tells a key's first document,
which keeps the line, from the later ones, and counts them.  A key that goes on
in the next partition is stitched from one row for each partition that holds it.
The result is each document's keep bitmap in compressed form, as run lengths,
for the documents that lose lines; texts only meet their bitmaps.  Only
DataFrame functions run.

Defined results: a null or empty text is one empty line and loses nothing;
documents are told apart by id, null being one id, which is never the largest
while another holds the line; of rows with one id each loses or keeps a line by
that id, and rows with equal id and text get the same bitmap; lines of any
length and number are taken whole; an empty table gives an empty table; other
columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, let, materialize

MIN_CHARS, MIN_DOCS = 40, 5
#: Sampled rows for each range of lines.
SAMPLED = 50
SPACE = " \t\n\x0b\x0c\r"
_RUNS = "array<struct<first:int,last:int>>"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(lines: Column, min_chars: int) -> Column:
    """array of (pos, two hashes of the key) for the lines that are long enough"""
    keys = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(SPACE)).alias("k")))
    long_ones = F.filter(keys, lambda x: F.char_length(x["k"]) >= min_chars)
    return F.transform(long_ones, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(7), x["k"]).alias("h2")))


def line_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, n_lines, pos, h1, h2 of the lines that are long enough."""
    whole = F.coalesce(F.col(text), F.lit(""))
    of_lines = let(_lines(ascii_lower(whole)), lambda x: F.struct(F.size(x).alias("n"), _keyed(x, min_chars).alias("long")))
    each = docs.select(F.col(key).alias("doc_id"), F.xxhash64(whole).alias("text_hash"), of_lines.alias("of"))
    return each.select("doc_id", "text_hash", F.col("of.n").alias("n_lines"), F.explode("of.long").alias("x")).select("doc_id", "text_hash", "n_lines", "x.pos", "x.h1", "x.h2")


def _place() -> Column:
    """Where a row stands in the order of key and document, largest first; null ids stand last."""
    return F.struct(F.col("h1").alias("h1"), F.col("h2").alias("h2"), F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("doc"))


def _ranged(lines: DataFrame) -> DataFrame:
    """Lines in as many ranges of key and document as there are shuffle partitions, with their range as ``part``.

    The split points are places of about ``SAMPLED`` rows for each range, all that reaches the driver.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.count()
    share = min(1.0, SAMPLED * parts / max(rows, 1))
    some = lines.filter(F.pmod(F.xxhash64(F.lit(11), *lines.columns), F.lit(1 << 30)) < int(share * (1 << 30))).select(_place().alias("p")).select("p.*")
    places = some.orderBy("h1", "h2", "doc").collect()
    splits = [places[len(places) * i // parts] for i in range(1, parts)] if places else []
    if not splits:
        return lines.withColumn("part", F.lit(0))
    known = F.array(*[F.struct(F.lit(a).alias("h1"), F.lit(b).alias("h2"), F.lit(c).alias("doc")) for a, b, c in splits])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splits).bit_length()))])

    def search(place: Column) -> Column:
        """How many split points stand at or before a place, by halving."""
        on = lambda at, step: F.when(F.get(known, at + step - 1) <= place, at + step).otherwise(at)
        return F.aggregate(steps, F.lit(0), on)

    return lines.withColumn("part", let(_place(), search)).repartitionById(parts, "part")


def later_occurrences(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``line_keys`` whose line ``min_docs`` documents hold, but for those of the largest id."""
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("text_hash"), F.col("pos")]
    ranged = _ranged(lines)
    along = Window.partitionBy("part").orderBy(*order)
    key = Window.partitionBy("part", "h1", "h2")
    before = F.lag(F.struct("h1", "h2", "doc_id")).over(along)
    fresh_doc = (~F.struct("h1", "h2", "doc_id").eqNullSafe(before)).cast("long")
    streamed = ranged.withColumn("new", fresh_doc)
    # in a partition: documents of a key, and its first and last one; a key at a partition's end may go on in the next
    streamed = streamed.withColumn("n_docs", F.sum("new").over(key)).withColumn("keeper", F.max("doc_id").over(key))
    streamed = materialize(streamed)
    ends = streamed.groupBy("part").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi"))
    # a row for each partition
    split = ends.withColumn("next", F.lead("lo").over(Window.orderBy("part"))).filter("hi = next").select("hi.h1", "hi.h2").distinct()
    parts = streamed.join(F.broadcast(split), ["h1", "h2"]).groupBy("part", "h1", "h2").agg(F.max("n_docs").alias("n_docs"), F.max("doc_id").alias("first_doc"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("last_doc"))
    of_key = Window.partitionBy("h1", "h2").orderBy("part")
    goes_on = (F.lag("last_doc.doc_id").over(of_key).eqNullSafe(F.col("first_doc")) & (F.row_number().over(of_key) > 1)).cast("long")
    stitched = parts.withColumn("goes_on", goes_on).groupBy("h1", "h2").agg((F.sum("n_docs") - F.sum("goes_on")).alias("all_docs"), F.max("first_doc").alias("all_keeper"))
    whole = streamed.join(F.broadcast(stitched), ["h1", "h2"], "left")
    found = F.coalesce("all_docs", "n_docs") >= min_docs
    kept = F.col("doc_id").eqNullSafe(F.when(F.col("all_docs").isNull(), F.col("keeper")).otherwise(F.col("all_keeper")))
    return whole.filter(found & ~kept).select(*lines.columns)


def _runs(drops: Column) -> Column:
    """Runs of consecutive positions of a sorted array."""
    starts = F.filter(F.transform(drops, lambda x, i: F.when((i == 0) | (F.get(drops, i - 1) != x - 1), x)), lambda x: x.isNotNull())
    ends = F.filter(F.transform(drops, lambda x, i: F.when(F.coalesce(F.get(drops, i + 1) != x + 1, F.lit(True)), x)), lambda x: x.isNotNull())
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def _bitmap(runs: Column, n_lines: Column) -> Column:
    """The keep bitmap as lengths of its runs, kept and dropped ones in turn, kept first."""

    def lengths(r: Column) -> Column:
        each = F.flatten(F.transform(r, lambda x, i: F.array(x["first"] - F.coalesce(F.get(r, i - 1)["last"] + 1, F.lit(0)), x["last"] - x["first"] + 1)))
        rest = n_lines - F.coalesce(F.get(r, F.size(r) - 1)["last"] + 1, F.lit(0))
        return F.concat(each, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))

    return let(F.coalesce(runs, F.array().cast(_RUNS)), lengths)


def drop_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, n_lines, runs (array of first, last line) of the documents that lose lines."""
    lost = later_occurrences(materialize(line_keys(docs, key, text, min_chars)), min_docs)
    drops = lost.groupBy("doc_id", "text_hash", "n_lines").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    return drops.select("doc_id", "text_hash", "n_lines", _runs(F.col("drops")).alias("runs"))


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, text_hash, keep_bitmap (array<int>: lengths of the runs of kept and dropped lines in turn, kept first)
    of the documents that lose lines; the others keep all."""
    return drop_runs(docs, key, text, **options).select("doc_id", "text_hash", _bitmap(F.col("runs"), F.col("n_lines")).alias("keep_bitmap"))


def _kept(text: Column, runs: Column) -> Column:
    gone = F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))

    def join(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return F.when(runs.isNull(), text).otherwise(let(_lines(text), join))


def _with_runs(docs: DataFrame, key: str, text: str, name: str, **options) -> DataFrame:
    """The documents with their runs of dropped lines, null if there are none."""
    whole = F.coalesce(F.col(text), F.lit(""))
    i, h, th = fresh(docs, "run_id", "run_hash", "text_hash")
    runs = drop_runs(docs, key, text, **options).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("runs").alias(name))
    found = docs.withColumn(th, F.xxhash64(whole)).join(runs.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(i)) & (F.col(th) == F.col(h)), "left")
    return found.select(*docs.columns, name)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, columns as they are, with ``text`` cut to its kept lines."""
    (runs,) = fresh(docs, "runs")
    found = _with_runs(docs, key, text, runs, **options)
    return found.withColumn(text, F.when(F.col(text).isNotNull(), _kept(F.col(text), F.col(runs)))).select(*docs.columns)


def line_dedup_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap (run lengths joined with commas)."""
    found = _with_runs(docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "doc_id", "text", "runs")
    n_lines = F.size(_lines(F.col("text")))
    dropped = F.aggregate(F.coalesce("runs", F.array().cast(_RUNS)), F.lit(0).cast("long"), lambda n, r: n + (r["last"] - r["first"] + 1).cast("long"))
    bitmap = F.array_join(_bitmap(F.col("runs"), n_lines).cast("array<string>"), ",")
    return found.select("doc_id", n_lines.cast("long").alias("n_lines"), dropped.alias("n_dropped"), F.sha2(_kept(F.col("text"), F.col("runs")), 256).alias("kept_sha256"), bitmap.alias("keep_bitmap"))
