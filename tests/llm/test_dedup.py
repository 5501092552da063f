import hashlib
import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from acreflow.llm import common, linededup, minhash, queries

from . import brute
from .conftest import ODD


def check_near(frame):
    rows = frame.select("doc_id", "text").collect()
    want = brute.near_components({r.doc_id: r.text for r in rows})
    got = minhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_table(sample):
    check_near(sample)


def test_a_large_group_of_near_copies(docs):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(140)]
    texts = []
    for _ in range(160):
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 60 + [f"only here {i} {i + 1} {i + 2} {i + 3}" for i in range(20)]
    rng.shuffle(texts)
    check_near(docs(texts))


def test_near_odd_texts(docs):
    check_near(docs(ODD, extra=True))
    assert minhash.near_duplicates(docs(["a"]).limit(0)).count() == 0
    got = minhash.near_duplicates(docs(["a b c", "a b c", "z"], ids=[None, 5, None])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got) == [(False, 5, True), (True, None, True), (True, None, True)]


def test_short_texts_are_one_shingle(docs):
    check_near(docs(["a b c d", "A B c\nd", "a b c", "a b c d e", "a b c d e f"]))


def test_signatures_estimate_similarity():
    import numpy as np

    from acreflow.llm.textvec import mix64

    x = mix64(np.arange(1, 1301, dtype=np.uint64))
    h = np.r_[x[:1000], x[300:1300]]
    sig = minhash.super_minhash(h, np.repeat([0, 1], 1000), 2, 256)
    assert abs((sig[0] == sig[1]).mean() - 700 / 1300) < 0.12
    assert (minhash.super_minhash(x[:3], np.zeros(3, int), 1, 128) < np.uint64(2**63)).all()


def test_lines_against_sql(spark, same_rows):
    same_rows(queries.op6_line_dedup(spark, "/root/testdata/sf0.001"), queries.ORACLES["op6_line_dedup"])


def check_lines(frame):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    want = Counter((i, n, d, hashlib.sha256(k.encode()).hexdigest(), b) for (i, _), (n, d, k, b) in zip(rows, brute.line_dedup(rows), strict=True))
    assert Counter(map(tuple, linededup.line_dedup_digest(frame).collect())) == want
    kept = Counter((i, k if t is not None else None) for (i, t), (_, _, k, _) in zip(rows, brute.line_dedup(rows), strict=True))
    done = linededup.dedup_lines(frame)
    assert done.columns == frame.columns and Counter((r.doc_id, r.text) for r in done.collect()) == kept


def test_lines_against_brute_force(docs):
    rng = random.Random(1)
    common = [f"{'A line that many documents hold, number'} {i} {'é' * (i % 3)}" for i in range(6)] + ["short", "", "   ", "x" * 40, "y" * 39]
    texts = ["\n".join(("  " if rng.random() < 0.2 else "") + (x.upper() if rng.random() < 0.2 and "é" not in x else x) for x in rng.choices(common + [f"own line of document {i} which is long enough"], k=rng.randrange(12))) for i in range(40)] + ODD
    check_lines(docs(texts, extra=True))
    assert linededup.line_dedup_digest(docs(texts).limit(0)).count() == 0


def test_null_ids_and_repeated_rows(docs):
    line = "this line is shared and has more than forty characters"
    check_lines(docs([line] * 7 + [line + "\nx"], ids=[None, None, 3, 4, 5, 9, 9, 9]))
    check_lines(docs([line] * 6, ids=[None, None, 3, 4, 9, 9]))
    check_lines(docs([line] * 5, ids=[None] * 5))


def test_lines_that_fill_many_partitions(spark, docs):
    """Two keys that nearly all documents hold, at several places, cut over 16 range partitions."""
    lines = ["the first line that is found in nearly all of the documents", "the second line that is found in nearly all of the documents"]
    texts = ["\n".join(["a", lines[i % 2], lines[0], f"only in document {i}, as its number says, and long", lines[1], lines[1]][: 2 + i % 5]) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        frame = docs(texts, ids=[i // 2 if i < 20 else None if i < 25 else i for i in range(400)])
        keys = linededup.line_keys(frame)
        assert keys.repartitionByRange("h1", "h2", "doc_id", "pos").rdd.getNumPartitions() == 16
        check_lines(frame)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bitmaps_are_run_lengths(docs):
    line = "this line is shared and has more than forty characters"
    frame = docs([f"a\n{line}\n{line}\nb\n{line}"] + [line] * 5)
    assert [(r.first, r.last) for r in linededup.drop_runs(frame).filter("doc_id = 0").first().runs] == [(1, 2), (4, 4)]
    assert {r.doc_id: r.keep_bitmap for r in linededup.keep_bitmaps(frame).collect()} == {0: [1, 2, 1, 1]} | {i: [0, 1] for i in range(1, 5)}


def test_lines_move_once(spark, sample, request):
    """One exchange brings the lines to their ranges, and the windows take them as they lie; a hot line is cut over many ranges."""
    hot = "This is a line that stands in very many of all the documents."
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(hot + "\n"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words of its own ")), 3)).alias("text"))
    lines = common.materialize(linededup.line_keys(rows))
    ranged = linededup._ranged(lines)
    counts = [r["count"] for r in ranged.groupBy("part").count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(counts) == parts and max(counts) < 1.5 * lines.count() / parts
    assert ranged.filter(F.col("part") != F.spark_partition_id()).count() == 0
    assert ranged.join(lines.groupBy("h1", "h2").count().filter("count > 1000"), ["h1", "h2"]).select("part").distinct().count() >= 2
    along = Window.partitionBy("part").orderBy("h1", "h2", F.col("doc_id").desc_nulls_last())
    plan = ranged.withColumn("before", F.lag("h1").over(along))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "shufflepartitionidpassthrough" in plan
    assert linededup.later_occurrences(lines).count() == 2999
