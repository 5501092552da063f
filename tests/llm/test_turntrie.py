import hashlib
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreflow.llm import queries, turntrie
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    """The trie's rows from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    trie = defaultdict(list)
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), [])
        path = tuple(base[:h] + turns[h:])
        for d in range(len(path) + 1):
            trie[path[:d]].append((c, len(path)))
    own_saved = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in trie.items()}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in trie:
        if p:
            children[p[:-1]] += 1
    for p in trie:
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved[p]
            leaves[p[:d]] += p not in children
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    first = {p: min(m)[0] for p, m in trie.items()}
    return sorted(repr((first[p], len(p), first[p[:-1]] if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha([c for c, n in m if n == len(p)]))) for p, m in trie.items())


def told(frame, **options):
    return sorted(repr(tuple(r)) for r in turntrie.prefix_trie(frame, **options).collect())


def random_rows(seed, convs):
    rng = np.random.default_rng(seed)
    rows = []
    for c in convs:
        turns = rng.permutation(int(rng.integers(1, 9)))
        rows += [(int(c), int(t), ["user", "bot"][t % 2], "xyz"[int(rng.integers(0, 2 + (t > 3)))] * int(t + 1)) for t in turns]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("bits", [64, 3])
def test_random_conversations(spark, bits):
    rows = random_rows(bits, [0, *range(3, 40), *range(101, 125), 700, 707, 811, -5, -130, 10**12 + 3])
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert told(frame, bits=bits) == brute(rows)


def test_one_conversation_over_many_partitions(spark, request):
    rows = [(200, i, "user", f"{i % 3}") for i in range(150)] + [(c, i, "user", f"{i % 3}") for c in (204, 205) for i in range(7)] + [(301, i, "a", "b") for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    values = turntrie._known_turns(frame.withColumn("n_chars", F.lit(1).cast("long")), 64).select(F.col("conv_id").alias("group"), "turn", F.lit(1).cast("long").alias("value"))
    numbered = turntrie.scan(values, F.col("turn"), base=1)
    assert values.repartitionByRange("group", "turn").select(F.spark_partition_id().alias("p"), "group").filter("group = 200").select("p").distinct().count() > 1
    assert numbered.filter("pos != turn OR run != pos + 1").count() == 0
    assert told(frame) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "a", "b"), (1, None, None, None), (1, None, None, None), (1, 2, "user", ""), (2, 5, "", "é☃\U0001f600" * 9), (3, 1, "user", "w " * 100_000), (103, 1, "user", "w " * 100_000), (104, 1, "x", None), (104, 1, "x", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = "node parent depth content group value pos run part seq n_convs last h m head own_run length back mixed up digest saved leaf base first n".split()
    assert told(frame.withColumns({c: F.lit("x") for c in clash})) == brute(rows)
    assert told(frame.limit(0)) == [] == told(frame.filter("conv_id IS NULL"))
    # all turns go to a base that is not there: only the root is left
    gone = next(c for c in range(901, 999) if crc32(str(c).encode()) % 6 > 1)
    assert told(spark.createDataFrame([(gone, 1, "a", "b")], SCHEMA)) == [repr((gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest()))]


def test_long_lists_of_ends(spark):
    rows = [(c, 0, "user", "hello") for c in range(10_000)]
    assert told(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_query_matches_sql(spark, same_rows):
    same_rows(queries.op11_prefix_trie(spark, SMALL), queries.ORACLES["op11_prefix_trie"])
