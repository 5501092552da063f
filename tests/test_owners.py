"""Segment index, greedy groups and ranks against plain versions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreflow.operators import owners, ranking


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i + 1]
    for j, y in enumerate(b):
        out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
    return out


def variants(rng, name, n):
    """Names some edits away."""
    out = []
    for _ in range(n):
        w = list(name)
        for _ in range(rng.integers(1, 9)):
            i = int(rng.integers(0, len(w) + 1))
            kind = rng.integers(0, 3)
            if kind == 0:
                w.insert(i, "ABCDE"[rng.integers(0, 5)])
            elif w and i < len(w):
                w[i : i + 1] = [] if kind == 1 else ["XYZ"[rng.integers(0, 3)]]
        out.append("".join(w))
    return out


@pytest.mark.parametrize("many", [0, 10**9])
def test_pairs_equal_brute_force(spark, many):
    rng = np.random.default_rng(2)
    names = ["AL SMITH", "A SMITH", "SMITH", " BO SMITH ", "BO SMITH", "CHRISTOPHER JAMES SMITH", "X", "", None]
    for base in ("JONATHAN ALEXANDER", "MARY ELIZABETH ANN", "FRED", "THE ESTATE OF WILLIAM HENRY"):
        names += [f"{v.strip()} {s}" for s in ("SMITH", "LEE") for v in variants(rng, base, 9)]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = {(r.a, r.b): r.distance for r in owners.name_pairs(frame, "n", many=many).collect()}
    plain = sorted({n.strip() for n in names if n is not None})
    last = lambda n: n.split()[-1] if n else ""
    want = {(a, b): edits(a, b) for i, a in enumerate(plain) for b in plain[i + 1 :] if last(a) == last(b)}
    assert got == {k: d for k, d in want.items() if d <= 6} and len(got) > 50


def test_candidates_in_proportion(spark):
    """One surname holds half of all names: the candidates are few beside the pairs of lengths alike."""
    word = lambda seed, n: F.substring(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), 1, n)
    names = spark.range(3000).select(F.concat_ws(" ", word("a", 14), word("b", 13), F.when(F.col("id") % 2 == 0, "SMITH").otherwise(word("c", 8))).alias("n"))
    found = owners.candidate_pairs(names, "n").count()
    by_length = owners.candidate_pairs(names, "n", many=10**9).count()
    assert by_length >= 1500 * 1499 / 2 and found < by_length / 4


def sequential(pairs, order):
    near = {}
    for (a, b), c in pairs.items():
        near.setdefault(a, {})[b] = c
        near.setdefault(b, {})[a] = c
    done, groups = set(), []
    for i, n in enumerate(order):
        if n not in done:
            found = [(m, near[n][m]) for m in order[i + 1 :] if m not in done and m in near.get(n, {})]
            if found:
                groups.append((n, found))
                done |= {m for m, _ in found}
            done.add(n)
    return groups


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_the_sequential_ones(spark, seed):
    rng = np.random.default_rng(seed)
    order = [f"n{i}" for i in rng.permutation(60)]
    # a chain through all names, which needs the most rounds, and others
    pairs = {tuple(sorted((a, b))): 0.9 for a, b in zip(order[:12], order[1:13], strict=False)}
    for a, b in rng.integers(0, 60, (70, 2)):
        if a != b:
            pairs[tuple(sorted((f"n{a}", f"n{b}")))] = float(rng.choice([0.98, 0.92, 0.82]))
    frame = spark.createDataFrame([(*k, c) for k, c in pairs.items()], "a string, b string, confidence double")
    ranked = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, rank long")
    got = {r.head: ([tuple(m) for m in r.members], r.confidence) for r in owners.greedy_groups(frame, ranked).collect()}
    want = sequential(pairs, order)
    assert got.keys() == {h for h, _ in want}
    for head, found in want:
        assert got[head][0] == found and got[head][1] == pytest.approx(np.mean([c for _, c in found]))
    assert owners.greedy_groups(frame.limit(0), ranked).count() == 0


def test_ranks_cut_a_large_group(spark, request):
    rng = np.random.default_rng(1)
    rows = [(str(g) if g else None, int(v)) for g, v in zip(rng.choice(4, 4000, p=[0.1, 0.7, 0.1, 0.1]), rng.permutation(4000), strict=True)]
    frame = spark.createDataFrame(rows, "g string, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    got = Counter((r.g, r.v, r.rank) for r in ranking.ranks(frame, ["g"], [F.desc("v")]).collect())
    want = Counter()
    for g in {g for g, _ in rows}:
        want.update((g, v, i + 1) for i, v in enumerate(sorted((v for h, v in rows if h == g), reverse=True)))
    assert got == want
    parts = frame.repartitionByRange("g", F.desc("v")).withColumn("p", F.spark_partition_id()).filter("g = '1'").select("p").distinct().count()
    assert parts >= 3
    everything = ranking.ranks(frame, [], [F.asc("v")]).collect()
    assert all(r.rank == r.v + 1 for r in everything) and len(everything) == 4000
    assert ranking.ranks(frame.limit(0), ["g"], [F.desc("v")]).count() == 0
