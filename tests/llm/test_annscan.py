import numpy as np
import pytest
from pyspark.sql import functions as F

from acreflow.llm import annscan, queries
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>"
ASKED = "vec_id % 50 = 0"


def brute(rows, k=5, every=50):
    """query -> its k nearest (id, cosine) by comparing it with all others."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i] / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def told(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def agrees(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def frame_of(spark, rows):
    return spark.createDataFrame([(int(i), [float(c) for c in np.asarray(v, np.float32)]) for i, v in rows], SCHEMA)


def test_all_lists_and_a_shared_vector(spark):
    rng = np.random.default_rng(3)
    same = rng.standard_normal(24)
    rows = [(i, same if i % 3 == 0 else same * 2 if i % 31 == 0 else rng.standard_normal(24)) for i in range(600)]
    rows = [(i, v * (10 if i % 7 == 0 else 1)) if i % 3 else (i, v) for i, v in rows]
    agrees(told(annscan.nearest_neighbours(frame_of(spark, rows), ASKED, lists=5, probes=5)), brute(rows))


def test_recall_on_groups_and_on_noise(spark):
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((30, 48)) * 2
    for rows, most in (([(i, middles[i % 30] + rng.standard_normal(48)) for i in range(4000)], 0.5), ([(i, rng.standard_normal(48)) for i in range(4000)], 1.0)):
        got, want = told(annscan.nearest_neighbours(frame_of(spark, rows), ASKED)), brute(rows)
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
        index = annscan.Lists(np.array([v for _, v in rows]), 4000, 5)
        assert index.probes <= most * len(index.centres)


def test_candidates_are_abandoned_early():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((300, 256)), 10, axis=0) + 0.5 * rng.standard_normal((3000, 256))
    q = x[:400:10] + 0.5 * rng.standard_normal((40, 256))
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
    qi, xi, read = annscan.adaptive_scan(q, x, np.full(40, np.inf), 5)
    assert read < 0.4 * 40 * 3000 * 256
    distance = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    left = set(zip(qi.tolist(), xi.tolist(), strict=True))
    best = {(i, int(j)) for i in range(40) for j in np.argsort(distance[i])[:5]}
    assert len(best & left) >= 0.97 * len(best)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [0.0, 3e38]), (8, [1e-38, 1e-38]), (-100, [-2.0, 1.0])]
    bad = [(None, [1.0, 2.0]), (100, None), (150, []), (200, [0.0, 0.0]), (250, [nan, 1.0]), (300, [1.0, inf]), (350, [None, 1.0]), (400, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(good + bad, SCHEMA)
    clash = "v k1 k2 list block chunk cell kind ids bound score rank r query_id blocks chunks label".split()
    got = told(annscan.nearest_neighbours(frame.withColumns({c: F.lit("x") for c in clash}), ASKED))
    agrees(got, brute([*good[:2], *good[3:]]))
    assert told(annscan.nearest_neighbours(frame.limit(0), ASKED)) == {} == told(annscan.nearest_neighbours(frame, F.col("vec_id") == 1))
    assert told(annscan.nearest_neighbours(frame.filter("vec_id = 0"), ASKED)) == {}
    wide = spark.createDataFrame([(i, [float(i * j % 11) for j in range(3)]) for i in range(1, 60)], "vec_id int, embedding array<double>")
    assert all(len(v) == 5 for v in told(annscan.nearest_neighbours(wide, F.col("vec_id") % 5 == 0, lists=20, probes=1)).values())


def test_query_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got, want = told(queries.op12_adaptive_neighbours(spark, SMALL)), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    x = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(x[q] @ x[i] / np.sqrt((x[q] @ x[q]) * (x[i] @ x[i]))), abs=1e-14)
