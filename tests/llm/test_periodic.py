import hashlib
import re
import time
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreflow.llm import periodic, queries
from tests.conftest import SMALL

from .conftest import ODD


def brute_runs(w, least=12):
    """(start, length, period) by comparing all words with those each distance further on."""
    runs = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                runs.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in runs.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(8))
def test_random_words(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        docs = []
        for _ in range(rng.integers(1, 6)):
            d = list(rng.integers(0, rng.integers(1, 4), rng.integers(0, 60)))
            if d and rng.random() < 0.5:
                d += d[: rng.integers(1, len(d) + 1)] * rng.integers(1, 5)
            docs.append(d)
        at = np.r_[0, np.cumsum([len(d) for d in docs])]
        got = periodic.maximal_runs(np.concatenate(docs).astype(np.int64), at)
        want = [(s + at[k], s + m + at[k], q) for k, d in enumerate(docs) for s, m, q in sorted(brute_runs(d), key=lambda r: (r[0], r[2]))]
        assert got.tolist() == [list(map(int, r)) for r in want]


def test_odd_texts(docs):
    lines = ["to be or not " * 4, "\r\n x  " + "a\tb " * 9 + "\x0b", "A a " * 8, " ".join(f"w{i % 7}" for i in range(20)), "é é " * 6 + "\x1c \x85"]
    texts = [*ODD, *lines, *["again and again we " * 5] * 2]
    frame = docs(texts, ids=[*range(len(texts) - 2), 70, 70], extra=True)
    got = sorted(map(tuple, periodic.runs_digest(frame).collect()))
    assert len(got) == len(texts)
    by_id = {r[0]: r for r in got}
    for i, t in zip([*range(len(texts) - 2), 70, 70], texts, strict=True):
        if len(t or "") < 10**5:
            assert by_id[i] == brute_row(i, t), (i, t)
    assert by_id[len(ODD) - 1][1:6] == (1, 0, 40000, 1, 40_000_000)
    assert periodic.runs_digest(frame.limit(0)).count() == 0
    (none,) = periodic.runs_digest(docs(["x y " * 10]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert none.doc_id is None and (none.n_runs, none.start, none.length, none.period) == (1, 0, 20, 2)


def test_collapsed_text_and_general_interface(docs):
    frame = docs(["say it again and again and again and again and again and again and end", "a b c"]).withColumnRenamed("text", "body").withColumnRenamed("doc_id", "id")
    rows = {r.doc_id: r for r in periodic.periodic_runs(frame, "id", "body", least=8).collect()}
    assert [tuple(x) for x in rows[0].runs] == [(2, 12, 2)] and rows[0].collapsed == "say it again and end" and rows[0].n_words == 15
    assert rows[1].runs == [] and rows[1].collapsed == "a b c"


@pytest.mark.parametrize("kind", ["one word", "two words", "fibonacci", "thirds"])
def test_long_texts_in_time(kind):
    n = 200_000
    words = {"one word": lambda: np.zeros(n, np.int64), "two words": lambda: np.arange(n) % 2, "thirds": lambda: np.tile(np.random.default_rng(1).integers(0, 3000, n // 3 + 1), 3)}
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        ids = np.array(b)
    else:
        ids = words[kind]()
    began = time.time()
    runs = periodic.maximal_runs(ids, np.array([0, len(ids)]))
    assert time.time() - began < 10
    assert len(runs) == 1 if kind != "fibonacci" else len(runs) > 1000


def test_query_matches_sql(spark, same_rows):
    same_rows(queries.op13_periodic_runs(spark, SMALL), queries.ORACLES["op13_periodic_runs"])
