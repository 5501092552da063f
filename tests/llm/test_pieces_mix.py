import math
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acreflow.llm import mixing, pieces

from .conftest import ODD


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(pieces.load_vocabulary(), 1.0)


def test_round_trip(docs, sample):
    frame = docs(ODD, extra=True)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame)).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert pieces.encoding_digest(sample).filter("NOT lossless").count() == 0
    assert pieces.encode(frame.limit(0)).count() == 0


def test_same_in_any_partitioning(sample):
    a = {r.doc_id: r.pieces_sha256 for r in pieces.encoding_digest(sample.repartition(7)).collect()}
    b = {r.doc_id: r.pieces_sha256 for r in pieces.encoding_digest(sample.coalesce(1)).collect()}
    assert a == b
    assert a != {r.doc_id: r.pieces_sha256 for r in pieces.encoding_digest(sample, seed=6).collect()}


def test_exact_distribution(lattice):
    vocabulary = pieces.load_vocabulary()
    ids = {t: i for i, t in enumerate(vocabulary["text"]) if t}
    data, weights = b" thing", {}

    def walk(at, path, w):
        if at == len(data):
            weights[tuple(path)] = w
        for to in range(at + 1, len(data) + 1):
            if (i := ids.get(data[at:to])) is not None:
                walk(to, [*path, i], w + lattice.logw[i])

    walk(0, [], 0.0)
    total, n = sum(map(math.exp, weights.values())), 30000
    got, off = pieces.encode_texts(lattice, np.frombuffer(b"thing" * n, np.uint8), np.arange(n + 1) * 5, np.arange(n, dtype=np.uint64))
    counts = Counter(tuple(got[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True))
    assert set(counts) <= set(weights)
    assert max(abs(counts[k] / n - math.exp(w) / total) for k, w in weights.items()) < 0.015


def test_long_texts_in_parts_and_long_words(lattice):
    """Parts of a text give the pieces of the whole; a long word is sampled as short ones are, in time in proportion."""
    rng = np.random.default_rng(3)
    seeds = np.arange(1, 2, dtype=np.uint64)
    encode = lambda raw, first=0: pieces.encode_texts(lattice, raw, np.array([0, len(raw)]), seeds, first)[0]
    raw = np.frombuffer("  the  old\n\nman é☃ and the sea\n ".encode() * 400 + b"x" * 3000 + b" end", np.uint8)
    cuts = pieces.word_parts(raw, 500)
    assert len(cuts) > 20 and max(np.diff(cuts)) < 3600
    assert np.array_equal(encode(raw), np.concatenate([encode(raw[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
    word = rng.choice(np.frombuffer("etaoinshrdlué".encode(), np.uint8), 3 * pieces.LONG)
    word = np.frombuffer(word.tobytes().decode(errors="ignore").encode(), np.uint8)
    long = encode(word)
    limit, pieces.LONG = pieces.LONG, len(word) + 2
    try:
        assert np.array_equal(long, encode(word))
    finally:
        pieces.LONG = limit
    began = time.process_time()
    line = rng.choice(np.frombuffer(b"etaoinshrdlu", np.uint8), 1 << 19)
    back, _ = lattice.decode(encode(line), np.array([0]))
    assert back[1:].tobytes() == line.tobytes() and time.process_time() - began < 15


def test_a_text_over_the_limit_of_a_part(docs, monkeypatch):
    text = "a word and\nanother é " * 9000
    whole = pieces.encode(docs([text])).first().ids
    monkeypatch.setattr(pieces, "PART", 4096)
    batch = pa.RecordBatch.from_pydict({"k": [0], "t": [text], "s": [docs([text]).select(F.xxhash64(F.lit(pieces.SEED), "doc_id")).first()[0]]})
    ((_, _, ids, off, *_),) = pieces._parts(pieces.Lattice(pieces.load_vocabulary(), 1.0), batch)
    assert ids.tolist() == whole and off.tolist() == [0, len(whole)]


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        share = {s: rest * weight[s] / open_weight for s in order if s not in full}
        over = {s for s, x in share.items() if x > 2 * sizes[s] * (1 + 1e-12)}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in full}
        full |= over


def test_targets_and_taken(docs, sample):
    for frame in (sample, docs(["a b c"] * 50 + ["d e"] * 7 + ["x"] * 20 + [None, ""], sources=["s"] * 50 + [None] * 7 + ["t"] * 20 + ["empty", "empty"], extra=True)):
        rows = frame.select("doc_id", "source", "text").collect()
        size = {r.doc_id: len((r.text or "").split()) for r in rows}
        sizes = defaultdict(int)
        for r in rows:
            sizes[r.source] += size[r.doc_id]
        got = mixing.mix(frame).collect()
        assert {r.doc_id: r.size for r in got} == size
        source = {r.doc_id: r.source for r in rows}
        target = targets_by_hand(dict(sizes))
        taken, largest = defaultdict(int), defaultdict(int)
        for r in got:
            assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
            assert r.taken in (0, r.size, 2 * r.size)
            taken[source[r.doc_id]] += r.taken
            largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
        assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
        assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame.repartition(3)).collect()))


def test_mixed_rows(docs):
    frame = docs(["a b c"] * 30 + ["d"] * 10, sources=["s"] * 30 + ["t"] * 10, extra=True)
    taken = {r.doc_id: r.copies for r in mixing.mix(frame).collect()}
    rows = Counter(r.doc_id for r in mixing.mixed_documents(frame).collect())
    assert rows == Counter({k: v for k, v in taken.items() if v}) and mixing.mixed_documents(frame).columns == frame.columns


def test_mix_of_nothing(docs):
    assert mixing.mix(docs(["a"]).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs([None, ""])).collect()] == [0, 0]
    assert mixing.mix(docs(["a b"] * 3, ids=[None, None, 1])).agg(F.sum("taken")).first()[0] in (8, 10)
