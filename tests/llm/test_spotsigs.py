import hashlib

import pytest
from pyspark.sql import functions as F

from acreflow.llm import spotsigs

from .conftest import ODD


def brute(text):
    import re

    words = re.split(r"[^\w]+|_", text.lower())
    content, starts = [], []
    for w in words:
        if w in spotsigs.ANTECEDENTS:
            if not starts or starts[-1] != len(content):
                starts.append(len(content))
        else:
            content.append(w)
    while content and content[-1] == "":
        content.pop()
    return {tuple(content[i : i + 3]) for i in starts if i + 3 <= len(content)}


def likeness(a, b):
    """Jaccard similarity of the fingerprints of two texts; one without a chain has its words."""
    import re

    a, b = (brute(t) or {("words", *re.split(r"(?:[^\w]|_)+", t.lower()))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_signatures_are_the_chains(spark, sample):
    got = sample.select("text", spotsigs.signatures(F.col("text")).alias("s")).collect()
    assert all(len(r.s) == max(1, len(brute(r.text))) for r in got)
    pairs = [(got[i], got[j]) for i in range(20) for j in range(i)]
    for a, b in pairs:
        x, y = brute(a.text), brute(b.text)
        if x and y:
            assert len(set(a.s) & set(b.s)) == len(x & y)


def test_neighbours(docs, sample):
    for frame in (sample, docs(ODD, ids=[7, 3, 1, 9, 20, 21, 22, 40, 41], extra=True)):
        rows = sorted((r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect())
        got = {r.doc_id: r for r in spotsigs.neighbour_digest(frame).collect()}
        assert len(got) == len(rows)
        prints = {}
        for k, (i, text) in enumerate(rows):
            after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.near_edited, r.near_next) == pytest.approx((likeness(text, edited), likeness(text, after)))
            assert prints.setdefault(text, r.fingerprint) == r.fingerprint
            if edited == text:
                assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
            if after == text:
                assert r.near_next == 1


def test_null_ids_repeats_and_nothing(docs):
    got = spotsigs.neighbour_digest(docs(["the cat sat on mats", "the cat sat on mats", "b"], ids=[4, 4, None])).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 1), (4, 19), (4, 19)]
    got = spotsigs.neighbour_digest(docs(["the cat sat on mats", "of one two three", "b"], ids=[4, 4, 5])).collect()
    assert sorted((r.doc_id, r.n_chars, r.near_next) for r in got) == [(4, 16, 0.0), (4, 19, 0.0), (5, 1, 0.0)]
    assert spotsigs.neighbour_digest(docs(["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("percent", [75, 40])
def test_pairs_against_all_pairs(docs, sample, percent):
    base = [r.text for r in sample.limit(30).collect()]
    texts = base + [t.replace("the ", "the same ", 3) for t in base[:15]] + [t[: int(len(t) * 0.9)] for t in base[:15]] + base[:5]
    frame = docs(texts)
    sets = {r.doc_id: frozenset(r.s) for r in frame.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(first.values())
    want = {(a, b) for b in reps for a in reps if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in spotsigs.near_pairs(frame, percent=percent).collect()}
    assert want == got and want


def test_classes_against_sql(spark, same_rows):
    from acreflow.llm import queries

    same_rows(queries.spotsigs_classes(spark, "/root/testdata/sf0.001"), queries.ORACLES["spotsigs_classes"])


def test_classes_of_odd_texts(docs):
    frame = docs([*ODD, "the cat sat on mats", "the cat sat on mats", None], ids=[*range(9), 20, 21, None], extra=True)
    got = {r.doc_id: (r.class_id, r.n_links) for r in spotsigs.similar_documents(frame).collect()}
    assert set(got) == {*range(9), 20, 21} and got[21] == (20, 0) and got[6][0] == 5 and got[0][0] == got[1][0] == 0
    assert spotsigs.similar_documents(frame.limit(0)).count() == 0
