from collections import Counter

import corpus_pipeline
from acreflow.llm import common, pieces
from tests.conftest import SMALL

from . import brute
from .conftest import ODD


def test_stages_on_a_table(spark, sample):
    docs, seen = sample, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SMALL))
        seen[name] = docs
    first, lines, near, mixed, ids = seen.values()
    assert all(d.columns == sample.columns for d in (first, lines, near, mixed))
    assert sample.count() * 0.98 <= first.count() <= sample.count()
    rows = sorted((r.doc_id, r.text) for r in first.select("doc_id", "text").collect())
    kept = {i: k for (i, _), (_, _, k, _) in zip(rows, brute.line_dedup(rows), strict=True)}
    assert {r.doc_id: r.text for r in lines.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    parts = brute.near_components(kept)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in parts.items() if i == c}
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert ids.count() == mixed.count()
    assert all(r.text == texts[r.doc_id] for r in pieces.decode(ids).collect())


def test_odd_rows(spark, docs):
    frame = docs(ODD, langs=["en", "fr"] * 4 + ["en"], extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.materialize(stage(spark, frame, ""))
        assert "slot" in frame.columns
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs(["a"]).limit(0), "").count()
