import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from acreflow.llm import langid

from .conftest import ODD


def test_held_out_accuracy(spark, sample):
    got = langid.language_ids(sample).toPandas()
    true = sample.select("doc_id", "lang").toPandas().set_index("doc_id").lang
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = got[got.held_out]
    assert (held.lang_pred == held.doc_id.map(true)).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_odd_texts(docs):
    langs = ["en", None, "fr", "en", "fr", "en", "en", None, "en"]
    got = langid.language_ids(docs(ODD, langs=langs, extra=True)).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, True, False, False, False, False, True, False]
    assert got[0].score == 0 and got[5][2:] == got[6][2:]


def test_nothing_to_learn_from(docs):
    assert [r.lang_pred for r in langid.language_ids(docs(["a b", None], langs=[None, None])).collect()] == ["und", "und"]
    assert langid.language_ids(docs(["a"]).limit(0)).count() == 0


def test_predictions_ignore_keys_and_batches(docs):
    text = ["the of and to", "le la les des", "the that with"] * 6
    frame = docs(text, langs=["en", "fr", "en"] * 6)
    got = langid.language_ids(frame.repartition(5)).toPandas().set_index("doc_id").sort_index()
    assert got.score.round(12).groupby([t for t in text]).nunique().max() == 1


def plain_probabilities(names, p, widths, window):
    """A window's probabilities by the network's definition, one filter and place at a time."""
    hidden = []
    for j, w in enumerate(widths):
        for f in range(p[1 + j].shape[1]):
            hidden.append(max(float(np.concatenate([p[0][b] for b in window[i : i + w]]) @ p[1 + j][:, f]) for i in range(len(window) - w + 1)) + float(p[1 + len(widths) + j][f]))
    logits = np.maximum(hidden, 0) @ p[-2].astype(float) + p[-1]
    e = np.exp(logits - logits.max())
    return e / e.sum()


def test_tables_against_a_plain_convolution():
    rng = np.random.default_rng(4)
    widths, counts, dim = [2, 4, 6], [3, 2, 2], langid.DIM
    p = [rng.normal(size=(256, dim))] + [rng.normal(size=(w * dim, c)) for w, c in zip(widths, counts, strict=True)] + [rng.normal(size=c) for c in counts] + [rng.normal(size=(7, 3)), rng.normal(size=3)]
    p = [a.astype(np.float32) for a in p]
    x = rng.integers(0, 256, (6, 40)).astype(np.uint8)
    got = langid.window_probabilities(langid._compiled(["a", "b", "c"], p, widths), x)
    assert np.allclose(got, [plain_probabilities("abc", p, widths, w) for w in x], atol=1e-4)


def test_texts_are_means_of_all_their_windows():
    rng = np.random.default_rng(1)
    model = langid.train(rng.integers(97, 123, (60, langid.WINDOW)).astype(np.uint8), ["a", "b", "c"] * 20)
    raw = [bytes(rng.integers(32, 123, n).astype(np.uint8)) for n in (1, 255, 256, 257, 700, 3 * langid.SLICE * langid.WINDOW // 2)]
    off = np.r_[0, np.cumsum([len(r) for r in raw])]
    got = langid.text_probabilities(model, np.frombuffer(b"".join(raw), np.uint8), off)
    for r, row in zip(raw, got, strict=True):
        parts = [r[i : i + langid.WINDOW] for i in range(0, len(r), langid.WINDOW)]
        x = np.array([np.frombuffer(w.ljust(langid.WINDOW, b"\0"), np.uint8) for w in parts])
        weight = np.array([sum(chr(b).isalpha() for b in w) for w in parts]) + 1e-3
        assert np.allclose(row, (langid.window_probabilities(model, x) * weight[:, None]).sum(axis=0) / weight.sum())


def test_as_many_labels_as_there_are(docs):
    rng = random.Random(6)
    words = {f"l{k:02d}": ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=2) + rng.choices("aeiouy", k=1) + rng.choices("bcdfghjklmnpqrstvwxz", k=2)) for _ in range(12)] for k in range(80)}
    langs = [label for label in words for _ in range(25)]
    got = langid.language_ids(docs([" ".join(rng.choices(words[v], k=40)) for v in langs], langs=langs)).filter("held_out").collect()
    assert len({r.lang_pred for r in got}) > 64 and sum(r.lang_pred == langs[r.doc_id] for r in got) > 0.9 * len(got)


def test_windows_are_learned_from_all_of_a_text():
    import pyarrow as pa

    text = "".join(f"{i:08d}" for i in range(32 * 40))
    batch = pa.RecordBatch.from_pydict({"h": [1, 2, 3], "l": ["a", "b", "c"], "t": [text, "short", None]})
    got = [r for b in langid.all_windows([batch]) for r in b.to_pylist()]
    assert [r["k"] for r in got] == [*range(40), 0]
    assert all(r["w"] == text[r["k"] * 256 : r["k"] * 256 + 256].encode() for r in got[:40])


def test_the_sample_is_bounded_and_holds_every_label(docs, monkeypatch):
    """Of rows of many labels one each, of copies one, and of a few labels about the wanted number."""
    seen = []
    monkeypatch.setattr(langid, "train", lambda x, labels: seen.append(labels))
    frame = docs([f"text number {i}" for i in range(3000)] + ["the same"] * 500, ids=[*range(3000), *[9000] * 500], langs=[f"l{i % 1000}" for i in range(3000)] + ["l0"] * 500)
    langid.learn(frame, "doc_id", "text", "lang", rows=100)
    langid.learn(frame.withColumn("lang", F.lit("en")), "doc_id", "text", "lang", sample=300, rows=300)
    assert set(seen[0]) == {f"l{i}" for i in range(1000)} and len(seen[0]) < 1300
    assert 200 < len(seen[1]) < 400


def test_names_that_are_taken(spark, docs):
    frame = docs(["the cat and the dog", "le chat et le chien"], langs=["en", "fr"]).selectExpr("*", "'x' AS lang_pred", "'y' AS SCORE", "1 AS __lang_pred")
    assert langid.with_language(frame).columns == [*frame.columns, "_lang_pred", "_score"]
