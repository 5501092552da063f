"""Language identification by a byte convolutional network.

A text is cut into windows of a fixed number of bytes.  Filters of several
widths run over the bytes of a window, each filter's greatest response over
the window is kept (max pooling), and a softmax layer gives the languages'
probabilities.  A text's are the mean over all its windows, each weighed by
its letters.  The network is trained in numpy on windows from all over a
bounded sample of labelled texts; it is applied to whole texts in batches of
windows, so memory does not grow with a text's length.

In use, a filter of even width is a sum of table rows, one for each pair of
bytes, so a batch costs a gather and an addition for each filter and pair.

Defined results: ``und`` with score 0 for a null text or one without a letter;
with no labelled rows to learn from, every text is ``und``; labels are any
strings, as many as there are, null ones are not learned; of labels that are
equally likely the first in order is given; every row gives a row, repeated
rows and null ids too; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, fresh, materialize
from .textvec import buffers, pieces

WINDOW = 256
WIDTHS = {2: 16, 4: 16, 6: 8}  # bytes seen: filters
SAMPLE = 200  # labelled texts learned from, for each label
SAMPLE_ROWS = 3200  # of all labels together, where there are many; but one of each at least
SLICE = 2048  # windows looked at together
DIM, EPOCHS, BATCH, RATE, SEED = 12, 6, 64, 4e-3, 11


@dataclass
class Model:
    labels: list[str]
    tables: list[tuple[int, np.ndarray, np.ndarray]]  # width, [width / 2, filters, 65536] responses to byte pairs, bias
    weights: np.ndarray
    bias: np.ndarray


def window_counts(off: np.ndarray, size: int = WINDOW) -> np.ndarray:
    return -(-np.diff(off) // size)


def windows(data: np.ndarray, off: np.ndarray, row: np.ndarray, k: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """[windows, size] bytes of the k-th window of each row, zeros at the end of a text."""
    place = (off[row] + k * size)[:, None] + np.arange(size)
    inside = place < off[row + 1][:, None]
    return np.where(inside, data[np.minimum(place, len(data) - 1)], 0)


def train(x: np.ndarray, labels: list[str], seed: int = SEED) -> Model | None:
    """A network by minibatch Adam on labelled windows."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    known = {name: i for i, name in enumerate(names)}
    y = np.array([known[v] for v in labels])
    # short windows are learned as well, for short texts
    cut = rng.random(len(x)) < 0.25
    x = np.where((np.arange(WINDOW)[None, :] >= rng.integers(24, WINDOW, len(x))[:, None]) & cut[:, None], 0, x)
    widths, counts = list(WIDTHS), list(WIDTHS.values())
    total = sum(counts)
    p = [rng.normal(0, 0.5, (256, DIM)).astype(np.float32)]
    p += [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, c)).astype(np.float32) for w, c in zip(widths, counts, strict=True)]
    p += [np.zeros(c, np.float32) for c in counts]
    p += [rng.normal(0, total**-0.5, (total, len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    p[0][0] = 0
    m, v, step, k = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, len(widths)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            bx, by = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
            b = len(bx)
            emb = p[0][bx]
            cols, best, pooled = [], [], []
            for j, w in enumerate(widths):
                view = np.lib.stride_tricks.sliding_window_view(emb.reshape(b, -1), w * DIM, axis=1)[:, ::DIM]
                cols.append(view)
                resp = view.reshape(-1, w * DIM) @ p[1 + j] + p[1 + k + j]
                resp = resp.reshape(b, -1, counts[j])
                best.append(resp.argmax(axis=1))
                pooled.append(np.take_along_axis(resp, best[-1][:, None], axis=1)[:, 0])
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            drop = rng.random(hidden.shape) > 0.1
            hidden = hidden * drop
            logits = hidden @ p[-2] + p[-1]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            d = prob
            d[np.arange(b), by] -= 1
            d /= b
            grads = [np.zeros_like(a) for a in p]
            grads[-2], grads[-1] = hidden.T @ d, d.sum(axis=0)
            dh = (d @ p[-2].T) * (hidden > 0) * drop
            at, seen, pushed = 0, [], []  # bytes that the picked windows hold, and what their embeddings get
            for j, w in enumerate(widths):
                dj = dh[:, at : at + counts[j]]
                at += counts[j]
                picked = cols[j][np.arange(b)[:, None], best[j]]  # [b, filters, w * DIM]
                grads[1 + j] = np.einsum("bf,bfd->df", dj, picked)
                grads[1 + k + j] = dj.sum(axis=0)
                back = dj[:, :, None] * p[1 + j].T[None]  # [b, filters, w * DIM]
                seen.append(bx[np.arange(b)[:, None, None], best[j][:, :, None] + np.arange(w)].ravel())
                pushed.append(back.reshape(-1, DIM))
            place = np.concatenate(seen).astype(np.int64)[:, None] * DIM + np.arange(DIM)
            grads[0] += np.bincount(place.ravel(), np.concatenate(pushed).ravel(), 256 * DIM).reshape(256, DIM).astype(np.float32)
            grads[0][0] = 0
            step += 1
            for a, g, mm, vv in zip(p, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return _compiled(names, p, widths)


def _compiled(names: list[str], p: list[np.ndarray], widths: list[int]) -> Model:
    """Filters as tables over byte pairs."""
    tables, k = [], len(widths)
    for j, w in enumerate(widths):
        one = np.stack([p[0] @ p[1 + j][q * DIM : (q + 1) * DIM] for q in range(w)])  # [w, 256, filters]
        # the pair (b0, b1), little-endian, is b0 + 256 * b1
        pairs = [one[q + 1].T[:, :, None] + one[q].T[:, None, :] for q in range(0, w, 2)]
        tables.append((w, np.stack([x.reshape(x.shape[0], -1) for x in pairs]).astype(np.float32), p[1 + k + j]))
    return Model(names, tables, p[-2], p[-1])


def window_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """[windows, labels]"""
    n, size = x.shape
    pair = x[:, :-1].astype(np.uint16) | (x[:, 1:].astype(np.uint16) << 8)
    pair = np.ascontiguousarray(pair)
    pooled = []
    for w, table, bias in model.tables:
        span = size - w + 1
        at = [np.ascontiguousarray(pair[:, q : q + span]).astype(np.intp) for q in range(0, w, 2)]
        for f in range(len(bias)):
            total = table[0, f].take(at[0])
            for q in range(1, len(at)):
                total += table[q, f].take(at[q])
            pooled.append(total.max(axis=1) + bias[f])
    hidden = np.maximum(np.stack(pooled, axis=1), 0)
    # sums one after the other, so equal windows get equal values in any batch
    logits = np.zeros((n, len(model.bias)), np.float64)
    for i in range(hidden.shape[1]):
        logits += hidden[:, i, None].astype(np.float64) * model.weights[i].astype(np.float64)
    logits += model.bias
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_LETTERISH = np.zeros(256, bool)
_LETTERISH[65:91] = _LETTERISH[97:123] = _LETTERISH[0xC2:] = True


def text_probabilities(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[texts, labels]; a text's windows are added one after the other, so equal texts get equal values in any batch."""
    per = window_counts(off)
    end = np.cumsum(per)
    total, weights = np.zeros((len(per), len(model.labels))), np.zeros(len(per))
    for at in range(0, int(per.sum()), SLICE):
        which = np.arange(at, min(at + SLICE, int(end[-1])))
        row = np.searchsorted(end, which, "right")
        x = windows(data, off, row, which - (end - per)[row])
        weight = _LETTERISH[x].sum(axis=1) + 1e-3
        np.add.at(total, row, window_probabilities(model, x) * weight[:, None])
        np.add.at(weights, row, weight)
    return total / np.maximum(weights, 1e-9)[:, None]


def predict_batches(model: Model | None, text_at: int, names: list[str]):
    """mapInArrow: all columns, the text at ``text_at`` -> all columns, label and score"""

    def run(batches):
        for batch in batches:
            text = batch.column(text_at)
            data, at = buffers(text)
            labels: list[str] = []
            scores = np.zeros(len(batch))
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            for i, j in pieces(at, 1 << 19):
                if model is None:
                    labels += ["und"] * (j - i)
                    continue
                total = text_probabilities(model, data[at[i] : at[j]], at[i : j + 1] - at[i])
                top = total.argmax(axis=1)
                ok = lettered[i:j]
                labels += [model.labels[t] if k else "und" for t, k in zip(top.tolist(), ok.tolist(), strict=True)]
                scores[i:j] = np.where(ok, np.minimum(total[np.arange(j - i), top], 1.0), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores)], names=names)

    return run


def all_windows(batches):
    """mapInArrow: hash, label, text -> hash, label, place, window of all windows of a text"""
    for batch in batches:
        data, off = buffers(batch.column(2))
        per = window_counts(off)
        row = np.repeat(np.arange(len(per)), per)
        step = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        for at in range(0, len(row), SLICE):
            r, k = row[at : at + SLICE], step[at : at + SLICE]
            x = windows(data, off, r, k)
            of = pa.array(r)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(k), pa.array([w.tobytes() for w in x], pa.binary())], names=["h", "l", "k", "w"])


def learn(labelled: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE, rows: int = SAMPLE_ROWS) -> Model | None:
    """A network from all windows of about ``sample`` texts of each label, fewer if there are more than ``rows / sample`` labels.

    The sample is those rows whose hash is under a threshold set from the
    label's count, and each label's row of the least hash, so about ``rows``
    texts, or one for each label, bound it whatever the size of the table;
    repeated rows count once.  Only windows reach the driver.
    """
    hashed = F.pmod(F.xxhash64(F.lit(29), "k", "t"), F.lit(1 << 60))
    known = labelled.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l")).filter("l IS NOT NULL").withColumn("h", F.when(F.length("t") > 0, hashed))
    counts = materialize(known.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")))
    n_labels = counts.count()
    if not n_labels:
        return None
    each = min(sample, rows / n_labels)
    some = known.join(broadcast_if_small(counts), "l").filter((F.col("h") == F.col("least")) | (F.col("h") < F.lit(each * float(1 << 60)) / F.col("n")))
    found = some.groupBy("h", "l").agg(F.min("t").alias("t")).mapInArrow(all_windows, "h long, l string, k long, w binary")
    got = found.orderBy("h", "l", "k", "w").collect()
    if not got:
        return None
    return train(np.frombuffer(b"".join(r["w"] for r in got), np.uint8).reshape(len(got), WINDOW), [r["l"] for r in got])


def held_out(key: str):
    """Whether a key's remainder of crc32 by 5 is 0: these rows are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_language(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns, in order, and two more at the end: the language and its score, named as given or, if such a
    name is taken, as ``fresh`` says; learns from the rows that aren't held out."""
    pred, score = fresh(docs, pred, score)
    model = learn(docs.filter(~held_out(key)), key, text, label)
    names = [*docs.columns, pred, score]
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    # bounded by the network's sizes and the labels; as a dict, for plain pickling
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def run(batches):
        return predict_batches(Model(**shared.value) if shared.value else None, names.index(text), names)(batches)

    return docs.mapInArrow(run, schema)


def language_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("lang"))
    return with_language(plain).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
