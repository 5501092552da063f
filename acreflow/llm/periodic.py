"""Periodic runs of words: Stoye and Gusfield's branching tandem repeats on a suffix tree.

1. Texts are taken in pieces of about a megabyte.  The suffixes of each
   document are sorted by doubling: what the first words tell apart is never
   touched again.  The ranks of each doubling give the common prefixes of
   neighbours, and these the tree: an inner node is an interval of the sorted
   suffixes between two smaller values, its children lie between equal ones.
2. For each node of depth q, the leaves of all children but the largest (the
   smaller halves) are looked at: if the suffix q words further on, or q words
   back, is a leaf of the same node under another child, the first of the two
   begins a branching tandem repeat of period q.
3. A run ends where its branching repeat ends.  The repeat is rotated to the
   left while the words agree; repeats that then cover the same words are one
   run, with the least period.

A leaf is looked at once for each node above it in whose larger half it is
not, so at most log n times; all steps are numpy over whole pieces.

Defined results: a null or empty text, or one of blanks alone, has no words and
no runs and collapses to the empty string; repeated rows have equal results;
texts of any length are taken whole, in a task that holds one of them; an empty
table gives an empty table; other columns are ignored, whatever their names.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .textvec import buffers, mix64, pieces, spans, word_hashes

MIN_LENGTH = 12
BLANKS = "[\\x20\\x09-\\x0D]+"
RUN = "struct<start:long,length:long,period:long>"
_EXACT = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffixes(key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order and, for each doubling, their ranks by so many first words.

    ``key`` holds an integer for each word that no other document has, ``end``
    the end of its document.  Ranks have one more entry, which equals no rank.
    """
    n = len(key)
    order = np.argsort(key)
    slots, by, levels, k = np.arange(n), key[order], [], 0
    rank = np.full(n + 1, -1)
    while True:
        new = np.r_[True, by[1:] != by[:-1]] if len(by) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(by)])
        rank = rank.copy()
        rank[order[slots]] = np.repeat(slots[first], size)
        levels.append(rank)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return order, levels
        k = 1 << (len(levels) - 1)
        at = order[slots]
        after = np.minimum(at + k, n)
        by = rank[at] * (n + 1) + np.where(after < end[at], rank[after] + 1, 0)
        turn = np.argsort(by)
        order[slots], by = at[turn], by[turn]


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """[n + 1] words that a suffix shares with the one before it in order; 0 at both ends."""
    out = np.zeros(len(order) + 1, np.int64)
    near = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    x, y = order[near - 1], order[near]
    shared = np.zeros(len(near), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        step = np.where(levels[j][x] == levels[j][y], 1 << j, 0)
        x, y, shared = x + step, y + step, shared + step
    out[near] = shared
    return out


def _smaller(values: np.ndarray, way: int) -> np.ndarray:
    """For each positive value the place of the nearest smaller one before (way -1) or after it (1)."""
    to = np.arange(len(values)) + way
    todo = np.flatnonzero(values > 0)
    while len(todo):
        on = to[todo]
        more = values[on] >= values[todo]
        todo, on = todo[more], on[more]
        to[todo] = to[on]
    return to


def branching_repeats(order: np.ndarray, rank: np.ndarray, shared: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of each branching tandem repeat; some are given twice."""
    n = len(order)
    cut = np.flatnonzero(shared > 0)
    if not len(cut):
        return cut, cut
    left, right = _smaller(shared, -1)[cut], _smaller(shared, 1)[cut]
    turn = np.argsort(left * (n + 2) + right, kind="stable")
    cut, left, right = cut[turn], left[turn], right[turn]
    new = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]
    first = np.flatnonzero(new)
    nodes = len(first)
    node = np.cumsum(new) - 1
    last = np.r_[first[1:], len(cut)] - 1
    # the children of a node lie between its left end, its cuts and its right end
    of = np.arange(len(cut)) + node
    lo, hi = np.empty(len(cut) + nodes, np.int64), np.empty(len(cut) + nodes, np.int64)
    lo[of + 1], hi[of] = cut, cut
    heads = first + np.arange(nodes)
    lo[heads], hi[last + np.arange(nodes) + 1] = left[first], right[first]
    children = np.diff(np.r_[heads, len(lo)])
    size = hi - lo
    largest = np.flatnonzero(size == np.repeat(np.maximum.reduceat(size, heads), children))
    parent = np.repeat(np.arange(nodes), children)
    small = np.ones(len(lo), bool)
    small[largest[np.r_[True, parent[largest][1:] != parent[largest][:-1]]]] = False
    lo, hi, size, parent = lo[small], hi[small], size[small], parent[small]
    leaf = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    depth = np.repeat(shared[cut[first]][parent], size)
    i = order[leaf]
    starts, periods = [], []
    for away, inside in ((depth, i + depth < end[i]), (-depth, i - depth >= begin[i])):
        some = np.flatnonzero(inside)
        other = rank[i[some] + away[some]]
        child = np.searchsorted(np.cumsum(size), some, "right")
        at = parent[child]
        fits = (other >= left[first][at]) & (other < right[first][at]) & ((other < lo[child]) | (other >= hi[child]))
        starts.append(np.minimum(i[some] + away[some], i[some])[fits])
        periods.append(depth[some][fits])
    return np.concatenate(starts), np.concatenate(periods)


def _rotated(ids: np.ndarray, begin: int, start: int, period: int) -> int:
    """The first word from which all words up to ``start`` equal those a period later."""
    step = 64
    while start > begin:
        lo = max(begin, start - step)
        differ = np.flatnonzero(ids[lo:start] != ids[lo + period : start + period])
        if len(differ):
            return lo + int(differ[-1]) + 1
        start, step = lo, step * 2
    return begin


def maximal_runs(ids: np.ndarray, at: np.ndarray, least: int = MIN_LENGTH) -> np.ndarray:
    """[runs, 3] first word, end and least period of the runs of all documents, in order; document d has words ``at[d]`` to ``at[d + 1]``.

    ``ids`` holds integers under 2 ** 32.
    """
    none = np.zeros((0, 3), np.int64)
    if not len(ids):
        return none
    counts = np.diff(at)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin, end = at[doc], at[doc + 1]
    order, levels = suffixes(doc << 32 | ids, end)
    start, period = branching_repeats(order, levels[-1], common_prefixes(order, levels), begin, end)
    for back in range(1, least - 1):  # most short repeats are no part of a run that is long enough
        need = 2 * period + back <= least
        go = np.flatnonzero(~need | (start - back >= begin[start]))
        start, period, need = start[go], period[go], need[go]
        go = ~need | (ids[start - back] == ids[start - back + period])
        start, period = start[go], period[go]
    found = np.unique(np.stack([start, period], 1), axis=0)
    if not len(found):
        return none
    found = found[np.lexsort((found[:, 1], found.sum(axis=1) + found[:, 1]))]  # by end and period
    runs, at_end, ended = [], -1, []
    for s, q in found.tolist():
        if s + 2 * q != at_end:
            at_end, ended = s + 2 * q, []
        if not any(q % p == 0 and f <= s for f, p in ended):  # else it lies in a run of a part of its period
            ended.append((_rotated(ids, int(begin[s]), s, q), q))
            runs.append((ended[-1][0], at_end, q))
    runs = np.array(runs, np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]]
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, 2 * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _joined(data: np.ndarray, first: np.ndarray, last: np.ndarray, keep: np.ndarray, at: np.ndarray) -> pa.Array:
    """The kept words of each document, with one space between them."""
    some = np.flatnonzero(keep)
    size = last[some] - first[some] + 1  # with the space
    ends = np.r_[0, np.cumsum(size)]
    source = np.repeat(first[some] - ends[:-1], size) + np.arange(ends[-1])
    out = np.empty(ends[-1] + 1, np.uint8)
    out[:-1] = data[np.minimum(source, max(len(data) - 1, 0))] if len(some) else 0
    out[ends[1:] - 1] = 32
    edge = ends[np.searchsorted(some, at)]
    # the space after a document's last word goes
    stay = np.ones(len(out), bool)
    stay[-1] = False
    full = edge[1:] > edge[:-1]
    stay[edge[1:][full] - 1] = False
    offsets = np.r_[0, np.cumsum(np.diff(edge) - full)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out[stay])])


def _batches(least: int):
    """mapInArrow: id, text -> id, n_words, runs, collapsed"""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in pieces(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                first, last, row = spans(part, off)
                ids = pa.array(word_hashes(part, first, last, _EXACT)).dictionary_encode().indices.to_numpy().astype(np.int64)
                at = np.searchsorted(row, np.arange(j - i + 1))
                runs = maximal_runs(ids, at, least)
                of = np.searchsorted(at, runs[:, 0], "right") - 1
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 1], -1)
                collapsed = _joined(part, first, last, np.cumsum(change[:-1]) == 0, at)
                columns = [pa.array(c) for c in (runs[:, 0] - at[of], runs[:, 1] - runs[:, 0], runs[:, 2])]
                each = pa.StructArray.from_arrays(columns, names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(j - i + 1)).astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), lists, collapsed.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words, by start and period) and
    collapsed, the words joined by one space without those that repeat a run's first period, of every row."""
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(_batches(least), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def with_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text: the words of each document whose id's crc32 divides by ten go round in a cycle from one word on; others stay, as do those without an id."""
    i = F.col(key).cast("long")
    h = F.crc32(i.cast("string"))
    g = F.floor(h / 10)

    def cycled(words: Column) -> Column:
        n = F.size(words).cast("long")
        return let(F.struct(words.alias("w"), n.alias("n"), (g % n).alias("a")), lambda x: let(F.floor((x["n"] - x["a"]) / (3 + g % 8)) + 1, lambda p: F.array_join(F.transform(x["w"], lambda w, k: F.when(k < x["a"], w).otherwise(F.get(x["w"], (x["a"] + (k - x["a"]) % p).cast("int")))), " ")))

    changed = let(_words(F.col(text)), lambda words: F.when(F.size(words) > 0, cycled(words)))
    return docs.select(i.alias("doc_id"), F.when(h % 10 == 0, changed).otherwise(F.col(text)).alias("text"))


def runs_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text, after ``with_tails``."""
    found = periodic_runs(with_tails(docs, key, text))
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    spelled = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    told = found.select("*", longest.alias("top"), F.sha2(spelled, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    length = -F.col("top.l")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", length.alias("length"), "top.period", F.floor(1000 * length / F.col("top.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
