"""Approximate nearest neighbours by cosine: inverted lists scanned with adaptive dimensions.

1. Equal vectors are one class, which keeps its least ids, as many as an answer
   can hold; so a vector that a third of all rows share is compared once.
2. Lists: spherical k-means on a bounded sample of classes (``SAMPLE``, chosen
   by hash); then every class goes to its nearest list.  How many lists a query
   probes is measured on that sample: so many of the nearest ones that they hold
   ``AIM`` of the true neighbours of sampled vectors among the sampled ones.
3. A list is cut into blocks of about ``BLOCK`` classes and its queries into
   chunks, and each block meets each chunk in one place of a sorted partition:
   a task holds one block and one batch of queries.
4. Adaptive dimension scan: unit vectors are rotated at random, so the first d of
   D dimensions hold a share of a squared distance that has mean d / D and
   variance 2 d (D - d) / (D * D * (D + 2)).  Block of columns after block, a candidate is
   abandoned when its part is too large for a distance under the query's bound:
   the hypothesis that it belongs to the answer is rejected at ``SIGMAS``.  The
   bound is the distance of enough of the sample, in probed lists, or of the list.
5. What is left is ranked by the cosine of the original vectors in double precision.

Defined results: rows whose id is null, or whose vector is null, empty, zero or
holds null or non-finite components take no part, nor do vectors of another
length than most have (of equally many the longer one).  Repeated rows are one
row; of several vectors with one id that of the least hash counts.  Ties go to
the smaller id.  With few rows all are found.  An empty table, or no query,
gives an empty table.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bounds of the fit: sampled classes, components of them, lists.
SAMPLE, SAMPLE_VALUES, LISTS = 32_768, 1 << 23, 1024
AIM, TUNED = 0.97, 256
BLOCK, CHUNK, PAIRS = 4096, 65_536, 1 << 18
COLUMNS, SIGMAS, SEED = 16, 3.0, 7


def _matrix(column: pa.Array) -> np.ndarray:
    """[n, D] of a list column without nulls; each row divided by a power of two, which changes no cosine."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    _, e = np.frexp(np.abs(rows).max(axis=1, initial=1e-300))
    return np.ldexp(rows, -e[:, None])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Lists:
    """Centroids, how many a query probes, a rotation and some sampled vectors, from a sample of vectors."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, lists: int | None = None, probes: int | None = None) -> None:
        x = _unit(sample)
        n, d = x.shape
        rng = np.random.default_rng(SEED)
        self.k, self.rotation = k, np.linalg.qr(rng.standard_normal((d, d)))[0]
        lists = max(1, min(lists or round(np.sqrt(rows) / 2), LISTS, n // 8))
        small = x.astype(np.float32)
        centres = small[rng.choice(n, lists, replace=False)]
        for _ in range(8):
            near = self._nearest(small, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, small)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
        self.centres = centres.astype(np.float64)
        self.some = x[rng.choice(n, min(n, BLOCK), replace=False)] if n > k else x
        self.some_home = self.home(self.some)
        self.probes = probes or self._tuned(x, rng)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def _tuned(self, x: np.ndarray, rng: np.random.Generator) -> int:
        """Lists to probe so that they hold AIM of the k nearest sampled vectors of some of them."""
        if len(self.centres) == 1 or len(x) <= self.k:
            return len(self.centres)
        own = self._nearest(x, self.centres)
        asked = rng.choice(len(x), min(len(x), TUNED), replace=False)
        place = np.argsort(np.argsort(-(x[asked] @ self.centres.T), axis=1), axis=1)
        near = x[asked] @ x.T
        near[np.arange(len(asked)), asked] = -2
        best = np.argpartition(-near, self.k, axis=1)[:, : self.k]
        needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return int(needed[int(np.ceil(AIM * len(needed))) - 1]) + 1

    def home(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x, self.centres)

    def probed(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and list: the nearest lists, and more of them until they hold enough classes for an answer."""
        order = np.argsort(-(x @ self.centres.T), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        yes = (np.arange(order.shape[1]) < self.probes) | (before <= self.k)
        q, at = np.nonzero(yes)
        return q, order[q, at]

    def bound(self, x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A squared distance within which the lists ``at`` that ``q`` probes hold k + 1 classes for sure, the query's own among them."""
        if len(self.some) <= self.k:
            return np.full(len(x), np.inf)
        probed = np.zeros((len(x), len(self.centres)), bool)
        probed[q, at] = True
        cosine = np.where(probed[:, self.some_home], x @ self.some.T, -np.inf)
        near = -np.partition(-cosine, self.k, axis=1)[:, self.k]
        return np.maximum(2 - 2 * near, 0) + 1e-9


def adaptive_scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int, step: int = COLUMNS, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of rows of ``q`` and ``x`` (rotated unit vectors) that are not abandoned, and how many components were read."""
    d_all = q.shape[1]
    d = min(step, d_all)
    part = (q[:, :d] ** 2).sum(axis=1)[:, None] + (x[:, :d] ** 2).sum(axis=1)[None] - 2 * q[:, :d] @ x[:, :d].T
    read = part.size * d
    some = min(len(x), 4 * (k + 1))
    # those that the first block shows near are read whole and give a bound; the best of them stay, so a wrong rejection leaves no answer short
    near = np.argpartition(part, some - 1, axis=1)[:, :some]
    whole = np.stack([((q - x[near[:, j]]) ** 2).sum(axis=1) for j in range(some)], axis=1)
    read += near.size * d_all
    best = np.take_along_axis(near, np.argsort(whole, axis=1)[:, : k + 1], axis=1) if len(x) > some else near
    if len(x) > k:
        bound = np.minimum(bound, np.partition(whole, k, axis=1)[:, k] + 1e-9)

    def most(d):
        share = d / d_all
        return min(1.0, share + sigmas * np.sqrt(2 * share * (1 - share) / (d_all + 2)))

    qi, xi = np.nonzero(part <= (bound * most(d))[:, None])
    so_far = part[qi, xi]
    while d < d_all:
        to = min(d + step, d_all)
        so_far = so_far + ((q[qi, d:to] - x[xi, d:to]) ** 2).sum(axis=1)
        read += len(qi) * (to - d)
        d = to
        go = so_far <= bound[qi] * most(d) + 1e-12
        qi, xi, so_far = qi[go], xi[go], so_far[go]
    pairs = np.union1d(qi * len(x) + xi, (np.arange(len(q))[:, None] * len(x) + best).ravel())
    return pairs // len(x), pairs % len(x), read


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]


class _Block:
    """The classes of one block of a list."""

    def __init__(self, lists: Lists) -> None:
        self.lists, self.vectors, self.ids, self.x = lists, [], [], None

    def add(self, vectors: pa.Array, ids: pa.Array) -> None:
        self.vectors.append(_matrix(vectors))
        self.ids.append(ids)

    def search(self, vectors: pa.Array, bound: np.ndarray):
        """Query, score and id: the k + 1 best rows of the block for each query."""
        if not self.vectors:
            return
        if self.x is None:
            self.whole = np.concatenate(self.vectors)
            self.norm = np.sqrt(np.einsum("ij,ij->i", self.whole, self.whole))
            self.x = (self.whole / self.norm[:, None]) @ self.lists.rotation
            self.flat, self.at = _offsets(pa.concat_arrays(self.ids))
        rows = _matrix(vectors)
        norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        q = (rows / norm[:, None]) @ self.lists.rotation
        some, k = max(1, PAIRS // len(self.x)), self.lists.k
        for i in range(0, len(q), some):
            qi, xi, _ = adaptive_scan(q[i : i + some], self.x, bound[i : i + some], k)
            qi = qi + i
            score = np.concatenate([np.einsum("ij,ij->i", rows[qi[j : j + PAIRS]], self.whole[xi[j : j + PAIRS]]) for j in range(0, len(qi), PAIRS)] or [np.zeros(0)]) / (norm[qi] * self.norm[xi])
            n = self.at[xi + 1] - self.at[xi]
            each = np.repeat(self.at[xi] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            qi, score, ids = np.repeat(qi, n), np.repeat(score, n), self.flat[each]
            turn = np.lexsort((ids, -score, qi))
            qi, score, ids = qi[turn], score[turn], ids[turn]
            first = np.searchsorted(qi, qi)
            best = np.arange(len(qi)) - first <= k
            yield qi[best], score[best], ids[best]


def _scan_batches(lists: Lists):
    """mapInArrow: cell, kind, k1, k2, ids, bound, v, by cell and kind (0 classes, 1 queries) -> k1, k2, vec_id, score"""

    def run(batches):
        cell, block = None, None
        for batch in batches:
            cells, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind"))
            cut = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1]), True][: len(cells) + 1]) if len(cells) else []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(i, j - i)
                if cells[i] != cell:
                    cell, block = cells[i], _Block(lists)
                if kinds[i] == 0:
                    block.add(part.column("v"), part.column("ids"))
                    continue
                for q, score, ids in block.search(part.column("v"), part.column("bound").to_numpy(zero_copy_only=False)):
                    own = pa.array(q)
                    yield pa.RecordBatch.from_arrays([part.column("k1").take(own), part.column("k2").take(own), pa.array(ids), pa.array(score)], names=["k1", "k2", "vec_id", "score"])

    return run


def _homes(lists: Lists):
    """mapInArrow: k1, k2, ids, v -> list and those"""

    def run(batches):
        for batch in batches:
            home = lists.home(_unit(_matrix(batch.column("v"))))
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int64)), *batch.columns], names=["list", *batch.schema.names])

    return run


def _probes(lists: Lists, sizes: np.ndarray):
    """mapInArrow: k1, k2, v -> list, bound and those, for each list that is probed"""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _unit(_matrix(part.column("v")))
                q, at = lists.probed(x, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(lists.bound(x, q, at)[q]), *[c.take(pa.array(q)) for c in part.columns]], names=["list", "bound", *part.schema.names])

    return run


def _counts(rows: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for at, count in rows.groupBy("list").count().collect():  # a row for each list
        out[at] = count
    return out


def usable_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, k1, k2 (a hash of the vector), v: one row for each id that takes part."""
    plain = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter("vec_id IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = plain.filter(finite & F.exists("v", lambda x: x != 0))
    length = plain.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    hashed = plain.filter(F.size("v") == (length["n"] if length else 0)).select("vec_id", F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2"), "v")
    each = hashed.groupBy("vec_id").agg(F.min_by(F.struct("k1", "k2", "v"), F.struct("k1", "k2")).alias("x"))
    return each.select("vec_id", "x.k1", "x.k2", "x.v")


def nearest_neighbours(vectors: DataFrame, asked: Column | str, k: int = 5, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found, other than itself, for each row whose ``asked`` (of ``vec_id``) is true."""
    one = materialize(usable_vectors(vectors, key, vector))
    queries = materialize(one.filter(asked).select("vec_id", "k1", "k2"))
    least = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = one.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k + 1)
    classes = materialize(few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")))
    rows, width = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    spark = vectors.sparkSession
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(64, min(SAMPLE, SAMPLE_VALUES // width))
    share = min(1.0, 0.9 * most / rows)
    sampled = classes.filter(F.pmod(F.xxhash64(F.lit(3), "k1", "k2"), F.lit(1 << 30)) < int(share * (1 << 30))).select("k1", "k2", "v").limit(most).toArrow()
    table = sampled.sort_by([("k1", "ascending"), ("k2", "ascending")])
    if not table.num_rows:  # of a few rows a hash may take none
        table = classes.select("k1", "k2", "v").limit(1).toArrow()
    index = Lists(_matrix(table.column("v").combine_chunks()), rows, k, lists, probes)

    n = len(index.centres)
    kind = dict(classes.dtypes)["v"]
    placed = materialize(classes.mapInArrow(_homes(index), f"list long, k1 long, k2 long, ids array<long>, v {kind}"))
    sizes = _counts(placed, n)
    wanted = classes.join(queries.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "v")
    probed = materialize(wanted.mapInArrow(_probes(index, sizes), f"list long, bound double, k1 long, k2 long, v {kind}"))
    # a row for each list
    cuts = spark.createDataFrame([(i, int(-(-a // BLOCK)) or 1, int(-(-b // CHUNK)) or 1) for i, (a, b) in enumerate(zip(sizes, _counts(probed, n), strict=True))], "list long, blocks long, chunks long")
    cut = lambda name: F.pmod(F.xxhash64(F.lit(4), "k1", "k2"), F.col(name))
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    cell = F.xxhash64("list", "block", "chunk").alias("cell")
    some = placed.join(F.broadcast(cuts), "list").withColumn("block", cut("blocks")).withColumn("chunk", each("chunks"))
    asks = probed.join(F.broadcast(cuts), "list").withColumn("chunk", cut("chunks")).withColumn("block", each("blocks"))
    some = some.select(cell, F.lit(0).alias("kind"), "k1", "k2", "ids", F.lit(0.0).alias("bound"), "v")
    asks = asks.select(cell, F.lit(1).alias("kind"), "k1", "k2", F.array().cast("array<long>").alias("ids"), "bound", "v")
    met = some.union(asks).repartition("cell").sortWithinPartitions("cell", "kind")
    found = met.mapInArrow(_scan_batches(index), "k1 long, k2 long, vec_id long, score double")
    of_class = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("r", F.row_number().over(of_class)).filter(F.col("r") <= k + 1).drop("r")
    answers = queries.select(F.col("vec_id").alias("query_id"), "k1", "k2").join(best, ["k1", "k2"]).filter("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
