"""The trie of conversations: each distinct sequence of first turns is a node.

1. A turn is known by a 64-bit hash of role and text, which is compared with
   all that share it (the least and the greatest of a hash are equal); what
   differs is hashed anew.
2. Turns are range-partitioned and sorted by conversation and turn, so one
   conversation may be cut over many tasks.  A numpy scan along each partition
   gives every turn its number and the rolling polynomial fingerprint of all
   turns up to it; a conversation that goes on in the next partition is carried
   over by one row for each partition.
3. Equal fingerprints are candidates for one node.  Each group is verified turn
   by turn against its representative, the least conversation: depth, last turn
   and the node above must be the representative's.  Collisions are split by new
   names until nothing differs.
4. Roll-up without a walk along the depths: each node belongs to its least
   conversation, whose nodes are the lower end of its path.  What a
   conversation brings to a node above is the sum over all nodes it owns, and
   for the node's own conversation the sum from that node on.

Only the root's row is made in the driver, of sums.  No step collects a group: counts and sums are aggregated before they are
shuffled, and the digest of the conversations that end in one node is fed from
sorted rows in chunks.

Defined results: rows without a conversation id are ignored; a null role or
text is empty; a null turn comes first; rows with equal turn numbers follow each
other by the hash of role and text, repeated rows are repeated turns; texts
count whole; an empty table has no node, not even the root; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textvec import mix64

#: Base of the polynomial, odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C1B
INVERSE = pow(BASE, -1, 1 << 64)
HEAD_MOST = 5
CHUNK = 4096
_NOTHING = hashlib.sha256().hexdigest()


def power(base: int, e: np.ndarray) -> np.ndarray:
    """base ** e modulo 2 ** 64"""
    out, e = np.ones(len(e), np.uint64), e.astype(np.uint64)
    square = np.full(1, base, np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * square, out)
        e, square = e >> np.uint64(1), square * square
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _local_scan(base: int):
    """mapInArrow: group, value (sorted by group) and other columns -> those, part, seq, pos and run.

    ``pos`` counts a group's rows in this partition from 0, ``run`` is the sum of
    value * base ** pos over them up to this row, modulo 2 ** 64.
    """
    from pyspark import TaskContext

    def run(batches):
        part, seq, last, count, total = TaskContext.get().partitionId(), 0, None, 0, np.uint64(0)
        for batch in batches:
            group, n = _column(batch, "group"), batch.num_rows
            if not n:
                continue
            new = np.r_[group[0] != last, group[1:] != group[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            pos = np.arange(n) - np.maximum(first, 0) + np.where(first < 0, count, 0)
            terms = _column(batch, "value").view(np.uint64) * power(base, pos)
            sums = np.r_[np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]
            so_far = sums[1:] - sums[np.maximum(first, 0)] + np.where(first < 0, total, np.uint64(0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(pos), pa.array(so_far.view(np.int64))], names=[*batch.schema.names, "part", "seq", "pos", "run"]
            )
            last, count, total, seq = group[-1], pos[-1] + 1, so_far[-1], seq + n

    return run


def _carried(base: int, carry: dict):
    """mapInArrow: the rows of ``_local_scan`` with ``pos`` and ``run`` counted from the group's first row in any partition."""

    def run(batches):
        for batch in batches:
            part, group, pos, value = (_column(batch, c) for c in ("part", "group", "pos", "run"))
            pos, value = pos.copy(), value.view(np.uint64).copy()
            for p in np.unique(part):
                if int(p) in carry:
                    of, count, total = carry[int(p)]
                    mine = (part == p) & (group == of)
                    value[mine] = np.uint64(total) + value[mine] * power(base, np.full(1, count))
                    pos[mine] += count
            names = batch.schema.names
            columns = [pa.array(pos) if c == "pos" else pa.array(value.view(np.int64)) if c == "run" else batch.column(c) for c in names if c not in ("part", "seq")]
            yield pa.RecordBatch.from_arrays(columns, names=[c for c in names if c not in ("part", "seq")])

    return run


def scan(rows: DataFrame, *order: Column, base: int = 1) -> DataFrame:
    """Rows (group and value: long, others) with ``pos``, the number of each in its group by ``order``, and ``run``, the sum
    of value * base ** pos from the group's first row to this one, modulo 2 ** 64.

    Only one row for each partition reaches the driver.
    """
    ranged = rows.repartitionByRange(F.col("group"), *order).sortWithinPartitions(F.col("group"), *order)
    kind = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    local = materialize(ranged.mapInArrow(_local_scan(base), f"{kind}, part int, seq long, pos long, run long"))
    ends = local.groupBy("part").agg(F.min_by("group", "seq").alias("first"), F.max_by(F.struct("group", "pos", "run"), "seq").alias("last")).orderBy("part").collect()
    carry, of, count, total = {}, None, 0, 0
    for part, first, (group, pos, run) in ends:
        if first == of:
            carry[part] = (of, count, total)
        goes_on = group == first == of
        total = (total + (run % (1 << 64)) * pow(base, count, 1 << 64)) % (1 << 64) if goes_on else run % (1 << 64)
        of, count = group, pos + 1 + (count if goes_on else 0)
    return local.mapInArrow(_carried(base, carry), f"{kind}, pos long, run long")


def _known_turns(turns: DataFrame, bits: int) -> DataFrame:
    """conv_id, turn, n_chars and ``content``, a number that only equal roles and texts share."""
    named = turns.withColumn("content", F.xxhash64("role", "text").bitwiseAND((1 << bits) - 1) if bits < 64 else F.xxhash64("role", "text"))
    for salt in range(1, 1 << 20):
        each = F.struct("role", "text")
        mixed = materialize(named.groupBy("content").agg(F.min(each).alias("lo"), F.max(each).alias("hi")).filter("lo != hi").select("content", F.lit(True).alias("mixed")))
        if mixed.isEmpty():
            break
        again = F.xxhash64(F.lit(salt), "content", "role", "text")
        named = named.join(mixed, "content", "left").withColumn("content", F.when(F.col("mixed"), again).otherwise(F.col("content"))).drop("mixed")
    return named.select("conv_id", "turn", "n_chars", "content")


def _mixed_values(batches):
    """mapInArrow: conv_id, turn, n_chars, content -> those as group, turn, n_chars, content and a random value of the content"""
    for batch in batches:
        value = mix64(_column(batch, "content").view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=["group", "turn", "n_chars", "content", "value"])


def _named(bits: int):
    """mapInArrow: fingerprints of own turns -> names of the node of each turn and of the one above.

    A name is the fingerprint of the whole sequence mixed with its depth.  The
    sequence is another conversation's first turns (``head_run``) and then own
    ones, whose powers move from ``h`` to ``m``.
    """
    mask = np.uint64((1 << bits) - 1)

    def name(run, depth):
        return mix64(run ^ mix64(depth.astype(np.uint64))) & mask

    def rows(batches):
        for batch in batches:
            conv, chars, content, depth, length = (_column(batch, c) for c in ("conv_id", "n_chars", "content", "depth", "length"))
            run, own, head = (_column(batch, c).view(np.uint64) for c in ("run", "own_run", "head_run"))
            moved = head + (run - own) * power(INVERSE, _column(batch, "back"))
            above = moved - mix64(content.view(np.uint64)) * power(BASE, depth - 1)
            up = pa.array(name(above, depth - 1).view(np.int64), mask=depth == 1)  # the root has no name
            columns = [conv, depth, name(moved, depth).view(np.int64), up, content, chars, depth == length]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["conv_id", "depth", "node", "parent", "content", "n_chars", "last"])

    return rows


_MEMBER = "conv_id long, depth long, node long, parent long, content long, n_chars long, last boolean"


def grafted(numbered: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are rebuilt, and a row for each of their turns.

    Of conversation c the first h = crc32(c) % 6 turns come from conversation
    c - c % 100, the rest are its own behind its first h.
    """
    first = F.sort_array(F.collect_list(F.when(F.col("pos") < HEAD_MOST, F.struct("pos", "n_chars", "content", "run"))))
    convs = materialize(numbered.groupBy(F.col("group").alias("conv_id")).agg(F.count(F.lit(1)).alias("n"), first.alias("first")))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    with_base = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(bases, "base", "left")
    h = F.crc32(F.col("conv_id").cast("string")) % (HEAD_MOST + 1)
    with_head = with_base.withColumn("h", h).withColumn("head", F.slice(F.coalesce("base_first", F.array().cast(convs.schema["first"].dataType)), F.lit(1), F.col("h").cast("int")))
    last_of = lambda items, n: F.coalesce(F.get(items, n - 1)["run"], F.lit(0))
    rebuilt = with_head.select(
        "conv_id", "h", "head", F.size("head").cast("long").alias("m"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        last_of(F.col("head"), F.size("head")).alias("head_run"), last_of(F.col("first"), F.col("h").cast("int")).alias("own_run"),
    )
    rebuilt = materialize(rebuilt)
    own = numbered.withColumnRenamed("group", "conv_id").join(rebuilt.drop("head"), "conv_id").filter("pos >= h")
    own = own.select("conv_id", "n_chars", "content", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("depth"), "length", "run", "own_run", "head_run", (F.col("h") - F.col("m")).alias("back"))
    zero = F.lit(0).cast("long")
    lent = rebuilt.select("conv_id", "length", F.explode("head").alias("x"))
    lent = lent.select("conv_id", "x.n_chars", "x.content", (F.col("x.pos") + 1).alias("depth"), "length", "x.run", zero.alias("own_run"), zero.alias("head_run"), zero.alias("back"))
    return rebuilt.select("conv_id", "length"), own.union(lent).mapInArrow(_named(bits), _MEMBER)


def verified(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members, and the groups of equal ``node``, all of whose members share depth, last turn and the node above with their least conversation."""
    each = {"depth": "depth", "content": "content", "parent": "parent"}
    for salt in range(1, 1 << 20):
        lows = [f(c).alias(f"{n}_{c}") for c in each for n, f in (("lo", F.min), ("hi", F.max))]
        ends = F.when(F.col("last"), F.col("conv_id"))
        groups = materialize(members.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_chars").alias("n_chars"), F.count(ends).alias("n_ends"), F.min(ends).alias("end_conv"), *lows))
        mixed = groups.filter(" OR ".join(f"lo_{c} != hi_{c}" for c in each)).select("node", F.lit(True).alias("mixed"))
        if mixed.isEmpty():
            break
        apart = F.when(F.col("mixed"), F.xxhash64(F.lit(salt), "node", *each)).otherwise(F.col("node"))
        named = materialize(members.join(mixed, "node", "left").withColumn("node", apart).drop("mixed"))
        above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
        members = materialize(named.join(above, ["conv_id", "depth"], "left").withColumn("parent", F.col("up")).select(*members.columns))
    return members, groups.select("node", F.col("lo_depth").alias("depth"), F.col("lo_parent").alias("parent"), "conv_id", "n_convs", "n_chars", "n_ends", "end_conv")


def _chunks(batches):
    """mapInArrow: node, conv_id in order -> node, first, and up to ``CHUNK`` ids joined with commas"""
    node, ids = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (n != node or len(ids) == CHUNK):
                yield out()
                ids = []
            node = n
            ids.append(c)
    if ids:
        yield out()


def _digests(batches):
    """mapInArrow: node, first, ids in order -> node and the SHA-256 of all its ids"""
    node, state = None, None
    for batch in batches:
        done = []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is None or n != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int64()), pa.array([d for _, d in done])], names=["node", "digest"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], names=["node", "digest"])


def end_digests(ends: DataFrame) -> DataFrame:
    """node, digest: the SHA-256 of the ids (node, conv_id) of each node in order, joined with commas."""
    ordered = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = ordered.mapInArrow(_chunks, "node long, first long, ids string")
    return materialize(chunks).repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node long, digest string")


def prefix_trie(convs: DataFrame, bits: int = 64) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``bits``: of the first hashes and fingerprints; whatever they are, collisions are split.
    """
    turns = convs.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("n_chars", F.char_length("text").cast("long"))
    values = _known_turns(turns, bits).mapInArrow(_mixed_values, f"group long, turn {turns.schema['turn'].dataType.simpleString()}, n_chars long, content long, value long")
    numbered = materialize(scan(values, F.col("turn").asc_nulls_first(), F.col("content"), base=BASE).drop("value", "turn"))
    rebuilt, members = grafted(numbered, bits)
    top = rebuilt.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_turnless")).first()
    if not top["n_convs"]:
        return turns.sparkSession.createDataFrame([], NODE)
    members, nodes = verified(materialize(members))

    saved = (F.col("n_convs") - 1) * F.col("n_chars")
    childless = F.col("n_convs") == F.col("n_ends")
    owned = materialize(nodes.groupBy("conv_id").agg(F.sum(saved).alias("saved"), F.max(childless.cast("int")).alias("leaf")))
    below = members.select("node", "conv_id").join(owned, "conv_id").groupBy("node").agg(F.sum("saved").alias("all_saved"), F.sum("leaf").cast("long").alias("n_leaves"))
    # of what the node's own conversation owns, the nodes above it don't count; those of one conversation save nothing
    shared = nodes.filter("n_convs > 1").select(F.col("conv_id").alias("group"), saved.alias("value"), "depth", "node")
    above = scan(shared, F.col("depth")).select("node", (F.col("run") - F.col("value")).alias("before"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = members.filter("last").select("node", "conv_id")
    several = end_digests(ends.join(nodes.filter("n_ends > 1").select("node"), "node", "left_semi"))

    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    one = F.when(F.col("n_ends") == 1, F.sha2(F.col("end_conv").cast("string"), 256)).otherwise(F.lit(_NOTHING))
    full = nodes.join(parents, "parent", "left").join(below, "node").join(above, "node", "left").join(children, "node", "left").join(several, "node", "left")
    found = full.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", F.lit(top["conv_id"])).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        F.when(F.col("n_convs") > 1, F.col("all_saved") - F.col("before")).otherwise(0).alias("saved_tokens"), F.coalesce("digest", one).alias("ends_sha256"),
    )
    turnless = rebuilt.filter("length = 0").select(F.lit(0).cast("long").alias("node"), "conv_id")
    digest = end_digests(turnless).first() if top["n_turnless"] else (0, _NOTHING)
    sums = nodes.agg(F.count_if(F.col("depth") == 1), F.count_if(childless), F.sum(saved)).first()
    root = turns.sparkSession.createDataFrame([(top["conv_id"], 0, None, top["n_convs"], sums[0], max(sums[1], 1), sums[2] or 0, digest[1])], NODE)
    return found.union(root)


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
