"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

The lattice of a text has an edge for each place where a piece of the
vocabulary matches.  An edge's log weight is ``alpha`` times the piece's log
probability, which for a vocabulary with ranks for scores is that of Zipf's
law.  Forward filtering sums the weights of all paths to each place; backward
sampling draws the pieces from the end, each in proportion to its share of
the sum, so a segmentation is drawn with its exact probability.  The draws are
hashes of the row's key and the place in the text, so they are the same in
any run and partitioning.

No piece reaches over the start of a word, so the lattice falls apart into
words; the forward pass runs once for each distinct word of a batch piece, and
sampling steps through all words of the piece together.

A space stands for the vocabulary's space mark, one space is put before the
text, and a character without a piece (the mark itself too) becomes bytes:
decoding gives every text back exactly.

Defined results: a null or empty text has no pieces; rows with equal key and
text get equal pieces, null keys being equal; a text of any length is one
lattice, whole, and takes time in proportion, with or without spaces; every row
gives a row; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from math import exp, log

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textvec import buffers, mix64, pieces, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
ALPHA, SEED = 1.0, 5
PART = 1 << 20
LONG = 1024  # bytes of a word that is stepped through by itself, as few others are as long


def load_vocabulary(path: str = MODEL) -> dict:
    """Bytes and log probability of each piece; bytes None for control pieces; ids of the single bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(n)])
    single = [model.is_byte(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    text = [None if special[i] or single[i] else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
    if any(t and (b"\n" in t or b" " in t.lstrip(b" ")) for t in text):
        raise ValueError("a piece reaches over the start of a word")
    usable = np.array([t is not None for t in text])
    ranks = usable.any() and bool(np.all(scores[usable] == np.rint(scores[usable])))
    logp = -np.log(2.0 - np.minimum(scores, 0)) if ranks else scores
    byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if single[i]}
    if len(byte_id) != 256:
        raise ValueError("a vocabulary with all 256 bytes is needed")
    return {"text": text, "logp": logp.astype(np.float64), "bytes": [byte_id[b] for b in range(256)]}


class Lattice:
    """The vocabulary as a byte trie and as flat arrays."""

    def __init__(self, vocabulary: dict, alpha: float) -> None:
        used = sorted({b for t in vocabulary["text"] if t for b in t})
        self.letter = np.zeros(256, np.int32)
        self.letter[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}, {}]  # node 0 is dead, 1 the root
        piece = [-1, -1]
        for i, text in enumerate(vocabulary["text"]):
            if text:
                at = 1
                for b in text:
                    at = children[at].setdefault(b, len(children))
                    if at == len(children):
                        children.append({})
                        piece.append(-1)
                piece[at] = i
        self.width = len(used) + 1
        self.child = np.zeros((len(children), self.width), np.int32)
        for at, row in enumerate(children):
            for b, to in row.items():
                self.child[at, self.letter[b]] = to
        self.child = self.child.ravel()
        self.piece = np.array(piece, np.int32)
        self.logw = alpha * vocabulary["logp"]
        self.byte_logw = -alpha * np.log(len(piece))
        self.byte_id = np.array(vocabulary["bytes"], np.int32)
        flat = [bytes([vocabulary["bytes"].index(i)]) if t is None and i in set(vocabulary["bytes"]) else t or b"" for i, t in enumerate(vocabulary["text"])]
        self.size = np.array([len(t) for t in flat], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]]
        self.flat = np.frombuffer(b"".join(flat), np.uint8)

    def edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end and piece (-1: the bytes of a character) of all edges; ends: of the word at each place."""
        start = np.flatnonzero((data & 0xC0) != 0x80)
        size = np.diff(np.r_[start, len(data)])
        at, node, n = start, np.ones(len(start), np.int32), 0
        known = np.zeros(len(start), bool)
        which = np.arange(len(start))
        found = []
        letters = self.letter[data]
        while len(at):
            node = self.child[node * self.width + letters[at + n]]
            n += 1
            hit = self.piece[node]
            yes = hit >= 0
            found.append((at[yes], at[yes] + n, hit[yes]))
            known[which[yes]] |= size[which[yes]] == n
            go = (node > 0) & (at + n < ends[at])
            at, node, which = at[go], node[go], which[go]
        rest = ~known
        found.append((start[rest], start[rest] + size[rest], np.full(int(rest.sum()), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def filtered(self, data: np.ndarray, off: np.ndarray):
        """Edges by end place, with the running probabilities to sample from, and the first edge of each end place."""
        length = np.diff(off)
        begin, ends = np.repeat(off[:-1], length), np.repeat(off[1:], length)
        s, e, p = self.edges(data, ends)
        logw = np.where(p >= 0, self.logw[p], (e - s) * self.byte_logw)
        bits = int(len(data) + 1).bit_length()
        order = np.argsort(e << bits | s)
        s, e, p, logw = s[order], e[order], p[order], logw[order]
        # of the paths to each place; a word's end is the next one's start, which counts as 0 there
        alpha = np.full(len(data) + 1, -np.inf)
        value = np.empty(len(s))
        for a, b in zip(*((np.searchsorted(e, x[length > LONG], "right")) for x in (off[:-1], off[1:])), strict=True):
            self._forward(s, e, logw, value, alpha, int(a), int(b))
        short = np.flatnonzero((length <= LONG)[np.searchsorted(off, s, "right") - 1])
        rel = e[short] - begin[s[short]]
        by_rel = short[np.argsort(rel.astype(np.uint16), kind="stable")]
        rs, re, rw = s[by_rel], e[by_rel], logw[by_rel]
        fresh = begin[rs] == rs
        cuts = np.r_[0, np.cumsum(np.bincount(rel))] if len(rel) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            v = rw[a:b] + np.where(fresh[a:b], 0.0, alpha[rs[a:b]])
            value[by_rel[a:b]] = v
            heads = np.flatnonzero(np.r_[True, re[a + 1 : b] != re[a : b - 1]])
            top = np.maximum.reduceat(v, heads)
            many = np.diff(np.r_[heads, b - a])
            alpha[re[a:b][heads]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), heads))
        share = np.exp(value - alpha[e])
        run = share.copy()
        head = np.flatnonzero(np.r_[True, e[1:] != e[:-1]]) if len(e) else np.zeros(0, int)
        many = np.diff(np.r_[head, len(e)])
        # each place's sums apart from the others', so a word has the same ones in any batch
        at, left = head[many > 1], many[many > 1]
        while len(at):
            at = at + 1
            run[at] += run[at - 1]
            left = left - 1
            at, left = at[left > 1], left[left > 1]
        run[head + many - 1] = 2.0
        first_edge = np.zeros(len(data) + 1, np.int64)
        first_edge[e[head]] = head
        return s, e, p, run, first_edge

    @staticmethod
    def _forward(s, e, logw, value, alpha, a: int, b: int) -> None:
        """The forward pass of one long word, whose edges are a to b: one end place after the other."""
        sums = memoryview(alpha)
        first = int(s[a])
        sums[first], before = 0.0, sums[first]
        place, v = -1, []
        for i in range(a, b, 1 << 16):
            j, out = min(b, i + (1 << 16)), []
            for begin, end, weight in zip(s[i:j].tolist(), e[i:j].tolist(), logw[i:j].tolist(), strict=True):
                if end != place:
                    if v:
                        top = max(v)
                        sums[place] = top + log(sum([exp(x - top) for x in v]))
                    place, v = end, []
                v.append(weight + sums[begin])
                out.append(v[-1])
            value[i:j] = out
        top = max(v)
        sums[place] = top + log(sum([exp(x - top) for x in v]))
        sums[first] = before

    @staticmethod
    def _backward(s, p, share, first_edge, draws, stop: int, end: int):
        """Pieces, start and end places of one long word, from its end on; draws: of each end place from ``stop`` on."""
        draws, edge, share, start, piece = (memoryview(np.ascontiguousarray(x)) for x in (draws, first_edge, share, s, p))
        while end > stop:
            k, u = edge[end], draws[end - stop]
            while u >= share[k]:
                k += 1
            yield piece[k], start[k], end
            end = start[k]

    def sample(self, data: np.ndarray, off: np.ndarray, seeds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the parts of texts in ``data`` (one space before each text), and how many each has; first: a part's place in its text."""
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        blank = data == 32
        edge[1:n] |= blank[1:] & ~blank[:-1]
        line = data == 10
        edge[:n] |= line
        edge[1 : n + 1] |= line
        word = np.flatnonzero(edge)
        word, last = word[:-1], word[1:]
        up, down = powers(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(data.astype(np.uint64) + np.uint64(77)) * up[:n], out=run[1:])
        key = mix64((run[last] - run[word]) * down[word] + (last - word).astype(np.uint64))
        _, pick, of = np.unique(key, return_index=True, return_inverse=True)
        length = (last - word)[pick]
        uoff = np.r_[0, np.cumsum(length)]
        source = np.repeat(word[pick] - uoff[:-1], length) + np.arange(uoff[-1])
        s, e, p, share, first_edge = self.filtered(data[source], uoff)
        # all words step back from their ends together
        row = np.searchsorted(off, word, "right") - 1
        shift = word - uoff[of]  # from a place in the distinct words to the one in the text
        stop, at = uoff[of], uoff[of + 1]
        seed = seeds[row]
        base = (off[:-1] - first)[row]
        token = np.full(n, -1, np.int32)

        def draw(seed, place):
            return (mix64(seed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53

        for w in np.flatnonzero(at - stop > LONG).tolist():
            a, b, move = int(stop[w]), int(at[w]), int(shift[w])
            for piece, begin, end in self._backward(s, p, share, first_edge, draw(seed[w], np.arange(a, b + 1) + (move - int(base[w]))), a, b):
                if piece >= 0:
                    token[begin + move] = piece
                else:
                    token[begin + move : end + move] = self.byte_id[data[begin + move : end + move]]
        go = at - stop <= LONG
        at, stop, shift, seed, base = at[go], stop[go], shift[go], seed[go], base[go]
        while len(at):
            u = draw(seed, (at + shift) - base)
            k = first_edge[at]
            todo = np.flatnonzero(u >= share[k])
            while len(todo):
                k[todo] += 1
                todo = todo[u[todo] >= share[k[todo]]]
            piece, begin = p[k], s[k]
            whole = piece >= 0
            token[(begin + shift)[whole]] = piece[whole]
            for a, b in zip((begin + shift)[~whole], (at + shift)[~whole], strict=True):
                token[a:b] = self.byte_id[data[a:b]]
            go = begin > stop
            at, stop, shift, seed, base = begin[go], stop[go], shift[go], seed[go], base[go]
        there = token >= 0
        return token[there], np.add.reduceat(there, off[:-1]) if len(off) > 1 else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of lists of ids, with the space before each text."""
        end = np.r_[0, np.cumsum(self.size[ids])]
        out = np.empty(end[-1], np.uint8)
        for i in range(0, len(ids), 1 << 18):
            some = ids[i : i + (1 << 18)]
            size = self.size[some]
            at, last = int(end[i]), int(end[i + len(some)])
            out[at:last] = self.flat[np.repeat(self.start[some] - (end[i : i + len(some)] - at), size) + np.arange(last - at)]
        return out, end[off]


def _before(data: np.ndarray, at: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts that aren't empty with one space before each that begins a text, and all parts' offsets."""
    size = np.diff(at)
    extra = (size > 0) & begins
    off = at + np.r_[0, np.cumsum(extra)]
    out = np.full(off[-1], 32, np.uint8)
    place = np.repeat((off[:-1] + extra) - at[:-1], size) + np.arange(at[-1])
    out[place] = data
    return out, off


def encode_texts(lattice: Lattice, data: np.ndarray, at: np.ndarray, seeds: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of texts, or of one part of a text that begins at byte ``first`` of it."""
    begins = np.full(len(at) - 1, first == 0)
    spaced, off = _before(data, at, begins)
    some = np.flatnonzero(np.diff(off) > 0)
    counts = np.zeros(len(at) - 1, np.int64)
    ids = np.zeros(0, np.int32)
    if len(some):
        # behind the first part, places count the space before the text
        places = np.full(len(some), first + 1 if first else 0)
        ids, counts[some] = lattice.sample(spaced, np.r_[off[some], off[-1]], mix64(seeds[some]), places)
    return ids, np.r_[0, np.cumsum(counts)]


def word_parts(data: np.ndarray, limit: int) -> list[int]:
    """Where to cut a long text into parts of about ``limit`` bytes that begin at words."""
    starts = np.flatnonzero(((data[1:] == 32) & (data[:-1] != 32)) | (data[1:] == 10) | (data[:-1] == 10)) + 1
    cuts = [0]
    while len(data) - cuts[-1] > limit and len(starts):
        at = int(np.searchsorted(starts, cuts[-1] + limit, "right"))
        if at and starts[at - 1] > cuts[-1]:
            at -= 1
        elif at == len(starts):
            break
        cuts.append(int(starts[at]))
    return [*cuts, len(data)]


def _parts(lattice: Lattice, batch):
    data, at = buffers(batch.column(1))
    seeds = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
    for i, j in pieces(at, PART):
        part = data[at[i] : at[j]]
        if len(part) <= PART:
            ids, off = encode_texts(lattice, part, at[i : j + 1] - at[i], seeds[i:j])
        else:
            cuts = word_parts(part, PART)
            ids = np.concatenate([encode_texts(lattice, part[a:b], np.array([0, b - a]), seeds[i:j], a)[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            off = np.array([0, len(ids)])
        yield i, j, ids, off, part, at[i : j + 1] - at[i]


def encode_batches(vocabulary, alpha: float):
    """mapInArrow: key, text, seed -> key, ids.  A task makes its trie from the broadcast vocabulary."""

    def run(batches):
        lattice = Lattice(vocabulary.value, alpha)
        for batch in batches:
            for i, j, ids, off, *_ in _parts(lattice, batch):
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["doc_id", "ids"])

    return run


def _texts(raw: np.ndarray, off: np.ndarray) -> list[bytes]:
    return [raw[a + 1 : b].tobytes() if b > a else b"" for a, b in zip(off[:-1], off[1:], strict=True)]


def digest_batches(vocabulary, alpha: float):
    """mapInArrow: key, text, seed -> key, n_pieces, pieces_sha256, decoded_sha256, lossless"""

    def run(batches):
        lattice = Lattice(vocabulary.value, alpha)
        for batch in batches:
            for i, j, ids, off, data, at in _parts(lattice, batch):
                texts = _texts(*lattice.decode(ids, off))
                ids = ids.astype("<i4")
                columns = [
                    pa.array(np.diff(off)),
                    pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array([t == data[a:b].tobytes() for t, a, b in zip(texts, at[:-1], at[1:], strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"])

    return run


def decode_batches(vocabulary):
    """mapInArrow: key, ids -> key, text; null ids give null"""

    def run(batches):
        lattice = Lattice(vocabulary.value, ALPHA)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                lists = [np.array(x if x is not None else [], np.int64) for x in part.column(1).to_pylist()]
                off = np.r_[0, np.cumsum([len(x) for x in lists])]
                texts = _texts(*lattice.decode(np.concatenate(lists), off))
                texts = [t.decode() if ok else None for t, ok in zip(texts, part.column(1).is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load_vocabulary(path))  # bounded by the vocabulary


def _seeded(docs: DataFrame, key: str, text: str, seed: int) -> tuple[DataFrame, str]:
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.lit(seed), F.col(key)).alias("seed"))
    return plain, plain.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, ids (array<int>) of each row."""
    plain, kind = _seeded(docs, key, text, seed)
    return plain.mapInArrow(encode_batches(_shared(docs.sparkSession, path), alpha), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = MODEL) -> DataFrame:
    """doc_id, text of each row."""
    plain = encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(decode_batches(_shared(encoded.sparkSession, path)), f"doc_id {kind}, text string")


def encoding_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256, decoded_sha256, lossless of each row."""
    plain, kind = _seeded(docs, key, text, seed)
    return plain.mapInArrow(digest_batches(_shared(docs.sparkSession, path), alpha), f"doc_id {kind}, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean")
