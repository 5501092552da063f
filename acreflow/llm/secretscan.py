"""Secret scans: all rules in one byte pass of one minimal automaton.

The whole expressions of all rules go into one nondeterministic automaton over
bytes, which is made deterministic by subset construction, minimised by
partition refinement and kept as a transition array.  Texts are cut into lanes
at bytes that send every state back to the start, and all lanes step through
the array together, one byte of each at a time (the last few long lanes one
after the other).  At each byte the automaton tells which rules have a match
that ends there; a run of such bytes is one match, and where it starts is found
by the rule's reversed automaton, back to the end of the match before at most.
So a text costs time in proportion to its length, whatever it holds.  How long
a match must be is counted outside the automaton: counted repetitions would
give it tens of thousands of states.

That a run is one match holds for rules that ``check_rule`` passes: a match that
begins earlier is complete no later, and once complete it ends with the first
byte that does not lengthen it.  Rules without these properties are refused.

Defined results: a null text is empty and has no spans; spans of several kinds
may overlap, and are in order of start, then of the rules; offsets count code
points; every row gives a row, repeated rows and null ids too; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import buffers, pieces

#: kind, expression, least length, whether that is of what follows from the first byte that can be the last one ("tail") or of all, any case
RULES = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, "tail", True),
    ("access", r"AKIA[A-Z0-9]+", 20, "all", False),
    ("hex", r"[0-9a-f]+", 24, "all", False),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "all", False),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, "all", False),
    ("chat", r"xox[abprs]-[0-9A-Za-z-]+", 15, "all", False),
    ("forge", r"gh[opusr]_[0-9A-Za-z]+", 20, "all", False),
)
BASE = ("assign", "access", "hex")
LANE, FEW = 512, 48  # bytes of a lane at least, where there is a place to cut; lanes that are not worth a step together


def parse(pattern: str, any_case: bool) -> tuple:
    """An expression as nested ("set", bytes), ("cat", parts), ("alt", parts), ("rep", least, most or None, part).

    Literals, escapes, classes with ranges, groups, alternatives and the
    repetitions ?, *, +, {n} and {n,m}.
    """
    at = 0

    def either(chars: set[int]) -> tuple:
        return ("set", frozenset(chars | {ord(f(chr(c))) for c in chars if any_case and c < 128 and chr(c).isalpha() for f in (str.lower, str.upper)}))

    def char() -> int:
        nonlocal at
        at += 1
        if pattern[at - 1] != "\\":
            return ord(pattern[at - 1])
        at += 1
        if pattern[at - 1] == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        if pattern[at - 1].isalnum():
            raise ValueError(f"not supported: \\{pattern[at - 1]}")
        return ord(pattern[at - 1])

    def one() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            part = ways()
            at += 1
            return part
        if pattern[at] != "[":
            if pattern[at] in ".^$":
                raise ValueError(f"not supported: {pattern[at]}")
            return either({char()})
        at += 1
        chars: set[int] = set()
        if pattern[at] == "^":
            raise ValueError("not supported: [^")
        while pattern[at] != "]":
            first = last = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                last = char()
            chars |= set(range(first, last + 1))
        at += 1
        return either(chars)

    def ways() -> tuple:
        nonlocal at
        found: list[list] = [[]]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                found.append([])
                continue
            part = one()
            if at < len(pattern) and pattern[at] in "?*+{":
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(pattern[at], (0, 0))
                if pattern[at] == "{":
                    close = pattern.index("}", at)
                    low, comma, high = pattern[at + 1 : close].partition(",")
                    least, most, at = int(low), int(high) if high else None if comma else int(low), close
                at += 1
                part = ("rep", least, most, part)
            found[-1].append(part)
        return ("alt", [("cat", x) for x in found])

    return ways()


def backwards(tree: tuple) -> tuple:
    """The expression of the reversed matches."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return (*tree[:3], backwards(tree[3]))
    parts = [backwards(x) for x in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


class _Nfa:
    """Thompson's construction over bytes."""

    def __init__(self) -> None:
        self.free: list[set[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []

    def state(self, after: int | None = None) -> int:
        self.free.append(set())
        self.step.append([])
        if after is not None:
            self.free[after].add(len(self.free) - 1)
        return len(self.free) - 1

    def add(self, tree: tuple, at: int) -> int:
        """The state after what ``tree`` matches from ``at`` on."""
        kind = tree[0]
        if kind == "set":
            to = self.state()
            self.step[at].append((tree[1], to))
            return to
        if kind == "cat":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        if kind == "alt":
            ends = [self.add(part, self.state(at)) for part in tree[1]]
        else:
            _, least, most, part = tree
            for _ in range(least):
                at = self.add(part, at)
            if most is None:
                loop = self.state(at)
                self.free[self.add(part, loop)].add(loop)
                return self.state(loop)
            ends = [at]
            for _ in range(most - least):
                ends.append(self.add(part, ends[-1]))
        to = self.state()
        for x in ends:
            self.free[x].add(to)
        return to

    def closures(self) -> list[int]:
        """Of each state, the states that it reaches for free, as bits; only those that have steps or end a rule count."""
        out = []
        for begin in range(len(self.free)):
            seen, todo = {begin}, [begin]
            while todo:
                for x in self.free[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            out.append(sum(1 << x for x in seen if self.step[x] or not self.free[x]))
        return out


def compile_rules(trees: list[tuple], search: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transitions [states, 256] and accept bits [states] of the minimal automaton; 0 is the start.

    With ``search`` a match may start at each byte.  Otherwise it starts at
    the first, and state 1 is the dead one.
    """
    nfa, ends = _Nfa(), []
    start = nfa.state()
    for tree in trees:
        ends.append(1 << nfa.state(nfa.add(tree, nfa.state(start))))
    # bytes that no rule tells apart are one letter
    sets = {chars for steps in nfa.step for chars, _ in steps}
    letters: dict[tuple[bool, ...], int] = {}
    letter = [letters.setdefault(tuple(b in s for s in sets), len(letters)) for b in range(256)]
    sample = [letter.index(x) for x in range(len(letters))]
    free = nfa.closures()
    moves = [[0] * len(nfa.step) for _ in sample]  # of each letter and state
    for at, steps in enumerate(nfa.step):
        for chars, to in steps:
            for x, b in enumerate(sample):
                if b in chars:
                    moves[x][at] |= free[to]
    first = free[start]
    known = {first: 0}
    if not search:
        known[0] = 1
    todo, table = list(known), []
    for now in todo:
        states = [i for i, bit in enumerate(reversed(bin(now)[2:])) if bit == "1"]
        row = []
        for move in moves:
            to = first if search else 0
            for i in states:
                to |= move[i]
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row.append(known[to])
        table.append(row)
    step = np.array(table)
    accept = np.array([sum(1 << bit for bit, end in enumerate(ends) if states & end) for states in todo])
    block = np.unique(accept, return_inverse=True)[1].ravel()
    while True:  # partition refinement
        finer = np.unique(np.c_[block, block[step]], axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    # the start becomes 0, the dead state 1
    order = [block[0]] + ([block[1]] if not search else [])
    order += [x for x in range(block.max() + 1) if x not in order]
    name = np.argsort(order)
    pick = [int(np.flatnonzero(block == x)[0]) for x in order]
    return name[block[step[pick]]][:, letter].astype(np.int32), accept[pick].astype(np.uint32)


def check_rule(tree: tuple) -> None:
    """Raises ValueError for a rule whose matches aren't the runs of bytes where some match ends.

    ``own`` follows one match, ``any_later`` those that begin after it.
    """
    own, done = compile_rules([tree], search=False)
    any_later, later_done = compile_rules([tree], search=True)
    if done[0]:
        raise ValueError("a rule that matches nothing at all")
    todo = deque((int(a), 0) for a in set(own[0].tolist()) if a != 1)
    seen = set(todo)
    while todo:
        a, s = todo.popleft()
        for a2, s2 in {*zip(own[a].tolist(), any_later[s].tolist(), strict=True)}:
            if done[a] and not done[a2] and a2 != 1:
                raise ValueError("a match that goes on after bytes that do not lengthen it")
            if later_done[s2] and not done[a2] and (done[a] or a2 != 1):
                raise ValueError("a match inside another is complete before it, or goes on behind it")
            if a2 != 1 and (a2, s2) not in seen:
                seen.add((a2, s2))
                todo.append((a2, s2))


def scan_lanes(data: np.ndarray, cuts: np.ndarray, step: np.ndarray, accept: np.ndarray) -> np.ndarray:
    """The accept bits at each byte; every lane [cuts[i], cuts[i+1]) begins at the start."""
    size = np.diff(cuts)
    order = np.argsort(-size, kind="stable")
    at, size = cuts[:-1][order], size[order]
    out = np.zeros(len(data), accept.dtype)
    together = int(size[FEW]) if len(size) > FEW else 0
    live = np.searchsorted(-size, -np.arange(together), "left")
    state = np.zeros(len(order), np.int32)
    flat = step.ravel()
    for j, n in enumerate(live):
        place = at[:n] + j
        state[:n] = flat[(state[:n] << 8) + data[place]]
        out[place] = accept[state[:n]]
    table, bits = step.tolist(), accept.tolist()
    for i in range(min(FEW, len(order))):
        begin = int(at[i]) + together
        s = int(state[i])
        for k, b in enumerate(data[begin : int(at[i] + size[i])].tobytes(), begin):
            s = table[s][b]
            if bits[s]:
                out[k] = bits[s]
    return out


@functools.lru_cache(8)
def compiled(rules: tuple) -> dict:
    """The combined automaton, and of each rule whether a match is complete with its first byte, its own and its reversed automaton."""
    trees = [parse(r[1], r[4]) for r in rules]
    for tree in trees:
        check_rule(tree)
    step, accept = compile_rules(trees, search=True)
    own = []
    for tree in trees:
        first, done = compile_rules([tree], search=False)
        back, begin = compile_rules([backwards(tree)], search=False)
        own.append((bool(all(a == 1 or done[a] for a in first[0])), *(x.tolist() for x in compile_rules([tree], search=True)), back.tolist(), begin.tolist()))
    return {"step": step, "accept": accept, "own": own}


def _begin(data: bytes, last: int, least: int, back: list, begin: list) -> int:
    """The first byte, ``least`` or later, of a match whose last one is ``last``; -1 if there is none."""
    state, found = 0, -1
    while last >= least:
        state = back[state][data[last]]
        if state == 1:
            break
        if begin[state]:
            found = last
        last -= 1
    return found


def _first_end(data: bytes, at: int, end: int, own: list, done: list) -> int:
    """The last byte of the first match to be complete of those that begin at ``at`` or later; -1 if there is none before ``end``."""
    state = 0
    for i in range(at, end):
        state = own[state][data[i]]
        if done[state]:
            return i
    return -1


def find_spans(part: np.ndarray, off: np.ndarray, rules, automaton: dict) -> dict[int, list[tuple[int, int, int]]]:
    """row -> (first byte, rule, end byte) in order, for the texts of a piece that have any."""
    step, accept = automaton["step"], automaton["accept"]
    reset = (step == 0).all(axis=0)
    breaks = np.flatnonzero(reset[part]) + 1
    breaks = breaks[np.r_[True, np.diff(breaks // LANE) > 0]] if len(breaks) else breaks
    bits = scan_lanes(part, np.unique(np.r_[off, breaks]), step, accept)
    edge = np.zeros(len(part) + 1, bool)
    edge[off] = True
    raw = part.tobytes()
    rows: dict[int, list] = {}
    for k, (_, _, least, counted, _) in enumerate(rules):
        yes = (bits >> np.uint32(k) & np.uint32(1)).astype(bool)
        before = np.r_[False, yes[:-1]]
        firsts = np.flatnonzero(yes & (~before | edge[:-1]))
        if not len(firsts):
            continue
        ends = np.flatnonzero(yes & (~np.r_[yes[1:], False] | edge[1:])) + 1
        at_once, own, done, back, begin = automaton["own"][k]
        if at_once:
            firsts, ends = firsts[ends - firsts >= least], ends[ends - firsts >= least]
        row = np.searchsorted(off, firsts, "right") - 1
        used, of = 0, -1
        for i, end, who in zip(firsts.tolist(), ends.tolist(), row.tolist(), strict=True):
            if who != of:
                used, of = int(off[who]), who
            start = i if at_once else _begin(raw, i, used, back, begin)
            if start < 0:  # what ends here began inside the match before: another may begin behind it
                i = _first_end(raw, used, end, own, done)
                if i < 0:
                    continue
                start = _begin(raw, i, used, back, begin)
            used = end
            if end - (i if counted == "tail" else start) >= least:
                rows.setdefault(who, []).append((start - int(off[who]), k, end - int(off[who])))
    return {who: sorted(found) for who, found in rows.items()}


def scan_batches(rules):
    """mapInArrow: id, text -> id, kinds, starts, ends (lists, by start and then rule)"""
    automaton = compiled(tuple(map(tuple, rules)))

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(1))
            for i, j in pieces(at):
                part, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
                lists: list[list] = [[] for _ in range(j - i)]
                for who, found in find_spans(part, off, rules, automaton).items():
                    count = np.r_[0, np.cumsum((part[off[who] : off[who + 1]] & 0xC0) != 0x80)]
                    lists[who] = [(int(count[s]), k, int(count[e])) for s, k, e in found]
                columns = [
                    pa.array([[rules[k][0] for _, k, _ in x] for x in lists], pa.list_(pa.string())),
                    pa.array([[s for s, _, _ in x] for x in lists], pa.list_(pa.int64())),
                    pa.array([[e for _, _, e in x] for x in lists], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", "kinds", "starts", "ends"])

    return run


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """doc_id, kinds, starts, ends of each row: all spans by start and then rule."""
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(scan_batches(rules), f"doc_id {kind}, kinds array<string>, starts array<long>, ends array<long>")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secret_spans(docs).withColumn("all", F.arrays_zip("kinds", "starts", "ends"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kinds"], x["starts"], x["ends"])), ",")
    base = F.filter("all", lambda x: x["kinds"].isin(*BASE))

    def count(name: str):
        return F.size(F.filter("kinds", lambda k: k == name)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
