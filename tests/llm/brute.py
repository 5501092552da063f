"""Plain versions of operators for small tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import groupby

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near_components(texts: dict):
    """id -> (set size, least id of its component)"""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    holders = defaultdict(list)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def line_dedup(rows):
    """[(doc_id, text)] -> [(n_lines, n_dropped, kept, run lengths of kept and dropped lines in turn)]"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [len(h := holders.get(key(x), ())) < 5 or i == max((x for x in h if x is not None), default=None) for x in lines]
        runs = [len(list(g)) for _, g in groupby(stay)]
        kept = [x for x, s in zip(lines, stay, strict=True) if s]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept), ",".join(map(str, runs if stay[0] else [0, *runs]))))
    return out


def secret_spans(text, rules):
    """(start, rule, end) of every rule's leftmost matches that are long enough, by start and rule, by plain regular expressions."""
    out = []
    for k, (_, pattern, least, counted, any_case) in enumerate(rules):
        for m in re.compile(pattern, re.I | re.A if any_case else 0).finditer(text or ""):
            if len(m[m.re.groups and 2] if counted == "tail" else m[0]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def secret_row(text, rules, base=3):
    """Counts and digest of the base kinds, and all spans."""
    found = secret_spans(text, rules)
    join = lambda spans: ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in spans)
    return *(sum(k == i for _, k, _ in found) for i in range(base)), hashlib.sha256(join(x for x in found if x[1] < base).encode()).hexdigest(), join(found)


def best_alignment(t, text):
    """(score, matched words, first, last) of the best local alignment of two word lists by the whole table: 2 for equal words, -1 for unequal ones and gaps."""
    above = [(0, 0, j) for j in range(len(text) + 1)]
    best = (0, 0, 0, -1)
    for a in t:
        row = [(0, 0, 0)]
        for j, b in enumerate(text):
            score, matched, first = above[j] if above[j][0] else (0, 0, j)
            ways = [(score + (2 if a == b else -1), matched + (a == b), first), (above[j + 1][0] - 1, *above[j + 1][1:]), (row[-1][0] - 1, *row[-1][1:])]
            top = max(ways, key=lambda x: x[0])
            row.append(top if top[0] > 0 else (0, 0, j + 1))
            if row[-1][0] > best[0]:
                best = (*row[-1], j)
        above = row
    return best


def licenses(text, templates, least):
    """(license, coverage, start, end) in text order: the copy with most matched words first, its words then gone, and so on."""
    words = lambda x: [(m[0].translate(LOWER), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", x or "")]
    at, out = words(text), []
    left = [w for w, *_ in at]
    while True:
        found = []
        for k, (name, template) in enumerate(templates.items()):
            t = [w for w, *_ in words(template)]
            _, matched, first, last = best_alignment(t, left)
            if matched >= least * len(t):
                found.append((-matched, k, name, matched / len(t), first, last))
        if not found:
            return sorted(out, key=lambda x: x[2])
        _, _, name, coverage, first, last = min(found)
        out.append((name, coverage, at[first][1], at[last][2]))
        left[first : last + 1] = [None] * (last - first + 1)
