"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WHITE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs, min_docs=10, min_chars=1):
    """docs: distinct (doc_id, text); -> kept text and counts by document."""
    held = Counter()
    for _, text in docs:
        held.update({line.strip(WHITE).translate(UPPER) for line in (text or "").split("\n")})
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        keep = [
            line
            for line in lines
            if len(k := line.strip(WHITE).translate(UPPER)) < min_chars or held[k] < min_docs
        ]
        out[doc_id] = (len(lines), len(lines) - len(keep), sha("\n".join(keep)))
    return out


def quality(text):
    """The five base figures of one text."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, again, len(marked)


def boilerplate(docs, max_docs):
    """docs: distinct (doc_id, source, text); -> words removed by document."""
    held, lines = defaultdict(set), {}
    for doc_id, source, text in docs:
        lines[doc_id] = [" ".join(WORD.findall(x)).translate(UPPER) for x in (text or "").split("\n")]
        for line in lines[doc_id]:
            held[source, line].add(text)
    out = {}
    for doc_id, source, _ in docs:
        out[doc_id] = sum(
            len(line.split(" "))
            for line in lines[doc_id]
            if line and len(held[source, line]) > max_docs
        )
    return out


def without_boilerplate(docs, max_docs):
    """docs: (doc_id, source, text) -> the same without the lines that `boilerplate` counts."""
    held = defaultdict(set)

    def key(line):
        return " ".join(WORD.findall(line)).translate(UPPER)

    for _, source, text in docs:
        for line in (text or "").split("\n"):
            held[source, key(line)].add(text)

    def stays(source, line):
        n = len(held[source, key(line)])
        return not key(line) or n <= max_docs

    return [
        (i, source, text and "\n".join(x for x in text.split("\n") if stays(source, x)))
        for i, source, text in docs
    ]


def shingles(text, width):
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near(docs, width, percent=80):
    """docs: (doc_id, text), ids set -> {doc_id: (set size, component)}."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    rare = sorted(holders, key=lambda x: (len(holders[x]), x))
    rank = {x: n for n, x in enumerate(rare)}
    seen = defaultdict(list)
    for i, s in sorted(sets.items()):
        order = sorted(s, key=rank.get)
        # two sets this alike share one of the rarest shingles of either
        head = order[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in head for j in seen[x]}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in head:
            seen[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """sizes: {source: words} -> {source: target}, by resharing until no target is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, cut = sum(sizes.values()), {}
    while True:
        rest = total - sum(cut.values())
        free = [s for s in names if s not in cut]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: most * sizes[s] for s in free if share[s] > most * sizes[s]}
        if not above:
            return {**cut, **share}
        cut |= above


_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text):
    """Base spans of one text: (start, kind, end)."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)
