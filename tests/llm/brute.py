"""Plain versions of the operators, on the driver, to hold results against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingle_set(text, n):
    w = BLANK_WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_components(docs, n, p, q):
    """{doc_id: (size, least id reached)} of [(doc_id, text)], by counting common shingles of all pairs."""
    sets = {d: shingle_set(t, n) for d, t in docs}
    first, groups = {}, Union()
    for d in sorted(sets):
        groups.root(d)
        if sets[d]:
            groups.join(first.setdefault(sets[d], d), d)
    kept = {d: sets[d] for d in first.values()}
    by_item = defaultdict(list)
    for d in sorted(kept):
        common = Counter(x for s in kept[d] for x in by_item[s])
        for x, i in common.items():
            if q * i >= p * (len(kept[d]) + len(kept[x]) - i):
                groups.join(x, d)
        for s in kept[d]:
            by_item[s].append(d)
    return {d: (len(sets[d]), groups.root(d)) for d in sets}


def contaminated(text, items, n=10):
    """(n_words, n_hit, items with windows in the text) for items [(item_id, text)]."""
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        length = min(n, len(v))
        if not length:
            continue
        windows = {tuple(v[i:i + length]) for i in range(len(v) - length + 1)}
        for i in range(len(w) - length + 1):
            if tuple(w[i:i + length]) in windows:
                hit.update(range(i, i + length))
                found.add(item)
    return len(w), len(hit), found
