"""Brute-force versions that several tests share."""

import numpy as np


def brute_components(links):
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in list(up)}


def shingle_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_near(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    named = [(i, s) for i, s in sets if i is not None and s]
    links = []
    for x, (a, s) in enumerate(named):
        for b, t in named[:x]:
            both = len(s & t)
            if a != b and 100 * both >= percent * (len(s) + len(t) - both):
                links.append((a, b))
    found = brute_components(links)
    return [(i, len(s), found.get(i, i), True if i is None else found.get(i, i) == i) for i, s in sets]


def pieces(rows):
    """(doc_id, ids) put together again from pieces in order of their sequences."""
    now = []
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        now += np.frombuffer(r["ids"], "<u4").tolist()
        if len(now) == r["doc_tokens"]:
            yield r["doc_id"], now
            now = []
