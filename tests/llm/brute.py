"""Plain, slow versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def low(text):
    return (text or "").translate(LOWER)


def words(text):
    return WORD.findall(text or "")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def contamination(docs, items, size=10):
    """Row per (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = {}
    for item_id, text in items:
        w = item_words(text)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = item_words(text)
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                owners = windows.get(tuple(w[s : s + k]))
                if owners:
                    hit.update(range(s, s + k))
                    found |= owners
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    lines = [x for x in (text or "").split("\n") if words(x)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def shingles(text, k=4):
    w = words(low(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)}


def components(docs, k=4):
    """Row per doc_id: n_shingles, component_id, from all pairs."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(n)
    for n, (d, s) in enumerate(sets):
        common = Counter(m for x in s for m in by[x] if m < n)
        for m, c in common.items():
            e, t = sets[m]
            if 100 * c >= 80 * (len(s) + len(t) - c):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return [(d, len(s), find(d)) for d, s in sets]
