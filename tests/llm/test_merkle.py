"""The manifest next to a plain tree, with builders so small that every tree takes several rounds."""

import hashlib
import zlib

import numpy as np
import pytest
from helpers import awkward, clashing, docs, frame

from tsengine.llm import merkle

TINY = merkle.Spec(levels=2)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(level):
    levels = [level]
    while len(level) > 1:
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        levels.append(level)
    return levels


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(levels, i, digest):
    proof = []
    for nodes in levels[:-1]:
        first = i - i % 3
        left, right = nodes[first:i], nodes[i + 1 : first + 3]
        digest, i = h(*left, digest, *right), i // 3
        proof += left + right
    return digest, proof


def plain(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = {}, {}
    for s in sources:
        order[s] = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = tree([leaf(*r) for r in order[s]])
    top = tree([trees[s][-1][0] for s in sources])
    made = []
    for number, s in enumerate(sources):
        for i, r in enumerate(order[s]):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            now = leaf(r[0], r[1].replace("\n", ""), *r[2:]) if cut else leaf(*r)
            sub, low = climb(trees[s], i, now)
            root, high = climb(top, number, sub)
            made.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], h(*low, *high), root, root == top[-1][0]))
    return made


def key(row):
    return [(v is None, str(v)) for v in row]


def check(spark, rows, spec=TINY, table=None):
    made = merkle.verified(table if table is not None else frame(spark, rows), spec).collect()
    assert sorted(map(tuple, made), key=key) == sorted(plain(rows), key=key)


def test_plain_tree_of_several_rounds(spark):
    """One source holds most rows; trees of 1, 9, 10 and 100 leaves end in ragged and single runs."""
    sizes = {"a": 1, "b": 9, "c": 10, "é": 28, None: 3, "hot": 100, "": 2}
    rows = [(d, f"text {d}\nline", "en", s, d % 7) for d, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    check(spark, rows)
    check(spark, rows, merkle.Spec(levels=1))
    check(spark, rows, merkle.Spec())


def test_many_sources(spark):
    check(spark, [(d, "one\n" * (d % 3), None, f"s{d % 40}", d) for d in range(130)])


def test_awkward_rows(spark):
    rows = [(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate([*awkward(), "a\n" * 200_000, "x" * 1_000_000])]
    rows += [rows[4]] * 3 + [(4, "another text", "en", "s0", 0), (None, None, None, None, None), (None, "a\nb", None, None, 3)]
    names = ["tree", "idx", "n", "leaf", "_tie", "digest", "_file", "block"]
    check(spark, rows, table=clashing(frame(spark, rows), *names))
    assert merkle.verified(frame(spark, [])).collect() == []


def test_equal_rows_are_spread(spark):
    """A third of all rows the same: still leaves of their own, in several files."""
    rows = [(7, "same", "en", "s", 4)] * 60 + [(i, f"t{i}", "en", "s", 2) for i in range(100, 220)]
    check(spark, rows)
    numbered = merkle.numbered(merkle.leaves(frame(spark, rows)), ["doc_id", "leaf"], "leaves")
    assert sorted(r["idx"] for r in numbered.collect()) == list(range(180))


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_log_is_postorder(spark, levels):
    """Every node lies at its place, and children come before parents in one walk."""
    spec = merkle.Spec(levels=levels)
    _, below, _, _ = merkle.manifest(docs(spark, [f"t{i}" for i in range(95)], lambda i: "a" if i < 64 else f"b{i % 4}"), spec)
    logs = {}
    for r in merkle.log_entries(below, spec).collect():
        logs.setdefault(r["tree"], {})[r["position"]] = (r["level"], r["idx"], bytes(r["digest"]))
    for log in logs.values():
        assert sorted(log) == list(range(len(log)))
        waiting = {}
        for place in sorted(log):
            level, idx, digest = log[place]
            if level:
                assert merkle.parent(waiting.pop(level - 1)) == digest
            waiting.setdefault(level, []).append(digest)
            assert idx == sum(1 for p in range(place) if log[p][0] == level)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 82])
def test_positions(n):
    """The closed form against the order in which nodes complete."""
    top = merkle.height(n)
    log = merkle.append_all([bytes([i]) * 32 for i in range(n)], top)
    for level in range(top + 1):
        for i, place in enumerate(merkle.positions(level, np.arange(-(-n // 3**level)), n, top)):
            inner = log[place]
            assert inner == bytes([i]) * 32 if level == 0 else inner == merkle.parent(
                [log[p] for p in merkle.positions(level - 1, np.arange(3 * i, min(3 * i + 3, -(-n // 3 ** (level - 1)))), n, top)]
            )
