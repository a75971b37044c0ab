"""Near duplicates against all pairs."""

import random

import brute
import numpy as np
import pandas as pd
import pytest
from helpers import awkward, clashing, docs, frame
from pyspark.sql import functions as F

from tsengine.llm import common, near_duplicates as nd
from tsengine.llm.shingles import WordHashes, shingle_set


def edited(draw, words, changes):
    out = list(words)
    for _ in range(changes):
        out[draw.randrange(len(out))] = f"n{draw.randrange(10**6)}"
    return out


def groups(seed=1):
    """Copies, near copies at all distances, chains, a shared passage, short texts."""
    draw = random.Random(seed)
    fresh = lambda n: [f"v{draw.randrange(3000)}" for _ in range(n)]
    texts = list(awkward())
    for size in (12, 60, 200):
        for _ in range(4):
            base = fresh(size)
            texts += [" ".join(edited(draw, base, draw.randrange(0, size // 12 + 2))) for _ in range(10)]
    chain = fresh(80)
    for _ in range(25):
        chain = edited(draw, chain, 2)
        texts.append("  ".join(chain).upper())
    passage = fresh(60)
    texts += [" ".join(fresh(60) + passage) for _ in range(40)]
    texts += ["a b", "A  b", "a b c", "a b c d", "b a"] * 2 + [texts[20]] * 30
    return texts


@pytest.mark.parametrize("shingle", [4, 5])
def test_components(spark, shingle):
    texts = groups()
    table = clashing(docs(spark, texts), "node", "comp", "key", "bands", "m")
    found = nd.near_duplicates(table, nd.Spec(shingle=shingle)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(brute.components(list(enumerate(texts)), shingle))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("block", [16, 8192])
def test_large_buckets_of_documents_that_are_not_linked(spark, block):
    """Short bands, so that texts with a shared passage meet in large buckets; they hold a few links as well."""
    draw = random.Random(9)
    fresh = lambda n: [f"v{draw.randrange(10**6)}" for _ in range(n)]
    passage, texts = fresh(60), []
    for i in range(150):
        base = fresh(12) + passage + fresh(12)
        texts.append(" ".join(base))
        if i % 10 == 0:
            texts += [" ".join(base[:-1] + fresh(1)), " ".join(fresh(2) + base[2:])]
    spec = nd.Spec(bands=24, rows=2, block=block, screen=0.5)
    found = nd.near_duplicates(docs(spark, texts), spec).collect()
    wanted = brute.components(list(enumerate(texts)))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(wanted)
    assert 100 < len({c for *_, c in wanted}) < len(texts)


def test_keep_first(spark):
    texts = groups(4)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[30]] * 3 + [(None, texts[30], "en", "s", 0), (None, "no other text is like this one", "en", "s", 0), (None, None, None, None, None)]
    kept = nd.keep_first(clashing(frame(spark, rows), "first", "n"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "first", "n"]
    ids = [r["doc_id"] for r in kept.collect()]
    wanted = [d for d, _, c in brute.components(list(enumerate(texts)), 4) if d == c]
    assert sorted(i for i in ids if i is not None) == wanted and ids.count(None) == 2


def test_keep_first_joins_tables_too_large_to_broadcast(spark, monkeypatch):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(i, same if i % 3 else f"{i} other words {i} that no other row {i} has", "en", "s", 0) for i in range(12)]
    rows += [rows[0]] * 2 + [(None, same, "en", "s", 0), (None, None, None, None, None)]
    table = clashing(frame(spark, rows), "_salt").withColumns({"m": F.create_map(F.lit("a"), "doc_id"), "a": F.array(F.struct("lang"))})
    wanted = sorted(map(str, nd.keep_first(table).collect()))
    assert len(wanted) == 6
    for module in (common, nd):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert sorted(map(str, nd.keep_first(table).collect())) == wanted


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_checked_beyond_broadcasts(spark, monkeypatch, how):
    big = spark.createDataFrame([(None if i % 5 == 0 else i % 5, f"t{i}", {"a": i}) for i in range(60)], "k long, v string, m map<string,long>")
    small = spark.createDataFrame([(None, "none"), (1, "one"), (7, "seven")], "k long, name string").repartition(2)
    small = small.select("k") if how in ("left_semi", "left_anti") else small
    wanted = sorted(map(str, common.join_checked(big, small, ["k"], how).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    joined = common.join_checked(big, small, ["k"], how)
    assert sorted(map(str, joined.collect())) == wanted
    assert len(wanted) == {"inner": 24, "left": 60, "left_semi": 24, "left_anti": 36}[how]


def test_empty(spark):
    assert nd.near_duplicates(frame(spark, [])).count() == 0
    alone = nd.near_duplicates(docs(spark, ["only one text here that is long enough", None])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in alone) == [(0, 0, True), (1, 1, True)]


@pytest.mark.parametrize("seed", range(3))
def test_connected(spark, seed):
    draw = random.Random(seed)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)]
    pairs += [(500, 501 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r["u"]: r["v"] for r in nd.connected(links).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_minima_are_those_of_the_hashes():
    spec = nd.Spec(bands=2, rows=3)
    a, b = spec.hashes()
    values = shingle_set("a b c d e f g h i", 4, WordHashes())
    x = [int(v ^ (v >> np.uint64(32))) & 0xFFFFFFFF for v in values]
    wanted = [min((int(m) * v + int(c)) % 2**32 for v in x) for m, c in zip(a.ravel(), b.ravel())]
    assert list(nd.minima(values, a, b, step=2)) == wanted


def test_rounds_lose_no_pair():
    """Every pair that passes the sketch is sent in some round, however components grow in between."""
    draw = np.random.default_rng(3)
    n = 60
    node, comp = np.arange(n) * 7, draw.integers(0, 4, n)
    i, j = np.nonzero(np.triu(draw.random((n, n)) < 0.9, 1))
    apart = draw.integers(0, 9, len(i))
    sent, number = [], 0
    while True:
        open_ = comp[i] != comp[j]
        rank = nd.ranked(i[open_], j[open_], apart[open_], comp, node)
        low, high = nd.GROWTH**number if number else 0, nd.GROWTH ** (number + 1)
        now = (rank >= low) & (rank < high)
        sent += list(zip(i[open_][now], j[open_][now]))
        if not (rank >= high).any():
            break
        comp[comp == 3] = 2
        number += 1
    assert number
    assert {(a, b) for a, b in zip(i, j) if comp[a] != comp[b]} <= set(sent)


def test_a_pair_belongs_to_one_band():
    draw = np.random.default_rng(5)
    bands = draw.integers(0, 2, (40, 6))
    i, j = np.nonzero(np.triu(np.ones((40, 40), bool), 1))
    owned = {}
    for band in range(6):
        same = bands[i, band] == bands[j, band]
        for pair in zip(i[same][nd.own_pairs(i[same], j[same], bands, band)], j[same][nd.own_pairs(i[same], j[same], bands, band)]):
            owned.setdefault(pair, []).append(band)
    assert all(len(v) == 1 for v in owned.values())
    assert set(owned) == {(a, b) for a, b in zip(i, j) if (bands[a] == bands[b]).any()}


def test_similar_is_all_pairs():
    """Blocks, sizes and sides against a plain double loop."""
    draw = np.random.default_rng(4)
    for side_of in (lambda k: -1, lambda k: k % 2):
        n = np.sort(draw.integers(5, 40, 90))
        comp, side = draw.integers(0, 6, 90), np.array([side_of(k) for k in range(90)])
        least = draw.integers(0, 4, (90, 64)).astype(np.uint32)
        least[30:60] = least[0]
        least[30:60, draw.integers(0, 64, 20)] ^= 1
        words = np.frombuffer(b"".join(map(nd.sketch, least)), "<u8").reshape(90, -1)
        i, j, apart = nd.similar(n, comp, words, side, 80, 20)
        wanted = {
            (a, b): int((least[a] != least[b]).sum())
            for a in range(90) for b in range(a + 1, 90)
            if comp[a] != comp[b] and 100 * n[a] >= 80 * n[b] and (side[a] < 0 or side[a] != side[b]) and (least[a] != least[b]).sum() <= 20
        }
        assert {(a, b): d for a, b, d in zip(i, j, apart)} == wanted and wanted


def bucket_of(texts, spec):
    """A bucket as its task gets it: every text a component of its own."""
    a, b = spec.hashes()
    sets = [shingle_set(t, spec.shingle, WordHashes()) for t in texts]
    least = [nd.minima(x, a, b) for x in sets]
    rows = [
        (7, None, i * 3, len(x), i * 3, nd.sketch(m), np.array([7] + [i] * (spec.bands - 1)), x.tobytes())
        for i, (x, m) in enumerate(zip(sets, least))
    ]
    return pd.DataFrame(rows, columns=["origin", "side", "node", "n_shingles", "comp", "sketch", "bands", "shingles"])


@pytest.mark.parametrize("most", [2, 9])
def test_a_bucket_sends_fewer_links_than_it_has_members(most):
    """Edited copies of one text, without it: most pairs are near the threshold, and were all sent on."""
    draw = random.Random(6)
    base = [f"v{draw.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(edited(draw, base, draw.randrange(1, most + 1))) for _ in range(120)]
    links = nd.merging_links(bucket_of(texts, nd.Spec()), nd.Spec())
    assert len(links) < len(texts)
    wanted = {d: c for d, _, c in brute.components(list(enumerate(texts)))}
    assert all(wanted[x // 3] == wanted[y // 3] for x, y in links)
    assert len(links) == len(texts) - len(set(wanted.values())) > 0


def test_sharing_is_the_share_of_the_union(monkeypatch):
    monkeypatch.setattr(nd, "AT_ONCE", 40)
    draw = np.random.default_rng(8)
    sets = [np.unique(draw.integers(0, 40, draw.integers(1, 60)).astype(np.uint64)) for _ in range(30)]
    i, j = (draw.integers(0, 30, 300) for _ in range(2))
    whole = [set(x.tolist()) for x in sets]
    wanted = [100 * len(whole[a] & whole[b]) >= 50 * len(whole[a] | whole[b]) for a, b in zip(i, j)]
    assert nd.sharing(i, j, sets, 50).tolist() == wanted and 0 < sum(wanted) < 300


def test_buckets_of_many_shingles_are_blocks_too(spark):
    rows = [(5, i, 100, i, 40, 4000) for i in range(40)] + [(6, i, 10, i, 3, 30) for i in range(3)]
    table = spark.createDataFrame(rows, "key long, node long, n_shingles long, comp long, m long, volume long")
    made = nd.in_blocks(table, 100, 1000).toPandas()
    assert len(made[made["origin"] == 6]) == 3
    large = made[made["origin"] == 5]
    assert large.groupby("key")["n_shingles"].sum().max() < 4000
    met = {tuple(sorted(p)) for _, g in large.groupby("key") for p in ((x, y) for x in g["node"] for y in g["node"] if x != y)}
    assert len(met) == 40 * 39 // 2
