"""Context trees over bytes, against the recursion itself."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import frame

from tsengine.llm import byte_tree as bt
from tsengine.llm import context_tree as ct

HELD = [i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
TEXTS = ["the cat 12 97", "the hat 12 97 12", "привет мир", "ему", "été à la", "", None, "the the the", "a=b_c {x}", "12 97 12 98 13 97"] * 2


def plain_logs(texts, training, depth, least=2):
    """Log10 probability of each byte string, decision by decision."""
    counts = defaultdict(Counter)  # (prefix, context, last byte first) -> outcomes
    strings = [ct.byte_string(ct.text_words(t)) for t in texts]

    def decided(data):
        for i, b in enumerate(data):
            context = tuple(data[i - k] if i >= k else 10 for k in range(1, depth + 1))
            for bit in range(8):
                yield (1 << bit) | (b >> (8 - bit)), context, (b >> (7 - bit)) & 1

    children = defaultdict(set)
    for data, known in zip(strings, training):
        for node, context, one in decided(data) if known else ():
            for d in range(depth + 1):
                counts[node, context[:d]][one] += 1
                if d:
                    children[node, context[: d - 1]].add(context[:d])

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def is_node(node, c):
        return not c or sum(counts[node, c].values()) >= least

    memo = {}

    def weigh(node, c):
        if (node, c) not in memo:
            n = counts[node, c]
            alone = kt(n[0], n[1])
            rest, below = Counter(n), 0.0
            for child in children[node, c] if len(c) < depth else ():
                if is_node(node, child):
                    rest.subtract(counts[node, child])
                    below += weigh(node, child)[0]
            whole = alone if len(c) == depth else math.log(0.5) + np.logaddexp(alone, below + kt(rest[0], rest[1]))
            memo[node, c] = whole, math.exp(math.log(0.5) + alone - whole), rest
        return memo[node, c]

    def predict(node, context, d):
        n = counts[node, context[:d]]
        own = (n[1] + 0.5) / (n[0] + n[1] + 1)
        if d == depth:
            return own
        _, share, rest = weigh(node, context[:d])
        deeper = is_node(node, context[: d + 1])
        below = predict(node, context, d + 1) if deeper else (rest[1] + 0.5) / (rest[0] + rest[1] + 1)
        return share * own + (1 - share) * below

    logs = []
    for data in strings:
        ones = [(predict(node, context, 0), one) for node, context, one in decided(data)]
        logs.append(sum(math.log10(p if one else 1 - p) for p, one in ones))
    return logs


@pytest.mark.parametrize("depth,size", [(8, 40), (8, 1 << 20), (3, 25), (2, 40)])
def test_logs_are_the_recursion(spark, depth, size):
    rows = [(str(i), t, i % 5 == 1) for i, t in enumerate(TEXTS)]
    blocks = bt.settle(bt.byte_blocks(spark.createDataFrame(rows, "doc_id string, text string, held_out boolean"), size), "t")

    def rows_of(group, scores):
        return group[["doc_id"]].assign(score=scores)

    string_of = lambda t: ct.byte_string(ct.text_words(t))
    made = bt.text_logs(blocks, string_of, rows_of, "doc_id string, score double", depth, size).collect()
    wanted = plain_logs(TEXTS, [not r[2] for r in rows], depth)
    assert {r["doc_id"]: r["score"] for r in made} == pytest.approx({str(i): w for i, w in enumerate(wanted)}, abs=1e-3)


def test_bytes_of_a_class_are_different_contexts(spark):
    """Which sign follows 1 and 2, or D0 and D1, is learned; digits and lead bytes were one class each."""
    pairs = [("1", "x"), ("2", "y"), ("й", "x"), ("щ", "y")]
    draw = random.Random(1)
    rows = [(i, " ".join(f"{a}{b}" for a, b in draw.choices(pairs, k=40)), "en", "s", 0) for i in range(40)]
    a, b = HELD
    rows += [(a, "1x 2y йx щy", "en", "s", 0), (b, "1y 2x йy щx", "en", "s", 0)]
    made = {r["doc_id"]: r["score"] for r in ct.language_scores(frame(spark, rows)).collect()}
    assert made[a] > made[b] + 4


def test_rare_contexts_count_beside_many_others(spark):
    """What was met three times is known whatever else is in the corpus; it was dropped below total / 2^share."""
    a, b = HELD
    rows = [(i, f"common words of text {i} " * 30, "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, "zqkjvb", "en", "s", 0) for i in range(15)] + [(a, "zqkjvb", "en", "s", 0), (b, "zqkvjb", "en", "s", 0)]
    made = {r["doc_id"]: r["score"] for r in ct.language_scores(frame(spark, rows)).collect()}
    assert made[a] > made[b] + 3


@pytest.mark.parametrize("depth", [8, 3])
def test_logs_over_many_spans(spark, depth):
    """Rows are dealt by their hash into spans of 48 bytes, and come out once each, rows that are alike too."""
    rows = [(str(i % 25), t, i % 5 == 1) for i, t in enumerate(TEXTS * 2)]
    made = bt.text_logs(
        spark.createDataFrame(rows, "doc_id string, text string, held_out boolean").repartition(3),
        lambda t: ct.byte_string(ct.text_words(t)),
        lambda group, scores: group[["doc_id"]].assign(score=scores),
        "doc_id string, score double",
        depth,
        8,
    ).collect()
    wanted = plain_logs([r[1] for r in rows], [not r[2] for r in rows], depth)
    got, wanted = sorted((r["doc_id"], r["score"]) for r in made), sorted((r[0], w) for r, w in zip(rows, wanted))
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in wanted], abs=1e-3)


def test_only_scores_are_written(spark, monkeypatch):
    """Texts and grams are shuffled once and not kept as tables; the grams alone went beyond the disk there is."""
    written, settle = [], ct.settle
    for module in (bt, ct):
        monkeypatch.setattr(module, "settle", lambda df, name: written.append(name) or settle(df, name))
    made = ct.language_scores(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]), ct.Spec(depth=3))
    assert made.count() == len(TEXTS) and written == ["scores"]


def test_packed_grams():
    """Grams of a span come back as they were, in less than the 17 bytes that each has."""
    draw = random.Random(4)
    strings = [ct.byte_string([draw.choice([b"the", b"cat", b"\xd0\xb9", b"hats"]) for _ in range(draw.randrange(0, 40))]) for _ in range(200)]
    span, seen = bt.Span(strings, 8), Counter()
    for _, (ctx, symbol, n) in bt.counted_grams(span, 150, 3, 4):
        back = bt.unpack_grams(packed := bt.pack_grams(ctx, symbol, n, 8), 8)
        assert all((a == b).all() for a, b in zip(back, (ctx, symbol, n))) and sum(map(len, packed)) < 12 * len(ctx) + 100
        keys = list(zip(ctx.tolist(), symbol.tolist()))
        assert keys == sorted(set(keys))
        seen.update(dict(zip(keys, n.tolist())))
    plain = Counter()
    for k, s in enumerate(strings):
        for i, b in enumerate(s):
            before = (b"\n" * 8 + s)[i : i + 8]
            plain[int.from_bytes(before, "little"), b] += k < 150
    assert seen == plain and set(seen) == set(plain)
