"""Toxicity, line quality and context trees."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from brute import low, words
from helpers import awkward, clashing, docs, frame

from tsengine.llm import context_tree as ct
from tsengine.llm import line_crf, queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_folding():
    assert toxicity.folded("You 1D10T, m0ron!") == " you idiot moron "
    assert toxicity.folded("іdіοt ѕtuр​id") == " idiot stupid "
    assert toxicity.folded("ｆｏｏ 2024 x2") == " foo x "
    assert toxicity.folded(None) == toxicity.folded(" \n") == "  "
    assert toxicity.folded("Été élan") == " été élan "
    assert toxicity.folded("w0rthl355 idio7 sh|t !diot 8itch ba6!") == " worthless idiot shit idiot bitch bag "
    assert toxicity.readings("1oser") == [" ioser ", " loser "] and toxicity.readings("c1own x") == [" ciown x ", " clown x "]
    assert toxicity.readings("1 or 11, well!") == [" or well "]


def test_hits_are_those_of_a_plain_scan():
    """Every entry at every place of every reading, one by one."""
    import random

    draw = random.Random(6)
    letters = "ab1l "
    for _ in range(150):
        lexicon = {" " + "".join(draw.choice("abl ") for _ in range(draw.randrange(1, 4))): float(draw.randrange(1, 9)) for _ in range(6)}
        exceptions = [" " + "".join(draw.choice("abl") for _ in range(draw.randrange(2, 6))) for _ in range(2)]
        exceptions = [e for e in exceptions if e not in lexicon]
        match = toxicity.Matcher(toxicity.Model(lexicon, exceptions))
        ways = toxicity.readings("".join(draw.choice(letters) for _ in range(40)))
        wanted = {}
        for way in ways:
            spared = [(i, i + len(e) - 1) for e in exceptions for i in range(len(way)) if way.startswith(e, i)]
            for entry, weight in lexicon.items():
                for i in range(len(way)):
                    last = i + len(entry) - 1
                    if way.startswith(entry, i) and not any(a <= i and last <= b for a, b in spared):
                        wanted[i] = max(wanted.get(i, 0.0), weight)
        assert {first: weight for first, _, weight in match.hits(*ways)} == wanted


def test_matcher_prefers_the_heaviest_and_spares_exceptions():
    model = toxicity.Model({" idio": 2.0, " idiot ": 3.0, " clown ": 1.5}, [" class clown "])
    match = toxicity.Matcher(model)
    assert [h[2] for h in match.hits(toxicity.folded("An idiot, idiotic"))] == [3.0, 2.0]
    assert match.hits(toxicity.folded("the class clown")) == []
    assert len(match.hits(toxicity.folded("class clown clown"))) == 1
    assert toxicity.Matcher(toxicity.Model()).facts("anything") == (0.0, 0.0)
    # The same hits weigh less in a longer text.
    assert match.facts("idiot")[1] > match.facts("idiot " + "word " * 50)[1]


def test_toxicity_learns_words_and_beginnings(spark):
    draw = random.Random(1)
    plain = [f"p{draw.randrange(400)}" for _ in range(4000)]
    texts, labels = [], []
    for i in range(900):
        body = [draw.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            body[draw.randrange(40)] = draw.choice(["nasty", "n4sty", f"grmbl{draw.randrange(10**6)}", "NASTY!"])
        elif i % 8 == 1:
            body[5:7] = ["not", "nasty"]
        texts.append(" ".join(body))
        labels.append((i, 1, int(bad)))
    table, marks = clashing(docs(spark, texts + awkward()), "y", "score"), frame(spark, labels + [(None, 1, 1), (5, None, None)], LABELS)
    model = toxicity.learn(table, marks, modulus=5, held=0)
    assert " not nasty " in model.exceptions and any(k.startswith(" grm") for k in model.lexicon)
    scored = {r["doc_id"]: r["s"] for r in table.select("doc_id", toxicity.score(table["text"], model).alias("s")).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((scored[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert all(scored[i] < 0.5 for i in range(900, 900 + len(awkward())))
    kept = toxicity.keep_clean(table, marks)
    assert kept.columns == table.columns and not {r["doc_id"] for r in kept.collect()} & {i for i in held if i % 4 == 0}


def test_toxicity_without_labels(spark):
    table = docs(spark, awkward())
    for marks in ([], [(3, 1, 1)], [(i, 1, 0) for i in range(8)]):
        model = toxicity.learn(table, frame(spark, marks, LABELS))
        scores = [r[0] for r in table.select(toxicity.score(table["text"], model)).collect()]
        assert len(set(scores)) == 1 and scores[0] < 0.5


@pytest.mark.parametrize("name,label,least", [("op2_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    made = queries.QUERIES[name](spark, folder).toPandas()
    known = made.merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    held = known[known.held_out]
    modulus, remainder = (4, 2) if label == "quality" else (5, 0)
    assert all(held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % modulus) == remainder) and len(held) > 50
    assert (held.predicted == held[label]).mean() >= least
    assert made.score.between(0, 1).all() and len(made) == 1000


def test_chain_is_the_sum_over_all_labellings():
    draw = np.random.default_rng(2)
    sizes = np.array([1, 4, 2, 5])
    unary, switch = draw.normal(size=sizes.sum()), draw.normal(size=(2, 2))
    good, pairs, whole = line_crf.chain(unary, sizes, switch)
    at, seen, logs = 0, np.zeros((2, 2)), 0.0
    for n in sizes:
        weights, own, edges = [], np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(u * y for u, y in zip(unary[at : at + n], labels)) + sum(switch[a, b] for a, b in zip(labels, labels[1:])))
            weights.append(w)
            own += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                edges[a, b] += w
        assert good[at : at + n] == pytest.approx(own / sum(weights))
        seen, logs, at = seen + edges / sum(weights), logs + math.log(sum(weights)), at + n
    assert pairs == pytest.approx(seen) and whole == pytest.approx(logs)


def test_line_measures_do_not_depend_on_the_batch():
    texts = awkward()
    whole, length, n_lines = line_crf.measure_lines(texts)
    single = [line_crf.measure_lines([t]) for t in texts]
    assert n_lines.tolist() == [(t or "").count("\n") + 1 for t in texts]
    assert np.array_equal(whole, np.concatenate([s[0] for s in single])) and np.array_equal(length, np.concatenate([s[1] for s in single]))
    model = line_crf.Model(np.random.default_rng(1).normal(size=line_crf.FEATURES), np.eye(2), 0.5)
    scores = line_crf.score_texts(texts, model)
    assert scores == pytest.approx(line_crf.score_texts(texts, model, line_crf.Spec(slab=1)))
    assert ((0 <= scores) & (scores <= 1)).all()


def test_quality_without_labels(spark):
    table = docs(spark, awkward())
    for marks in ([], [(i, 1, 0) for i in range(8)]):
        model = line_crf.learn(table, frame(spark, marks, LABELS))
        assert len({r[0] for r in table.select(line_crf.score(table["text"], model)).collect()}) == 1
    empty = frame(spark, [])
    assert empty.select(line_crf.score(empty["text"], model)).count() == 0


def prose(n=120, seed=3):
    draw = random.Random(seed)
    parts = ["th", "er", "an", "ing", "re", "é", "on"]
    word = lambda: "".join(draw.choice(parts) for _ in range(draw.randrange(1, 4)))
    known = [word() for _ in range(60)]
    return [" ".join(draw.choice(known) for _ in range(draw.randrange(1, 60))) for _ in range(n)] + awkward()


@pytest.mark.parametrize("hot", [3, 100_000])
def test_language_scores(spark, hot):
    texts = prose()
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "th an unseenword", None, None, None), (7, texts[7], "en", "s", 0)]
    made = ct.language_scores(clashing(frame(spark, rows), "row", "word", "c"), ct.Spec(depth=5, hot=hot)).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, text, *_ in rows:
        if not held(i):
            counts.update([*words(low(text)), "\n"])
    n, v = sum(counts.values()), len(counts)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in made)
    tokens = {k: [*words(low(t)), "\n"] for k, (_, t, *_) in enumerate(rows)}
    assert got == sorted((str(r[0]), held(r[0]), len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n) for k, r in enumerate(rows))
    base = {str(r[0]): sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[k]) for k, r in enumerate(rows)}
    assert {str(r["doc_id"]): r["base_score"] for r in made} == pytest.approx(base)
    # The tree knows the language: it beats the words' baseline on what it hasn't seen, and an even guess by far.
    unseen = [r for r in made if r["held_out"] and 20 < r["n_tokens"] < 100]
    assert sum(r["score"] for r in unseen) > 0.4 * sum(-math.log10(64) * 4 * r["n_tokens"] for r in unseen)


def test_language_scores_without_training(spark):
    made = ct.language_scores(frame(spark, [(None, "a b", None, None, None), (None, None, None, None, None)]), ct.Spec(depth=5)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in made) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert ct.language_scores(frame(spark, []), ct.Spec(depth=5)).count() == 0
