"""The alignment next to a plain one, token by token, with the libraries' own encoders."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, clashing, docs, frame

from tsengine.llm import token_alignment as ta

SPEC = ta.Spec()


@pytest.fixture(scope="module")
def encoders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(SPEC.byte_level)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=SPEC.pieces)


def plain_tokens(text, encoders):
    """(id, begin, end) of both kinds, or nothing."""
    if not text:
        return [], []
    a, b = encoders
    alphabet = ta.byte_alphabet()
    sides = []
    for ids, value in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(alphabet[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, side, raw = 0, [], b""
        for i in ids:
            raw += value(i)
            side.append((i, at, len(raw)))
            at = len(raw)
        if raw != (" " + text).encode():
            return [], []
        sides.append(side)
    return sides


def plain(rows, encoders):
    made = []
    for doc_id, text in rows:
        a, b = plain_tokens(text, encoders)
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], {id(a): 0, id(b): 0}
        for end in common:
            own = []
            for side in (a, b):
                own.append([])
                while start[id(side)] < len(side) and side[start[id(side)]][2] <= end:
                    own[-1].append(str(side[start[id(side)]][0]))
                    start[id(side)] += 1
            groups.append("|".join(map(",".join, own)))
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            at = first
            while at < len(b) and b[at][1] < e:
                links.append((i, b[at][0]))
                at += 1
        made.append((doc_id, len(a), len(b), groups, links))
    held = Counter(p for *_, links in made for p in set(links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [
        (d, na, nb, len(g), len(ln), sum(held[p] == most[p[0]] for p in ln), sum(held[p] for p in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, na, nb, g, ln in made
    ]


def key(row):
    return [(v is None, str(v)) for v in row]


def check(spark, rows, encoders, spec=SPEC, table=None):
    table = table if table is not None else frame(spark, [(d, t, "en", "s", 0) for d, t in rows])
    made = [tuple(r) for r in ta.counted(table, spec).collect()]
    assert sorted(made, key=key) == sorted(plain(rows, encoders), key=key)
    return made


def prose(seed, words):
    draw = random.Random(seed)
    parts = ["antidisestablishment", "the", "Straße", "naïve", "1234567", "don't", "x", "re-enter", "日本語テキスト", "é", "🙂", "if(x){y++;}", "http://a.b/c?d=e"]
    return "".join(draw.choice(parts) + draw.choice([" ", " ", " ", "\n", "  ", "\t", ", "]) for _ in range(words))


def test_against_plain(spark, encoders):
    rows = [(i, prose(i, 5 + 7 * i)) for i in range(25)] + [(100 + i, t) for i, t in enumerate(awkward())]
    rows += [(200, "<|endoftext|> and <s> </s> <0x41> <unk>"), (201, "a ▁ b"), (202, "\x00a"), (203, "﻿x​ y z　"), (204, " lead  and trail  ")]
    check(spark, rows, encoders)


def test_ranges_of_long_texts(spark, encoders):
    """Tiny ranges: every text is cut into many, inside words too, and composed in several rounds; blocks of few pairs."""
    rows = [(i, prose(i, 300)) for i in range(4)] + [(9, "internationalization misunderstanding " * 120), (10, "ab" * 700), (11, " " * 900 + "x"), (12, "a ▁ b " * 90)]
    spec = ta.Spec(range_bytes=96, fan_in=3, block_pairs=200)
    check(spark, rows, encoders, spec)
    raw = b" " + rows[9 - 5][1].encode()
    cuts = ta.ranges(raw, 96, True)
    assert len(cuts) > 20 and [c[0] for c in cuts[1:]] == [c[1] for c in cuts[:-1]] and any(raw[c[0] - 1 : c[0]].isalpha() and raw[c[0] : c[0] + 1].isalpha() for c in cuts)


def test_awkward_rows(spark, encoders):
    long = "one very long text of many words, " * 12_000
    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (None, None), (2, ""), (3, long), (None, long)]
    table = frame(spark, [(d, t, None, None, None) for d, t in rows])
    made = check(spark, rows, encoders, table=clashing(table, "rid", "seq", "codes", "size", "fragment", "a", "code"))
    assert sum(r[0] is None for r in made) == 3
    # One word of a megabyte: no place to cut, so one range.
    (word,) = ta.counted(frame(spark, [(4, "x" * 1_000_000, None, None, None)])).collect()
    assert word["n_groups"] > 0 and word["n_links"] == word["n_a"] + word["n_b"] - word["n_groups"] and len(word["groups_sha256"]) == 64
    assert ta.counted(frame(spark, [])).collect() == []


def test_session_setting_is_put_back(spark, encoders):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7777")
    check(spark, [(1, "a b c")], encoders)
    assert spark.conf.get(name) == "7777"
    spark.conf.set(name, before)


def test_composing_is_associative():
    """Any tree over any cuts gives what the whole text gives."""
    draw = random.Random(1)
    pair = ta.Pair.open(SPEC)
    width = len(pair.b.bytes)
    for seed in range(12):
        ((a_ids, b_ids),) = pair.ids([" " + prose(seed, 60)])
        (a, a_ends, _), (b, b_ends, _) = ta._ranges([a_ids], pair.a_sizes), ta._ranges([b_ids], pair.b_sizes)
        run = ta.Run(a, a_ends, b, b_ends)
        cuts = [0, *sorted(draw.sample(range(1, int(a_ends[-1])), 30)), int(a_ends[-1])]
        parts = [ta.fragment(run.part(low, high), width) for low, high in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            i = draw.randrange(len(parts) - 1)
            parts[i : i + 2] = [ta.joined(parts[i], parts[i + 1], width)]
        for made, wanted in zip(ta.whole(parts[0], width).parts(), ta.closed(run, width).parts()):
            assert np.array_equal(np.sort(made) if made.dtype is wanted.dtype and len(made) != len(wanted) else made, wanted)
        assert not len(parts[0].tail.a) and parts[0].same


def test_spans(spark, encoders):
    text = prose(3, 40)
    row = ta.align(docs(spark, [text, None]), spans=True).where("doc_id = 0").first()
    a, b = plain_tokens(text, encoders)
    assert row["a_ids"] == [i for i, _, _ in a] and row["b_ids"] == [i for i, _, _ in b]
    assert sum(row["a_sizes"]) == len(a) and sum(row["b_sizes"]) == len(b) and len(row["a_sizes"]) == row["n_groups"]


def test_packing_of_numbers():
    draw = np.random.default_rng(2)
    for n in (0, 1, 500):
        values = np.sort(draw.choice(50_257 * 32_000, n, replace=False))
        assert np.array_equal(ta.unpacked_sorted(ta.packed_sorted(values)), values)
        for most in (1, 300, 70_000):
            times = draw.integers(0, most, n)
            assert np.array_equal(ta.unpacked(ta.packed(times)), times)


def test_encoders_agree(spark, tiny, encoders):
    """Whole documents, and an endless run of blanks."""
    pair = ta.Pair.open(SPEC)
    texts = [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").collect() if r["text"]] + [" " * 3_000, "\n" * 3_000]
    for text, ids in zip(texts, pair.a.encode(texts)):
        assert ids == encoders[0].encode(text, add_special_tokens=False).ids
