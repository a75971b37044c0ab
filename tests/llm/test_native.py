"""Decontamination, host rules and mixing against plain versions."""

import random

import brute
import pytest
from helpers import awkward, clashing, docs, frame
from pyspark.sql import functions as F

from tsengine.llm import decontamination, host_rules, mixing

ITEMS = "item_id long, text string"


def texts_with_items(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    some = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, some(draw.choice([1, 2, 4, 5, 7, 9, 10, 11, 25]))) for i in range(30)]
    items += [(3, items[3][1]), (100, items[20][1]), (101, None), (102, "  "), (None, some(12)), (103, "W5, w6! w7-w8")]
    made = []
    for _ in range(80):
        parts = [some(draw.randrange(0, 30))]
        for _ in range(draw.randrange(0, 4)):
            parts += [draw.choice(items)[1] or "", some(draw.randrange(0, 6))]
        made.append(draw.choice([" ", ", ", "\n"]).join(parts))
    return made + awkward(), items


def contaminated(df, items, spec=decontamination.Windows()):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(tuple, decontamination.contamination(df, items, spec).select(*names).collect()))


@pytest.mark.parametrize("spec", [decontamination.Windows(), decontamination.Windows(per_pass=17), decontamination.Windows(size=4, shingle=2)])
def test_contamination(spark, spec):
    texts, items = texts_with_items(3)
    table = clashing(docs(spark, texts), "pos", "shingle_id", "n_words", "k", "start")
    wanted = sorted(brute.contamination(enumerate(texts), items, spec.size))
    got = contaminated(table, clashing(frame(spark, items, ITEMS), "window_id", "k", "words"), spec)
    assert got == wanted
    assert sum(r[-1] for r in wanted) > 30


def test_contamination_of_repeated_rows_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"x {item} y", "en", "s", 0)] * 3 + [(None, item, "en", None, 0)] * 2 + [(1, "other", "en", "s", 0)]
    items = frame(spark, [(7, item)], ITEMS)
    found = decontamination.contamination(frame(spark, rows), items).select("doc_id", "n_hit", "contaminated").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 10, True)] * 3 + [(None, 10, True)] * 2 + [(1, 0, False)], key=str)
    assert decontamination.contamination(frame(spark, []), items).count() == 0
    assert contaminated(frame(spark, rows[:1]), frame(spark, [], ITEMS))[0][2:4] == (0, 0)
    kept = decontamination.keep_clean(clashing(frame(spark, rows), "_copy"), items)
    assert [(r["doc_id"], r["text"], r["_copy"]) for r in kept.collect()] == [(1, "other", "clash")]


def test_rule_counts(spark):
    texts = [*awkward(), "a b c a b c a b", "x x x x", "p q r s p q r t q r s", "# $ %\n# $ %\n\n\n# $ %", "<a> |b| &c*"]
    counts = host_rules.measure(docs(spark, texts).select("doc_id", "source", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in counts.collect()}
    assert got == {i: brute.rule_counts(t) for i, t in enumerate(texts)}


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(80))
    bad = "short"
    rows = [(i, good if i % 10 else bad, "en", f"h{i % 7}", 0) for i in range(700)]
    rows += [(1000 + i, bad if i else good, "en", "junk", 0) for i in range(60)]
    rows += [(2000, bad, "en", "young", 0), (2001, good, "en", "young", 0), (2002, good, "en", None, 0), (None, None, None, None, None)]
    judged = host_rules.judge(clashing(frame(spark, rows), "n", "host_ok").select("doc_id", "source", "text"))
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in judged.collect()}
    assert kept[1000] == (False, False), "a good document of a host that fails nearly always"
    assert kept[2001] == (False, True), "one failure of two says little about a host"
    assert kept[2002] == (False, True) and kept[None] == (True, False) and kept[1] == (False, True) and kept[0] == (True, False)
    assert host_rules.judge(frame(spark, []).select("doc_id", "source", "text")).count() == 0


def water(sizes, weights, most=3):
    """Shares by weight; what is above the cap is shared again among the others."""
    total, capped = sum(sizes), {}
    while True:
        left = total - sum(capped.values())
        free = [i for i in range(len(sizes)) if i not in capped]
        whole = sum(weights[i] for i in free)
        target = {i: left * weights[i] / whole for i in free}
        above = {i: most * sizes[i] for i in free if target[i] > most * sizes[i] + 1e-9}
        if not above:
            return [capped.get(i, target.get(i)) for i in range(len(sizes))]
        capped |= above


def test_targets(spark):
    sizes = {"b": 1000, "a": 10, "ä": 500, "Z": 0, None: 40, "c": 3, "zz": 7000}
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes.items())]
    made = mixing.targets(frame(spark, rows, "doc_id long, source string, size long")).orderBy("source_no").collect()
    order = ["Z", "a", "b", "c", "zz", "ä", None]
    assert [r["source"] for r in made] == order
    wanted = water([sizes[s] for s in order], [1, 2, 3, 1, 2, 3, 1])
    assert [r["target"] for r in made] == pytest.approx(wanted)
    assert all(r["n_draws"] <= 3 * r["n_blocks"] for r in made)


def corpus(n=900, seed=2):
    draw = random.Random(seed)
    big = lambda i: "s0" if i % 3 == 0 else None if i % 97 == 0 else f"s{i % 11}"
    return [(i, " ".join(["w"] * draw.choice([0, 1, 5, 60, 300, 900])), "en", big(i), 0) for i in range(n)]


def test_mix(spark):
    rows = corpus() + [(5, "w w w", "en", "s5", 0)] * 2 + [(None, None, None, None, None)]
    made = mixing.taken(clashing(frame(spark, rows), "size", "start", "index")).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in made) == sorted((str(r[0]), len((r[1] or "").split())) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in made)
    by = {}
    for r in made:
        by.setdefault((r["target"], r["source_size"]), []).append(r["taken"])
    for (target, _), taken in by.items():
        assert abs(sum(taken) - target) <= 130, (target, sum(taken))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = mixing.taken(frame(spark, rows)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, ((str(r["doc_id"]), r["taken"]) for r in made))) == sorted((str(r["doc_id"]), r["taken"]) for r in again)
    assert mixing.taken(frame(spark, [])).count() == 0


def test_draws_use_all_blocks_before_any_again(spark):
    rows = [(i, "s" if i % 2 else "t", 640) for i in range(400)]
    sizes = frame(spark, rows, "doc_id long, source string, size long")
    sources = mixing.targets(sizes)
    counts = mixing.shard_counts(sources, mixing.Plan(shard=256)).cache()
    draws = mixing.draw(counts).cache()
    n = {r["source_no"]: (r["n_blocks"], r["n_draws"]) for r in sources.collect()}
    for source_no, (blocks, total) in n.items():
        used = [r["times"] for r in draws.where(F.col("source_no") == source_no).groupBy("index").agg(F.count("*").alias("times")).collect()]
        assert sum(used) == total and max(used) == -(-total // blocks) and (total < blocks or len(used) == blocks)
    # The draws are those of the shards' counts; every shard but the last is full.
    shares = {(r["shard"], r["source_no"]): r["n"] for r in counts.collect()}
    assert shares == {(r["shard"], r["source_no"]): r["count"] for r in draws.groupBy("shard", "source_no").count().collect()}
    slots = sum(t for _, t in n.values())
    shards = -(-slots // 256)
    assert [sum(c for (k, _), c in shares.items() if k == shard) for shard in range(shards)] == [256] * (shards - 1) + [slots - 256 * (shards - 1)]
    for source_no, (_, total) in n.items():
        mine = [c for (k, s), c in shares.items() if s == source_no and k < shards - 1]
        mean = 256 * total / slots
        assert all(abs(c - mean) < 6 * mean**0.5 for c in mine) and len(set(mine)) > 1


def test_draws_are_made_in_many_tasks(spark):
    """One row a source: what comes of it is spread before it is made, and again before blocks are named."""
    sources = mixing.targets(frame(spark, [(0, "a", 30_000_000), (1, "b", 900)], "doc_id long, source string, size long"))
    tasks = mixing.draw(mixing.shard_counts(sources)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 0.7 * sum(r["count"] for r in tasks)


def test_a_third_of_all_rows_the_same(spark):
    same = [(7, "one two three four five", "en", "hot", 0)] * 5_000
    rows = same + [(None, "x y", "en", "hot", 0)] * 300 + [(i, f"a{i} " * 9, "en", f"s{i % 3}", 0) for i in range(100, 4_000)]
    table = frame(spark, rows)
    taken = mixing.taken(table).collect()
    assert len(taken) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in taken)
    placed = mixing.place(mixing.sized(table), mixing.targets(mixing.sized(table)))
    assert placed.count() == 2 + 3_900
    words = sum(len(r["text"].split()) for r in mixing.mixed_documents(table).collect())
    assert words == sum(r["taken"] for r in taken)


def test_mixed_documents(spark):
    texts = [(i, "\n".join(f"d{i} w{j}  x" for j in range(n)), "en", s, 0) for i, (n, s) in enumerate([(200, "a"), (30, "b"), (400, "c"), (1, "b"), (0, "a")])]
    texts.append(texts[1])
    names = ["_copy", "times", "copy", "row", "key", "mark", "size", "pieces", "chosen", "all_words", "mixed"]
    table = clashing(frame(spark, texts), *names)
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns
    assert all(r[n] == "clash" for r in mixed.collect() for n in names)
    words = {}
    for r in mixed.collect():
        whole = texts[r["doc_id"]][1]
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split("\n")) <= {x for x in whole.split("\n")} | {p for p in r["text"].split("\n")}
        assert r["text"] == whole or all(w in whole.split() for w in r["text"].split())
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    taken = {}
    for r in mixing.taken(table).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    # The marks of the blocks are the same, whatever the order of repeated rows.
    assert sum(words.values()) == sum(taken.values())
    assert {k: v for k, v in taken.items() if v and k not in (1, 3)} == {k: v for k, v in words.items() if k not in (1, 3)}
