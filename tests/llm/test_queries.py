"""The registered queries, and the pipeline's stages."""

import brute
import check
import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from helpers import awkward, clashing, frame

import __spark_entry__ as entry
from tsengine.llm import packing
from tsengine.llm.queries import ORACLES, QUERIES


def test_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLES) <= set(entry.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, tiny, name, monkeypatch):
    monkeypatch.setattr(check, "QUERIES", QUERIES)
    monkeypatch.setattr(check, "ORACLES", ORACLES)
    verdict, rows, _, _ = check.compare(spark, check.connect(tiny), name, tiny)
    assert verdict.startswith("ok") and rows > 0, verdict


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_rows(spark, tiny, name):
    made = QUERIES[name](spark, tiny).toPandas()
    if name == "op6_pack":
        assert sorted({d for ids in made.doc_ids for d in ids}) == list(range(200))
    else:
        key = "page_id" if "page_id" in made else "doc_id"
        assert sorted(made[key]) == list(range(50 if key == "page_id" else 200))


def test_main_texts(spark, tiny):
    """The pages here hold their article in one element."""
    pages = pd.read_parquet(f"{tiny}/pages.parquet").set_index("page_id")
    made = QUERIES["op8_main_text"](spark, tiny).toPandas().set_index("page_id")
    import html
    import re

    for page_id, row in made.iterrows():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages.html[page_id], re.S)[1]
        plain = html.unescape(re.sub(r"</?b>", "", inner).replace("<", " <")) if "&" not in inner else None
        if plain:
            assert row.text == " ".join(re.sub(r"<[^>]+>", " ", plain).split())


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "packing"]
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        made = stage(spark, docs, tiny)
        if name == "packing":
            assert {d for r in made.collect() for d in r["doc_ids"]} == set(before)
            break
        assert made.columns == docs.columns
        after = made.collect()
        left = {r["doc_id"] for r in after}
        assert left <= set(before)
        if name == "near_duplicates":
            assert left == {d for d, _, c in brute.components(sorted(before.items()), 5) if d == c} and len(after) == len(left)
        if name == "decontamination":
            assert left == {r[0] for r in brute.contamination(before.items(), items) if not r[-1]}
        docs = spark.createDataFrame(after, made.schema)


def test_stages_on_awkward_rows(spark, tiny):
    names = ["score", "n", "first", "size", "start", "_copy", "text_hash", "pos", "sequence", "row", "key", "mark", "_toxicity_score", "_dup_id", "_bad_hash", "_r_key"]
    long = [(90, " ".join(f"word{i % 7_001}" for i in range(20_000)), "en", "s0", 0), (91, "x" * 1_000_000, "en", "s1", 0)]
    rows = long + [(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate(awkward())]
    rows += [rows[len(long) + 4]] * 2 + [(None, None, None, None, None), (None, "a text of its own that nothing else here is like", None, None, None)]
    kept = {}
    for table in (frame(spark, rows), frame(spark, [])):
        full = clashing(table, *names)
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, full, tiny)
            kept[name, bool(table.count())] = [r.asDict() for r in made.collect()]
            if name != "packing":
                assert made.columns == full.columns
                assert all(r[n] == "clash" for r in kept[name, bool(table.count())] for n in names)
    assert not any(v for (_, some), v in kept.items() if not some)
    assert len(kept["toxicity", True]) == len(kept["decontamination", True]) == len(rows)
    ids = [r["doc_id"] for r in kept["near_duplicates", True]]
    assert sorted(i for i in ids if i is not None) == [i for i in range(len(awkward())) if i not in (5, 6)] + [90, 91] and ids.count(None) == 2
    texts = {i: t for i, t, *_ in rows}
    assert all(r["text"] and (r["doc_id"] is None or set(r["text"].split()) <= set(texts[r["doc_id"]].split())) for r in kept["mixing", True])
    assert sum(len(r["doc_ids"]) for r in kept["packing", True] if r) >= len(rows)


def test_run(spark, tiny):
    made = corpus_pipeline.run(spark, tiny)
    spec = packing.Spec()
    rows = made.collect()
    assert rows and all(len(np.frombuffer(r["input_ids"], spec.ids())) == spec.length for r in rows)
