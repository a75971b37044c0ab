"""Small tables with what is awkward in them."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    """Rows as a DataFrame of a few partitions."""
    return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)


def docs(spark, texts, source=lambda i: f"s{i % 3}"):
    """Documents numbered from 0."""
    return frame(spark, [(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)])


def awkward(seed=5):
    """Texts: none, empty, blanks only, one word, repeated, long, many scripts, odd white space."""
    draw = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "straße", "delta,", "ε", "|", "!!", "###", "x-y", "42"]
    long = " ".join(draw.choice(words) for _ in range(3000))
    lines = "\n".join(" ".join(draw.choice(words) for _ in range(draw.randrange(0, 9))) for _ in range(60))
    same = "one two three four five six seven eight nine ten eleven"
    return [None, "", "   \n\t ", "word", same, same, same.upper(), long, lines, "a\x0bb\x0cc\r\nd  e\xa0f", "\U0001f600 " * 30, "z " * 200]


def clashing(df, *names):
    """The same rows with further columns whose names an operator may use itself."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names})
