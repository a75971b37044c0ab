"""Benchmark decontamination: which documents hold a window of a benchmark item.

A prefix-filtered set join. A window is ``size`` consecutive words of an item (all
of them, if it has fewer). Its shingles are ordered by rarity in the documents; a
document that holds the window holds its rarest shingle, so that one is the whole
prefix that has to be joined. The shingle's place in the window fixes where the
window starts in the document (positional bound) and that it must end inside it
(length bound). What remains is verified with the shingles that cover the window,
at their exact places.

The documents are read once: the occurrences of benchmark shingles that this pass
finds carry everything later steps need.

Defined results: NULL text has no words, so no windows; an item without words is
ignored, one without id counts for the hits but not as an item; items that repeat
are one; repeated documents (same id, same text) give a row each; an empty
benchmark hits nothing; columns beyond those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tsengine.llm.common import join_checked, lower_ascii, packed_rows, settle, split_words, unpacked_rows

#: Separators of words: every ASCII character but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["doc_id", "text_hash"]


@dataclass(frozen=True)
class Windows:
    """``size``: words of a window; ``shingle``: words of a shingle; ``per_pass``: benchmark shingles broadcast at once."""

    size: int = 10
    shingle: int = 5
    per_pass: int = 250_000


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def item_windows(items: DataFrame, spec: Windows = Windows()) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``window_id``, ``k``, ``words``), and the items that have them."""
    worded = items.select(F.col("item_id"), words_of(F.col("text")).alias("_w")).where("size(_w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - spec.size, F.lit(0)))
    cut = worded.select("item_id", "_w", F.explode(starts).alias("_s")).select(
        "item_id", F.slice("_w", F.col("_s") + 1, F.lit(spec.size)).alias("words")
    )
    cut = cut.select("item_id", F.array_join("words", " ").alias("window"), "words")
    distinct = cut.groupBy("window").agg(F.first("words").alias("words"))
    windows = settle(
        distinct.select(F.monotonically_increasing_id().alias("window_id"), "window", F.size("words").alias("k"), "words"),
        "windows",
    )
    owners = cut.select("item_id", "window").join(windows.select("window", "window_id"), "window")
    return windows, settle(owners.select("window_id", "item_id").distinct(), "window-items")


def window_shingles(windows: DataFrame, spec: Windows) -> DataFrame:
    """A row per window and offset; ``q`` words, fewer only if the window has fewer."""
    q = F.least(F.lit(spec.shingle), F.col("k"))
    offsets = windows.withColumn("q", q).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("q"))))
    shingle = F.array_join(F.slice("words", F.col("offset") + 1, F.col("q")), " ")
    return offsets.select("window_id", "k", "q", "offset", shingle.alias("shingle"))


def _hash(words: Column, at: Column, q: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(q)])


def occurrences(docs: DataFrame, shingles: DataFrame, spec: Windows) -> DataFrame:
    """A row for each place of a benchmark shingle in a document, and one at -1 for each document.

    ``shingles``: ``shingle_id``, ``shingle``, ``q``; settled. Beyond ``per_pass`` of
    them, blocks of shingles are joined one after the other.
    """
    sizes = sorted(r["q"] for r in shingles.select("q").distinct().collect())  # at most spec.shingle values
    count = shingles.count()
    passes = max(1, -(-count // spec.per_pass))
    text = F.col("text")
    worded = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words_of(text).alias("_w"))
    worded = worded.withColumn("n_words", F.size("_w").cast("long"))
    at, w = F.col("pos"), F.col("_w")
    spread = worded.withColumn("pos", F.explode(F.sequence(F.lit(-1), F.size("_w") - 1)))
    if len(sizes) > 1:
        spread = spread.withColumn("_q", F.explode(F.array(*map(F.lit, sizes))))
        spread = spread.where(f"pos >= 0 OR _q = {sizes[0]}")
    else:
        spread = spread.withColumn("_q", F.lit(sizes[0] if sizes else 1))
    key = F.lit(None).cast("long")
    for q in sizes:
        key = F.when((F.col("_q") == q) & (at >= 0) & (at + q <= F.size(w)), _hash(w, at, q)).otherwise(key)
    spread = spread.withColumn("_h", key)
    listed = shingles.withColumn("_key", key_of_text(shingles, sizes))
    found = None
    for number in range(passes):
        part = listed.where(F.pmod("shingle_id", F.lit(passes)) == number) if passes > 1 else listed
        same = F.array_join(F.slice("_w", F.greatest(at, F.lit(0)) + 1, F.col("_q")), " ") == F.col("shingle")
        same = F.coalesce(same, F.lit(False))  # a condition on the rows of equal hashes, not a second key for all rows
        joined = spread.join(F.broadcast(part.select("_key", "shingle", "shingle_id")), (F.col("_h") == F.col("_key")) & same, "left")
        hit = F.col("shingle_id").isNotNull()
        joined = joined.where(hit | (at == -1) if number == 0 else hit).select(*KEY, "n_words", "pos", "shingle_id")
        found = joined if found is None else found.unionByName(joined)
    return found


def key_of_text(shingles: DataFrame, sizes: list[int]) -> Column:
    words, key = F.split("shingle", " "), F.lit(None).cast("long")
    for q in sizes:
        key = F.when(F.col("q") == q, _hash(words, F.lit(0), q)).otherwise(key)
    return key


def rarest_shingles(places: DataFrame, parts: DataFrame) -> DataFrame:
    """The prefix of each window: its shingle with the fewest occurrences, then the smallest id."""
    counts = places.where("pos >= 0").groupBy("shingle_id").agg(F.count("*").alias("_n"))
    rarity = F.struct(F.coalesce("_n", F.lit(0)), F.col("shingle_id"), F.col("offset"))
    least = parts.join(counts, "shingle_id", "left").groupBy("window_id", "k", "q").agg(F.min(rarity).alias("_p"))
    return least.select("window_id", "k", "q", F.col("_p.shingle_id").alias("shingle_id"), F.col("_p.offset").alias("offset"))


def window_hits(places: DataFrame, parts: DataFrame) -> DataFrame:
    """Verified occurrences: document, ``start``, ``k``, ``window_id``."""
    prefix = settle(rarest_shingles(places, parts), "prefixes")
    found = settle(places.where("pos >= 0").distinct(), "shingle-places")
    start = F.col("pos") - F.col("offset")
    placed = join_checked(found, prefix, ["shingle_id"], "inner").withColumn("start", start)
    bounded = placed.where((F.col("start") >= 0) & (F.col("start") + F.col("k") <= F.col("n_words")))
    # Shingles at 0, q, 2q, ... and at the end cover a window.
    covers = parts.where("offset = k - q OR offset % q = 0").select("window_id", "offset", "shingle_id")
    needed = settle(covers.groupBy("window_id").agg(F.collect_list(F.struct("offset", "shingle_id")).alias("_cover")), "covers")
    wanted = join_checked(bounded.select(*KEY, "start", "k", "window_id"), needed, ["window_id"], "inner").select(
        *KEY, "start", "k", "window_id", F.size("_cover").alias("_n"), F.explode("_cover").alias("_c")
    )
    wanted = wanted.withColumn("pos", F.col("start") + F.col("_c.offset")).withColumn("shingle_id", F.col("_c.shingle_id"))
    there = found.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("pos").alias("_pos"), F.col("shingle_id").alias("_id"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    on += [F.col("pos") == F.col("_pos"), F.col("shingle_id") == F.col("_id")]
    met = wanted.join(there, on).groupBy(*KEY, "start", "k", "window_id", "_n").agg(F.count("*").alias("_met"))
    return met.where("_met = _n").select(*KEY, "start", "k", "window_id")


def contamination(docs: DataFrame, items: DataFrame, spec: Windows = Windows()) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` words inside windows, ``n_items``, ``items_sha256``, ``contaminated``."""
    windows, owners = item_windows(items, spec)
    cut = window_shingles(windows, spec)
    shingles = settle(
        cut.groupBy("shingle").agg(F.first("q").alias("q")).select(F.monotonically_increasing_id().alias("shingle_id"), "shingle", "q"),
        "shingles",
    )
    parts = settle(cut.join(shingles.select("shingle", "shingle_id"), "shingle").drop("shingle"), "window-shingles")
    places = settle(occurrences(docs, shingles, spec), "shingle-occurrences")
    hits = settle(window_hits(places, parts), "window-hits")

    # Words covered: what each window adds beyond the furthest end before it.
    before = Window.partitionBy(*KEY).orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("start") + F.col("k")).over(before), F.lit(0))
    spans = hits.select(*KEY, "start", "k").distinct().withColumn("_from", F.greatest("start", reached))
    added = F.greatest(F.col("start") + F.col("k") - F.col("_from"), F.lit(0))
    covered = spans.groupBy(*KEY).agg(F.sum(added).cast("long").alias("n_hit"))

    named = join_checked(hits.select(*KEY, "window_id").distinct(), owners, ["window_id"], "inner")
    ids = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    listed = named.groupBy(*KEY).agg(ids.alias("items"))

    rows = places.where("pos = -1").groupBy(*KEY, "n_words").agg(F.count("*").cast("int").alias("_rows"))
    known = [F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}")) for k in KEY]
    joined = rows.alias("d").join(covered.alias("r"), known, "left").select("d.*", "n_hit").alias("d")
    joined = joined.join(listed.alias("r"), known, "left").select("d.*", "items")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows")))).select(
        *KEY,
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        items_of.alias("items"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, spec: Windows = Windows()) -> DataFrame:
    """Rows of documents without a window of the benchmark, all columns."""
    found = contamination(docs, items, spec).where("contaminated").select(*KEY).distinct()
    bad = settle(found, "contaminated")
    rows = packed_rows(docs, "doc_id", F.xxhash64("text").alias("text_hash"))
    return unpacked_rows(join_checked(rows, bad, KEY, "left_anti"), docs.columns)
