"""Mixing sources to target weights.

The words of a source form one stream, cut into blocks of fixed length. The mix is a row
of slots, cut into output shards of fixed size.

* **Counts per shard.** A source has as many slots as its target needs; all slots are
  dealt to the shards by one pseudorandom permutation. So a shard's source counts are a
  multinomial draw, given that all shards together meet the targets (drawing each shard on
  its own would miss them by the square root of their size).
* **Blocks of a shard.** A source's running sum over the shards' counts numbers its draws.
  Draw j of a source of n blocks takes block perm(j mod n), a keyed permutation, another
  one for each round of n: after a round every block was used once more, none twice before
  all others once.
* **Join by index.** Blocks used and the documents' pieces of blocks meet on (source,
  index); texts are moved once, when their pieces are cut out.

Rows that are alike in id, source and text are one row with a number until their pieces
are written out, so a third of all rows being the same is one row in every window.

Defined results: NULL texts have no words and are never taken; a NULL source is a
source of its own, last in order; repeated rows are documents of their own, and which of
them gets which of their places makes no difference; an empty table gives an empty
result; columns may have any name. Nothing depends on partitions or on a random state:
reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tsengine.functions.permutation import permuted
from tsengine.llm.common import SPACE, join_checked, settle
from tsengine.operators.chunks import explode_range

# Weights by order of source.
WEIGHTS = (1, 2, 3)
#: Copies of a row that are written out where the row is; more are spread over tasks.
COPIES = 4096


@dataclass(frozen=True)
class Plan:
    """``block``: words; ``most``: times a source may be used; ``shard``: slots of an output shard; ``rows``: documents per ordered group."""

    block: int = 64
    most: int = 3
    shard: int = 65_536
    rows: int = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^"))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """A row per source: ``source_no``, ``source_size``, ``target``, ``n_blocks``, ``n_draws``.

    The words of all sources are shared by weight; none gets more than ``most`` times
    its size, and what that leaves is shared again. Filling by one level for all does
    that in one go: in order of size / weight, the level is the largest
    (words left) / (weight left).
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = totals.select(
        "source",
        "source_size",
        F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())).cast("long").alias("source_no"),
    )
    pick = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("source_no") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighted = ranked.withColumn("weight", pick.cast("double")).withColumn("most", plan.most * F.col("source_size"))
    by_ratio = everything.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    levels = weighted.withColumn("level", left / F.sum("weight").over(after))
    level = F.max("level").over(everything)
    target = F.least(F.col("most").cast("double"), F.col("weight") * level)
    blocks = F.expr(f"(source_size + {plan.block - 1}) div {plan.block}")
    filled = levels.select("source", "source_no", "source_size", target.alias("target"), blocks.alias("n_blocks"))
    draws = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")))
    draws = F.least(F.coalesce(draws, F.lit(0)).cast("long"), plan.most * F.col("n_blocks"))
    return filled.withColumn("n_draws", draws)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and ``mark``, a digest of id, size and text; settled."""
    size = word_count(F.col("text"))
    named = docs.select("doc_id", "source", size.alias("size"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    mark = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string"), "text_md5").cast("binary"))
    return settle(named.select("doc_id", "source", "size", mark.alias("mark")), "mix-sizes")


def place(sizes: DataFrame, sources: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """A row per distinct document: ``n`` times it is there, and ``start``, the words before its first copy in the source's stream.

    A source is dealt into groups by the mark; running sums are taken inside groups and
    over the groups' totals.
    """
    groups = max(1, -(-sizes.count() // plan.rows))
    alike = sizes.groupBy("source", "mark", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    number = F.pmod(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long"), F.lit(groups))
    grouped = join_checked(alike, sources, ["source"], "inner").withColumn("grp", number)
    totals = grouped.groupBy("source_no", "grp").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    over = Window.partitionBy("source_no").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source_no", "grp", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_no", "grp").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size") * F.col("n")
    running = grouped.withColumn("before", F.sum(words).over(inside) - words)
    placed = running.join(offsets, ["source_no", "grp"])
    return placed.withColumn("start", F.col("offset") + F.col("before")).drop("grp", "offset", "before")


def copies(placed: DataFrame) -> DataFrame:
    """A row per document: the start of each copy of a row. Many copies are spread."""
    few = placed.where(F.col("n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = explode_range(placed.where(F.col("n") > COPIES), F.lit(0).cast("long"), F.col("n") - 1, "copy", spread=["source_no", "start"])
    rows = few.unionByName(many)
    return rows.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copy", "n")


def shard_counts(sources: DataFrame, plan: Plan = Plan(), seed: int = 17) -> DataFrame:
    """``shard``, ``source_no``, ``n_blocks``, ``n`` draws and ``before``, the source's draws in earlier shards.

    The permutation of all slots decides which shard a slot is in; every shard but the last has ``plan.shard``.
    """
    everything = Window.partitionBy()
    earlier = everything.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    offset, total = F.coalesce(F.sum("n_draws").over(earlier), F.lit(0)), F.sum("n_draws").over(everything)
    rows = sources.select("source_no", "n_blocks", "n_draws", offset.alias("offset"), total.alias("total")).where("n_draws > 0")
    slots = explode_range(rows, F.lit(0).cast("long"), F.col("n_draws") - 1, "number", spread=["source_no"])
    slot = permuted(F.col("offset") + F.col("number"), F.col("total"), F.lit(f"{seed}/slots"))
    shard = F.floor(slot / plan.shard).cast("long").alias("shard")
    counts = slots.groupBy("source_no", "n_blocks", shard).agg(F.count(F.lit(1)).alias("n"))
    past = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0)))


def draw(counts: DataFrame, seed: int = 17) -> DataFrame:
    """A row per draw of the shards' counts: ``shard``, ``source_no``, ``draw_no``, ``index`` of the block."""
    last = F.col("before") + F.col("n") - 1
    draws = explode_range(counts, F.col("before"), last, "draw_no", spread=["source_no", "shard"])
    key = F.concat_ws("/", F.lit(str(seed)), F.col("source_no").cast("string"), F.expr("draw_no div n_blocks").cast("string"))
    index = permuted(F.col("draw_no") % F.col("n_blocks"), F.col("n_blocks"), key)
    return draws.select("shard", "source_no", "draw_no", index.alias("index"))


def blocks(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """A row per document and block it has words in: ``first`` and ``words`` are the piece inside the document."""
    end = F.col("start") + F.col("size")
    touched = F.expr(f"sequence(start div {plan.block}, (start + size - 1) div {plan.block})")
    spans = documents.where("size > 0").withColumn("index", F.explode(touched))
    low = F.greatest(F.col("start"), F.col("index") * plan.block)
    high = F.least(end, (F.col("index") + 1) * plan.block)
    return spans.select("source_no", "index", "start", (low - F.col("start")).alias("first"), (high - low).alias("words"))


def mix(sizes: DataFrame, plan: Plan = Plan(), seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Distinct documents with their places, and the mix: a row per piece of a document and block, ``times`` it is used.

    A document with words is known by (``source_no``, ``start``).
    """
    sources = settle(targets(sizes, plan), "mix-sources")
    placed = settle(place(sizes, sources, plan), "mix-places")
    counts = settle(shard_counts(sources, plan, seed), "mix-shards")
    times = draw(counts, seed).groupBy("source_no", "index").agg(F.count(F.lit(1)).cast("int").alias("times"))
    # The hint: draws look small to a planner that can't see how many a shard's row becomes.
    return placed, blocks(copies(placed), plan).join(times.hint("merge"), ["source_no", "index"])


def taken(docs: DataFrame, plan: Plan = Plan(), seed: int = 17) -> DataFrame:
    """Rows of ``docs`` with the words the mix takes of each."""
    placed, mixed = mix(sized(docs), plan, seed)
    sums = mixed.groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    whole = copies(placed.where("size > 0")).join(sums, ["source_no", "start"], "left")
    none = copies(placed.where("size = 0")).withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return whole.select(*columns).unionByName(none.select(*columns))


def _cut(text: str, size: str) -> tuple[Column, Column]:
    """The words of a text, and a copy's text: the words of its pieces, a line feed where others are left out."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = (
        "ltrim(array_join(transform(chosen, (p, i) -> concat(if(i > 0 AND chosen[i - 1].first + chosen[i - 1].words <> p.first,"
        " '\\n', ''), array_join(slice(all_words, p.first + 1, p.words), ''))), ''))"
    )
    return words, F.when(F.expr(f"aggregate(chosen, 0, (a, p) -> a + p.words) = {size}"), F.col(text)).otherwise(F.expr(part))


def mixed_documents(docs: DataFrame, plan: Plan = Plan(), seed: int = 17) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document comes as often as its most used block; a copy holds the words of the
    blocks used that often, a line feed where others are left out. ``n_chars`` is
    counted anew. Texts go through one shuffle, rows that are there once by their mark;
    rows alike in id, source and text are made one before.
    """
    columns = docs.columns
    sizes = sized(docs)
    placed, mixed = mix(sizes, plan, seed)
    piece = F.struct(F.col("first").cast("int").alias("first"), F.col("words").cast("int").alias("words"), "times")
    pieces_of = mixed.groupBy("source_no", "start").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    named = copies(placed.where("size > 0")).select("source_no", "start", "source", "mark", "size")
    uses = named.join(pieces_of, ["source_no", "start"]).select(row_key().alias("key"), "size", "pieces")
    repeated = settle(placed.where("n > 1 AND size > 0").select(row_key().alias("key")), "mix-repeated")
    # The user's columns travel as one, so that no name can clash.
    size = word_count(F.col("text"))
    mark = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), size.cast("string"), F.md5(F.col("text").cast("binary"))).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "source", "text", mark.alias("mark"))
    rows = rows.where(size > 0).select("row", "text", row_key().alias("key"))
    single = join_checked(rows, repeated, ["key"], "left_anti")
    alike = join_checked(rows, repeated, ["key"], "left_semi").groupBy("key").agg(F.max(F.struct("row", "text")).alias("one"))
    once = single.unionByName(alike.select(F.col("one.row").alias("row"), F.col("one.text").alias("text"), "key"))
    met = once.join(uses.hint("shuffle_hash"), "key")
    copied = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.array_max(F.expr("transform(pieces, p -> p.times)")))))
    words, text = _cut("text", "size")
    chosen = copied.withColumn("chosen", F.expr("filter(pieces, p -> p.times >= copy)")).withColumn("all_words", words)
    made = chosen.select("row", text.alias("mixed"))
    replaced = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return made.select(*[replaced[c].alias(c) if c in replaced else F.col("row")[c].alias(c) for c in columns])


def row_key() -> Column:
    """One key for source and mark; a NULL source differs from all others."""
    return F.concat(F.col("mark"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
