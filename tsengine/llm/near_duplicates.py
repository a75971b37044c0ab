"""Near duplicates: MinHash banding, verification, connected components.

1. Every document gets the minima of ``bands * rows`` universal hashes of its shingle
   set. Documents with equal sets are one class from here on; a class of any size
   costs one row.
2. Classes that agree in all rows of a band share a bucket.
3. In each bucket a centre, the member with the most company, is compared with the
   others: first by signature, then on the full shingle sets. Links are merged by
   alternating large-star and small-star. Buckets whose members are all connected
   are done.
4. The others, say of documents that share a passage and no more, are not taken apart: a
   row of theirs carries a sketch (two bits of each minimum) and its whole shingle set,
   and the task that has the bucket compares sketches of members of different components
   and sizes that allow a link, then the sets of the pairs that pass, each member's best
   pairs first. A link merges two components at once, and only such links leave the task:
   fewer than the bucket has members, however many pairs it has. Buckets of more than
   ``block`` members or ``SHINGLES`` shingles go to several tasks, a pair of blocks each.
   So no bucket is capped, a group of copies is never expanded into its pairs, and rows
   multiply only in buckets beyond those sizes.

A pair at the threshold misses all bands with probability (1 - 0.8^6)^48 = 5e-7; a link
passes the signature test and the sketch test with an error of five standard deviations.

Defined results: NULL and empty texts, and texts of white space only, are linked
with nothing and keep their own id; rows with the same id and text are one
document; a NULL id never names a component, and such a row is kept only where
nothing in its component has an id; an empty table gives an empty result; columns
beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tsengine.llm.common import BROADCAST_ROWS, join_checked, packed_rows, settle, small_batches, unpacked_rows
from tsengine.llm.shingles import WordHashes, mix, shingle_set

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, signature binary, sketch binary"


@dataclass(frozen=True)
class Spec:
    """``percent``: of the union that links share; ``screen``: estimate below which a pair isn't looked at again; ``block``: members that one task compares."""

    shingle: int = 4
    percent: int = 80
    bands: int = 48
    rows: int = 6
    screen: float = 0.68
    seed: int = 1
    block: int = 8192

    @property
    def differing(self) -> int:
        """Places of a sketch in which the two texts of a link may differ: five deviations above the mean."""
        share, size = (1 - self.percent / 100) * 0.75, self.bands * self.rows
        return int(np.ceil(size * share + 5 * np.sqrt(size * share * (1 - share))))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers (odd) and offsets of the universal hashes x -> a x + b mod 2^32."""
        draw = np.random.default_rng(self.seed)
        size = self.bands * self.rows
        a = draw.integers(0, 2**32, size, dtype=np.uint32) | np.uint32(1)
        return a[:, None], draw.integers(0, 2**32, size, dtype=np.uint32)[:, None]


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1024) -> np.ndarray:
    """Minimum of every hash over a set."""
    x = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(x), step):
        least = np.minimum(least, (a * x[at : at + step] + b).min(axis=1))
    return least


def sketch(least: np.ndarray) -> bytes:
    """The two lowest bits of every minimum, in whole words of 64 bits."""
    bits = np.zeros(-(-len(least) // 32) * 32, np.uint8)
    bits[: len(least)] = least & np.uint32(3)
    quarter = bits.reshape(-1, 4)
    return (quarter[:, 0] | quarter[:, 1] << 2 | quarter[:, 2] << 4 | quarter[:, 3] << 6).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """A row per document: size and key of its set, band keys, signature of 8 bits a hash."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = spec.hashes()
        known, numbers = WordHashes(), np.arange(spec.bands, dtype=np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            rows = []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                values = shingle_set(text, spec.shingle, known)
                if not len(values):
                    rows.append((doc_id, text_hash, 0, None, None, None, None))
                    continue
                least = minima(values, a, b)
                keys = numbers
                for column in least.reshape(spec.bands, spec.rows).T.astype(np.uint64):
                    keys = mix(keys, column)
                set_key = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                rows.append((doc_id, text_hash, len(values), set_key, keys.view(np.int64), least.astype(np.uint8).tobytes(), sketch(least)))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
            yield frame.astype({"doc_id": "Int64", "text_hash": "Int64"})

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInPandas(sign, NODES)


def classes_of(signed: DataFrame) -> DataFrame:
    """A row per distinct set: a node number, the document that stands for it, bands and signature."""
    document = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")
    sets = signed.where("set_key IS NOT NULL").groupBy("set_key")
    found = sets.agg(F.min(document).alias("d"), *[F.min(c).alias(c) for c in ("n_shingles", "signature", "sketch", "bands")])
    return found.select(
        F.monotonically_increasing_id().alias("node"), "set_key", "d.doc_id", "d.text_hash", "n_shingles", "signature", "sketch", "bands"
    )


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows of buckets of two nodes or more, with the size ``m`` of the bucket and its shingles ``volume``."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("volume"))
    return rows.join(sizes.where("m > 1"), "key")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """A row per node and bucket of two nodes or more: ``key``, ``node``, ``n_shingles``, ``m``, ``volume``; settled."""
    return settle(shared_buckets(nodes.select("node", "n_shingles", F.explode("bands").alias("key"))), "bucket-members")


def centre_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's centre and another member whose sizes allow a link.

    The centre is the member whose buckets are the largest in all: the original of many
    edited copies is that of each of its buckets.
    """
    weights = members.groupBy("node").agg(F.sum("m").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("node")).alias("node"), "n_shingles")).alias("c")
    heaviest = members.select("key", "node", "n_shingles").join(weights, "node").groupBy("key").agg(best)
    centres = heaviest.select("key", (-F.col("c.node")).alias("centre"), F.col("c.n_shingles").alias("n_centre"))
    small, large = F.least("n_shingles", "n_centre"), F.greatest("n_shingles", "n_centre")
    pairs = members.join(centres, "key").where((F.col("node") != F.col("centre")) & (100 * small >= percent * large))
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


#: Pairs that are looked at first for a member and another component; each round goes that many times as far.
GROWTH = 8
#: Shingles of the members that one task compares.
SHINGLES = 1 << 22
#: Pairs of sketches that are compared at once.
AT_ONCE = 1 << 17
ODD_BITS = np.uint64(0x5555555555555555)


def in_blocks(rows: DataFrame, block: int, shingles: int = SHINGLES) -> DataFrame:
    """Buckets of more than ``block`` members or ``shingles`` shingles as pairs of blocks, which have keys of their own.

    ``side`` tells the two blocks of a pair apart; it is NULL where all members meet all.
    """
    columns = [F.col("key").alias("origin"), "node", "n_shingles", "comp"]
    fits = (F.col("m") <= block) & (F.col("volume") <= shingles)
    small = rows.where(fits).select("key", F.lit(None).cast("boolean").alias("side"), *columns)
    parts = F.ceil(2 * F.greatest(F.col("m") / block, F.col("volume") / shingles)).cast("int")
    large = rows.where(~fits).withColumn("_own", F.pmod(F.xxhash64("node"), parts).cast("int"))
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") != F.col("_other"), F.col("_own") > F.col("_other"))
    return small.unionByName(large.select(F.xxhash64("key", low, high).alias("key"), side.alias("side"), *columns))


def similar_parts(n: np.ndarray, comp: np.ndarray, words: np.ndarray, side: np.ndarray, percent: int, differing: int):
    """Pairs of a bucket that may be links, a part at a time: two places and the number of differing minima.

    ``n`` ascends. ``side`` is -1 where all members meet all. Each part heeds what ``comp`` is by then.
    """
    start = 0
    while start < len(n):
        ends = np.searchsorted(n, n[start : start + AT_ONCE] * 100 // percent, "right")
        width = int(ends[0]) - start
        stop = min(len(n), start + max(1, AT_ONCE // max(1, width)))
        end = int(ends[stop - start - 1])
        x = words[start:stop, None, :] ^ words[None, start:end, :]
        apart = np.bitwise_count((x | x >> np.uint64(1)) & ODD_BITS).sum(axis=2, dtype=np.int32)
        near = (apart <= differing) & (comp[start:stop, None] != comp[None, start:end])
        near &= (side[start:stop, None] < 0) | (side[start:stop, None] != side[None, start:end])
        i, j = np.nonzero(near)
        later = (j > i) & (n[i + start] * 100 >= percent * n[j + start])
        i, j = i[later], j[later]
        yield i + start, j + start, apart[i, j]
        start = stop


def similar(n: np.ndarray, comp: np.ndarray, words: np.ndarray, side: np.ndarray, percent: int, differing: int):
    """The parts of ``similar_parts`` as one."""
    return tuple(np.concatenate(v) for v in zip(*similar_parts(n, comp, words, side, percent, differing)))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal values."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([np.diff(c) != 0 for c in columns], axis=0)
    starts = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(starts, np.diff(np.append(starts, len(new))))


def ranked(i: np.ndarray, j: np.ndarray, apart: np.ndarray, comp: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each pair the worse of its two ranks among a member's pairs into the other's component."""
    asker, other, score = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([apart, apart])
    order = np.lexsort((node[other], score, comp[other], asker))
    rank = np.empty(len(order), np.int64)
    rank[order] = _runs(asker[order], comp[other[order]])
    return np.maximum(rank[: len(i)], rank[len(i) :])


def own_pairs(i: np.ndarray, j: np.ndarray, bands: np.ndarray, band: int) -> np.ndarray:
    """Which pairs agree in no band before ``band``."""
    earlier = [(bands[i[at : at + AT_ONCE], :band] == bands[j[at : at + AT_ONCE], :band]).any(axis=1) for at in range(0, len(i), AT_ONCE)]
    return ~np.concatenate(earlier) if earlier else np.ones(0, bool)


def sharing(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of places have sets that share ``percent`` of their union."""
    linked = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.diff(i[order], prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:]):
        own = sets[i[order[a]]]
        at = a
        while at < b:
            others, held = [], 0
            while at + len(others) < b and held < AT_ONCE:
                others.append(sets[j[order[at + len(others)]]])
                held += len(others[-1])
            sizes, values = np.array([len(x) for x in others]), np.concatenate(others)
            met = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            common = np.add.reduceat(met.astype(np.int64), np.cumsum(sizes) - sizes)
            linked[order[at : at + len(others)]] = 100 * common >= percent * (len(own) + sizes - common)
            at += len(others)
    return linked


def merging_links(group: pd.DataFrame, spec: Spec) -> list[tuple[int, int]]:
    """Links that merge all components of a bucket that its links connect, each a merger of two.

    ``group``: origin, side, node, n_shingles, comp, sketch, bands, shingles.
    """
    group = group.sort_values("n_shingles", kind="stable")
    node, n, comp = (group[c].to_numpy(np.int64) for c in ("node", "n_shingles", "comp"))
    comp = comp.copy()
    words = np.frombuffer(b"".join(group["sketch"]), "<u8").reshape(len(group), -1)
    side = group["side"].astype("float").fillna(-1).to_numpy(np.int64)
    bands = np.stack(group["bands"].to_numpy())
    band = int(np.argmax(bands[0] == group["origin"].iloc[0]))
    sets = [np.frombuffer(x, "<u8") for x in group["shingles"]]
    links = []
    for i, j, apart in similar_parts(n, comp, words, side, spec.percent, spec.differing):
        own = own_pairs(i, j, bands, band)
        i, j, apart, high = i[own], j[own], apart[own], GROWTH
        while len(i):
            now = ranked(i, j, apart, comp, node) < high
            found = sharing(i[now], j[now], sets, spec.percent)
            for x, y in zip(i[now][found], j[now][found]):
                if comp[x] != comp[y]:
                    comp[comp == comp[y]] = comp[x]
                    links.append((int(node[x]), int(node[y])))
            left = ~now & (comp[i] != comp[j])
            i, j, apart, high = i[left], j[left], apart[left], high * GROWTH
    return links


def bucket_links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, spec: Spec) -> DataFrame:
    """Links ``a``, ``b`` between the components of buckets, fewer than a bucket (or pair of blocks) has members.

    ``rows``: key, node, n_shingles, comp, m, volume; ``sets``: node, shingles.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for batch in batches:
            for key, rows in batch.groupby("key", sort=False):
                if key != last and held:
                    yield links_of(held)
                    held = []
                held.append(rows)
                last = key
        if held:
            yield links_of(held)

    def links_of(held: list[pd.DataFrame]) -> pd.DataFrame:
        group = pd.concat(held, ignore_index=True)
        return pd.DataFrame(merging_links(group, spec) if len(group) > 1 else [], columns=["a", "b"], dtype="int64")

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = in_blocks(rows, spec.block).join(nodes.select("node", "sketch", "bands").join(sets, "node"), "node")
    return whole.repartition(tasks, "key").sortWithinPartitions("key").mapInPandas(compare, "a long, b long")


def _attach(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The values of ``column`` for both ends of pairs."""
    for end in ("b", "a"):
        side = table.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}"))
        pairs = pairs.join(side, end)
    return pairs


def screen(pairs: DataFrame, nodes: DataFrame, spec: Spec) -> DataFrame:
    """Pairs whose signatures agree in enough places."""

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                left, right = (
                    np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("signature_a", "signature_b")
                )
                batch = batch[(left == right).mean(axis=1) >= spec.screen]
            yield batch[["a", "b"]]

    return _attach(pairs, nodes, "signature").select("a", "b", "signature_a", "signature_b").mapInPandas(agree, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, spec: Spec) -> DataFrame:
    """Pairs whose full shingle sets share ``percent`` of their union."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, last, own = WordHashes(), None, None
        for batch in batches:
            linked = []
            for a, text_a, text_b in zip(batch["a"], batch["text_a"], batch["text_b"]):
                if a != last:  # rows of one centre come together
                    last, own = a, shingle_set(text_a, spec.shingle, known)
                other = shingle_set(text_b, spec.shingle, known)
                common = len(np.intersect1d(own, other, assume_unique=True))
                linked.append(100 * common >= spec.percent * (len(own) + len(other) - common))
            yield batch.loc[linked, ["a", "b"]]

    return _attach(pairs, texts, "text").select("a", "b", "text_a", "text_b").mapInPandas(compare, "a long, b long")


def sets_of(texts: DataFrame, spec: Spec) -> DataFrame:
    """The shingle sets of texts: ``node``, ``shingles``."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(t, spec.shingle, known).tobytes() for t in batch["text"]]})

    return texts.mapInPandas(build, "node long, shingles binary")


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood. ``edges``: ``u`` > ``v``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """``u`` to ``v``, the smallest node of its component, for all nodes of links that are not themselves the smallest."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    while mark[0]:
        edges = settle(small_star(large_star(edges)), "stars")
        before, mark = mark, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if before == mark:
            break
    return edges


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the documents that stand for nodes: ``node``, ``text``."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = wanted.select("node", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"))
    if wanted.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    joined = texts.join(rows, (F.col("text_hash") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    # Repeated rows of a document would give its node twice.
    return joined.groupBy("node").agg(F.min("text").alias("text"))


def link_components(docs: DataFrame, nodes: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """``node`` to ``comp``, the smallest node of its component, for the nodes that have links."""
    members = bucket_members(nodes)
    wanted = settle(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash"), "wanted")
    texts = settle(texts_of(docs, wanted), "texts")
    labels = nodes.select("node", F.col("node").alias("comp")).limit(0)

    def merged(links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return labels
        # Links between components, and what the components were made of.
        every = links.unionByName(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        return connected(every).select(F.col("u").alias("node"), F.col("v").alias("comp"))

    tried = settle(centre_pairs(members, spec.percent), "pairs")
    labels = merged(settle(confirm(settle(screen(tried, nodes, spec), "screened"), texts, spec), "links"))

    # Buckets that hold two components, with the component of each member.
    named = members.where("m > 2").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = named.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high").select("key")
    rows = settle(named.join(open_, "key", "left_semi"), "open-buckets")
    if rows.isEmpty():
        return labels
    sets = settle(sets_of(texts.join(rows.select("node").distinct(), "node", "left_semi"), spec), "sets")
    return merged(settle(bucket_links(rows, nodes, sets, spec), "links"))


def near_duplicates(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Per document: ``n_shingles``, ``component_id`` (smallest id reachable by links), ``kept``.

    ``first`` marks rows of the document that stands for its component.
    """
    small_batches(docs.sparkSession)
    signed = settle(signatures(docs, spec), "signatures")
    nodes = settle(classes_of(signed), "classes")
    labels = link_components(docs, nodes, spec)
    placed = nodes.select("node", "set_key", "doc_id", "text_hash").join(labels, "node", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "node"))
    document = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")
    heads = placed.groupBy("comp").agg(F.min(document).alias("h"))
    named = placed.join(heads, "comp").select("set_key", F.col("h.doc_id").alias("component_id"), F.col("h.text_hash").alias("_head"))
    rows = signed.select("doc_id", "text_hash", "n_shingles", "set_key")
    linked = rows.where("set_key IS NOT NULL").join(named, "set_key").drop("set_key")
    alone = rows.where("set_key IS NULL").drop("set_key")
    alone = alone.withColumn("component_id", F.col("doc_id")).withColumn("_head", F.col("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return linked.unionByName(alone).select(
        "doc_id",
        "text_hash",
        "n_shingles",
        "component_id",
        same.alias("kept"),
        (same & F.col("text_hash").eqNullSafe(F.col("_head"))).alias("first"),
    )


def keep_first(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """One row for each component of near duplicates, all columns."""
    key = ["doc_id", "text_hash"]
    found = near_duplicates(docs, spec).select(*key, "first")
    found = settle(found.groupBy(*key).agg(F.max("first").alias("first"), F.count("*").alias("n")), "dup-decisions")
    gone = settle(found.where("NOT first").select(*key), "dup-gone")
    again = settle(found.where("first AND n > 1").select(*key), "dup-again")
    rows = packed_rows(docs, "doc_id", F.xxhash64("text").alias("text_hash"))
    left = join_checked(rows, gone, key, "left_anti")
    single = join_checked(left, again, key, "left_anti")
    repeated = join_checked(left, again, key, "left_semi").dropDuplicates(key)
    return unpacked_rows(single.unionByName(repeated), docs.columns)
