"""Merkle manifest of a dataset, kept as a postorder append log.

A row is a leaf. Leaves of a source make a tree of three children a node, and the roots
of all sources make one more tree; the manifest's root stands for the whole dataset.

* **Numbering.** Rows are sorted by range and written; a row's number is its place in its
  file and the rows of earlier files, so that no source is one task.
* **Builders are aligned.** One takes 3^8 neighbouring leaves, appends a node to its part
  of the log whenever the node's last child is there, and hands its last node to the next
  round, where a builder again takes 3^8 of them. Ten billion rows are three rounds.
* **Positions are closed form.** Before a node come the nodes that its own leaves and all
  earlier ones have completed: a sum over levels of rounded quotients. A proof is read by
  computing where the siblings are, inside the builder's part of the log for the lower
  levels; what lies above a builder is the same for all its leaves and is handed down once.

Defined results: a NULL source is a tree of its own, before all others; NULL ids come
first in their source; rows of one source and id are ordered by leaf, and equal rows are
leaves of their own; a NULL text, source, language, id or length is written ``-`` and an
empty one ``0:``; rows with NULL ids are not tampered with; an empty table has no rows,
no log and no root. Other columns are not part of a leaf and may have any name.
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tsengine.llm.common import fold, join_checked, settle

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


@dataclass(frozen=True)
class Spec:
    """Children of a node, and levels that one builder completes."""

    arity: int = 3
    levels: int = 8

    @property
    def width(self) -> int:
        return self.arity**self.levels


# --- the tree's arithmetic -----------------------------------------------------------


def height(n: int, arity: int = 3) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def positions(level: int, index, n: int, top: int, arity: int = 3):
    """Places in the postorder log of the nodes ``index`` of a level; ``top`` is the root's level.

    A node completes after all nodes of its level and below that begin before its last
    leaf's end, and after those nodes above its level that end before its first leaf.
    """
    start = index * arity**level
    end = np.minimum(start + arity**level, n)
    place = sum(-(-end // arity**j) for j in range(level + 1))
    return place + sum(start // arity**j for j in range(level + 1, top + 1)) - 1


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in children).encode()).digest()


def append_all(digests: list[bytes], top: int, arity: int = 3) -> list[bytes]:
    """The log of one builder: leaves as they come, nodes as they complete, up to level ``top``."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(top + 1)]

    def add(digest: bytes, level: int) -> None:
        log.append(digest)
        waiting[level].append(digest)

    for digest in digests:
        add(digest, 0)
        level = 0
        while level < top and len(waiting[level]) == arity:
            made, waiting[level] = parent(waiting[level]), []
            level += 1
            add(made, level)
    for level in range(top):
        if waiting[level]:
            add(parent(waiting[level]), level + 1)
    return log


def siblings(log: bytes, n: int, top: int, arity: int = 3) -> list[list[bytes]]:
    """For every leaf of a builder's log: its proof up to level ``top``, a step a level.

    A step is the number of siblings to the left and to the right, a byte each, and
    their digests.
    """
    digest = [log[i : i + DIGEST] for i in range(0, len(log), DIGEST)]
    steps: list[list[bytes]] = []
    for level in range(top):
        count = -(-n // arity**level)
        nodes = [digest[p] for p in positions(level, np.arange(count, dtype=np.int64), n, top, arity)]
        made = []
        for i in range(count):
            first = i - i % arity
            left, right = nodes[first:i], nodes[i + 1 : first + arity]
            made.append(bytes((len(left), len(right))) + b"".join(left + right))
        steps.append(made)
    return [[steps[level][i // arity**level] for level in range(top)] for i in range(n)]


def unfold(path: bytes):
    """Steps of a proof: siblings to the left and to the right."""
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        at += 2
        found = [path[at + DIGEST * i : at + DIGEST * (i + 1)] for i in range(left + right)]
        at += DIGEST * (left + right)
        yield found[:left], found[left:]


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for left, right in unfold(path):
        leaf = parent([*left, leaf, *right])
    return leaf


def proof_digest(path: bytes) -> str:
    return hashlib.sha256("".join(d.hex() for left, right in unfold(path) for d in left + right).encode()).hexdigest()


# --- leaves --------------------------------------------------------------------------


def leaf(*values: Column) -> Column:
    """Digest of a row's fields, as hex text."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tree_of(source: Column) -> Column:
    """Name of a source's tree: sorts like the source, NULL first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and ``tampered``: the leaf of the text without line feeds, for half of the ids."""
    field = {c: F.col(c) for c in FIELDS}
    cut = {**field, "text": F.translate(field["text"], "\n", "")}
    original = leaf(*field.values())
    chosen = F.coalesce(fold(F.col("doc_id"), 2) == 0, F.lit(False))
    tampered = F.when(chosen & F.col("text").contains("\n"), leaf(*cut.values())).otherwise(original)
    return docs.select(tree_of(F.col("source")).alias("tree"), "doc_id", F.unhex(original).alias("leaf"), F.unhex(tampered).alias("tampered"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``idx``, the row's number in its ``tree`` by ``order``, and ``n``, the rows of the tree.

    Rows are written sorted; the number is the place in the file plus what earlier files
    hold of the tree. Equal rows are spread over partitions too.
    """
    keys = ["tree", *order, "_tie"]
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    files = settle(ordered.drop("_tie"), name)
    placed = files.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # How Spark names the files of a write, by partition and piece.
    part = [F.regexp_extract("_file", r"^part-(\d+)", 1).cast("long"), F.regexp_extract("_file", r"-c(\d+)\.", 1).cast("long")]
    runs = placed.groupBy("tree", "_file").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    by_file = Window.partitionBy("tree").orderBy(*part)
    runs = runs.select(
        "tree", "_file", "_first", F.sum("_rows").over(Window.partitionBy("tree")).alias("n"),
        (F.sum("_rows").over(by_file) - F.col("_rows")).alias("_before"),
    )
    runs = settle(runs, f"{name}-runs")
    joined = join_checked(placed, runs, ["tree", "_file"], "inner")
    return joined.withColumn("idx", F.col("_before") + F.col("_row") - F.col("_first")).drop("_file", "_row", "_first", "_before")


# --- builders ------------------------------------------------------------------------

SEGMENT = "tree string, round int, block long, n long, width long, log binary, last binary"


def _builder(spec: Spec, number: int):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        n = int(rows["n"].iloc[0])
        top = spec.levels if n > spec.width else height(n, spec.arity)
        log = append_all(list(rows["digest"]), top, spec.arity)
        return pd.DataFrame([(key[0], number, key[1], n, spec.width, b"".join(log), log[-1])], columns=["tree", "round", "block", "n", "width", "log", "last"])

    return build


def build(nodes: DataFrame, spec: Spec, name: str) -> list[DataFrame]:
    """Segments of the logs of all trees, a table a round, from ``tree, idx, n, digest``."""
    rounds: list[DataFrame] = []
    while True:
        block = F.floor(F.col("idx") / spec.width).cast("long").alias("block")
        grouped = nodes.select("tree", "idx", "n", "digest", block).groupBy("tree", "block")
        made = settle(grouped.applyInPandas(_builder(spec, len(rounds)), SEGMENT), f"{name}-{len(rounds)}")
        rounds.append(made)
        open_ = made.where(F.col("n") > spec.width)
        if open_.isEmpty():
            return rounds
        more = F.ceil(F.col("n") / spec.width).cast("long").alias("n")
        nodes = open_.select("tree", F.col("block").alias("idx"), more, F.col("last").alias("digest"))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """tree, round, digest: the last node of each tree."""
    ends = [r.where(F.col("n") <= F.col("width")).select("tree", "round", F.col("last").alias("digest")) for r in rounds]
    made = ends[0]
    for more in ends[1:]:
        made = made.unionAll(more)
    return made


def log_entries(rounds: list[DataFrame], spec: Spec) -> DataFrame:
    """The logs node by node: tree, position, level, idx, digest; a tree's positions are 0, 1, 2, ...

    Each builder's nodes lie where the closed form puts them in the whole tree.
    """

    def entries(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                base, done = int(row.round) * spec.levels, int(row.block) * spec.width
                here = min(spec.width, int(row.n) - done)
                top = spec.levels if row.n > spec.width else height(int(row.n), spec.arity)
                # Leaves of the whole tree: only their number at this round's level matters above it.
                total, whole = int(row.total), height(int(row.total), spec.arity)
                for level in range(0 if base == 0 else 1, top + 1):
                    index = np.arange(-(-here // spec.arity**level), dtype=np.int64)
                    near = positions(level, index, here, top, spec.arity)
                    index = index + done // spec.arity**level
                    far = positions(base + level, index, total, whole, spec.arity)
                    yield pd.DataFrame({
                        "tree": row.tree, "position": far, "level": base + level, "idx": index,
                        "digest": [row.log[DIGEST * p : DIGEST * (p + 1)] for p in near],
                    })

    sizes = rounds[0].where(F.col("block") == 0).select("tree", F.col("n").alias("total"))
    made = None
    for segments in rounds:
        part = join_checked(segments, sizes, ["tree"], "inner").mapInPandas(entries, "tree string, position long, level int, idx long, digest binary")
        made = part if made is None else made.unionAll(part)
    return made


# --- proofs --------------------------------------------------------------------------


def _handed_down(spec: Spec):
    def paths(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                done = int(row.block) * spec.width
                here = min(spec.width, int(row.n) - done)
                top = spec.levels if row.n > spec.width else height(int(row.n), spec.arity)
                own = siblings(row.log, here, top, spec.arity)
                yield pd.DataFrame({
                    "tree": row.tree, "block": np.arange(done, done + here, dtype=np.int64),
                    "path": [b"".join(steps) + row.path for steps in own], "subroot": row.subroot,
                })

    return paths


PATH = "tree string, block long, path binary, subroot binary"


def paths_above(rounds: list[DataFrame], ends: DataFrame, spec: Spec, name: str) -> DataFrame:
    """For every builder of the first round: ``path`` from its last node to the top.

    ``ends`` has tree, round, path and subroot: what follows the root of a tree.
    """
    paths = None
    for number in reversed(range(len(rounds))):
        here = ends.where(F.col("round") == number).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
        paths = here if paths is None else paths.unionAll(here)
        if number:
            joined = rounds[number].join(paths, ["tree", "block"])
            paths = settle(joined.mapInPandas(_handed_down(spec), PATH), f"{name}-{number}")
    return paths


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(spec: Spec, root: bytes):
    names = [c.split()[0] for c in RESULT.split(", ")]

    def prove(rows: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        here, n = len(rows), int(rows["n"].iloc[0])
        top = spec.levels if n > spec.width else height(n, spec.arity)
        log, above, subroot = segment["log"].iloc[0], segment["path"].iloc[0], segment["subroot"].iloc[0]
        found = []
        for steps, now in zip(siblings(log, here, top, spec.arity), rows["tampered"]):
            path = b"".join(steps) + above
            found.append((proof_digest(path), folded(now, path)))
        made = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "leaf": [d.hex() for d in rows["leaf"]]})
        made["subroot"], made["root"] = subroot.hex(), root.hex()
        made["proof_sha256"] = [p for p, _ in found]
        made["folded_root"] = [d.hex() for _, d in found]
        made["verified"] = [d == root for _, d in found]
        return made[names]

    return prove


def manifest(docs: DataFrame, spec: Spec = Spec()) -> tuple[DataFrame, list[DataFrame], DataFrame, list[DataFrame]]:
    """Numbered leaves, rounds of the sources' trees, numbered sources, rounds of the tree above them."""
    rows = numbered(leaves(docs), ["doc_id", "leaf"], "merkle-leaves")
    below = build(rows.withColumn("digest", F.col("leaf")), spec, "merkle-log")
    ends = roots(below).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "round", "digest")
    sources = settle(numbered(ends, ["source"], "merkle-sources"), "merkle-sources-numbered")
    return rows, below, sources, build(sources, spec, "merkle-top")


def verified(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Per document its leaf, roots and proof, and the root that the tampered copy folds to."""
    rows, below, sources, above = manifest(docs, spec)
    top = roots(above).first()
    if top is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    root = bytes(top["digest"])
    start = docs.sparkSession.createDataFrame([("", len(above) - 1, b"", root)], "tree string, round int, path binary, subroot binary")
    opened = above[0].join(paths_above(above, start, spec, "merkle-top-paths"), ["tree", "block"])
    outer = opened.mapInPandas(_handed_down(spec), PATH).select(F.col("block").alias("idx"), "path")
    ends = sources.join(outer, "idx").select(F.col("source").alias("tree"), "round", "path", F.col("digest").alias("subroot"))
    ends = settle(ends, "merkle-ends")
    inner = below[0].join(paths_above(below, ends, spec, "merkle-paths"), ["tree", "block"]).select("tree", "block", "log", "path", "subroot")
    block = F.floor(F.col("idx") / spec.width).cast("long").alias("block")
    keyed = rows.select("tree", block, "idx", "n", "doc_id", "leaf", "tampered")
    return keyed.groupBy("tree", "block").cogroup(inner.groupBy("tree", "block")).applyInPandas(_prove(spec, root), RESULT)
