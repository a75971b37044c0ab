"""Token ids packed into rows of fixed length.

Documents become ids of a public byte-level tokenizer, with an end id after each. What
is longer than a row is cut into pieces without loss. Pieces are packed by
best-fit-decreasing: each, longest first, goes to the row with the least room that is
enough; a segment tree over the amounts of room finds it.

A task packs its documents in groups of about ``group`` tokens, so memory is bounded
and nothing is shuffled; only a group's last rows have room left.

A row of the result is a row of the id matrix: ``input_ids`` and ``position_ids`` are
little-endian unsigned integers (two bytes where ids and lengths allow, else four),
padded to the row's length; ``cu_seqlens`` are the segments' cumulative lengths, and
``doc_ids`` and ``pieces`` say what a segment is. Positions start at 0 in each segment.

Defined results: NULL and empty texts are the end id alone; a NULL id is kept;
repeated rows are packed one by one; an empty table gives no rows; columns beyond
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from tsengine.llm.common import small_batches

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the pattern that splits texts for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Between these two characters a text can be cut without changing its ids.
_CUT = regex.compile(r"(?<=\S) (?=\p{L})")

SCHEMA = (
    "sequence long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>,"
    " pieces array<int>"
)


@dataclass(frozen=True)
class Spec:
    """``ranks``: the tokenizer's file; ``end``: id after a document, also the padding; ``length``: of a row."""

    ranks: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    end: int = 50256
    length: int = 2048
    group: int = 4_000_000
    slab: int = 1 << 20

    def ids(self) -> str:
        return "<u2" if self.end < 1 << 16 else "<u4"

    def positions(self) -> str:
        return "<u2" if self.length <= 1 << 16 else "<u4"


def load_encoding(spec: Spec) -> tiktoken.Encoding:
    with open(spec.ranks, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, encoding: tiktoken.Encoding, spec: Spec) -> np.ndarray:
    """Ids of a text and the end; long texts are encoded slab by slab."""
    text, parts, at = text or "", [], 0
    while len(text) - at > spec.slab:
        cut = _CUT.search(text, at + spec.slab)
        if not cut:
            break
        parts.append(np.array(encoding.encode_ordinary(text[at : cut.start()]), spec.ids()))
        at = cut.start()
    parts.append(np.array(encoding.encode_ordinary(text[at:] if at else text), spec.ids()))
    return np.concatenate([*parts, np.array([spec.end], spec.ids())])


class Rooms:
    """Rows by their room: a segment tree counts the rows below each node, leaves are amounts of room."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.tree = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = self.base + room
        while node:
            self.tree[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes a row with the least room of at least ``size``."""
        node = self.base + size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.base
        while node:
            self.tree[node] -= 1
            node >>= 1
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Items of each row, by best-fit-decreasing."""
    rooms, rows = Rooms(length), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[item])
        if found is None:
            rows.append([item])
            row, room = len(rows) - 1, length
        else:
            row, room = found
            rows[row].append(item)
        if room > sizes[item]:
            rooms.put(row, room - sizes[item])
    return rows


def pack_group(group: list[tuple], first: int, spec: Spec, size: int = 1_000) -> Iterator[pd.DataFrame]:
    """Packed rows of a group of (doc_id, piece, ids), numbered from ``first``."""
    rows = best_fit([len(ids) for _, _, ids in group], spec.length)
    ramp = np.arange(spec.length, dtype=spec.positions())
    for at in range(0, len(rows), size):
        made = []
        for number, items in enumerate(rows[at : at + size], first + at):
            ids = np.full(spec.length, spec.end, spec.ids())
            places = np.zeros(spec.length, spec.positions())
            ends = [0]
            for item in items:
                piece = group[item][2]
                ids[ends[-1] : ends[-1] + len(piece)] = piece
                places[ends[-1] : ends[-1] + len(piece)] = ramp[: len(piece)]
                ends.append(ends[-1] + len(piece))
            docs, pieces = [group[i][0] for i in items], [group[i][1] for i in items]
            made.append((number, ends[-1], ids.tobytes(), places.tobytes(), ends, docs, pieces))
        yield pd.DataFrame(made, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def pack(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Packed rows of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(spec)
        number = TaskContext.get().partitionId() << 33
        group: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text, encoding, spec)
                doc = None if pd.isna(doc_id) else int(doc_id)
                for piece, at in enumerate(range(0, len(ids), spec.length)):
                    group.append((doc, piece, ids[at : at + spec.length]))
                held += len(ids)
                if held >= spec.group:
                    for frame in pack_group(group, number, spec):
                        number += len(frame)
                        yield frame
                    group, held = [], 0
        if group:
            yield from pack_group(group, number, spec)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Packed rows as files, one matrix per file, with what describes its rows next to it in the same rows."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def segments(packed: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """The pieces again: ``doc_id``, ``piece``, ``ids`` (binary); a document is its pieces in order."""
    width = np.dtype(spec.ids()).itemsize

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data, ends, docs, pieces in zip(batch["input_ids"], batch["cu_seqlens"], batch["doc_ids"], batch["pieces"]):
                data = bytes(data)
                for a, b, doc, piece in zip(ends, ends[1:], docs, pieces):
                    out.append((None if pd.isna(doc) else int(doc), int(piece), data[a * width : b * width]))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "piece", "ids"]).astype({"doc_id": "Int64"})

    columns = packed.select("input_ids", "cu_seqlens", "doc_ids", "pieces")
    return columns.mapInPandas(cut, "doc_id long, piece int, ids binary")
