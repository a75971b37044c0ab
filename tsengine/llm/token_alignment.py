"""Alignment of two tokenizers' ids on the same bytes.

Both encode a blank and the text. Where a token of each ends at the same byte, a group
ends; inside a group every pair of tokens whose bytes overlap is a link. A link's count
is the number of documents of the whole corpus that hold its pair of ids.

* **Fragments are a monoid.** A byte range of a text gives an open beginning (tokens up to
  the first common end), closed groups, and an open end (tokens after the last common
  end). Joining two neighbours closes the group between them, or leaves all open where one
  has no common end; that is associative, so ranges may be joined in any tree.
* **Long texts are cut anywhere.** A range's task encodes it with what lies around it up to
  the next places where neither tokenizer joins across (a blank between two ASCII letters),
  and owns the tokens that end in the range. Where such places are too far away the cut is
  left out: one endless word is one range. Ranges of one document are dealt over the
  cluster and composed sixteen at a time, round by round.
* **Short texts** are one range each. A batch of them is one array to NumPy, since the end
  of a text is a common end.
* **Counts** cover all documents: pairs are counted per task, then summed. Per document only
  its distinct pairs are written. The table of pairs goes back to the documents in blocks
  of whole A ids, of at most ``Spec.block_pairs`` pairs each (an A id has no more pairs than
  B has ids), one map-only pass a block.

Defined results: a text that is NULL or empty, or whose tokens' bytes aren't the blank and
the text, has no tokens: zeros and an empty digest. Every row is a document: rows with
equal or NULL ids, equal texts included, count one by one. An empty table has no rows.
Other columns are not looked at. Python tasks of the passes that read texts take at most
``common.BATCH_ROWS`` rows at once; the session's own setting is put back after them.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
import sys
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tsengine.llm.common import settle, small_tasks

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How byte-level vocabularies cut text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"


@dataclass(frozen=True)
class Spec:
    """Vocabulary files, bytes of a range of a long text, texts' bytes aligned at once, pairs sent at once."""

    byte_level: str = "/opt/tokenizers/byte_bpe_50k.json"
    pieces: str = "/opt/tokenizers/piece_bpe_32k.model"
    range_bytes: int = 32 << 10
    batch_bytes: int = 1 << 20
    fan_in: int = 16
    block_pairs: int = 1_000_000


# --- tokenizers ----------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class ByteLevel:
    """Ids of a byte-level vocabulary and the bytes they stand for; special tokens' strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet, vocab = byte_alphabet(), model["vocab"]
        merged = ["".join(m) if not isinstance(m, str) else m.replace(" ", "", 1) for m in model["merges"]]
        found = [vocab[m] for m in merged]
        self.path, self._slow = path, None
        single = {t: vocab[t] for t in alphabet if t in vocab}
        # Merging by lowest id is merging by order only where ids follow the order of merges.
        self._ordered = len(single) == 256 and all(a < b for a, b in zip(found, found[1:])) and max(single.values()) < found[0]
        known = [*single, *merged]
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token in known:
            self.bytes[vocab[token]] = bytes(alphabet[c] for c in token)
        if self._ordered:
            import tiktoken

            ranks = {self.bytes[vocab[t]]: vocab[t] for t in known}
            self._fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self._ordered:
            return [self._plain(t) for t in texts]
        made = []
        for text in texts:
            try:
                made.append(self._fast.encode_ordinary(text))
            except BaseException as error:  # noqa: BLE001 - its pattern engine panics on endless white space
                if type(error).__name__ not in ("PanicException", "ValueError"):
                    raise
                made.append(self._plain(text))
        return made


class Pieces:
    """Ids of a piece vocabulary; it puts a blank before what it encodes."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.bytes = [
            bytes([int(n[3:5], 16)]) if self._model.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)
        ]
        #: No piece goes on over a blank, so texts may be cut before one.
        self.cuttable = not any(BLANK in n.lstrip(BLANK) for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers, opened once in a worker."""

    _opened: dict[tuple[str, str], Pair] = {}

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.a_sizes, self.b_sizes = (np.array([len(v) for v in t.bytes], np.int64) for t in (a, b))
        # What a token writes into the digest, with what may follow it.
        self.marks = [f"{i}{end}" for i in range(len(a.bytes)) for end in ",|"]
        self.marks += [f"{i}{end}" for i in range(len(b.bytes)) for end in ",;"]

    @classmethod
    def open(cls, spec: Spec) -> Pair:
        at = (spec.byte_level, spec.pieces)
        if at not in cls._opened:
            cls._opened[at] = cls(ByteLevel(spec.byte_level), Pieces(spec.pieces))
        return cls._opened[at]

    def ids(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Both tokenizers' ids of texts that begin with a blank; none where their bytes aren't the text's."""
        a_ids, b_ids = self.a.encode(texts), self.b.encode([t[1:] for t in texts])
        made = []
        for text, a, b in zip(texts, a_ids, b_ids):
            raw = text.encode()
            same = b"".join(map(self.a.bytes.__getitem__, a)) == raw and b"".join(map(self.b.bytes.__getitem__, b)) == raw
            made.append((a, b) if same else None)
        return made


# --- groups and fragments ------------------------------------------------------------


@dataclass
class Run:
    """Tokens of both kinds with the bytes where they end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def part(self, after: int, upto: int) -> Run:
        """Tokens that end after one byte and up to another."""
        i, j = np.searchsorted(self.a_ends, [after, upto], "right")
        k, m = np.searchsorted(self.b_ends, [after, upto], "right")
        return Run(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])

    def __add__(self, other: Run) -> Run:
        return Run(*(np.concatenate(v) for v in zip(self.parts(), other.parts())))

    def parts(self):
        return self.a, self.a_ends, self.b, self.b_ends


def empty_run() -> Run:
    return Run(*(np.empty(0, np.int64) for _ in range(4)))


@dataclass
class Groups:
    """Closed groups: ids, tokens of each group, and a code for every link."""

    a: np.ndarray
    b: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    links: np.ndarray

    def parts(self):
        return self.a, self.b, self.a_sizes, self.b_sizes, self.links

    @classmethod
    def joined(cls, parts: list[Groups]) -> Groups:
        return cls(*(np.concatenate(v) for v in zip(*(p.parts() for p in parts)))) if parts else cls(*(np.empty(0, np.int64) for _ in range(5)))


def merged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of two ascending arrays together, each once, and those that are in both."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    again = both[1:] == both[:-1]
    return both[np.concatenate([[True], ~again])[: len(both)]], both[1:][again]


def closed(run: Run, width: int) -> Groups:
    """Groups of a run that begins and ends at common ends; ``width`` is the number of B's ids."""
    ends, common = merged(run.a_ends, run.b_ends)
    a_sizes = np.diff(np.searchsorted(run.a_ends, common, "right"), prepend=0)
    b_sizes = np.diff(np.searchsorted(run.b_ends, common, "right"), prepend=0)
    links = run.a[np.searchsorted(run.a_ends, ends)] * width + run.b[np.searchsorted(run.b_ends, ends)]
    return Groups(run.a, run.b, a_sizes, b_sizes, links)


@dataclass
class Fragment:
    """A byte range's tokens: open beginning, closed groups (None: no common end), open end.

    ``same`` tells whether the tokens' bytes are the text's.
    """

    same: bool
    head: Run
    body: Groups | None
    tail: Run


def fragment(run: Run, width: int) -> Fragment:
    _, common = merged(run.a_ends, run.b_ends)
    if not len(common):
        return Fragment(True, run, None, empty_run())
    first, last = int(common[0]), int(common[-1])
    end = 1 << 62
    return Fragment(True, run.part(-1, first), closed(run.part(first, last), width), run.part(last, end))


def joined(left: Fragment, right: Fragment, width: int) -> Fragment:
    """Associative; the neutral element is a fragment without tokens."""
    same = left.same and right.same
    if left.body is None:
        return Fragment(same, left.head + right.head, right.body, right.tail)
    if right.body is None:
        return Fragment(same, left.head, left.body, left.tail + right.head)
    between = left.tail + right.head
    parts = [left.body, *([closed(between, width)] if len(between.a) else []), right.body]
    return Fragment(same, left.head, Groups.joined(parts), right.tail)


def whole(fragment_: Fragment, width: int) -> Groups:
    """The groups of a fragment that is a whole text."""
    parts = [closed(fragment_.head, width)] if len(fragment_.head.a) else []
    return Groups.joined(parts + ([fragment_.body] if fragment_.body is not None else []))


# --- results of a text ---------------------------------------------------------------

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"
SPANS = ", a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"


def digest(groups: Groups, pair: Pair) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``."""
    a_last, b_last = np.cumsum(groups.a_sizes), np.cumsum(groups.b_sizes)
    a_mark, b_mark = groups.a * 2, 2 * len(pair.a.bytes) + groups.b * 2
    a_mark[a_last - 1] += 1
    b_mark[b_last - 1] += 1
    order = np.empty(len(a_mark) + len(b_mark), np.int64)
    order[np.arange(len(a_mark)) + np.repeat(b_last - groups.b_sizes, groups.a_sizes)] = a_mark
    order[np.arange(len(b_mark)) + np.repeat(a_last, groups.b_sizes)] = b_mark
    text = "".join(map(pair.marks.__getitem__, order.tolist()))[:-1]
    return hashlib.sha256(text.encode()).hexdigest()


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: their width, then the numbers."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted whole numbers as the bytes of their differences, lowest bytes first: they compress better so."""
    steps = np.diff(values, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return steps.T.tobytes()


def unpacked_sorted(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel().astype(np.int64))


def _row(doc_id, groups: Groups | None, pair: Pair, spans: bool):
    """A document's result; the pairs it holds with their times."""
    if groups is None or not len(groups.a):
        none = (doc_id, 0, 0, 0, 0, "", b"", packed(np.empty(0, np.int64)))
        return (*none, [], [], [], []) if spans else none
    codes, times = np.unique(groups.links, return_counts=True)
    counts = len(groups.a), len(groups.b), len(groups.a_sizes), len(groups.links)
    row = (doc_id, *counts, digest(groups, pair), packed_sorted(codes), packed(times))
    return (*row, *(v.astype(np.int32) for v in groups.parts()[:4])) if spans else row


def _ranges(ids: list[list[int]], sizes: np.ndarray):
    """Ids of several texts in one array, and where each text's ids begin and all end."""
    bounds = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(chain.from_iterable(ids), np.int64, bounds[-1])
    return flat, np.cumsum(sizes[flat]), bounds


def _batch(rows: list[tuple], pair: Pair, spans: bool):
    """Results of short texts, all at once: the end of a text is a common end."""
    found = pair.ids([" " + text for _, text in rows])
    good = [f for f in found if f is not None]
    made = iter(())
    if good:
        a, a_ends, a_bounds = _ranges([f[0] for f in good], pair.a_sizes)
        b, b_ends, b_bounds = _ranges([f[1] for f in good], pair.b_sizes)
        groups = closed(Run(a, a_ends, b, b_ends), len(pair.b.bytes))
        g = np.concatenate([[0], np.searchsorted(np.cumsum(groups.a_sizes), a_bounds[1:], "left") + 1])
        # A link ends wherever a token ends, and both end at once where a group does.
        links = a_bounds + b_bounds - g

        def parts():
            for i in range(len(good)):
                yield Groups(
                    a[a_bounds[i] : a_bounds[i + 1]], b[b_bounds[i] : b_bounds[i + 1]], groups.a_sizes[g[i] : g[i + 1]],
                    groups.b_sizes[g[i] : g[i + 1]], groups.links[links[i] : links[i + 1]],
                )

        made = parts()
    return [_row(doc_id, next(made) if f is not None else None, pair, spans) for (doc_id, _), f in zip(rows, found)]


def _columns(spans: bool) -> tuple[list[str], str]:
    schema = RESULT + (SPANS if spans else "")
    return [c.split()[0] for c in schema.split(", ")], schema


def _short(spec: Spec, spans: bool):
    names, _ = _columns(spans)

    def align(batches):
        pair = Pair.open(spec)
        for frame in batches:
            rows, size = [], 0
            for doc_id, text in zip(frame["doc_id"].astype(object), frame["text"]):
                rows.append((None if pd.isna(doc_id) else int(doc_id), text if isinstance(text, str) else ""))
                size += len(rows[-1][1])
                if size >= spec.batch_bytes:
                    yield _frame(rows, pair, spans, names)
                    rows, size = [], 0
            if rows:
                yield _frame(rows, pair, spans, names)

    return align


def _frame(rows: list[tuple], pair: Pair, spans: bool, names: list[str]) -> pd.DataFrame:
    full = [r for r in rows if r[1]]
    made = iter(_batch(full, pair, spans) if full else ())
    out = [next(made) if r[1] else _row(r[0], None, pair, spans) for r in rows]
    frame = pd.DataFrame(out, columns=names)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


# --- long texts ----------------------------------------------------------------------

# Where neither tokenizer joins: before a blank between two ASCII letters.
CUT = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")
PIECE = "rid long, doc_id long, seq long, low long, high long, start long, around binary"
FRAGMENT = "rid long, doc_id long, seq long, fragment binary"


def ranges(raw: bytes, size: int, cuttable: bool) -> list[tuple[int, int, int, int]]:
    """Byte ranges of a text, each with the bytes that must be encoded for it: low, high, start, end.

    A multiple of ``size`` is a bound unless the places around it where the text may be
    cut are more than ``size`` apart.
    """
    bounds = [(0, 0, 0)]
    for at in range(size, len(raw) - 1, size) if cuttable else ():
        after = CUT.search(raw, at, min(len(raw), at + size))
        if not after:
            continue
        # The last cut not after the bound, looked for in doubling steps back.
        step, before = 64, None
        while before is None and step <= 2 * size:
            for found in CUT.finditer(raw, max(0, at - step), at + 2):
                if found.start() <= at:
                    before = found.start()
            step *= 2
        if before is not None and before > 0 and after.start() - before <= size:
            bounds.append((at, before, after.start()))
    bounds.append((len(raw), len(raw), len(raw)))
    return [(low, high, start, end) for (low, start, _), (high, _, end) in zip(bounds, bounds[1:])]


def _cut(spec: Spec, cuttable: bool):
    def cut(batches):
        for frame in batches:
            for rid, doc_id, text in zip(frame["rid"], frame["doc_id"].astype(object), frame["text"]):
                raw = b" " + text.encode()
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for seq, (low, high, start, end) in enumerate(ranges(raw, spec.range_bytes, cuttable)):
                    made = pd.DataFrame([(rid, doc_id, seq, low, high, start, raw[start:end])], columns=[c.split()[0] for c in PIECE.split(", ")])
                    made["doc_id"] = made["doc_id"].astype("Int64")
                    yield made

    return cut


def _fragments(spec: Spec):
    def encode(batches):
        pair = Pair.open(spec)
        width = len(pair.b.bytes)
        for frame in filter(len, batches):
            made = []
            for low, high, start, around in zip(frame["low"], frame["high"], frame["start"], frame["around"]):
                (found,) = pair.ids([around.decode()])
                if found is None:
                    made.append(Fragment(False, empty_run(), None, empty_run()))
                    continue
                (a, a_ends, _), (b, b_ends, _) = _ranges([found[0]], pair.a_sizes), _ranges([found[1]], pair.b_sizes)
                made.append(fragment(Run(a, a_ends + start, b, b_ends + start).part(low, high), width))
            frame["fragment"] = [pickle.dumps(_state(f)) for f in made]
            yield frame[["rid", "doc_id", "seq", "fragment"]]

    return encode


def _state(f: Fragment):
    """A fragment as plain arrays, which need no class on the other side."""
    return f.same, f.head.parts(), None if f.body is None else f.body.parts(), f.tail.parts()


def _opened(raw: bytes) -> Fragment:
    same, head, body, tail = pickle.loads(raw)
    return Fragment(same, Run(*head), None if body is None else Groups(*body), Run(*tail))


def _compose(spec: Spec):
    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        width = len(Pair.open(spec).b.bytes)
        # Neighbours are joined two by two: composing is associative.
        parts = [_opened(raw) for raw in rows["fragment"]]
        while len(parts) > 1:
            pairs = [joined(x, y, width) for x, y in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[len(pairs) * 2 :]
        out = rows.iloc[:1][["rid", "doc_id"]].copy()
        out["seq"], out["fragment"] = key[1], [pickle.dumps(_state(parts[0]))]
        return out

    return compose


def _finish(spec: Spec, spans: bool):
    names, _ = _columns(spans)

    def finish(batches):
        pair = Pair.open(spec)
        for frame in filter(len, batches):
            for doc_id, raw in zip(frame["doc_id"].astype(object), frame["fragment"]):
                found = _opened(raw)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                made = pd.DataFrame([_row(doc_id, whole(found, len(pair.b.bytes)) if found.same else None, pair, spans)], columns=names)
                made["doc_id"] = made["doc_id"].astype("Int64")
                yield made

    return finish


def _long(docs: DataFrame, spec: Spec, spans: bool) -> DataFrame:
    """Results of long texts: ranges over the cluster, composed in rounds."""
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    pieces = settle(numbered.mapInPandas(_cut(spec, Pair.open(spec).b.cuttable), PIECE), "token-ranges")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = settle(pieces.repartition(width, "rid", "seq").mapInPandas(_fragments(spec), FRAGMENT), "token-fragments")
    most = parts.agg(F.max("seq")).first()[0]
    while most:
        parts = parts.withColumn("grp", F.floor(F.col("seq") / spec.fan_in).cast("long"))
        parts = settle(parts.groupBy("rid", "grp").applyInPandas(_compose(spec), FRAGMENT), "token-fragments")
        most //= spec.fan_in
    return parts.mapInPandas(_finish(spec, spans), _columns(spans)[1])


def align(docs: DataFrame, spec: Spec = Spec(), spans: bool = False) -> DataFrame:
    """A row a document: numbers of tokens, groups and links, the groups' digest, its distinct pairs.

    ``codes`` and ``times`` are the pairs and how often each is linked, packed. With
    ``spans`` the groups themselves come along: ids of both kinds, tokens of each group.
    The result is settled.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    texts = docs.select("doc_id", "text", size.alias("size"))
    long = texts.where(F.col("size") > 2 * spec.range_bytes)
    with small_tasks(docs.sparkSession):
        made = settle(texts.where(F.col("size") <= 2 * spec.range_bytes).mapInPandas(_short(spec, spans), _columns(spans)[1]), "aligned")
        if long.isEmpty():
            return made
        return made.unionByName(settle(_long(long, spec, spans), "aligned-long"))


# --- counts over the corpus ----------------------------------------------------------


def _document_counts(limit: int):
    """Pairs of a task's documents with the number of documents; sent on whenever there are many."""

    def count(batches):
        held, size = [], 0

        def merged():
            codes = np.concatenate([c for c, _ in held])
            found, at = np.unique(codes, return_inverse=True)
            return found, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for frame in batches:
            for raw in frame["codes"]:
                codes = unpacked_sorted(raw)
                held.append((codes, np.ones(len(codes), np.int64)))
                size += len(codes)
                if size > 2 * limit:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > limit:
                        yield pd.DataFrame({"code": held[0][0], "docs": held[0][1]})
                        held, size = [], 0
        if size:
            found, docs = merged()
            yield pd.DataFrame({"code": found, "docs": docs})

    return count


def pair_counts(aligned: DataFrame, spec: Spec) -> DataFrame:
    """code, a, docs, best: documents that hold a pair, and whether no pair of its A id is in more."""
    width = len(Pair.open(spec).b.bytes)
    counted = aligned.select("codes").mapInPandas(_document_counts(spec.block_pairs), "code long, docs long")
    counted = counted.groupBy("code").agg(F.sum("docs").alias("docs")).withColumn("a", F.floor(F.col("code") / width).cast("long"))
    counted = settle(counted, "pair-counts")
    # One row an A id: the vocabulary bounds it.
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return settle(counted.join(F.broadcast(most), "a").select("code", "a", "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")


def _blob(batches):
    for frame in filter(len, batches):
        yield pd.DataFrame([(frame["code"].to_numpy().tobytes(), frame["docs"].to_numpy().tobytes(), frame["best"].to_numpy(bool).tobytes())], columns=["code", "docs", "best"])


def _share(pairs: DataFrame):
    """Broadcasts a block of pairs, sorted by code; at most ``Spec.block_pairs`` and one A id more."""
    rows = pairs.mapInPandas(_blob, "code binary, docs binary, best binary").collect()
    code, docs, best = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.int64, np.int64, bool)))
    order = np.argsort(code)
    return pairs.sparkSession.sparkContext.broadcast((code[order], docs[order], best[order]))


def _weigh(shared):
    def weigh(batches):
        code, docs, best = shared.value
        for frame in filter(len, batches):
            sums, bests = [], []
            for raw, often in zip(frame["codes"], frame["times"]):
                own, times = unpacked_sorted(raw), unpacked(often)
                at = np.minimum(np.searchsorted(code, own), len(code) - 1)
                here = code[at] == own
                at, times = at[here], times[here]
                sums.append(int((times * docs[at]).sum()))
                bests.append(int(times[best[at]].sum()))
            frame["count_sum"] = frame["count_sum"] + np.array(sums, np.int64)
            frame["n_best"] = frame["n_best"] + np.array(bests, np.int64)
            yield frame

    return weigh


def blocks(pairs: DataFrame, spec: Spec) -> list[tuple[int, int]]:
    """First and last A id of each block of pairs."""
    sizes = sorted((r["a"], r["count"]) for r in pairs.groupBy("a").count().collect())
    made: list[tuple[int, int]] = []
    held = spec.block_pairs + 1
    for a, size in sizes:
        if held + size > spec.block_pairs:
            made.append((a, a))
            held = 0
        made[-1] = (made[-1][0], a)
        held += size
    return made


def counted(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Per document its tokens, groups and links, and how common its links are in the corpus."""
    aligned = align(docs, spec)
    pairs = pair_counts(aligned, spec)
    state = aligned.select("*", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    schema = f"{RESULT}, n_best long, count_sum long"
    parts = blocks(pairs, spec)
    for number, (first, last) in enumerate(parts):
        shared = _share(pairs.where(F.col("a").between(first, last)))
        state = state.mapInPandas(_weigh(shared), schema)
        if number + 1 < len(parts):
            state = settle(state, "token-weighed")
    return state.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
