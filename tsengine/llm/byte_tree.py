"""Context-tree weighting over bytes, with every context that was met twice.

A byte is eight binary decisions, each with a tree of the contexts (up to ``depth``
bytes) in which it was met. A context is a node of a decision's tree if it was met
there ``LEAST`` times in training, at every size of the input; what is rarer is one
child of its parent. Nodes predict by Krichevsky-Trofimov estimates, mixed over all
depths by context-tree weights.

No table is held whole anywhere. Texts are dealt into spans by their hash, a span's
different grams (a context and its byte) by the last four bytes of the context into
buckets. A bucket holds whole subtrees: it gives the weights at its top to the buckets
of the next part (four to two bytes, then two to none, of fixed size), gets back what
the contexts above predict, and answers each span's grams. Spans and buckets are
partitions: what comes back to them joins them where they lie, so texts and grams
are shuffled once, and a gram travels once for each span, however often it is met.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tsengine.llm.common import settle  # noqa: F401

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Times a context is met to be a node, bytes of text for each bucket, and how often as many a span has;
# positions that are sorted at once, different words in a message, and the byte of an end.
LEAST = 2
BLOCK = 4 << 20
SPAN = 6
PIECE = 1 << 20
WORDS = 200_000
END = 10
ENTRY = np.dtype([("ctx", "<u8"), ("node", "u1"), ("zeros", "<i8"), ("ones", "<i8"), ("log", "<f8")])
ABOVE = np.dtype([("settled", "<f8"), ("left", "<f8"), ("final", "<f8")])

_TABLE = 1 << 16
_HALF = np.array([math.lgamma(k + 0.5) for k in range(_TABLE)])
_ONE = np.array([math.lgamma(k + 1.0) for k in range(_TABLE)])


def _log_gamma(counts: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    """log gamma(count + more): looked up, beyond the table Stirling's series."""
    found = table[np.minimum(counts, _TABLE - 1)]
    large = counts >= _TABLE
    if large.any():
        x = counts[large] + more
        found[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
    return found


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros, _HALF, 0.5) + _log_gamma(ones, _HALF, 0.5) - _log_gamma(zeros + ones, _ONE, 1.0) - math.log(math.pi)


def squeeze(data: bytes, level: int = 1) -> bytes:
    """Compressed, after its length."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def loose(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], size, asbytes=True) if size else b""


def pack(values: np.ndarray) -> bytes:
    """Compressed; the bytes of equal weight lie together."""
    return squeeze(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(loose(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_grams(ctx: np.ndarray, symbol: np.ndarray, n: np.ndarray, depth: int) -> tuple[bytes, bytes, bytes]:
    """Sorted grams: how many bytes each shares with the one before it, then what differs, byte by byte; and counts."""
    columns = [(ctx >> np.uint64(8 * (depth - 1 - k))).astype(np.uint8) for k in range(depth)] + [symbol]
    shared, same = np.zeros(len(ctx), np.uint8), np.ones(max(len(ctx) - 1, 0), bool)
    for column in columns[:-1]:
        same &= column[1:] == column[:-1]
        shared[1:] += same
    return squeeze(shared.tobytes()), squeeze(b"".join(c[shared <= k].tobytes() for k, c in enumerate(columns))), pack(n.astype("<i4"))


def unpack_grams(data: tuple[bytes, bytes, bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shared, left = np.frombuffer(loose(data[0]), np.uint8), np.frombuffer(loose(data[1]), np.uint8)
    ctx = np.zeros(len(shared), np.uint64)
    for k in range(depth):
        given = np.flatnonzero(shared <= k)
        ctx = (ctx << np.uint64(8)) | np.repeat(left[: len(given)], np.diff(given, append=len(shared)))
        left = left[len(given) :]
    return ctx, left, unpack(data[2], "<i4").astype(np.int64)


class Span:
    """Byte strings laid out with ends between them, so that the bytes before a place are its context."""

    def __init__(self, strings: list[bytes], depth: int):
        self.joined = b"".join([b"\n" * 8, *[s + b"\n" * 7 for s in strings]])
        self.size, self.drop = len(self.joined) - 8, np.uint64(8 * (8 - depth))
        self.ends = np.cumsum(np.array([len(s) + 7 for s in strings], np.int64)) - 8
        self.starts = np.concatenate([[0], self.ends[:-1] + 8])

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """The ``depth`` bytes before each place, the last one highest."""
        found = np.ndarray((self.size,), "<u8", self.joined, 0, (1,))[at]
        return found >> self.drop if self.drop else found

    def places(self) -> Iterator[list[tuple[int, np.ndarray]]]:
        """By the last byte of the context, in its order: each byte value with its places, in order."""
        pairs = np.ndarray((self.size,), ">u2", self.joined, 7, (1,))  # a byte after the one before it
        found: dict[int, list[np.ndarray]] = {}

        def add(keys: np.ndarray, at: np.ndarray) -> None:
            values, first = distinct(keys)
            for value, a, b in zip(values.tolist(), first, np.append(first[1:], len(at))):
                found.setdefault(value, []).append(at[a:b].copy())  # or a part would hold the whole

        for begin in range(0, self.size, PIECE):
            keys = pairs[begin : begin + PIECE].astype(np.uint16)
            order = np.argsort(keys, kind="stable")
            add(keys[order], order.astype(np.uint32) + np.uint32(begin))
        for key in [key for key in found if key & 255 == END]:
            del found[key]  # others than these only keep texts apart
        order = np.argsort(pairs[self.ends], kind="stable")
        add(pairs[self.ends][order], self.ends[order].astype(np.uint32))
        last: dict[int, list[int]] = {}
        for key in sorted(found):
            last.setdefault(key >> 8, []).append(key)
        for keys in last.values():
            yield [(key & 255, np.concatenate(found.pop(key))) for key in keys]

    def batches(self, units: int, drop: int, made: Callable) -> Iterator[tuple[list[np.ndarray], list[tuple[int, np.ndarray]]]]:
        """What ``made`` gives for the places of a byte (contexts, and more), and by bucket where its grams lie in that.

        A bucket's grams are in order, by context, then byte, through all batches.
        """

        def batch(some: list[tuple[np.ndarray, ...]]) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray]]]:
            columns = [np.concatenate(c) for c in zip(*some)]
            order = np.argsort(columns[0], kind="stable")
            return columns, [(unit, order[at]) for unit, at in by_unit(unit_of(columns[0][order], drop, units))]

        held: list[tuple[np.ndarray, ...]] = []
        for some in self.places():
            held += [made(value, at) for value, at in some]
            if sum(len(x[0]) for x in held) >= PIECE:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ones of sorted values, and where each begins."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], first


def counted_grams(span: Span, known: int, units: int, drop: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """By bucket the different contexts and bytes of a span, and their counts in its first ``known`` strings, the training ones."""
    held, top = span.starts[known] if known < len(span.starts) else span.size, np.uint64(255 << 56)

    def counted(value: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
        met = span.contexts(at)
        last = met[0] & top
        met <<= np.uint64(8)  # the last byte, which all have, makes room for whether a place is held out
        met[np.searchsorted(at, held) :] |= np.uint64(1)
        met.sort()
        both, first = distinct(met >> np.uint64(8))
        times = np.diff(first, append=len(met)) - np.add.reduceat((met & np.uint64(1)).astype(np.int32), first)
        return both | last, np.full(len(both), value, np.uint8), times.astype(np.int32)

    parts: dict[int, list[list[np.ndarray]]] = {}
    for columns, dealt in span.batches(units, drop, counted):
        for unit, at in dealt:
            parts.setdefault(unit, []).append([c[at] for c in columns])
    for unit in sorted(parts):
        yield unit, [np.concatenate(c) for c in zip(*parts.pop(unit))]


def summed_logs(span: Span, units: int, drop: int, logs: dict[int, np.ndarray]) -> np.ndarray:
    """By string the sum of its grams' logs, given by bucket in the order in which the grams were."""
    sums, taken = np.zeros(len(span.starts)), Counter()

    def placed(value: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
        met = span.contexts(at)
        order = np.argsort(met)
        both, first = distinct(met[order])
        string = (np.searchsorted(span.starts, at, "right") - 1).astype(np.int32)
        return both, np.diff(first, append=len(met)), string[order]

    for (ctx, times, string), dealt in span.batches(units, drop, placed):
        found = np.empty(len(ctx), "<f4")
        for unit, at in dealt:
            found[at] = logs[unit][taken[unit] : taken[unit] + len(at)]
            taken[unit] += len(at)
        sums += np.bincount(string, weights=np.repeat(found, times), minlength=len(sums))
    return sums


def words_in(joined: bytes) -> pa.Array:
    """Words of which each ends with a blank."""
    stops = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1
    return pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(np.concatenate([[0], stops])), pa.py_buffer(joined)])


def joined_words(words: pa.Array) -> bytes:
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return words.buffers()[2][ends[0] : ends[-1]].to_pybytes() if len(words) else b""


def words_of(strings: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The word at each place, by its number; different words; and the number of words of each string."""
    words = words_in(b"".join([s[:-1] + b" " for s in strings if len(s) > 1])).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, np.array([s.count(b" ") + 1 if len(s) > 1 else 0 for s in strings], np.int64)


def unit_of_words(words: pa.Array, units: int) -> np.ndarray:
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    at = (np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))).astype(np.uint64)
    keys = np.add.reduceat(data * ((at * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), ends[:-1] - ends[0])
    return unit_of(keys, 0, units)


def deal_words(words: pa.Array, counts: np.ndarray, units: int, span: int, most: int) -> Iterator[tuple]:
    """Different words and their counts by bucket."""
    if not len(words):
        return
    order = pc.array_sort_indices(words).to_numpy()
    for unit, at in by_unit(unit_of_words(words, units)[order]):
        for begin in range(0, len(at), most):
            some = order[at[begin : begin + most]]
            yield unit, ("words", span, squeeze(joined_words(words.take(pa.array(some)))), pack(counts[some].astype("<i8")))


def sum_words(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The spans' words by their numbers, the sum of each different one, and how many each message has."""
    read = [words_in(loose(words)) for _, words, _ in parts]
    if not read:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    numbers = pa.concat_arrays(read).dictionary_encode().indices.to_numpy()
    counts = np.concatenate([unpack(c, "<i8") for *_, c in parts])
    return numbers, np.bincount(numbers, weights=counts).astype(np.int64), [len(r) for r in read]


def unit_of(ctx: np.ndarray, drop: int, units: int) -> np.ndarray:
    """Bucket of contexts by their last bytes; ``drop``: how many older ones don't count."""
    key = ctx >> np.uint64(8 * drop)
    mixed = (key ^ (key >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return (((mixed >> np.uint64(32)) * np.uint64(units)) >> np.uint64(32)).astype(np.int64)


def by_unit(units: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with its places, in order."""
    order = np.argsort(units.astype(np.uint16) if len(units) and units.max() < 1 << 16 else units, kind="stable")  # short numbers sort faster
    found = units[order]
    cuts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]])) if len(found) else []
    for a, b in zip(cuts, cuts[1:]):
        yield int(found[a]), order[a:b]


def climb(part: np.ndarray | dict[str, np.ndarray], bottom: int, top: int, leaves: bool) -> tuple[list[tuple], np.ndarray]:
    """Levels of one decision's trees from ``top`` down, and the entries at ``top``.

    ``part``: entries at ``bottom``, sorted by node and context. A level: is it a node,
    own weight, own and the rest's estimate, and each child's place in it.
    """
    ctx, which, zeros, ones, logs = (np.ascontiguousarray(part[n]) for n in ("ctx", "node", "zeros", "ones", "log"))
    levels = []
    if leaves:
        met = zeros + ones >= LEAST
        logs = np.zeros(len(ctx))
        logs[met] = log_kt(zeros[met], ones[met])
        estimate = (ones + 0.5) / (zeros + ones + 1)
        levels.append((met, np.ones(len(ctx)), estimate, estimate, None))
    for d in range(bottom - 1, top - 1, -1):
        met, shorter = zeros + ones >= LEAST, ctx >> np.uint64(8)
        new = np.concatenate([[True], (shorter[1:] != shorter[:-1]) | (which[1:] != which[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        add = lambda x: np.diff(np.cumsum(x)[last], prepend=0)
        rest_zeros, rest_ones, below = add(np.where(met, 0, zeros)), add(np.where(met, 0, ones)), np.add.reduceat(logs, first)
        ctx, which, zeros, ones = shorter[first], which[first], add(zeros), add(ones)
        here = (zeros + ones >= LEAST) | (d == 0)
        at = np.flatnonzero(here)  # what is no node has neither
        alone = log_kt(zeros[at], ones[at])
        mixed = np.logaddexp(alone, below[at] + log_kt(rest_zeros[at], rest_ones[at])) + math.log(0.5)
        logs, weight = np.zeros(len(here)), np.zeros(len(here))
        logs[at], weight[at] = mixed, np.exp(math.log(0.5) + alone - mixed)
        estimate, others = (ones + 0.5) / (zeros + ones + 1), (rest_ones + 0.5) / (rest_zeros + rest_ones + 1)
        levels.append((here, weight, estimate, others, np.cumsum(new) - 1))
    made = np.empty(len(ctx), ENTRY)
    for name, value in zip(ENTRY.names, (ctx, which, zeros, ones, logs)):
        made[name] = value
    return levels[::-1], made


def sink(levels: list[tuple], above: np.ndarray) -> np.ndarray:
    """What the nodes at and above the last level predict; ``above``: the same of the first level's parents."""
    settled, left, final = (above[n] for n in ABOVE.names)
    for met, weight, estimate, others, child in levels:
        now = np.where(met, settled + left * weight * estimate, final)
        left = np.where(met, left * (1 - weight), 0.0)
        settled, final = now, np.where(met, now + left * others, final)
        if child is not None:
            settled, left, final = settled[child], left[child], final[child]
    made = np.empty(len(settled), ABOVE)
    for name, value in zip(ABOVE.names, (settled, left, final)):
        made[name] = value
    return made


def gram_entries(ctx: np.ndarray, symbol: np.ndarray, n: np.ndarray, bit: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Entries of one decision of sorted grams; by gram its place among them and its outcome."""
    prefix = symbol >> np.uint8(8 - bit) if bit else np.zeros(len(symbol), np.uint8)
    outcome = (symbol >> np.uint8(7 - bit)) & 1
    order = np.argsort(prefix, kind="stable")
    c, p, k, one = ctx[order], prefix[order], n[order], outcome[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (p[1:] != p[:-1])])
    first = np.flatnonzero(new)
    ones = np.add.reduceat(k * one, first)
    made = {"ctx": c[first], "node": p[first] | np.uint8(1 << bit), "zeros": np.add.reduceat(k, first) - ones, "ones": ones, "log": np.zeros(len(first))}
    place = np.empty(len(ctx), np.int64)
    place[order] = np.cumsum(new) - 1
    return made, place, outcome


def byte_blocks(texts: DataFrame, size: int = BLOCK) -> DataFrame:
    """Adds ``block``: runs of a task's texts of ``size`` bytes (one longer text is a block)."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = []
            for text in batch["text"]:
                now = len((text or "").encode("utf-8", "surrogatepass")) + 1
                if held and held + now > size:
                    block, held = block + 1, 0
                held += now
                numbers.append(block)
            yield batch.assign(block=np.array(numbers, np.int64))

    return texts.mapInPandas(number, "doc_id string, text string, held_out boolean, block long")


def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the spans' sorted grams, sorted; by gram of a span its place."""
    ctx, symbol, n = (np.concatenate(x) for x in zip(*parts))
    if len(parts) == 1:
        return ctx, symbol, n, np.arange(len(ctx))
    # Both times sorted runs are merged, which a stable sort does fast.
    order = np.argsort(ctx, kind="stable")
    c = ctx[order]
    new = np.concatenate([[True], c[1:] != c[:-1]])
    key = np.empty(len(ctx), np.int64)
    key[order] = np.cumsum(new) << 8
    key |= symbol
    order = np.argsort(key, kind="stable")
    key = key[order]
    met, first = distinct(key)
    place = np.empty(len(ctx), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))
    return c[new][(met >> 8) - 1], (met & 255).astype(np.uint8), np.add.reduceat(n[order], first), place


def own(key: int) -> int:
    """Spans and buckets are partitions by their number."""
    return key


def pack_texts(texts: DataFrame, spans: int, size: int) -> RDD:
    """Texts by span: (span, ids, texts and held_out as bytes). A row's span is made of its block, or else of itself.

    Rows that are alike are dealt one after the other, so they don't meet in a span.
    """
    blocks = "block" in texts.columns
    key = F.col("block") if blocks else F.xxhash64("doc_id", "text")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        seen, bytes_held = Counter(), 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(k, squeeze(pickle.dumps(tuple(zip(*v)), 5), 3)) for k, v in held.items()], columns=["span", "texts"])

        for batch in batches:
            for doc, text, out, of in zip(batch["doc_id"], batch["text"], batch["held_out"], batch["key"]):
                span = int(of if blocks else of + seen[of]) % spans
                seen[of] += 1
                held.setdefault(span, []).append((doc, text, bool(out)))
                bytes_held += len(text or "") + 1
            if bytes_held > SPAN * size // 2:
                yield rows()
                held, bytes_held = {}, 0
        if held:
            yield rows()

    made = texts.select("doc_id", "text", "held_out", key.alias("key")).mapInPandas(packed, "span long, texts binary")
    return made.rdd.map(tuple).partitionBy(spans, own)


def read_texts(rows: list[tuple]) -> pd.DataFrame:
    ids, texts, out = (sum(x, ()) for x in zip(*[pickle.loads(loose(data)) for data in rows]))
    group = pd.DataFrame({"held_out": np.array(out, bool)})
    group["doc_id"], group["text"] = pd.Series(ids, dtype=object), pd.Series(texts, dtype=object)
    return group


def grouped(rows: Iterator[tuple]) -> tuple[int | None, dict[str, list]]:
    """A partition's span or bucket, and what lies in it by kind."""
    key, kinds = None, {"grams": [], "words": [], "texts": [], "above": [], "entries": [], "known": []}
    for key, value in rows:
        if isinstance(value, bytes | bytearray):
            kinds["texts"].append(value)
        else:
            kinds[value[0]].append(value[1:])
    return key, kinds


def scored(
    texts: DataFrame, string_of: Callable, rows_of: Callable, schema: str, depth: int, size: int = BLOCK, words: bool = True, most: int = WORDS
) -> tuple[DataFrame, tuple[int, int, int]]:
    """As ``text_logs``, with counts of words: in training words, different ones, and texts in training.

    With ``words`` byte strings are words between blanks; ``rows_of`` then gets the training count of
    each word of its texts, and each text's number of words. ``most``: different words in a message.
    """
    spark, columns = texts.sparkSession, StructType.fromDDL(schema)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tops = [t for t in (4, 2, 0) if t < depth]
    units = [max(1, -(-total // size))]
    units += [max(1, units[0] // 16) if t else 1 for t in tops[1:]]
    bottoms = [depth, *tops]
    spans = max(1, -(-total // (SPAN * size)))

    def deal(rows: Iterator[tuple]) -> Iterator[tuple]:
        span, kinds = grouped(rows)
        if span is None:
            return
        group = read_texts(kinds.pop("texts"))
        training = ~group["held_out"].to_numpy(bool)
        yield span % units[0], ("known", int(training.sum()))
        strings = [string_of(t) for t in group["text"]]
        del group, kinds
        if words:
            numbers, different, sizes = words_of(strings)
            yield from deal_words(different, np.bincount(numbers[np.repeat(training, sizes)], minlength=len(different)), units[0], span, most)
            del numbers, different
            pa.default_memory_pool().release_unused()
        order = np.argsort(~training, kind="stable")
        span_of, known = Span([strings[i] for i in order], depth), int(training.sum())
        del strings
        for unit, (ctx, symbol, n) in counted_grams(span_of, known, units[0], depth - tops[0]):
            yield unit, ("grams", span, *pack_grams(ctx, symbol, n, depth))

    held = pack_texts(texts, spans, size)
    dealt = held.mapPartitions(deal).partitionBy(units[0], own)

    def met(rows: Iterator[tuple]) -> Iterator[tuple[int, int, int]]:
        _, kinds = grouped(rows)
        sums = sum_words(kinds["words"])[1]
        yield int(sums.sum()), int((sums > 0).sum()), sum(k for (k,) in kinds["known"])

    totals = tuple(int(x) for x in np.sum(dealt.mapPartitions(met).collect(), axis=0)) if words else (0, 0, 0)

    def raised(unit: int, entries: np.ndarray, k: int) -> Iterator[tuple]:
        """Rows for the next part's buckets; they hold where they come from."""
        for up, at in by_unit(unit_of(entries["ctx"], tops[k] - tops[k + 1], units[k + 1])):
            yield up, ("entries", unit, pack(entries[at]))

    def merged(kinds: dict[str, list]) -> tuple[list[int], list[int], tuple]:
        """Spans, how many grams each has, and all grams."""
        spans_here, parts = [], []
        for span, *data in sorted(kinds.pop("grams"), key=lambda x: x[0]):
            spans_here.append(span)
            parts.append(unpack_grams(data, depth))
        return spans_here, [len(p[0]) for p in parts], merge(parts)

    def up_grams(rows: Iterator[tuple]) -> Iterator[tuple]:
        unit, kinds = grouped(rows)
        if kinds["grams"]:
            ctx, symbol, n, _ = merged(kinds)[2]
            yield from raised(unit, np.concatenate([climb(gram_entries(ctx, symbol, n, bit)[0], depth, tops[0], True)[1] for bit in range(8)]), 0)

    def joined(kinds: dict[str, list]) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        """Parts, their sizes, all entries in order, and the order."""
        group = sorted(kinds.pop("entries"))
        parts = [unpack(e, ENTRY) for _, e in group]
        entries = np.concatenate(parts)
        order = np.lexsort((entries["ctx"], entries["node"]))
        return [k for k, _ in group], [len(p) for p in parts], entries[order], order

    def up_of(k: int) -> Callable:
        def up(rows: Iterator[tuple]) -> Iterator[tuple]:
            unit, kinds = grouped(rows)
            if kinds["entries"]:
                yield from raised(unit, climb(joined(kinds)[2], bottoms[k], tops[k], False)[1], k)

        return up

    def over_of(above: list[tuple], k: int) -> Callable:
        """What the next part's buckets sent back; each call takes the next entries."""
        sent, taken = {up: unpack(data, ABOVE) for up, data in above}, Counter()

        def over(ctx: np.ndarray) -> np.ndarray:
            if k + 1 == len(tops):
                return np.repeat(start, len(ctx))
            made = np.empty(len(ctx), ABOVE)
            for up, at in by_unit(unit_of(ctx, tops[k] - tops[k + 1], units[k + 1])):
                made[at] = sent[up][taken[up] : taken[up] + len(at)]
                taken[up] += len(at)
            return made

        return over

    def down_of(k: int) -> Callable:
        def down(rows: Iterator[tuple]) -> Iterator[tuple]:
            unit, kinds = grouped(rows)
            if not kinds["entries"]:
                return
            parts, sizes, entries, order = joined(kinds)
            levels, top = climb(entries, bottoms[k], tops[k], False)
            back = np.empty(len(order), ABOVE)
            back[order] = sink(levels, over_of(kinds["above"], k)(top["ctx"]))
            for part, piece in zip(parts, np.split(back, np.cumsum(sizes)[:-1])):
                yield part, ("above", unit, pack(piece))

        return down

    start = np.array([(0.0, 1.0, 0.5)], ABOVE)
    passed = [dealt]  # by part of the tree what its buckets hold
    for k in range(len(tops) - 1):
        passed.append(passed[-1].mapPartitions(up_of(k) if k else up_grams).partitionBy(units[k + 1], own))
    for k in range(len(tops) - 1, 0, -1):
        passed[k - 1] = passed[k - 1].union(passed[k].mapPartitions(down_of(k)).partitionBy(units[k - 1], own))

    def answer(rows: Iterator[tuple]) -> Iterator[tuple]:
        unit, kinds = grouped(rows)
        messages = kinds.pop("words")
        numbers, sums, sizes = sum_words(messages)
        for (span, listed, _), some in zip(messages, np.split(numbers, np.cumsum(sizes)[:-1])):
            yield span, ("words", listed, pack(sums[some]))
        if not kinds["grams"]:
            return
        over = over_of(kinds.pop("above"), 0)
        spans_here, sizes, (ctx, symbol, n, place) = merged(kinds)
        chance = np.ones(len(ctx))
        for bit in range(8):  # in the order in which the tops were given
            entries, at, outcome = gram_entries(ctx, symbol, n, bit)
            levels, top = climb(entries, depth, tops[0], True)
            one = sink(levels, over(top["ctx"]))["final"][at]
            chance *= np.where(outcome == 1, one, 1 - one)
        for span, piece in zip(spans_here, np.split(np.log10(chance).astype("<f4")[place], np.cumsum(sizes)[:-1])):
            yield span, ("grams", unit, pack(piece))

    def score(rows: Iterator[tuple]) -> Iterator[tuple]:
        span, kinds = grouped(rows)
        if span is None:
            return
        group = read_texts(kinds.pop("texts"))
        strings = [string_of(t) for t in group["text"]]
        logs = {unit: unpack(data, "<f4") for unit, data in kinds.pop("grams")}
        scores = summed_logs(Span(strings, depth), units[0], depth - tops[0], logs)
        del logs
        more = []
        if words:
            at, different, sizes = words_of(strings)
            messages = kinds["words"]
            counts = np.concatenate([np.zeros(0, np.int64), *[unpack(c, "<i8") for _, c in messages]])
            known = pc.index_in(different, pa.concat_arrays([words_in(loose(w)) for w, _ in messages])).to_numpy() if messages else at
            more = [counts[known][at], sizes]
        frame = rows_of(group, scores, *more)
        yield from zip(*[frame[name].tolist() for name in columns.names])

    answers = passed[0].mapPartitions(answer).partitionBy(spans, own)
    made = held.union(answers).mapPartitions(score)
    return spark.createDataFrame(made, columns, verifySchema=False), totals


def text_logs(texts: DataFrame, string_of: Callable, rows_of: Callable, schema: str, depth: int, size: int = BLOCK) -> DataFrame:
    """Rows of ``schema`` by ``rows_of`` (texts of a span, log10 probabilities of each).

    ``texts``: id, text and ``held_out``. ``string_of`` gives a text's byte string, that ends with an end.
    """
    return scored(texts, string_of, rows_of, schema, depth, size, words=False)[0]
