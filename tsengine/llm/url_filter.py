"""URL filter: exact membership in lists of keys by cascades of Bloom filters, without joins.

A list has two kinds of keys, each with a verdict: rules (host and beginning of the path,
such as ``example.com/en/``) and words of a host's name (such as ``casino``). The keys a
page may meet are what its url can be cut into by the shapes that rules have: so many
labels of the host, so many characters of the path. All pages together give the universe.

Level 1 of a cascade encodes the listed keys; level 2 those keys of the universe that
level 1 takes for listed; level 3 the listed keys that level 2 takes for such, and so on
until a level has no false positive left. A key of the universe is listed if the last of
the levels that it passes without a gap is an odd one: that is exact, not probable.
Level 1 is as wide as the universe asks for, so that its false positives are fewer than
the listed keys: the cascade grows with the list, not with the pages.

Keys are dealt into shards by hash; a shard's whole cascade is built in one task, and
shards are broadcast in passes of at most ``Spec.pass_bytes``. A list that needs more than
one pass costs one more scan of the pages' urls for each.

Defined results: a NULL url or one without ``://`` has an empty host and path. The longest
fitting rule decides, by code points; of equally long ones that with the longer host; a
rule listed with both verdicts blocks. Where no rule fits, a listed word of the host
decides (block before allow), else the page is allowed. A rule without a host fits empty
hosts only. Rows with equal or NULL ids are judged one by one. An empty list allows
everything, and an empty table has no rows. Other columns of the pages are not looked at.
"""

from __future__ import annotations

import math
import pickle
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from tsengine.llm.common import lower_ascii, settle

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The rules in force, and words of hosts that are not to be crawled.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
HOST_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam")
VERDICTS = ("block", "allow")
# Host and path of a url: after the first "://".
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Spec:
    """Listed keys to a shard, and bytes of filters that one pass may broadcast."""

    shard_keys: int = 100_000
    pass_bytes: int = 64 << 20


# --- filters -------------------------------------------------------------------------


def digests(keys: list[str]) -> np.ndarray:
    """Two 64-bit hashes of every key."""
    raw = b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys)
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


@dataclass
class Level:
    """A Bloom filter; ``depth`` gives every level hash functions of its own."""

    depth: int
    probes: int
    size: int
    bits: np.ndarray

    @classmethod
    def of(cls, depth: int, hashes: np.ndarray, rate: float) -> Level:
        size = max(64, math.ceil(len(hashes) * -math.log2(rate) / math.log(2)))
        level = cls(depth, max(1, round(-math.log2(rate))), size, np.zeros(-(-size // 8), np.uint8))
        for place in level.places(hashes):
            np.bitwise_or.at(level.bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        return level

    def places(self, hashes: np.ndarray):
        # Odd multipliers of 64-bit mixing.
        start = (hashes[:, 0] ^ np.uint64(self.depth * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        start ^= start >> np.uint64(31)
        step = hashes[:, 1] | np.uint64(1)
        for i in range(self.probes):
            mixed = (start + np.uint64(i) * step) * np.uint64(0x94D049BB133111EB)
            yield (mixed ^ (mixed >> np.uint64(32))) % np.uint64(self.size)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self.places(hashes):
            found &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


#: More levels than halving any set takes: two keys with one 128-bit hash.
MOST_LEVELS = 200


def cascade(listed: np.ndarray, others: np.ndarray, first: Level) -> list[Level]:
    """Levels that tell the listed keys from the others; ``others`` are level 1's false positives."""
    levels = [first]
    inside, outside = listed, others[first.holds(others)] if len(others) else others
    while len(outside):
        level = Level.of(len(levels) + 1, outside, 0.5)
        levels.append(level)
        if len(levels) > MOST_LEVELS:
            raise ValueError("a listed key and another one have the same hash")
        inside, outside = outside, inside[level.holds(inside)]
    return levels


def member(levels: list[Level], hashes: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed."""
    passed = np.zeros(len(hashes), np.int64)
    going = np.arange(len(hashes))
    for level in levels:
        going = going[level.holds(hashes[going])]
        passed[going] += 1
    return passed % 2 == 1


# --- keys of a url -------------------------------------------------------------------


def labels(host: str) -> int:
    return host.count(".") + 1 if host else 0


def last_labels(host: str, count: int) -> str | None:
    """The last ``count`` labels of a host, or nothing where it has fewer."""
    if count == 0:
        return "" if not host else None
    parts = host.rsplit(".", count)
    if len(parts) > count:
        return host[len(parts[0]) + 1 :]
    return host if host and len(parts) == count else None


def split_rule(key: str) -> tuple[str, str]:
    at = key.index("/")
    return key[:at], key[at:]


def rule_keys(host: str, path: str, shapes: list[tuple[int, int]]) -> list[str]:
    """The rules that would fit, among those of the shapes that a list has."""
    made = []
    for count, length in shapes:
        end = last_labels(host, count) if length <= len(path) else None
        if end is not None:
            made.append(end + path[:length])
    return made


def host_words(host: str) -> list[str]:
    return list(dict.fromkeys(w for w in host.replace("-", ".").split(".") if w))


def _batch_keys(rows: pd.DataFrame, shapes: list[tuple[int, int]]):
    """Distinct keys of a batch, and for each row the numbers of its own."""
    number: dict[str, int] = {}
    own = []
    for host, path in zip(rows["host"], rows["path"]):
        keys = rule_keys(host, path, shapes) + host_words(host)
        own.append([number.setdefault(k, len(number)) for k in keys])
    return list(number), own


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    part = [F.coalesce(F.regexp_extract("url", URL, i), F.lit("")) for i in (1, 2)]
    return pages.select("page_id", lower_ascii(part[0]).alias("host"), part[1].alias("path"))


# --- building ------------------------------------------------------------------------


@dataclass
class Plan:
    """What building a list's cascades needs to know: shards, rates of the first level, shapes of rules."""

    shards: int
    rates: dict[str, float]
    shapes: list[tuple[int, int]]

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes[:, 1] >> np.uint64(20)) % np.uint64(self.shards)


def distinct_keys(listed: DataFrame) -> DataFrame:
    """key, verdict: hosts of rules in lower case, one verdict a key, empty and NULL keys left out."""
    host = F.substring_index("key", "/", 1)
    key = F.concat(lower_ascii(host), F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"))
    made = listed.where("key is not null and key <> ''").select(key.alias("key"), "verdict")
    return made.groupBy("key").agg(F.max("verdict").alias("verdict"))


def shapes_of(listed: DataFrame) -> list[tuple[int, int]]:
    """Distinct pairs of labels and path length among the rules; no more than urls have lengths."""
    host = F.substring_index("key", "/", 1)
    count = F.when(host == "", 0).otherwise(F.length(host) - F.length(F.translate(host, ".", "")) + 1)
    rules = listed.where(F.instr("key", "/") > 0)
    rows = rules.select(count.alias("labels"), (F.length("key") - F.length(host)).alias("length")).distinct().collect()
    return sorted((int(r["labels"]), int(r["length"])) for r in rows)


def plan_for(pages: DataFrame, listed: DataFrame, spec: Spec) -> Plan:
    shapes = shapes_of(listed)
    sizes = {r["verdict"]: r["count"] for r in listed.groupBy("verdict").count().collect()}

    def hashes(batches):
        for rows in batches:
            keys, _ = _batch_keys(rows, shapes)
            if keys:
                yield pd.DataFrame({"key": digests(keys)[:, 0].astype(np.int64)})

    universe = parsed(pages).mapInPandas(hashes, "key long").agg(F.approx_count_distinct("key")).first()[0]
    rates = {v: min(0.5, math.sqrt(0.5) * n / max(universe, 1)) for v, n in sizes.items()}
    return Plan(max(1, math.ceil(sum(sizes.values()) / spec.shard_keys)), rates, shapes)


CASCADE = "shard long, verdict string, levels binary"


def _pack(levels: list[Level]) -> bytes:
    return pickle.dumps([(v.depth, v.probes, v.size, v.bits.tobytes()) for v in levels])


def _unpack(blob: bytes) -> list[Level]:
    return [Level(*head, np.frombuffer(bits, np.uint8)) for *head, bits in pickle.loads(blob)]


def sharded(keys: DataFrame, plan: Plan) -> DataFrame:
    """Adds the shard of each key."""

    def add(batches):
        for rows in filter(len, batches):
            rows["shard"] = plan.shard(digests(list(rows["key"]))).astype(np.int64)
            yield rows

    return keys.mapInPandas(add, "key string, verdict string, listed boolean, shard long")


def first_levels(listed: DataFrame, plan: Plan) -> DataFrame:
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        level = Level.of(1, digests(list(rows["key"])), plan.rates[key[1]])
        return pd.DataFrame([(key[0], key[1], _pack([level]))], columns=["shard", "verdict", "levels"])

    return listed.groupBy("shard", "verdict").applyInPandas(build, CASCADE)


def full_levels(listed: DataFrame, others: DataFrame, plan: Plan) -> DataFrame:
    """Whole cascades, from the listed keys and those that level 1 mistakes for them."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        inside, outside = (digests(list(rows["key"][rows["listed"] == flag])) for flag in (True, False))
        levels = cascade(inside, outside, Level.of(1, inside, plan.rates[key[1]]))
        return pd.DataFrame([(key[0], key[1], _pack(levels))], columns=["shard", "verdict", "levels"])

    return listed.unionByName(others).groupBy("shard", "verdict").applyInPandas(build, CASCADE)


class Filters:
    """The cascades of some shards, opened in a task."""

    def __init__(self, blobs: dict[tuple[int, str], bytes], plan: Plan):
        self.plan, self.levels = plan, {at: _unpack(blob) for at, blob in blobs.items()}

    def listed(self, keys: list[str], verdict: str) -> np.ndarray:
        """Which keys pass: exactly the listed ones, once the cascades are whole."""
        hashes = digests(keys)
        found = np.zeros(len(keys), bool)
        if keys:
            shard = self.plan.shard(hashes).astype(np.int64)
            for number in np.unique(shard):
                levels = self.levels.get((int(number), verdict))
                if levels:
                    here = np.flatnonzero(shard == number)
                    found[here] = member(levels, hashes[here])
        return found


def _shared(cascades: DataFrame):
    """Broadcasts the cascades of a pass; their size is bounded by ``Spec.pass_bytes``."""
    blobs = {(r["shard"], r["verdict"]): bytes(r["levels"]) for r in cascades.collect()}
    return cascades.sparkSession.sparkContext.broadcast(blobs)


def _mistaken(shared, plan: Plan):
    def scan(batches):
        filters = Filters(shared.value, plan)
        for rows in batches:
            keys, _ = _batch_keys(rows, plan.shapes)
            for verdict in VERDICTS:
                found = np.flatnonzero(filters.listed(keys, verdict))
                if len(found):
                    yield pd.DataFrame({"key": [keys[i] for i in found], "verdict": verdict, "listed": False})

    return scan


# --- judging -------------------------------------------------------------------------

JUDGED = "page_id long, host string, path string, rule string, rule_verdict string, word_verdict string"


def _judge(shared, plan: Plan):
    def better(a, b):
        """Of two rules with their verdicts: the longer, then that of the longer host, then the blocking one."""
        return max(a, b, key=lambda r: (len(r[0]), len(split_rule(r[0])[0]), r[1] == "block"))

    def judge(batches):
        filters = Filters(shared.value, plan)
        for rows in filter(len, batches):
            keys, own = _batch_keys(rows, plan.shapes)
            found = {v: filters.listed(keys, v) for v in VERDICTS}
            rules, words = [], []
            for mine, rule, verdict, word in zip(own, rows["rule"], rows["rule_verdict"], rows["word_verdict"]):
                best = (rule, verdict) if isinstance(rule, str) else None
                for i in mine:
                    for v in VERDICTS:
                        if not found[v][i]:
                            continue
                        if "/" in keys[i]:
                            best = (keys[i], v) if best is None else better(best, (keys[i], v))
                        elif word != "block":
                            word = v
                rules.append(best or (None, None))
                words.append(word)
            rows["rule"], rows["rule_verdict"] = [r for r, _ in rules], [v for _, v in rules]
            rows["word_verdict"] = words
            yield rows

    return judge


def default_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*RULES, *((w, "block") for w in HOST_WORDS)], "key string, verdict string")


def verdicts(pages: DataFrame, listed: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, by a list of ``key, verdict``."""
    listed = settle(distinct_keys(listed), "url-list")
    plan = plan_for(pages, listed, spec)
    urls = parsed(pages)
    state = urls.select("*", *[F.lit(None).cast("string").alias(c) for c in ("rule", "rule_verdict", "word_verdict")])
    if plan.rates:
        listed = settle(sharded(listed.withColumn("listed", F.lit(True)), plan), "url-list-sharded")
        # A key takes its share of level 1 and, in all later levels, less than eight bits.
        width = spec.shard_keys * (8 + 1.45 * max(-math.log2(r) for r in plan.rates.values())) / 8
        at_once = max(1, int(spec.pass_bytes // width))
        for start in range(0, plan.shards, at_once):
            some = listed.where(F.col("shard").between(start, start + at_once - 1))
            first = _shared(first_levels(some, plan))
            passing = urls.mapInPandas(_mistaken(first, plan), "key string, verdict string, listed boolean").distinct()
            mistaken = passing.join(some.select("key", "verdict"), ["key", "verdict"], "left_anti").select("key", "verdict", "listed")
            others = settle(sharded(mistaken, plan), "url-mistaken")
            state = state.mapInPandas(_judge(_shared(full_levels(some, others, plan)), plan), JUDGED)
            if start + at_once < plan.shards:
                state = settle(state, "url-judged")
    return state.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "word_verdict", F.lit("allow")).alias("verdict"))
