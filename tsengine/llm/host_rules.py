"""Quality rules with a verdict per host.

Every document is measured inside its row, by JVM functions. Rule failures are
added up by host, the failure rates are shrunk towards a beta prior that is fitted
to all hosts, and the hosts' verdicts are joined back to the documents.

Defined results: NULL or empty text has no words and fails ``short``; a NULL host
is a host of its own; repeated rows are measured and counted one by one; an empty
table gives an empty result; columns beyond those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tsengine.llm.common import join_checked, settle, split_words

#: Rules that decide on a document alone, and the others.
BASE_RULES = ("short", "repeats")
RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules. A document of a host that is bad for a rule goes, and one that fails a rule itself."""

    min_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 20
    dup_line_percent: int = 50
    word_chars: tuple[int, int] = (2, 20)
    host_rate: float = 0.75


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts the rules look at; ``text`` goes.

    Repeated words are those inside any three-word window that occurs twice: window
    hashes are sorted with their positions, equal neighbours are repeats, and the
    words their windows cover are counted from the sorted positions.
    """
    kept = [c for c in docs.columns if c != text]
    counts = docs.select(
        *kept,
        split_words(F.col(text)).alias("_w"),
        F.expr(rf"filter(split(`{text}`, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("_lines"),
        F.coalesce(
            F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")), F.lit(0)
        ).cast("long").alias("n_symbols"),
    )
    counts = counts.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.expr(
            "CASE WHEN size(_w) >= 3 THEN transform(sequence(0, size(_w) - 3),"
            " i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE CAST(array() AS array<bigint>) END"
        ).alias("_tri"),
    )
    counts = counts.withColumn(
        "_order",
        F.expr(
            "CASE WHEN size(array_distinct(_tri)) < size(_tri)"
            " THEN sort_array(transform(_tri, (h, i) -> struct(h AS h, i AS i)))"
            " ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END"
        ),
    ).drop("_tri")
    starts = (
        "sort_array(transform(filter(_order, (x, i) -> x.h = get(_order, i - 1).h OR x.h = get(_order, i + 1).h), x -> x.i))"
    )
    counts = counts.withColumn("_starts", F.expr(starts)).drop("_order")
    covered = (
        "aggregate(transform(_starts, (s, i) -> least(3, coalesce(get(_starts, i + 1) - s, 3))), 0L, (a, x) -> a + x)"
    )
    return counts.withColumn("n_repeat_words", F.expr(covered)).drop("_starts")


def failures(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds ``fails_<rule>`` booleans."""
    few, many = limits.word_chars
    n = F.col("n_words")
    return counts.withColumns(
        {
            "fails_short": n < limits.min_words,
            "fails_repeats": 100 * F.col("n_repeat_words") > limits.repeat_percent * n,
            "fails_symbols": 100 * F.col("n_symbols") > limits.symbol_percent * n,
            "fails_dup_lines": 100 * F.col("n_dup_lines") > limits.dup_line_percent * F.col("n_lines"),
            "fails_word_length": (F.col("word_chars") < few * n) | (F.col("word_chars") > many * n),
        }
    )


def host_counts(flagged: DataFrame, host: str) -> DataFrame:
    """Documents and failures by host."""
    sums = [F.sum(F.col(f"fails_{r}").cast("long")).alias(f"k_{r}") for r in RULES]
    return flagged.groupBy(host).agg(F.count("*").alias("n"), *sums)


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(alpha, beta) by rule, from the mean and the spread of all hosts' rates.

    With p the overall rate, H hosts and N documents, the size-weighted variance of
    the rates is p (1 - p) (r + (1 - r) H / N) for hosts whose true rates have the
    intra-class correlation r; alpha + beta is 1 / r - 1.
    """
    total = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), *[F.sum(f"k_{r}").alias(r) for r in RULES]).first()
    if not total["n"]:
        return {r: (0.5, 0.5) for r in RULES}
    mean = {r: total[r] / total["n"] for r in RULES}
    spread = hosts.agg(*[F.sum(F.col("n") * (F.col(f"k_{r}") / F.col("n") - mean[r]) ** 2).alias(r) for r in RULES]).first()
    priors, thin = {}, total["h"] / total["n"]
    for r in RULES:
        p = min(max(mean[r], 1e-6), 1 - 1e-6)
        share = spread[r] / total["n"] / (p * (1 - p))
        tie = min(max((share - thin) / (1 - thin), 1e-4), 0.999) if thin < 1 else 0.5
        priors[r] = (p * (1 / tie - 1), (1 - p) * (1 / tie - 1))
    return priors


def host_verdicts(hosts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds shrunk ``rate_<rule>`` and ``host_ok``."""
    priors = beta_priors(hosts)
    rates = {f"rate_{r}": (F.col(f"k_{r}") + a) / (F.col("n") + a + b) for r, (a, b) in priors.items()}
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    return hosts.withColumns(rates).withColumn("host_ok", worst <= limits.host_rate)


def judge(docs: DataFrame, host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Counts, ``base_failed``, the host's rates and ``kept`` for each row.

    ``kept``: no rule fails, and no rule's shrunk failure rate at the host is above
    ``host_rate``.
    """
    flagged = settle(failures(measure(docs, text), limits), "host-rules")
    hosts = settle(host_verdicts(host_counts(flagged, host), limits), "hosts")
    joined = join_checked(flagged, hosts.select(host, "host_ok", *[f"rate_{r}" for r in RULES]), [host])
    fails = [F.col(f"fails_{r}") for r in RULES]
    base = F.col("fails_short") | F.col("fails_repeats")
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.greatest(*fails) & F.col("host_ok"))
