"""The URL filter next to a plain look-up of all rules."""

import random
import re

import numpy as np
import pytest
from helpers import clashing

from tsengine.llm import url_filter as uf

PAGES = "page_id long, url string, html string"


def plain(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for key, verdict in listed:
        if "/" in key:
            end, start = key[: key.index("/")], key[key.index("/") :]
            if (host == end or (end and host.endswith("." + end))) and path.startswith(start):
                fits.append((len(key), len(end), verdict == "block", key, verdict))
    if fits:
        return host, path, max(fits)[3], max(fits)[4]
    words = {v for k, v in listed if "/" not in k and k in re.split(r"[.\-]", host)}
    return host, path, None, "block" if "block" in words else "allow"


def check(spark, urls, listed, spec=uf.Spec(), extra=()):
    pages = clashing(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES).repartition(3), *extra)
    table = spark.createDataFrame(listed, "key string, verdict string")
    made = {r["page_id"]: tuple(r)[1:] for r in uf.verdicts(pages, table, spec).collect()}
    assert made == {i: plain(u, listed) for i, u in enumerate(urls)}
    return made


def test_rules_in_force(spark):
    listed = [*uf.RULES, *((w, "block") for w in uf.HOST_WORDS)]
    urls = [
        None, "", "no scheme", "://", "http://", "http:///en/", "http://COM/x", "http://x.com", "http://x.com/", "https://example.com/en/1",
        "https://example.com/en", "https://WWW.Example.com/en/1?x", "https://a.www.example.com/en/", "https://notexample.com/en/", "http://a.net/es/#t",
        "http://a.net/ES/", "http://a.net?/es/", "http://free-bets.example.org/", "http://bets.com/", "http://betsy.org/", "a://b://c/d", "http://u@h:80/p",
        "http://é.NET/fr/ü\n", "http://x.net/" + "fr/" * 50_000, "http://" + "a." * 20_000 + "net/fr/", "http://spam", "//spam/x",
    ]
    made = check(spark, urls * 2, listed, extra=["host", "path", "rule", "key", "verdict", "listed", "shard"])
    assert made[9][2:] == ("example.com/en/", "block") and made[11][2:] == ("www.example.com/en/", "allow") and made[16][2:] == (None, "allow")


def test_long_list_in_shards_and_passes(spark):
    """Thousands of listed keys among many more that are not; shards of 50 keys, a few to a pass."""
    draw = random.Random(3)

    def url():
        return "http://" + ".".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 5))) + "/" + "".join(draw.choice("ab/") for _ in range(draw.randrange(0, 6)))

    urls = [url() for _ in range(4_000)]
    keys = {u.split("://")[1] for u in urls[:500]} | {url().split("://")[1] for _ in range(300)}
    listed = [(k, draw.choice(uf.VERDICTS)) for k in sorted(keys)] + [("a", "block"), ("b", "allow"), ("zz", "allow")]
    check(spark, urls, listed, uf.Spec(shard_keys=50, pass_bytes=600))
    check(spark, urls, listed)


def test_repeated_and_tied_rules(spark):
    listed = [("a.com/", "allow"), ("A.com/", "block"), ("com/ab", "allow"), ("com/abc", "allow"), ("b.com/", "allow"), ("b.com/", "allow"), (None, "block"), ("", "block")]
    made = uf.verdicts(
        spark.createDataFrame([(1, "http://a.com/abc", None), (1, "http://b.com/ab", None), (None, "http://c.com/ab", None)], PAGES),
        spark.createDataFrame(listed, "key string, verdict string"),
    )
    rows = sorted(((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in made.collect()), key=lambda r: r[1])
    assert rows == [(1, "a.com", "com/abc", "allow"), (1, "b.com", "b.com/", "allow"), (None, "c.com", "com/ab", "allow")]


def test_nothing_listed_or_no_pages(spark):
    check(spark, ["http://a.com/x", None], [])
    pages = spark.createDataFrame([], PAGES)
    assert uf.verdicts(pages, uf.default_list(spark)).collect() == []


@pytest.mark.parametrize("listed, others", [(0, 0), (1, 0), (1, 10_000), (300, 20_000), (5_000, 5_000), (3_000, 10)])
def test_cascade_is_exact(listed, others):
    keys = uf.digests([f"k{i}" for i in range(listed + others)])
    inside, outside = keys[:listed], keys[listed:]
    rate = min(0.5, 0.71 * max(listed, 1) / max(others, 1))
    levels = uf.cascade(inside, outside, uf.Level.of(1, inside, rate))
    assert uf.member(levels, inside).all() and not uf.member(levels, outside).any()
    # It grows with the list: level 1 as its rate asks, then less than a byte a key.
    assert sum(len(v.bits) for v in levels[1:]) <= listed + 8 * len(levels)


def test_level_holds_what_it_encodes():
    keys = uf.digests([str(i) for i in range(20_000)])
    level = uf.Level.of(3, keys[:1_000], 0.01)
    assert level.holds(keys[:1_000]).all() and level.holds(keys[1_000:]).mean() < 0.02


def test_last_labels():
    for host, count, end in [("a.b.c", 1, "c"), ("a.b.c", 3, "a.b.c"), ("a.b.c", 4, None), ("", 0, ""), ("a", 0, None), ("", 1, None), (".b", 1, "b"), (".b", 2, ".b")]:
        assert uf.last_labels(host, count) == end, (host, count)
    assert np.array_equal(uf.digests([]), np.empty((0, 2)))
