"""Packing, main texts and archives."""

import gzip
import hashlib
import random
import uuid

import numpy as np
import pytest
from helpers import awkward, clashing, docs, frame

from tsengine.llm import packing, warc, wrappers
from tsengine.session import scratch_path

PAGES = "page_id long, url string, html string"


def scan_best_fit(sizes, length):
    """Best-fit-decreasing by looking at every row."""
    rows, room = [], []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, k) for k, r in enumerate(room) if r >= sizes[item]]
        if fits:
            least = min(r for r, _ in fits)
            k = [k for r, k in fits if r == least][-1]
            room[k] -= sizes[item]
            rows[k].append(item)
        else:
            rows.append([item])
            room.append(length - sizes[item])
    return rows, room


@pytest.mark.parametrize("seed", range(4))
def test_best_fit(seed):
    draw = random.Random(seed)
    length = draw.choice([7, 64, 100])
    sizes = [draw.randrange(1, length + 1) for _ in range(400)]
    rows = packing.best_fit(sizes, length)
    assert sorted(i for r in rows for i in r) == list(range(400))
    left = sorted(length - sum(sizes[i] for i in r) for r in rows)
    assert left == sorted(scan_best_fit(sizes, length)[1]) and min(left) >= 0


@pytest.mark.parametrize("spec", [packing.Spec(length=64, slab=500), packing.Spec(length=2048), packing.Spec(length=100, group=300)])
def test_packing_is_lossless(spark, spec):
    texts = awkward() + [f"text number {i} " * (i % 9) for i in range(60)]
    packed = packing.pack(clashing(docs(spark, texts), "sequence", "pieces"), spec)
    rows = packed.collect()
    assert len({r["sequence"] for r in rows}) == len(rows)
    parts = {}
    for r in rows:
        ids, places = np.frombuffer(r["input_ids"], spec.ids()), np.frombuffer(r["position_ids"], spec.positions())
        ends = r["cu_seqlens"]
        assert len(ids) == len(places) == spec.length and ends[0] == 0 and ends[-1] == r["n_tokens"] <= spec.length
        assert (ids[r["n_tokens"] :] == spec.end).all()
        for a, b, doc, piece in zip(ends, ends[1:], r["doc_ids"], r["pieces"]):
            assert places[a:b].tolist() == list(range(b - a)) and (doc, piece) not in parts
            parts[doc, piece] = ids[a:b].tolist()
    encoding = packing.load_encoding(spec)
    for i, text in enumerate(texts):
        ids = [t for piece in range(sum(d == i for d, _ in parts)) for t in parts[i, piece]]
        assert ids[-1] == spec.end and encoding.decode(ids[:-1]) == (text or "") and ids[:-1] == encoding.encode_ordinary(text or "")
    again = {(r["doc_id"], r["piece"]): np.frombuffer(r["ids"], spec.ids()).tolist() for r in packing.segments(packed, spec).collect()}
    assert again == parts


def test_packing_of_nulls_and_files(spark):
    rows = [(None, None, None, None, None), (4, "same text", "en", "s", 0), (4, "same text", "en", "s", 0)]
    packed = packing.pack(frame(spark, rows), packing.Spec(length=32))
    path = scratch_path(spark, "matrices")
    packing.write_matrices(packed, path)
    read = packing.segments(packing.read_matrices(spark, path), packing.Spec(length=32)).collect()
    assert sorted(str(r["doc_id"]) for r in read) == ["4", "4", "None"]
    assert packing.pack(frame(spark, [])).count() == 0


def page(title, body, extra="", side="", comments=""):
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p > a {{}}</style><script>if (1 < 2) document.write('<p>no</p>')</script></head>"
        f"<body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a><li><a href='/x'>More</a></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div>{extra}<article><h1>{title}</h1>{body}</article>"
        f"<aside>{side}</aside><section class=comments>{comments}</section><form><p>Search</p></form><footer>&copy; Site</footer></body></html>"
    )


def test_main_text_of_one_page():
    html = page("A &amp; B", "<p>One <b>t</b>wo<br>three<p>four\n\n &lt;five&gt;&nbsp;six<ul><li>x<li>y</ul><!-- <p>no</p> -->", comments="<p>me too</p>")
    assert wrappers.main_text(html, None) == "A & B One two three four <five> six x y"
    assert wrappers.main_text(None, None) == wrappers.main_text("", None) == ""
    assert wrappers.main_text("a < b & c", None) == "a < b & c"
    assert wrappers.main_text("<div>" * 3000 + "deep" + "</div>" * 3000, None) == "deep"
    assert wrappers.main_text("<article><p>cut off <b>here", None) == "cut off here"


def test_alignment():
    make = lambda *labels: [wrappers.Node(x, 1, False, 0, 0, 0, []) for x in labels]
    show = lambda nodes, pages=2: wrappers.Node("r", pages, False, 0, 0, 0, nodes).render()
    assert show(wrappers.fold_repeats(make("h", "p", "p", "p")), 1) == "r[h p+]"
    assert show(wrappers.fold_repeats(make("h", "p", "h", "p", "f")), 1) == "r[(h p)+ f]"
    assert show(wrappers.align(make("a", "b", "c"), make("a", "c"))) == "r[a b? c]"
    assert show(wrappers.align(make("a", "c"), make("a", "b", "d", "c"))) == "r[a b? d? c]"
    a, b = (wrappers.tree_of(wrappers.parse(f"<body><p>{t}</p><div>same</div></body>")) for t in ("x", "y"))
    assert wrappers.combine(a, b).render() == "page[body[p[#] div]]"


def test_wrappers_by_host(spark):
    draw = random.Random(1)
    prose = lambda n: " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(99)}" for _ in range(n))
    rows, wanted = [], {}
    for i in range(120):
        paragraphs = [prose(draw.randrange(4, 40)) for _ in range(draw.randrange(1, 6))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        if i % 3:  # nothing in the names says which part is the article
            promo = f"<table><tr><td>{prose(3)}</td></tr></table>" if i % 4 == 0 else ""
            html = f"<div id=top><a href=/>Home</a> <a href=/b>Other</a></div>{promo}<div class=x{i}><h2>{prose(4)}</h2>{body}<p class=mail>Mail this page</p></div><div class=end>All rights</div>"
            wanted[i] = [html.split("<h2>")[1].split("</h2>")[0], *paragraphs]
            rows.append((i, f"https://plain.example/{i}", html))
        else:
            rows.append((i, f"http://Named.example:80/{i}", page("T", body, f"<div class=ad>{prose(5)}</div>", prose(9), prose(30))))
            wanted[i] = ["T", *paragraphs]
    rows += [(200, None, page("N", "<p>x y</p>")), (201, "", None), (202, "https://plain.example/odd", "<article>other form</article>"), (None, None, "")]
    made = {r["page_id"]: r for r in wrappers.main_texts(clashing(frame(spark, rows, PAGES), "host", "rules")).collect()}
    assert {i: made[i]["text"] for i in wanted} == {i: " ".join(p) for i, p in wanted.items()}
    assert made[200]["text"] == "N x y" and made[201]["text"] == made[None]["text"] == "" and made[202]["text"] == "other form"
    assert all(r["n_chars"] == len(r["text"]) for r in made.values())
    assert wrappers.main_texts(frame(spark, [], PAGES)).count() == 0


def test_copies_of_a_page_keep_what_other_pages_lack(spark):
    draw = random.Random(4)
    prose = lambda n: " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(99)}" for _ in range(n))
    own = "<h2>Summary</h2><p class=intro>Only here</p><blockquote class=q>Said once</blockquote><pre class=c>x = 1</pre>"
    copied = page("T", f"{own}<p>{prose(20)}</p>")
    rows = [(i, "http://copies.example/a", copied) for i in range(12)]
    texts = [prose(20) for _ in range(20)]
    rows += [(100 + i, "http://copies.example/b", page("T", f"<h3>Ingredients</h3><p>{t}</p><p class=mail>Mail this page</p>")) for i, t in enumerate(texts)]
    links = "<div class=more><a href=/a>One long link</a> <a href=/b>and another</a></div>"
    notes = "<div class=more>The note of this page</div>"
    rows += [(200 + i, "http://lists.example/a", page("T", f"<p>{t}</p>{links if i else notes}")) for i, t in enumerate(texts)]
    made = {r["page_id"]: r["text"] for r in wrappers.main_texts(frame(spark, rows, PAGES)).collect()}
    for i in range(12):
        assert made[i].startswith("T Summary Only here Said once x = 1 ")
    assert all(made[100 + i] == f"T Ingredients {t}" for i, t in enumerate(texts))
    assert made[200] == f"T {texts[0]} The note of this page" and all(made[200 + i] == f"T {t}" for i, t in enumerate(texts) if i)


@pytest.mark.parametrize(
    "around", ["<div class='has-sidebar'>", "<div class='content-no-comments'>", "<div class='header-fixed banner-off'>", "<form id='aspnetForm'>", "<div class=search-result-page><div class=ad-free>"]
)
@pytest.mark.parametrize("inner", ["<article>", "<main>", "<div class=story>", "<div class=x>"])
def test_layout_around_an_article_does_not_bar_it(around, inner):
    top = "<nav><a href=/>Home</a> menu</nav><div class=cookie-notice>We use cookies</div>"
    comments = "<div class=comments><p>me too, and so on</p></div>"
    body = f"<h1>Title</h1><p>{'some words of the text ' * 30}</p>"
    plain = f"<html><body>{top}{around}{inner}{body}{comments}</div></body></html>"
    assert wrappers.main_text(plain, None) == f"Title {'some words of the text ' * 30}".strip()
    if inner not in ("<article>", "<main>"):
        return
    body = f"<h1>Title</h1><div class=no-sidebar><p>{'some words of the text ' * 30}</p></div>"
    html = f"<html><body>{top}{around}{inner}{body}{comments}</div></body></html>"
    wanted = f"Title {'some words of the text ' * 30}".strip()
    assert wrappers.main_text(html, None) == wanted
    # Comments that outgrow a free article are none of it.
    long = f"<section id=comments><article class=comment><div class=text><p>{'me too ' * 400}</p></div></article></section>"
    assert wrappers.main_text(f"<html><body>{top}<article>{body}</article>{long}</body></html>", None) == wanted
    # A bar at a short article beside longer parts.
    side = f"<div class=x>{'beside it ' * 100}</div>"
    assert wanted in wrappers.main_text(f"<html><body>{around}<article>{body}</article>{'</div>' * 2}</form>{side}</body></html>", None)


@pytest.mark.parametrize(
    "part, text",
    [
        ("<h2>References</h2><ul><li><a href=/1>First title</a></li><li><a href=/2>Second title</a></li></ul>", "References First title Second title"),
        ("<div><a href=/1>One study</a> and <a href=/2>another</a></div>", "One study and another"),
        ("<ol class=footnotes><li><a href=/1>Source</a></li></ol>", "Source"),
        ("<p class=teaser>The lead paragraph</p>", "The lead paragraph"),
        ("<div class=legal>What the law says</div>", "What the law says"),
        ("<div class=more-links><a href=/1>Read on</a> <a href=/2>and on</a></div>", ""),
        ("<div class=newsletter>Sign up now</div><div class=related-posts><a href=/x>Other</a></div>", ""),
    ],
)
def test_article_keeps_its_own_parts(spark, part, text):
    draw = random.Random(9)
    prose = [" ".join(f"w{draw.randrange(99)}" for _ in range(25)) for _ in range(12)]
    rows = [(i, "http://own.example/a", page("T", f"<p>{t}</p>{part if i in (1, 3) else ''}")) for i, t in enumerate(prose)]
    made = {r["page_id"]: r["text"] for r in wrappers.main_texts(frame(spark, rows, PAGES)).collect()}
    assert made == {i: " ".join(["T", t, text if i in (1, 3) else ""]).strip() for i, t in enumerate(prose)}


def test_alignment_is_a_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(200):
        xs, ys = (["".join(draw.choice("abcd")) for _ in range(draw.randrange(9))] for _ in range(2))
        table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        make = lambda labels, mark: [wrappers.Node(x, 1, False, 0, 0, 0, [], (mark, k)) for k, x in enumerate(labels)]
        before, wrappers.fold_repeats = wrappers.fold_repeats, list
        try:
            made = wrappers.align(make(xs, 1), make(ys, 2))
        finally:
            wrappers.fold_repeats = before
        assert sum(n.pages == 2 for n in made) == table[-1][-1] and len(made) == len(xs) + len(ys) - table[-1][-1]


def revisits(pages, least=1000):
    last = {}
    for page_id, _, html in pages:
        data = (html or "").encode()
        if len(data) >= least and (data not in last or last[data] is None or (page_id or -1) > last[data]):
            last[data] = page_id
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        again = len(data) >= least and page_id != last[data]
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[data] if again else None))
    return out


def test_archive(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" + "x" * 1500
    pages = [(i, f"http://a/{i}", t) for i, t in enumerate([long, long, "short", "short", None, "", "y" * 1000, "y" * 1000, "y" * 999, "y" * 999])]
    pages += [(50, "http://a/ b\r\nX: y", long), (None, None, long), (6, "http://a/6", "y" * 1000)]
    pages += [(100 + i, "u", long) for i in range(40)]
    records = warc.resolve_revisits(warc.headers(clashing(frame(spark, pages, PAGES), "payload", "refers_to")))
    path = scratch_path(spark, f"archive-{uuid.uuid4().hex}")
    warc.write_archive(records, path, date="2024-01-02T03:04:05Z")
    read = warc.read_archive(spark, path).collect()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[n] for n in names) for r in read), key=str) == sorted(revisits(pages), key=str)
    htmls = {p[0]: (p[2] or "").encode() for p in pages}
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in read)
    assert all(bytes(r["payload"]) == htmls[r["page_id"]] for r in read if r["payload"] is not None)
    assert {r["url"] for r in read if r["page_id"] == 50} == {"http://a/bX:y"}


def test_records_and_empty_archives(spark):
    rows = frame(spark, [(1, "http://a", "text")], PAGES)
    path = scratch_path(spark, "one")
    warc.write_archive(warc.resolve_revisits(warc.headers(rows)), path)
    files = spark.read.format("binaryFile").load(path + "/*.gz").collect()
    data = b"".join(gzip.decompress(bytes(r["content"])) for r in files)
    ((fields, block),) = warc.parse_records(data)
    assert fields["WARC-Type"] == "response" and int(fields["Content-Length"]) == len(block) and block.endswith(b"\r\n\r\ntext")
    with pytest.raises(ValueError):
        list(warc.parse_records(data.replace(b"text", b"texts")))
    path = scratch_path(spark, "none")
    warc.write_archive(warc.resolve_revisits(warc.headers(frame(spark, [], PAGES))), path)
    assert warc.read_archive(spark, path).count() == 0


def test_archives_hold_as_many_records_as_fit(spark, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (100, 1_000))
    monkeypatch.setattr(warc, "FILE_BYTES", 2_000)
    pages = [(i, f"http://a/{i}", f"{i:04}" + "x" * size) for i, size in enumerate([10] * 50 + [500] * 9 + [5_000] * 3 + [96, 97, 996, 997])]
    path = scratch_path(spark, "rolled")
    warc.write_archive(warc.resolve_revisits(warc.headers(frame(spark, pages, PAGES).coalesce(1))), path)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path + "/*.gz").collect()]
    sizes = [sum(int(fields["X-Payload-Length"]) for fields, _ in warc.parse_records(gzip.decompress(f))) for f in files]
    assert len(files) == 3 + 6 + 4 and all(size <= 2_000 or size >= 5_000 for size in sizes)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.read_archive(spark, path).collect()) == [(i, len(t)) for i, _, t in pages]
