"""Main text of web pages, by wrappers inferred for each host.

A page is a tree of block elements with text. The wrapper of a host is a union-free
regular expression over such trees: elements in order, each once, optional or
repeated (also groups of up to three), with text that is constant or a slot. It
begins as one page and is aligned with one page after the other: equal neighbours
become repeated groups, elements that only one side has become optional, texts that
differ become slots. Aligning works between wrappers as well, so that the pages of a
host are folded in many tasks, first by partition, then by bucket, then by host; no
host is one task's work and no page is left out.

What the wrapper knows of a slot (place, names, text that varies over pages, share of
links) decides which part is the article. These decisions are a short list of paths,
joined back to the pages by host. A text that recurs is the template's only next to
articles that differ, copies of a page count once; lists of links are left out page
by page, but inside an ``article`` only those with a name that doesn't tell of
references. Names such as ``sidebar``, and forms, bar what they stand on unless that is
the layout around the article; ``teaser``, ``legal`` and the like don't bar inside an
``article``, where they mark its lead or its notes.

Defined results: NULL and empty html give an empty text; pages without a host form a
host of their own; a page that holds none of its host's article paths is decided on
its own tree; repeated pages are extracted one by one; an empty table gives an empty
result; columns beyond ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
import sys
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tsengine.llm.common import join_checked, settle, small_batches

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that make a block, hold nothing, or are no part of an article by their kind; names that
# bar, those of them that don't inside an article, names of an article's lists of links.
BLOCKS = frozenset(
    "html head body main article section div p ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6"
    " header footer nav aside form fieldset blockquote pre figure figcaption address details summary dialog menu hgroup"
    " center button label".split()
)
CLOSES_P = BLOCKS - {"button", "label"}
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
BREAKS = frozenset("br hr img".split())
OUTSIDE = frozenset("head nav header footer aside form button dialog menu fieldset label".split())
OUTSIDE_NAMES = frozenset(
    "nav navbar navigation menu sidebar footer masthead banner cookie cookies consent gdpr notice notices alert ad ads advert"
    " adverts advertisement sponsor sponsored promo promotion comment comments disqus reply replies respond share sharing social"
    " related recommended recommendations breadcrumb breadcrumbs newsletter subscribe subscription signup login search widget"
    " popup modal overlay toolbar pagination pager copyright legal skip teaser".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
ARTICLE_NAMES = frozenset("teaser legal search skip copyright alert".split())
CITED_NAMES = frozenset("reference references ref refs reflist citation citations cite bibliography source sources footnote footnotes note notes".split())
INSIDE_NAMES = frozenset("article content story entry post body main text".split())
# Elements that hold an article's own words even where they recur, those that do so without a name, and lists.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 blockquote pre".split())
BODY_TEXT = frozenset("p li dt dd td th caption figcaption".split())
LISTS = frozenset("ul ol div section".split())
#: Digests of article texts that a node remembers. The root's are a sample of the host's different pages.
SEEN = 16

_TAG_REST = r"""(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)" + _TAG_REST + r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def label_of(tag: str, rest: str) -> str:
    """Element with class, id and role; numbers in them stand for any number."""
    if "=" not in rest:
        return tag
    found = {k.lower(): re.sub(r"\d+", "0", v.strip("\"'")) for k, v in _ATTRIBUTE.findall(rest)}
    name = tag
    if found.get("class", "").strip():
        name += "".join(f".{c}" for c in sorted(set(found["class"].split())))
    if found.get("id", "").strip():
        name += f"#{found['id'].strip()}"
    if found.get("role", "").strip():
        name += f"@{found['role'].strip().lower()}"
    return name


class Block:
    """An element of a page. ``parts``: texts, and child blocks in between; ``links``: characters inside links."""

    __slots__ = ("label", "tag", "parts", "links")

    def __init__(self, label: str, tag: str):
        self.label, self.tag, self.parts, self.links = label, tag, [], 0


def parse(page: str | None) -> Block:
    """Tree of the block elements; inline elements leave their text, line breaks a blank."""
    root = Block("page", "page")
    stack, anchors = [root], 0
    for token in _TOKEN.finditer(page or ""):
        text = token["text"]
        if text is not None:
            value = entities.unescape(text) if "&" in text else text
            stack[-1].parts.append(value)
            if anchors:
                stack[-1].links += len(value.strip())
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            anchors = 0 if token["end"] else 1
        if tag in BREAKS:
            stack[-1].parts.append(" ")
        if tag not in BLOCKS:
            continue
        if token["end"]:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == tag:
                    del stack[at:]
                    break
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if tag in SIBLINGS:
            scope = SCOPES.get(tag, ())
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in scope:
                    break
                if stack[at].tag in SIBLINGS[tag]:
                    del stack[at:]
                    break
        block = Block(label_of(tag, token["rest"] or ""), tag)
        stack[-1].parts.append(block)
        if len(stack) < 200:  # deeper blocks stay siblings, their text keeps its order
            stack.append(block)
    return root


class Node:
    """An element of a wrapper.

    ``pages``: that hold it; ``many``: repeated somewhere; ``chars`` and ``links``: its
    own text on all pages; ``constant``: checksum of its text while all agree, else -1
    (a slot), 0 without text; ``seen``: the smallest digests of the article texts it
    stands next to, copies of a page count once. A group has an empty label.
    """

    __slots__ = ("label", "pages", "many", "chars", "links", "constant", "children", "seen")

    def __init__(self, label, pages, many, chars, links, constant, children, seen=()):
        self.label, self.pages, self.many, self.chars = label, pages, many, chars
        self.links, self.constant, self.children, self.seen = links, constant, children, seen

    def key(self) -> str:
        return self.label or "(" + " ".join(c.key() for c in self.children) + ")"

    def dump(self) -> list:
        kids = [c.dump() for c in self.children]
        return [self.label, self.pages, int(self.many), self.chars, self.links, self.constant, kids, self.seen]

    @classmethod
    def load(cls, made: list) -> Node:
        return cls(*made[:2], bool(made[2]), *made[3:6], [cls.load(c) for c in made[6]], tuple(made[7]))

    def render(self) -> str:
        """The expression as text: ``?`` optional, ``+`` repeated, ``#`` a slot."""
        inner = [c.render() + ("+" if c.many else "") + ("?" if c.pages < self.pages else "") for c in self.children]
        inner = ["#"] * (self.constant == -1) + inner
        if not self.label:
            return f"({' '.join(inner)})"
        return f"{self.label}[{' '.join(inner)}]" if inner else self.label


def _constant(a: int, b: int) -> int:
    return a if a == b or not b else b if not a else -1


def combine(a: Node, b: Node, siblings: bool = False) -> Node:
    """Alignment of two wrappers of the same element; siblings lie on the same pages."""
    pages = max(a.pages, b.pages) if siblings else a.pages + b.pages
    made = Node(a.label, pages, a.many or b.many, a.chars + b.chars, a.links + b.links, 0, [])
    made.constant = _constant(a.constant, b.constant)
    made.seen = a.seen if a.seen == b.seen else tuple(sorted({*a.seen, *b.seen})[:SEEN])
    made.children = align(a.children, b.children, siblings)
    return made


def fold_repeats(nodes: list[Node]) -> list[Node]:
    """Equal neighbours, and equal groups of two or three, become one repeated element."""
    for size in (1, 2, 3):
        keys = [n.key() for n in nodes]
        out: list[Node] = []
        at = 0
        while at < len(nodes):
            unit = keys[at : at + size]
            run = 1
            while len(unit) == size and keys[at + run * size : at + (run + 1) * size] == unit:
                run += 1
            if run == 1 or (size > 1 and len(set(unit)) == 1):
                out.append(nodes[at])
                at += 1
                continue
            units = [nodes[at + k * size : at + (k + 1) * size] for k in range(run)]
            merged = units[0]
            for unit_nodes in units[1:]:
                merged = [combine(x, y, siblings=True) for x, y in zip(merged, unit_nodes)]
            if size == 1:
                merged[0].many = True
                out.append(merged[0])
            else:
                out.append(Node("", max(n.pages for n in merged), True, 0, 0, 0, merged, merged[0].seen))
            at += run * size
        nodes = out
    return nodes


def align(xs: list[Node], ys: list[Node], siblings: bool = False) -> list[Node]:
    """Longest common subsequence of the elements; what only one side has stays, and is optional by its pages."""
    kx, ky = [n.key() for n in xs], [n.key() for n in ys]
    if kx == ky:
        return [combine(x, y, siblings) for x, y in zip(xs, ys)]
    # What both begin and end with needs no table.
    same = next((i for i, (x, y) in enumerate(zip(kx, ky)) if x != y), min(len(kx), len(ky)))
    most = min(len(kx), len(ky)) - same
    tail = next((i for i in range(most) if kx[-1 - i] != ky[-1 - i]), most)
    first = [combine(x, y, siblings) for x, y in zip(xs[:same], ys[:same])]
    last = [combine(x, y, siblings) for x, y in zip(xs[len(xs) - tail :], ys[len(ys) - tail :])]
    xs, ys, kx, ky = (z[same : len(z) - tail] for z in (xs, ys, kx, ky))
    n, m = len(xs), len(ys)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if kx[i] == ky[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if kx[i] == ky[j]:
            out.append(combine(xs[i], ys[j], siblings))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(xs[i])
            i += 1
        else:
            out.append(ys[j])
            j += 1
    return fold_repeats(first + out + xs[i:] + ys[j:] + last)


def tree_of(block: Block, seen: tuple[int, ...] = ()) -> Node:
    """Wrapper of a single page. ``seen``: the digest of its article text."""
    text = " ".join("".join(p if isinstance(p, str) else " " for p in block.parts).split())
    children = fold_repeats([tree_of(p, seen) for p in block.parts if not isinstance(p, str)])
    mark = (zlib.crc32(text.encode("utf-8", "surrogatepass")) or 1) if text else 0
    return Node(block.label, 1, False, len(text), min(block.links, len(text)), mark, children, seen)


def page_tree(page: str | None) -> Node:
    """Wrapper of a single page, marked with the digest of the article text that the page alone gives."""
    root = parse(page)
    text = extract(root, decide(tree_of(root))) or ""
    return tree_of(root, (int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest()),))


def _names(label: str) -> set[str]:
    return {w.lower() for w in _NAME.findall(re.split(r"[.#@]", label, maxsplit=1)[1])} if re.search(r"[.#@]", label) else set()


#: Where an element stands: inside a container, inside an ``article``.
CONTAINED, IN_ARTICLE = 1, 2


def bar_of(label: str, place: int) -> int:
    """2 if an element is no part of an article by its kind, 1 if by its names or as a form, else 0."""
    tag = re.split(r"[.#@]", label, maxsplit=1)[0]
    if tag in OUTSIDE and tag != "form" and not (tag == "header" and place):
        return 2
    if "@" in label and label.rsplit("@", 1)[1] in OUTSIDE_ROLES:
        return 2
    names = OUTSIDE_NAMES - ARTICLE_NAMES if place == IN_ARTICLE else OUTSIDE_NAMES
    return int(tag == "form" or (bool(_names(label) & names) and tag not in ("html", "body", "main")))


def inside(label: str) -> int:
    """How surely an element is an article's container by its kind or its names: 0 to 3."""
    tag = re.split(r"[.#@]", label, maxsplit=1)[0]
    if tag == "article":
        return 3
    if tag == "main" or label.endswith("@main"):
        return 2
    return int(tag in ("div", "section", "td") and bool(_names(label) & INSIDE_NAMES))


def decide(wrapper: Node) -> dict[str, list[str]]:
    """Paths of the article's containers, and of parts below them that are none of it."""
    worth: dict[str, float] = {}
    marks: dict[str, int] = {}
    nodes: dict[str, list[Node]] = {}
    texts: dict[int, float] = {}

    def text_below(node: Node) -> float:
        texts[id(node)] = max(0.0, node.chars - 2.0 * node.links) + sum(map(text_below, node.children))
        return texts[id(node)]

    def articles(node: Node) -> float:
        """Text of the article and main elements under no bar."""
        if node.label and bar_of(node.label, 0):
            return 0.0
        return texts[id(node)] if inside(node.label) >= 2 else sum(map(articles, node.children))

    whole = text_below(wrapper)
    # Names and forms bar for good where an article lies free of them.
    named_only = articles(wrapper) < 0.1 * whole

    def visit(node: Node, path: str, barred: int, place: int, around: float) -> float:
        here = path
        if node.label:
            here = f"{path}>{node.label}"
            own = bar_of(node.label, place)
            if own == 1 and _wraps(node, texts[id(node)], around):
                own = 0
            sure = inside(node.label) >= 2
            barred = 0 if sure and not own and barred == 1 and named_only else max(barred, own)
            place = max(place, IN_ARTICLE if inside(node.label) == 3 else CONTAINED if sure else 0)
            around = texts[id(node)] if sure and not barred else around
            nodes.setdefault(here, []).append(node)
        value = 0.0 if barred else max(0.0, node.chars - 2.0 * node.links)
        value += sum(visit(c, here, barred, place, around) for c in node.children)
        if node.label and not barred:
            worth[here] = worth.get(here, 0.0) + value
            marks[here] = inside(node.label)
        return value

    total = visit(wrapper, "", 0, 0, whole if named_only else math.inf)
    if not total:
        return {"in": [], "out": []}
    best: list[str] = []
    for sure in (3, 2, 1):
        named = [p for p in worth if marks[p] == sure and worth[p] > 0]
        if sure == 1:  # the innermost of nested ones that hold nearly all
            named = [p for p in named if not any(q != p and q.startswith(p + ">") and worth[q] >= 0.8 * worth[p] for q in named)]
        top = [p for p in named if not any(p.startswith(q + ">") for q in named)]
        if sum(worth[p] for p in top) >= (0.3 if sure > 1 else 0.5) * total:
            best = [p for p in top if worth[p] >= 0.1 * max(worth[q] for q in top)]
            break
    if not best:
        holds = [p for p in worth if worth[p] >= 0.7 * total]
        best = [max(holds, key=lambda p: (p.count(">"), p))] if holds else [min(worth, key=len)]
        # A container, not the one paragraph that is long.
        while best[0].count(">") > 1 and re.split(r"[.#@]", best[0].rsplit(">", 1)[1], maxsplit=1)[0] in ("p", "li", "h1", "h2", "pre", "blockquote"):
            best = [best[0].rsplit(">", 1)[0]]
    below = {p: ns for p, ns in nodes.items() if any(p.startswith(b + ">") for b in best)}
    varied = any(n.constant == -1 for ns in below.values() for n in ns)
    barred = []
    for path, found in sorted(below.items()):
        label = path.rsplit(">", 1)[1]
        place = IN_ARTICLE if any(inside(x) == 3 for x in path.split(">")[1:-1]) else CONTAINED
        own, held = bar_of(label, place), max(sum(texts[id(n)] for n in nodes[b]) for b in best if path.startswith(b + ">"))
        if own == 1 and any(_wraps(n, texts[id(n)], held) for n in found):
            own = 0
        if own or varied and _fixed(label, found, wrapper):
            barred.append(path)
    return {"in": best, "out": barred}


def _wraps(node: Node, text: float, whole: float) -> bool:
    """Does an element hold what it would bar: nearly all text, or most of it and what only an article has?"""

    def holds(below: Node) -> bool:
        if below is not node and below.label and bar_of(below.label, CONTAINED):
            return False
        return bool(below.label) and (below.label.startswith("h1") or inside(below.label) > 0) or any(map(holds, below.children))

    return text > 0 and (text >= 0.9 * whole or (text >= 0.5 * whole and holds(node)))


def _fixed(label: str, found: list[Node], wrapper: Node) -> bool:
    """Is a part the template's: one short text next to five different articles or more, on half of a host's different pages?"""
    tag = re.split(r"[.#@]", label, maxsplit=1)[0]
    if tag in HEADINGS or (tag in BODY_TEXT and tag == label):
        return False
    if not all(n.constant > 0 and not n.children for n in found):
        return False
    seen = {d for n in found for d in n.seen}
    return len(seen) >= 5 and 2 * len(seen.intersection(wrapper.seen)) >= len(wrapper.seen)


def link_lists(root: Block) -> set[int]:
    """Blocks (by ``id``) of a page that are nearly only links."""
    found: set[int] = set()

    def visit(block: Block) -> tuple[int, int]:
        chars = len(" ".join("".join(p if isinstance(p, str) else " " for p in block.parts).split()))
        links = min(block.links, chars)
        for part in block.parts:
            if not isinstance(part, str):
                below = visit(part)
                chars, links = chars + below[0], links + below[1]
        if block.tag in LISTS and links > 0.7 * chars:
            found.add(id(block))
        return chars, links

    visit(root)
    return found


def _own_list(label: str) -> bool:
    """May a list of links be an article's own: has it no name, or one that tells of references?"""
    return not re.search(r"[.#@]", label) or bool(_names(label) & CITED_NAMES)


def extract(root: Block, rules: dict[str, list[str]]) -> str | None:
    """Text below the containers without the barred parts; None if the page has no container."""
    containers, barred, pieces, met = set(rules["in"]), set(rules["out"]), [], False
    listed = link_lists(root)

    def walk(block: Block, path: str, on: bool, article: bool) -> None:
        nonlocal met
        for part in block.parts:
            if isinstance(part, str):
                if on:
                    pieces.append(part)
                continue
            here = f"{path}>{part.label}"
            take = on or here in containers
            met = met or take
            if here in barred or (on and id(part) in listed and not (article and _own_list(part.label))):
                take = False
            pieces.append(" ")
            walk(part, here, take, take and (article or inside(part.label) == 3))
            pieces.append(" ")

    top = f">{root.label}"
    met = top in containers
    walk(root, top, met, False)
    return " ".join("".join(pieces).split()) if met else None


def main_text(page: str | None, rules: dict[str, list[str]] | None) -> str:
    root = parse(page)
    found = extract(root, rules) if rules and rules["in"] else None
    if found is None:
        found = extract(root, decide(tree_of(root)))
    return found or ""


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def infer(pages: DataFrame, buckets: int = 64) -> DataFrame:
    """A wrapper per host (JSON). ``pages``: ``host``, ``html``."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Node] = {}
        for batch in batches:
            for host, page in zip(batch["host"], batch["html"]):
                tree = page_tree(page)
                found[host] = combine(found[host], tree) if host in found else tree
        if found:
            yield pd.DataFrame({"host": list(found), "wrapper": [json.dumps(n.dump()) for n in found.values()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(group["wrapper"])
        whole = Node.load(json.loads(ordered[0]))
        for part in ordered[1:]:
            whole = combine(whole, Node.load(json.loads(part)))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(whole.dump())]})

    parts = pages.select("host", "html").mapInPandas(learn, "host string, wrapper string")
    parts = settle(parts, "wrapper-parts").withColumn("bucket", F.pmod(F.xxhash64("wrapper"), F.lit(buckets)))
    parts = parts.groupBy("host", "bucket").applyInPandas(merge, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each page."""
    small_batches(pages.sparkSession)
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    @F.pandas_udf("string")
    def rules_of(wrappers: pd.Series) -> pd.Series:
        return wrappers.map(lambda w: json.dumps(decide(Node.load(json.loads(w)))))

    rules = settle(infer(hosted).select("host", rules_of("wrapper").alias("rules")), "wrapper-rules")

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, dict] = {}
        for htmls, decided in batches:
            out = []
            for page, rule in zip(htmls, decided):
                if rule is not None and rule not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[rule] = json.loads(rule)
                out.append(main_text(page, known.get(rule)))
            yield pd.Series(out, dtype=object)

    texts = join_checked(hosted, rules, ["host"]).select("page_id", "url", text_of("html", "rules").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
