"""Main text of HTML pages by wrappers: union-free regular expressions inferred for each host.

A page's tags make a tree of labels (tag name, class and id words). The trees of a host's pages are aligned one after
another: equal neighbours, and equal groups of up to four labels, fold into repeated groups, labels that match are
merged, those that only one side has become optional, and text becomes a slot. The result is the host's wrapper, built
of sequence, option, repetition and text slots only.

What is text follows from the wrapper. A text that stands at the same place on at least half of a host's different pages
(and on three) is part of the template, a constant of the expression; other texts fill slots. The wrapper counts the
characters in its slots over all pages, and the article's region is found from its root: into the child that holds at
least half of the slots' characters, again and again, until a node holds headings, paragraphs or bare text of its own,
or no child holds half. A page is read through its host's wrapper: what fills the slots of the region is its text, and
where a page has nothing there, what fills any slot. Without a wrapper nothing is read. Names decide nothing but ties:
an article or main element, or a container named as content, ends the way down; and within the region elements that
HTML or their names mark as menus, adverts, forms, scripts, comments and so on are left out.

A host's trees are merged where its pages are read, then in groups dealt out by hash, then per host; template texts are
counted by aggregation; so a host with a third of all pages is no single task's work. The pages themselves are shuffled
only where the wrappers are too large to broadcast.

Defined results: null, empty and textless pages give an empty string; a null or odd url has the empty host; broken
markup is read like a browser would where it matters (unclosed paragraphs and items end at the next one, stray end tags
are ignored, an unclosed comment or script runs to the end); in the wrapper, what is nested below 60 levels counts with
its ancestor there; equal rows are extracted one by one, and count once for the wrapper; ties between regions go to the
first; a very long page is read whole; an empty table gives an empty result; further columns are kept whatever their
names, except for the text column, which is replaced.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import cut, few, read

DEPTH = 60
#: Wrappers of up to this many bytes together are broadcast.
BROADCAST_BYTES = 4 << 20
#: Template texts of so many hosts are broadcast; a host has at most two for every block of an average page.
MOST_HOSTS = 1 << 14
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "section", "div"}
#: Elements and name words that are no part of an article.
DROPPED = {"script", "style", "head", "title", "noscript", "template", "nav", "aside", "footer", "form", "button", "select", "textarea", "iframe", "svg", "object", "dialog", "menu", "figure-ad"}
BAD_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "banner", "promo", "promotion", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "toolbar", "widget", "pagination", "pager", "search", "skip", "footer", "complementary", "contentinfo", "alertdialog"}
HEADERS = {"header", "masthead", "banner", "topbar"}
GOOD_WORDS = {"content", "article", "post", "entry", "story", "main", "body", "text"}
#: Elements that hold text themselves, so that a region does not narrow to one kind of them.
TEXTUAL = {"#", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "figcaption", "td", "th"}
#: A text is template if it is on at least so many pages, and on this share of a host's pages.
LEAST_PAGES, TEMPLATE_SHARE = 3, 0.5
#: A child with this share of its parent's slot characters is the way to the article.
REGION_SHARE = 0.5

Node = list  # [label, quantifier, children, characters in slots]; a text slot's label is "#", a group's "()"


def label_of(tag: str, attributes: str) -> str:
    names: set[str] = set()
    if attributes and "=" in attributes:
        for _, a, b, c in NAMED.findall(attributes):
            # Words, and words with a number of up to two digits; longer numbers are those of single pages.
            for word, number in re.findall(r"([a-z]+)([0-9]{1,2}(?![0-9]))?", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()):
                names.update((word, word + number))
    return ".".join([tag, *sorted(names)])


def events(page: str) -> Iterator[tuple[str, str]]:
    """("open", label), ("close", label), ("text", raw text) and ("break", tag) of one page, properly nested."""
    stack: list[str] = []
    tags: list[str] = []
    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in tags:
                while tags:
                    gone = tags.pop()
                    yield "close", stack.pop()
                    if gone == tag:
                        break
            continue
        if tag in VOID:
            yield "break", tag
            continue
        ends = ENDS.get(tag)
        if ends or tag not in INLINE:
            for i in range(len(tags) - 1, -1, -1):
                if (ends and tags[i] in ends) or (tags[i] == "p" and tag not in INLINE):
                    while len(tags) > i:
                        tags.pop()
                        yield "close", stack.pop()
                    break
                if tags[i] in SCOPES:
                    break
        label = label_of(tag, m[3])
        tags.append(tag)
        stack.append(label)
        yield "open", label
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if end is None:
                break
            if end.start() > at and tag not in ("script", "style"):
                yield "text", page[at : end.start()]
            at = end.end()
            tags.pop()
            yield "close", stack.pop()
        elif m[3].endswith("/") and tag not in ("p", "div", "a", "span"):
            tags.pop()
            yield "close", stack.pop()
    else:
        return
    if at < len(page) and not (tags and tags[-1] in RAW):
        yield "text", page[at:]
    while stack:
        yield "close", stack.pop()


class Block:
    """The text between two breaks of blocks: where it stands, its parts, and the slots of the tree that they fill."""

    def __init__(self) -> None:
        self.path: tuple[str, ...] = ()
        self.parts: list[str] = []
        self.slots: list[tuple[Node, int]] = []

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def vetoed(label: str, above: tuple[bool, bool]) -> tuple[bool, bool]:
    """Whether an element is left out by what it is or how it is named, and whether it is inside of content; above: of its parent."""
    out, inside = above
    tag, *names = label.split(".")
    found = set(names)
    out = out or tag in DROPPED or bool(found & BAD_WORDS) or (not inside and (tag == "header" or bool(found & HEADERS)))
    return out, inside or is_content(label)


def is_content(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in ("article", "main") or "main" in names or (tag != "body" and bool(set(names) & GOOD_WORDS))


def blocks_of(page: str, root: Node | None = None) -> Iterator[Block]:
    """The blocks of text of a page in order, without what is left out by element or name. root gets the page's tree."""
    open_: list[Node] = [["", "", [], 0] if root is None else root]
    path: list[str] = []
    states = [(False, False)]
    block = Block()
    for kind, what in events(page):
        if kind == "text":
            if what.strip() and not states[-1][0]:
                if not block.parts:
                    block.path = tuple(path)
                if root is not None:
                    children = open_[min(len(open_), DEPTH) - 1][2]
                    if not children or children[-1][0] != "#":
                        children.append(["#", "", [], 0])
                    block.slots.append((children[-1], len(what)))
            if not states[-1][0] and (block.parts or what.strip()):
                block.parts.append(what)
            continue
        if what.split(".")[0] not in INLINE and block.parts:
            yield block
            block = Block()
        if kind == "open":
            path.append(what)
            states.append(vetoed(what, states[-1]))
            if root is not None:
                node: Node = [what, "", [], 0]
                if len(open_) < DEPTH:
                    open_[-1][2].append(node)
                open_.append(node)
        elif kind == "close":
            path.pop()
            states.pop()
            if root is not None:
                open_.pop()
    if block.parts:
        yield block


def key_of(path: tuple[str, ...], text: str) -> int:
    """A hash of a text and the block-level labels above it."""
    where = "/".join(x for x in path if x.split(".")[0] not in INLINE)
    return xxhash.xxh64_intdigest(f"{where}\n{text}") - (1 << 63)


def tree_of(page: str, template: set[int] | frozenset[int] = frozenset()) -> Node:
    """The page's folded tree, with the characters that fill slots: those of texts that are not template."""
    root: Node = ["", "", [], 0]
    for block in blocks_of(page, root):
        if key_of(block.path, block.text()) not in template:
            for slot, n in block.slots:
                slot[3] += n
    return summed(root)


def summed(node: Node) -> Node:
    """The tree folded from below, every node with the characters under it."""
    for n in node[2]:
        summed(n)
    node[2] = fold(node[2])
    node[3] += sum(n[3] for n in node[2])
    return node


def quantifier(optional: bool, many: bool) -> str:
    return ("*" if many else "?") if optional else ("+" if many else "")


def merged(a: Node, b: Node, many: bool) -> Node:
    optional = a[1] in ("?", "*") or b[1] in ("?", "*")
    return [a[0], quantifier(optional, many or a[1] in ("+", "*") or b[1] in ("+", "*")), align(a[2], b[2]), a[3] + b[3]]


def maybe(n: Node) -> Node:
    return [n[0], quantifier(True, n[1] in ("+", "*")), n[2], n[3]]


def fold(children: list[Node]) -> list[Node]:
    """Runs of equal labels, then of equal groups of two to four labels, become repeated."""
    out: list[Node] = []
    for node in children:
        out[-1:] = [merged(out[-1], node, True)] if out and out[-1][0] == node[0] else [*out[-1:], node]
    for width in (2, 3, 4):
        i = 0
        while i + 2 * width <= len(out):
            names = [n[0] for n in out[i : i + width]]
            if len(set(names)) > 1 and "()" not in names and names == [n[0] for n in out[i + width : i + 2 * width]]:
                group = out[i : i + width]
                j = i + width
                while [n[0] for n in out[j : j + width]] == names:
                    group = [merged(a, b, False) for a, b in zip(group, out[j : j + width])]
                    j += width
                out[i:j] = [["()", "+", group, sum(n[3] for n in group)]]
            i += 1
    return out


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One sequence that has both: matching labels merged along a longest common subsequence, the others optional."""
    if not a or not b:
        return [maybe(n) for n in a or b]
    if [n[0] for n in a] == [n[0] for n in b]:
        return [merged(x, y, False) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list[Node] = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            out.append(merged(a[i], b[j], False))
            i, j = i + 1, j + 1
        else:
            left = best[i + 1][j] >= best[i][j + 1]
            out.append(maybe(a[i] if left else b[j]))
            i, j = i + left, j + (not left)
    return out + [maybe(n) for n in a[i:] + b[j:]]


def both(a: Node | None, b: Node) -> Node:
    """Two trees aligned into one."""
    return b if a is None else ["", "", fold(align(a[2], b[2])), a[3] + b[3]]


def aligned(trees: list[str]) -> str:
    """The trees (as JSON), in a fixed order, aligned into one."""
    whole = None
    for t in sorted(trees):
        whole = both(whole, json.loads(t))
    return json.dumps(whole)


def expression(node: Node) -> str:
    """The wrapper as text, for people: tags, #text slots, and the quantifiers of regular expressions."""
    inner = "".join(expression(n) for n in node[2])
    body = "#text" if node[0] == "#" else f"({inner})" if node[0] in ("", "()") else f"<{node[0]}>{inner}</{node[0].split('.')[0]}>"
    return f"({body}){node[1]}" if node[1] else body


def region(wrapper: Node) -> list[str]:
    """The labels that lead to the part of the wrapper that is the article; empty for all of it."""
    path: list[str] = []
    node = wrapper
    while True:
        children = [x for n in node[2] for x in (n[2] if n[0] == "()" else [n])]
        own = sum(n[3] for n in children if n[0].split(".")[0] in TEXTUAL or n[0].split(".")[0] in INLINE)
        if not children or own > 0 or (path and is_content(path[-1])):
            return path
        # A label may stand at several places of a sequence; pages are read by label, so these are one.
        share: dict[str, int] = {}
        for n in children:
            share[n[0]] = share.get(n[0], 0) + n[3]
        label = max(share, key=lambda x: share[x])
        if share[label] == 0 or share[label] < REGION_SHARE * node[3]:
            return path
        path.append(label)
        same = [n for n in children if n[0] == label]
        node = [label, "", [x for n in same for x in n[2]], share[label]]


def extract(page: str, wrapper: Node | None, way: list[str], template: set[int]) -> str:
    """The text in the slots of the wrapper's region, or in any slot where the region has none on this page."""
    if wrapper is None:
        return ""
    inside, others = [], []
    for block in blocks_of(page):
        text = block.text()
        if text and key_of(block.path, text) not in template:
            (inside if list(block.path[: len(way)]) == way else others).append(text)
    return " ".join(inside or others)


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def pages_of(pages: DataFrame, url: str, page: str) -> DataFrame:
    return pages.select(host_of(url).alias("host"), F.coalesce(F.col(page), F.lit("")).alias("page"))


def templates(read_pages: DataFrame) -> DataFrame:
    """(host, template): hashes of the texts that are part of the host's template.

    A page's first hash is that of the page itself, under the number of pages; copies of a page count once.
    """

    def keys(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            hosts, whole, texts = [], [], []
            for h, p in zip(b.column("host").to_pylist(), b.column("page").to_pylist()):
                own = {key_of(x.path, x.text()) for x in blocks_of(p)}
                hosts += [h] * (len(own) + 1)
                whole += [xxhash.xxh64_intdigest(p) - (1 << 63)] * (len(own) + 1)
                texts += [None, *own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(texts, pa.int64())], names=["host", "whole", "key"])

    each = read_pages.mapInArrow(keys, "host string, whole long, key long").distinct()
    counts = cut(each.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("key").isNull() | (F.col("n") >= LEAST_PAGES)))
    of = counts.filter(F.col("key").isNull()).select("host", F.col("n").alias("of"))
    often = counts.filter(F.col("key").isNotNull()).join(of, "host").filter(F.col("n") >= F.lit(TEMPLATE_SHARE) * F.col("of"))
    return of.join(often.groupBy("host").agg(F.collect_list("key").alias("template")), "host", "left").select("host", F.coalesce("template", F.array().cast("array<long>")).alias("template"))


def infer(pages: DataFrame, url: str = "url", page: str = "html", groups: int = 16) -> DataFrame:
    """(host, wrapper, template): the wrapper of every host, as JSON, and the hashes of its template's texts."""

    def trees(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            whole: dict[str, Node] = {}
            seen: dict[str, set[int]] = {}
            for h, p, t in zip(b.column("host").to_pylist(), b.column("page").to_pylist(), b.column("template")):
                template = seen.get(h)
                if template is None:
                    template = seen[h] = set(t.as_py())
                whole[h] = both(whole.get(h), tree_of(p, template))
            yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.string()), pa.array([json.dumps(t) for t in whole.values()], pa.string())], names=["host", "tree"])

    def wrapper(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "tree": [aligned(list(rows["tree"]))]})

    read_pages = pages_of(pages, url, page)
    known = cut(templates(read_pages))
    each = read_pages.join(few(known, MOST_HOSTS), "host").select("host", "page", "template").mapInArrow(trees, "host string, tree string")
    partly = each.groupBy("host", F.pmod(F.xxhash64("tree"), F.lit(groups)).alias("part")).applyInPandas(wrapper, "host string, tree string")
    return partly.groupBy("host").applyInPandas(wrapper, "host string, tree string").withColumnRenamed("tree", "wrapper").join(known, "host")


def main_text(pages: DataFrame, url: str = "url", page: str = "html", text: str = "text", wrappers: DataFrame | None = None) -> DataFrame:
    """pages without the page column, with its main text. wrappers: as `infer` gives them, if they are known already."""
    wrappers = cut(infer(pages, url, page) if wrappers is None else wrappers)
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + 8 * F.size("template")), F.lit(0))).first()[0]
    kept = [c for c in pages.columns if c not in (page, text)]
    inner = {c: f"_in_{i}" for i, c in enumerate(kept)}
    body = pages.select(*[F.col(f"`{c}`").alias(inner[c]) for c in kept], F.coalesce(F.col(page), F.lit("")).alias("_page"), host_of(url).alias("host"))
    joined = body.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Node | None, list[str], set[int]]] = {}
        for b in found:
            out = []
            for h, p, w, t in zip(b.column("host").to_pylist(), b.column("_page").to_pylist(), b.column("wrapper"), b.column("template")):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    tree = json.loads(w.as_py()) if w.is_valid else None
                    known[h] = tree, region(tree) if tree else [], set(t.as_py() or ())
                out.append(extract(p, *known[h]))
            yield pa.RecordBatch.from_arrays([*[b.column(inner[c]) for c in kept], pa.array(out, pa.string())], names=[*[inner[c] for c in kept], "_text"])

    schema = ", ".join(f"{inner[f.name]} {f.dataType.simpleString()}" for f in pages.schema if f.name in inner)
    done = joined.select(*[inner[c] for c in kept], "_page", "host", "wrapper", "template").mapInArrow(batches, f"{schema}, _text string")
    return done.select(*[F.col(inner[c]).alias(c) for c in kept], F.col("_text").alias(text))


def op3_union_free_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
