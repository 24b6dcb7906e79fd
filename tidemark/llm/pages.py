"""Main text of web pages by a site style tree.

1. Each page becomes a tree of its block elements; a node's style is its path of
   tags, classes and ids.  The trees of one host are merged: equal paths are one
   node of the site's style tree.
2. A node's importance is high where pages differ.  Presentation: the entropy of
   the child sequences seen under it.  Content: a text seen on n of the node's m
   pages has entropy log_m n, and the node's content counts for one minus the
   mean over the texts below it.  Both lie in 0..1 and are weighted 1 - DAMPING
   to DAMPING, so a branch that is the same on all pages has importance 0.
   A node whose name says what it is (nav, footer, class "ad", ...) has
   importance 0 from the start, since a host may have a single page; body,
   article and main have not, nor what holds the page's only article.
3. From each page the branches of low importance are removed, and what stays of
   its article, or of its body where it marks none, is the text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache, partial
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import carried, released, schema_of
from .urls import host_of

LEAST_PAGES, LEAST_IMPORTANCE, DAMPING = 5, 0.25, 0.9
PATHS = 500_000  # paths of low importance sent to every task (8 bytes each); more are joined by a shuffle of the pages
ROWS = 200_000  # counted rows that a task holds before it passes them on
PRESENT, STYLE, CONTENT = range(3)
OWN = ["text", "n_chars"]

# Elements that begin a block, those that are never main text, and words of class, id and role that say so.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead "
    "title tr ul button iframe object svg canvas audio video label".split())
RAW = set("script style textarea".split())
VOID = {"hr"}
NEVER = set("head title nav aside footer noscript template select option optgroup button iframe object svg canvas audio video dialog menu".split())
UNLESS_MAIN = {"header", "form", "fieldset", "label", "legend"}
NEVER_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion comment comments disqus reply replies respond "
    "nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr share sharing social newsletter subscribe related".split())
UNLESS_MAIN_WORDS = set(
    "aside banner complementary contentinfo header masthead modal notice notices overlay pager pagination popup recommended search sidebar "
    "signup login alert toolbar widget widgets form".split())
COMMENT_WORDS = set("comment comments disqus reply replies respond".split())
# A class, id or role made of such words and these names a section as a whole; "comments-open" doesn't.
PART_WORDS = set("area bar block box container content item items links list menu post posts section thread widget wrap wrapper".split())
MAIN = {"article", "main"}
CLOSES = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dd": ("dd dt", {"dl"}), "dt": ("dd dt", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}),
          "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select", "optgroup"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(1 << 16)
def hash64(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 14)
def _style(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool, bool]:
    """The node's style, and what rules it out: its tag; a word in its names, a name as a whole, or one of a comment
    section; and whether it is ruled out unless it holds the main text."""
    words, wholes, shown, hidden = set(), set(), [], False
    for name, *values in _NAMES.findall(attributes):
        name, value = name.lower(), "".join(values)
        hidden |= name == "hidden"
        if name != "hidden" and value:
            found = _WORDS.findall(value.lower())
            words.update(found, _WORDS.findall(_CAMEL.sub(" ", value).lower()))
            for token in value.split():
                parts = set(_WORDS.findall(_CAMEL.sub(" ", token).lower()))
                if parts <= NEVER_WORDS | PART_WORDS:
                    wholes |= parts & NEVER_WORDS
            shown.append(".".join(found))
    style = tag + ("#" + "#".join(shown) if shown else "")
    return style, hidden or tag in NEVER, bool(words & NEVER_WORDS), bool(wholes), bool(wholes & COMMENT_WORDS), tag in UNLESS_MAIN or bool(words & UNLESS_MAIN_WORDS)


class _Node:
    __slots__ = ("tag", "up", "path", "never", "worded", "whole", "comment", "weak", "holds_main", "holds_title", "children", "inside_main", "named")

    def __init__(self, tag, up, style, never=False, worded=False, whole=False, comment=False, weak=False):
        self.tag, self.up = tag, up
        self.path = hash64(f"{up.path}>{style}") if up else hash64(style)
        self.never, self.worded, self.whole, self.comment, self.weak = never, worded, whole, comment, weak
        self.holds_main, self.holds_title, self.children = False, False, []
        self.inside_main = up is not None and (up.inside_main or up.tag in MAIN)
        self.named = style != tag or (up is not None and up.named and self.inside_main)


def blocks(html: str) -> tuple[list[tuple[_Node, str]], list[_Node]]:
    """The page's texts in order, each with the block element that holds it, and all block elements."""
    root = _Node("", None, "")
    stack, nodes, out, text = [root], [], [], []
    at = 0

    def flush():
        if text:
            joined = " ".join(unescape("".join(text)).split())
            text.clear()
            if joined:
                out.append((stack[-1], joined))

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = len(html) if end is None else html.find(">", end.start()) + 1 or len(html)
            continue
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            if any(n.tag == tag for n in stack):
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
            continue
        if stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            same, until = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in same.split():
                    del stack[i:]
                    break
        node = _Node(tag, stack[-1], *_style(tag, m[3]))
        stack[-1].children.append(node.path)
        nodes.append(node)
        if tag in MAIN or tag == "h1":
            up = node.up
            while up is not None:
                up.holds_main |= tag in MAIN
                up.holds_title |= tag == "h1"
                up = up.up
        if tag not in VOID:
            stack.append(node)
    flush()
    return out, nodes


def _chain(node: _Node):
    while node is not None and node.up is not None:
        yield node
        node = node.up


def _named_out(node: _Node, elsewhere: bool) -> bool:
    """Whether names rule the node out.

    Body, article and main are never ruled out by name, save an article of
    another one's comments.  What holds an article is one's comment section, or,
    if the page has an article ``elsewhere``, a section named so as a whole.
    """
    if node.tag == "body":
        return False
    if node.tag in MAIN:
        return node.comment and node.inside_main
    return (node.comment or (node.whole and elsewhere)) if node.holds_main else node.worded


def _ruled_out(node: _Node, elsewhere: bool) -> bool:
    return any(n.never or _named_out(n, elsewhere) or (n.weak and not n.holds_main and not _titles_main(n)) for n in _chain(node))


def _titles_main(node: _Node) -> bool:
    """A header inside an article holds its title."""
    return node.tag == "header" and node.inside_main and node.holds_title


def main_text(html: str, low: frozenset[int] = frozenset()) -> str:
    """What stays of the page without the branches in ``low`` (paths of low importance) and those named so.

    Inside an article or main element only branches with a class or id of their
    own, or below one, can be of low importance: its plain paragraphs are text
    even where a whole site repeats them.
    """
    found, nodes = blocks(html)
    elsewhere = any(n.tag in MAIN and not n.holds_main and not _ruled_out(n, True) for n in nodes)
    named = [(n, t) for n, t in found if not _ruled_out(n, elsewhere)]
    kept = [(n, t) for n, t in named if not any(c.path in low and (c.named if c.inside_main else not c.holds_main and c.tag not in MAIN) for c in _chain(n))]
    inside = [(n, t) for n, t in kept if n.inside_main or n.tag in MAIN]
    return "\n\n".join(t for _, t in inside or kept or named)


def _observed(html: str, rows: Counter, host: str) -> None:
    """Counts, once a page, of the page's nodes, of what stands under each, and of the texts below each."""
    found, nodes = blocks(html)
    seen = set()
    for n in nodes:
        seen.add((host, n.path, PRESENT, 0))
        seen.add((host, n.path, STYLE, hash64(",".join(map(str, n.children)))))
    for n, text in found:
        value = hash64(text)
        seen.update((host, c.path, CONTENT, value) for c in _chain(n))
    rows.update(seen)


def _counted(batches):
    def out():
        host, path, kind, value = zip(*rows, strict=True) if rows else ((), (), (), ())
        batch = pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64()), pa.array(rows.values(), pa.int64())],
            ["host", "path", "kind", "value", "n"])
        rows.clear()
        return batch

    rows: Counter = Counter()
    for batch in batches:
        for host, html in zip(batch.column("host"), batch.column("html"), strict=True):
            _observed(html.as_py() or "", rows, host.as_py())
            if len(rows) > ROWS:
                yield out()
    yield out()


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, presentation, content, importance) of the merged nodes of each host's pages."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> '' and html is not null")
    counts = rows.mapInArrow(_counted, "host string, path long, kind int, value long, n long").groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    present, style, content = (F.col("kind") == k for k in (PRESENT, STYLE, CONTENT))
    nodes = counts.groupBy("host", "path").agg(
        F.max(F.when(present, F.col("n"))).alias("pages"),
        F.sum(F.when(style, F.col("n"))).alias("styles"), F.sum(F.when(style, F.col("n") * F.ln("n"))).alias("style_logs"),
        F.count_if(content).alias("texts"), F.coalesce(F.sum(F.when(content, F.ln("n"))), F.lit(0.0)).alias("text_logs"))
    several = F.col("pages") > 1
    presentation = F.when(several, (F.ln("styles") - F.col("style_logs") / F.col("styles")) / F.ln("pages")).otherwise(1.0)
    same = F.when(several & (F.col("texts") > 0), 1 - F.col("text_logs") / F.col("texts") / F.ln("pages"))
    nodes = nodes.select("host", "path", "pages", F.least(presentation, F.lit(1.0)).alias("presentation"), F.coalesce(same, F.lit(1.0)).alias("content"))
    return nodes.withColumn("importance", (1 - DAMPING) * F.col("presentation") + DAMPING * F.col("content"))


def _texts(batches, names):
    for batch in batches:
        out = []
        for html, low in zip(batch.column("html"), batch.column("low"), strict=True):
            out.append(main_text(html.as_py() or "", frozenset(low.as_py() or ())))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(out, pa.string()), pa.array(np.fromiter(map(len, out), np.int64, len(out)))], [*names, *OWN])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html and others) with the text of each page's article and its n_chars.

    Character references are decoded, white space inside a block is one space,
    and blocks are joined by an empty line.  The style tree of a host is made of
    all its pages; nodes seen on fewer than ``LEAST_PAGES`` are judged by name
    alone, and so are pages whose url has no host.

    Null or empty html, and pages without text, have an empty text.  Repeated
    rows are pages of their own, of equal result; an empty table gives an empty
    table.  A column of the input that has the name of an added one is replaced.
    """
    low = style_tree(pages).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    low = cut(low.select("host", "path"))
    few = low.count() <= PATHS
    low = low.groupBy("host").agg(F.collect_list("path").alias("low"))  # a host's own styles, however many pages it has
    low = F.broadcast(low) if few else low
    rows = pages.select(host_of(F.col("url")).alias("host"), "url", "html", carried(pages, "url", "html").alias("rest"))
    names = ["url", "html", "rest"]
    out = rows.join(low, "host", "left").mapInArrow(partial(_texts, names=names), schema_of(rows.select(*names), text="string", n_chars="long"))
    return released(out, pages.columns, OWN, ("url", "html"))
