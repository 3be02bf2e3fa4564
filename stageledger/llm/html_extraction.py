"""HTML extraction by a site style tree.

The pages of a host are merged by the paths of their structural elements. A node of
the tree (host, path) counts how its pages present it (sequence of child elements)
and what they hold there (text); diverse nodes have high entropy and are important,
nodes that look and read alike on page after page are not. Entropy alone can't tell
a menu with other links on each page from an article, so a node's importance also
has a prior from its element: branches of boilerplate elements (menus, headers,
footers, sidebars, notices, adverts, forms, comments) have none whatever their
entropy, branches of the article fall only if they are nearly the same on all pages
(its own running text doesn't), and where a page has an article the rest of it passes
only if it is very diverse.
Branches under ``LEAST`` are removed from each page, and what stays is its text.

Pages of a host that hold the same outside boilerplate are copies and count as one.

Defined cases: a null or empty html gives an empty text; a url without a host puts
the page into the host ''; repeated pages and null page_ids keep a row each; a node
on fewer than ``REPEATED`` distinct pages isn't repeated, one on a single page beside
an article isn't diverse; html that ends inside a tag loses that tag;
other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, ship, table

LEAST = 0.5
#: What presentation counts against content in a node's entropy.
PRESENTATION = 0.1
#: What an article's branch has besides its entropy.
INSIDE = 0.4
#: What entropy counts outside the article, on a page that has one.
OUTSIDE = 0.6
#: Distinct pages that it takes to call a branch repeated.
REPEATED = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template noframes xmp svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main nav aside footer header form body".split())
BOILER_TAGS = frozenset("head nav footer aside form button select dialog menu header input option datalist".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside widget ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup comment comments disqus respond reply replies share sharing social related recommended breadcrumb breadcrumbs pagination pager login search toolbar copyright".split()
)
#: A class with one of these says what a page has or lacks, not what the element is.
QUALIFIERS = frozenset("has no with without is".split())
#: Elements of an article's own running text, where they have no class or id.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ARTICLE_NAMES = frozenset("article post entry story content main body text".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Node:
    tag: str
    path: str
    boiler: bool = False
    article: bool = False
    #: Numbers of the elements above, itself among them, that are boilerplate by name only.
    named: tuple[int, ...] = ()
    #: Whether an element above, or itself, is boilerplate by what it is.
    hard: bool = False
    #: Whether it is an article's own element.
    root: bool = False


@dataclass
class Branch:
    """What one page has at one path."""

    boiler: bool
    article: bool
    children: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _role(tag: str, attributes: dict[str, str], inside: bool, spared: bool) -> tuple[bool, bool, bool, str]:
    """(boilerplate by kind, by name, article, name for the path) of an element.

    ``inside``: within an article; ``spared``: its names don't count.
    """
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = {w for token in _CAMEL.sub(r"\1 \2", names).lower().split() if not (own := set(_NAME.findall(token))) & QUALIFIERS for w in own}
    role = attributes.get("role", "").lower()
    article = tag in ("article", "main") or role in ("main", "article")
    hard = tag in BOILER_TAGS - {"form"} or role in BOILER_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
    named = tag == "form" or tag not in ("html", "body", "main") and bool(words & BOILER_NAMES) and (tag == "article" or not words & ARTICLE_NAMES)
    named = named and not spared
    if inside and (hard or named) and (tag == "header" or "header" in words and not words & (BOILER_NAMES - {"header"})) and role not in BOILER_ROLES:
        hard = named = False  # an article's own heading
    kind = re.sub(r"\d+", "0", ".".join(sorted(names.split()))).replace("/", "\\")
    if len(kind) > 60:
        kind = f"{kind[:60]}~{_hash(kind):x}"
    # The verdicts are part of the name, so that all elements at one path have the same.
    return hard, named, article, "-" * (hard or named) + "+" * article + (f"{tag}.{kind}" if kind else tag)


def _to_spare(items: list[tuple[Node, str, bool]]) -> frozenset[int]:
    """Elements whose names would blank the whole page: around all of its articles, or around all of its text."""
    roots = [node for node, _, opens in items if opens and node.root]
    if roots:
        if any(not node.boiler for node in roots):
            return frozenset()
        return frozenset(x for node in roots if not node.hard for x in node.named)
    texts = [node for node, text, opens in items if not opens and text.strip()]
    wraps = {node.named[0] if node.named and not node.hard else None for node in texts if not node.hard}
    prose = any(node.tag in PROSE for node in texts if not node.hard)
    return frozenset(wraps) if len(wraps) == 1 and None not in wraps and prose else frozenset()


def segments(html: str | None) -> list[tuple[Node, str, bool]]:
    """(node, text, break before it) in page order; also (node, '', True) when an element opens.

    A name is a hint: where names alone leave nothing of a page's articles, or of a page
    without articles, the elements that bear them are read again without.
    """
    items = list(_walk(html, frozenset()))
    spared = _to_spare(items)
    return list(_walk(html, spared)) if spared else items


def _walk(html: str | None, spared: frozenset[int]) -> Iterator[tuple[Node, str, bool]]:
    html, number = html or "", 0
    root = Node("", "")
    stack = [root]
    at, n = 0, len(html)

    def close(upto: int) -> None:
        del stack[upto:]

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield stack[-1], entities.unescape(html[at:lt]), False
        if lt >= n:
            return
        nxt = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if nxt in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (nxt.isalpha() or nxt == "/" and html[lt + 2 : lt + 3].isalpha()):
            if not nxt or nxt == "/" and lt + 2 >= n:
                return
            yield stack[-1], "<", False
            at = lt + 1
            continue
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            return  # the page ends inside a tag
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            if tag not in INLINE:
                yield stack[-1], "", True
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at) if not m[3].endswith("/") else None
            at = end.end() if end else at if m[3].endswith("/") else n
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if tag in CLOSES_OWN:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES_OWN[tag]:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        top = stack[-1]
        if tag in INLINE and "=" not in m[3]:
            node = Node(tag, top.path, top.boiler, top.article, top.named, top.hard)
        else:
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])}
            number += 1
            hard, named, article, name = _role(tag, attributes, top.article, number in spared)
            boiler = hard or named
            path = top.path if tag in INLINE and not boiler and not article else f"{top.path}/{name}"
            node = Node(tag, path, top.boiler or boiler, top.article or article and not boiler, top.named + (number,) * named, top.hard or hard, article)
        if tag not in INLINE:
            yield node, "", True
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag not in INLINE:
            stack.append(node)  # a slash closes nothing in HTML


def branches(html: str | None) -> dict[str, Branch]:
    found: dict[str, Branch] = {}
    for node, text, opens in segments(html):
        own = found.get(node.path)
        if own is None:
            own = found[node.path] = Branch(node.boiler, node.article)
        if opens:
            parent = found.get(node.path.rpartition("/")[0])
            if parent is not None and parent is not own:
                name = node.path.rpartition("/")[2]
                if parent.children[-1:] != [name]:
                    parent.children.append(name)
        else:
            own.text.append(text)
    return found


def extract(html: str | None, kept: set[str]) -> str:
    """Text of the branches at ``kept`` paths: blocks in page order, white space as single spaces."""
    parts: list[str] = []
    for node, text, opens in segments(html):
        if opens:
            parts.append(" ")
        elif node.path in kept:
            parts.append(text)
    return " ".join("".join(parts).split())


NODES = "r long, h long, host string, lead boolean, page long, path string, place int, presentation long, content long"


#: Places of a node: on a page without an article, beside one, inside one, its own running text.
NOWHERE, BESIDE, INSIDE_IT, ITS_OWN = range(4)


def _prose(path: str) -> bool:
    """Whether only elements of running text stand between the innermost article and this node."""
    for name in reversed(path.split("/")):
        if name.startswith("+"):
            return True
        if name not in PROSE:
            return False
    return False


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows = []
            for r, h, host, html in zip(*(part.column(c).to_pylist() for c in ("r", "h", "host", "html")), strict=True):
                own = branches(html)
                has = any(b.article for b in own.values())
                found = []
                for path, b in own.items():
                    text = " ".join(" ".join(b.text).split())
                    if text and not b.boiler:  # boilerplate and nodes without text of their own decide nothing
                        place = INSIDE_IT + _prose(path) if b.article else BESIDE if has else NOWHERE
                        found.append((path, place, _hash(" ".join(b.children)), _hash(text)))
                same = _hash(repr(sorted(found)))
                rows.extend((r, h, host, not i, same, *x) for i, x in enumerate(found))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])


def _identified(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64("page_id", "url", "html").alias("h"), host.alias("host"))


def copies(nodes: DataFrame) -> DataFrame:
    """r of the pages that are copies of an earlier page of their host."""
    pages = nodes.where("lead").select("r", "host", "page")
    first = pages.groupBy("host", "page").agg(F.min("r").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pages.join(first, ["host", "page"]).where("r > first").select("r")


def style_tree(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, entropy): the mix of both normalised entropies, 1 for nodes of one page."""

    def entropy(what: str) -> DataFrame:
        each = nodes.groupBy("host", "path", what).agg(F.count("*").cast("double").alias("c"))
        return each.groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s")).select("host", "path", F.col("m").alias(f"m_{what}"), F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0).alias(f"e_{what}"))

    both = entropy("presentation").join(entropy("content"), ["host", "path"])
    return both.select("host", "path", F.col("m_content").alias("pages"), (PRESENTATION * F.col("e_presentation") + (1 - PRESENTATION) * F.col("e_content")).alias("entropy"))


def importance() -> Column:
    """The importance of a node that isn't boilerplate: entropy under the prior of its place."""
    own = F.when(F.col("pages") < REPEATED, 1.0).otherwise(F.col("entropy"))
    beside = F.when(F.col("pages") > 1, OUTSIDE * F.col("entropy")).otherwise(0.0)
    return F.when(F.col("place") == ITS_OWN, 1.0).when(F.col("place") == INSIDE_IT, INSIDE + own).when(F.col("place") == BESIDE, beside).otherwise(own)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    The nodes (hashes, no text) are a written table; a host with very many pages is
    a skewed key of the join with its tree, which AQE splits.
    """
    ship(pages.sparkSession)
    own = _identified(pages)
    numbered = own.select(F.monotonically_increasing_id().alias("r"), "h", "host", "html")
    nodes = materialize(numbered.mapInArrow(_nodes, NODES), "style-nodes")  # written, so that r stays
    again = materialize(copies(nodes), "page-copies")
    tree = materialize(style_tree(nodes.join(again, "r", "left_anti")), "style-tree")
    kept = nodes.join(tree, ["host", "path"]).where(importance() >= LEAST).groupBy("h").agg(F.collect_set("path").alias("kept"))
    kept = materialize(kept, "kept-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(html, set(paths or ())) for html, paths in zip(batch.column("html").to_pylist(), batch.column("kept").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    found = own.select("page_id", "url", "html", "h").join(kept, "h", "left").select("page_id", "url", "html", "kept")
    for x in (nodes, again, tree):
        discard(x)
    return found.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
