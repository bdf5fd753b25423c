"""HTML extraction by wrapper induction: DOM trees of same-host pages are aligned by simple tree matching.

Each host has one reference page, the page of the smallest hash. Runs of siblings of the same sign and shape are folded into one
list node, so trees stay small, and every page of the host is aligned with the reference by simple tree matching (the largest
order- and parent-preserving match). Over all pages of a host, exact counts tell for each reference node how many pages have
it, how much text it has there, how much of that is in links, and how many pages repeat a text. Then

- constant nodes become template: a text that nearly all pages with its node repeat. What the reference lacks (another layout,
  an error page) is counted by its path, the signs from the root down, in the same way;
- slots that are mostly links are menus;
- the other slots compete by what varies in them. The content root is where the alignment's varying, unlinked text is: from the
  root of the reference down, the child that holds HOLDS of it, as long as one does that has parts of its own; headings right
  before it belong to it. What stands in other slots is not content, whatever its name.

A page's text is its varying blocks under the content root. Names are hints: text inside `article` or `main` counts HINT times in
the competition; an element named as a notice, menu, comment box and so on (or a form) is not content, unless it holds an article or
most of the page's text; and pages that the alignment says nothing about (a host of few pages, a layout that has no match for the
content root) fall back on these hints alone, the deepest `article` or `main`, else the body.

Pages that equal the reference say nothing about what varies, so they do not count, and copies of a page count as one. A host
needs MIN_PAGES others before anything is called template, ROOT_PAGES before slots compete. Pages are parsed and aligned
once; their blocks are written, and counts are gathered from them per reference item, so a host with a third of all pages is
summed where its pages are read. The reference pages are joined by host, which Spark may broadcast or split.

Defined cases: null and empty html give an empty text; broken markup is closed as browsers do; a host with one page uses hints
alone; a null url is a host of its own (empty); repeated rows give the same text each; very long pages are parsed whole; elements
below DEPTH levels keep their own flags and text but stand beside each other; siblings are matched at the cost of a vector
operation for each of them, and where two lists of siblings would make a table of over CELLS cells (some 2,000 alternating
siblings on both sides), likes are folded also where they do not follow each other. Clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import table, written
from semblance.llm.urls import with_host_path

#: Pages, other than copies of the reference, that a host needs before a node can be template, and before slots compete.
MIN_PAGES, ROOT_PAGES = 8, 3
#: Share of the pages with a node that must repeat its text for it to be template.
CONSTANT = 0.95
#: What sums of shares of pages may miss.
NEAR = 1e-6
#: Share of link text above which a slot is a menu.
LINKED = 0.6
#: Share of the varying text that a child must hold to be the content root, and what text counts inside of an article.
HOLDS, HINT = 0.75, 3.0
#: Pages of a batch that are parsed together.
PAGES = 500
#: Cells of a table of siblings.
CELLS = 1 << 22

#: Levels that a tree has at most; deeper elements stand beside each other on the last one.
DEPTH = 120

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as part of an article; and forms, which may be around a whole page.
SILENT = set("script style noscript template head iframe object svg math canvas audio video select option datalist textarea button input label fieldset legend map dialog title".split())
FORMS = {"form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that frame an article.
FRAME = set("nav footer aside menu header".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that close an open element of the kinds named.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Elements that a search for an open element does not leave.
SCOPES = set("table ul ol dl article section main div body html td th nav aside footer header blockquote form".split())
#: Words of class, id and role that name something beside the article.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|sidebar|side|menu|nav\w*|breadcrumbs?|footer|masthead|"
    r"comments?|respond|replies|disqus|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|popup|modal|overlay|login|search|widget|toolbar|"
    r"pagination|pager|skip|complementary|contentinfo|navigation|dialog|alertdialog)(?:$|[\s_-])", re.I)
BESIDE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header)(?:$|[\s_-])", re.I)


@dataclass
class Node:
    tag: str
    place: str = ""
    #: why its text may not be content: 2 never shown, 1 a name that hints so
    reason: int = 0
    article: bool = False
    beside: bool = False
    #: articles around and at this node: 1 for one, 2 for one inside of another
    within: int = 0
    #: texts (with whether they are in a link) and child nodes, in order
    order: list = field(default_factory=list)


class Builder(HTMLParser):
    """Blocks of a page as a tree; text of inline elements goes to the block around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open: list[Node] = [self.root]
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and len(self.open) > 1 and any(n.tag == tag for n in self.open):
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.handle_data(" ")
            return
        if tag == "a":
            self.links += 1
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")) if attrs else ""
        hidden = bool(attrs) and (any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs) or any(k == "style" and v and re.search(r"display\s*:\s*none", v, re.I) for k, v in attrs))
        hint = bool(named) and bool(BESIDE.search(named))
        if tag in INLINE and not (hint or hidden):
            return
        if tag not in INLINE:
            self._close(lambda n: n.tag == "p", SCOPES)
            if tag in CLOSES:
                self._close(lambda n: n.tag in CLOSES[tag], SCOPES - {"td", "th"} if tag in ("tr", "td", "th") else SCOPES)
        article = tag in ("article", "main") or any((k == "role" and v in ("main", "article")) or (k == "itemprop" and v == "articleBody") for k, v in attrs)
        above = self.open[-1]
        inside = above.within > 0
        soft = hint or tag in FORMS or (tag in FRAME and not (tag == "header" and inside)) or (bool(named) and bool(BESIDE_HEADER.search(named)) and not inside)
        node = Node(tag, named, 2 if hidden or tag in SILENT else int(soft), article, within=min(2, above.within + article))
        self._attach(node)
        self.open.append(node)

    def _attach(self, node: Node) -> None:
        self.open[min(len(self.open), DEPTH) - 1].order.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, found, scopes):
        for at in range(len(self.open) - 1, 0, -1):
            if found(self.open[at]):
                del self.open[at:]
                return
            if self.open[at].tag in scopes:
                return

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in VOID or tag in ("html", "body"):
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                if tag not in INLINE:
                    self.links = 0
                return
            if self.open[at].tag in SCOPES and tag in INLINE:
                return

    def handle_data(self, data):
        if len(self.open) > DEPTH and self.open[DEPTH - 1].order[-1] is not self.open[-1]:
            # text after a deeper element: what it belongs to goes on as a further node
            old = self.open[-1]
            self.open[-1] = Node(old.tag, old.place, old.reason, old.article, within=old.within)
            self._attach(self.open[-1])
        self.open[-1].order.append((data, self.links > 0))


@dataclass
class Block:
    """A run of text between block boundaries."""

    text: str
    linked: int
    node: Node


@dataclass
class Fold:
    """A run of like siblings; its blocks are those of the run, in order."""

    sign: str
    nodes: list[Node]
    blocks: list[Block] = field(default_factory=list)
    children: list[Fold] = field(default_factory=list)
    index: int = -1
    #: the first index behind the subtree
    end: int = -1
    #: equal for subtrees of equal structure
    shape: int = 0
    size: int = 1


def parse(html: str | None) -> Node:
    """The tree of a page, with what is beside the article marked."""
    b = Builder()
    if html:
        b.feed(html)
        b.close()
    shown: dict[int, int] = {}
    holds: dict[int, bool] = {}

    def measure(n: Node) -> tuple[int, bool]:
        size, article = 0, n.article
        for x in n.order:
            if isinstance(x, Node):
                more, found = measure(x)
                size, article = size + more, article or found
            else:
                size += len(x[0])
        if n.reason == 2:
            size, article = 0, False
        shown[id(n)], holds[id(n)] = size, article
        return size, article

    total = measure(b.root)[0]

    def mark(n: Node, beside: bool) -> None:
        # a hint on what holds the article or most of the page is not taken
        n.beside = beside or n.reason == 2 or (n.reason == 1 and not holds[id(n)] and 2 * shown[id(n)] <= total)
        for x in n.order:
            if isinstance(x, Node):
                mark(x, n.beside)

    mark(b.root, False)
    return b.root


def _sign(n: Node) -> str:
    return f"{n.tag}|{n.place}"


def _shape(n: Node) -> tuple:
    return n.tag, n.place, n.beside, frozenset(x.tag for x in n.order if isinstance(x, Node))


def blocks_of(node: Node) -> list:
    """Blocks of the node's own text, and its child nodes, in order; text is split where child nodes stand."""
    out, run = [], []

    def end():
        text = " ".join("".join(t for t, _ in run).split())
        if text:
            out.append(Block(text, sum(len(t.strip()) for t, link in run if link), node))
        run.clear()

    for x in node.order:
        if isinstance(x, Node):
            if run:
                end()
            out.append(x)
        else:
            run.append(x)
    if run:
        end()
    return out


def fold(root: Node) -> tuple[Fold, list[tuple[Block, Fold]]]:
    """The folded tree, and the blocks of the page in page order with the fold that each is in. Likes are siblings of the
    same sign, tags of children and standing that follow each other."""
    counter = [0]
    where: dict[int, Fold] = {}

    def of(nodes: list[Node]) -> Fold:
        f = Fold(_sign(nodes[0]), nodes, index=counter[0])
        counter[0] += 1
        below: list[Node] = []
        for n in nodes:
            where[id(n)] = f
            parts[id(n)] = blocks_of(n)
            for x in parts[id(n)]:
                if isinstance(x, Block):
                    f.blocks.append(x)
                else:
                    below.append(x)
        run: list[Node] = []
        like = None
        for n in below:
            own = _shape(n)
            if run and own != like:
                f.children.append(of(run))
                run = []
            run.append(n)
            like = own
        if run:
            f.children.append(of(run))
        f.end = counter[0]
        f.shape = hash((f.sign, *(c.shape for c in f.children)))
        f.size += sum(c.size for c in f.children)
        return f

    parts: dict[int, list] = {}
    top = of([root])

    def read(n: Node) -> Iterator[tuple[Block, Fold]]:
        for x in parts[id(n)]:
            if isinstance(x, Block):
                yield x, where[id(n)]
            else:
                yield from read(x)

    return top, list(read(root))


def _merged(children: list[Fold]) -> list[Fold]:
    """Children with all likes folded together, each where the first of it stands."""
    by: dict[str, Fold] = {}
    for c in children:
        f = by.setdefault(c.sign, Fold(c.sign, [], index=c.index, end=c.end))
        f.nodes, f.blocks, f.children = f.nodes + c.nodes, f.blocks + c.blocks, f.children + c.children
    for f in by.values():
        f.size = 1 + sum(c.size for c in f.children)
        f.shape = hash((f.sign, *(c.shape for c in f.children)))
    return list(by.values())


def simple_tree_matching(a: Fold, b: Fold, known: dict | None = None) -> int:
    """Size of the largest match of two trees that keeps parents and the order of siblings. known: sizes by shapes."""
    if a.sign != b.sign:
        return 0
    if a.shape == b.shape:
        return a.size
    known = {} if known is None else known
    key = (a.shape, b.shape)
    if key not in known:
        known[key] = 1 + _siblings(a.children, b.children, known, None)
    return known[key]


def _siblings(xs: list[Fold], ys: list[Fold], known: dict, out: list | None) -> int:
    """Size of the largest match of two lists of siblings; its pairs are added to out. Equal siblings at both ends match each
    other, which no other match can better; the rest is a table, filled row by row."""
    low, total = 0, 0
    while low < min(len(xs), len(ys)) and xs[low].shape == ys[low].shape:
        total += xs[low].size
        if out is not None:
            out.append((xs[low], ys[low]))
        low += 1
    high = 0
    while high < min(len(xs), len(ys)) - low and xs[-1 - high].shape == ys[-1 - high].shape:
        total += xs[-1 - high].size
        if out is not None:
            out.append((xs[-1 - high], ys[-1 - high]))
        high += 1
    xs, ys = xs[low : len(xs) - high], ys[low : len(ys) - high]
    if not xs or not ys:
        return total
    if len(xs) * len(ys) > CELLS:
        xs, ys = _merged(xs), _merged(ys)
    # equal shapes share a row or column of weights
    kinds_x, kinds_y = ({s: i for i, s in enumerate(dict.fromkeys(z.shape for z in zs))} for zs in (xs, ys))
    of_x, of_y = ({z.shape: z for z in zs} for zs in (xs, ys))
    weight = np.array([[simple_tree_matching(of_x[p], of_y[q], known) for q in kinds_y] for p in kinds_x], dtype=np.int32)
    rows = weight[[kinds_x[x.shape] for x in xs]][:, [kinds_y[y.shape] for y in ys]]
    best = np.zeros((len(xs) + 1, len(ys) + 1), dtype=np.int32)
    for i in range(len(xs)):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + rows[i]), out=best[i + 1, 1:])
    if out is not None:
        i, j, found = len(xs), len(ys), []
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((xs[i], ys[j]))
        out += reversed(found)
    return total + int(best[-1, -1])


def matched(a: Fold, b: Fold) -> dict[int, int]:
    """Index in a: index in b, of the pairs of the largest match."""
    known: dict = {}
    pairs, todo = {}, [(a, b)] if a.sign == b.sign else []
    while todo:
        x, y = todo.pop()
        pairs[x.index] = y.index
        _siblings(x.children, y.children, known, todo)
    return pairs


def _each(f: Fold) -> Iterator[Fold]:
    yield f
    for c in f.children:
        yield from _each(c)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


@lru_cache(maxsize=20_000)
def _below(path: int, sign: str) -> int:
    return -2 - (_hash(f"{path} {sign}") >> 1)


def _paths(f: Fold, above: int = 0) -> Iterator[tuple[int, Fold]]:
    """Each node with the key of its path, which is negative, unlike the number of a reference node."""
    own = _below(above, f.sign)
    yield own, f
    for c in f.children:
        yield from _paths(c, own)


@lru_cache(maxsize=64)
def _reference(html: str) -> tuple[Fold, frozenset[int]]:
    f = fold(parse(html))[0]
    return f, frozenset(p for p, _ in _paths(f))


BLOCKS = "array<struct<node: int, anchor: int, path: long, known: boolean, text: string, linked: int, beside: boolean, within: int, first: array<boolean>>>"


def aligned(html: str | None, reference: str | None) -> list[tuple]:
    """Blocks of a page: reference node (-1: none), the nearest one at or above it, path and whether the reference has that,
    text, characters in links, flags, and whether it is the page's first of its path, of that with its text, of its node,
    and of that with its text."""
    if not html:
        return []
    f, found = fold(parse(html))
    path_of = {x.index: p for p, x in _paths(f)}
    ref, known = _reference(reference) if reference else (None, frozenset())
    to = matched(f, ref) if ref else {}
    anchor: dict[int, int] = {}

    def anchored(x: Fold, above: int) -> None:
        anchor[x.index] = own = to.get(x.index, above)
        for c in x.children:
            anchored(c, own)

    anchored(f, -1)
    seen: set = set()

    def first(*key) -> bool:
        new = key not in seen
        seen.add(key)
        return new

    out = []
    for b, x in found:
        node, path = to.get(x.index, -1), path_of[x.index]
        marks = [first(path), first(path, b.text), first(node), first(node, b.text)]
        out.append((node, anchor[x.index], path, path in known, b.text, b.linked, b.node.beside, b.node.within, marks))
    return out


def content_root(reference: str, mass: dict[int, float]) -> tuple[int, int]:
    """First index and end of the part of the reference that holds the varying text; mass: that of its nodes."""
    f = _reference(reference)[0]
    held = {x.index: max(0.0, mass.get(x.index, 0.0)) * (HINT if any(n.within for n in x.nodes) else 1.0) for x in _each(f)}
    total = lambda x: sum(held[i] for i in range(x.index, x.end))
    whole = total(f)
    while whole > 0 and not any(n.within for n in f.nodes):
        best = max(f.children, key=total, default=None)
        if best is None or not best.children or total(best) < HOLDS * whole:
            break
        at = first = f.children.index(best)
        while first and f.children[first - 1].nodes[0].tag in HEADINGS:
            first -= 1
        if first < at:
            return f.children[first].index, best.end
        f = best
    return f.index, f.end


def induce(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages with their aligned blocks, and one row for each host: template, menus and content root."""
    order = F.xxhash64(F.coalesce("html", F.lit("")))
    full = pages.where(F.length("html") > 0)
    refs = written(full.groupBy("host").agg(F.min_by("html", F.struct(order, "html")).alias("reference")), "html-references")
    copied = written(full.groupBy("host", F.xxhash64("html").alias("key")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "html-copies")
    joined = pages.withColumn("key", F.xxhash64("html")).join(copied, ["host", "key"], "left").join(refs, "host", "left")

    def align(batches):
        for b in batches:
            for at in range(0, len(b), PAGES):
                part = b.iloc[at : at + PAGES]
                blocks = [aligned(h, r) for h, r in zip(part["html"], part["reference"], strict=True)]
                yield pd.DataFrame({c: part[c] for c in ("known_id", "page_id", "url", "host", "copies")} | {"copy": part["html"] == part["reference"], "blocks": blocks})

    # a column with nulls would reach pandas as floats, which round large ids
    rows = joined.select(F.col("page_id").isNotNull().alias("known_id"), F.coalesce("page_id", F.lit(0)).cast("long").alias("page_id"), "url", "host", F.coalesce("copies", F.lit(1)).alias("copies"), "html", "reference")
    read = written(rows.mapInPandas(align, f"known_id boolean, page_id long, url string, host string, copies long, copy boolean, blocks {BLOCKS}"), "html-blocks")

    def vote(key: str, at: int):
        """A block's vote for its node or path: what it adds to the pages that have it, and to those that repeat its text."""
        return lambda b: F.struct(b[key].cast("long").alias("node"), F.xxhash64(b["text"]).alias("hash"), b["first"][at].alias("any"), b["first"][at + 1].alias("same"),
                                  F.when(b["beside"], 0).otherwise(F.length(b["text"])).alias("chars"), F.when(b["beside"], 0).otherwise(b["linked"]).alias("linked"))

    by_node = F.transform(F.filter("blocks", lambda b: (b["node"] >= 0) & ~F.col("copy")), vote("node", 2))
    votes = read.select("host", (1 / F.col("copies")).alias("share"), F.explode(F.concat(F.transform("blocks", vote("path", 0)), by_node)).alias("v")).select("host", "share", "v.*")
    # a copy has its share of the vote of a page
    share = lambda c: F.sum(F.col("share") * F.col(c).cast("int")).alias(c)
    of_text = votes.groupBy("host", "node", "hash").agg(*map(share, ("any", "same", "chars", "linked")))
    often = F.when(F.col("same") > CONSTANT * MIN_PAGES - NEAR, F.struct("hash", "same", (F.col("chars") - F.col("linked")).alias("fixed")))
    nodes = written(of_text.groupBy("host", "node").agg(F.sum("any").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.collect_list(often).alias("texts")), "html-counts")
    enough = F.col("n") > F.when(F.col("node") < 0, MIN_PAGES + 1).otherwise(MIN_PAGES) - NEAR  # the reference has its own part in paths
    nodes = nodes.withColumn("texts", F.filter("texts", lambda t: enough & (t["same"] > CONSTANT * F.col("n") - NEAR)))
    fixed = nodes.select("host", "node", F.explode("texts").alias("t"))
    template = fixed.groupBy("host").agg(F.collect_list(F.struct("node", F.col("t.hash").alias("hash"))).alias("template"))
    menus = nodes.groupBy("host").agg(F.collect_list(F.when((F.col("linked") > LINKED * F.col("chars")) & enough, F.col("node"))).alias("menus"))
    constant = F.aggregate("texts", F.lit(0.0), lambda total, t: total + t["fixed"])
    varying = nodes.where((F.col("node") >= 0) & (F.col("n") > ROOT_PAGES - NEAR))
    mass = varying.groupBy("host").agg(F.collect_list(F.struct("node", (F.col("chars") - F.col("linked") - constant).alias("mass"))).alias("mass"))

    def root(batches):
        for b in batches:
            got = [content_root(r, {m["node"]: m["mass"] for m in ms}) for r, ms in zip(b["reference"], b["mass"], strict=True)]
            yield pd.DataFrame({"host": b["host"], "first": [x for x, _ in got], "end": [x for _, x in got]})

    roots = refs.join(mass, "host").mapInPandas(root, "host string, first int, end int")
    return read, written(refs.select("host").join(menus, "host", "left").join(template, "host", "left").join(roots, "host", "left"), "html-wrappers")


def chosen(read: DataFrame, wrappers: DataFrame) -> DataFrame:
    """The text of each page: its blocks that are neither beside nor template nor menu, under the content root if any are."""
    both = read.join(wrappers, "host", "left")
    none = F.array().cast("array<struct<node: bigint, hash: bigint>>")
    template, menus = F.coalesce("template", none), F.coalesce("menus", F.array().cast("array<bigint>"))

    def varies(b):
        item = lambda k: F.array_contains(template, F.struct(b[k].cast("long").alias("node"), F.xxhash64(b["text"]).alias("hash")))
        menu = F.array_contains(menus, b["node"].cast("long")) | (F.array_contains(menus, b["path"]) & ~b["known"])
        return ~b["beside"] & ~((F.size(template) > 0) & (item("node") | item("path"))) & ~menu

    rooted = both.withColumn("kept", F.filter("blocks", varies))
    inside = F.filter("kept", lambda b: (b["anchor"] >= F.col("first")) & (b["anchor"] < F.col("end")))
    rooted = rooted.withColumn("inside", F.coalesce(F.when(F.size(inside) > 0, inside), F.col("kept")))
    # an article inside of a main element is the narrower frame
    level = F.array_max(F.transform("inside", lambda b: b["within"]))
    texts = F.transform(F.filter("inside", lambda b: b["within"] == level), lambda b: b["text"])
    return rooted.select(F.when(F.col("known_id"), F.col("page_id")).alias("page_id"), "url", "host", F.array_join(texts, " ").alias("text"))


def main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html): page_id, url, host, text."""
    return chosen(*induce(with_host_path(pages.select("page_id", "url", "html")).drop("path")))


def hinted_text(html: str | None) -> str:
    """The text of one page by hints alone, as for a page that no alignment says anything about."""
    kept = [b for b, _ in fold(parse(html))[1] if not b.node.beside] if html else []
    level = max((b.node.within for b in kept), default=0)
    return " ".join(b.text for b in kept if b.node.within == level)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")
