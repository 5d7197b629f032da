"""Main text of a web page by tree scoring.

The page is read into a tree of structural elements (inline markup is transparent).
Every paragraph-like block gives points for its length and its commas to its ancestors,
less with each level, discounted by the share of its text that stands in links. The best
container is kept with those siblings that score near it or are prose of their own, and
with the headings, lists, quotes, tables and sections between them.

Forms and sections whose name tells that they are no part of the article are in doubt:
they are left out, unless the best container lies in one, which counts less. For that they
must hold most of the page's points or its only article. If nothing is found, the page is
read again without regard to names, then with menus and the like that never end as parts of
the page.

Menus, headers and the like are left out up to their end tag. One without an end tag ends where
an article begins or its parent ends. All sums along the tree are made once, bottom-up or
top-down, so that the work grows with the page, however deep its elements are nested.

Defined results: a null or empty page, or one without text outside menus and the like,
gives the empty text; unclosed, cut-off and misnested markup is read as browsers do for
paragraphs and lists; equal scores go to the container that comes first; pages of any
length are read whole; repeated rows are read each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import as_texts

#: Content of these is no text of the page.
SILENT = frozenset("script style noscript template iframe object svg math title textarea select option button input canvas audio video map datalist".split())
#: Sections that are never the article.
ASIDE = frozenset("nav header footer aside menu dialog".split())
#: Sections that are the article only if there is no other; what a score in one is worth.
DOUBTFUL = frozenset(("form", "fieldset"))
DOUBT = 0.25
#: Share of a section's text in links up to which it is prose.
MOST_LINKED = 0.25
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text where they begin and end.
BLOCK = frozenset("html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A new one of these ends an open one of the named kinds in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements past which an end tag or an implied end does not reach.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Words of class, id or role that mark a section as no part of the article, wherever they stand.
UNLIKELY = frozenset(
    "ad ads adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies cookiebar disqus disclaimer footer gdpr"
    " masthead menu modal nav navbar newsletter outbrain pager pagination popup sidebar sidebars subscribe subscription taboola toolbar complementary".split()
)
UNLIKELY_HEADS = ("advert", "navigation", "promo", "sponsor")
#: Words that do so alone or with others of these, with those above or with words of place and shape.
AMBIGUOUS = frozenset("foot header notice notices related replies reply respond search share sharing skip social teaser widget widgets".split())
SHAPES = frozenset(
    "area articles bar block bottom box button buttons container footer form global icons inner item items left link links list main news outer page panel posts"
    " primary right secondary section site stories to top wrap wrapper".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b|aria-hidden\s*=\s*[\"']?(true)|style\s*=\s*[\"'][^\"']*display\s*:\s*(none)", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "score", "text_len", "link_len", "order", "in_doubt", "in_article", "free")

    def __init__(self, name: str, parent: Node | None, order: int, in_doubt: bool = False) -> None:
        self.name, self.parent, self.order, self.in_doubt = name, parent, order, in_doubt
        self.in_article = name in ("article", "main") or parent is not None and parent.in_article
        self.free = not in_doubt and (parent is None or parent.free)  # nothing around it is in doubt
        self.children: list[Node | Block] = []
        self.score, self.text_len, self.link_len = 0.0, 0, 0


class Block:
    """A run of text between two block boundaries, with the share of it in links."""

    __slots__ = ("parent", "text", "linked")

    def __init__(self, parent: Node, text: str, linked: int) -> None:
        self.parent, self.text, self.linked = parent, text, linked


class Page:
    """The nodes, each after its parent, and the blocks in page order."""

    def __init__(self) -> None:
        self.nodes = [Node("html", None, 0)]
        self.blocks: list[Block] = []

    def add(self, name: str, parent: Node, in_doubt: bool) -> Node:
        node = Node(name, parent, len(self.nodes), in_doubt)
        parent.children.append(node)
        self.nodes.append(node)
        return node


class Tag(NamedTuple):
    """A tag and the text before it; the last one of a page has no name."""

    text: str
    name: str = ""
    end: bool = False
    attributes: str = ""


def hidden(attributes: str) -> bool:
    return any(m[5] or m[6] or m[7] for m in NAMED.finditer(attributes))


def unlikely(attributes: str) -> bool:
    return any(unlikely_name(token) for m in NAMED.finditer(attributes) for token in (m[2] or m[3] or m[4] or "").split())


def unlikely_name(token: str) -> bool:
    parts = [x.rstrip("0123456789") for x in re.split(r"[_-]", token.lower()) if x.strip("0123456789")]
    if any(x in UNLIKELY or x.startswith(UNLIKELY_HEADS) for x in parts):
        return True
    return any(x in AMBIGUOUS for x in parts) and all(x in AMBIGUOUS or x in SHAPES for x in parts)


def tags_of(html: str) -> list[Tag]:
    """The page's tags, without comments and without elements of raw text."""
    out: list[Tag] = []
    text: list[str] = []
    pos, size = 0, len(html)
    while pos < size:
        lt = html.find("<", pos)
        if lt < 0:
            text.append(html[pos:])
            break
        text.append(html[pos:lt])
        m = TOKEN.match(html, lt)
        if not m:
            text.append("<")
            pos = lt + 1
            continue
        pos = m.end()
        if m[2] is None:
            continue
        end, name = bool(m[1]), m[2].lower()
        if not end and name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, pos)
            pos = close.end() if close else size
            continue
        out.append(Tag("".join(text), name, end, m[3]))
        text = []
    out.append(Tag("".join(text)))
    return out


def with_end(tags: list[Tag]) -> set[int]:
    """Positions of the start tags that an end tag belongs to: the last open one of its name."""
    opened: dict[str, list[int]] = {}
    out = set()
    for i, tag in enumerate(tags):
        if not tag.end:
            opened.setdefault(tag.name, []).append(i)
        elif opened.get(tag.name):
            out.add(opened[tag.name].pop())
    return out


class Dropped:
    """A section that is left out, and the elements open in it, itself the first."""

    def __init__(self, name: str, ended: bool) -> None:
        self.name, self.ended = name, ended  # whether it has an end tag of its own
        self.names = [name]
        self.held = Counter(self.names)

    def goes_on(self, tag: Tag, opened: Counter) -> bool:
        """Whether a tag lies in the section; `opened`: elements open around it."""
        name = tag.name
        if tag.end:
            if self.held[name]:
                while True:
                    last = self.names.pop()
                    self.held[last] -= 1
                    if last == name:
                        return True
            return self.ended or not opened[name]
        if name == "main" and self.name in ASIDE or not self.ended and self.cut_by(name):
            return False
        if name in VOID or tag.attributes.rstrip().endswith("/") or not (name in BLOCK or name in SILENT or name == self.name):
            return True
        last = self.names[-1]
        if name in ENDS and last in ENDS[name] or last == "p" and name in BLOCK and len(self.names) > 1:
            self.held[self.names.pop()] -= 1
        self.names.append(name)
        self.held[name] += 1
        return True

    def cut_by(self, name: str) -> bool:
        """Whether a section without an end tag ends where this element begins."""
        alone = len(self.names) == 1
        inline = self.name not in BLOCK and self.name not in SILENT
        return name in ("article", "main") or name in BLOCK and (inline or alone and self.name == "p") or alone and name in ENDS and self.name in ENDS[name]


def parse(html: str, by_name: bool = True, open_asides: bool = False) -> Page:
    """The tree of structural elements without silent, hidden and aside parts, and its blocks
    in page order; `by_name`: names put sections in doubt; `open_asides`: menus and the like
    without an end tag are read as other sections."""
    page = Page()
    root = at = page.nodes[0]
    opened: Counter = Counter()  # names of the elements open around, but for the root
    run: list[str] = []
    links: list[str] = []
    in_link = 0
    dropped: Dropped | None = None

    def flush() -> None:
        nonlocal run, links
        if run:
            text = SPACE.sub(" ", unescape("".join(run))).strip()
            if text:
                linked = len(SPACE.sub(" ", unescape("".join(links))).strip())
                block = Block(at, text, linked)
                at.children.append(block)
                page.blocks.append(block)
            run, links = [], []

    def leave(to: Node) -> None:
        nonlocal at
        while at is not to:
            opened[at.name] -= 1
            at = at.parent

    tags = tags_of(html)
    ended = with_end(tags)
    for i, tag in enumerate(tags):
        name = tag.name
        if tag.text and dropped is None:
            run.append(tag.text)
            if in_link:
                links.append(tag.text)
        if dropped is not None:
            if dropped.goes_on(tag, opened):
                if not dropped.names:
                    dropped = None
                continue
            dropped = None
        if name == "br":
            run.append(" ")
        elif name == "a" and (tag.end or not hidden(tag.attributes)):
            in_link = 0 if tag.end else 1
        elif name in BLOCK or name in SILENT:
            if name in BLOCK:
                flush()
            if tag.end:
                if opened[name]:
                    node = at
                    while node.name != name:
                        node = node.parent
                    leave(node.parent)
                continue
            if name in BLOCK:
                if name in ENDS and any(opened[x] for x in ENDS[name]):
                    node = at
                    while node is not root and node.name not in ENDS[name] and node.name not in SCOPE.get(name, ()):
                        node = node.parent
                    if node is not root and node.name in ENDS[name]:
                        leave(node.parent)
                while at.name == "p":
                    leave(at.parent)
            if name in VOID:
                continue
            whole = name in ("html", "body", "article", "main")
            aside = name in ASIDE and not (open_asides and i not in ended)
            if aside or name in SILENT or not whole and hidden(tag.attributes):
                flush()
                dropped = Dropped(name, i in ended)
                continue
            if name in ("html", "body") and opened[name]:
                continue
            at = page.add(name, at, not whole and by_name and (name in DOUBTFUL or unlikely(tag.attributes)))
            opened[name] += 1
            in_link = 0
        elif name and not tag.end and tag.attributes and name not in VOID and hidden(tag.attributes) and not tag.attributes.rstrip().endswith("/"):
            dropped = Dropped(name, i in ended)
    flush()
    return page


def ancestors(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def points_of(block: Block) -> float:
    return (1 + block.text.count(",") + min(len(block.text) / 100, 3)) * (1 - block.linked / len(block.text) if block.linked <= len(block.text) else 0)


def believed(page: Page) -> set[int]:
    """Sections in doubt that may hold the article nevertheless: those with most of the
    page's points, if no article outside such sections has a tenth of theirs, and those with
    an article, if none lies outside. Sections with both are in doubt no more."""
    points = [0.0] * len(page.nodes)
    filled = [False] * len(page.nodes)  # with text
    articles = [False] * len(page.nodes)  # an article with text at or below it
    total = outside = 0.0
    for b in page.blocks:
        own = points_of(b)
        total += own
        points[b.parent.order] += own
        filled[b.parent.order] = True
        if b.parent.in_article and b.parent.free:
            outside += own
    for node in reversed(page.nodes):
        k = node.order
        articles[k] = articles[k] or filled[k] and node.name in ("article", "main")
        if node.parent is not None:
            up = node.parent.order
            points[up] += points[k]
            filled[up] = filled[up] or filled[k]
            articles[up] = articles[up] or articles[k]
    doubted = [n.order for n in page.nodes if n.in_doubt and filled[n.order]]
    most = {k for k in doubted if 2 * points[k] > total and points[k] > 10 * outside}
    if outside:
        return most
    with_article = {k for k in doubted if articles[k]}
    for k in most & with_article:
        page.nodes[k].in_doubt = False
    return most | with_article


def extract(html: str) -> str:
    """The article's blocks joined by newlines."""
    return read(parse(html)) or read(parse(html, by_name=False)) or read(parse(html, by_name=False, open_asides=True))


def read(page: Page) -> str:
    may = believed(page)
    nodes = page.nodes
    banned = [False] * len(nodes)
    doubts = [0] * len(nodes)  # sections in doubt at or around a node
    for node in nodes:
        above = node.parent.order if node.parent else None
        banned[node.order] = above is not None and banned[above] or node.in_doubt and node.order not in may
        doubts[node.order] = node.in_doubt + (doubts[above] if above is not None else 0)
    candidates: dict[int, Node] = {}
    whole = [[0, 0] for _ in nodes]  # length and linked length of all text below
    for b in page.blocks:
        own = b.parent
        if banned[own.order]:
            continue
        whole[own.order][0] += len(b.text)
        whole[own.order][1] += b.linked
        holds = own.name in ("p", "pre", "td", "blockquote") or own.name[:1] == "h" and own.name[1:].isdigit()
        start = own.parent if holds and own.parent and not own.in_doubt else own
        start.text_len += len(b.text)
        start.link_len += b.linked
        points = points_of(b)
        for depth, node in zip(range(5), ancestors(start)):
            node.score += points / (1 if depth == 0 else 2 * depth)
            candidates[node.order] = node
            if node.in_doubt:  # nothing for what lies around it
                break
    if not candidates:
        return ""
    for node in reversed(nodes):
        if node.parent is not None and not node.in_doubt:
            node.parent.text_len += node.text_len
            node.parent.link_len += node.link_len
            for i in (0, 1):
                whole[node.parent.order][i] += whole[node.order][i]
    value = {n.order: n.score * (1 - min(1.0, n.link_len / max(1, n.text_len))) * DOUBT ** doubts[n.order] for n in candidates.values()}
    best = max(candidates.values(), key=lambda n: (value[n.order], -n.order))
    for node in ancestors(best):  # a part of an article stands for all of it
        if node.name in ("article", "main"):
            best = node
            break
    kept = {best.order}
    loose: set[int] = set()  # kept blocks beside the kept containers
    if best.name not in ("article", "main") and best.parent is not None and not best.in_doubt:
        siblings = best.parent.children
        headings = ("h1", "h2", "h3", "h4", "h5", "h6")

        def plain(x: Node | Block) -> bool:
            size, linked = (len(x.text), x.linked) if isinstance(x, Block) else whole[x.order]
            return linked <= MOST_LINKED * size

        def stands(x: Node | Block) -> bool:
            if isinstance(x, Block) or x.in_doubt:
                return False
            near = value.get(x.order, 0) >= max(10.0, 0.2 * value[best.order])
            part = best.name == x.name == "section" or x.name == "p" and whole[x.order][0]
            return x is best or near or x.name == "h1" or part and plain(x)

        at = [i for i, x in enumerate(siblings) if stands(x)]
        first, last = at[0], at[-1]
        kept.update(siblings[i].order for i in at)
        while first and isinstance(x := siblings[first - 1], Node) and x.name in headings and not x.in_doubt:
            first -= 1
            kept.add(x.order)
        for x in siblings[first : last + 1]:
            if isinstance(x, Block):
                if plain(x):
                    loose.add(id(x))
            elif not x.in_doubt and plain(x):
                kept.add(x.order)
    elif best.name == "article" and best.parent is not None:
        for sibling in best.parent.children:
            if isinstance(sibling, Node) and sibling.name == "article" and value.get(sibling.order, 0) >= 0.2 * value.get(best.order, 0):
                kept.add(sibling.order)
    around = {n.order for n in ancestors(best)}
    inside, out_of_way = [False] * len(nodes), [False] * len(nodes)
    for node in nodes:
        k, up = node.order, node.parent.order if node.parent else None
        inside[k] = k in kept or up is not None and inside[up]
        out_of_way[k] = node.in_doubt and k not in around or up is not None and out_of_way[up]
    return "\n".join(b.text for b in page.blocks if (id(b) in loose or inside[b.parent.order]) and not out_of_way[b.parent.order])


def main_text(html: Column) -> Column:
    """Column of the main text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(h) for h in as_texts(batch)], dtype=object)

    return run(html)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text)."""
    found = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), main_text(F.col(html)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
