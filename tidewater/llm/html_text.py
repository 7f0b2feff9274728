"""Main text of a web page by tree scoring.

The page is read into a tree (end tags that authors leave out are implied, cut-off pages
end where they end). Each paragraph passes points for its length and commas to its ancestors, half
as many at each step up, less its share of link text; the best container is kept together with
those of its siblings that score near it or read like running text.

Names in class and id mark furniture. A name made of furniture words only (``share-buttons``, ``cookie_notice``, ``ad``) drops its element. One that holds
such a word beside others (``share-price``, ``notice-period``) drops it only if its text does not read like an article's: under 2 points of the same kind, or, in
an article, mostly links. A list of links is a menu, except in an article, where it may be its sources.

Edge cases: null, empty or text-free pages give ''; markup that does not parse as a tag is
text; very deep trees are walked without recursion; repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|(?=<)|\Z)", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Fixed values of HTML: elements without content, raw text, block level, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}

#: Elements, roles and words of class or id that mark what is not the article.
DROP = frozenset("aside button canvas dialog embed footer form head iframe input label menu nav noscript object search select audio video".split()) | (RAW - {"svg", "math"}) | {"svg", "math"}
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words that stand beside those without a meaning of their own.
PLAIN_WORDS = frozenset(
    "a area bar block body bottom box btn button buttons close col column container content desktop el first float form group head header heading icon icons inline inner is item items js last left line link links list main message mobile module outer page panel right row section site slot small sticky strip tab tabs text the title top unit wide wrap wrapper zone".split()
)
DROP_STEMS = re.compile("advert|breadcrumb|comments?(?!ar)|cookie|disclaimer|disqus|footer|navbar|navigation|newsletter|popup|sidebar|sponsor|subscri")
LAYOUT_WORDS = frozenset("has layout no with without".split())  # "with-sidebar" is said of what stands beside one
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote".split())  # pass their points on whole
GOOD_WORDS = frozenset("article body content entry main page post story text".split())


class Node:
    __slots__ = ("article", "children", "furniture", "hints", "kept", "link", "links", "parent", "role", "score", "size", "tag", "whole")

    def __init__(self, tag: str, parent: Node | None, hints: frozenset = frozenset(), role: str = "", furniture: int = 0) -> None:
        self.tag, self.parent, self.hints, self.role = tag, parent, hints, role
        self.furniture = furniture  # 2: a name says so; 1: a part of a name does
        self.article = tag == "article" or parent is not None and parent.article  # stands in an article
        self.children: list[Node | str] = []
        self.score, self.size, self.link, self.links = 0.0, 0, 0, 0
        self.kept = False
        self.whole = False  # holds an article, main or top heading


def _furniture(name: str) -> int:
    """2 for a name of furniture words only, 1 for one that has such words, else 0."""
    own = [w.lower() for w in WORD.findall(name)]
    marked = [w for w in own if w in DROP_WORDS or DROP_STEMS.match(w)]
    if marked:
        return 2 if all(w in marked or w in PLAIN_WORDS for w in own) else 1
    return 2 * bool(DROP_STEMS.match(name.lower().replace("-", "").replace("_", "")))


def _attributes(text: str) -> tuple[frozenset, str, int]:
    if "=" not in text and "hidden" not in text:
        return frozenset(), "", 0
    words: set[str] = set()
    role, furniture = "", 0
    for m in ATTR.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words.update(w.lower() for w in WORD.findall(value))
            furniture = max([furniture, *map(_furniture, value.split())])
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            role = role or "hidden"
    return frozenset(words), role, 0 if words & LAYOUT_WORDS else furniture


def parse(page: str) -> Node:
    root = Node("#root", None)
    at, pos = root, 0
    open_nodes = [root]
    open_tags: defaultdict[str, list[int]] = defaultdict(list)  # where each tag's open elements stand among all open ones

    def close(to: int) -> None:
        nonlocal at
        while len(open_nodes) > to:
            open_tags[open_nodes.pop().tag].pop()
        at = open_nodes[-1]

    def outermost(tags: tuple[str, ...], stop: tuple[str, ...]) -> int | None:
        """Where the first open element of these tags stands inside the last open one of ``stop``."""
        inside = max((open_tags[t][-1] for t in stop if open_tags[t]), default=0)
        return min((open_tags[t][i] for t in tags if (i := bisect(open_tags[t], inside)) < len(open_tags[t])), default=None)

    for m in iter(lambda: TOKEN.search(page, pos), None):
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag]:
                close(open_tags[tag][-1])
            continue
        if tag in BLOCK and open_tags["p"] and (i := outermost(("p",), ("table", "button", "td", "th"))):
            close(i)
        if tag in CLOSES and (i := outermost(CLOSES[tag], SCOPE[tag])):
            close(i)
        node = Node(tag, at, *_attributes(m[3]))
        at.children.append(node)
        if tag in VOID or m[3].endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        at = node
        open_tags[tag].append(len(open_nodes))
        open_nodes.append(node)
    if pos < len(page):
        at.children.append(page[pos:])
    return root


def _order(root: Node) -> list[Node]:
    """Nodes, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(c for c in n.children if isinstance(c, Node))
    return out


def _reading(nodes: list[Node]) -> dict[int, tuple[int, int, int]]:
    """Characters, those within links, and commas below each node; nodes: parents first."""
    out: dict[int, tuple[int, int, int]] = {}
    for n in reversed(nodes):
        own = [(len(c.strip()), 0, c.count(",")) if isinstance(c, str) else out[id(c)] for c in n.children]
        size, link, commas = (sum(x[i] for x in own) for i in range(3))
        out[id(n)] = (size, size if n.tag == "a" else link, commas)
    return out


def _prune(root: Node) -> list[Node]:
    """Take away what is never part of the article; nodes left, parents first."""
    nodes = _order(root)
    for n in reversed(nodes):
        if n.tag in ("article", "main") and not n.furniture or any(isinstance(c, Node) and c.whole for c in n.children):
            n.whole = True
    reading = _reading(nodes) if any(n.furniture == 1 for n in nodes) else {}

    def outweighed(c: Node) -> bool:
        """Whether its text reads like an article's, whatever a part of its name says."""
        size, link, commas = reading[id(c)]
        if c.article and c.tag in PARAGRAPH:
            return link <= 0.5 * size
        return size > 0 and (1 + commas + min(size / 100, 3)) * (1 - link / size) >= 2

    inside: dict[int, bool] = {}
    for n in nodes:
        inside[id(n)] = n.tag in ("article", "main") or n.parent is not None and inside[id(n.parent)]
        kept = []
        for c in n.children:
            if isinstance(c, Node):
                named = c.tag not in ("html", "body") and (c.furniture == 2 or c.furniture == 1 and not outweighed(c))
                bad = c.tag in DROP or c.role in DROP_ROLES or c.role == "hidden" or named
                if c.tag == "header" or "header" in c.hints and c.tag == "div":
                    if not inside[id(n)]:
                        bad = True
                    elif c.tag == "header":  # of an article's own header, the headings stay
                        c.children = [x for x in c.children if isinstance(x, Node) and re.fullmatch("h[1-6]|hgroup|div", x.tag)]
                if bad and not (c.whole and c.tag not in DROP and c.role != "hidden"):
                    continue
            kept.append(c)
        n.children = kept
    return _order(root)


def _squeeze(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _blocks(n: Node) -> Iterator[tuple[Node, str, int]]:
    """Runs of text not broken by a block-level element: (element, text, characters within links)."""
    parts: list[str] = []
    linked: list[str] = []
    todo: list[tuple[Node | str, Node | None, int]] = [(n, None, 0)]
    owner = n
    out: list[tuple[Node, str, int]] = []

    def flush() -> None:
        if parts:
            if text := _squeeze(parts):
                out.append((owner, text, len(_squeeze(linked))))
            parts.clear()
            linked.clear()

    while todo:
        x, within, depth = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            if depth:
                linked.append(x)
        elif within is not None:  # the end of an element
            if x.tag in BLOCK or x is n:
                flush()
                owner = within
        elif x.tag == "br":
            parts.append(" ")
        else:
            if x.tag in BLOCK or x is n:
                flush()
                todo.append((x, owner, 0))
                owner = x
            todo.extend((c, None, depth + (x.tag == "a")) for c in reversed(x.children))
    return iter(out)


def main_text(page: str | None) -> str:
    """Blocks of the article in page order, one to a line."""
    if not page:
        return ""
    root = parse(page)
    nodes = _prune(root)
    blocks = list(_blocks(root))
    if not blocks:
        return ""
    for owner, text, linked in blocks:
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        (owner if owner.tag not in PARAGRAPH else owner.parent or owner).score += points
        owner.size += len(text)
        owner.link += linked
        owner.links += linked > 0
    for n in reversed(nodes):  # children before parents
        if n.parent is not None:
            n.parent.score += n.score / 2
            n.parent.size += n.size
            n.parent.link += n.link
            n.parent.links += n.links
    root.score = 0.0
    best, top = root, -1.0
    for n in nodes:
        if n.size and n.tag in BLOCK and n.tag not in ("html", "head", "p") or n is root:
            n.score += {"article": 40, "main": 30, "section": 3, "div": 3}.get(n.tag, 0) + 15 * bool(n.hints & GOOD_WORDS) - (n is root or n.tag == "body")
            n.score *= 1 - n.link / max(n.size, 1)
            if n.score > top:
                best, top = n, n.score
    keep = {id(best)}
    for s in best.parent.children if best.parent is not None else ():
        if isinstance(s, Node) and s is not best and s.size and s.tag in BLOCK:
            density = s.link / s.size
            running = s.tag == "p" and (s.size > 80 and density < 0.25 or density == 0)
            if running or s.tag == best.tag and s.score >= max(10.0, top / 5) and density < 0.25:
                keep.add(id(s))
    menus = {id(n) for n in nodes if n.tag in ("ul", "ol", "div", "table", "section", "dl") and n.links >= 3 and n.link > 0.5 * n.size and n is not best and not n.article}
    for n in nodes:  # parents before children
        n.kept = id(n) not in menus and (id(n) in keep or n.parent is not None and n.parent.kept)
    return "\n".join(text for owner, text, _ in blocks if owner.kept)


@F.pandas_udf(T.StringType())
def _main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in pages:
        yield s.map(main_text, na_action=None)


def extract(page: Column) -> Column:
    """The main text of a column of HTML."""
    return _main_text(page)
