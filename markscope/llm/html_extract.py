"""Main text of web pages by tree scoring.

The page becomes a tree of block elements. Each paragraph (a run of text between block boundaries) earns
points for its length and its commas and passes them to its ancestors, the nearest most. Points are
discounted by link density. The best container is kept with those siblings that score well by
themselves; parts of it that are menus, headers, footers, sidebars, notices, adverts, forms or reader
comments, by tag, role, class or id, or that consist mostly of links, are left out.

Cases: a null or empty page, and one without text, gives an empty string; unclosed and stray tags, a
page that breaks off inside a tag, and upper-case tags are accepted; a "<" that starts no tag is text;
character references are decoded after tags have been taken out; no text is dropped or capped by
length; pages are rows, so repeated pages give repeated rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import pick

# Element names of the HTML standard by what they do here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BREAKS = frozenset(["br", "hr"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg math select option button head noframes xmp canvas audio video".split())
#: Among them those whose content may hold no tags.
OPAQUE = frozenset("script style textarea title iframe noframes xmp".split())
CLOSES_P = BLOCKS
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark what is no article.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-social comment comments commentlist "
    "consent cookie cookies disclaimer disqus dropdown footer footnav gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promotion recommended related "
    "replies reply respond rail search share sharing shoutbox sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subscribe "
    "subscription taboola tags toolbar topbar tweet widget widgets alert author-bio".split()
)
#: Words of a class or id beside which "header" is the article's own.
ARTICLE_WORDS = frozenset(["article", "post", "entry", "story"])
NEVER_DROPPED = frozenset(["html", "body", "main", "article"])
BONUS = {"article": 40.0, "main": 30.0, "section": 3.0, "div": 3.0, "body": 0.0, "html": -10.0, "td": 2.0, "blockquote": 2.0, "pre": 2.0, "li": -3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "form": -5.0}
#: Share of link characters from which a list, table or division is a menu.
MENU_DENSITY = 0.5
#: Share of the best score from which a sibling is kept.
SIBLING_SHARE = 0.2

_TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<decl>[!?])|(?P<close>/)?(?P<name>[a-zA-Z][^\s/><]*))")
_ATTRS = re.compile(r"""(?>[^>"']++|"[^"]*"|'[^']*')*+>""")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_SPLIT = re.compile(r"[^0-9a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "score", "chars", "links")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False):
        self.tag, self.parent, self.drop = tag, parent, drop
        #: Nodes, and paragraphs as (text, characters in links).
        self.children: list = []
        self.score, self.chars, self.links = 0.0, 0, 0


def _is_boilerplate(tag: str, attrs: str) -> bool:
    if tag in BOILERPLATE_TAGS:
        return True
    if tag in NEVER_DROPPED or tag == "h1" or not attrs:
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in BOILERPLATE_ROLES:
            return True
        if name in ("class", "id"):
            for part in value.split():
                found = {part, *_SPLIT.split(part)}
                marks = found & BOILERPLATE_WORDS
                if marks and not (marks == {"header"} and found & ARTICLE_WORDS):
                    return True
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attrs))


def parse(page: str) -> Node:
    """The tree of the page's block elements."""
    root = node = Node("html", None)
    pieces: list[str] = []
    linked = 0
    in_link = False
    pos, n = 0, len(page)
    last_close: dict[str, int] = {}

    def closes(tag: str) -> bool:
        """Whether an end tag follows; looked up once a tag name, so that unclosed ones cost no search each."""
        if tag not in last_close:
            last_close[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", page, re.I)), default=-1)
        return last_close[tag] >= pos

    def behind(tag: str) -> int:
        """The place behind the end of an element that has just begun."""
        depth = 1
        for m in re.compile(rf"<(/?){re.escape(tag)}\b[^>]*>?", re.I).finditer(page, pos):
            depth += -1 if m[1] else 1
            if not depth:
                return m.end()
        return n

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node.children.append((text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if in_link:
                linked += len(" ".join(raw.split()))

    while pos < n:
        m = _TAG.search(page, pos)
        if not m:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        if m["comment"] is not None:
            end = page.find("-->", m.end())
            pos = n if end < 0 else end + 3
            continue
        full = _ATTRS.match(page, m.end())
        if full:
            pos = full.end()
        else:  # a quote that never closes, or the page breaks off
            end = page.find(">", m.end())
            pos = n if end < 0 else end + 1
        if m["decl"]:
            continue
        tag = m["name"].lower()
        if m["close"]:
            if tag == "a":
                in_link = False
            if tag in BREAKS or tag == "p" and not _open(node, "p"):
                flush()
            elif tag in BLOCKS:
                found = _open(node, tag)
                flush()
                if found and found.parent:
                    node = found.parent
            continue
        attrs = page[m.end() : pos - 1]
        if tag in RAW:
            if attrs.endswith("/"):
                continue
            if tag == "head":
                end = re.compile(r"</head\s*>|<body\b", re.I).search(page, pos)
                if end:
                    pos = end.start()
                    continue
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, pos) if closes(tag) else None
            if end:
                pos = end.end()
            elif tag in OPAQUE:
                pos = n
            continue
        if tag not in BLOCKS and tag not in VOID and attrs and _is_boilerplate(tag, attrs) and closes(tag):
            pos = behind(tag)  # an advert or notice inside a line, or hidden text
            continue
        if tag in BREAKS:
            flush()
        elif tag == "a":
            in_link = True
        elif tag in BLOCKS and tag not in ("html", "body"):
            flush()
            if tag in CLOSES_P and (p := _open(node, "p")):
                node = p.parent
            if tag in ("li", "dd", "dt", "td", "th", "tr") and node.tag in (tag, "dd" if tag == "dt" else tag, "dt" if tag == "dd" else tag):
                node = node.parent or root
            child = Node(tag, node, _is_boilerplate(tag, attrs))
            node.children.append(child)
            node = child
    flush()
    return root


def _open(node: Node | None, tag: str) -> Node | None:
    """The nearest open element of this tag; for p only inside the nearest other container."""
    while node and node.parent:
        if node.tag == tag:
            return node
        if tag == "p" and node.tag in ("article", "section", "div", "td", "li", "blockquote", "main", "body"):
            return None
        node = node.parent
    return None


def _walk(root: Node) -> list[Node]:
    """Nodes before what they hold, without dropped ones."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    return out


def score(root: Node) -> list[Node]:
    """Set scores, characters and link characters of all kept nodes; returns them."""
    nodes = _walk(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, tuple):
                node.chars += len(c[0])
                node.links += c[1]
            elif not c.drop:
                node.chars += c.chars
                node.links += c.links
    for node in nodes:
        for c in node.children:
            if isinstance(c, tuple) and c[1] < len(c[0]):
                text = c[0]
                points = 1.0 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3.0)
                up, weight, depth = (node.parent or node) if node.tag in ("p", "pre", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote") else node, 1.0, 0
                while up and depth < 5:
                    up.score += points * weight
                    depth += 1
                    weight = 0.5 if depth == 1 else weight / 2
                    up = up.parent
    for node in nodes:
        node.score = (node.score + (BONUS.get(node.tag, 0.0) if node.chars else 0.0)) * (1 - (node.links / node.chars if node.chars else 0.0))
    return nodes


def _texts(node: Node, out: list[str], top: bool = False) -> None:
    todo: list = [(node, top)]
    while todo:
        item, is_top = todo.pop()
        if isinstance(item, tuple):
            out.append(item[0])
            continue
        if item.drop:
            continue
        if not is_top and item.chars and item.tag in ("ul", "ol", "dl", "table", "div", "section") and item.links > MENU_DENSITY * item.chars:
            continue
        todo += [(c, False) for c in reversed(item.children)]


def extract(page: str | None) -> str:
    """The page's main text: its blocks in page order, joined by one space."""
    if not page:
        return ""
    root = parse(page)
    nodes = score(root)
    able = [x for x in nodes if x.chars and x.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6")]
    if not able:
        return ""
    best = max(able, key=lambda x: x.score)  # the first of equals
    out: list[str] = []
    if best.parent is None:
        _texts(best, out, True)
        return " ".join(out)
    least = max(10.0, SIBLING_SHARE * best.score)
    for c in best.parent.children:
        if c is best:
            _texts(c, out, True)
        elif isinstance(c, Node) and not c.drop and c.chars:
            density = c.links / c.chars
            if c.tag == best.tag and c.score >= least or c.tag == "p" and density < 0.25 and (c.chars > 80 or best.tag not in ("article", "main")) or c.tag in ("h1", "h2") and not density and best.tag != "article":
                _texts(c, out, True)
    return " ".join(out)


def extract_main_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: id, url, ``text`` and its number of code points ``n_chars``."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(lo, 500)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url, "text", "n_chars"])

    return pick(pages, id_col, url, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url}` string, text string, n_chars long")
