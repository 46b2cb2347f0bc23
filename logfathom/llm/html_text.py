"""Main text of web pages by tree scoring.

The page becomes a tree (void elements, implied ends of paragraphs, list items and cells, unclosed elements). Paragraphs
pass points for length and commas to their ancestors, halved at each step up to three levels, and each candidate's
points are discounted by its link density. The best container and its siblings of low link density are kept; menus, headers outside the article, footers, sidebars, notices, adverts, forms, comments and scripts inside are
left out. Text blocks follow in page order, one line each.

Defined results: a null or empty page, or one without text, gives an empty text. Character references are decoded, white
space inside a block becomes one space, blocks are trimmed and empty ones dropped. Ties go to the container that starts
first. Rows are neither dropped nor merged; other columns pass through, existing ``text`` and ``n_chars`` columns are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text never belongs to the article.
DROPPED = frozenset(
    "script style noscript template head title nav aside footer button select option textarea input iframe object svg math canvas "
    "audio video map menu dialog".split()
)
BLOCKS = frozenset(
    "html body article section main header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption "
    "figure figcaption address details summary hr fieldset hgroup center".split()
)
CLOSES_P = BLOCKS | {"form"} | DROPPED - {"script", "style", "noscript", "template", "button", "select", "option", "textarea", "input", "iframe", "object", "svg",
                               "math", "canvas", "audio", "video", "map", "title", "head"}
# An opening tag ends an open one of the listed kinds, unless a scope element stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot html body article section div td th blockquote aside nav footer header main form".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|combx|comments?|commentlist|reply|replies|respond|disqus|consent|cookies?|gdpr|footer|header"
    r"|masthead|menu|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|modal|overlay|promo\w*|related|recommended|remark|rss|share|sharing"
    r"|shoutbox|sidebar|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|tooltip|widget|login|signup|search|copyright|alert|toc)"
    r"(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
LIKELY = frozenset("article body content entry main page post story text".split())
# A form with this many characters of paragraphs, and more of them than other text, is a page wrapped in a form.
FORM_TEXT = 250
# The opening of a tag that is not finished before the next one begins.
TORN = re.compile(r"""<(?=[a-zA-Z/](?>[^<>"']++|"[^"]*+"(?=[\s/>a-zA-Z])|'[^']*+'(?=[\s/>a-zA-Z]))*+(?!>))""")
OPEN_COMMENT = re.compile("<!--(?!-?>)")
LINKS = 0.5  # share of linked text from which a sibling of the article is a list of links
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "links", "parent", "points", "tag", "words")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.points, self.words, self.links = 0.0, 0, 0


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags: set[str] | frozenset[str], scopes: frozenset[str]) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag in tags:
                self.at = node.parent
                return
            if node.tag in scopes:
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, SCOPES)
        if tag in ENDS:
            self._close(ENDS[tag], SCOPES - {"td", "th"} if tag == "tr" else SCOPES - ENDS[tag])
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        node = self.at
        while node is not None and node.tag != tag:
            if tag not in BLOCKS and node.tag in SCOPES:  # a stray inline end tag closes no container
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    # What has no end is text; looking for its end from each beginning would take quadratic time.
    closed = html.rfind("-->") + 1
    html = html[:closed] + OPEN_COMMENT.sub("&lt;!--", html[closed:])
    closed = html.rfind(">") + 1
    html = TORN.sub("&lt;", html[:closed]) + html[closed:].replace("<", "&lt;")
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _names(node: Node) -> list[list[str]]:
    """The words of each class and of the id."""
    names = f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}"
    return [[w for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if w] for name in names.split()]


def _unlikely(node: Node, inside: bool, quoted: bool) -> bool:
    """Whether an element is no part of an article. ``inside`` an article headers stay, ``quoted`` footers name a source."""
    if "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    if (node.attrs.get("role") or "").lower() in ROLES or "display:none" in (node.attrs.get("style") or "").replace(" ", ""):
        return True
    if node.tag in DROPPED:
        return not (quoted and node.tag == "footer")
    if node.tag == "header":
        return not inside
    if node.tag in ("html", "body", "article", "main"):
        return False
    names = [[w.lower() for w in words] for words in _names(node)]
    if node.tag in BLOCKS and any(words and LIKELY.issuperset(words) for words in names):
        return False
    for words in names:
        if words[:1] in (["has"], ["with"], ["no"]) or "of" in words:  # says what is in it, or is a phrase
            continue
        if words and words[-1] == "header":
            if not inside and not {"article", "entry", "post", "story"} & set(words):
                return True
        elif UNLIKELY.search("-".join(words)):
            return True
    return False


def _wraps_page(form: Node) -> bool:
    paragraphs = other = 0
    stack: list[tuple[Node | str, bool]] = [(form, False)]
    while stack:
        at, inside = stack.pop()
        if isinstance(at, str):
            size = len(at.strip())
            paragraphs, other = (paragraphs + size, other) if inside else (paragraphs, other + size)
        elif at.tag not in DROPPED:
            stack += [(c, inside or at.tag in PARAGRAPHS) for c in at.children]
    return paragraphs >= max(FORM_TEXT, other)


def _prune(root: Node) -> None:
    """Cut unlikely elements, page headers outside an article, and forms that don't wrap one."""
    stack = [(root, False, False)]
    while stack:
        node, inside, quoted = stack.pop()
        inside, quoted = inside or node.tag in ("article", "main"), quoted or node.tag == "blockquote"
        node.children = [c for c in node.children if isinstance(c, str) or not _unlikely(c, inside, quoted)]
        for child in node.children:
            if not isinstance(child, str):
                stack.append((child, inside, quoted))
    forms = [n for n in _order(root) if n.tag == "form" or (n.attrs.get("role") or "").lower() == "form"]
    for form in forms:
        if not _wraps_page(form):
            form.children = []


def _order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return order


def _measure(root: Node) -> list[Node]:
    """Set text and link lengths bottom up; the nodes in page order."""
    order = _order(root)
    for node in reversed(order):
        own = sum(len(SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        node.words = own + sum(c.words for c in node.children if not isinstance(c, str))
        node.links = node.words if node.tag == "a" else sum(c.links for c in node.children if not isinstance(c, str))
    return order


def _own_text(node: Node) -> str:
    """Text of a paragraph without nested blocks."""
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(at)
        elif at is node or at.tag not in BLOCKS:
            stack += reversed(at.children)
    return SPACE.sub(" ", "".join(out)).strip()


def _score(order: list[Node]) -> list[Node]:
    for node in order:
        loose = node.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and len(c.strip()) > 25 for c in node.children)
        if node.tag not in PARAGRAPHS and not loose:
            continue
        text = _own_text(node)
        if not text:
            continue
        points = (1.0 if len(text) >= 25 else 0.2) + text.count(",") + min(len(text) / 100, 3)
        share, up = 1.0, node if loose else node.parent
        while up is not None and up.tag != "#root" and share > 0.2:
            up.points += points * share
            share, up = share / 2, up.parent
    return [n for n in order if n.points > 0 and n.tag not in PARAGRAPHS or n.points > 0 and n.tag in ("td", "blockquote", "li")]


def _value(node: Node) -> float:
    bonus = 1.25 if node.tag in ("article", "main") else 1.0
    return node.points * bonus * (1 - node.links / max(1, node.words))


def _blocks(nodes: list[Node | str]) -> list[str]:
    lines, current = [], []

    def flush() -> None:
        line = SPACE.sub(" ", "".join(current)).strip()
        if line:
            lines.append(line)
        current.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        at = stack.pop()
        if at is None:
            flush()
        elif isinstance(at, str):
            current.append(at)
        elif at.tag == "br":
            current.append(" ")
        elif at.tag in BLOCKS:
            flush()
            stack += [None, *reversed(at.children)]
        else:
            stack += reversed(at.children)
    flush()
    return lines


def main_text(html: str | None) -> str:
    """The page's main text."""
    if not html:
        return ""
    root = parse(html)
    _prune(root)
    candidates = _score(_measure(root))
    if not candidates:
        return "\n".join(_blocks([root]))
    best = max(candidates, key=_value)
    while best.parent is not None and best.parent.tag in ("article", "main") or best.tag in ("li", "td", "tr", "tbody", "ul", "ol", "blockquote"):
        if best.parent is None or best.parent.tag in ("body", "html", "#root"):
            break
        best = best.parent  # a list or table, or a part of the article, stands for the whole
    kept: list[Node | str] = []
    for other in best.parent.children if best.parent is not None else [best]:
        # pruning took what is no article; beside the best container only lists of links are left out
        if other is best or not isinstance(other, str) and other.words and other.links / other.words < LINKS:
            kept.append(other)
    return "\n".join(_blocks(kept))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The given rows with ``text`` and ``n_chars`` (code points)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    return pages.drop("text", "n_chars").withColumn("text", run(F.col(html))).withColumn("n_chars", F.length("text").cast("bigint"))
