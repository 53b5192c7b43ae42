"""Main text of web pages by composite text density.

Every page is parsed once into a tree. A node's composite density is its characters per tag,
adjusted by how much of the text is links; a node's score is the sum of its children's
densities. The subtree with the largest score holds the article; the smallest density on the
path from it up to the body is the threshold that its parts must reach: parts below it that hold nothing
but links go, unless they stand between prose or an article element says where the article is. Parts that by element or name are
not the article (menus, headers and footers of the page, sidebars, notices, adverts, forms,
comments by readers) take no part in any sum and give no text.

Each page is handled on its own, in Arrow batches, so work spreads as the rows do.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.common import text_of, unused

# Names of HTML elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
SILENT = frozenset(
    "script style noscript iframe xmp noembed noframes title head template svg math canvas audio video object "
    "nav footer aside form button select option textarea input label fieldset menu dialog".split()
)
BLOCK = frozenset(
    "html body div p article section main header footer aside nav h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
    "tfoot tr td th caption blockquote pre figure figcaption form fieldset address hr details summary br center".split()
)
CLOSES_P = BLOCK - {"br", "html", "body"}
SAME_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
SCOPES = frozenset("table ul ol dl select body html article section div td th".split())
#: A class or id of these words, and of words that say where or in what such a part stands, marks something else than the article.
_OTHER = (
    r"(?:ads?|advert|adverts|advertis(?:ement|ements|ing)|adsense|sponsor(?:ed|s)?|promo|promos|promotion|banner|banners|nav|navbar|navigation|menu|menus|"
    r"breadcrumbs?|sidebar|side-bar|footer|masthead|site-header|page-header|cookies?|consent|notices?|gdpr|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|share|sharing|social|related|recommended|recommendations?|comments?|commentlist|disqus|respond|reply|replies|"
    r"widgets?|pagination|pager|login|signup|search|toolbar|skip-link|copyright|disclaimer|legal|tag-?cloud)"
)
_PLACE = r"(?:site|page|main|primary|secondary|top|bottom|left|right|global|container|wrapper|wrap|box|bar|list|links|area|buttons|block)"
OTHER_PARTS = re.compile(rf"(?:{_PLACE}[-_]+)*{_OTHER}(?:[-_]+(?:{_OTHER}|{_PLACE}|\d+))*")
#: Inside an article ids are names of places to link to; only these elements are judged by them.
HOLDERS = frozenset("div ul ol".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile("[\"'>]")
SPACES = re.compile(r"\s+")
WORD = re.compile(r"\w")


class Node:
    __slots__ = ("name", "parent", "children", "other", "chars", "tags", "links", "link_tags", "density", "score", "named", "plain")

    def __init__(self, name: str, parent: Node | None, other: bool, named: bool = False):
        self.name, self.parent, self.other, self.named = name, parent, other, named
        self.children: list[Node | str] = []
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.score = 0.0
        self.plain = False  # holds a word that is no link


def _other(name: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """(whether a part is not the article, whether only its class or id says so)."""
    if name in SILENT or (name == "header" and not inside_article):
        return True, False
    if not attributes or name in ("html", "body", "main", "article"):
        return False, False
    named = False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or key == "role" and value in OTHER_ROLES:
            return True, False
        if key == "class" or key == "id" and (not inside_article or name in HOLDERS):
            named = named or any(OTHER_PARTS.fullmatch(x) for x in value.split())
    return named, named


def _spare_article(root: Node) -> None:
    """Take back what only a name drops, where it holds the page's article.

    The article is the article or main element with the most unlinked text. Without one, and within
    it, a part with most of the body's unlinked text is not dropped either.
    """
    order, stack, body = [], [(root, False)], root
    plain: dict[int, int] = {}
    while stack:
        node, linked = stack.pop()
        if node.other and not node.named:
            continue
        linked = linked or node.name == "a"
        body = node if node.name == "body" and body is root else body
        order.append(node)
        plain[id(node)] = 0 if linked else sum(len(SPACES.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        stack.extend((c, linked) for c in node.children if isinstance(c, Node))
    if not any(n.named for n in order):
        return
    for node in reversed(order):
        if node.parent is not None:
            plain[id(node.parent)] += plain[id(node)]
    article = max((n for n in order if n.name in ("article", "main")), key=lambda n: plain[id(n)], default=None)
    article = article if article is not None and plain[id(article)] else None
    around, node = set(), article
    while node is not None:
        around.add(id(node))
        node = node.parent
    within = {id(article)}
    for node in order:
        if id(node.parent) in within:
            within.add(id(node))
        if node.named and (
            id(node) in around or (article is None or id(node) in within) and 2 * plain[id(node)] > plain[id(body)]
        ):
            node.other = node.named = False


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, outside quoted values; -1 if the page ends before."""
    while True:
        m = QUOTE_OR_END.search(page, at)
        if m is None:
            return -1
        if m.group() == ">":
            return m.start()
        at = page.find(m.group(), m.end()) + 1
        if not at:
            return -1


class _Open:
    """Open elements by name, in all and since the last one that bounds implied ends, so that an
    end that meets nothing costs no climb."""

    def __init__(self) -> None:
        self.all: Counter[str] = Counter()
        self.near = [Counter()]

    def enter(self, name: str) -> None:
        self.all[name] += 1
        if name in SCOPES:
            self.near.append(Counter())
        self.near[-1][name] += 1

    def leave(self, name: str) -> None:
        self.all[name] -= 1
        self.near[-1][name] -= 1
        if name in SCOPES:
            self.near.pop()


def _tags(page: str) -> Iterator[tuple[str, bool, str, int]]:
    """Pieces of a page in order: (text, False, "", 0) or ("", ends, name, place behind the name).

    Whoever reads a tag sends back where to go on. Comments and declarations give nothing.
    """
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield page[at:], False, "", 0
            return
        follows = page[start + 1 : start + 2]
        m = TAG.match(page, start) if follows == "/" or follows.isalpha() else None
        if m is None and follows not in ("!", "?"):
            # A lone "<" is text.
            yield page[at : start + 1], False, "", 0
            at = start + 1
            continue
        if start > at:
            yield page[at:start], False, "", 0
        if m is not None:
            at = yield "", bool(m.group(1)), m.group(2).lower(), m.end()
            continue
        end = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) else ">"
        found = page.find(end, start + (4 if end == "-->" else 1))
        at = found + len(end) if found >= 0 else size


def parse(page: str) -> Node:
    """A tree of a page as browsers would roughly build it: implied ends, void and raw elements.

    A page with a quote that nothing closes, inside a tag, is read on without regard to quotes; a
    tag that the page does not end is text. Work grows in proportion to the page.
    """
    root = Node("#root", None, False)
    top, articles, loose, is_open = root, 0, False, _Open()
    pieces = _tags(page)
    piece = next(pieces, None)
    while piece is not None:
        text, ends_one, name, at = piece
        if not name:
            top.children.append(text)
            piece = next(pieces, None)
            continue
        end = -1 if loose else _tag_end(page, at)
        if end < 0:
            loose, end = True, page.find(">", at)
        if end < 0:
            top.children.append(page[page.rfind("<", 0, at) :])
            break
        attributes, at = page[at:end], end + 1
        if ends_one:
            if is_open.all[name]:
                while True:
                    articles -= top.name == "article"
                    is_open.leave(top.name)
                    last, top = top, top.parent
                    if last.name == name:
                        break
            piece = _next(pieces, at)
            continue
        ends = SAME_ENDS.get(name, frozenset())
        if name in CLOSES_P:
            ends = ends | {"p"}
        if any(is_open.near[-1][e] for e in ends):
            while True:
                articles -= top.name == "article"
                is_open.leave(top.name)
                last, top = top, top.parent
                if last.name in ends:
                    break
        node = Node(name, top, *_other(name, attributes, articles > 0))
        top.children.append(node)
        if name in VOID or attributes.rstrip().endswith("/") and name in ("svg", "path", "use", "math"):
            piece = _next(pieces, at)
            continue
        if name in RAW:
            m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            node.children.append(page[at : m.start() if m else len(page)])
            piece = _next(pieces, m.end() if m else len(page))
            continue
        articles += name == "article"
        is_open.enter(name)
        top = node
        piece = _next(pieces, at)
    _spare_article(root)
    return root


def _next(pieces, at: int):
    try:
        return pieces.send(at)
    except StopIteration:
        return None


def _measure(root: Node) -> Node:
    """Fill in densities bottom-up; returns the body. Iterative, as trees may be very deep."""
    order, stack, body = [], [root], root
    while stack:
        node = stack.pop()
        order.append(node)
        if node.name == "body" and body is root:
            body = node
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.other)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(SPACES.sub(" ", c).strip())
                node.plain = node.plain or WORD.search(c) is not None
            elif not c.other:
                node.chars += c.chars
                node.plain = node.plain or c.plain
                node.tags += c.tags + 1
                node.links += c.links
                node.link_tags += c.link_tags
        if node.name == "a":
            node.links, node.link_tags, node.plain = node.chars, node.tags + 1, False
    total, linked = max(body.chars, 1), body.links
    for node in reversed(order):
        node.density = _density(node, total, linked)
        node.score = sum(c.density for c in node.children if isinstance(c, Node) and not c.other)
    return body


def _density(node: Node, total: int, linked: int) -> float:
    """Characters per tag, to a logarithm whose base grows with the share of linked text."""
    if not node.chars:
        return 0.0
    chars, tags = node.chars, max(node.tags, 1)
    links, link_tags, plain = node.links, max(node.link_tags, 1), max(node.chars - node.links, 1)
    base = math.log(chars / plain * links + linked / total * chars + math.e)
    return chars / tags * math.log(max(chars / max(links, 1) * (tags / link_tags), 1.0 + 1e-9)) / math.log(1.0 + base)


def _blocks(node: Node, threshold: float | None) -> list[str]:
    """Texts of the blocks below a node in page order, without its other parts.

    Given a threshold, parts below it that hold nothing but links go too, unless they stand between prose.
    """
    parts: list[str] = []
    current: list[str] = []

    def end_block() -> None:
        text = SPACES.sub(" ", html.unescape("".join(current))).strip()
        current.clear()
        if text:
            parts.append(text)

    stack: list[tuple[Node | str, bool, bool]] = [(node, False, threshold is None)]
    while stack:
        item, leaving, whole = stack.pop()
        if isinstance(item, str):
            current.append(item)
            continue
        if leaving:
            end_block()
            continue
        if item.other:
            continue
        if not whole and item.name in BLOCK and item.density < threshold and item.links * 2 > item.chars and not item.plain and item is not node:
            continue
        if item.name in BLOCK:
            end_block()
            stack.append((item, True, whole))
        if whole:
            stack.extend((c, False, True) for c in reversed(item.children))
            continue
        # What stands between prose within one part stays as a whole.
        prose = [i for i, c in enumerate(item.children) if (WORD.search(c) if isinstance(c, str) else c.plain and not c.other)]
        first, last = (prose[0], prose[-1]) if prose else (len(item.children), -1)
        stack.extend((c, False, first < i < last) for i, c in reversed(list(enumerate(item.children))))
    end_block()
    return parts


def main_text(page: str | None) -> str:
    """The article of one page; empty for a page without text or null."""
    if not page:
        return ""
    body = _measure(parse(page))
    best, stack = body, [body]
    while stack:
        node = stack.pop()
        if node.score > best.score or (node.score == best.score and best is not body and node.chars > best.chars):
            best = node
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.other)
    threshold, node = best.density, best
    while node is not None and node is not body:
        threshold, node = min(threshold, node.density), node.parent
    threshold = min(threshold, body.density)
    # The best node may be a part of the article; an article element around it is the whole.
    outer = best
    while outer.parent is not None and outer.name not in ("article", "main"):
        outer = outer.parent
    if outer.name in ("article", "main"):
        return " ".join(_blocks(outer, None))
    return " ".join(_blocks(best, threshold))


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns with ``text`` and ``n_chars`` (code points) for every row.

    Null and empty pages, and pages without an article, have an empty text. Whole pages are read
    whatever their length or depth. Repeated rows and null identifiers come back as they are. An
    empty table gives an empty result. Columns not named in ``keep`` are not read, so ``text`` and
    ``n_chars`` clash with nothing.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(len(keep))]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_chars"])

    kept = pages.select(*keep)
    schema = kept.schema.add("text", "string").add("n_chars", "long")
    return pages.select(*keep, text_of(page).alias(unused(list(keep), "__html"))).mapInArrow(texts, schema)

