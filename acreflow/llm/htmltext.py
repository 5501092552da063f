"""Main text of HTML pages by composite text density.

A small tokenizer builds the tree of a page: void elements, elements whose
end tags may be left out, raw text, comments.  Each node has a number of
characters, tags, characters inside links and links.  Its composite density is
its characters per tag, adjusted by the shares of linked characters and links
(a node of links only has next to none).  The density sum of a node is the sum
of its children's densities; the node with the greatest one, the first of
several, is the main content, wherever it stands and whatever its tag.  The
least density on the way from it up to the body is the threshold that a part of
the page beside that way must reach to be kept with it; what lies between two
kept parts and headings right before one are kept too.  Beside the way inside
the article or main element that holds the content, and among other such
elements of the page, short parts are kept as well, but no menus: parts whose
text is mostly that of several links.

What never belongs to an article is no part of the tree: menus, headers,
footers, sidebars, forms and their controls, scripts and styles by their
elements and roles, what a browser with scripts does not show in the place of
scripts, frames and media, and containers whose class or id is, as a whole, the
name of an advert, a notice, a menu, a sidebar, reader comments or the like
("ad", "cookie-notice", "comment-list"; not "market-share" or "related-work").
Headings, paragraphs and other text elements have no such rule, and sections
only that of adverts, sidebars and comments.  Names that an article may use for
its own parts ("header", "related", "discussion"), and dialogs, only mark a
container: outside the article it goes, inside it goes if it is a menu, or has
links and a density under the threshold.

Defined results: a null or empty page gives the empty text; a page without
tags is one block; end tags without a start are ignored; markup that never ends reaches to the end of the page, and
a tag whose quote never ends to the next ``>``; time and memory grow with a
page's length alone, and no page is cut; every row gives a row, repeated rows
and null ids too; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quote ends a value only before white space, a slash or the tag's end, unless the value has no angle bracket: else it was never closed.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']|"[^"<>]*"|'[^'<>]*'|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))*)(?=>|\Z)|[^>]*)(?:>|\Z)""",
    re.S | re.X,
)
_SPACE = re.compile(r"\s+")
_LABEL = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed".split())
NOISE = RAW | frozenset("head nav header footer aside form button select option menu object audio video".split())
ARTICLES = frozenset(("article", "main"))
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt ruby s samp small span strike strong
sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover semantics annotation""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that a start tag of one of these ends, up to the named borders.
CLOSES = {
    **dict.fromkeys("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ({"p"}, {"table", "td", "th", "button", "article", "section", "div"})),
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
}
#: Names of what is no article text, as a whole class or id of a container or with words of ``PLAIN``.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion".split())
ASIDES = frozenset("sidebar sidebars comment comments commentlist disqus".split())
NAMES = ADVERTS | ASIDES | frozenset("""banner breadcrumb breadcrumbs cookie cookies consent disclaimer footer gdpr masthead menu menubar modal nav navbar navigation
newsletter notice notices notification notifications pager pagination popup alert sharing sponsors subscribe subscription toolbar widget widgets""".split())
#: Names that an article may use for its own parts too: density decides.
DOUBTFUL = frozenset("header related recommended discussion respond replies share social search complementary".split())
PLAIN = frozenset("area bar block box buttons container form inner items level links list main page posts section signup site top wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert".split())
#: Elements that hold text, whatever their names.
TEXTS = HEADINGS | INLINE - {"ins", "span", "a"} | frozenset("p li dt dd td th tr tbody thead pre blockquote figure figcaption caption".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_DROP, _DOUBT = 2, 1


class Node:
    __slots__ = ("tag", "parent", "mark", "parts", "chars", "tags", "link_chars", "links", "density", "total")

    def __init__(self, tag: str, parent: Node | None, mark: int = 0) -> None:
        self.tag, self.parent, self.mark, self.parts = tag, parent, mark, []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0


_known: dict[tuple[str, str], int] = {}


def _named(attributes: str) -> tuple[int, frozenset[str]]:
    """How sure the names in attributes are that a container is no article text, and their words."""
    mark, told = 0, set()
    for m in _LABEL.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            if m[1].lower() == "role":
                mark = _DROP if name.lower() in ROLES else mark
                continue
            whole = "".join(x for x in name.lower() if x.isalpha())
            words = {whole} if whole in NAMES | DOUBTFUL else {w.lower() for w in _WORD.findall(name)}
            if words <= NAMES | DOUBTFUL | PLAIN and (here := words & (NAMES | DOUBTFUL)):
                mark = max(mark, _DROP if here & NAMES else _DOUBT)
                told |= here
    return mark, frozenset(told)


def noise_of(tag: str, attributes: str) -> int:
    """2 if an element is no part of an article, 1 if density decides, else 0."""
    if tag in NOISE:
        return _DROP
    mark = _DOUBT if tag == "dialog" else 0
    if not attributes or tag in ("body", "html") or tag in ARTICLES or tag in TEXTS:
        return mark
    if (found := _known.get((tag, attributes))) is None:
        found, told = _named(attributes)
        if tag == "section" and not told & (ADVERTS | ASIDES):
            found = 0
        if len(_known) < 10_000:
            _known[tag, attributes] = found
    return max(found, mark)


class _Open:
    """The open elements, outermost first, and where those of each tag stand: no step looks at more of them than it closes."""

    def __init__(self) -> None:
        self.nodes, self.places = [Node("body", None)], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def end(self, tag: str) -> None:
        if at := self.last((tag,)):
            self.cut(at)

    def close_for(self, tag: str) -> None:
        """Close what a start tag ends without an end tag."""
        ended, borders = CLOSES[tag]
        border = self.last(borders)
        if tag not in ("tr", "td", "th"):
            if (at := self.last(ended)) > border:
                self.cut(at)
            return
        places = [p[i] for t in ended if (p := self.places.get(t)) and (i := bisect.bisect_right(p, border)) < len(p)]
        if places:
            self.cut(min(places))


def parse(page: str) -> Node:
    """The tree of a page without its noise; the root is the body."""
    opened = _Open()
    root = opened.nodes[0]
    pos, n, skip, inside = 0, len(page), [], Counter()  # skip: open elements inside a part that is left out, and how many of each
    for m in _TOKEN.finditer(page):
        start = m.start()
        if start < pos:
            continue
        at = opened.nodes[-1]
        if start > pos and not skip:
            at.parts.append(page[pos:start])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if skip:
                if inside[tag]:
                    while (gone := skip.pop()) != tag:
                        inside[gone] -= 1
                    inside[tag] -= 1
                elif opened.places.get(tag):  # the end of what holds the part
                    skip.clear()
                    inside.clear()
            if not skip and tag not in ("body", "html"):
                opened.end(tag)
            continue
        ends = m[3].endswith("/")
        if skip:
            if tag in ARTICLES and skip[0] not in RAW and skip[0] not in ("aside", "form"):
                skip.clear()  # an end tag was forgotten
                inside.clear()
            elif tag not in VOID and not ends:
                if tag in RAW:
                    pos = _raw_end(page, tag, pos, n)
                elif tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                    skip.append(tag)
                    inside[tag] += 1
                continue
            else:
                continue
        if tag in ("html", "body"):
            continue
        if tag == "br" or tag == "hr":
            at.parts.append(None)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            opened.close_for(tag)
            at = opened.nodes[-1]
        mark = noise_of(tag, m[3])
        if mark == _DROP:
            if tag in RAW:
                pos = _raw_end(page, tag, pos, n)
            elif not ends:
                skip.append(tag)
                inside[tag] += 1
            at.parts.append(None if tag not in INLINE else "")
            continue
        node = Node(tag, at, mark)
        at.parts.append(node)
        if not ends or tag not in ("svg", "math"):
            opened.push(node)
    if pos < n and not skip:
        opened.nodes[-1].parts.append(page[pos:])
    return root


def _up(node: Node):
    while node.parent is not None:
        yield node
        node = node.parent


def _raw_end(page: str, tag: str, pos: int, n: int) -> int:
    m = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, pos)
    return m.end() if m else n


def _count(node: Node) -> None:
    """Characters, tags and links of a node whose child nodes are counted."""
    node.chars = node.tags = node.link_chars = node.links = 0
    for x in node.parts:
        if isinstance(x, Node):
            node.chars += x.chars
            node.tags += x.tags + 1
            node.link_chars += x.link_chars
            node.links += x.links
        elif x:
            node.chars += len(x) - x.count(" ") if not x.isspace() else 0
    if node.tag == "a":
        node.link_chars, node.links = node.chars, node.links + 1


def _density(node: Node, share: float) -> float:
    c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.links
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    y = (c / max(lc, 1)) * (t / max(lt, 1))
    return c / t * math.log(max(y, 1.0) + 1e-9) / math.log(base + 1) if y > 1 else 0.0


def _measure(root: Node) -> list[Node]:
    """All nodes, parents first, with their counts, densities and sums."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.parts if isinstance(x, Node)]
    for node in reversed(order):
        _count(node)
    # The base of the logarithm is one more than in the published formula, where
    # a page without links would divide by log(1).
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        node.density = _density(node, share)
    for node in order:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node))
    return order


def _blocks(node: Node) -> list[str]:
    """The texts of the blocks below a node, in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            line.append(" ")
        elif x is flush:
            flush()
        elif isinstance(x, str):
            line.append(x)
        else:
            inside = x.parts[::-1]
            if x.tag in INLINE:
                todo += inside
            else:
                flush()
                todo.append(flush)
                todo += inside
    flush()
    return out


def main_text(page: str | None) -> str:
    """The text of the main content of a page, a block a line."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    best = max(order, key=lambda x: x.total)
    if _without_doubtful(order, best):
        order = _measure(root)
        best = max(order, key=lambda x: x.total)
    if not best.total:
        return "\n".join(_blocks(root))
    if best is root:
        return "\n".join(_blocks(root))
    threshold = min([root.density, *(x.density for x in _up(best))])
    whole = {id(best)}
    path = {id(root), *(id(x) for x in _up(best))} - whole
    kind: set[int] = set()  # nodes on the way, inside the article
    if (article := next((x for x in _up(best) if x.tag in ARTICLES), None)) is not None:
        for x in _up(best):
            kind.add(id(x))
            if x is article:
                break
        # other articles are parts of the content too, if they aren't lists of links
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag not in ARTICLES:
                todo += [x for x in node.parts if isinstance(x, Node)]
            elif id(node) not in path and node is not best and 2 * node.link_chars < node.chars:
                whole.add(id(node))
                for x in _up(node.parent):
                    if id(x) in path:
                        break
                    path.add(id(x))
                    kind.add(id(x))
    share = root.link_chars / max(root.chars, 1)
    keep: list[str] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) in path:
            todo += _kept_parts(node, path, whole, None if id(node) in kind and node.tag else threshold, share)[::-1]
        else:
            keep += _blocks(node)
    return "\n".join(keep)


def _without_doubtful(order: list[Node], best: Node) -> bool:
    """Empty the marked parts that hold no content: those outside its article, menus, and those with links under the threshold."""
    marked = [x for x in order if x.mark and x.chars]
    if not marked:
        return False
    way = {id(x) for x in (best, *_up(best))}
    article = next((x for x in (best, *_up(best)) if x.tag in ARTICLES), best)
    threshold = min([order[0].density, *(x.density for x in (best, *_up(best)))])
    within = {id(article)}
    for x in order:  # parents come first
        if x.parent is not None and id(x.parent) in within:
            within.add(id(x))
    gone = [x for x in marked if id(x) not in way and (id(x) not in within or _menu(x) or (x.links and x.density < threshold))]
    for x in gone:
        x.parts = []
    return bool(gone)


def _menu(node: Node) -> bool:
    return node.links > 1 and 2 * node.link_chars > node.chars


def _kept_parts(node: Node, path: set[int], whole: set[int], threshold: float | None, share: float) -> list[Node]:
    """The parts of a node on the way that belong to the content; text and inline elements in a row are one part.

    These are the parts that hold the content, parts that reach the threshold
    (if there is none, all but menus), headings right before a kept part, and
    all but menus between two kept parts.
    """
    parts: list[Node] = []
    run = None
    for x in node.parts:
        if isinstance(x, Node) and (x.tag not in INLINE or id(x) in path):
            parts.append(x)
            run = None
        else:
            if run is None:
                parts.append(run := Node("", node))
            run.parts.append(x)
    for x in parts:
        if not x.tag:
            _count(x)
            x.density = _density(x, share)
    parts = [x for x in parts if x.chars or id(x) in path or id(x) in whole]
    keep = []
    for x in parts:
        held = id(x) in path or id(x) in whole or (not x.tag and any(id(y) in whole for y in x.parts))
        keep.append(held or (not _menu(x) if threshold is None else x.density >= threshold and x.density > 0))
    at = [i for i, k in enumerate(keep) if k]
    for i in range(at[0], at[-1]) if at else ():
        keep[i] = keep[i] or not _menu(parts[i])
    for i in range(len(parts) - 2, -1, -1):
        keep[i] = keep[i] or (keep[i + 1] and parts[i].tag in HEADINGS)
    return [x for x, k in zip(parts, keep, strict=True) if k]


def text_batches(batches):
    """mapInArrow: id, url, html -> id, url, text, n_chars"""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def page_texts(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    plain = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return plain.mapInArrow(text_batches, f"page_id {plain.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
