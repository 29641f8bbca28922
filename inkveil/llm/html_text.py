"""Main text of web pages by composite text density.

Every element gets C characters, T tags, LC characters and LT tags inside links, and the
density C/T scaled by a logarithm that falls with the share of links.  The element whose
children have the greatest sum of densities holds the article; the least density on the path
from the densest element to the body is the threshold that elements must reach to be chosen.
Further elements that reach it add theirs, so an article in several sections is whole.
Elements that are boilerplate by tag, role, class or id are taken out first; one that only its
class or id names stays if it holds the page's article or, where none is marked, most of its text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, and words that pages use to name boilerplate.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas noframes xmp".split())
DROP = RAW | frozenset("nav footer aside form button select datalist dialog menu head audio video map".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HINTS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer gdpr "
    "header masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related reply replies "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_SCOPE = frozenset("html body table td th caption button object template article aside section div main header footer nav blockquote ul ol dl form fieldset".split())
_PAIRS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SHUT_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}

_HOLDERS = ("article", "main")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PROSE = frozenset(("p", "li", "pre", "blockquote", "ul", "ol", *_HEADINGS))

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
# Words that begin a name that says what an element lacks or has beside it.
_BESIDE = frozenset("has have with no not non without hide".split())


class Node:
    __slots__ = ("chars", "children", "density", "drop", "hint", "link", "link_chars", "link_tags", "parent", "parts", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, drop: bool, hint: bool = False):
        self.tag, self.parent, self.drop, self.hint = tag, parent, drop, hint
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _boilerplate(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether only its class or id says so; ``inside`` an article or main."""
    if tag in DROP or tag == "header" and not inside:
        return True, False
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False, False
    hint = False
    for name, *values in _ATTR.findall(attrs):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for words in map(_WORD.findall, value.split()):
                found = set() if not words or words[0] in _BESIDE else HINTS & set(words)
                # The header of an article or of a section holds a title.
                if tag in _HEADINGS or inside:
                    found -= {"header"}
                hint |= bool(found)
    return False, hint


def _settle(root: Node) -> None:
    """Drops the elements that their class or id hints at, except those that hold the article."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.drop:
            order.append(node)
            todo.extend(node.children)
    if not any(n.hint for n in order):
        return
    size = {}
    for node in reversed(order):
        size[node] = sum(len(x.strip()) if isinstance(x, str) else size.get(x, 0) for x in node.parts)
    mains = [n for n in order if n.tag == "main"]
    articles = [n for n in order if n.tag == "article" and not n.hint]
    marked = mains + ([max(articles, key=size.get)] if articles else [])
    holds = set()
    for node in marked:
        while node is not None and node not in holds:
            holds.add(node)
            node = node.parent
    for node in order:
        if node.hint and node.tag != "article" and node not in holds and (marked or 2 * size[node] <= size[root]):
            node.drop = True


def parse(text: str) -> Node:
    """The tree of a page; broken markup is closed as browsers do in the common cases."""
    root = Node("body", None, False)
    stack, at, end = [root], 0, len(text)
    lower, opened = None, Counter()  # elements open by tag: where none is, the stack isn't searched

    def pop_to(tags, scope) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                opened.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    while at < end:
        m = _TAG.search(text, at)
        stop = m.start() if m else end
        if stop > at:
            stack[-1].parts.append(html.unescape(text[at:stop]))
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            stack[-1].parts.append(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "br":
                stack[-1].parts.append(" ")
            elif tag not in ("html", "body"):
                pop_to((tag,), ("td", "th") if tag in ("p", "b", "i", "a", "span") else ())
            continue
        if tag in ("html", "body"):
            continue
        if tag in _SHUT_P:
            pop_to(("p",), _SCOPE)
        if tag in _PAIRS:
            pop_to(_PAIRS[tag], ("ul", "ol", "dl", "table", "select"))
        attrs = m[4]
        up = stack[-1]
        node = Node(tag, up, *_boilerplate(tag, attrs, any(opened[t] for t in _HOLDERS)))
        up.children.append(node)
        up.parts.append(node)
        if tag in RAW:
            if not attrs.endswith("/") or tag not in ("svg", "math"):
                lower = lower if lower is not None else text.lower()
                close = lower.find(f"</{tag}", at)
                # An unclosed text-like element ends with the page, an unclosed title with its line of markup.
                at = end if close < 0 else (text.find(">", close) + 1 or end)
        elif tag not in VOID and (tag in BLOCK or not attrs.endswith("/")):
            stack.append(node)
            opened[tag] += 1
    _settle(root)
    return root


def _count(root: Node) -> list[Node]:
    """Fills in the counts bottom-up; the kept nodes in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.drop:
            order.append(node)
            todo.extend(reversed(node.children))
    for node in reversed(order):
        node.chars += sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    return order


def _density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite density of c characters and t tags; counts of 0 that divide are taken as 1, so text without links has one too."""
    if not c:
        return 0.0
    t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / t * math.log(c / lc * t / lt + 1) / math.log(base)


def _densities(order: list[Node]) -> None:
    body = order[0]
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        # Text straight in an element counts as a child of its own.
        node.total += _density(sum(len(x.strip()) for x in node.parts if isinstance(x, str)), 1, 0, 0, share)
    for node in order[1:]:
        node.parent.total += node.density


def _within(node: Node | None, tags) -> Node | None:
    """The nearest of the node and what holds it with one of the tags."""
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def _chosen(order: list[Node]) -> tuple[list[Node], bool]:
    """The elements that hold the article, in page order; one may hold another.  And whether text straight in the body belongs to it."""
    root = order[0]
    densest = max(order, key=lambda n: n.density)
    least, up = densest.density, densest
    while up is not None:
        least, up = min(least, up.density), up.parent
    peak = {}
    for node in reversed(order):
        peak[node] = max([node, *(peak[x] for x in node.children if not x.drop)], key=lambda n: n.total)
    best = peak[root]
    # Every dense element, under dense elements, gives the one of the greatest sum in it.
    marks, reached = set(), {root}
    for node in order[1:]:
        if node.parent in reached and node.density >= least:
            reached.add(node)
            marks.add(peak[node])
    holder = _within(best, _HOLDERS)
    if holder is not None:
        inner = {}
        for node in order:  # the nearest holder of each element, from the top down
            inner[node] = node if node.tag in _HOLDERS else inner.get(node.parent)
        held = {inner[n] for n in marks} - {None}
        return [n for n in order if n is holder or n in held], False
    # A paragraph's inline markup or one paragraph of an article: the element that holds the article whole.
    while best.parent is not None and (best.tag not in BLOCK or best.tag in _PROSE):
        best = best.parent
    if best is root:
        # Straight in the body: its prose stays, and of the containers those that are dense.
        return [n for n in root.children if not n.drop and (n.density >= least or n.tag not in BLOCK or n.tag in _PROSE)], True
    marks.add(best)
    # Headings that stand before a chosen element belong to it.
    heads = set()
    for up in {n.parent for n in marks}:
        before = []
        for x in up.children:
            if x in marks:
                heads.update(before)
            elif x.tag in _HEADINGS and not x.drop:
                before.append(x)
    return [n for n in order if n in marks or n in heads], False


def _text(node: Node, only: list[Node] | None = None) -> str:
    """The text of an element; with ``only``, of these of its descendants and the text straight in it."""
    out: list[str] = []
    todo: list = [node]
    if only is not None:
        keep = set(only)
        todo = [x for x in reversed(node.parts) if isinstance(x, str) or x in keep]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop:
            block = x.tag in BLOCK
            if block:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.parts))
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The article of a page as one line; empty where there is none."""
    if not page:
        return ""
    root = parse(page)
    order = _count(root)
    if not root.chars:
        return ""
    _densities(order)
    chosen, straight = _chosen(order)
    if straight:
        return _text(root, chosen)
    kept, under, out = set(chosen), set(), []
    for node in order:  # what lies in a chosen element is in its text
        if node.parent in kept or node.parent in under:
            under.add(node)
        elif node in kept:
            out.append(_text(node))
    return " ".join(x for x in out if x)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages, and pages without text, give an empty text; of equally dense parts
    the first in the page is taken; time grows in proportion to a page, however deep its
    elements; a null page_id or url stays null; repeated rows are all returned; other columns
    are ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html")]
    return pages.select(*cols).mapInArrow(run, "page_id long, url string, text string, n_chars long")
