"""Main-text extraction by composite text density of the DOM.

For every node of the parsed page, with C characters, T tags, LC characters
and LT tags of links in it (LCb and Cb: link and all characters of the body),

    density = C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

so many characters per tag score high and link text scores low.  The subtree
whose children's densities sum highest is the core of the article; the least
density on its path to the body is the threshold of its surroundings: what reaches it
stays, and so does other text of which at most half is links (the logarithms
grow with a node's size, so short paragraphs score under a long body).  An
article or main element around the core is the article, with others like it.

Elements whose name, role or class says that they are furniture (menus,
headers, footers, sidebars, notices, adverts, forms, comments) are cut before
anything is counted.  A class, an id or the form tag doesn't cut a wrapper:
where no article or main stands outside such elements, one that holds a main,
an article of more text than stands outside, or most of the body's text stays.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, text_or_empty

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CUT = frozenset("script style textarea title xmp iframe noembed noframes noscript template head nav footer aside form button select option dialog menu object svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus "
                      "footer gdpr header masthead menu modal nav navbar navigation newsletter notice paywall popup promo promoted related replies respond share "
                      "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
# an opening tag ends these open elements, up to the nearest of the second set
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
        "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}


class Node:
    __slots__ = ("cut", "density", "inside", "link", "link_chars", "links", "parent", "parts", "sum", "tag", "tags", "chars", "soft")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, soft: bool = False):
        self.tag, self.parent, self.parts, self.cut, self.soft = tag, parent, [], cut, soft
        self.link = tag == "a" or (parent is not None and parent.link)
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.chars = self.link_chars = self.tags = self.links = 0
        self.density = self.sum = 0.0


def _furniture(tag: str, attributes: str, inside: bool) -> str:
    """"cut", "soft" (by class, id or form tag: a wrapper of the text stays) or ""."""
    if tag != "form" and tag in CUT or (tag == "header" and not inside):
        return "cut"
    found = "soft" if tag == "form" else ""
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return found
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES - {"form"}):
            return "cut"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "cut"
        if (name == "role" and value.lower() == "form") or (name in ("class", "id") and not FURNITURE.isdisjoint(w.lower() for w in WORDS.findall(value))):
            found = "soft"
    return found


def _own(n: Node) -> int:
    """Characters but blanks of a node's own text."""
    return sum(len(x) - x.count(" ") for p in n.parts if type(p) is str for x in (" ".join(p.split()),))


def _cut_soft(nodes: list[Node]) -> None:
    """Cuts the soft elements but the wrappers of the page's text."""
    if not any(n.soft for n in nodes):
        return
    size, held, under, outside = {}, {}, set(), 0
    for n in reversed(nodes):
        size[n] = 0 if n.cut else size.get(n, 0) + _own(n)
        if n.parent is not None and size[n]:
            size[n.parent] = size.get(n.parent, 0) + size[n]
    for n in nodes:
        if n.soft or n.parent in under:
            under.add(n)
        elif not n.cut:
            outside += _own(n)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    spared = set()
    if not any(n.tag in ("article", "main") and size[n] and n not in under for n in nodes):
        for n in reversed(nodes):
            holds = held.get(n, False) or (n.tag == "main" and size[n] > 0) or (n.tag == "article" and size[n] > outside)
            if n.parent is not None and holds:
                held[n.parent] = True
            if n.soft and (holds or 2 * size[n] > size[body]):
                spared.add(n)
    for n in nodes:
        n.cut = n.cut or (n.soft and n not in spared) or (n.parent is not None and n.parent.cut)


def parse(page: str) -> list[Node]:
    """All nodes in document order, the root first.  Text parts are strings
    in ``parts`` with their character references decoded."""
    root = Node("#root", None)
    nodes, top, at = [root], root, 0
    size = len(page)

    def text(upto: int) -> None:
        if upto > at:
            top.parts.append(html.unescape(page[at:upto]))

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            text(size)
            break
        text(m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            n = top
            while n.parent is not None and n.tag != tag:
                if tag not in BLOCK and n.tag in BLOCK:
                    n = root
                    break
                n = n.parent
            if n.parent is not None:
                top = n.parent
            continue
        closed, stop = ENDS.get(tag, ({"p"}, {"table", "td", "th", "button", "object"}) if tag in BLOCK else (None, None))
        if closed:
            n, last = top, None
            while n.parent is not None and n.tag not in stop:
                if n.tag in closed:
                    last = n
                n = n.parent
            if last is not None:
                top = last.parent
        kind = _furniture(tag, m[3], top.inside)
        node = Node(tag, top, top.cut or kind == "cut", kind == "soft")
        top.parts.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = size if close < 0 else close + 1
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path", "math")):
            top = node
    _cut_soft(nodes)
    return nodes


def _count(nodes: list[Node]) -> Node:
    """Counts and densities of every kept node; returns the body."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    for n in reversed(nodes):
        if n.cut:
            continue
        own = _own(n)
        n.chars += own
        n.link_chars += own if n.link else 0
        if n.parent is not None and not n.parent.cut:
            p = n.parent
            p.chars, p.link_chars, p.tags, p.links = p.chars + n.chars, p.link_chars + n.link_chars, p.tags + n.tags + 1, p.links + n.links + (n.tag == "a")
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        if not n.cut and n.chars:
            c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.links)
            base = math.log(math.log(c / max(1, c - n.link_chars) * n.link_chars + share * c + math.e) + 1e-9)
            n.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt))) / max(base, 1e-3) if base > 1e-3 else c / t * math.log(max(1.0, c / lc * t / lt) + 1)
            if n.parent is not None:
                n.parent.sum += n.density
    return body


def _linked(n: Node) -> bool:
    """A block that is mostly links to elsewhere: a menu without a name."""
    return n.tag in BLOCK and n.links > 1 and n.link_chars * 10 > n.chars * 8


def _text(node: Node, whole, path=frozenset()) -> str:
    """The kept text under a node: blocks in page order, white space as one
    space.  A block that is ``whole`` stays with all in it but menus; of one
    that isn't, and isn't on the path to the core, the blocks in it that are."""
    out: list[str] = []
    stack: list = [(node, False)]
    while stack:
        x, kept = stack.pop()
        if type(x) is str:
            out.append(x)
        elif not x.cut and (x is node or x in path or not _linked(x)):
            if x.tag in BLOCK or x.tag == "br":
                out.append(" ")
                stack.append((" ", True))
            kept = kept or whole(x)
            for part in reversed(x.parts):
                if type(part) is not str:
                    stack.append((part, kept or (part.tag not in BLOCK and x in path)))
                elif kept or x in path:
                    stack.append((part, True))
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The article's text of a page; "" for null, empty or textless pages."""
    if not page:
        return ""
    nodes = parse(page)
    body = _count(nodes)
    best = body
    inside = set()
    for n in nodes:
        if n is body or (n.parent is not None and n.parent in inside):
            inside.add(n)
            if not n.cut and n.sum > best.sum:
                best = n
    threshold, path, n = best.density, [best], best
    while n is not body and n.parent is not None:
        n = n.parent
        path.append(n)
        threshold = min(threshold, n.density)
    named = [x for x in path if x.tag in ("article", "main")]
    if not named:  # the core is in none: the body's own, the longest
        own = [x for x in body.parts if type(x) is Node and x.tag in ("article", "main") and not x.cut and x.chars]
        if best is body and own:
            named = [max(own, key=lambda x: x.chars)]
    if named:
        root = named[-1]
        like = [x for x in root.parent.parts if type(x) is Node and x.tag == root.tag and not x.cut and x.chars and (x is root or x.density >= threshold)]
        return " ".join(filter(None, (_text(x, lambda _: True) for x in like)))
    root = best
    while root is not body and root.parent not in (None, body) and 10 * root.parent.chars <= 13 * root.chars and root.parent.density >= threshold:
        root = root.parent
    around = frozenset(path[path.index(root) + 1:] or path[-1:])
    return _text(body, lambda x: x not in around and (x is root or x.density >= threshold or (_own(x) and 2 * x.link_chars <= x.chars)), around)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).  Null or empty html
    gives an empty text; rows are independent, so repeated rows, null ids and
    other columns don't matter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "html"):
            texts = [main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
