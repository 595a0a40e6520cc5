"""Main text of web pages by composite text density.

Each DOM node has its characters C, tags T, link characters L and link tags K, each 1 at
least. Its density is C/T, adjusted by how much of it is links against the page's body:
C/T * log_b(C/L * T/K) with b = ln(C/notL * L + LB/CB * C + e). A node's density sum is the
sum over its children. The subtree of the largest sum is text, and the least density on its
path to the body is the threshold: from the body down, each child that reaches it marks the
subtree of the largest sum inside it too, so that an article in several parts is whole.

Where the largest sum is the body's own, its children that reach the threshold are marked.

The answer is the smallest subtree that holds all marked ones, and the heading before it
where it has none. Marked subtrees are taken whole; beside them go containers below the
threshold and what is mostly links, other lines of text stay.

Exclusions made before densities: elements that are never article text by their tag (menus,
forms, scripts ...), and those whose class, id or role names another part. Where these names
take most of the page's text and leave no subtree of an eighth of the sum, they don't weigh
on the elements that hold the largest sum.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perispark.llm.common import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Never part of an article; a form may also be wrapped around a whole page.
DROPPED = RAW | frozenset(
    (
        "head nav footer aside button select option menu dialog svg canvas object video audio map label fieldset"
    ).split()
)
BLOCK = frozenset(
    (
        "address article blockquote body br caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 "
        "header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul"
    ).split()
)
#: Words of a class, id or role that name what isn't the article.
ASIDE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|footer"
    r"|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|comments?|disqus|respond|replies"
    r"|widget|toolbar|search|login|signup|pagination|pager|complementary|contentinfo|alert)(?:$|[-_\s])",
    re.I,
)
#: Words that also name an article's own parts: within article and main they say nothing of an element that isn't mostly links.
PARTS = re.compile(r"(?:^|[-_\s])(?:header|masthead|related|recommended)(?:$|[-_\s])", re.I)
#: An opening tag that ends an open element of these names.
ENDS = {
    "li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPE = frozenset("ul ol dl table article section div body main td th blockquote".split())
CLOSES_P = frozenset(
    (
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
        "section table ul"
    ).split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that group others; beside marked subtrees they stay only by their density.
CONTAINERS = frozenset("address article body center details div figure header main section".split())


class Node:
    __slots__ = (
        "name", "parent", "children", "depth", "scope", "dropped", "named", "part", "inside", "linked", "out",
        "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "marks",
    )

    def __init__(self, name: str, parent: Node | None, named: bool = False, part: bool = False):
        self.name, self.parent, self.named, self.part = name, parent, named, part
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        #: the depth of the nearest element, itself included, that keeps list items and cells in
        self.scope = self.depth if name in SCOPE or parent is None else parent.scope
        self.inside = name in ("article", "main") or (parent is not None and parent.inside)
        self.linked = name == "a" or (parent is not None and parent.linked)
        self.dropped = name in DROPPED or (name == "header" and not self.inside) or (parent is not None and parent.dropped)


def settle(nodes: list[Node]) -> None:
    """Leave forms out, but for one that holds over half of the page's text; let words that name parts of an article
    weigh where they don't do that."""
    for n in nodes:
        n.chars = n.link_chars = 0
    for n in reversed(nodes):
        if n.dropped:
            continue
        own = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        n.chars += own
        n.link_chars += own * n.linked
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars
    for n in nodes:
        up = n.parent
        n.dropped = n.dropped or (n.name == "form" and 2 * n.chars <= nodes[0].chars) or (up is not None and up.dropped)
        n.named = n.named or (n.part and not (up is not None and up.inside and n.chars and n.chars >= 2 * n.link_chars))


def parse(page: str) -> list[Node]:
    """The page's nodes in order, the root first; unclosed and stray tags are borne. Linear in
    the page: elements are popped once, and open ones of a name are known."""
    root = Node("", None)
    nodes, node, at = [root], root, 0
    open_: defaultdict[str, list[Node]] = defaultdict(list)
    low = None

    def close(last: Node, now: Node) -> Node:
        """Close the open elements up to and with last."""
        while True:
            open_[now.name].pop()
            now, done = now.parent, now is last
            if done:
                return now

    while m := TOKEN.search(page, at):
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if m[1]:
            if open_[name] and name not in ("html", "body"):
                node = close(open_[name][-1], node)
            continue
        for ended in (ENDS.get(name), {"p"} if name in CLOSES_P else None):
            if ended and (last := max((open_[x][-1] for x in ended if open_[x]), key=lambda n: n.depth, default=None)):
                if last.depth >= node.scope:
                    node = close(last, node)
        words = [x for g in NAMED.findall(m[3] or "") for x in g if x] if name not in ("html", "body") else []
        child = Node(name, node, any(map(ASIDE.search, words)), any(map(PARTS.search, words)))
        node.children.append(child)
        nodes.append(child)
        if name in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{name}", at)
            end = len(page) if end < 0 else end
            at = (low.find(">", end) + 1 or len(page)) if end < len(page) else end
        elif name not in VOID and not (m[3] or "").rstrip().endswith("/"):
            open_[name].append(child)
            node = child
    if at < len(page):
        node.children.append(page[at:])
    settle(nodes)
    return nodes


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite density of a node; share: the body's link characters by its characters."""
    if not chars:
        return 0.0
    c, t, links, k = chars, max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(c / max(1, c - link_chars) * links + share * c + math.e)
    return max(0.0, c / t * math.log(c / links * t / k) / math.log(base))


def measure(nodes: list[Node], spared: set[Node], names_weigh: bool = True) -> tuple[Node, int]:
    """Fill in all nodes' measures; the body, and the characters that names exclude."""
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = n.marks = 0
        n.density = n.total = 0.0
        n.best = n
        up = n.parent
        n.out = n.dropped or (up is not None and up.out) or (names_weigh and n.named and n not in spared)
    lost = 0
    for node in reversed(nodes):  # children stand after their parent
        if node.dropped:
            continue
        for child in node.children:
            if isinstance(child, str):
                n = len(child.strip())
                if node.out:
                    lost += n
                    continue
                node.chars += n
                if node.linked:
                    node.link_chars += n
            elif not child.out:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_tags += child.link_tags + (child.name == "a")
                node.link_chars += child.link_chars
    body = next((n for n in nodes if n.name == "body" and n.chars), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if not node.out:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in reversed(nodes):
        up = node.parent
        if node.out or not node.chars or up is None:
            continue
        up.total += node.density
    for node in reversed(nodes):  # of equal sums the deeper and then the earlier subtree
        if not node.out and node.chars and node.parent is not None and node.best.total >= node.parent.best.total:
            node.parent.best = node.best
    return body, lost


def path(node: Node, top: Node) -> list[Node]:
    out = [node]
    while out[-1] is not top and out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def mark(nodes: list[Node], body: Node) -> float:
    """Count in each node the marked subtrees it holds; the body path's threshold."""
    threshold = min(n.density for n in path(body.best, body))
    reached, marked = {body}, {body.best}
    if body.best is body:  # the whole page: its parts are judged each
        marked = {n for n in body.children if isinstance(n, Node) and not n.out and n.chars and n.density >= threshold}
    for node in nodes:
        if node.parent in reached and not node.out and node.chars and node.density >= threshold:
            reached.add(node)
            marked.add(node.best)
    for node in reversed(nodes):
        node.marks += node in marked
        if node.parent is not None:
            node.parent.marks += node.marks
    for node in nodes:  # what lies in a marked subtree is taken with it: marks is -1 from there
        if node in marked or (node.parent is not None and node.parent.marks == -1):
            node.marks = -1
    return threshold


def chosen(nodes: list[Node], body: Node) -> Node:
    """The smallest subtree that holds all marked ones; with the heading before it where it has none."""
    top = body
    while top.marks != -1:
        held = [c for c in top.children if isinstance(c, Node) and c.marks]
        if len(held) != 1:
            break
        top = held[0]
    inner = iter(nodes[nodes.index(top) :])
    if any(n.name in HEADINGS and n.chars and not n.out for n in inner if n is top or n.depth > top.depth):
        return top
    at = top
    while at is not body and at.parent is not None:
        for child in at.parent.children:
            if child is at:
                break
            if isinstance(child, Node) and child.name in HEADINGS and not child.out and 0 < child.chars >= 2 * child.link_chars:
                return at.parent
        at = at.parent
    return top


def stays(node: Node) -> bool:
    """Whether an element is text: marked, on the way to a marked one, or a line that isn't mostly links."""
    if node.out:
        return False
    if node.marks:
        return True
    return not node.chars or (node.name not in CONTAINERS and node.chars >= 2 * node.link_chars)


def _texts(top: Node) -> Iterator[str]:
    """Text blocks in page order: block elements and line breaks end one."""
    parts: list[str] = []
    stack: list[tuple[Node, int]] = [(top, 0)]
    while stack:
        node, i = stack.pop()
        if node.name in BLOCK and i in (0, len(node.children)):
            yield "".join(parts)
            parts.clear()
        while i < len(node.children):
            child = node.children[i]
            i += 1
            if isinstance(child, str):
                parts.append(child)
            elif stays(child) and (child.children or child.name in BLOCK):
                if not child.marks:
                    child.marks = -1  # a line that stays is taken whole
                for x in child.children:
                    if child.marks == -1 and isinstance(x, Node):
                        x.marks = -1
                stack += [(node, i), (child, 0)]
                break
        else:
            if node.name in BLOCK and node.children:
                yield "".join(parts)
                parts.clear()
    yield "".join(parts)


def extract(page: str) -> str:
    """The page's main text: blocks with references decoded and white space joined, one space between."""
    if not page:
        return ""
    nodes = parse(page)
    body, lost = measure(nodes, set())
    if lost > body.chars:  # names exclude most of the text: is it an aside or a wrapper?
        least = body.best.total
        everything, _ = measure(nodes, set(), names_weigh=False)
        holders = set(path(everything.best, nodes[0])) if 8 * least < everything.best.total or not least else set()
        body, _ = measure(nodes, holders)
    if not body.chars:
        return ""
    mark(nodes, body)
    blocks = (" ".join(entities.unescape(b).split()) for b in _texts(chosen(nodes, body)))
    return " ".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the main text in out_col (empty where there is none; null html counts as empty).

    Rows are worked on alone: repeated rows give repeated results, an empty table none.
    An existing column out_col is replaced. One scan, no shuffle.
    """

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(html: pd.Series) -> pd.Series:
        return html.map(lambda x: extract(x or ""))

    return pages.withColumn(out_col, texts(F.col(html_col).cast("string")))
