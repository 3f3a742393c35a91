"""Main text of web pages by composite text density.

Every node of the page's tree gets its characters per tag, adjusted by the share of
characters and tags that links hold. The subtree whose children's densities have the
greatest sum is the content (of a block of text what holds it); the least density on its path to the body is the threshold
that other subtrees must reach. It grows to a parent whose other children together are
half as dense as that, and takes the headings before it.

Elements whose kind or role says that they are no text of the page (menus, footers, side
bars, scripts, hidden ones) are no part of the tree. A class, an id or a form only breaks
ties: without such elements the densest subtree is looked for first, and it stands unless
theirs has twice the sum and no headline or article stands elsewhere; in what is taken,
those that hold less than half are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by their role in a page.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = RAW | frozenset("nav footer aside button select option optgroup datalist label fieldset legend dialog menu head svg math canvas object audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login"
    r"|nav|navbar|navigation|menu|submenu|breadcrumb|breadcrumbs|pager|pagination|header|masthead|topbar|footer|footnotes|copyright|sidebar|side|aside|widget|related|recommended|share|sharing|social|toolbar|comment|comments|commentlist|respond|replies|disqus|discussion|skip)(?:$|[\s_-])"
)
#: An open element of the first kind ends when one of the second kind begins.
ENDS = {"p": BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: What such an implied end doesn't reach across.
WALLS = frozenset("ul ol dl table td th article section div body html aside nav header footer form main blockquote".split())

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>\"'=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']*+)[^>\"'=]*+)*+)>|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*>)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACE = re.compile(r"\s+")
END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Node:
    """An element: its children and texts in order, and what its subtree holds."""

    __slots__ = ("tag", "parent", "parts", "out", "doubted", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: bool, doubted: bool = False):
        self.tag, self.parent, self.parts, self.out, self.doubted = tag, parent, [], out, doubted


def _is_named(attributes: str) -> bool:
    """Whether a word of the class or id is one of NAMES."""
    return any(name.lower() in ("class", "id") and NAMES.search("".join(values).lower()) for name, *values in ATTRIBUTE.findall(attributes))


def _is_dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or attributes.isspace():
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "style" and HIDDEN.search(value):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
    return False


def parse(page: str) -> Node:
    """The tree of ``page``; elements left open end where their parents do."""
    root = node = Node("body", None, False)
    at, articles = 0, 0
    find = TAG.search
    while True:
        m = find(page, at)
        if m is None:
            if at < len(page):
                node.parts.append(page[at:])
            return root
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at, tag = m.end(), m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                if up.tag in WALLS and tag not in WALLS:
                    break
                up = up.parent
            if up is not root and up.tag == tag:
                while node is not up:
                    articles -= node.tag == "article"
                    node = node.parent
                articles -= node.tag == "article"
                node = node.parent
            elif tag == "p":
                node.parts.append(Node("p", node, node.out))
            continue
        if tag in ("html", "body"):
            continue
        up = node
        while up is not root and up.tag not in WALLS | {"li", "dt", "dd", "option", "tr", "td", "th", "p"}:
            up = up.parent
        while up is not root and tag in ENDS.get(up.tag, ()):
            while node is not up:
                node = node.parent
            node = up = up.parent
            while up is not root and up.tag not in ENDS and up.tag not in WALLS:
                up = up.parent
        named = bool(m[3]) and not m[3].isspace() and _is_named(m[3])
        new = Node(tag, node, node.out or _is_dropped(tag, m[3], articles > 0), tag == "form" or named and tag not in ("article", "main"))
        if tag in ("h1", "article", "main") and not named and not new.out:
            up = node
            while up is not None:  # what holds the headline or an article is none of what its name says
                up.doubted = False
                up = up.parent
        node.parts.append(new)
        if tag in RAW:
            end = END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            articles += tag == "article"
            node = new


def _walk(root: Node) -> list[Node]:
    """All nodes that stay, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.out:
            out.append(node)
            todo += [x for x in reversed(node.parts) if type(x) is not str]
    return out


def composite(chars: int, tags: int, link_chars: int, link_tags: int, of_body: float) -> float:
    """Characters per tag, times the logarithm of their ratios to those of links, to a base that grows with the links' share."""
    if not chars:
        return 0.0
    tags = tags or 1
    base = math.log(chars / max(1, chars - link_chars) * link_chars + of_body * chars + math.e)
    return chars / tags * max(0.0, math.log(max(chars / (link_chars or 1) * tags / (link_tags or 1), 1.0))) / max(base, 1.0)


def measure(root: Node) -> list[Node]:
    """Set every node's composite density and its children's sum; the nodes, parents first."""
    nodes = _walk(root)
    for node in reversed(nodes):
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        for x in node.parts:
            if type(x) is str:
                node.chars += len(x) - x.count(" ") - x.count("\n")
            elif not x.out:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    of_body = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(nodes):
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, of_body)
        node.total = math.fsum(x.density for x in node.parts if type(x) is not str and not x.out)
        if not node.total and node.chars:
            node.total = node.density * 1e-9  # only texts: before an empty node, after any with children
    return nodes


def _best(nodes: list[Node]) -> Node:
    return max(nodes, key=lambda n: n.total)  # the first, so the outer one, of equals


def _selected(root: Node) -> Node:
    """The subtree with the greatest sum of densities, doubted elements settled: those that are no text of the page are out."""
    doubted = [n for n in _walk(root) if n.doubted]
    if not doubted:
        return _best(measure(root))
    first = _best(measure(root))
    total = first.total
    for node in doubted:
        node.out = True
    best = _best(measure(root))
    plain = any(n.tag in ("h1", "article", "main") for n in _walk(root))
    if not best.chars or not plain and total > 2 * best.total:
        around, node = set(), first
        while node is not None:
            around.add(id(node))
            node = node.parent
        for node in doubted:
            node.out = False
        measure(root)
        for node in doubted:
            node.out = id(node) not in around and 2 * node.chars < first.chars
        nodes = measure(root)
        best = first if first.total else _best(nodes)
    return best


def _thin(nodes: list[Node], threshold: float, in_article: bool, of_body: float) -> bool:
    """Whether ``nodes`` together are less than half as dense as the threshold, or in an article mostly links."""
    c, t, lc, lt = (sum(getattr(n, k) for n in nodes) for k in ("chars", "tags", "link_chars", "link_tags"))
    return 2 * lc >= c if in_article else 2 * composite(c, t + len(nodes), lc, lt, of_body) < threshold


def content(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    best = _selected(root)
    if not best.chars:
        return []
    while best is not root and not any(type(x) is not str and not x.out and x.chars and x.tag in BLOCKS for x in best.parts):
        best = best.parent  # a block of text stands for what holds it
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold, of_body = min(n.density for n in path), root.link_chars / root.chars
    while best is not root and best.parent is not root:
        beside = [x for x in best.parent.parts if type(x) is not str and not x.out and x is not best and x.chars]
        if beside and _thin(beside, threshold, best.parent.tag in ("article", "main"), of_body):
            break
        best = best.parent
    if best is root:
        return [root]
    kept, inside = [], set(map(id, path))
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, heads = todo.pop()
        if node is best or heads or id(node) not in inside and node.chars and node.density >= threshold:
            kept.append(node)
        elif id(node) in inside:
            parts = [x for x in node.parts if type(x) is not str and not x.out and (x.chars or id(x) in inside)]
            at = next(k for k, x in enumerate(parts) if id(x) in inside)
            first = at
            while first and (parts[first - 1].tag in HEADINGS or node.tag in ("article", "main")):
                first -= 1
            todo += [(x, first <= k < at) for k, x in reversed(list(enumerate(parts)))]
    return kept


def blocks(node: Node) -> Iterator[str]:
    """Texts of the subtree's blocks in page order, references decoded, white space folded."""
    held: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            if text := SPACE.sub(" ", html.unescape("".join(held))).strip():
                yield text
            held.clear()
        elif type(x) is str:
            held.append(x)
        elif x.tag == "br":
            held.append("\n")
        elif not x.out:
            block = x.tag in BLOCKS
            if block:
                todo.append(None)
            todo += reversed(x.parts)
            if block:
                todo.append(None)
    if text := SPACE.sub(" ", html.unescape("".join(held))).strip():
        yield text


def main_text(page: str | None) -> str:
    """The main text of one page; '' for none."""
    return "\n".join(text for node in content(parse(page)) for text in blocks(node)) if page else ""


def extract_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(*keep, text, n_chars) for every row of ``df``, in one pass without a shuffle.

    A null or empty page, and one without main text, gives '' and 0. Whole pages of any
    length are read; broken markup and bare text are taken as browsers take them. Repeated
    rows and nulls in ``keep`` stay; other columns are not read, whatever their names.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"],
            )

    return df.select(*keep, html_col).mapInArrow(run, f"{schema}, text string, n_chars long")
