"""Main text of web pages by composite text density.

A page is parsed into a tree. Each node's composite density is its characters per tag, scaled down by the share of
characters inside links; a stretch of text counts as a node of one tag. The node whose children's densities sum to
the most is the core of the main text. The threshold is the least density on the path from it up to the body (up to
the `article` or `main` around it, where there is one: what surrounds those is menus more often than text).

The core's container is the main region. From the body down, every other subtree of threshold density or more is text
as well, and so are headings beside a region; all in page order. Left out everywhere are subtrees that their element,
role, class or id marks as chrome (menus, headers, footers, sidebars, notices, adverts, forms, comments), and lists of
links under the threshold.
"""

from __future__ import annotations

import html as entities
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightloom.llm.common import fresh

#: Comments and the like, end tags, start tags. A quote opens a string only behind an equals sign.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*|))*+)(?:>|\Z)",
    re.S,
)
_MARK = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg canvas audio video head noframes".split())
VERBATIM = frozenset("script style textarea title xmp iframe noembed noframes".split())
CHROME = frozenset("nav header footer aside form button select option textarea input fieldset dialog menu menuitem".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold the parts of a text, rather than being one.
CONTAINERS = frozenset("html body article main section div td center details".split())
LANDMARKS = frozenset("article main".split())
#: Words in a class or id that mark chrome, whatever words are beside them.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies gdpr sidebar navbar breadcrumb "
    "breadcrumbs masthead comment comments commentlist disqus newsletter onetrust cookiebot disclaimer".split()
)
#: A name that ends so tells a state of the text or of the page, such as whether comments are open.
STATES = frozenset("enabled disabled open closed allowed off on count status active".split())
#: A name that ends so is of a text, unless it is of an advert or a comment.
TEXT_ENDS = frozenset("article story entry post".split())
NO_TEXT = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored comment comments".split())
#: Names of reader comments, outside of the article's own element.
READERS = frozenset("discussion discussions responses respond".split())
#: Words that mark chrome where nothing but such words and neutral ones are in the name.
CHROME_NAMES = frozenset(
    "header footer menu nav navigation side aside notice notices banner consent alert popup modal overlay promo promotion reply replies "
    "share sharing social related recommended subscribe signup login search toolbar widget widgets pagination pager".split()
)
NEUTRAL_WORDS = frozenset(
    "site page global top bottom left right upper lower main primary secondary mobile desktop user reader box bar area block container "
    "wrapper wrap inner outer row col column list item items section panel links link icons buttons button form the of my sticky fixed".split()
)
#: A name that starts so tells a state, and a name of such words alone is of text.
STATE_WORDS = frozenset("has with without no is not".split())
TEXT_WORDS = frozenset("content contents article post entry story body text main page".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: A start tag closes the open elements that it can't be inside of, up to an element that bounds the search.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "parent", "children", "chrome", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, chrome: bool):
        self.tag, self.parent, self.chrome = tag, parent, chrome
        self.children: list[Node | str] = []


@lru_cache(maxsize=65536)
def _kind(name: str) -> str:
    """Of a class or id: `chrome`, `readers` (their comments), `text` or nothing in particular."""
    parts = [p.lower() for p in _NAME.findall(name)]
    if not parts or parts[0] in STATE_WORDS:
        return ""
    if len(parts) > 1 and (parts[-1] in STATES or parts[-1] in TEXT_ENDS and not NO_TEXT.intersection(parts)):
        return ""
    if CHROME_WORDS.intersection(parts):
        return "chrome"
    if READERS.intersection(parts) and all(p in READERS or p in NEUTRAL_WORDS or p.isdigit() for p in parts):
        return "readers"
    if all(p in TEXT_WORDS for p in parts):
        return "text"
    if CHROME_NAMES.intersection(parts) and all(p in CHROME_NAMES or p in NEUTRAL_WORDS or p.isdigit() for p in parts):
        return "chrome"
    return ""


def _is_chrome(tag: str, attributes: str, in_text: bool) -> bool:
    if tag in CHROME and not (tag == "header" and in_text):
        return True
    if tag in ("html", "body", "main") or not attributes:
        return False
    kinds = set()
    for m in _MARK.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in CHROME_ROLES:
                return True
        else:
            kinds.update(_kind(name) for name in value.split())
    if "readers" in kinds and not in_text and tag != "article":
        return True
    # An article is left out only as a comment; a header in one, or a name of text beside, isn't chrome.
    if tag == "article":
        return "comment" in attributes.lower() and "chrome" in kinds
    return "chrome" in kinds and "text" not in kinds and not (tag == "header" and in_text)


def parse(page: str) -> Node:
    """The tree of a page, however broken: unknown end tags are ignored, open elements end with their parents."""
    root = Node("html", None, False)
    at, pos, n = root, 0, len(page)
    open_tags = {"html": 1}

    def close(node: Node) -> Node:
        """Ends the open elements down from `node`, itself included."""
        nonlocal at
        while True:
            open_tags[at.tag] -= 1
            done, at = at, at.parent
            if done is node:
                return at

    while pos < n:
        m = _TOKEN.search(page, pos)
        if not m:
            at.children.append(page[pos:])
            break
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag not in VOID and tag != "html" and open_tags.get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                close(node)
        elif m[2]:
            tag = m[2].lower()
            if tag == "html":
                continue
            if tag in VOID:
                at.children.append(Node(tag, at, False))
                continue
            if tag in BLOCK and open_tags.get("p"):  # a block ends an open paragraph and what is in it
                node = at
                while node.tag != "p":
                    node = node.parent
                close(node)
            if tag in CLOSES:
                node = at
                while node and node.tag not in BOUNDS[tag]:
                    if node.tag in CLOSES[tag]:
                        close(node)
                        node = at
                    else:
                        node = node.parent
            if tag == "body" and open_tags.get("head"):
                node = at
                while node.tag != "head":
                    node = node.parent
                close(node)
            node = Node(tag, at, _is_chrome(tag, m[3], bool(open_tags.get("article") or open_tags.get("main"))))
            at.children.append(node)
            if tag in VERBATIM:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, pos)
                node.children.append(page[pos : end.start()])
                pos = end.end()
            elif not m[0].endswith("/>") or tag not in ("svg", "math"):
                at = node
                open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def _counted(root: Node) -> list[Node]:
    """All nodes, parents first, with their counts: characters, tags, and both inside links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.children) if not isinstance(x, str))
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        if node.tag in RAW:
            continue
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(x.strip())
            elif x.tag not in RAW:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
            node.link_tags = node.tags
    return order


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body: Node) -> float:
    """Characters per tag, scaled down the more of them lie in links, against the body's own share."""
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(tags, 1), link_chars, max(link_tags, 1)
    base = math.log(c * lc / max(c - lc, 1) + body.link_chars * c / max(body.chars, 1) + math.e)
    found = c / t * math.log(c * t / (max(lc, 1) * lt) + 1e-9) / math.log(base) if base > 1 else c / t
    return max(0.0, found)


def _text_density(text: str, body: Node) -> float:
    return _density(len(text.strip()), 1, 0, 0, body)


def main_node(root: Node) -> tuple[Node, Node, float]:
    """The body, the node with the largest sum of its children's densities (ties to the first in page order), and the
    least density on the path to it. Chrome takes no part; a form around most of the page isn't chrome."""
    order = _counted(root)
    body = next((x for x in order if x.tag == "body"), root)
    for node in order:
        if node.tag == "form" and 2 * node.chars > body.chars:
            node.chrome = False
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, body) if node.tag not in RAW else 0.0
    within, best, most = {id(body)}, body, -1.0
    for node in order:
        if node is not body and (node.parent is None or id(node.parent) not in within or node.chrome or node.tag in RAW):
            continue
        within.add(id(node))
        total = sum(_text_density(x, body) if isinstance(x, str) else x.density for x in node.children if isinstance(x, str) or not x.chrome)
        if total > most:
            best, most = node, total
    landmark = node = best
    while node is not body and node.parent is not None:
        landmark, node = node if node.tag in LANDMARKS else landmark, node.parent
    top = landmark if landmark.tag in LANDMARKS else body
    threshold, node = best.density, best
    while node is not top and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    return body, best, threshold


def _regions(body: Node, best: Node, threshold: float) -> set[int]:
    """Ids of the nodes whose subtrees are the main text."""
    region = best
    while region.tag not in CONTAINERS and region.parent is not None and region is not body:
        region = region.parent
    path, node = set(), region
    while node is not body and node.parent is not None:
        if node.tag in LANDMARKS:
            region, path = node, set()
        node = node.parent
        path.add(id(node))
    path.discard(id(region))
    found: set[int] = {id(region)}
    headings: list[Node] = []
    holds = set(path)  # nodes with a region below them
    stack = [body] if body is not region else []
    while stack:
        node = stack.pop()
        for x in node.children:
            if isinstance(x, str) or x.chrome or x.tag in RAW or id(x) in found:
                continue
            if id(x) not in path and x.chars and (x.density >= threshold or x.tag == "article"):
                found.add(id(x))
                while id(node) not in holds:
                    holds.add(id(node))
                    node = node.parent
                node = x.parent
            elif x.tag in HEADINGS:
                headings.append(x)
            else:
                stack.append(x)
    return found | {id(x) for x in headings if id(x.parent) in holds}


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by line feeds; empty for null, or where there is none."""
    if not page:
        return ""
    body, best, threshold = main_node(parse(page))
    regions = _regions(body, best, threshold)
    blocks: list[list[str]] = [[]]
    # Depth first without recursion: pages nest without bound. A node closes, or opens outside or inside a region.
    stack: list[tuple[Node | str, bool, bool]] = [(body, True, False)]
    while stack:
        x, opens, inside = stack.pop()
        if isinstance(x, str):
            if inside or _text_density(x, body) >= threshold:
                blocks[-1].append(x)
            continue
        if not opens:
            blocks.append([])
            continue
        starts = not inside and id(x) in regions
        inside = inside or starts
        if x.tag in RAW and x.tag not in BLOCK:
            continue
        if x.tag in RAW or (x.chrome and not starts):
            # What stands in a line of text, as a button does, leaves a gap in it.
            if x.tag in BLOCK:
                blocks.append([])
            else:
                blocks[-1].append(" ")
            continue
        if inside and not starts and x.tag in ("ul", "div", "section", "table") and x.link_chars > 0.5 * x.chars and x.density < threshold:
            blocks.append([])
            continue
        if x.tag == "br":
            blocks[-1].append(" ")
            continue
        if x.tag in BLOCK:
            blocks.append([])
            stack.append((x, False, inside))
        stack.extend((c, True, inside) for c in reversed(x.children))
    out = []
    for parts in blocks:
        if line := _SPACE.sub(" ", entities.unescape("".join(parts))).strip():
            out.append(line)
    return "\n".join(out)


def extracted(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns but `html`, with the main text in `out` (an input column of that name is replaced).

    A null or empty page has an empty text. Pages are parsed one by one and whole, however long: repeated rows give
    repeated results, equal densities go to the node that comes first, an empty table gives no rows, other columns are
    kept as they are.
    """
    carry = [c for c in pages.columns if c.lower() not in (html.lower(), out.lower())]
    h = fresh(pages, "_html")
    source = pages.select(*carry, F.col(html).alias(h))
    schema = source.select(*carry, F.lit("").alias(out)).schema

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*carry, out])

    return source.mapInArrow(run, schema)


def op7_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page, by `extracted`: a null or empty page has an empty one, pages are read whole, repeated
    rows give repeated results, an empty table gives no rows; other columns don't matter."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
