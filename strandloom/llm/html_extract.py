"""Main text of web pages by composite text density.

A lenient parser builds the tree; what is never article text (scripts, styles, forms, navigation, asides and
containers whose class, id or role says menu, advert, notice, comments and the like) is taken out. For each node
that is left the composite density is its characters per tag, scaled down as link characters and link tags grow.
The sum of the densities of a node's child blocks is largest at the node that holds the article (inline elements
are part of their block's text); a heading beside it and an enclosing article element belong to it. The least density on the path
from it to the body is the threshold: each subtree at or above it contributes its own largest-sum node. Blocks of
the chosen nodes, in page order, are the text.

Defined cases: null or empty html gives an empty text; a page without a body is its own body; unclosed and
mismatched tags are read as browsers do in the common cases; rows with equal ids stay rows; an empty table gives
no rows; other columns are ignored. Nothing in a chosen subtree is dropped or cut short.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow_batches, read_table, slices, with_rest

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math select object".split())
DROPPED = frozenset("head nav footer aside form button menu dialog fieldset label canvas audio video figure".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag of the key closes an open element of the value.
CLOSES = {
    **{t: frozenset({"p"}) for t in BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}},
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
}
#: Elements that the closing of an outer element of the same kind does not cross.
SCOPE = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"})}
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside widget widgets related recommended share sharing social footer cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies pagination pager skip "
    "masthead topbar toolbar copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
WORD = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def boilerplate(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED:
        return tag != "figure" or not inside_article
    if tag == "header" and not inside_article:
        return True
    if tag in ("body", "html", "article", "main") or not attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag in BLOCK | {"span"}:
            words = WORD.findall(value)
            if any(w in HINTS for w in words) or ("header" in words and not inside_article):
                return True
    return False


def parse(page: str) -> Node:
    root = Node("#root", None)
    node, at, article = root, 0, 0
    match = TAG.search(page)
    while match:
        if match.start() > at:
            node.items.append(page[at : match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if tag:
            if match[1] or match[4]:
                up = node
                while up is not root and up.tag != tag:
                    if tag not in BLOCK and up.tag in BLOCK:  # an inline end tag does not close blocks
                        up = root
                        break
                    up = up.parent
                if up is not root:
                    while node is not up.parent:
                        article -= node.tag in ("article", "main")
                        node = node.parent
            else:
                closes = CLOSES.get(tag)
                if closes:
                    up, last, stop = node, None, SCOPE.get(tag, frozenset())
                    while up is not root and up.tag not in stop and (up.tag not in BLOCK or up.tag in closes):
                        if up.tag in closes:
                            last = up
                        up = up.parent
                    if last is not None:
                        node = last.parent
                attributes = match[3] or match[6] or ""
                child = Node(tag, node, boilerplate(tag, attributes, article > 0))
                node.items.append(child)
                if tag in RAW and not attributes.endswith("/"):
                    end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
                    if end:
                        close = page.find(">", end.start())
                        at = len(page) if close < 0 else close + 1
                    elif tag != "noscript":
                        at = len(page)
                elif tag not in VOID:
                    node = child
                    article += tag in ("article", "main")
        match = TAG.search(page, at)
    if at < len(page):
        node.items.append(page[at:])
    return root


def measure(root: Node) -> list[Node]:
    """Counts of the nodes that are left; they come back with parents before children."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(x for x in reversed(n.items) if isinstance(x, Node) and not x.drop)
    for n in reversed(order):
        for x in n.items:
            if isinstance(x, str):
                n.chars += sum(map(len, x.split()))
            elif not x.drop:
                n.chars += x.chars
                n.tags += x.tags + 1
                n.link_chars += x.link_chars
                n.link_tags += x.link_tags + (x.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    return order


def densities(order: list[Node], body: Node) -> None:
    share = body.link_chars / max(1, body.chars)
    for n in reversed(order):
        n.total = sum(x.density for x in n.items if isinstance(x, Node) and not x.drop and x.tag in BLOCK)
        if n.tag in VOID or not n.chars:
            continue
        n.density = n.chars / max(1, n.tags)
        if body.link_chars:
            base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + math.e)
            ratio = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)
            n.density *= max(0.0, math.log(ratio)) / max(math.log(base), 0.05)


def lifted(n: Node, body: Node) -> Node:
    """The nearest enclosing article element, or the parent that adds little more than a heading."""
    up = n
    while up is not None and up is not body:
        if up.tag == "article":
            return up
        up = up.parent
    while n is not body and n.parent is not None and n.parent is not body:
        heads = any(isinstance(x, Node) and not x.drop and x.tag in ("h1", "h2", "header", "hgroup") for x in n.parent.items)
        if not heads or n.parent.chars > 1.25 * n.chars + 200:
            break
        n = n.parent
    return n


def chosen(order: list[Node], body: Node) -> set[int]:
    """Identities of the subtrees that hold the article."""
    position = {id(n): k for k, n in enumerate(order)}
    ends = [0] * len(order)
    for k in range(len(order) - 1, -1, -1):
        ends[k] = max([k + 1, *(ends[position[id(x)]] for x in order[k].items if isinstance(x, Node) and not x.drop)])
    best = [0] * len(order)  # position of the largest sum in each subtree, the first of equals
    for k in range(len(order) - 1, -1, -1):
        best[k] = k
        for x in order[k].items:
            if isinstance(x, Node) and not x.drop and order[best[position[id(x)]]].total > order[best[k]].total:
                best[k] = best[position[id(x)]]
    at = position[id(body)]
    top = order[best[at]]
    least, n = top.density, top
    while n is not body and n.parent is not None:
        n = n.parent
        least = min(least, n.density)
    marked: set[int] = set()
    k = at
    while k < ends[at]:
        n = order[k]
        if k != at and n.chars and n.density >= least or k == at:
            pick = best[k] if order[best[k]].total > 0 else k
            marked.add(id(lifted(order[pick], body)))
            if pick == k:
                k = ends[k]
                continue
        k += 1
    return marked


def blocks(body: Node, marked: set[int]) -> list[str]:
    """White-space-normal texts of the blocks under marked nodes, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append(text)

    stack: list[tuple[Node | str, bool, bool]] = [(body, False, False)]
    while stack:
        x, inside, end = stack.pop()
        if isinstance(x, str):
            if inside:
                run.append(html.unescape(x) if "&" in x else x)
            continue
        if end:
            flush()
            continue
        if x.drop:
            if x.tag in BLOCK:
                flush()
            continue
        if x.tag == "br":
            run.append(" ")
            continue
        now = inside or id(x) in marked
        if x.tag in BLOCK or now and not inside:
            flush()
            stack.append((x, now, True))
        stack.extend((y, now, False) for y in reversed(x.items))
    flush()
    return out


def main_text(page: str) -> str:
    """The article of a page, blocks joined by a line feed."""
    root = parse(page)
    order = measure(root)
    body = next((n for n in order if n.tag == "body"), None)
    body = body if body is not None and body.chars * 2 >= root.chars else root
    if not body.chars:
        return ""
    densities(order, body)
    return "\n".join(blocks(body, chosen(order, body)))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    with_rest(pages, id_col, url_col, html_col)
    bound_arrow_batches(pages.sparkSession)
    p = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = pa.array([main_text(x) for x in part.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), texts], names=["page_id", "url", "text"])

    return p.mapInArrow(run, "page_id long, url string, text string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(read_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
