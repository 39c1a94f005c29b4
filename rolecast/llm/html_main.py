"""Main text of web pages: site templates are found by counting element subtrees per host.

First pass: every page is parsed into a tree (unclosed and misnested tags
allowed) and each element outside the article's prose gets a hash of its whole
subtree.  Spark counts on how many different pages of a host each hash stands.
Second pass: subtrees that recur on many pages of their host are deleted, with
the elements whose tag or class says that they are no article (menus, adverts,
comments ...), and the text of the rest is read off block by block.

Prose (paragraphs, headings, lists, quotations, tables) inside an ``article`` or
``main`` element is never deleted for recurring: many articles of a host may
share a passage.

Both passes read whole pages.  Copies of a page count once.  Only the hashes that
recur and stand on a page are joined to it, by a hash of host and content.

Edge cases: a null or empty page has empty text; a null URL is the host "";
copies of a page have equal text; a page of which recurrence would delete
everything keeps what the tags and classes leave; markup in capital letters,
without end tags, or cut off in the middle is read as far as it goes; columns
other than url and html are carried as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.operators.shaping import cut_lineage

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Elements that are never article text.
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe svg math button select textarea dialog menu object "
    "canvas audio video xmp noembed noframes title".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th caption figure "
                  "figcaption b i em strong a span code sub sup small u s q cite br".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that mark something beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices comment comments reply "
    "replies disqus share sharing social related newsletter subscribe popup modal pagination pager toolbar widget "
    "contentinfo complementary search skip".split())
#: Further words of that kind on a page without an article or main element.
BESIDE_PAGE = frozenset("header topbar masthead logo branding toolbar".split())
MAIN = frozenset({"article", "main"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|"
                    r"<([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^<>\"]*\"|'[^<>']*')*|[^>]*)>|[^<]+|<", re.S)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_MASK = (1 << 63) - 1


class Node:
    __slots__ = ("tag", "marks", "kids", "hidden")

    def __init__(self, tag: str, attrs: str):
        self.tag = tag
        self.kids: list = []
        self.marks = {w for m in _MARKS.finditer(attrs) for w in _SPLIT.split(m[1].lower())} if attrs else frozenset()
        self.hidden = bool(attrs) and _HIDDEN.search(attrs) is not None

    def beside(self) -> bool:
        return self.tag in DROPPED or self.hidden or not self.marks.isdisjoint(BESIDE)


def parse(page: str) -> Node:
    """Tree of elements and text pieces (still with character references)."""
    root = Node("html", "")
    stack = [root]
    end = len(page)
    pos = 0
    while pos < end:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        shut, tag = m[1], m[2]
        if tag:
            tag = tag.lower()
            if tag in ENDS_P:
                _close(stack, {"p"}, BLOCKS - {"p", "br"})
            if tag in SAME:
                _close(stack, SAME[tag], {"ul", "ol", "dl", "table", "select"})
            if tag == "html":
                continue
            node = Node(tag, m[3])
            stack[-1].kids.append(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, pos)
                node.kids.append(page[pos: close.start() if close else end])
                pos = close.end() if close else end
            elif tag not in VOID and not (m[3] or "").endswith("/"):
                stack.append(node)
        elif shut:
            shut = shut.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == shut:
                    del stack[i:]
                    break
        elif m[0][:2] not in ("<!", "<?"):
            stack[-1].kids.append(m[0])
    return root


def _close(stack: list[Node], tags: set[str], walls: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in walls:
            return


def _hash(text: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def subtree_hashes(root: Node, host: str) -> dict[int, int]:
    """{id(node): hash} for elements with text outside the prose of a main element, children first (no recursion)."""
    out: dict[int, int] = {}
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        inside = inside or node.tag in MAIN
        todo.extend((k, inside) for k in node.kids if isinstance(k, Node))
    own: dict[int, int] = {}
    for node, inside in reversed(order):
        parts = [node.tag]
        parts += [" ".join(k.split()) if isinstance(k, str) else str(own[id(k)]) for k in node.kids]
        own[id(node)] = h = _hash("\x00".join(parts))
        if node.tag not in ("html", "body") and node.tag not in MAIN and not (inside and node.tag in PROSE) and node.kids:
            out[id(node)] = (h ^ _hash(host)) & _MASK
    return out


def main_element(root: Node) -> Node:
    """The outermost article or main element with the most text, else the page."""
    best, most, todo = root, 0, [root]
    while todo:
        node = todo.pop()
        if node.tag in MAIN and not node.beside():
            size = _text_size(node)
            # The first of equal ones, since the stack is walked from the last child.
            if size >= most and size > 0:
                best, most = node, size
        elif not node.beside():
            todo.extend(k for k in node.kids if isinstance(k, Node))
    return best


def _text_size(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                total += len(k)
            else:
                todo.append(k)
    return total


def blocks_text(root: Node, gone: set[int]) -> str:
    """Text of the blocks under ``root`` without the deleted elements."""
    blocks: list[str] = []
    piece: list[str] = []
    extra = frozenset() if root.tag in MAIN else BESIDE_PAGE

    def cut() -> None:
        if piece:
            line = " ".join(html.unescape("".join(piece)).split())
            if line:
                blocks.append(line)
            piece.clear()

    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            cut()
        elif isinstance(item, str):
            piece.append(item)
        elif item is root or not (id(item) in gone or item.beside() or _page_header(item) or not item.marks.isdisjoint(extra)):
            if item.tag in BLOCKS:
                cut()
                todo.append(None)
            todo.extend(reversed(item.kids))
    cut()
    return "\n".join(blocks)


def _page_header(node: Node) -> bool:
    """A header that carries no heading of an article."""
    if node.tag != "header":
        return False
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag in ("h1", "h2"):
            return False
        todo.extend(k for k in n.kids if isinstance(k, Node))
    return True


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def recurring_subtrees(pages: DataFrame, min_pages: int) -> DataFrame:
    """(_key, _gone): per page content, the hashes of its subtrees that stand on ``min_pages`` pages of the host or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = [], []
            for key, host, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = set(subtree_hashes(parse(page or ""), host or "").values())
                keys += [key] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], names=["_key", "_hash"])

    rows = cut_lineage(
        pages.select("_key", "_host", "_html").mapInArrow(run, "_key bigint, _hash bigint").distinct(), "html-subtrees")
    often = rows.groupBy("_hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("_hash")
    # At most the subtrees of one page in a list.
    return rows.join(often, "_hash").groupBy("_key").agg(F.collect_list("_hash").alias("_gone"))


def extract(pages: DataFrame, page: str = "html", url: str = "url", keep: list[str] | None = None,
            min_pages: int = 10) -> DataFrame:
    """The columns ``keep`` (default: all) with ``main_text``: the article's blocks, one per line."""
    names = [c for c in (keep if keep is not None else pages.columns) if c != "main_text"]
    packed = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(page).alias("_html"), host_of(F.col(url)).alias("_host"))
    packed = packed.withColumn("_key", F.xxhash64("_host", "_html"))
    joined = packed.join(recurring_subtrees(packed, min_pages), "_key", "left").select("_doc", "_host", "_html", "_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, raw, gone in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                texts.append(page_text(raw or "", host or "", set(gone or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_doc", "main_text"])

    schema = f"_doc {joined.schema['_doc'].dataType.simpleString()}, main_text string"
    return joined.mapInArrow(run, schema).select("_doc.*", "main_text")


def page_text(raw: str, host: str, recurring: set[int]) -> str:
    root = parse(raw)
    gone = {node for node, h in subtree_hashes(root, host).items() if h in recurring} if recurring else set()
    top = main_element(root)
    return blocks_text(top, gone) or blocks_text(top, set())
