"""Main text of web pages by site template removal.

Every page is parsed to a tree and its element subtrees are hashed. Spark counts, per host, on how many
pages with different content each subtree stands; subtrees that recur are the site's template and are
deleted. What marks itself as no content (navigation, forms, adverts, comments ...) goes too. The
paragraphs of an explicit article are never taken for a template: copies of an article on one host, or
a sentence that many articles share, are content.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from visitline.session import materialize, ship_package

MIN_PAGES = 5  # a template stands on at least so many different pages of its host, however large that is
BROADCAST_TEMPLATES = 200_000  # up to so many (host, subtree) rows go to all tasks, else a join moves the pages

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Fixed names of the markup language and of common page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noframes".split())
SILENT = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video map select option button input textarea "
    "form nav footer aside dialog menu fieldset label title noframes".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl table header footer aside nav form figure".split())
ENDS_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "html", "body"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
BOILERPLATE = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer bottombar colophon sidebar sidenav aside "
    "widget widgets ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist respond reply replies discussion disqus pagination pager toolbar skip search searchform paywall".split()
)
COMMENTS = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
MAIN_NAMES = frozenset("article post entry story content main maincontent articlebody".split())


class Node:
    __slots__ = ("tag", "names", "marks", "kids", "up", "key")

    def __init__(self, tag: str, names: frozenset, marks: str, up: Node | None):
        self.tag, self.names, self.marks, self.up, self.kids, self.key = tag, names, marks, up, [], None


def parse(page: str) -> Node:
    """The element tree; unclosed and stray tags are settled as browsers do for common cases."""
    root = here = Node("#root", frozenset(), "", None)
    at, n = 0, len(page)
    while at < n:
        less = page.find("<", at)
        found = _TAG.match(page, less) if less >= 0 else None
        if less < 0:
            here.kids.append(page[at:])
            break
        if found is None:
            here.kids.append(page[at : less + 1])
            at = less + 1
            continue
        if less > at:
            here.kids.append(page[at:less])
        at = found.end()
        if found[1]:
            tag, node = found[1].lower(), here
            while node is not root and node.tag != tag:
                node = node.up
            if node is not root:
                here = node.up
            continue
        name = found[2] or found[4]
        if not name:
            if found[0].startswith("<![CDATA["):
                here.kids.append(found[0][9:-3])
            continue
        tag, raw = name.lower(), found[3] or found[5] or ""
        if not page.endswith(">", less, at):  # cut off inside a tag
            break
        if tag in ENDS_P:
            here = _close(here, ("p",), ("button", "td", "th", "table", "div", "section", "article", "main", "body", "li", "blockquote"), root)
        if tag in SIBLINGS:
            here = _close(here, SIBLINGS[tag], SCOPES[tag], root)
        names, marks = frozenset(), ""
        if raw.strip(" /"):
            values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
            words = " ".join(values.get(k, "") for k in ("class", "id", "role", "itemprop")).lower()
            names = frozenset(re.split(r"[^a-z0-9]+", words)) - {""}
            if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
                marks = "hidden"
        node = Node(tag, names, marks, here)
        here.kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            node.kids.append(page[at : close.start() if close else n])
            at = close.end() if close else n
        elif tag not in VOID and not raw.endswith("/"):
            here = node
        elif tag not in VOID and tag not in ("svg", "path", "use"):
            here = node  # a slash on an ordinary element has no meaning
    return root


def _close(here: Node, tags: tuple, scope: tuple, root: Node) -> Node:
    node = here
    while node is not root and node.tag not in scope:
        if node.tag in tags:
            return node.up
        node = node.up
    return here


def silent(node: Node, inside: bool) -> bool:
    """Whether an element says itself that it holds no main text."""
    if node.tag in SILENT or node.marks:
        return True
    if node.tag == "header" and not inside:
        return True
    return bool(node.names & BOILERPLATE) and node.tag not in ("html", "body", "p") and not (node.tag in HEADINGS)


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))


def raw_text(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            stack.extend(reversed(item.kids))
    return "".join(out)


def main_roots(root: Node) -> list[Node]:
    """Explicit holders of the main text: articles, else main, else the largest element with a main name."""

    def blocked(node: Node) -> bool:
        up = node
        while up is not None:
            if up.names & COMMENTS or (up is not node and up.tag in ("aside", "nav", "footer", "article")):
                return True
            up = up.up
        return False

    nodes = list(walk(root))
    for test in (lambda x: x.tag == "article", lambda x: x.tag == "main" or ("main" in x.names and x.tag != "html" and x.tag != "body")):
        found = [x for x in nodes if test(x) and not blocked(x)]
        if found:
            return [x for x in found if not any(_inside(x, y) for y in found if y is not x)] if len(found) > 1 else found
    named = [x for x in nodes if x.tag in ("div", "section", "td") and x.names & MAIN_NAMES and not (x.names & BOILERPLATE) and not blocked(x)]
    return [max(named, key=lambda x: len(raw_text(x)))] if named else []


def _inside(node: Node, outer: Node) -> bool:
    up = node.up
    while up is not None and up is not outer:
        up = up.up
    return up is outer


def subtree_key(node: Node) -> int:
    """Signed 64-bit hash of an element: its tag, names and all below, with white space folded."""
    if node.key is None:
        for x in reversed(list(walk(node))):  # children before parents
            if x.key is None:
                parts = [x.tag, ".".join(sorted(x.names))]
                parts += [str(k.key) if isinstance(k, Node) else " ".join(k.split()) for k in x.kids]
                x.key = int.from_bytes(xxhash.xxh3_64_digest("\x1f".join(parts)), "big", signed=True)
    return node.key


def candidates(root: Node, mains: list[Node]) -> Iterator[Node]:
    """Subtrees that may be a template: outside explicit main text any block, inside it containers below the top."""
    tops = set(map(id, mains))
    holders = set()
    for node in mains:
        up = node.up
        while up is not None:
            holders.add(id(up))
            up = up.up
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        for kid in node.kids:
            if isinstance(kid, Node):
                within = inside or id(node) in tops
                if id(kid) not in tops and id(kid) not in holders and kid.tag not in ("html", "body", "head", "script", "style", "br"):
                    if kid.tag in (CONTAINERS if within else BLOCK):
                        yield kid
                stack.append((kid, within))


def main_text(root: Node, mains: list[Node], templates: frozenset) -> str:
    """Blocks in page order, one line each, without deleted subtrees."""
    deleted = {id(x) for x in candidates(root, mains) if subtree_key(x) in templates} if templates else set()
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in mains or [root]:
        stack: list = [top]
        headings_only: int | None = None
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                if headings_only is None:
                    line.append(item)
            elif item is None:
                flush()
            elif isinstance(item, tuple):  # end of an article's own header
                headings_only = None
                flush()
            elif item is not top and (id(item) in deleted or silent(item, bool(mains)) or _links_only(item)):
                if item.tag in BLOCK:
                    flush()
            elif mains and item.tag == "header" and item is not top:
                flush()
                stack.extend(x for h in reversed([y for y in walk(item) if y.tag in HEADINGS]) for x in (None, h))
            elif item.tag in BLOCK:
                flush()
                stack.append(None)
                stack.extend(reversed(item.kids))
            else:
                stack.extend(reversed(item.kids))
        flush()
    return "\n".join(blocks)


def _links_only(node: Node) -> bool:
    """A container of three links or more with hardly any other text."""
    if node.tag not in ("ul", "ol", "div", "section", "table"):
        return False
    linked = sum(len(raw_text(x).strip()) for x in walk(node) if x.tag == "a")
    return linked > 0 and sum(x.tag == "a" for x in walk(node)) >= 3 and linked >= 0.8 * len("".join(raw_text(node).split()))


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without its port; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def extract_main_text(pages: DataFrame, *, min_pages: int = MIN_PAGES, broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """``page_id, url, text, n_chars, host, n_templates`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    A subtree is a template of its host if it stands on at least ``min_pages`` pages of different content
    of the host. ``text`` is '' where nothing is left; null or empty html is an
    empty page; null urls share the host ''. Rows that repeat return side by side, and count once.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("host", host_of(F.col("url")))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, content, subtree = [], [], []
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                root = parse(page)
                mains = main_roots(root)
                own = xxhash.xxh3_64_intdigest("".join(raw_text(x) for x in mains or [root])) - (1 << 63)
                keys = {subtree_key(x) for x in candidates(root, mains)}
                host += [h] * len(keys)
                content += [own] * len(keys)
                subtree += list(keys)
            yield pa.RecordBatch.from_pydict({"host": pa.array(host, pa.string()), "content": pa.array(content, pa.int64()), "subtree": pa.array(subtree, pa.int64())})

    # One row per page content and subtree; the hot host is spread by the subtree in the key.
    seen = materialize(rows.select("host", "html").mapInArrow(subtrees, "host string, content bigint, subtree bigint").distinct(), "subtrees")
    counts = seen.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    templates = materialize(counts.where(F.col("n") >= min_pages).select("host", "subtree"), "templates")
    schema = "page_id bigint, url string, text string, n_chars bigint, host string, n_templates bigint"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, own in zip(batch.column("html").to_pylist(), batch.column("subtrees").to_pylist()):
                root = parse(page)
                texts.append(main_text(root, main_roots(root), frozenset(own or ())))
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()), "host": batch.column("host"),
                    "n_templates": pa.array([len(x or ()) for x in batch.column("subtrees").to_pylist()], pa.int64()),
                }
            )

    if templates.count() <= broadcast_templates:
        by_host = templates.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))
        return rows.join(F.broadcast(by_host), "host", "left").mapInArrow(extract, schema)
    # Too many for every task: the subtrees of a page content that are templates meet the page by its content.
    marked = rows.withColumn("page_hash", F.xxhash64("html"))

    def page_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, page_hash, subtree = [], [], []
            for h, k, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page_hash", "html"))):
                root = parse(page)
                keys = {subtree_key(x) for x in candidates(root, main_roots(root))}
                host += [h] * len(keys)
                page_hash += [k] * len(keys)
                subtree += list(keys)
            yield pa.RecordBatch.from_pydict({"host": pa.array(host, pa.string()), "page_hash": pa.array(page_hash, pa.int64()), "subtree": pa.array(subtree, pa.int64())})

    own = marked.select("host", "page_hash", "html").mapInArrow(page_subtrees, "host string, page_hash bigint, subtree bigint").distinct()
    by_page = own.join(templates, ["host", "subtree"]).groupBy("host", "page_hash").agg(F.collect_list("subtree").alias("subtrees"))
    return marked.join(by_page, ["host", "page_hash"], "left").mapInArrow(extract, schema)
