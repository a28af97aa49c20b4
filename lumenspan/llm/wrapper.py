"""Main text of web pages by wrapper induction.

Every page of a host is aligned with the host's reference page by simple tree matching.
A text node of the reference that meets equal text on nearly all of the host's pages is
template, inside article elements too; varying slots are content. What is content but not
article is told by its region: menus, headers, footers, sidebars, notices, adverts, forms
and reader comments; where an article element holds varying slots, only those count.
The counts behind the template cover all pages of the host (copies of a page count once)
and are summed before they are shuffled; where pages meet what is known of their host, a
host with many pages is dealt over many tasks.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from math import isqrt

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, map_rows, materialize

#: A reference node is template if this share of the host's pages has its text there, and the share's
#: lower confidence bound (Wilson, so many standard errors) is over CERTAIN: few pages prove little.
TEMPLATE_SHARE, CERTAIN, ERRORS = 0.8, 0.5, 2.0
#: A host's reference page is the middle one, by nodes, of up to so many drawn from its pages.
DRAWN = 15
#: Lists of children up to this long (in the geometric mean) are aligned on one table; longer ones row by row.
FULL_ALIGNMENT = 60
#: What a matched node counts beside a subtree that meets its like; more than there are children.
MORE = 1 << 24

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
REGIONS = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag closes an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl div article section main aside nav footer header body html td th form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id values that mark what isn't article, outside article elements.
MARKS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe\w*|signup|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|footer\w*|header|masthead|topbar|comment\w*|disqus|replies|respond|share\w*|social\w*|related\w*|recommend\w*|widget\w*|pagination|pager|toolbar|login|search\w*)(?=$|[\s_-])", re.I)
#: Whole class and id values that mark it inside article elements as well; there the template tells the rest.
INNER_MARKS = frozenset("ad ads advert advertisement adsbygoogle comments disqus_thread sidebar".split())
#: A tag that the page's end cuts off.
CUT_TAG = re.compile(r"<[/!A-Za-z][^<>]*\Z")
SPACE = re.compile(r"[\s]+")


@dataclass
class Node:
    tag: str
    marks: str = ""
    children: list = field(default_factory=list)  # nodes and texts


class _Builder(HTMLParser):
    """A forgiving tree builder: implied ends of paragraphs and list items, stray end tags ignored, open elements closed at the end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def parse_marked_section(self, i, report=1):
        """Marked sections are bogus comments, as browsers read them, whatever their name."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def _close(self, kinds, stop) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in kinds:
                del self.open[i:]
                return
            if tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close({"p"}, SCOPES)
        if tag in CLOSES:
            self._close(CLOSES[tag], {"table", "ul", "ol", "dl", "select"} - CLOSES[tag])
        found = dict(attrs)
        role = (found.get("role") or "").lower()
        hidden = "hidden" in found or (found.get("aria-hidden") or "").lower() == "true" or "display:none" in (found.get("style") or "").replace(" ", "").lower()
        marks = "hidden" if hidden else "role" if role in ROLES else f"{found.get('class') or ''} {found.get('id') or ''}".strip()
        node = Node(tag, marks)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close({tag}, {"#root"} if tag in BLOCKS else {"#root", "td", "th", "table"})

    def handle_data(self, data):
        if data:
            self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    """The page's tree; of broken markup what can be read."""
    builder = _Builder()
    if html:
        try:
            builder.feed(CUT_TAG.sub("", html))
            builder.close()
        except AssertionError:  # the library gives up on some declarations
            builder.handle_data(builder.rawdata)
    return builder.root


def _excluded(node: Node, inside: bool) -> bool:
    """True for regions that aren't article. Within an article, a header may hold its headline, and words in class names say little."""
    if node.tag in HIDDEN or node.marks in ("hidden", "role"):
        return True
    if node.tag in REGIONS and not (inside and node.tag == "header"):
        return True
    if not node.marks or node.tag in ("html", "body", "article", "main"):
        return False
    return not INNER_MARKS.isdisjoint(node.marks.lower().split()) if inside else MARKS.search(node.marks) is not None


def _squeeze(text: str) -> str:
    return SPACE.sub(" ", text).strip()


@dataclass
class Block:
    """A run of text between block boundaries, and the tree node that holds it.

    ``slot`` is what templates list: the hash of the text at its path of block elements,
    as a sentence may repeat a menu's word. Aligned nodes have one path.
    """

    text: str
    node: int
    article: bool
    slot: int


def blocks(root: Node, every: bool = False) -> tuple[list[Block], list[Node]]:
    """Blocks in page order, without those of excluded regions unless ``every``, and the tree's nodes in order (``Block.node`` indexes them)."""
    out: list[Block] = []
    nodes: list[Node] = []
    run: list[str] = []
    owner = [0, False, ""]

    def flush() -> None:
        text = _squeeze("".join(run))
        if text:
            out.append(Block(text, owner[0], owner[1], mark(f"{owner[2]} {text}")))
        run.clear()

    # An explicit stack: trees may be deeper than Python's own.
    stack: list[tuple[str, object, int, bool, str]] = [("enter", root, -1, False, "")]
    while stack:
        what, item, at, inside, path = stack.pop()
        if what == "flush":
            flush()
        elif what == "text":
            if not run:
                owner[:] = [at, inside, path]
            run.append(item)
        elif what == "enter":
            node: Node = item
            number = len(nodes)
            nodes.append(node)
            if node.tag in HIDDEN if every else _excluded(node, inside):
                if node.tag in BLOCKS:
                    flush()
                continue
            if node.tag == "br":
                run.append(" ")
                continue
            inside = inside or node.tag in ("article", "main")
            if node.tag in BLOCKS:
                flush()
                stack.append(("flush", None, 0, False, ""))
                path = xxhash.xxh64_hexdigest(f"{path} {node.tag}.{node.marks}".encode("utf-8", "surrogatepass"))
            for child in reversed(node.children):
                stack.append(("text", child, number, inside, path) if isinstance(child, str) else ("enter", child, at, inside, path))
    flush()
    return out, nodes


def mark(text: str) -> int:
    """A text's hash as a signed long."""
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def skeleton(root: Node) -> list[tuple[str, int, int]]:
    """The block structure of all regions as a flat tree: (label, parent, slot of the text), in page order.

    Inner nodes are block elements (hash 0), leaves the blocks of text directly in them.
    """
    found, nodes = blocks(root, True)
    parent = {id(c): n for n in nodes for c in n.children if isinstance(c, Node)}
    flat: list[tuple[str, int, int]] = [("#root", -1, 0)]
    place: dict[int, int] = {id(root): 0}

    def put(node: Node) -> int:
        chain = []
        while id(node) not in place:
            chain.append(node)
            node = parent.get(id(node), root)
        at = place[id(node)]
        for n in reversed(chain):
            if n.tag in BLOCKS:
                flat.append((f"{n.tag}.{n.marks}", at, 0))
                at = len(flat) - 1
            place[id(n)] = at
        return at

    for b in found:
        flat.append(("#text", put(nodes[b.node]), b.slot))
    return flat


def align(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
    """Pairs (node of a, node of b) of a largest top-down, order-keeping matching: simple tree matching.

    Of equally large matchings of two lists of children one wins whose matched subtrees are
    alike, texts included, as often as can be, so a constant line meets itself among
    paragraphs of any number. Children lists beyond FULL_ALIGNMENT go through the same dynamic program row by row: of
    n rows about twice the square root of n are kept at a time.
    """
    kids_a, kids_b = ([[] for _ in t] for t in (a, b))
    for kids, tree in ((kids_a, a), (kids_b, b)):
        for i, n in enumerate(tree[1:], 1):
            kids[n[1]].append(i)
    ids: dict[tuple, int] = {}
    nodes: list[int] = []  # of a subtree of each shape

    def shapes(tree: list[tuple], kids: list[list[int]]) -> list[int]:
        """Each node's subtree as a number: equal ones have the same labels throughout."""
        out = [0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            own = [out[k] for k in kids[i]]
            out[i] = ids.setdefault((tree[i][0], *own), len(nodes))
            if out[i] == len(nodes):
                nodes.append(1 + sum(nodes[k] for k in own))
        return out

    shape_a, shape_b = shapes(a, kids_a), shapes(b, kids_b)
    whole: dict[tuple, int] = {}

    def wholes(tree: list[tuple], kids: list[list[int]]) -> list[int]:
        """Each node's subtree as a number: equal ones have the same labels and texts throughout."""
        out = [0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            out[i] = whole.setdefault((tree[i][0], tree[i][2], *[out[k] for k in kids[i]]), len(whole))
        return out

    whole_a, whole_b = wholes(a, kids_a), wholes(b, kids_b)
    memo: dict[tuple[int, int], int] = {}

    def table(p: list[int], q: list[int]) -> list[list[int]]:
        """Values of the best matchings of the first i and j children: MORE a node, and 1 for a subtree that meets its like."""
        m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, x in enumerate(p, 1):
            for j, y in enumerate(q, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + MORE * size(x, y) + (whole_a[x] == whole_b[y]))
        return m

    def stepper(p: list[int], q: list[int]):
        """A function from row i - 1 of the table and i to row i."""
        _, first, kind = np.unique([shape_b[y] for y in q], return_index=True, return_inverse=True)
        like = np.array([whole_b[y] for y in q])
        sizes: dict[int, np.ndarray] = {}

        def step(above: np.ndarray, i: int) -> np.ndarray:
            x = p[i - 1]
            if shape_a[x] not in sizes:
                sizes[shape_a[x]] = MORE * np.array([size(x, q[k]) for k in first], np.int64)
            row = np.zeros_like(above)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + sizes[shape_a[x]][kind] + (like == whole_a[x])), out=row[1:])
            return row

        return step

    def best(p: list[int], q: list[int]) -> int:
        if len(p) * len(q) <= FULL_ALIGNMENT**2:
            return table(p, q)[-1][-1] // MORE
        step, row = stepper(p, q), np.zeros(len(q) + 1, np.int64)
        for i in range(1, len(p) + 1):
            row = step(row, i)
        return int(row[-1]) // MORE

    def told(x: int, y: int) -> bool:
        """Whether ``size`` is known without looking at the children's matching."""
        return a[x][0] != b[y][0] or shape_a[x] == shape_b[y] or not kids_a[x] or not kids_b[y] or (shape_a[x], shape_b[y]) in memo

    def size(x: int, y: int) -> int:
        if a[x][0] != b[y][0]:
            return 0
        if shape_a[x] == shape_b[y]:
            return nodes[shape_a[x]]
        if not kids_a[x] or not kids_b[y]:
            return 1
        return memo[shape_a[x], shape_b[y]]

    # Children before their parents, on a stack of its own: pages may be nested deeper than Python calls.
    waiting = [(0, 0)]
    while waiting:
        x, y = waiting[-1]
        if told(x, y):
            waiting.pop()
            continue
        p, q = ({shape[k]: k for k in kids}.values() for shape, kids in ((shape_a, kids_a[x]), (shape_b, kids_b[y])))
        open_ = [(c, d) for c in p for d in q if not told(c, d)]
        waiting.extend(open_)
        if not open_:
            memo[shape_a[x], shape_b[y]] = 1 + best(kids_a[x], kids_b[y])
            waiting.pop()

    def trace(rows, low: int, i: int, j: int) -> tuple[int, int]:
        """Walks back from (i, j) to row ``low`` of a table of which ``rows`` are rows ``low`` and on."""
        while i > low and j:
            own, above = rows[i - low], rows[i - low - 1]
            if own[j] == above[j]:
                i -= 1
            elif own[j] == own[j - 1]:
                j -= 1
            else:
                todo.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
        return i, j

    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        p, q = kids_a[x], kids_b[y]
        if shape_a[x] == shape_b[y]:
            todo.extend(zip(p, q, strict=True))
            continue
        if len(p) * len(q) <= FULL_ALIGNMENT**2:
            trace(table(p, q), 0, len(p), len(q))
            continue
        step, apart = stepper(p, q), isqrt(len(p)) + 1
        row = np.zeros(len(q) + 1, np.int64)
        kept = [row]
        for i in range(1, len(p) + 1):
            row = step(row, i)
            if i % apart == 0:
                kept.append(row)
        i, j = len(p), len(q)
        while i and j:
            low = (i - 1) // apart * apart
            rows = [kept[low // apart]]
            for k in range(low + 1, i + 1):
                rows.append(step(rows[-1], k))
            i, j = trace(rows, low, i, j)
    return out


def article(root: Node, template: frozenset[int] = frozenset()) -> str:
    """The main text: slots outside excluded regions without the template's; of these the article element's if there are such. Where all is template, all slots."""
    found = blocks(root)[0]
    varying = [b for b in found if b.slot not in template] or found
    kept = [b for b in varying if b.article] or varying
    return "\n".join(b.text for b in kept)


def host(url_col: str):
    """The host of a URL in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points of text).

    Null and empty pages have an empty text. Pages without a host are one host. On hosts
    of a few pages nothing is proven to be template. Rows that repeat an id are extracted
    each; null ids are kept. Empty tables give no rows. Other columns are ignored.
    """
    keyed = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host(url_col).alias("_host"))

    def shape():
        """Each page is parsed once: its blocks outside excluded regions, and the tree of all its blocks."""

        def step(ids, urls, hosts, htmls):
            roots = list(map(parse, htmls))
            found = [[(b.text, b.slot, b.article) for b in blocks(r)[0]] for r in roots]
            trees = list(map(skeleton, roots))
            packed = list(map(json.dumps, trees))
            return {"_id": ids, "_url": urls, "_host": hosts, "blocks": found, "nodes": list(map(len, trees)), "tree": packed, "_h": list(map(mark, packed))}

        return step

    block = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("mark", T.LongType()), T.StructField("article", T.BooleanType())]))
    schema = T.StructType([keyed.schema["_id"], keyed.schema["_url"], T.StructField("_host", T.StringType()), T.StructField("blocks", block), T.StructField("nodes", T.LongType()), T.StructField("tree", T.StringType()), T.StructField("_h", T.LongType())])
    trees = materialize(map_rows(keyed, ["_id", "_url", "_host", "_html"], shape, schema), "trees")
    # Copies of a page have one tree and count once: they say nothing new about their host's template.
    ids = trees.groupBy("_host", "_h", "nodes").agg(F.count("*").alias("rows"))
    # The reference page: of up to DRAWN pages that their hashes pick, the middle one by nodes. No tree is shuffled to find it.
    drawn = ids.groupBy("_host", F.pmod("_h", F.lit(DRAWN)).alias("_draw")).agg(F.min(F.struct("_h", "nodes")).alias("d"), F.count("*").alias("pages"), F.sum("rows").alias("n"))
    some = F.array_sort(F.collect_list(F.struct("d.nodes", "d._h")))
    drawn = drawn.groupBy("_host").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), some.alias("some"))
    counted = materialize(drawn.select("_host", "pages", "n", F.get("some", (F.size("some") / 2).cast("int"))["_h"].alias("_h")), "hosts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    reference = trees.select("_host", "_h", "tree").join(counted, ["_host", "_h"]).groupBy("_host", "n").agg(F.min("tree").alias("reference"))
    reference = materialize(reference, "reference")

    def meet():
        known = lru_cache(256)(json.loads)  # reference trees

        def step(hosts, marks, refs, own):
            out = {"_host": [], "_h": [], "text": []}
            for h, m, r, o in zip(hosts, marks, refs, own, strict=True):
                a, b = known(r), json.loads(o)
                same = {a[x][2] for x, y in align(a, b) if a[x][2] and a[x][2] == b[y][2]}
                out["_host"] += [h] * len(same)
                out["_h"] += [m] * len(same)
                out["text"] += same
            return out

        return step

    pairs = hot_join(trees.select("_host", "_h", "tree"), reference, ["_host"], total, F.col("_h"))
    met = map_rows(pairs, ["_host", "_h", "reference", "tree"], meet, T.StructType([T.StructField("_host", T.StringType()), T.StructField("_h", T.LongType()), T.StructField("text", T.LongType())]))
    same = met.distinct().groupBy("_host", "text").count().join(counted.select("_host", "pages", "n"), "_host")
    template = same.where(is_template(F.col("count"), F.col("pages"))).groupBy("_host", "n").agg(F.collect_set("text").alias("template"))
    template = materialize(template, "template")

    # As ``article`` does, on blocks that are read already.
    met = hot_join(trees.select("_id", "_url", "_host", "_h", "blocks"), template, ["_host"], total, F.col("_h"), "left")
    slots = F.filter("blocks", lambda b: ~F.array_contains(F.coalesce("template", F.array().cast("array<bigint>")), b["mark"]))
    met = met.withColumn("_varying", F.when(F.size(slots) > 0, slots).otherwise(F.col("blocks")))
    inner = F.filter("_varying", lambda b: b["article"])
    text = F.array_join(F.transform(F.when(F.size(inner) > 0, inner).otherwise(F.col("_varying")), lambda b: b["text"]), "\n")
    return met.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def is_template(k, n):
    """True if a text that comes up on k of a host's n pages is template: columns or numbers."""
    share, z = k / n, ERRORS * ERRORS
    middle, spread = share + z / (2 * n), share * (1 - share) / n + z / (4 * n * n)
    # The bound (middle - ERRORS * sqrt(spread)) / (1 + z / n) is over CERTAIN, without the root.
    over = middle - CERTAIN * (1 + z / n)
    return (share >= TEMPLATE_SHARE) & (over > 0) & (over * over > z * spread)
