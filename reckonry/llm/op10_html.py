"""Main text of web pages by wrapper induction.

Pages become trees of elements. Each host's wrapper starts as the tree of one of its pages; simple
tree matching aligns every page of the host with it, and nodes of a page that align with none extend
the wrapper by their place below the nearest node that does, so second layouts are in it too. Over
all distinct pages of the host, a wrapper node with one text in most of the pages that have it is
template; one whose text varies is a slot. A block of a page is left out if its node is template and
its own text is that constant text, or if the element or a whole class name says that it is no article (menus,
footers, adverts, forms and so on). Class names decide nothing on html, body, article, main and headings. An article or main element raises what is asked of a constant
inside it (nearly all pages that have it agree, three at least), and decides nothing alone.

The wrapper of a host is small (element names and text hashes, no text) and rides to its pages in a
plain join by host; what pages contribute to it is summed up before the shuffle.
"""

from __future__ import annotations

import html
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reckonry.llm.batches import slices
from reckonry.llm.keys import written_keys
from reckonry.plans.staging import stage

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                            "header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tbody thead tfoot select".split())
LEFT_OUT = frozenset("head nav footer aside form script style noscript template iframe svg math object button select textarea input dialog menu "
                     "canvas audio video map title datalist noembed noframes".split())
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
                        "breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice notices notification alert popup modal "
                        "comment comments commentlist disqus respond reply share sharing social related newsletter subscribe signup login search "
                        "pagination pager widget toolbar complementary contentinfo".split())
#: Parts that a class name may have beside such a word; with any other part it names something else (share-price, article-header).
AROUND = frozenset("site page main global top bottom left right box bar wrap wrapper container block section area slot list form link links button buttons "
                   "item items inner outer content primary secondary mobile desktop".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WITHIN_TEXT = LEFT_OUT - frozenset("head nav footer aside form dialog menu".split())  # left out, but no end of a block
CONTENT = frozenset(("article", "main"))
#: A wrapper node is constant if more than this share of the pages that have it have one text there;
#: inside an article or main element the share is ``NEARLY_ALL``, of ``PAGES`` pages or more.
MOST, NEARLY_ALL, PAGES = 0.5, 0.9, 3
#: Elements nested deeper lie side by side at this depth; their text stays in place.
DEPTH = 400
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))  # matching takes a few frames a level
#: Child lists whose table would be larger are split where the best match splits them (linear space).
TABLE = 250_000


class Node:
    __slots__ = ("tag", "marks", "children")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.children = tag, marks, []


def parse(page: str) -> Node:
    """The tree of a page. Children are nodes and strings; unclosed and stray tags are put up with."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)
    low = None
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at:m.start()]))
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSED_BY_BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in SAME_CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME_CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        marks = " ".join((x[2] if x[2] is not None else x[3] if x[3] is not None else x[4] or "") for x in ATTRIBUTE.finditer(m[3])) if m[3] else ""
        node = Node(tag, marks.lower())
        stack[-1].children.append(node)
        if tag in RAW:
            low = low if low is not None else page.lower()
            end = low.find(f"</{tag}", at) if len(low) == size else page.find(f"</{tag}", at)
            if end < 0:
                break
            at = page.find(">", end) + 1 or size
        elif tag not in VOID and not m[3].endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    return root


# ---- trees and their matching ------------------------------------------------------------------

Skeleton = list  # [label, hash of the node's own text, [children]]


def skeleton(node: Node) -> Skeleton:
    """Labels and text hashes; inline markup belongs to the text of the node that holds it."""
    own, below, todo = [], [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            own.append(x)
        elif x.tag in INLINE:
            todo += reversed(x.children)
        else:
            below.append(x)
    text = " ".join(" ".join(own).split())
    return [f"{node.tag} {node.marks}".strip(), zlib.crc32(text.encode("utf-8", "replace")) if text else 0, [skeleton(x) for x in below]]


def numbered(tree: Skeleton) -> tuple[list, int]:
    """The tree as nested [label, hash, children, number, size, shape], numbers in page order.

    ``shape`` is equal for trees of equal labels, in one process.
    """
    count = 0

    def walk(t):
        nonlocal count
        own, count = count, count + 1
        children = [walk(x) for x in t[2]]
        return [t[0], t[1], children, own, 1 + sum(c[4] for c in children), hash((t[0], *(c[5] for c in children)))]

    return walk(tree), count


def _uneven(a: list, b: list) -> tuple[list, list, int]:
    """Child lists without the children of equal shape at both ends, and how many there are at the front.

    Such children match whole, so pairing them loses nothing.
    """
    x, y, low, high = a[2], b[2], 0, 0
    least = min(len(x), len(y))
    while low < least and x[low][5] == y[low][5]:
        low += 1
    while high < least - low and x[-1 - high][5] == y[-1 - high][5]:
        high += 1
    return x[low:len(x) - high], y[low:len(y) - high], low


class Weights:
    """Sizes of the largest matches of two child lists' members, worked out once a pair of shapes."""

    def __init__(self, x: list, y: list, memo: dict):
        self.memo, shapes = memo, {}
        self.of_y = np.array([shapes.setdefault(q[5], len(shapes)) for q in y], np.int64)
        self.y = list({q[5]: q for q in reversed(y)}[k] for k in shapes)
        self.rows: dict[int, np.ndarray] = {}

    def row(self, p: list) -> np.ndarray:
        found = self.rows.get(p[5])
        if found is None:
            sizes = []
            for q in self.y:
                sizes.append(matched(p, q, self.memo) if p[0] == q[0] else 0)
            found = self.rows[p[5]] = np.array(sizes, np.int64)
        return found


def matched(a: list, b: list, memo: dict) -> int:
    """The size of the largest order-keeping match of two numbered trees with equal roots."""
    if a[5] == b[5]:
        return a[4]
    found = memo.get((a[5], b[5]))
    if found is None:
        x, y, _ = _uneven(a, b)
        found = 1 + sum(p[4] for p in a[2]) - sum(p[4] for p in x)
        if x and y:
            w = Weights(x, y, memo)
            found += int(_last_row(x, w, w.of_y)[-1])
        memo[a[5], b[5]] = found
    return found


def _last_row(x: list, w: Weights, of_y: np.ndarray) -> np.ndarray:
    """Sizes of the best matches of all of ``x`` with each beginning of the other list."""
    row = np.zeros(len(of_y) + 1, np.int64)
    for p in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w.row(p)[of_y]))
    return row


def _pairs(x: list, w: Weights) -> list[tuple[int, int]]:
    """Places of the best match's pairs. Tables stay below ``TABLE`` cells whatever the lists' lengths."""
    out, todo = [], [(0, len(x), 0, len(w.of_y))]
    while todo:
        a, b, c, d = todo.pop()
        n, m = b - a, d - c
        if not n or not m:
            continue
        if n == 1:
            sizes = w.row(x[a])[w.of_y[c:d]]
            if sizes.max() > 0:
                out.append((a, c + int(sizes.argmax())))
        elif n * m > TABLE:
            half = a + n // 2
            front, back = _last_row(x[a:half], w, w.of_y[c:d]), _last_row(x[half:b][::-1], w, w.of_y[c:d][::-1])
            at = c + int((front + back[::-1]).argmax())
            todo += [(a, half, c, at), (half, b, at, d)]
        else:
            best = np.zeros((n + 1, m + 1), np.int64)
            for i in range(n):
                np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + w.row(x[a + i])[w.of_y[c:d]]), out=best[i + 1, 1:])
            i, j = n, m
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
    return out


def _whole(a: list, b: list, out: dict[int, int]) -> None:
    """Pairs of two trees of equal shape: numbers follow page order, so they run alike."""
    for k in range(a[4]):
        out[a[3] + k] = b[3] + k


def match(a: list, b: list, out: dict[int, int], memo: dict | None = None) -> int:
    """Simple tree matching: the largest order-keeping match of two numbered trees with equal roots.

    ``out`` gets number in ``a`` -> number in ``b``. Children of equal shape at both ends are paired
    first, which loses nothing; the rest goes through the usual table, at any length.
    """
    if a[0] != b[0]:
        return 0
    if a[5] == b[5]:
        _whole(a, b, out)
        return a[4]
    memo = {} if memo is None else memo
    out[a[3]] = b[3]
    x, y, low = _uneven(a, b)
    high = len(a[2]) - low - len(x)
    ends = [*zip(a[2][:low], b[2][:low]), *(zip(a[2][-high:], b[2][-high:]) if high else ())]
    for p, q in ends:
        _whole(p, q, out)
    total = 1 + sum(p[4] for p, _ in ends)
    if len(x) == 1 and len(y) == 1:
        return total + match(x[0], y[0], out, memo)
    if x and y:
        for i, j in _pairs(x, Weights(x, y, memo)):
            total += match(x[i], y[j], out, memo)
    return total


def keys(tree: list, out: dict[int, int]) -> dict[int, int]:
    """The wrapper's node for every node of a page, by number.

    A node that aligns with none has a key of its own from 2**62 on: its label and place among unaligned
    siblings of that label, below the key of its parent.
    """
    found, todo = {}, [(tree, out.get(tree[3], 1 << 62))]
    while todo:
        t, key = todo.pop()
        found[t[3]] = key
        times: Counter = Counter()
        for x in t[2]:
            own = out.get(x[3])
            if own is None:
                text = f"{key} {times[x[0]]} {x[0]}".encode("utf-8", "replace")
                own = (zlib.crc32(text) << 30 | zlib.adler32(text[::-1]) & (1 << 30) - 1) | 1 << 62
                times[x[0]] += 1
            todo.append((x, own))
    return found


def packed(tree: Skeleton) -> str:
    """A skeleton as text, one node a line: depth, hash, label."""
    lines, todo = [], [(tree, 0)]
    while todo:
        t, depth = todo.pop()
        lines.append(f"{depth} {t[1]} {' '.join(t[0].split())}")
        todo += [(x, depth + 1) for x in reversed(t[2])]
    return "\n".join(lines)


def unpacked(text: str) -> Skeleton:
    path: list[Skeleton] = []
    for line in text.split("\n"):
        depth, own, label = line.split(" ", 2)
        node = [label, int(own), []]
        del path[int(depth):]
        if path:
            path[-1][2].append(node)
        path.append(node)
    return path[0]


def hashes(tree: list) -> Iterator[tuple[int, int]]:
    todo = [tree]
    while todo:
        t = todo.pop()
        yield t[3], t[1]
        todo += t[2]


# ---- text --------------------------------------------------------------------------------------

def boilerplate(node: Node, inside: bool = False) -> bool:
    """Whether the element or one of its class names as a whole says that it is no article; inside one, a header belongs to it."""
    if node.tag in LEFT_OUT:
        return True
    if not node.marks or node.tag in CONTENT or node.tag in HEADINGS or node.tag in ("html", "body"):
        return False
    words = BOILERPLATE - {"header", "masthead", "banner"} if inside else BOILERPLATE
    return any(not words.isdisjoint(parts) and all(x in words or x in AROUND or x.isdigit() for x in parts)
               for parts in ([x for x in re.split(r"[-_:]+", name) if x] for name in node.marks.split()))


def main_text(root: Node, shared: frozenset[int] = frozenset(), firm: frozenset[int] = frozenset()) -> str:
    """Blocks of the page's content, an empty line between two.

    ``shared`` holds the numbers of the page's nodes whose text is the host's, ``firm`` those of them
    that hold inside an article or main element too. Their text is left out.
    """
    blocks: list[str] = []
    count = -1

    def walk(node: Node, inside: bool, shown: bool) -> None:
        nonlocal count
        count += 1
        inside = inside or node.tag in CONTENT
        # the header of an article holds its heading
        shown = shown and not boilerplate(node, inside) and not (node.tag == "header" and not inside)
        use = shown and count not in (firm if inside else shared)
        run: list[str] = []

        def flush() -> None:
            text = " ".join("".join(run).split())
            run.clear()
            if text and use:
                blocks.append(text)

        todo = [(x, True) for x in reversed(node.children)]
        while todo:
            x, seen = todo.pop()
            if isinstance(x, str):
                if seen:
                    run.append(x)
            elif x.tag in INLINE:
                if x.tag == "br":
                    run.append(" ")
                seen = seen and not boilerplate(x, inside)
                todo += [(y, seen) for y in reversed(x.children)]
            elif x.tag in WITHIN_TEXT:
                walk(x, inside, False)
            else:
                flush()
                walk(x, inside, shown and seen)
        flush()

    walk(root, False, True)
    return "\n\n".join(blocks)


# ---- Spark -------------------------------------------------------------------------------------

def _of_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, skeleton of one of its pages, and template: its constant nodes with their text's hash.

    The page is the one with the least hash of its html among those that have any. Pages of equal
    html count once together, so copies and the order of rows don't matter.
    """
    hosted = _of_host(pages)
    # written first, so that its true size decides how it meets the pages: few hosts need no shuffle of pages
    distinct = stage(hosted.where("html is not null").groupBy("host", F.xxhash64("html").alias("own")).agg(F.count("*").alias("copies")), "wrapper-pages-seen")
    chosen = stage(distinct.groupBy("host").agg(F.min("own").alias("own")), "wrapper-choice")

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [packed(skeleton(parse(x))) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string())], ["host", "skeleton"])

    models = hosted.select("host", "html", F.xxhash64("html").alias("own")).join(chosen, ["host", "own"])
    models = models.select("host", "html").mapInArrow(outlined, "host string, skeleton string").groupBy("host").agg(F.min("skeleton").alias("skeleton"))
    models = stage(models, "wrapper-pages")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        counts: Counter = Counter()
        for batch in batches:
            for host, page, model, copies in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "skeleton", "copies"))):
                for pair in _nodes(parse(page), model, known).values():
                    counts[host, *pair, copies] += 1
            if len(counts) > 100_000:  # sums so far; later ones add up in the shuffle
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    again = written_keys(distinct.where("copies > 1"), "wrapper-copies")
    joined = hosted.where("html is not null").select("host", "html", F.xxhash64("html").alias("own")).join(again, ["host", "own"], "left").select(
        "host", "html", F.coalesce("copies", F.lit(1)).alias("copies")).join(models, "host")
    counted = joined.mapInArrow(aligned, "host string, node long, own long, copies long, n long")
    # every copy of a page gives the same nodes, so sums divide by the copies without a rest
    texts = counted.groupBy("host", "node", "own", "copies").agg(F.sum("n").alias("n")).groupBy("host", "node", "own").agg(
        F.sum(F.expr("n div copies")).alias("n"))
    constant = texts.groupBy("host", "node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "own")).alias("most")).where(f"n > 1 and most.n > {MOST} * n")
    firm = F.expr(f"if(n >= {PAGES} and most.n >= {NEARLY_ALL} * n, 1, 0)")
    found = constant.where("most.own > 0").groupBy("host").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "node", "most.own", firm))), " ").alias("template"))  # as many as the wrapper has nodes
    return stage(models.join(found, "host", "left"), "wrappers")


def _model(model: str, known: dict) -> list:
    if model not in known:
        if len(known) > 500:
            known.clear()
        known[model] = numbered(unpacked(model))[0]
    return known[model]


def _template(template: str, known: dict) -> dict[tuple[int, int], bool]:
    """(node, hash of its constant text) -> whether it holds inside an article or main element."""
    if template not in known:
        if len(known) > 500:
            known.clear()
        entries = (x.split(":") for x in template.split())
        known[template] = {(int(node), int(own)): firm == "1" for node, own, firm in entries}
    return known[template]


def _nodes(root: Node, model: str, known: dict) -> dict[int, tuple[int, int]]:
    """Wrapper node and hash of the own text, by number of the page's node."""
    seen, out = numbered(skeleton(root))[0], {}
    match(seen, _model(model, known), out)
    of = keys(seen, out)
    return {number: (of[number], own) for number, own in hashes(seen)}


def _counted(counts: Counter) -> pa.RecordBatch:
    rows = list(counts.items())
    columns = [*([k[i] for k, _ in rows] for i in range(4)), [n for _, n in rows]]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "node", "own", "copies", "n"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null and empty html give an empty text. Pages without a host share the empty host. Every row
    gives a row, repeated ones too. Other columns are not read.
    """
    models = wrappers(pages)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            for part in slices(batch, column="html"):
                texts = [_text(*row, known) for row in zip(*(part.column(c).to_pylist() for c in ("html", "skeleton", "template")))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    joined = _of_host(pages).select(F.col("page_id").cast("long"), "url", "html", "host").join(models, "host", "left")
    return joined.select("page_id", "url", "html", "skeleton", "template").mapInArrow(work, "page_id long, url string, text string, n_chars long")


def _text(page: str | None, model: str | None, template: str | None, known: dict) -> str:
    if not page:
        return ""
    root = parse(page)
    if not model or not template:
        return main_text(root)
    constant = _template(template, known)
    shared = {number: constant[pair] for number, pair in _nodes(root, model, known).items() if pair in constant}
    return main_text(root, frozenset(shared), frozenset(n for n, firm in shared.items() if firm))


def op10_wrapper_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(spark.read.parquet(f"{folder}/pages.parquet"))


QUERY = op10_wrapper_text
SQL = None
