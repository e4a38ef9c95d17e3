"""HTML extraction by wrapper induction.

The pages of a host are aligned with a pivot page of the host by simple tree
matching. Blocks that match with equal text on most pages are the template and
are dropped; slots that vary are content. The smallest element that holds all
of the varying text of a host is its main slot, text of elements that the pivot
lacks counted for the nearest ancestor that it has. A page's text is what is
left of its main slot, in page order: every varying slot, without template
blocks and without elements that are boilerplate by tag or role, by the words
of class and id (unless they hold the page's article, main, title or most of
its paragraphs, see spare()), or that are lists of links. If articles or mains
are inside of the slot, it is their text. Where a host has too few pages for a
template, it is the text of the page's article, main or densest element.

Three things look like a template and are not: pages of a host that are near
copies of each other, lines that articles share, and a line among lines of its
kind that vary (a block is template only with most of its like siblings). Blocks of LONG characters
or more are therefore content if the constant ones of the host outweigh what
varies; and inside of an article or main a block is template only if nearly all
of MANY_PAGES pages or more have it there and such blocks are a small part of
the articles' text.

Scale: the pages' trees travel in a short form (tags, marks, text lengths and
64-bit hashes; no text) and meet their host's pivot, and pages their host's
template, in the worker: from a broadcast table if all templates are small,
else from a row that goes ahead of the host's pages, of which hosts of many
have several parts. All pages take part with all their elements. The matching
is the largest one for trees of any size: sizes are computed once for each two
shapes of subtrees, and lists of children are aligned row by row with numpy;
below DEEPEST levels, text counts for the ancestor there.

Defined cases: null html is empty and has no text; a null or odd url is a host of
its own kind; markup errors (unclosed, stray or nested tags, open quotes,
cut-off comments) are read as browsers do in outline; copies of a page, and rows
that share an id, count once for the template and have a row each; of pages that
tie for the pivot the one of least digest is it; very long pages are read alone;
columns other than id, url and html are not carried; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import short_batches
from millrace.llm.common import cut, table

#: Parameters: pages that must agree, and for a template inside of articles; characters of a long block; levels of a tree; bytes of templates broadcast, else pages of a host that follow one template row.
LEAST_PAGES, MANY_PAGES, LONG, DEEPEST, SMALL_BYTES, SALT_PAGES = 3, 5, 100, 200, 8_000_000, 20_000

# Element kinds of HTML, and words that mark boilerplate.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
_DROP = frozenset("nav header footer aside form script style noscript template iframe svg math object canvas button select option textarea input label menu dialog head title search video audio map noembed noframes xmp".split())
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog".split())
_DROP_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsor promo promoted promotion outbrain taboola nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail widget widgets footer foot colophon masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription newsletter signup login paywall share sharing social follow comment comments commentlist discussion disqus respond reply replies related recommended recommendation recommendations pager pagination skip copyright legal disclaimer tags taglist byline-share print".split()
)
#: Words of what holds other texts than the page's own, articles too.
_OTHERS = frozenset("comment comments commentlist discussion disqus respond reply replies related recommended recommendation recommendations promo promoted promotion ad ads adv advert adverts advertisement advertising adbox adslot teaser sponsor sponsored outbrain taboola".split())
_TEXT = frozenset("p blockquote pre".split())
_KEEP_TAG = frozenset("html body main".split())
_DROP_ARTICLE = frozenset("comment comments reply replies related recommended promo ad ads teaser sponsored".split())
_HEAD_ONLY = frozenset("title style script meta link base noscript template".split())
#: Parts of a text, never the main slot.
_NO_SLOT = frozenset("p li td th tr blockquote pre h1 h2 h3 h4 h5 h6 ul ol dl dt dd table thead tbody tfoot figure hgroup header".split())
#: What an opening tag closes: itself among its like.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = frozenset("ul ol dl table select article section div main body html td th".split())
_CLOSES_P = _BLOCK - {"html", "head", "body", "title", "option", "optgroup", "tbody", "td", "th", "thead", "tfoot", "tr", "legend"}

_TAG = re.compile(r"<(?:!--(?P<c>.*?)(?:--!?>|\Z)|(?P<d>[!?][^>]*)(?:>|\Z)|/(?P<e>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<t>[a-zA-Z][^\s/>]*)(?P<a>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"""(?:^|(?<=[\s"']))(class|id|role|hidden|style|aria-hidden|itemprop)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_WS = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")


class Node:
    """An element: tag, mark (class, id, role), parent, why its names alone mark it as boilerplate, whether its own text is template, and its children: nodes and strings in order."""

    __slots__ = ("drop", "fixed", "items", "mark", "parent", "soft", "tag")

    def __init__(self, tag: str, mark: str, drop: bool, parent: Node | None, soft: str = ""):
        self.tag, self.mark, self.drop, self.parent, self.soft, self.fixed, self.items = tag, mark, drop, parent, soft, False, []


@lru_cache(20_000)
def _marked(tag: str, attrs: str) -> tuple[str, bool, bool, str]:
    """An element's mark, whether tag, role or names say it is not content, whether it is a header only, and "others" or "names" if only names say so."""
    drop, head = tag in _DROP and tag != "header", tag == "header"
    soft, named_head = "", False
    mark = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            mark.append(f"{name}={_NUMBER.sub('#', value)}")  # post-17 and post-18 are one kind
        if name == "role" and value.lower() in _DROP_ROLE:
            drop = True
        if name in ("class", "id") and tag not in _KEEP_TAG:
            words = {w.lower() for w in _WORDS.findall(value)}
            if words & (_DROP_ARTICLE if tag == "article" else _DROP_WORD):
                soft = "others" if soft == "others" or words & _OTHERS else "names"
            named_head = named_head or "header" in words
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            drop = True
    if tag in ("html", "body"):
        return " ".join(mark), False, False, ""
    if drop or (head and not soft):
        return " ".join(mark), drop, not drop, ""
    return " ".join(mark), bool(soft), named_head and not soft, soft or ("names" if named_head else "")


def parse(html: str) -> Node:
    """The page's elements; markup errors are mended as browsers do, in outline."""
    root = Node("html", "", False, None)
    named: list[Node] = []
    at, spot = root, 0
    while True:
        m = _TAG.search(html, spot)
        if m is None:
            if spot < len(html):
                at.items.append(html[spot:])
            if named:
                spare(root, named)
            return root
        if m.start() > spot:
            at.items.append(html[spot : m.start()])
        spot = m.end()
        if m["e"] is not None:
            tag, node = m["e"].lower(), at
            while node is not None and node.tag != tag:
                # A stray end of an inline element does not end a block.
                if node.tag in _BLOCK and tag not in _BLOCK:
                    node = None
                    break
                node = node.parent
            if tag == "br":
                at.items.append("\n")
            if node is not None and node.parent is not None:
                at = node.parent
        elif m["t"] is not None:
            tag, attrs = m["t"].lower(), m["a"] or ""
            if at.tag == "head" and tag not in _HEAD_ONLY:
                at = at.parent or root
            if tag in ("html", "body"):
                continue
            if tag in _CLOSES_P:
                node = at
                while node is not None and node.tag != "p" and node.tag not in _SCOPE:
                    node = node.parent
                if node is not None and node.tag == "p":
                    at = node.parent
            if tag in _CLOSES:
                node = at
                while node is not None and node.tag not in _CLOSES[tag] and node.tag not in _SCOPE:
                    node = node.parent
                if node is not None and node.tag in _CLOSES[tag] and node.parent is not None:
                    at = node.parent
            if tag == "br":
                at.items.append("\n")
                continue
            mark, drop, head, soft = _marked(tag, attrs)
            if head:
                up = at
                while up is not None and up.tag not in ("article", "main"):
                    up = up.parent
                drop = up is None  # an article's own header holds its title
            node = Node(tag, mark, drop, at, soft if drop else "")
            at.items.append(node)
            if node.soft:
                named.append(node)
            if tag in _RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, spot)
                spot = end.end() if end else len(html)
            elif tag not in _VOID and not (attrs.endswith("/") and tag not in _BLOCK and tag not in ("a", "b", "i", "span", "em", "strong")):
                at = node
    return root


def spare(root: Node, named: list[Node]) -> None:
    """Elements dropped for a word of their names alone are kept if they hold the page's own text.

    That is a main, an article, a title that no element outside of such names
    has, or most of the page's paragraph text. Names that mean others' texts
    (comments, related articles) yield only if no article or main is outside of
    such names.
    """

    def kind_of(node: Node) -> str:
        return node.tag if node.tag in ("article", "main", "h1") else "main" if "role=main" in node.mark else ""

    # Most such elements hold links or a line: their tags say so at once.
    stack: list = list(named)
    found = False
    while stack and not found:
        node = stack.pop()
        found = bool(kind_of(node)) or node.tag in _TEXT
        stack += [x for x in node.items if not isinstance(x, str) and not x.drop]
    if not found:
        return
    # All elements but boilerplate by tag or role: paragraph characters and landmarks of each, what is outside of names, and all.
    order, chars, kinds = [], [], []
    outside, total, marks = 0, 0, set()
    todo: list = [(root, -1, False, False, False)]
    while todo:
        node, up, text, in_soft, in_others = todo.pop()
        if node.drop and not node.soft:
            continue
        in_soft, in_others, text = in_soft or bool(node.soft), in_others or node.soft == "others", text or node.tag in _TEXT
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str)) if text else 0
        kind = kind_of(node)
        order.append((node, up))
        chars.append(own)
        kinds.append({kind} if kind else set())
        outside += 0 if in_soft else own
        total += 0 if in_others else own
        if not in_soft:
            marks.add(kind)
        here = len(order) - 1
        todo += [(x, here, text, in_soft, in_others) for x in reversed(node.items) if not isinstance(x, str)]
    anchored = bool(marks & {"article", "main"})
    for i in range(len(order) - 1, 0, -1):
        node, up = order[i]
        if node.soft == "others":
            node.drop = anchored or not (kinds[i] or chars[i] > outside)
        elif node.soft:
            node.drop = not (kinds[i] & {"article", "main"} or ("h1" in kinds[i] and "h1" not in marks) or chars[i] * 2 > total)
        if not (node.drop and node.soft == "others"):
            chars[up] += chars[i]
            kinds[up] |= kinds[i]


def blocks(node: Node, out: list[str] | None = None, run: list[str] | None = None) -> list[str]:
    """The texts of node's blocks in page order, boilerplate left out."""
    top = out is None
    out, run = ([], []) if top else (out, run)

    def flush() -> None:
        if run:
            text = _WS.sub(" ", unescape("".join(run))).strip()
            if text:
                out.append(text)
            run.clear()

    stack: list = [(node, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.tag in _BLOCK:
            flush()
        items = node.items
        while i < len(items):
            x = items[i]
            i += 1
            if isinstance(x, str):
                if not node.fixed:
                    run.append(x)
            elif not x.drop:
                stack.append((node, i))
                stack.append((x, 0))
                break
            elif x.tag in _BLOCK:
                flush()
        else:
            if node.tag in _BLOCK:
                flush()
    flush()
    return out


def own_text(node: Node) -> str:
    return _WS.sub(" ", "".join(x for x in node.items if isinstance(x, str))).strip()


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) if text else 0


#: An element of a tree: kind (tag and mark), depth, hash of own text, characters of own text.
Tree = list[tuple[tuple[str, str], int, int, int]]


def skeleton(root: Node) -> tuple[Tree, list[Node]]:
    """The elements in page order, and their nodes. Inline elements count as their block's text; boilerplate elements are left out."""
    out, nodes, stack = [], [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        nodes.append(node)
        if depth == DEEPEST:
            text = " ".join(blocks(node))
            out.append(((node.tag, node.mark), depth, _hash(text), len(text)))
            continue
        text = own_text(node)
        inline = [x for x in node.items if not isinstance(x, str) and not x.drop and x.tag not in _BLOCK and x.tag not in _RAW]
        while inline:
            x = inline.pop()
            text += " " + own_text(x)
            inline += [y for y in x.items if not isinstance(y, str) and not y.drop]
        text = _WS.sub(" ", text).strip()
        out.append(((node.tag, node.mark), depth, _hash(text), len(text)))
        for x in reversed(node.items):
            if not isinstance(x, str) and not x.drop and x.tag in _BLOCK:
                stack.append((x, depth + 1))
    return out, nodes


_ROW = np.dtype([("kind", "<u4"), ("depth", "<u2"), ("hash", "<u8"), ("chars", "<u4")])


def packed(tree: Tree) -> bytes:
    kinds: dict[tuple[str, str], int] = {}
    rows = np.array([(kinds.setdefault(k, len(kinds)), d, h, n) for k, d, h, n in tree], dtype=_ROW)
    names = "\x1e".join(f"{t}\x1f{m}" for t, m in kinds).encode("utf-8", "replace")
    return struct.pack("<II", len(names), len(kinds)) + names + rows.tobytes()


def unpacked(data: bytes) -> Tree:
    size, _ = struct.unpack_from("<II", data)
    kinds = [tuple(x.split("\x1f", 1)) for x in data[8 : 8 + size].decode().split("\x1e")]
    rows = np.frombuffer(data, dtype=_ROW, offset=8 + size)
    return [(kinds[k], d, h, n) for k, d, h, n in rows.tolist()]


def children(tree: Tree) -> list[list[int]]:
    """Each node's children, from the depths."""
    out: list[list[int]] = [[] for _ in tree]
    path: list[int] = []
    for i, n in enumerate(tree):
        del path[n[1] :]
        if path:
            out[path[-1]].append(i)
        path.append(i)
    return out


def parents(tree: Tree) -> list[int]:
    """Each node's parent; -1 of the root."""
    out, path = [], []
    for i, n in enumerate(tree):
        del path[n[1] :]
        out.append(path[-1] if path else -1)
        path.append(i)
    return out


class _Shapes:
    """The shapes of subtrees (their kinds, without texts), by number, and the size of the largest matching of two of them: trees have few shapes, however many nodes."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.kind: list[tuple[str, str]] = []
        self.kids: list[tuple[int, ...]] = []
        self.count: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}

    def of(self, tree: Tree, kids: list[list[int]]) -> list[int]:
        """Each node's shape."""
        out = [0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            below = tuple(out[k] for k in kids[i])
            key = (tree[i][0], below)
            if key not in self.known:
                self.known[key] = len(self.kind)
                self.kind.append(tree[i][0])
                self.kids.append(below)
                self.count.append(1 + sum(self.count[k] for k in below))
            out[i] = self.known[key]
        return out

    def size(self, s: int, t: int) -> int:
        if self.kind[s] != self.kind[t]:
            return 0
        if s == t:
            return self.count[s]
        if (s, t) not in self.sizes:
            x, y = self.kids[s], self.kids[t]
            lo, hi = _ends(x, y)
            x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
            ends = self.count[s] - sum(self.count[k] for k in x)
            self.sizes[s, t] = ends + (int(_row(np.zeros(len(y) + 1, np.int64), x, self.gains(x, y))[-1]) if x and y else 0)
        return self.sizes[s, t]

    def gains(self, x: tuple[int, ...], y: tuple[int, ...]) -> dict[int, np.ndarray]:
        """Of each shape in x, its sizes with those of y."""
        turn = {t: k for k, t in enumerate(dict.fromkeys(y))}
        codes = np.array([turn[t] for t in y])
        return {s: np.array([self.size(s, t) for t in turn], dtype=np.int64)[codes] for s in dict.fromkeys(x)}

    def pairs(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places in x and y that the largest matching pairs, of several the one that is first in x and y. Of the table of sizes, one row in about sqrt(len(x)) is held."""
        gains, step = self.gains(x, y), math.isqrt(len(x)) + 1
        starts = [np.zeros(len(y) + 1, np.int64)]
        for k in range(step, len(x) + 1, step):
            starts.append(_row(starts[-1], x[k - step : k], gains))
        got, p, q = [], len(x), len(y)
        for k in range(len(starts) - 1, -1, -1):
            rows = [starts.pop()]
            for s in x[k * step : (k + 1) * step]:
                rows.append(_row(rows[-1], (s,), gains))
            while p > k * step and q:
                row, above = rows[p - k * step], rows[p - k * step - 1]
                if row[q] == above[q]:
                    p -= 1
                elif row[q] == row[q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    got.append((p, q))
        return got[::-1]


def _row(row: np.ndarray, x: tuple[int, ...], gains: dict[int, np.ndarray]) -> np.ndarray:
    """A row of the table of sizes, len(x) rows on."""
    for s in x:
        after = np.empty_like(row)
        after[0] = 0
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gains[s]), out=after[1:])
        row = after
    return row


def _ends(x: Sequence[int], y: Sequence[int]) -> tuple[int, int]:
    """How many are equal at the start and, of the rest, at the end. Equal subtrees there are paired in some largest matching."""
    lo = 0
    while lo < len(x) and lo < len(y) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < len(x) - lo and hi < len(y) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    return lo, hi


def match(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of nodes of a and b, roots first, of the largest matching that keeps order and parents, whatever the trees' sizes."""
    if not a or not b or a[0][0] != b[0][0]:
        return []
    ka, kb = children(a), children(b)
    ha, hb = subtrees(a, ka), subtrees(b, kb)
    shapes = None
    pairs, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        pairs.append((i, j))
        x, y = ka[i], kb[j]
        lo, hi = _ends([ha[p] for p in x], [hb[q] for q in y])
        todo += zip(x[:lo], y[:lo], strict=True)
        todo += zip(x[len(x) - hi :], y[len(y) - hi :], strict=True)
        x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
        if not x or not y:
            continue
        if len(x) == len(y) == 1:
            if a[x[0]][0] == b[y[0]][0]:
                todo.append((x[0], y[0]))
            continue
        if not any(ka[p] for p in x) and not any(kb[q] for q in y) and len({a[p][0] for p in x} | {b[q][0] for q in y}) == 1:
            todo += zip(x, y, strict=False)
            continue
        if shapes is None:
            shapes = _Shapes()
            sa, sb = shapes.of(a, ka), shapes.of(b, kb)
        todo += [(x[p], y[q]) for p, q in shapes.pairs(tuple(sa[p] for p in x), tuple(sb[q] for q in y))]
    return pairs


def subtrees(tree: Tree, kids: list[list[int]]) -> list[int]:
    """A hash of each node with all below it."""
    out = [0] * len(tree)
    for i in range(len(tree) - 1, -1, -1):
        out[i] = hash((tree[i][0], tree[i][2], *(out[k] for k in kids[i])))
    return out


def tally(pivot: Tree, page: Tree) -> dict[int, list[int]]:
    """Of each pivot node that the page has: 1, whether the text is equal, characters of unequal text, characters of text below that the pivot lacks."""
    met = {j: i for i, j in match(pivot, page)}
    out: dict[int, list[int]] = {i: [1, 0, 0, 0] for i in met.values()}
    path: list[int] = []
    for j, n in enumerate(page):
        del path[n[1] :]
        i = met.get(j)
        if i is None:
            i = path[-1] if path else 0
            out.setdefault(i, [0, 0, 0, 0])[3] += n[3]
        elif pivot[i][2] == n[2]:
            out[i][1] = 1
        else:
            out[i][2] = n[3]
        path.append(i)
    return out


def induce(pivot: Tree, pages: int, met: dict[int, tuple[int, int, int, int]]) -> tuple[int, set[int]]:
    """The pivot's node that is the host's main slot, or -1, and the nodes whose text is template.

    met: of each node, the pages that matched it, those of them with the pivot's
    text, and the characters of varying text and of text the pivot lacks.
    """
    kids, up = children(pivot), parents(pivot)
    inside = [False] * len(pivot)
    for i, n in enumerate(pivot):
        inside[i] = n[0][0] in ("article", "main") or "role=main" in n[0][1] or (up[i] >= 0 and inside[up[i]])
    same = {i: m[1] for i, m in met.items() if pivot[i][3]}
    varies = sum(m[2] + m[3] for m in met.values())
    # Outside of articles: what most pages have; long blocks only if they are less than what varies.
    fixed = {i for i, n in same.items() if pages >= LEAST_PAGES and n * 5 >= pages * 4}
    if sum(pivot[i][3] * same[i] for i in fixed if pivot[i][3] >= LONG) > varies:
        fixed = {i for i in fixed if pivot[i][3] < LONG}
    # Inside: what nearly all pages have, if it is a small part.
    rare = {i for i, n in same.items() if inside[i] and pages >= MANY_PAGES and n * 10 >= pages * 9}
    articles = sum(m[2] + m[3] for i, m in met.items() if inside[i])
    if sum(pivot[i][3] * same[i] for i in rare) * 5 > articles:
        rare = set()
    fixed = {i for i in fixed if not inside[i]} | rare
    # Paragraphs or items of one list are all template or none: those of a kind go if two thirds of them with text are the same.
    for below in kids:
        like: dict[tuple[str, str], list[int]] = {}
        for k in below:
            if k in fixed or met.get(k, (0, 0, 0, 0))[2]:
                like.setdefault(pivot[k][0], []).append(k)
        for found in like.values():
            if sum(k in fixed for k in found) * 3 < 2 * len(found):
                fixed.difference_update(found)
    mass = [0] * len(pivot)
    for i in range(len(pivot) - 1, -1, -1):
        _, _, chars, lacked = met.get(i, (0, 0, 0, 0))
        own = (0 if i in fixed else chars + (pivot[i][3] * same.get(i, 0) if pivot[i][3] >= LONG else 0)) + lacked
        mass[i] = own + sum(mass[k] for k in kids[i])
    at = 0
    if not mass or not varies:
        return -1, set()
    while True:
        whole = [k for k in kids[at] if mass[k] == mass[at] and pivot[k][0][0] not in _NO_SLOT and met.get(k, (0,))[0] * 2 > pages]
        if not whole:
            return at, fixed
        at = whole[0]


#: What a host's pages need of it: the pivot, the main slot's node, the template's nodes.
Template = tuple[Tree, int, set[int]]


def _fix(node: Node, deep: bool) -> None:
    """Marks a node's own text, that of its inline elements and, if deep, of all below as template."""
    stack = [node]
    while stack:
        x = stack.pop()
        x.fixed = True
        stack += [y for y in x.items if not isinstance(y, str) and (deep or y.tag not in _BLOCK)]


def applied(root: Node, template: Template) -> Node | None:
    """Marks the template's text in a page; returns the page's main slot, if it has it."""
    pivot, slot, fixed = template
    tree, nodes = skeleton(root)
    found = None
    for i, j in match(pivot, tree):
        if i == slot:
            found = nodes[j]
        if i in fixed and pivot[i][2] == tree[j][2]:
            _fix(nodes[j], tree[j][1] == DEEPEST)
    return found


def links_only(node: Node) -> bool:
    """Whether a list of three items or more is nearly all links."""
    if node.tag not in ("ul", "ol") or sum(not isinstance(x, str) and x.tag == "li" for x in node.items) < 3:
        return False
    chars, linked, stack = 0, 0, [(node, False)]
    while stack:
        x, inside = stack.pop()
        for y in x.items:
            if isinstance(y, str):
                n = len(y.strip())
                chars, linked = chars + n, linked + n * inside
            else:
                stack.append((y, inside or y.tag == "a"))
    return chars > 0 and linked * 10 >= chars * 9


def main_parts(root: Node, slot: Node | None) -> list[Node]:
    """The page's main elements: the articles and mains of its slot or else the slot; without one, its longest article or main, or the element with most paragraph text."""
    top, up = slot or root, slot
    while up is not None:
        if up.tag in ("article", "main") or "role=main" in up.mark:
            return [slot]
        up = up.parent
    named: list[Node] = []
    best, most = top, 0
    stack = [(top, False)]
    while stack:
        node, in_named = stack.pop()
        if node.drop:
            continue
        if not in_named and (node.tag in ("article", "main") or "role=main" in node.mark):
            named.append(node)
            in_named = True
        direct = sum(len(t) for x in node.items if not isinstance(x, str) and x.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol") and not x.drop for t in blocks(x)) if not named and slot is None else 0
        if direct > most:
            best, most = node, direct
        stack += [(x, in_named) for x in reversed(node.items) if not isinstance(x, str)]
    if slot is not None:
        for node in [] if named else [x for x in _elements(slot) if links_only(x)]:
            node.drop = True
        return named or [slot]
    if named:
        return [max(((sum(map(len, blocks(n))), -i, n) for i, n in enumerate(named)), key=lambda x: x[:2])[2]]
    return [best if most else root]


def _elements(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [y for y in x.items if not isinstance(y, str) and not y.drop]


def extract(html: str, template: Template | None = None) -> str:
    """A page's main text: blocks joined by line feeds."""
    root = parse(html)
    slot = applied(root, template) if template else None
    nodes = main_parts(root, slot)
    node = nodes[0]
    if node.tag not in ("html", "article", "main") and slot is None:
        # The densest element may leave out parts of an article cut by wrappers; its parent's blocks are kept if they are text too.
        up = node.parent
        if up is not None and not up.drop and sum(map(len, blocks(up))) < 1.5 * sum(map(len, blocks(node))):
            nodes = [up]
    return "\n".join(t for n in nodes for t in blocks(n))


def _meet(rows: DataFrame, templates: DataFrame, run: Callable, kinds: str, column: int) -> DataFrame:
    """rows (host first) mapped by run(batch, template of a host as bytes or None).

    templates: host, template. Together they are broadcast if they are small;
    else a template's row goes ahead of its host's pages, whose parts have
    SALT_PAGES pages each. column: of a row's text, to bound batches.
    """
    spark = rows.sparkSession
    volume = templates.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).head()[0] or 0
    if volume <= SMALL_BYTES:
        held = spark.sparkContext.broadcast({r["host"]: bytes(r["template"]) for r in templates.collect()})

        def from_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in short_batches(whole, column)):
                yield from run(batch, [held.value.get(h) for h in batch.column(0).to_pylist()])

        return rows.mapInArrow(from_table, kinds)
    names = rows.columns
    parts = cut(rows.groupBy("host").agg(F.ceil(F.count("*") / SALT_PAGES).cast("int").alias("parts")).where("parts > 1"))  # hosts of many pages only
    salted = rows.join(F.broadcast(parts) if parts.count() <= 100_000 else parts, "host", "left")
    mine = salted.select(F.pmod(F.xxhash64(*names[1:]), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("turn"), *names, F.lit(None).cast("binary").alias("template"))
    ahead = templates.join(parts, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    ahead = ahead.select("salt", F.lit(0).alias("turn"), "host", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[1:]], "template")
    both = ahead.unionByName(mine).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "host", "salt").sortWithinPartitions("host", "salt", "turn")

    def from_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, template = None, None
        for batch in (part for whole in batches for part in short_batches(whole, column + 2)):
            turns, hosts, ahead_ = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(len(names) + 2)
            found = []
            for k, (turn, host) in enumerate(zip(turns, hosts, strict=True)):
                if turn == 0:
                    at, template = host, ahead_[k].as_py()
                else:
                    found.append(template if host == at else None)
            own = batch.filter(pa.array([t == 1 for t in turns]))
            if own.num_rows:
                yield from run(pa.RecordBatch.from_arrays(own.columns[2 : 2 + len(names)], names=names), found)

    return both.mapInArrow(from_stream, kinds)


@lru_cache(64)
def _pivot(data: bytes) -> Tree:
    return unpacked(data)


@lru_cache(64)
def _template(data: bytes) -> Template:
    slot, n = struct.unpack_from("<iI", data)
    return unpacked(data[8 + 4 * n :]), slot, set(np.frombuffer(data, dtype="<u4", count=n, offset=8).tolist())


def html_extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """df's id and url with text and n_chars."""
    rows = df.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    host = F.lower(F.coalesce(F.regexp_extract("__url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = rows.select(host.alias("host"), "__id", "__url", "__html")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in short_batches(whole, 1)):
            trees = [skeleton(parse(h))[0] for h in batch.column(1).to_pylist()]
            data = [packed(t) for t in trees]
            digests = np.array([xxhash.xxh3_64_intdigest(x) for x in data], dtype=np.uint64).view(np.int64)
            kinds_ = [len({n[0] for n in t}) for t in trees]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array(kinds_, pa.int32()), pa.array(data, pa.binary())], names=["host", "digest", "kinds", "tree"])

    trees = rows.where(F.char_length("__html") > 0).select("host", "__html").mapInArrow(shorten, "host string, digest bigint, kinds int, tree binary")
    trees = cut(trees.dropDuplicates(["host", "digest"]))
    # The pivot is the page with most kinds of elements, so that it has what the host's template has.
    first = trees.groupBy("host").agg(F.min(F.struct((-F.col("kinds")).alias("k"), F.octet_length("tree").alias("n"), "digest")).alias("f"), F.count("*").alias("pages"))
    first = first.where(F.col("pages") >= LEAST_PAGES).select("host", F.col("f.digest").alias("digest"), "pages")
    pivots = cut(trees.join(first, ["host", "digest"]).select("host", "pages", F.col("tree").alias("template")))
    slim = trees.select("host", "tree").join(F.broadcast(first.select("host")) if first.count() <= 100_000 else first.select("host"), "host", "left_semi")

    def align(batch: pa.RecordBatch, pivots_: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}
        for h, t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pivots_, strict=True):
            for i, found in tally(_pivot(p), unpacked(t)).items() if p else ():
                s = sums.setdefault((h, i), [0, 0, 0, 0])
                for c, x in enumerate(found):
                    s[c] += x
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([sums[k][c] for k in keys], pa.int64()) for c in range(4))], names=["host", "node", "n", "same", "chars", "lacked"])

    aligned = _meet(slim, pivots.select("host", "template"), align, "host string, node int, n bigint, same bigint, chars bigint, lacked bigint", 1)
    sums = aligned.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("chars").alias("chars"), F.sum("lacked").alias("lacked"))
    nodes = sums.groupBy("host").agg(F.collect_list(F.struct("node", "n", "same", "chars", "lacked")).alias("nodes"))  # at most the pivot's nodes a host

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 64) for whole in batches for k in range(0, whole.num_rows, 64)):
            out = []
            for pages, pivot, met in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                at, fixed = induce(unpacked(pivot), pages, {m["node"]: (m["n"], m["same"], m["chars"], m["lacked"]) for m in met})
                out.append(struct.pack("<iI", at, len(fixed)) + np.array(sorted(fixed), dtype="<u4").tobytes() + pivot if at >= 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["host", "template"])

    templates = pivots.join(nodes, "host").select("host", "pages", "template", "nodes").mapInArrow(decide, "host string, template binary")
    templates = cut(templates.where(F.col("template").isNotNull()))
    kinds = "__id " + df.schema[id_col].dataType.simpleString() + ", __url " + df.schema[url_col].dataType.simpleString()

    def read(batch: pa.RecordBatch, found: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        texts = [extract(h, _template(t) if t else None) for h, t in zip(batch.column(3).to_pylist(), found, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["__id", "__url", "text", "n_chars"])

    return _meet(rows, templates, read, f"{kinds}, text string, n_chars bigint", 3).toDF(id_col, url_col, "text", "n_chars")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
