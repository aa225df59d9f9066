"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a tree without what is never article text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments: by
element, role and class words; class words don't drop an element that holds the
marked article or most of the page's text). The trees of one host are aligned by simple
tree matching: children are matched in order so that the most nodes agree, by
dynamic programming at every size (above CELLS by halves, in linear memory),
subtrees of equal shape without recursion. The aligned
trees accumulate in a wrapper whose text slots know how many pages have them
and their most common texts (TEXTS counters, Misra-Gries, with the number that
each may be too low). Slots with the same text on most pages of a host are
template; varying slots are content. Where the counters leave it open, a further
pass counts the host's pages.

Distribution: every task merges its own pages into one wrapper per host, so a
host with a third of all pages is spread over all tasks; the partial wrappers
(of bounded size, as they only hold shape, counts and hashes) then merge in two
steps. What extraction needs from a wrapper is its constant slots; these few
are joined to the pages by host, broadcast while they are small and by a
shuffle on the host otherwise.

Where the page marks its article (article, main or the like), slots outside it
are left out. Else blocks that mostly consist of links are left out as menus.

Cases: null and empty html has an empty text; a null or unreadable url gives a
page without host, which is read without a wrapper; cut-off and badly nested
pages are read as far as they go; blocks nested deeper than DEPTH blocks are
aligned as if they stood at that depth, with all their texts (browsers do so,
too, from some depth on); a host of few pages, or one where the
constant slots make up most of the page (copies of one article), keeps all
slots; repeated rows give a row each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcast.llm.shared import cut

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li tbody td tfoot th thead tr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = frozenset("table ul ol dl select html body article section main div".split())

#: What is never article text.
DROPPED = frozenset("""nav footer aside form script style noscript template iframe svg canvas button select option textarea title head
object embed audio video dialog menu datalist math""".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
DROPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidenav menu nav navbar navigation breadcrumb
breadcrumbs footer masthead topbar cookie cookies consent gdpr banner notice notification popup modal overlay newsletter subscribe signup login paywall comment comments
disqus respond reply replies share sharing social related recommended widget pagination pager skip toolbar""".split())
ARTICLE = frozenset(("article", "main"))

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|itemprop|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: A name that starts so tells what a page or an article has or lacks; it isn't the name of the thing.
_TELLS = re.compile(r"(?i)(?:no|has|have|with|without|hide|show|is|not)[-_]|(?:no|has|with|without|hide|show|is)(?=[A-Z])")
_ANY_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)[^>]*>")
_MARKED = re.compile(r"""(?i)<(?:article|main)[\s>]|\srole\s*=\s*["']?(?:main|article)\b|\sitemprop\s*=\s*["']?articlebody\b""")
_NO_TEXT = re.compile(r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|\s+")

MIN_PAGES, MOST_PAGES, MOST_TEXT = 6, 0.5, 0.3
CELLS = 60_000
NODES = 200_000
DEPTH = 100
PARTS = 64
TEXTS = 4
BROADCAST_BYTES = 8 << 20


# ---- pages as trees: [label, children] and text leaves (a str) ----

class Element:
    __slots__ = ("tag", "children", "dropped", "article")

    def __init__(self, tag: str, dropped: bool = False, article: bool = False):
        self.tag, self.children, self.dropped, self.article = tag, [], dropped, article


def _judged(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is never article text, whether it is marked as the article, and whether its class or id names something else."""
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True, False, False
    article, by_name = tag in ARTICLE, False
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), ""), name.lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True, False, False
            if name == "role":
                if value.lower() in DROPPED_ROLES:
                    return True, False, False
                article |= value.lower() in ARTICLE
            elif name == "itemprop":
                article |= value.lower() == "articlebody"
            elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                by_name |= any(w.lower() in DROPPED_WORDS for token in value.split() if not _TELLS.match(token) for w in _NAME_WORD.findall(token))
    return False, article, by_name


class Extents:
    """Where a page's elements end, where its text is and where articles are marked; found in one pass over the page each."""

    def __init__(self, page: str):
        self.ends: dict[int, int] = {}
        opened: dict[str, list[int]] = {}
        for found in _ANY_TAG.finditer(page):
            tag = found[2].lower()
            if not found[1]:
                opened.setdefault(tag, []).append(found.start())
            elif opened.get(tag):
                self.ends[opened[tag].pop()] = found.end()
        self.n, self._page, self._removed = len(page), page, None
        self._marked = [found.span() for found in _MARKED.finditer(page)]

    def _measure(self) -> None:
        starts, after, removed, total = [0], [0], [0], 0
        for found in _NO_TEXT.finditer(self._page):
            total += found.end() - found.start()
            starts.append(found.start())
            after.append(found.end())
            removed.append(total)
        self._starts, self._after, self._removed, self._size = starts, after, removed, self.n - total

    def _text_before(self, at: int) -> int:
        k = bisect_right(self._starts, at) - 1
        return at - self._removed[k] + max(0, self._after[k] - at)

    def end_of(self, tag: str, start: int) -> int | None:
        """Where the element opened at ``start`` closes; the end of the page if nothing closes it, None where a later tag may."""
        return self.ends.get(start, None if tag == "p" or tag in CLOSED_BY else self.n)

    def holds_the_text(self, start: int, end: int, inside_article: bool) -> bool:
        """Whether page[start:end] has the only marked article of the page or most of its text."""
        marked = self._marked
        if marked and (marked[0][1] <= start or marked[-1][0] >= end):
            if not inside_article:  # what is outside the article is left out anyway
                return False
        elif marked and bisect_left(marked, (start, 0)) < bisect_left(marked, (end, 0)):
            return True
        if self._removed is None:
            self._measure()
        return 2 * (self._text_before(end) - self._text_before(start)) > self._size


def parse(page: str) -> Element:
    """The tree of a page; dropped elements have no children."""
    root = Element("html")
    stack, at, n = [root], 0, len(page)
    hidden = depth = 0
    open_tags: dict[str, int] = {}
    extents = None

    def close(k: int) -> None:
        nonlocal hidden, depth
        for e in stack[k:]:
            open_tags[e.tag] -= 1
            hidden -= e.dropped
            depth -= e.article
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not hidden:
            stack[-1].children.append(page[at:lt])
        if lt == n:
            break
        m = _TOKEN.match(page, lt)
        if not m:
            if not re.match(r"</?[a-zA-Z]", page[lt:lt + 3]):  # a bare sign
                if not hidden:
                    stack[-1].children.append("<")
                at = lt + 1
                continue
            m = _OPEN_TAG.match(page, lt)  # quotes that don't pair: the tag ends at the next sign
            if not m:
                break  # a tag cut off at the end
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_tags.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE and tag not in BLOCK:
                    break
            continue
        if tag in ("html", "body"):
            continue
        closing = CLOSED_BY.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
        for k in range(len(stack) - 1, 0, -1) if any(open_tags.get(t) for t in closing) else ():
            if stack[k].tag in closing:
                close(k)
                break
            if stack[k].tag in SCOPE:
                break
        dropped, article, by_name = _judged(tag, m[3], depth > 0)
        by_name &= not hidden and not article and tag not in VOID
        if extents is None and (by_name or dropped and not hidden):
            extents = Extents(page)
        if by_name:
            end = extents.end_of(tag, lt)
            dropped = end is None or not extents.holds_the_text(at, end, depth > 0)
        element = Element(tag, dropped, article)
        if not hidden and not dropped:
            stack[-1].children.append(element)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = page.find(">", end.start()) + 1 if end and page.find(">", end.start()) >= 0 else n
            continue
        if dropped and not hidden and extents.ends.get(lt, 0) > at:  # what is dropped as a whole need not be read, if it is closed
            at = extents.ends[lt]
            continue
        stack.append(element)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        hidden += dropped
        depth += article
    return root


@lru_cache(32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[\s/>]", re.I)


def _roots(tree: Element) -> tuple[list[Element], bool]:
    """Outermost marked articles, or the whole tree."""
    found, todo = [], [tree]
    while todo:
        e = todo.pop()
        if e.article:
            found.append(e)
        else:
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]
    if any(e.tag == "article" for e in found) and len(found) > 1:
        found = [e for e in found if e.tag == "article"]
    elif len(found) == 1 and found[0].tag == "main":  # the article inside main, where there is one
        inner, todo = [], [c for c in reversed(found[0].children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            if e.tag == "article":
                inner.append(e)
            else:
                todo += [c for c in reversed(e.children) if isinstance(c, Element)]
        found = inner or found
    return (found, True) if found else ([tree], False)


def blocks(page: str) -> tuple[list[tuple[tuple[str, ...], str, int]], bool]:
    """(path of block labels, text, characters in links) of the text blocks in page order, and whether an article is marked."""
    roots, marked = _roots(parse(page))
    out: list[tuple[tuple[str, ...], str, int]] = []
    buffer: list[str] = []
    linked = 0

    def flush(path: tuple[str, ...]) -> None:
        nonlocal linked
        text = "".join(buffer)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            out.append((path, text, linked))
        buffer.clear()
        linked = 0

    for root in roots:
        todo: list[tuple] = [("open", root, (), False)]
        while todo:
            what, e, path, link = todo.pop()
            if what == "text":
                buffer.append(e)
                linked += len(e.strip()) if link else 0
            elif what == "flush":
                flush(path)
            else:
                if e.tag == "br":
                    buffer.append(" ")
                    continue
                is_block = e.tag in BLOCK or e is root
                inner = (*path, e.tag) if is_block and len(path) < DEPTH else path
                if is_block:
                    flush(path)
                    todo.append(("flush", None, inner, False))
                for c in reversed(e.children):
                    todo.append(("text", c, inner, link or e.tag == "a") if isinstance(c, str) else ("open", c, inner, link or e.tag == "a"))
        flush(())
    return out, marked


# ---- wrappers: [label, pages, children] and slots ["#", pages, hash]; of several texts: ["#", pages, commonest hash or None, [[hash, count]], lost] ----

def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) << 16 | len(text) & 0xFFFF


def as_wrapper(page_blocks: list[tuple[tuple[str, ...], str, int]]) -> list:
    """The wrapper of one page: its block tree with hashed texts as slots."""
    root: list = ["", 1, []]
    for path, text, _ in page_blocks:
        at = root
        for label in path:
            last = at[2][-1] if at[2] else None
            # a text ends a simple block; the next one of the same label is a sibling
            if last is None or last[0] != label or (label not in _CONTAINERS):
                last = [label, 1, []]
                at[2].append(last)
            at = last
        at[2].append(["#", 1, _hash(text)])
    return root


_CONTAINERS = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr pre blockquote figcaption".split())


def _size(node: list) -> int:
    return 1 if node[0] == "#" else 1 + sum(map(_size, node[2]))


def _score(a: list, b: list, cache: dict) -> float:
    """Simple tree matching: the number of nodes that agree, with a little more for equal texts."""
    if a[0] != b[0]:
        return 0.0
    if a[0] == "#":
        return 1.5 if a[2] is not None and a[2] == b[2] else 1.0
    key = (id(a), id(b))
    if key not in cache:
        x, y = a[2], b[2]
        if len(x) == len(y) == 1 and x[0][0] == "#" == y[0][0]:
            cache[key] = 1 + _score(x[0], y[0], cache)
        elif len(x) * len(y) > CELLS:
            cache[key] = 1 + float(_last_row(range(len(x)), range(len(y)), _child_weights(x, y, cache))[-1])
        else:
            row = [0.0] * (len(y) + 1)
            for p in x:
                last, row = row, [0.0]
                for j, q in enumerate(y):
                    best = last[j + 1] if last[j + 1] >= row[j] else row[j]
                    if p[0] == q[0]:
                        both = last[j] + _score(p, q, cache)
                        if both > best:
                            best = both
                    row.append(best)
            cache[key] = 1 + row[-1]
    return cache[key]


def _texts(nodes: list) -> list | None:
    """The slot of each node if all are plain blocks of one text."""
    out = []
    for node in nodes:
        inner = node[2]
        if node[0] == "#" or len(inner) != 1 or inner[0][0] != "#":
            return None
        out.append(inner[0][2])
    return out


@lru_cache(4096)
def _aligned_labels(x: tuple[str, ...], y: tuple[str, ...]) -> list[tuple[int, int]]:
    """The alignment of plain blocks that have no text in common: the longest common subsequence of their labels."""
    lead = 0
    while lead < min(len(x), len(y)) and x[lead] == y[lead]:
        lead += 1
    tail = 0
    while tail < min(len(x), len(y)) - lead and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    inner = _plain_pairs(x[lead:len(x) - tail], y[lead:len(y) - tail], {}, {}) if lead + tail < min(len(x), len(y)) else []
    return [*((k, k) for k in range(lead)), *((i + lead, j + lead) for i, j in inner), *((len(x) - k, len(y) - k) for k in range(tail, 0, -1))]


def _plain_pairs(x: tuple[str, ...], y: tuple[str, ...], xs, ys) -> list[tuple[int, int]]:
    """Alignment of plain blocks with labels x and y and texts xs and ys: two nodes agree, or two and a half of equal text."""
    if len(x) * len(y) > CELLS:
        xt, yt = (np.array([-1 - k if t is None else t for t in (ts or [None] * n)], dtype=np.int64) for k, ts, n in ((0, xs, len(x)), (1, ys, len(y))))
        labels = {label: k for k, label in enumerate({*x, *y})}
        xl, yl = (np.array([labels[label] for label in z]) for z in (x, y))
        return _halved(len(x), len(y), lambda i, js: np.where(yl[js] == xl[i], np.where(yt[js] == xt[i], 2.5, 2.0), 0.0))
    table = [[0.0] * (len(y) + 1)]
    for i, p in enumerate(x):
        last, row, text = table[-1], [0.0], xs[i] if xs else None
        before = 0.0
        for j, q in enumerate(y):
            best = last[j + 1] if last[j + 1] >= before else before
            if p == q:
                both = last[j] + (2.5 if text is not None and text == ys[j] else 2.0)
                if both > best:
                    best = both
            row.append(best)
            before = best
        table.append(row)
    return _traced(table)


def _traced(table: list[list[float]]) -> list[tuple[int, int]]:
    i, j, pairs = len(table) - 1, len(table[0]) - 1, []
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _child_weights(x: list, y: list, cache: dict):
    return lambda i, js: np.array([_score(x[i], y[j], cache) for j in js])


def _last_row(rows, columns, weights) -> np.ndarray:
    """Best scores of aligning all ``rows`` with each lead of ``columns``; weights(i, js): scores of the pairs, 0 for none."""
    best, js = np.zeros(len(columns) + 1), np.array(columns, dtype=np.int64)
    for i in rows:
        best[1:] = np.maximum(best[1:], best[:-1] + weights(i, js))
        np.maximum.accumulate(best, out=best)
    return best


def _halved(n: int, m: int, weights) -> list[tuple[int, int]]:
    """Pairs of an alignment of the highest score of n with m children, in memory linear in them (Hirschberg)."""
    pairs, todo = [], [(0, n, 0, m)]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 == i1 or j0 == j1:
            continue
        if i1 - i0 == 1:
            own = weights(i0, np.arange(j0, j1))
            if own.max() > 0:
                pairs.append((i0, j0 + int(own.argmax())))
            continue
        half = (i0 + i1) // 2
        lead = _last_row(range(i0, half), range(j0, j1), weights)
        tail = _last_row(range(i1 - 1, half - 1, -1), range(j1 - 1, j0 - 1, -1), weights)[::-1]
        cut_at = j0 + int((lead + tail).argmax())
        todo += [(half, i1, cut_at, j1), (i0, half, j0, cut_at)]
    return pairs


def _aligned(x: list, y: list, cache: dict) -> list[tuple[int, int]]:
    """Pairs of children in an alignment of the highest score."""
    if len(x) == len(y) == 1:
        return [(0, 0)] if x[0][0] == y[0][0] else []
    xs = _texts(x)
    ys = xs and _texts(y)
    if xs and ys:
        labels = tuple([n[0] for n in x]), tuple([n[0] for n in y])
        if {*xs, None}.isdisjoint({*ys} - {None}):
            return _aligned_labels(*labels)
        return _plain_pairs(*labels, xs, ys)
    return _aligned_pairs(x, y, cache)


def _aligned_pairs(x: list, y: list, cache: dict) -> list[tuple[int, int]]:
    if len(x) * len(y) > CELLS:
        return _halved(len(x), len(y), _child_weights(x, y, cache))
    table = [[0.0] * (len(y) + 1)]
    for p in x:
        last, row = table[-1], [0.0]
        for j, q in enumerate(y):
            best = last[j + 1] if last[j + 1] >= row[j] else row[j]
            if p[0] == q[0]:
                both = last[j] + _score(p, q, cache)
                if both > best:
                    best = both
            row.append(best)
        table.append(row)
    return _traced(table)


def _merged_slot(a: list, b: list) -> list:
    """Both slots' pages and texts: counts of the TEXTS most common ones, each at most ``lost`` too low."""
    if len(a) == len(b) == 3 and a[2] == b[2]:
        return ["#", a[1] + b[1], a[2]]
    counts = dict(a[3]) if len(a) > 3 else {a[2]: a[1]}
    for text, n in b[3] if len(b) > 3 else ((b[2], b[1]),):
        counts[text] = counts.get(text, 0) + n
    lost = (a[4] if len(a) > 3 else 0) + (b[4] if len(b) > 3 else 0)
    if len(counts) > TEXTS:
        less = sorted(counts.values())[-1 - TEXTS]
        counts = {text: n - less for text, n in counts.items() if n > less}
        lost += less
    most, text = max(((n, text) for text, n in counts.items()), default=(0, None))
    return ["#", a[1] + b[1], text if most > 1 else None, sorted(map(list, counts.items())), lost]


def merge(a: list, b: list, cache: dict | None = None) -> list:
    """``a`` with the tree ``b`` (of the same label) aligned into it; counts add up."""
    cache = {} if cache is None else cache
    if a[0] == "#":
        return _merged_slot(a, b)
    x, y = a[2], b[2]
    if len(x) == len(y) == 1 and x[0][0] == "#" == y[0][0]:
        return [a[0], a[1] + b[1], [merge(x[0], y[0])]]
    out, i, j = [], 0, 0
    for p, q in [*_aligned(a[2], b[2], cache), (len(a[2]), len(b[2]))]:
        out += a[2][i:p] + b[2][j:q]
        if p < len(a[2]):
            out.append(merge(a[2][p], b[2][q], cache))
        i, j = p + 1, q + 1
    return [a[0], a[1] + b[1], out]


def constant_part(node: list, pages: int) -> list | None:
    """The wrapper reduced to slots ["#", pages, hash, sure] that have, or may have, one text on most of a host's pages."""
    if node[0] == "#":
        if node[2] is None:
            return None
        count, lost = (dict(node[3])[node[2]], node[4]) if len(node) > 3 else (node[1], 0)
        need = max(MIN_PAGES, MOST_PAGES * pages)
        return ["#", node[1], node[2], count >= need] if count + lost >= need else None
    inner = [x for x in (constant_part(c, pages) for c in node[2]) if x]
    return [node[0], node[1], inner] if inner else None


def _slots(node: list) -> list[list]:
    return [node] if node[0] == "#" else [slot for c in node[2] for slot in _slots(c)]


def _confirmed(node: list, held: set[int]) -> list | None:
    """The reduced wrapper without the unsure slots (by identity) that aren't in ``held``."""
    if node[0] == "#":
        return node if node[3] or id(node) in held else None
    inner = [x for x in (_confirmed(c, held) for c in node[2]) if x]
    return [node[0], node[1], inner] if inner else None


def _equal_slots(page: list, wrapper: list) -> list[tuple[list, list]]:
    """Aligned slots of page and reduced wrapper that have the same text."""
    found: list[tuple[list, list]] = []
    cache: dict = {}

    def walk(a: list, b: list) -> None:
        if a[0] == "#":
            if a[2] == b[2]:
                found.append((a, b))
            return
        for p, q in _aligned(a[2], b[2], cache):
            walk(a[2][p], b[2][q])

    walk(page, wrapper)
    return found


def template_slots(page: list, wrapper: list) -> set[int]:
    """Numbers (in page order) of the page's slots that match a constant slot of the wrapper."""
    number = {id(slot): k for k, slot in enumerate(_slots(page))}
    return {number[id(a)] for a, _ in _equal_slots(page, wrapper)}


def main_text(page: str, wrapper: list | None = None) -> str:
    """Content blocks of a page, one a line."""
    found, marked = blocks(page)
    if not marked:
        found = [b for b in found if b[2] <= 0.6 * len(b[1])]
    if wrapper and found:
        template = template_slots(as_wrapper(found), wrapper)
        size = sum(len(b[1]) for b in found)
        constant = sum(len(found[k][1]) for k in template)
        if constant < size and (not marked or constant <= MOST_TEXT * size):
            found = [b for k, b in enumerate(found) if k not in template]
    return "\n".join(b[1] for b in found)


# ---- Spark ----

def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def induced(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper): the constant part of each host's wrapper, for hosts that have one."""
    schema = "host string, part int, pages long, wrapper string"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId() % PARTS
        met: dict[str, list] = {}
        nodes = 0

        def given() -> pa.RecordBatch:
            rows = [(h, part, w[1], json.dumps(w)) for h, w in met.items()]
            met.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.string()))],
                                              ["host", "part", "pages", "wrapper"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                one = as_wrapper(blocks(page.as_py() or "")[0])
                nodes += _size(one)
                met[host] = merge(met[host], one) if host in met else one
            if met and nodes > NODES:
                yield given()
                nodes = 0
        if met:
            yield given()

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        out = None
        for w in frame.sort_values(["pages", "wrapper"])["wrapper"]:
            w = json.loads(w)
            out = w if out is None else merge(out, w)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "part": [0], "pages": [out[1]], "wrapper": [json.dumps(out)]})

    def reduced(frame: pd.DataFrame) -> pd.DataFrame:
        row = joined(frame)
        left = constant_part(json.loads(row["wrapper"].iloc[0]), int(row["pages"].iloc[0])) if row["pages"].iloc[0] >= MIN_PAGES else None
        sure = left is None or all(slot[3] for slot in _slots(left))
        return row.assign(wrapper=json.dumps(left), sure=sure)[["host", "pages", "wrapper", "sure"]][[left is not None]]

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        counts: dict[tuple[str, int], int] = {}
        for b in batches:
            for host, page, wrapper in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if host not in known:
                    tree = json.loads(wrapper)
                    known[host] = tree, {id(slot): k for k, slot in enumerate(_slots(tree))}
                tree, number = known[host]
                for _, slot in _equal_slots(as_wrapper(blocks(page.as_py() or "")[0]), tree):
                    counts[host, number[id(slot)]] = counts.get((host, number[id(slot)]), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int64()),
                                          pa.array(list(counts.values()), pa.int64())], ["host", "slot", "n"])

    def settled(wrapper: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(wrapper):
            return wrapper[["host", "pages", "wrapper"]]
        tree, n = json.loads(wrapper["wrapper"].iloc[0]), int(wrapper["pages"].iloc[0])
        slots = _slots(tree)
        held = {id(slots[k]) for k, m in zip(counts["slot"], counts["n"]) if m >= max(MIN_PAGES, MOST_PAGES * n)}
        left = _confirmed(tree, held)
        return wrapper.assign(wrapper=json.dumps(left))[["host", "pages", "wrapper"]][[left is not None]]

    read = pages.select(_host().alias("host"), "html").where("host <> ''")
    parts = read.mapInArrow(partial, schema)
    parts = parts.groupBy("host", "part").applyInPandas(joined, schema)
    found = cut(parts.groupBy("host").applyInPandas(reduced, "host string, pages long, wrapper string, sure boolean"), "wrappers-found")
    unsure = found.where("NOT sure").select("host", "pages", "wrapper")
    if unsure.isEmpty():
        return found.select("host", "pages", "wrapper")
    counts = read.join(unsure.select("host", "wrapper"), "host").mapInArrow(equal, "host string, slot long, n long")
    counts = counts.groupBy("host", "slot").agg(F.sum("n").alias("n"))
    unsure = unsure.groupBy("host").cogroup(counts.groupBy("host")).applyInPandas(settled, "host string, pages long, wrapper string")
    return found.where("sure").select("host", "pages", "wrapper").unionByName(unsure)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    wrappers = cut(induced(pages), "wrappers").select("host", "wrapper")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for b in batches:
            texts = []
            for page, wrapper in zip(b.column(2), b.column(3).to_pylist()):
                if wrapper is not None and wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                texts.append(main_text(page.as_py() or "", known.get(wrapper)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("host"))
    small = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    rows = rows.join(small, "host", "left").select("page_id", "url", "html", "wrapper")
    return rows.mapInArrow(read, "page_id long, url string, text string")
