"""Block trees of web pages, and their alignment by simple tree matching."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable

import numpy as np

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements, roles and names that are not the article.
CHROME_TAGS = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video map nav footer aside form "
    "button select datalist textarea input fieldset dialog menu xmp noembed noframes title".split()
)
CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split()
)
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox banner banners sponsor sponsored sponsors promo "
    "promos promotion menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs pagination pager sidebar side "
    "sidenav rail aside widget widgets footer masthead topbar toolbar header cookie cookies consent gdpr notice notices "
    "notification notifications alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist respond reply replies disqus share sharing social related recommended recommendations outbrain taboola "
    "copyright skip".split()
)
# Words that say where or how a block stands, and leave open what it is.
PLAIN_NAMES = frozenset(
    "area article bar block blocks body bottom box btn button buttons card cell col column container content count desktop "
    "entry fixed form global group holder icon icons inner item items js left link links list main middle mobile module news "
    "outer page panel post primary right row secondary section site slot sticky story sub text thread title top unit web "
    "wrap wrapper zone".split()
)
_CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
        "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt tr td th tbody thead tfoot".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
# Elements that an end tag inside them does not reach through.
_SCOPES = frozenset("table td th caption article section aside nav footer header form html body main ul ol".split())
MAX_DEPTH = 100
# Scores that the alignment of two pages remembers; beyond, they are computed again.
MAX_CELLS = 1 << 20
# Tables of rows of siblings up to this size are filled cell by cell, larger ones row by row.
SMALL_CELLS = 1 << 12

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|</[^>]*>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Run(str):
    """A run of text, and how many of its characters are links."""

    __slots__ = ("linked",)


class Node:
    """A block element; ``items`` are nodes and runs of text, in page order.

    ``doubt`` marks a block that is named like chrome among other words.
    """

    __slots__ = ("tag", "label", "chrome", "doubt", "items", "shape", "size")

    def __init__(self, tag: str, label: str, chrome: bool, doubt: bool = False):
        self.tag, self.label, self.chrome, self.doubt = tag, label, chrome, doubt
        self.items: list = []


def _names(attrs: dict, inside_article: bool) -> tuple[bool, bool]:
    """Whether class or id name nothing but chrome, and whether they mention it among other words."""
    doubt = False
    for name in (attrs.get("class", ""), attrs.get("id", "")):
        for one in name.split():
            words = _WORDS.findall(_CAMEL.sub(r"\1 \2", one).lower())
            if words[:1] and words[0] in ("with", "has", "no", "without"):
                continue
            found = CHROME_NAMES.intersection(words)
            if not found or inside_article and words[-1] == "header":
                continue
            if all(w in found or w in PLAIN_NAMES or w.isdigit() for w in words):
                return True, False
            doubt = True
    return False, doubt


def _is_chrome(tag: str, attrs: dict, inside_article: bool) -> tuple[bool, bool]:
    """Whether a block is chrome for certain, and whether its names leave that open."""
    if tag in CHROME_TAGS or attrs.get("role", "").lower() in CHROME_ROLES:
        return True, False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True, False
    # A header inside the article holds its heading; any other is the site's.
    if tag == "header":
        return not inside_article, False
    if tag in ("html", "body", "main"):
        return False, False
    return _names(attrs, inside_article)


def parse(page: str | None) -> Node:
    """The block tree of a page; broken markup never fails.

    Inline elements leave only their text.  Nesting beyond MAX_DEPTH is laid flat; no text is
    lost by that.
    """
    root = Node("#root", "#root", False)
    page = page or ""
    # Open elements: tag, the node that collects their text, whether they are blocks, whether a link is open.
    stack: list[tuple[str, Node, bool, bool]] = [("#root", root, True, False)]
    run: list[str] = []
    linked = 0

    def close_run() -> None:
        nonlocal linked
        if run:
            text = Run(" ".join(entities.unescape("".join(run)).split()))
            if text:
                text.linked = min(linked, len(text))
                stack[-1][1].items.append(text)
            run.clear()
        linked = 0

    at = 0
    while at < len(page):
        found = _MARKUP.search(page, at)
        if not found:
            run.append(page[at:])
            linked += (len(page) - at) * stack[-1][3]
            break
        if found.start() > at:
            run.append(page[at : found.start()])
            linked += (found.start() - at) * stack[-1][3]
        at = found.end()
        tag = found.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if found.group(1):
            if tag in INLINE:
                hidden = len(stack) > 1 and stack[-1][0] == tag and stack[-1][1].chrome
                if hidden:
                    close_run()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if not any(stack[j][2] for j in range(i, len(stack))) or hidden:
                            del stack[i:]
                        break
                    if stack[i][2]:
                        break
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close_run()
                    del stack[i:]
                    break
                if stack[i][0] in _SCOPES and tag not in _SCOPES:
                    break
            continue
        attrs = {}
        if found.group(3):
            for m in _ATTRIBUTE.finditer(found.group(3)):
                attrs.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("br", "hr"):
            run.append(" ")
            if tag == "hr":
                close_run()
            continue
        if tag in VOID:
            continue
        inside = any(s[0] == "article" and not s[1].chrome for s in stack)
        chrome, doubt = _is_chrome(tag, attrs, inside)
        if tag in INLINE and not chrome:
            if len(stack) < 4 * MAX_DEPTH:
                stack.append((tag, stack[-1][1], False, stack[-1][3] or tag == "a"))
            continue
        close_run()
        for i in range(len(stack) - 1, 0, -1):
            if tag in _CLOSED_BY.get(stack[i][0], ()):
                del stack[i:]
                break
            if stack[i][0] in _SCOPES:
                break
        kinds = sorted(_DIGITS.sub("", attrs.get("class", "")).split())
        node = Node(tag, f"{tag}.{' '.join(kinds)}", chrome, doubt)
        stack[-1][1].items.append(node)
        if sum(s[2] for s in stack) < MAX_DEPTH:
            stack.append((tag, node, True, stack[-1][3]))
        else:
            stack.append((tag, stack[-1][1], False, stack[-1][3]))
    close_run()
    _settle(root)
    _keep_articles(root)
    return root


def _settle(node: Node) -> tuple[int, int]:
    """Characters below a block and those in links; a doubtful name holds for a block that is mostly links."""
    chars = linked = 0
    for item in node.items:
        n, k = (len(item), item.linked) if isinstance(item, str) else _settle(item)
        chars, linked = chars + n, linked + k
    node.chrome = node.chrome or node.doubt and 0 < chars <= 2 * linked
    return chars, linked


def _keep_articles(node: Node) -> bool:
    """Whether an article is inside; a block that holds one is not chrome for its name alone."""
    holds = False
    for item in node.items:
        if isinstance(item, Node):
            holds = _keep_articles(item) or holds
    if holds and node.chrome and node.tag not in CHROME_TAGS:
        node.chrome = False
    return holds or (node.tag in ("article", "main") and not node.chrome)


def _measure(node: Node) -> None:
    shapes, size = [], 1
    for item in node.items:
        if isinstance(item, str):
            shapes.append("#")
            size += 1
        else:
            _measure(item)
            shapes.append(item.shape)
            size += item.size
    node.shape, node.size = hash((node.label, tuple(shapes))), size


class Leaves:
    """A page's text runs in order, with the tree that aligns them."""

    def __init__(self, page: str | None):
        self.root = parse(page)
        _measure(self.root)
        self.texts: list[str] = []
        self.chrome: list[bool] = []
        self.article: list[str] = []
        self._number: dict[tuple[int, int], int] = {}
        self._walk(self.root, False, "")

    def _walk(self, node: Node, chrome: bool, article: str) -> None:
        chrome = chrome or node.chrome
        if node.tag in ("article", "main") and not chrome:
            article = article or node.tag
        for i, item in enumerate(node.items):
            if isinstance(item, str):
                self._number[id(node), i] = len(self.texts)
                self.texts.append(item)
                self.chrome.append(chrome)
                self.article.append(article)
            else:
                self._walk(item, chrome, article)

    def number(self, node: Node, i: int) -> int:
        return self._number[id(node), i]

    def main_text(self, template: set[int]) -> list[str]:
        """Text runs of the page's article: neither chrome nor template.

        ``main`` holds it, or the ``article`` elements.  Articles with less than half of the words
        outside them (links count for nothing) are teasers: the story is what stands
        outside, and articles that are mostly links go.  So it is if the articles are all template.
        """
        slots = [i for i, c in enumerate(self.chrome) if not c and i not in template]
        marked = [i for i in slots if self.article[i]]
        if not marked:
            return [] if "main" in self.article else [self.texts[i] for i in slots]
        own = {i: len(self.texts[i]) - self.texts[i].linked for i in slots}
        inside = sum(own[i] for i in marked)
        if any(self.article[i] == "main" for i in marked) or 2 * inside >= sum(own.values()) - inside:
            return [self.texts[i] for i in marked]
        teasers = 2 * inside <= sum(len(self.texts[i]) for i in marked)
        return [self.texts[i] for i in slots if not (teasers and self.article[i])]


def _shape(item) -> object:
    return "#" if isinstance(item, str) else item.shape


class _Matcher:
    """Simple tree matching of two pages.

    The largest match whatever the length of the rows of siblings: a table of more than ``cells``
    cells is held in part only, every so many of its rows, and the rest is computed again where
    it is needed.
    """

    def __init__(self, cells: int = MAX_CELLS):
        self.cells = cells
        self.memo: dict = {}

    def score(self, a, b) -> int:
        """Largest number of nodes that two subtrees share in order."""
        if isinstance(a, str) or isinstance(b, str):
            return int(isinstance(a, str) and isinstance(b, str))
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        key = (a.shape, b.shape)
        found = self.memo.get(key)
        if found is None:
            found = 1 + self._shared(a.items, b.items)
            if len(self.memo) < self.cells:
                self.memo[key] = found
        return found

    def _shared(self, left: list, right: list) -> int:
        begin, n, m = _equal_ends(left, right, _shape)
        total = sum(1 if isinstance(x, str) else x.size for x in left[:begin] + left[n:])
        left, right = left[begin:n], right[begin:m]
        if not left or not right:
            return total
        if self._small(left, right):
            return total + self._table(left, right)[-1][-1]
        row, weights = np.zeros(len(right) + 1, "int64"), self._weights(right)
        for a in left:
            row = _next_row(row, weights(a))
        return total + int(row[-1])

    def pairs(self, left: list, right: list) -> list[tuple[int, int]]:
        """Places of the siblings that a largest match puts together, last ones first."""
        out: list[tuple[int, int]] = []
        if self._small(left, right):
            _trace(self._table(left, right), 0, len(left), len(right), out)
            return out
        step, weights = math.isqrt(len(left)) + 1, self._weights(right)
        row, kept = np.zeros(len(right) + 1, "int64"), []
        for i, a in enumerate(left):
            if i % step == 0:
                kept.append(row)
            row = _next_row(row, weights(a))
        j = len(right)
        for k in range(len(kept) - 1, -1, -1):
            rows = [kept.pop()]
            for a in left[k * step : (k + 1) * step]:
                rows.append(_next_row(rows[-1], weights(a)))
            j = _trace(rows, k * step, len(rows) - 1, j, out)
            if not j:
                break
        return out

    def _small(self, left: list, right: list) -> bool:
        return len(left) * len(right) <= min(self.cells, SMALL_CELLS)

    def _weights(self, right: list) -> Callable[[object], np.ndarray]:
        """Scores of a sibling with all of ``right``; siblings of one shape are scored once."""
        first: dict = {}
        codes = np.array([first.setdefault(_shape(b), len(first)) for b in right])
        kinds = dict(zip(map(_shape, right), right))
        one_of_each = [kinds[shape] for shape in first]
        known: dict = {}

        def weights(a) -> np.ndarray:
            shape = _shape(a)
            found = known.get(shape)
            if found is None:
                found = np.array([self.score(a, b) for b in one_of_each], "int64")
                if (len(known) + 1) * len(found) <= self.cells:
                    known[shape] = found
            return found[codes]

        return weights

    def _table(self, left: list, right: list) -> list[list[int]]:
        """Best scores of all pairs of leading rows."""
        table = [[0] * (len(right) + 1)]
        for a in left:
            above, row = table[-1], [0]
            for j, b in enumerate(right):
                best = above[j + 1] if above[j + 1] >= row[j] else row[j]
                both = above[j] + self.score(a, b)
                row.append(both if both > best else best)
            table.append(row)
        return table


def _next_row(above: np.ndarray, weights: np.ndarray) -> np.ndarray:
    row = np.zeros_like(above)
    np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights), out=row[1:])
    return row


def _trace(rows: list, at: int, i: int, j: int, out: list[tuple[int, int]]) -> int:
    """Walk from row ``i``, column ``j`` up to the first of ``rows``, which is row ``at`` of the table."""
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((at + i, j))
    return j


def _equal_ends(left: list, right: list, key) -> tuple[int, int, int]:
    """How many items are equal from the start, and where the equal ends of both begin."""
    begin, n, m = 0, len(left), len(right)
    while begin < min(n, m) and key(left[begin]) == key(right[begin]):
        begin += 1
    while min(n, m) > begin and key(left[n - 1]) == key(right[m - 1]):
        n, m = n - 1, m - 1
    return begin, n, m


def align(ref: Leaves, page: Leaves, cells: int = MAX_CELLS) -> dict[int, int]:
    """Number of each page text run that has a place in the reference -> that place."""
    places: dict[int, int] = {}
    matcher = _Matcher(cells)

    def match(a: Node, b: Node) -> None:
        left, right = a.items, b.items
        # Runs of equal shape at both ends are matched as they are; no other match is larger.
        begin, n, m = _equal_ends(left, right, _shape)
        ends(a, b, 0, 0, begin, len(left), n, m)
        if begin == n or begin == m:
            return
        for i, j in matcher.pairs(left[begin:n], right[begin:m]):
            pair(a, begin + i, b, begin + j)

    def ends(a: Node, b: Node, at: int, to: int, count: int, stop: int, n: int, m: int) -> None:
        for i in range(count):
            pair(a, at + i, b, to + i)
        for i in range(stop - n):
            pair(a, n + i, b, m + i)

    def pair(a: Node, i: int, b: Node, j: int) -> None:
        if isinstance(a.items[i], str):
            places[page.number(b, j)] = ref.number(a, i)
        else:
            match(a.items[i], b.items[j])

    match(ref.root, page.root)
    return places
