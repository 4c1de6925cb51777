"""Main text of HTML pages by composite text density.

A page becomes a small DOM. Menus, forms and the like are pruned by element and by
name; then every node gets its characters per tag, adjusted for link characters and
link tags. The node whose children's densities sum highest is the content; other
nodes with at least the lowest density on the path from it to the body contribute
their own densest subtrees. Pages are independent rows: no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp svg math select object canvas".split())
DROP = RAW | set("head nav footer aside form button dialog menu audio video map".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - set("caption legend option tbody td tfoot th thead tr body html".split())
#: A start tag ends open elements of these names, up to the nearest of the scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class names and ids that speak against an element, and among them those that also name parts of articles.
NAMED = set(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar side nav navbar"
    " navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay"
    " newsletter subscribe subscription signup login comment comments discussion disqus respond reply replies share sharing social related"
    " recommended recommendations widget widgets toolbar pagination pager search skip".split()
)
VAGUE = set("banner side menu notice notices overlay respond reply replies social search skip subscription".split())
#: What the sums of elements with such names count for when the best subtree is sought.
NAMED_WEIGHT = 0.2
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
DECLARATION = re.compile(r"<[!?]")
#: Deeper elements are children of the deepest open one, as in browsers.
MOST_DEPTH = 512
#: So many links make a list of links.
LIST_LINKS = 3
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Dom:
    """Elements in page order (parents first), and the texts between tags with their element."""

    def __init__(self, page: str):
        self.tags, self.parent, self.attributes = ["html"], [-1], [""]
        self.texts: list[tuple[int, str, int]] = []  # element, text, number of the block that it stands in
        self._stack, self._block = [0], 0
        self._open: dict[str, int] = {}  # how many elements of a name are open
        at, end = 0, len(page)
        last = page.rfind(">") + 1  # no tag ends behind it, and up to there each one ends, so no part is searched twice
        while at < end:
            m = TOKEN.search(page, at, last) if at < last else None
            if not m:
                rest = DECLARATION.search(page, at)
                self._text(page[at : rest.start() if rest else end])
                break
            self._text(page[at : m.start()])
            at = end if m[0].startswith("<!--") and not m[0].endswith("-->") else m.end()
            if name := m[2]:
                name = name.lower()
                if m[1]:
                    self._end(name)
                else:
                    self._start(name, m[3])
                    if name in RAW and not m[3].endswith("/"):
                        close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                        at = close.end() if close else end
                        self._end(name)

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._stack[-1], text, self._block))

    def _close(self, k: int) -> None:
        for i in self._stack[k:]:
            self._open[self.tags[i]] -= 1
        del self._stack[k:]

    def _pop(self, names: set[str], scope: set[str]) -> None:
        if not any(self._open.get(n) for n in names):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[k]]
            if tag in names:
                self._close(k)
                self._block += 1
                if tag == "p":
                    return
            elif tag in scope:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._pop({"p"}, BLOCK - {"p"})
        if name in IMPLIED:
            self._pop(*IMPLIED[name])
        if name in BLOCK:
            self._block += 1
        elif name == "br":
            self.texts.append((self._stack[-1], " ", self._block))
        self.tags.append(name)
        self.parent.append(self._stack[-1])
        self.attributes.append(attributes)
        if name not in VOID and not (attributes.endswith("/") and name not in BLOCK) and len(self._stack) < MOST_DEPTH:
            self._stack.append(len(self.tags) - 1)
            self._open[name] = self._open.get(name, 0) + 1

    def _end(self, name: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1) if self._open.get(name) else ():
            tag = self.tags[self._stack[k]]
            if tag == name:
                self._close(k)
                break
            if name not in BLOCK and tag in BLOCK:
                break  # a stray inline end tag closes no block
        if name in BLOCK:
            self._block += 1

    def pruned(self) -> tuple[list[bool], list[int]]:
        """Which elements are no article by element, hidden or within such a one; and which have a name or role against them:
        1 a vague word of a part of the article, else 2."""
        n = len(self.tags)
        holds = [False] * n  # the article, its main part or a main heading stands within
        for i in range(n - 1, 0, -1):
            if holds[i] or self.tags[i] in ("article", "main", "h1"):
                holds[self.parent[i]] = True
        out, named, inside = [False] * n, [0] * n, [False] * n  # inside: of an article or the main part
        first = self.tags.index("article") if "article" in self.tags else -1
        for i in range(1, n):
            p = self.parent[i]
            inside[i] = inside[p] or self.tags[p] in ("article", "main")
            kind = self._foreign(i, holds[i], inside[i], i == first)
            out[i] = out[p] or kind == 3
            named[i] = kind % 3
        return out, named

    def _foreign(self, i: int, holds: bool, inside: bool, first: bool) -> int:
        """0 nothing speaks against the element; 1 a vague word, 2 another or a role; 3 it is no article."""
        tag = self.tags[i]
        if tag in DROP or tag == "header" and not (inside and holds):
            return 3
        if tag == "header" or not self.attributes[i]:
            return 0
        values = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(self.attributes[i])}
        if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
            return 3
        if tag in ("body", "main"):
            return 0
        if values.get("role", "").lower() in ROLES and not holds:
            return 2
        words = {w.lower() for k in ("class", "id") for w in NAME_WORD.findall(values.get(k, ""))} & NAMED
        if not words or first or holds and not words & {"comment", "comments"}:
            return 0
        return 1 if inside and words <= VAGUE else 2


def _densities(dom: Dom, out: list[bool]) -> tuple[list[float], list[float], list[bool]]:
    """Composite density of every element, the sum over its children, and whether it is a list of links:
    several, with most of its characters."""
    n = len(dom.tags)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = dom.tags[i] == "a" or linked[dom.parent[i]]
    for e, text, _ in dom.texts:
        if not out[e]:
            size = len(text.strip())
            chars[e] += size
            links[e] += size * linked[e]
    for i in range(n - 1, 0, -1):
        if not out[i]:
            p = dom.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (dom.tags[i] == "a")
    body_share = links[0] / max(chars[0], 1)
    density = [0.0] * n
    for i in range(n):
        c, t = chars[i], max(tags[i], 1)
        if c and not out[i]:
            base = math.log(c / max(c - links[i], 1) * links[i] + body_share * c + math.e)
            ratio = c / max(links[i], 1) * t / max(link_tags[i], 1)
            density[i] = c / t * math.log(ratio + 1) / math.log(base + 1)
    sums = [0.0] * n
    for i in range(1, n):
        sums[dom.parent[i]] += density[i]
    sums = [s or d for s, d in zip(sums, density)]  # a leaf stands for itself
    return density, sums, [2 * x > c and k >= LIST_LINKS for x, c, k in zip(links, chars, link_tags)]


def _spared(dom: Dom, out: list[bool], named: list[int]) -> list[bool]:
    """`out`, and the named elements too, but for those that hold the best subtree, and for vague ones that are as dense as what
    lies on the path from there to the body. Where no article or main part with text is stated, a subtree of named
    elements can be the best, by what names leave of its sum."""
    if not any(named):
        return out
    n = len(dom.tags)
    within = [False] * n
    for i in range(1, n):
        within[i] = within[dom.parent[i]] or named[i] > 0
    density, sums, _ = _densities(dom, [o or w for o, w in zip(out, within)])
    best = max(range(n), key=lambda i: (sums[i], -i))
    stated = any(density[i] and dom.tags[i] in ("article", "main") for i in range(n))
    with_named, named_sums, _ = _densities(dom, out)
    rival = max((i for i in range(n) if within[i] and not out[i]), key=lambda i: (named_sums[i], -i), default=0)
    if not stated and NAMED_WEIGHT * named_sums[rival] * within[rival] > sums[best]:
        best = rival
    i, density = best, with_named
    threshold, path = density[best], {best}
    while i > 0:
        i = dom.parent[i]
        path.add(i)
        if dom.tags[i] not in ("body", "html"):
            threshold = min(threshold, density[i])
    out = list(out)
    for i in range(1, n):
        own = named[i] == 2 or named[i] == 1 and density[i] < threshold
        out[i] = out[i] or out[dom.parent[i]] or own and i not in path
    return out


def _content(dom: Dom, out: list[bool]) -> list[bool]:
    """Which elements are content."""
    n = len(dom.tags)
    density, sums, link_list = _densities(dom, out)
    best = max(range(n), key=lambda i: (sums[i], -i))
    threshold, i = density[best], best
    while i > 0 and dom.tags[i] != "body":
        threshold = min(threshold, density[i])
        i = dom.parent[i]
    # The best subtree of every subtree, children before parents.
    top = list(range(n))
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        if not out[i] and sums[top[i]] > sums[top[p]]:
            top[p] = top[i]
    taken = [False] * n
    whole = best
    i = best
    while i > 0:  # an article that holds the best subtree is content as a whole
        if dom.tags[i] in ("article", "main"):
            whole = i
        i = dom.parent[i]
    taken[best] = taken[whole] = True
    # Lists of links below the threshold are none of the article, nor are headings right before them, nor are further
    # articles with little of the characters (teasers).
    out, below, path, i = list(out), [False] * n, {best}, best
    while i > 0:
        i = dom.parent[i]
        path.add(i)
    chars = [0] * n
    for e, text, _ in dom.texts:
        if not out[e]:
            chars[e] += len(text.strip())
    for i in range(n - 1, 0, -1):
        chars[dom.parent[i]] += chars[i]
    articles = [i for i in range(1, n) if dom.tags[i] == "article" and not out[i]]
    own = max((chars[i] for i in articles if i in path), default=0)
    for i in articles:
        out[i] = i not in path and best not in _lineage(dom, i) and 3 * chars[i] < own
    before: dict[int, int] = {}  # of an element: its last child so far
    for i in range(1, n):
        p = dom.parent[i]
        below[i] = below[p] or p == whole
        if below[i] and not out[i] and i not in path and dom.tags[i] in BLOCK and link_list[i] and density[i] < threshold:
            out[i] = True
            if dom.tags[before.get(p, 0)] in HEADINGS:
                out[before[p]] = True
        before[p] = i
    if whole == best:
        seen = [False] * n
        for i in range(1, n):
            p = dom.parent[i]
            seen[i] = seen[p] or taken[p]
            if not seen[i] and not out[i] and dom.tags[i] != "body" and density[i] >= threshold > 0:
                taken[top[i]] = True
    for i in range(1, n):
        out[i] = out[i] or out[dom.parent[i]]
        taken[i] = (taken[i] or taken[dom.parent[i]]) and not out[i]
    return taken


def _lineage(dom: Dom, i: int) -> set[int]:
    """The elements that an element lies in."""
    found: set[int] = set()
    while i > 0:
        i = dom.parent[i]
        found.add(i)
    return found


def main_text(page: str | None) -> str:
    """The article of a page: one line per block, white space as one space, character references decoded."""
    if not page:
        return ""
    dom = Dom(page)
    taken = _content(dom, _spared(dom, *dom.pruned()))
    blocks: dict[int, list[str]] = {}
    for e, text, block in dom.texts:
        if taken[e]:
            blocks.setdefault(block, []).append(html.unescape(text))  # a reference doesn't reach over a tag
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of `pages`.

    A null or empty html, and one without content, gives an empty text. Null or
    repeated ids and urls pass through; other columns are not read; an empty table
    gives an empty table. A page without any tag is all content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
