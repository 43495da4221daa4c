"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Parts that are marked as something else than an article are taken
off it: scripts, styles, forms, navigation, headers, footers, asides, and elements whose role, class or
id names a menu, sidebar, advert, notice or reader comments.  Of the others every element i has

    density(i) = C/T * log(C/LC * T/LT) / log(ln(max(1, C/(C-LC) * LC + LCb/Cb * C) + e))

with C characters, T tags, LC characters and LT tags of links below it, and LCb, Cb those of the whole
body; a zero divisor counts as one.  Long text under few tags is dense, links make it thin.  The
subtree whose children's densities have the largest sum is the article.  The smallest density on the
way from it up to the body is the threshold: elements beside it that reach the threshold are taken
too, each with its own densest subtree.  If the article lies within an ``article`` or ``main`` element, that
whole element is taken.  Lists and boxes made of links alone are left out as menus.

Character references are decoded, white space within a block is one space, and blocks are joined by
one space in page order; ``br`` ends a line of a block.

Defined results: a null or empty page, or one without text outside the parts taken off, has the empty
text; a page without tags is its own text; tags that are never closed end with their parent; a tag cut
off by the page's end is dropped; ids and addresses may be null and are passed on; equal pages are
treated alike; of other columns nothing is read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is no markup; all of it is left out.
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title".split())
#: Elements that are never part of an article.
APART = RAW | frozenset(
    "head nav aside footer form menu dialog select button input label fieldset object embed svg math canvas audio video map".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What an opening tag closes: elements of the first set, unless one of the second lies between.
_LIST, _ROW = frozenset(("ul", "ol", "menu", "dl")), frozenset(("table",))
CLOSES = {
    "li": (frozenset(("li",)), _LIST), "dt": (frozenset(("dt", "dd")), _LIST), "dd": (frozenset(("dt", "dd")), _LIST),
    "td": (frozenset(("td", "th")), _ROW), "th": (frozenset(("td", "th")), _ROW), "tr": (frozenset(("tr", "td", "th")), _ROW),
    "thead": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th")), _ROW), "tbody": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th")), _ROW),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th")), _ROW), "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Elements within a line of text: they end no paragraph and no word.
WITHIN = INLINE | RAW | frozenset("button select input label object embed svg math canvas audio video map img source track".split())
#: Roles and words of classes and ids that mark a part as no article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login popup modal "
    "overlay share sharing social related recommended recommendations comment comments commentlist replies respond disqus pager pagination search "
    "toolbar widget copyright disclaimer skip".split()
)
#: Those that hold even if an article element lies within.
OTHERS = frozenset("related recommended recommendations comment comments commentlist replies respond disqus".split())
#: Elements nested deeper hold nothing: their text belongs to the last one that fits.
DEPTH = 512
_FOR_ARTICLE = frozenset(("article", "main"))
_BOXES = frozenset("ul ol dl div section table".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A longer value in quotes ends at the first >, so that a page of open quotes is not read over and over.
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]{0,65536}+"|'[^']{0,65536}+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _marked(name: str, attributes: str, in_article: bool) -> int:
    """2 if an element's attributes say that it is no part of an article, 1 if so unless it holds one, else 0."""
    mark = 0
    if not attributes or attributes.isspace():
        return mark
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(max(values, key=len)).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return 2
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if key in ("class", "id"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                named = {parts[0], parts[-1], word} & WORDS
                # "no-sidebar" and the like tell what is not there; an article's own header stays.
                if not named or parts[0] in ("no", "has", "with", "without") or (in_article and named <= {"header"}):
                    continue
                if named & OTHERS:
                    return 2
                if name not in _FOR_ARTICLE:
                    mark = 1
    return mark


class Page:
    """The elements of a page in page order, and its texts with the element that each stands in."""

    def __init__(self, source: str):
        self.names, self.parents, self.marks, self.in_article = ["html"], [0], [0], [False]
        #: (element, text), with None for the end of a line or block.
        self.pieces: list[tuple[int, str | None]] = []
        self.body = 0
        self._read(source)
        self._set_apart()

    def _text(self, node: int, text: str) -> None:
        self.pieces.append((node, html.unescape(text) if "&" in text else text))

    def _read(self, source: str) -> None:
        open_, at = [0], 0
        names, pieces = self.names, self.pieces
        n = len(source)
        while at < n:
            tag = _TAG.search(source, at)
            if tag is None:
                self._text(open_[-1], source[at:])
                break
            if tag.start() > at:
                self._text(open_[-1], source[at : tag.start()])
            at = tag.end()
            name = tag[2] or tag[5]
            if not name:
                continue
            name = name.lower()
            if name not in WITHIN:
                pieces.append((0, None))
            if tag[1] or tag[4]:
                self._close(open_, name)
                continue
            attributes = tag[3] if tag[3] is not None else tag[6]
            if name in ("html", "body"):
                if name == "body" and not self.body:
                    del open_[1:]
                    self.body = self._open(open_, name, attributes)
                continue
            self._imply(open_, name)
            if name in VOID:
                self._open(open_, name, attributes, False)
            elif name in RAW:
                end = _ENDS[name].search(source, at)
                at = n if end is None else end.start()
            else:
                self._open(open_, name, attributes, not (name in ("svg", "math") and attributes.endswith("/")))

    def _open(self, open_: list[int], name: str, attributes: str, holds: bool = True) -> int:
        in_article = self.in_article[open_[-1]] or name in _FOR_ARTICLE
        never = name in APART or (name == "header" and not in_article)
        self.names.append(name)
        self.parents.append(open_[-1])
        self.in_article.append(in_article)
        self.marks.append(2 if never else 0 if name in ("html", "body") else _marked(name, attributes, in_article))
        if holds and len(open_) < DEPTH:
            open_.append(len(self.names) - 1)
        return len(self.names) - 1

    def _imply(self, open_: list[int], name: str) -> None:
        """Closes what an opening tag ends."""
        if name in CLOSES:
            ended, walls = CLOSES[name]
            for k in range(len(open_) - 1, 0, -1):
                if self.names[open_[k]] in walls:
                    break
                if self.names[open_[k]] in ended:
                    # The outermost one: a row ends with its cells.
                    while k > 1 and self.names[open_[k - 1]] in ended:
                        k -= 1
                    del open_[k:]
                    break
        if self.names[open_[-1]] == "head" and name not in ("meta", "link", "base", "title", "style", "script"):
            open_.pop()
        if name not in WITHIN and name not in VOID:
            # A paragraph holds no blocks.
            for k in range(len(open_) - 1, 0, -1):
                if self.names[open_[k]] == "p":
                    del open_[k:]
                    break
                if self.names[open_[k]] not in INLINE:
                    break

    def _close(self, open_: list[int], name: str) -> None:
        for k in range(len(open_) - 1, 0, -1):
            own = self.names[open_[k]]
            if own == name and name != "body":
                del open_[k:]
                return
            # An inline tag's end closes no block, and a cell's content nothing outside of the cell.
            cell = own in ("td", "th", "caption") and name not in ("tr", "tbody", "thead", "tfoot", "table")
            if own in ("body", "table") or cell or (name in INLINE and own not in INLINE):
                return

    def _set_apart(self) -> None:
        """Which elements are taken off: marked ones with all below them."""
        n = len(self.names)
        sure = [False] * n
        for i in range(1, n):
            sure[i] = sure[self.parents[i]] or self.marks[i] == 2
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            holds[i] |= self.names[i] in _FOR_ARTICLE and not sure[i]
            holds[self.parents[i]] |= holds[i]
        self.apart = [False] * n
        for i in range(1, n):
            self.apart[i] = self.apart[self.parents[i]] or self.marks[i] == 2 or (self.marks[i] == 1 and not holds[i])

    def densities(self) -> None:
        """Counts, densities and sums of the elements, bottom up."""
        n = len(self.names)
        chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parents[i]] or self.names[i] == "a"
        for node, text in self.pieces:
            if text is not None:
                size = len(text.strip())
                chars[node] += size
                link_chars[node] += size * linked[node]
        whole = list(zip(chars, link_chars, strict=True))
        for i in range(n - 1, 0, -1):
            # The share of links is that of the whole body, its menus included.
            up = self.parents[i]
            whole[up] = (whole[up][0] + whole[i][0], whole[up][1] + whole[i][1])
            if self.apart[i]:
                continue
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (self.names[i] == "a")
        all_chars, all_links = whole[self.body]
        ratio = all_links / max(all_chars, 1)

        def density(i: int) -> float:
            c, t, lc, lt = chars[i], max(tags[i], 1), link_chars[i], link_tags[i]
            if not c:
                return 0.0
            base = math.log(max(1.0, c / max(c - lc, 1) * lc + ratio * c) + math.e)
            return c / t * math.log(max(c / max(lc, 1) * (t / max(lt, 1)), 1.0)) / math.log(base)

        self.chars, self.link_chars, self.link_tags = chars, link_chars, link_tags
        self.density = [0.0 if self.apart[i] else density(i) for i in range(n)]
        self.sums = [0.0] * n
        #: (largest sum within the subtree, its element); of equal ones the first in page order, so the outer one.
        self.best = [(0.0, -i) for i in range(n)]
        for i in range(n - 1, -1, -1):
            self.best[i] = max(self.best[i], (self.sums[i], -i))
            up = self.parents[i]
            if i and not self.apart[i]:
                self.sums[up] += self.density[i]
                self.best[up] = max(self.best[up], self.best[i])

    def content(self) -> set[int]:
        """Roots of the subtrees that are taken."""
        self.densities()
        top = -self.best[self.body][1]
        path = [top]
        while path[-1] not in (0, self.body):
            path.append(self.parents[path[-1]])
        n = len(self.names)
        below = [False] * n
        below[top] = True
        for i in range(top + 1, n):
            below[i] = below[self.parents[i]]
        for kind in ("article", "main"):
            around = [i for i in path if self.names[i] == kind]
            single = [i for i in range(n) if below[i] and self.names[i] == kind and not self.apart[i] and self.chars[i]]
            # Those within another one count as part of it.
            single = [i for i in single if not any(self.names[j] == kind for j in self._above(i) if below[j])]
            if around or len(single) == 1:
                return {(around or single)[0]}
        threshold, path = min(self.density[i] for i in path), set(path)
        taken, inside = {top}, [False] * n
        for i in range(self.body, n):
            inside[i] = i in taken or (i > 0 and inside[self.parents[i]])
            if not inside[i] and not self.apart[i] and self.density[i] >= threshold > 0 and i not in path:
                best = -self.best[i][1]
                taken.add(best if self.sums[best] > 0 else i)
                inside[i] = i in taken
        return taken

    def _above(self, i: int) -> Iterator[int]:
        while i:
            i = self.parents[i]
            yield i

    def text(self) -> str:
        taken = self.content()
        n = len(self.names)
        shown = [False] * n
        for i in range(n):
            up = i > 0 and shown[self.parents[i]]
            menu = up and self.names[i] in _BOXES and self.link_tags[i] >= 3 and self.link_chars[i] >= 0.9 * self.chars[i]
            shown[i] = (i in taken or up) and not self.apart[i] and not menu
        return " ".join("".join(" " if text is None else text for node, text in self.pieces if text is None or shown[node]).split())


def main_text(source: str | None) -> str:
    """The article of a page; empty if there is none."""
    return Page(source).text() if source and not source.isspace() else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(source) for source in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
