"""Main text of HTML pages.

The standard library's parser is fed once and its events build lines: one per block element, with its text, the tags
met in it and the characters inside links. Each line's text-to-tag ratio is smoothed with a Gaussian over the page's
lines, two-means clustering of the smoothed ratios gives the threshold, and lines above it are content. The region is
the lowest container that holds every content line, every h1 and every article and main element outside chrome, so
several articles, a main beside an article, and sections of any size stay together. All lines of the region are text, in
page order, but for those under chrome: menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

Chrome is known by element, by role, or by a class or id all of whose words say so (``cookie-bar``, but neither
``with-sidebar`` nor ``share-price``); a heading is never chrome by its class. An element that holds an article or main
is no chrome, nor, on a page without either, one that holds half of the page's text, comments excepted. Of a header
inside an article or main the headings stay. Outside article and main, link-only lines of a list or container that is
links throughout are a menu.

Parsing is linear: end tags find their element by counts of open tags, and sums over containers take one pass.

Defined results: null or empty html gives an empty text; unclosed, stray or cut tags never fail; repeated rows stay;
an empty table gives no rows; extract() passes further columns on and refuses an input with a column ``main_text``.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements by what they do, and the words that mark chrome.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center details div dl main ol section table tbody td tr ul".split())
UNSEEN = frozenset("canvas head iframe input noscript object script select style svg template textarea title".split())
CHROME = frozenset("aside button dialog footer form frameset header menu nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SAME_CLOSES = frozenset("li dt dd tr td th option p".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SAYS_CHROME = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promos promoted related share sharing sidebar sidenav signup social sponsor sponsored subscribe toc widget widgets".split())
SAYS_COMMENTS = frozenset("comment comments disqus replies respond".split())
NEUTRAL = frozenset("area bar block bottom box buttons column container content fixed form global group inner item items left links list main page panel right section site thread top wrap wrapper".split())
CHROME_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
NAME = re.compile(r"[^\W\d_]+|\d+(?:x\d+)?")
SIGMA = 1.0
PLAIN, SOFT, COMMENTS = range(3)


def marked(attrs: list) -> int:
    """What class, id and role say of an element."""
    for name, value in attrs:
        if not value:
            continue
        if name == "role" and value.lower() in CHROME_ROLE:
            return SOFT
        if name in ("class", "id"):
            for token in value.lower().split():
                words = [w for w in NAME.findall(token) if not w[0].isdigit()]
                own = [w for w in words if w not in NEUTRAL]
                if own and all(w in SAYS_COMMENTS or w in SAYS_CHROME for w in own):
                    return COMMENTS if any(w in SAYS_COMMENTS for w in own) else SOFT
    return PLAIN


class Lines(HTMLParser):
    """Builds lines and the tree of containers from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, container outside, unseen
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack
        self.bounds: list[int] = []  # places of containers and chrome
        self.parents, self.kinds, self.marks = [-1], [""], [PLAIN]
        self.at, self.unseen = 0, 0
        self.parts: list[str] = []
        self.tags, self.linked = 0, 0
        self.lines: list[tuple[str, int, int, int, str]] = []  # text, tags, characters in links, container, block

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            block = "h1" if self.open["h1"] else "p" if self.open["p"] and self.open["p"][-1] >= (self.bounds or [0])[-1] else next((h for h in HEADINGS if self.open[h]), "")
            self.lines.append((text, self.tags, self.linked, self.at, block))
            self.tags = self.linked = 0
        self.parts = []

    def _pop(self, upto: int) -> None:
        while len(self.stack) > upto:
            tag, container, unseen = self.stack[-1]
            if tag in BLOCKS and not self.unseen:
                self.flush()
            self.stack.pop()
            self.open[tag].pop()
            if self.bounds and self.bounds[-1] == len(self.stack):
                self.bounds.pop()
            self.at = container
            self.unseen -= unseen

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open["head"] and tag not in IN_HEAD and tag not in ("head", "html"):
            self._pop(self.open["head"][-1])
        if not self.unseen:
            self.tags += 1
        if tag in BLOCKS:
            bound = self.bounds[-1] if self.bounds else -1
            for name in ("p", tag) if tag in SAME_CLOSES else ("p",):
                if self.open[name] and self.open[name][-1] >= bound:
                    self._pop(self.open[name][-1])
            if not self.unseen:
                self.flush()
        if tag in VOID:
            if tag == "br" and not self.unseen:
                self.parts.append(" ")
            return
        unseen = tag in UNSEEN or (tag in BLOCKS and tag not in ("html", "body") and any(n == "hidden" or (n == "aria-hidden" and v == "true") for n, v in attrs))
        mark = PLAIN
        if tag not in ("html", "body", "article", "main", "a") and tag not in HEADINGS:
            mark = marked(attrs) or (SOFT if tag in CHROME else PLAIN)
        self.open[tag].append(len(self.stack))
        if tag in CONTAINERS or mark:
            self.bounds.append(len(self.stack))
        self.stack.append((tag, self.at, unseen))
        self.unseen += unseen
        if tag in CONTAINERS or mark:
            if mark and tag not in BLOCKS and not self.unseen:
                self.flush()
            self.parents.append(self.at)
            self.kinds.append(tag)
            self.marks.append(mark)
            self.at = len(self.parents) - 1

    def handle_endtag(self, tag: str) -> None:
        if not self.unseen:
            self.tags += 1
        places = self.open[tag]
        if not places or (tag not in BLOCKS and self.bounds and self.bounds[-1] > places[-1]):
            return  # stray, or an inline tag that would close a container
        if self.at and self.bounds and self.bounds[-1] == places[-1] and tag not in BLOCKS and not self.unseen:
            self.flush()
        self._pop(places[-1])

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass


def smoothed(ratios: list[float]) -> list[float]:
    reach = math.ceil(3 * SIGMA)
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - reach), min(len(ratios), i + reach + 1)
        w = weights[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(w, ratios[lo:hi], strict=True)) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """Midway between the means of two clusters; all lines are content where the clusters don't differ."""
    lo, hi = min(values), max(values)
    cut = lo
    for _ in range(20):
        mid = (lo + hi) / 2
        below, above = [v for v in values if v < mid], [v for v in values if v >= mid]
        if not below or not above:
            return cut
        new = sum(below) / len(below), sum(above) / len(above)
        cut = sum(new) / 2
        if new == (lo, hi):
            break
        lo, hi = new
    return cut


def _summed(values: list[int], parents: list[int]) -> list[int]:
    """Sums over containers and all inside them; a container comes after the one around it."""
    out = list(values)
    for i in range(len(parents) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    parents, kinds, marks, lines = parser.parents, parser.kinds, parser.marks, parser.lines
    if not lines:
        return ""
    places = range(len(parents))
    size, links, named, titled = ([0] * len(parents) for _ in range(4))
    for text, _, linked, at, block in lines:
        size[at] += len(text.replace(" ", ""))
        links[at] += linked
        titled[at] += block == "h1"
    for i in places:
        named[i] = int(kinds[i] in ("article", "main") and marks[i] == PLAIN)
    size, links, named, titled = (_summed(x, parents) for x in (size, links, named, titled))
    stated, chrome, header = [False] * len(parents), [False] * len(parents), [False] * len(parents)
    for i in places:
        around = parents[i]
        own = marks[i] != PLAIN and not named[i]
        if own and not named[0] and marks[i] == SOFT and (2 * size[i] >= size[0] or (kinds[i] == "form" and titled[i])):
            own = False
        stated[i] = kinds[i] in ("article", "main") or (around >= 0 and stated[around])
        inner = around >= 0 and chrome[around]
        header[i] = (own and kinds[i] == "header" and stated[i] and not inner) or (around >= 0 and header[around] and not own)
        chrome[i] = own or inner
    lines = [x for x in lines if not chrome[x[3]] or (header[x[3]] and x[4] in HEADINGS)]
    if not lines:
        return ""
    values = smoothed([len(text) / max(1, tags) for text, tags, *_ in lines])
    cut = threshold(values)
    menu = [10 * links[i] >= 9 * size[i] for i in places]
    mine = [stated[at] or bool(block) or not menu[at] or 10 * linked < 9 * len(text.replace(" ", "")) for text, _, linked, at, block in lines]
    held = [0] * len(parents)
    for (_, _, _, at, block), v, own in zip(lines, values, mine, strict=True):
        held[at] += own and (v >= cut or block == "h1" or stated[at])
    held = _summed(held, parents)
    root = max(i for i, n in enumerate(held) if n == held[0]) if held[0] else 0
    inside = [False] * len(parents)
    for i, p in enumerate(parents):
        inside[i] = i == root or (p >= 0 and inside[p])
    return "\n".join(text for (text, _, _, at, _), own in zip(lines, mine, strict=True) if inside[at] and own)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``main_text``."""
    if "main_text" in df.columns:
        raise ValueError("the input already has a column main_text")
    schema = T.StructType([*df.schema.fields, T.StructField("main_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) if x.is_valid else "" for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "main_text"])

    return df.mapInArrow(run, schema)
