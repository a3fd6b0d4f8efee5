"""Main-text extraction from HTML by smoothed text-to-tag ratios.

The standard library's parser streams a page as events.  They form lines, one
for each block of text, with its characters and the tags met since the line
before; lines belong to regions, which are the page's ``article`` or ``main``
elements or, outside them, the containers directly around the text.  The ratios
of characters to tags are smoothed along the page with a Gaussian, ``article``
and ``main`` raise theirs by a prior, and the lines that may be content are split
in two by threshold clustering.  Regions that reach the upper cluster are content,
on every page.  A content region is kept whole, short lines included, except lines
inside elements that announce themselves as something else: menus, page headers,
footers, sidebars, notices, adverts, forms, reader comments, scripts, styles and
hidden elements.  A class or id announces that only by words that say nothing
else: ``cookie-notice`` does, ``notice-board`` does not.

Defined results: a null, empty or text-free page gives the empty text.  Markup
that never closes is closed by its container.  A page is parsed whole, whatever
its length or depth.  Regions with equal ratios are all kept or all left out.
Rows that repeat a page are extracted each; an empty table gives no rows; other
input columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import map_batches

#: Elements whose text never counts.
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title nav footer aside form button select textarea option label menu dialog".split())
#: Containers: they hold regions and close what is open inside them.
CONTAINERS = frozenset("html body main article section div header nav footer aside form ul ol dl table tbody thead tr td th blockquote figure fieldset details center menu dialog".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption summary hgroup legend".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
CONTENT = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert disclaimer sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs pager pagination footer masthead comment comments commentlist disqus replies share sharing social related recommended newsletter subscribe "
    "signup login popup modal overlay widget toolbar skip".split()
)
#: Words that may stand beside one of WORDS in a name.
BESIDE = frozenset(
    "area article bar block bottom box btn button buttons col column container content desktop entry fixed float floating form global group head header icon icons inline inner "
    "input item items large leaderboard left link links list main message mobile msg outer page panel policy post primary reader rectangle right row secondary section site "
    "skyscraper slot small sticky story text title top unit user wrap wrapper".split()
)
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
SIGMA, REACH = 1.5, 4
#: What an article or main element adds to its lines' logarithmic ratios.
PRIOR = 1.5
_KERNEL = [exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(REACH + 1)]


@lru_cache(maxsize=1 << 14)
def _says(name: str) -> bool:
    """Whether one class or id names something that is not content, and nothing else."""
    words = {w.lower() for w in SPLIT.split(name) if w}
    return not WORDS.isdisjoint(words) and words <= WORDS | BESIDE


def _announced(tag: str, attrs: list) -> bool:
    """Whether an element says by its attributes that it is not content."""
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name in ("class", "id"):
            if tag not in ("html", "body", "main") and any(map(_says, value.split())):
                return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "aria-hidden":
            if value.lower() == "true":
                return True
        elif name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, region, kept) lines from one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.named: set[int] = set()  # regions that are article or main
        self.stack: list[tuple[str, int, int]] = []  # tag, region around it, drops around it
        self.region = self.regions = self.drops = self.tags = 0
        self.inside = 0  # depth of article and main
        self.text: list[str] = []
        self.lost: list[str] = []  # text of dropped elements; what came before them waits in ``text``
        self.at = 0  # region of ``text``

    def flush(self) -> None:
        """End the line of dropped text inside dropped elements, else that of the block."""
        self._line(self.lost, self.region, False)
        if not self.drops:
            self._line(self.text, self.at, True)

    def _line(self, parts: list[str], region: int, keep: bool) -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                self.lines.append((text, self.tags, region, keep))
                self.tags = 0
            parts.clear()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self._add(data)

    def _add(self, data: str) -> None:
        if self.drops:
            self.lost.append(data)
            return
        if not self.text:
            self.at = self.region
        self.text.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self._add(" ")
            elif tag == "hr":
                self.flush()
            return
        block = tag in BLOCKS
        if block:
            self.flush()
        if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
            self._pop(len(self.stack) - 1)  # its end tag was left out
        drop = tag in DROPPED or (tag == "header" and not self.inside) or (bool(attrs) and _announced(tag, attrs))
        if not (drop or tag in CONTAINERS):
            return
        if tag == "main" and self.drops:
            self._pop(0)  # what was never closed ends where the main element begins
        self.stack.append((tag, self.region, self.drops))
        self.drops += drop
        if tag in CONTENT:
            self.inside += 1
            if self.inside == 1 and not self.drops:
                self.regions += 1
                self.region = self.regions
                self.named.add(self.region)
        elif tag in CONTAINERS and not self.inside:
            self.regions += 1
            self.region = self.regions

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            top = self.stack[k][0]
            if top == tag:
                self._pop(k)
                return
            if top in CONTAINERS and tag not in CONTAINERS:
                return

    def _pop(self, k: int) -> None:
        self._line(self.lost, self.region, False)
        if any(tag in BLOCKS for tag, _, drops in self.stack[k:] if not drops):
            self._line(self.text, self.at, True)  # a block around the text ends
        for tag, region, drops in reversed(self.stack[k:]):
            self.region, self.drops = region, drops
            self.inside -= tag in CONTENT
        del self.stack[k:]


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian average along the page, renormalised at its ends."""
    out, n = [], len(ratios)
    for i in range(n):
        total = weight = 0.0
        for j in range(max(0, i - REACH), min(n, i + REACH + 1)):
            w = _KERNEL[abs(i - j)]
            total, weight = total + w * ratios[j], weight + w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Midpoint of a two-means split of the values."""
    low, high = min(values), max(values)
    for _ in range(16):
        cut = (low + high) / 2
        above = [v for v in values if v >= cut]
        below = [v for v in values if v < cut]
        if not below:
            return cut
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The kept lines of the content regions, in page order, joined by newlines."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.drops = 0  # what never closed ends here
    page.flush()
    lines = page.lines
    if not any(keep for *_, keep in lines):
        return ""
    score = smoothed([log1p(len(t) / max(1, n)) for t, n, _, _ in lines])
    able = [(x + PRIOR * (r in page.named), r) for x, (_, _, r, keep) in zip(score, lines, strict=True) if keep]
    cut = threshold([x for x, _ in able])
    chosen = {r for x, r in able if x >= cut}
    return "\n".join(t for t, _, r, keep in lines if keep and r in chosen)


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py()) for x in batch.column("__html")]
        return pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    kinds = [df.schema[c].dataType.simpleString() for c in (page_id, url)]
    cols = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("__html"))
    return map_batches(cols, run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
