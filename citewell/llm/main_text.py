"""Main text of web pages: the contiguous stretch of words and tags with the largest sum of scores.

A page is read once into words and tags, each with its context: the nearest block element, whether it is a link, the
zone it lies in (menu, header, footer, sidebar, form, notice, advert, comments, sharing, other; by element, role, class
and id), and where it lies to the part that the page marks as its article (article, or else main). Words score
positive and tags negative at first; pages that mark exactly one article are the labelled pages, and their counts move
the scores: log odds of lying inside, smoothed towards the score of the wider context and that one towards the first
score. Words may fall below zero, tags never rise above it. Each labelled page also counts as if nothing were marked,
and that is what pages without a marked article are scored by. A whole zone scores as one tag, by its kind: adverts
are set into articles, menus stand around them; inside a marked article it scores nothing. One linear scan finds the
best stretch. It is widened to whole blocks, and zones inside it go; of a header in an article, headings stay.

Scale: no page leaves its task. Counting emits one number a context, and contexts come from fixed lists (below 2,000
in all), so the table of scores that every task gets has a fixed bound. All labelled pages count, without a sample.

Defined results: null and empty html give an empty text; a page without words outside of zones too, except that forms
are no zones where nothing else is left. A comment, script or tag that does not end takes the rest of the page, as in
browsers. Repeated rows give repeated rows; without labelled pages the first scores hold. Columns beside id, url and
html are not read.
"""

from __future__ import annotations

import html as H
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import exp, log
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import bounded_batches, table, text_blocks

#: Pseudo counts of a smoothed share, the smallest score, and the largest of a word and of a tag.
WEIGHT, LEAST, WORD_AT_MOST, TAG_AT_MOST = 20.0, -8.0, 2.0, -0.05
#: First scores: of a word; in a link; beside a marked article; of a tag of text, of structure, of a link, of any other.
WORD, LINKED, OUTSIDE, TEXT_TAG, STRUCTURE_TAG, LINK_TAG, OTHER_TAG = 1.0, 0.1, -2.0, -0.3, -1.0, -2.0, -3.25
#: What a zone scores as a whole.
ZONES = {"menu": -20.0, "header": -20.0, "footer": -20.0, "sidebar": -20.0, "comments": -20.0, "form": -8.0, "sharing": -4.0, "notice": -4.0, "advert": -4.0, "byline": -0.5, "other": -0.5}

#: Elements of HTML by their part in a page.
TEXT_TAGS = frozenset("p br b i em strong u s small mark sub sup span q cite code pre blockquote h1 h2 h3 h4 h5 h6 abbr time figure figcaption".split())
STRUCTURE_TAGS = frozenset("div section ul ol li dl dt dd table thead tbody tfoot tr td th caption hr center article main details summary address fieldset header footer nav aside form body html head".split())
BLOCKS = (STRUCTURE_TAGS | frozenset("p br pre blockquote h1 h2 h3 h4 h5 h6 figure figcaption title option legend".split()))
CLOSES_P = BLOCKS - frozenset("br td th tr tbody thead tfoot caption body html head title option legend summary".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ZONE_TAGS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form"} | dict.fromkeys("head noscript template object svg canvas select button textarea audio video dialog script style title xmp iframe noembed noframes label".split(), "other")
ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "alertdialog": "notice"}
#: Words of class and id names that tell a zone.
HINTS = {
    word: zone
    for zone, words in {
        "advert": "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox banner promo promos promotion sponsor sponsored sponsors",
        "menu": "nav navbar navigation topnav sidenav navlinks menu menus sidemenu menubar breadcrumb breadcrumbs pagination pager toolbar skip skiplink",
        "header": "header masthead topbar",
        "footer": "footer colophon copyright",
        "sidebar": "sidebar sidebars aside rail widget widgets",
        "form": "form newsletter subscribe subscription signup signin login search register",
        "notice": "cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay paywall",
        "comments": "comment comments commentlist disqus discussion replies reply respond",
        "sharing": "share sharing social related recommended recommendations trending",
    }.items()
    for word in words.split()
}
#: What may follow a hint in a name, and what turns it round in front of it.
NOUNS = frozenset("box list container wrapper wrap area section block slot unit bar panel links link item items form inner outer row text posts articles stories reading story post article content body group buttons icons tags thread message top bottom left right main".split())
TURNED = frozenset("has no with without is not hide hides".split())

_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""")
_END = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>")
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PART = re.compile(r"[^a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Item(NamedTuple):
    """A tag, or the words between two tags: n words, in a block, with their context."""

    kind: str
    name: str
    zone: str
    linked: bool
    inside: int  # 2 in an article, 1 in main alone
    n: int
    block: int
    text: str


def hinted(names: str) -> str | None:
    """The zone that a class or id tells, if any."""
    for name in names.split():
        parts = [p for p in _PART.split(_CAMEL.sub("-", name).lower()) if p]
        parts = [p for p in parts if not p.isdigit()] or parts
        if not parts or parts[0] in TURNED:
            continue
        if parts[-1] == "header" and len(parts) > 1 and parts[0] in ("article", "post", "entry", "content", "story", "section"):
            continue
        if parts[-1] in HINTS:
            return HINTS[parts[-1]]
        if parts[0] in HINTS and all(p in NOUNS for p in parts[1:]):
            return HINTS[parts[0]]
    return None


def _described(name: str, attributes: str) -> tuple[str | None, int]:
    """(zone, whether it marks the article: 2, or the main part: 1) by element, class, id, role and itemprop."""
    zone, marks = None, {"article": 2, "main": 1}.get(name, 0)
    for key, a, b, c in _NAMED.findall(attributes):
        key, value = key.lower(), H.unescape(a or b or c)
        if key == "role":
            value = value.strip().lower()
            zone, marks = ROLES.get(value, zone), max(marks, {"article": 2, "main": 1}.get(value, 0))
        elif key == "itemprop":
            marks = max(marks, 2 * (value.strip().lower() == "articlebody"))
        else:
            zone = zone or hinted(value)
    return zone, marks


class _Reader:
    def __init__(self, forms: bool):
        self.forms, self.items = forms, []
        self.stack: list[tuple] = []  # (name, zone, linked, inside, block element)
        self.open: Counter = Counter()
        self.block, self.parts, self.marks = 0, [], [0, 0, 0]

    def _top(self) -> tuple:
        return self.stack[-1] if self.stack else ("", "", False, 0, "")

    def text(self) -> None:
        if self.parts:
            text = H.unescape("".join(self.parts))
            self.parts = []
            n = len(text.split())
            _, zone, linked, inside, element = self._top()
            self.items.append(Item("word", element, zone, linked, inside, n, self.block, text))

    def _tag(self, name: str, zone: str) -> None:
        _, _, linked, inside, _ = self._top()
        known = name if name in TEXT_TAGS or name in STRUCTURE_TAGS or name == "a" else "?"
        self.items.append(Item("tag", known, zone, linked, inside, 1, self.block, ""))

    def _pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def start(self, name: str, attributes: str) -> None:
        self.text()
        if name in CLOSES_P and self.open["p"]:
            self._close("p")
        if name == "li" and self.open["li"]:
            for frame in reversed(self.stack):
                if frame[0] in ("ul", "ol", "menu"):
                    break
                if frame[0] == "li":
                    self._close("li")
                    break
        if name in BLOCKS:
            self.block += 1
        _, zone, linked, inside, element = self._top()
        if name in VOID:
            self._tag(name, zone)
            return
        told, marks = _described(name, attributes)
        own = ZONE_TAGS.get(name) or told
        if name in ("html", "body", "main") or marks > inside or own == "form" and not self.forms:
            own = None
        if own == "header" and inside:
            own = "byline"
        if marks > inside and zone in ("", "form"):
            self.marks[marks] += 1
            zone, inside_now = "", marks
        else:
            inside_now = inside
        zone = "" if zone == "byline" and name in HEADINGS else zone or own or ""
        self._tag(name, zone)  # a zone's own tags belong to it
        self.stack.append((name, zone, linked or name == "a", inside_now, name if name in BLOCKS else element))
        self.open[name] += 1

    def _close(self, name: str) -> None:
        while self.stack:
            closing = self.stack[-1][0]
            self._pop()
            if closing == name:
                break

    def end(self, name: str) -> None:
        self.text()
        zone = self._top()[1]
        if self.open[name]:
            self._close(name)
        if name in BLOCKS:
            self.block += 1
        self._tag(name, zone)


def read(page: str, forms: bool = True) -> tuple[list[Item], int, int]:
    """The words and tags of a page in order; the level of its mark (2 article, 1 main, 0 none) and how many it has."""
    to, at, n = _Reader(forms), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            to.parts.append(page[at:])
            break
        if lt > at:
            to.parts.append(page[at:lt])
        following = page[lt + 1 : lt + 2]
        if following.isascii() and following.isalpha():
            m = _TAG.match(page, lt)
            if not m:  # a tag that does not end
                break
            name = m[1].lower()
            to.start(name, m[2])
            at = m.end()
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                at = end.start() if end else n
        elif following == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha():
            m = _END.match(page, lt)
            if not m:
                break
            to.end(m[1].lower())
            at = m.end()
        elif following in ("!", "?", "/") and following:
            end = page.find("-->", lt + 2) + 2 if page.startswith("<!--", lt) and page.find("-->", lt + 2) >= 0 else -1 if page.startswith("<!--", lt) else page.find(">", lt)
            if end < 0:
                break
            at = end + 1
        else:
            to.parts.append("<")
            at = lt + 1
    to.text()
    level = 2 if to.marks[2] else 1 if to.marks[1] else 0
    return to.items, level, to.marks[level]


def _key(item: Item, mark: str) -> tuple:
    return item.kind, item.name, item.linked, mark


def counted(page: str) -> Counter:
    """(context, inside or not) -> number, of what lies in no zone of a page that marks one article; else empty."""
    items, level, marks = read(page)
    out: Counter = Counter()
    if marks == 1:
        for x in items:
            if x.n and not x.zone:
                label = x.inside >= level
                out[*_key(x, "in" if label else "out"), label] += x.n
                out[*_key(x, "none"), label] += x.n
    return out


def _first(kind: str, name: str, linked: bool, mark: str) -> float:
    if kind == "word":
        return OUTSIDE if mark == "out" else LINKED if linked else WORD
    return TEXT_TAG if name in TEXT_TAGS else STRUCTURE_TAG if name in STRUCTURE_TAGS else LINK_TAG if name == "a" else OTHER_TAG


class Scores:
    """The score of a word or tag by its context, from counts (context, inside or not) -> number."""

    def __init__(self, counts: dict):
        self.own, self.wider, self.known = Counter(), Counter(), {}
        for (kind, name, linked, mark, label), n in counts.items():
            self.own[kind, name, linked, mark, label] += n
            self.wider[kind, linked, mark, label] += n

    @staticmethod
    def _share(n_in: float, n_out: float, share: float) -> float:
        return (n_in + WEIGHT * share) / (n_in + n_out + WEIGHT)

    def of(self, key: tuple) -> float:
        if key not in self.known:
            kind, name, linked, mark = key
            share = 1 / (1 + exp(-_first(kind, name, linked, mark)))
            if kind == "word" or mark != "none":  # nothing marked: a tag that was not seen keeps its first score
                share = self._share(self.wider[kind, linked, mark, True], self.wider[kind, linked, mark, False], share)
            share = self._share(self.own[*key, True], self.own[*key, False], share)
            most = TAG_AT_MOST if kind == "tag" else WORD_AT_MOST
            self.known[key] = max(LEAST, min(most, log(max(share, 1e-9) / max(1 - share, 1e-9))))
        return self.known[key]


def scored(items: list[Item], level: int, scores: Scores) -> list[float]:
    """The score of each item: a zone's on its first item."""
    out, zone = [], ""
    for x in items:
        mark = "none" if not level else "in" if x.inside >= level else "out"
        if x.zone:
            out.append(ZONES[x.zone] if x.zone != zone and mark != "in" else 0.0)
        else:
            out.append(scores.of(_key(x, mark)) * x.n)
        zone = x.zone
    return out


def best_stretch(scores: list[float]) -> tuple[int, int] | None:
    """[first, last] of the stretch with the largest positive sum, the earliest of equal ones; None without one."""
    best, found, total, start = 0.0, None, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i)
    return found


def main_text(page: str | None, scores: Scores) -> str:
    """The main text of a page: words of a block divided by one space, and so are blocks."""
    items, level, _ = read(page or "")
    if not any(x.kind == "word" and x.n and not x.zone for x in items):
        items, level, _ = read(page or "", forms=False)
    found = best_stretch(scored(items, level, scores))
    if not found:
        return ""
    first, last = found
    while first and items[first - 1].block == items[first].block:
        first -= 1
    while last + 1 < len(items) and items[last + 1].block == items[last].block:
        last += 1
    blocks: list[str] = []
    at = None
    for x in items[first : last + 1]:
        if x.kind == "word" and not x.zone:
            if x.block != at:
                blocks.append("")
                at = x.block
            blocks[-1] += x.text
    return " ".join(" ".join(blocks).split())


def _counts(batches) -> Iterator:
    import pyarrow as pa

    names = ["kind", "name", "linked", "mark", "label", "n"]
    out: Counter = Counter()
    for batch in batches:
        for _, pages in text_blocks(batch.column(0)):
            for page in pages:
                out.update(counted(page))
    rows = [(*k, n) for k, n in out.items()]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def fit(pages: DataFrame, html: str = "html") -> Scores:
    """Scores from all pages that mark their article."""
    bounded_batches(pages.sparkSession)
    found = pages.select(F.col(html).cast("string")).mapInArrow(_counts, "kind string, name string, linked boolean, mark string, label boolean, n long")
    found = found.groupBy("kind", "name", "linked", "mark", "label").agg(F.sum("n").alias("n"))
    return Scores({tuple(r[:5]): r[5] for r in found.collect()})  # at most a row a context


def _texts(batches, scores: Scores) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for lo, pages in text_blocks(batch.column(2)):
            texts = [main_text(p, scores) for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), batch.column(1).slice(lo, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, scores: Scores | None = None, page_id="page_id", url="url", html="html") -> DataFrame:
    """page_id, url, text, n_chars of every page; scores are fitted on the same pages if none are given."""
    scores = scores or fit(pages, html)
    rows = pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    return rows.mapInArrow(partial(_texts, scores=scores), "page_id long, url string, text string, n_chars long")


def op11(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
