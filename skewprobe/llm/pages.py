"""The main text of web pages by two passes of block rules.

A page is cut into blocks at block elements. The first pass decides blocks by the share of
stop words, by length and by the share of linked text: running text has many stop words and few links, menus
and lists of references the reverse. Short blocks, and long ones with few stop words, stay
ambiguous. The second pass gives those the label of the nearest decided neighbour.

Markup decides beforehand what it names: navigation, headers, footers, asides, forms,
scripts, and elements whose class, id or role says advert, notice, comments and the like are
never text. Inside an article the borders of the article are the decided neighbours, so its short
blocks and odd paragraphs stay; what stands outside of it goes. Pages without an article or main element are
left to the two passes alone.

Pages are read alone, in one map without a shuffle, in time linear in their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skewprobe.llm.common import replaced

#: Shorter blocks are ambiguous; longer ones are text on less evidence. In code points.
SHORT, LONG = 70, 200
#: Least share of stop words of running text, and of a short block between text and links.
STOPS, SOME_STOPS = 0.25, 0.15
#: Largest share of linked text in running text.
LINKS = 0.4
RESULT = "text string, n_chars long, n_blocks long, n_kept long"

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he his i in is it not of on or she that the their they this to
    was we were which will with you
    aber als am auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für hat ich im ist mit
    nach nicht noch oder sich sie sind so um und von vor war wie wird zu zum zur über
    au aux avec ce ces cette dans de du elle en est et été il ils la le les leur mais ne nous ou où par pas plus pour
    qu que qui sa se ses son sur un une vous à
    al como con cuando del ella entre era esta este fue ha hay las lo los más me muy no o para pero por porque sin
    sobre su sus también una y ya
    """.split()
)
# Elements. Those that begin a new block, those whose text is never shown as text, those
# that frame the main text.
BLOCKS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol
    optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul
    """.split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
RAW = frozenset(("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "svg"))
CHROME = frozenset(
    "aside button dialog footer form head header menu nav noscript optgroup option search select template".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An open element of the first kind ends when one of the second begins.
ENDED_BY = {
    "p": BLOCKS,
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot", "thead")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot", "thead")),
    "tr": frozenset(("tr", "tbody", "tfoot", "thead")),
    "option": frozenset(("option", "optgroup")),
    **{h: HEADINGS for h in HEADINGS},
}
# Words of class, id and role. The first may also name a mere part of the layout around the text.
LAYOUT_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertising adsbygoogle alert alertdialog banner breadcrumb breadcrumbs
    consent contentinfo cookie cookies copyright dialog disclaimer footer gdpr header login masthead menu modal nav
    navbar navigation newsletter notice notices notification overlay pagination pager paywall popup promo promotion
    search signup skip sponsor sponsored subscribe subscription toolbar topbar
    """.split()
)
OTHER_WORDS = frozenset(
    """
    aside comment commentlist comments complementary discussion disqus recommendations recommended related replies
    reply respond share sharebar sharing sidebar social teaser teasers widget widgets
    """.split()
)
INLINE_WORDS = frozenset("ad ads advert advertisement adsbygoogle sponsored".split())
MAIN_NAMES = frozenset(("main", "content", "main-content", "maincontent", "page-content"))
ARTICLE_NAMES = frozenset(
    ("article", "article-body", "article-content", "articlebody", "entry-content", "post-body", "post-content", "story-body")
)
NOT_HERE = frozenset(("has", "no", "with", "without", "is", "not"))

TAG = re.compile(
    r"</?([a-zA-Z][^\s/>]*+)"
    r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+)>"
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NAME_WORD = re.compile(r"[a-z]+")
LETTERS = re.compile(r"[^\W\d_]+")
ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
TOO_LARGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass(slots=True)
class Block:
    text: str
    links: int  # code points of linked text
    tag: str
    place: int


@dataclass(slots=True)
class Place:
    """An open element."""

    name: str
    parent: int
    chrome: bool = False
    layout: bool = False  # chrome by a word that may also name a frame around the text
    inside: str = ""  # "article" or "main"


def decoded(text: str) -> str:
    """Character references decoded; impossible numbers become the replacement character."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = TOO_LARGE.sub("�", ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _named(attributes: dict[str, str]) -> tuple[list[str], set[str]]:
    """The names of class, id and role, and the words in them that stand for themselves."""
    given = " ".join(decoded(attributes[k]) for k in ("class", "id", "role") if k in attributes)
    names, words = [], set()
    for name in given.split():
        mine = NAME_WORD.findall(CAMEL.sub("-", name).lower())
        names.append(name.lower())
        if not NOT_HERE.intersection(mine):
            words.update(mine)
    return names, words


class Page:
    """The blocks of a page with the elements around them."""

    def __init__(self, text: str):
        self.blocks: list[Block] = []
        self.places = [Place("", -1)]
        self.open = [0]
        self.counts: Counter[str] = Counter()
        self.parts: list[str] = []
        self.links, self.link_depth = 0, 0
        self.framed = False
        self._read(text)
        self._flush()

    def _read(self, text: str) -> None:
        at = 0
        while (lt := text.find("<", at)) >= 0:
            if tag := TAG.match(text, lt):
                self._text(text[at:lt])
                at = tag.end()
                name = tag[1].lower()
                if text[lt + 1] == "/":
                    self._end(name)
                    continue
                if name in RAW and not (name == "svg" and tag[2].endswith("/")):
                    end = RAW_END[name].search(text, at)
                    if end is None:
                        return
                    at = end.start()
                    continue
                self._start(name, tag[2])
            elif text.startswith("<!--", lt):
                self._text(text[at:lt])
                at = text.find("-->", lt + 2) + 3
                if at < 3:
                    return
            elif text[lt + 1 : lt + 2] in ("!", "?", "/") or text[lt + 1 : lt + 2].isalpha() and text[lt + 1].isascii():
                # A declaration, or a tag that never ends.
                self._text(text[at:lt])
                at = text.find(">", lt) + 1
                if at < 1:
                    return
            else:
                self._text(text[at : lt + 1])
                at = lt + 1
        self._text(text[at:])

    def _text(self, text: str) -> None:
        if text:
            text = decoded(text)
            self.parts.append(text)
            if self.link_depth:
                self.links += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1]
            self.blocks.append(Block(text, self.links, self.places[top].name, top))
        self.parts, self.links = [], 0

    def _start(self, name: str, given: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name == "a":
            self.link_depth = len(self.open) if "href" in given.lower() else 0
        if name in BLOCKS:
            self._flush()
            while len(self.open) > 1 and name in ENDED_BY.get(self.places[self.open[-1]].name, ()):
                self._pop()
            if name in VOID:
                return
        attributes = _attributes(given) if given and not given.isspace() else {}
        if name not in BLOCKS and not (name in ("span", "ins", "a") and "class" in attributes):
            return
        names, words = _named(attributes)
        place = Place(name, self.open[-1])
        if name not in BLOCKS:
            if not INLINE_WORDS & words:
                return
            self._flush()
            place.chrome = True
        elif name in ("html", "body"):
            pass
        else:
            self._judge(place, attributes, names, words)
        self.places.append(place)
        self.open.append(len(self.places) - 1)
        self.counts[name] += 1

    def _judge(self, place: Place, attributes: dict[str, str], names: list[str], words: set[str]) -> None:
        name = place.name
        if name == "article" or ARTICLE_NAMES.intersection(names) or attributes.get("itemprop") == "articleBody":
            place.inside = "article"
        elif name == "main" or "main" in names or attributes.get("id", "").lower() in MAIN_NAMES:
            place.inside = "main"
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", ""))
        layout = bool(LAYOUT_WORDS & words) and not (place.inside and not OTHER_WORDS & words)
        place.chrome = bool(name in CHROME or hidden or OTHER_WORDS & words or layout)
        place.layout = bool(place.chrome and not OTHER_WORDS & words and not hidden and (layout or name == "form"))
        if place.inside and not place.chrome and not self.framed:
            # The first frame of text: what merely lays out the page around it is no chrome.
            self.framed = True
            for i in self.open:
                if self.places[i].layout and (self.places[i].name not in CHROME or self.places[i].name == "form"):
                    self.places[i].chrome = False

    def _end(self, name: str) -> None:
        if name == "a":
            self.link_depth = 0
            if not self.counts["a"]:
                return
        if name in BLOCKS:
            self._flush()
            if name in ("p", "li"):
                self.link_depth = 0
        if self.counts[name]:
            self._flush()
            while self._pop() != name:
                pass

    def _pop(self) -> str:
        name = self.places[self.open.pop()].name
        self.counts[name] -= 1
        if len(self.open) < self.link_depth:
            self.link_depth = 0
        return name


def _frames(page: Page) -> tuple[list[bool], list[str]]:
    """For each place whether it is chrome, and in what frame it stands."""
    chrome, inside = [False], [""]
    for place in page.places[1:]:
        # A heading in the header of an article is its title.
        above = place.parent
        title = place.name in HEADINGS and not place.chrome and _title(page, above)
        chrome.append(place.chrome or chrome[above] and not title)
        inside.append("article" if "article" in (place.inside, inside[above]) else place.inside or inside[above])
    return chrome, inside


def _title(page: Page, place: int) -> bool:
    """Whether the place is a header right inside of an article."""
    if page.places[place].name == "hgroup":
        place = page.places[place].parent
    found = page.places[place]
    return found.name == "header" and found.parent > 0 and page.places[found.parent].inside == "article" and not page.places[found.parent].chrome


def stop_share(text: str, stop_words: frozenset[str] = STOP_WORDS) -> float:
    words = LETTERS.findall(text.lower())
    return sum(w in stop_words for w in words) / len(words) if words else 0.0


GOOD, BAD, UNSURE = "good", "bad", "unsure"


def labels(page: Page, stop_words: frozenset[str] = STOP_WORDS) -> list[str]:
    """For each block of the page whether it is main text: ``good`` or ``bad``."""
    chrome, inside = _frames(page)
    frames = {inside[b.place] for b in page.blocks if not chrome[b.place]}
    out, shares = [], []
    for block in page.blocks:
        frame = inside[block.place]
        size = len(block.text)
        linked = block.links > LINKS * size
        share = 0.0
        if chrome[block.place] or (not frame and frames & {"article", "main"}):
            label = ""  # decided by markup, and no neighbour to anyone
        elif block.tag in HEADINGS and frame == "article":
            label = UNSURE
        elif linked and (size < SHORT or block.tag not in ("p", "blockquote", "pre")):
            label = BAD
        else:
            share = stop_share(block.text, stop_words)
            if size < SHORT:
                label = UNSURE
            elif linked:
                label = BAD if share < STOPS else UNSURE
            elif share >= STOPS or size >= LONG and share >= SOME_STOPS:
                label = GOOD
            else:
                label = UNSURE if frame or size >= LONG else BAD
        out.append(label)
        shares.append(share)
    if GOOD not in out:
        # No running text in a known language: long blocks are the best evidence.
        out = [GOOD if x == UNSURE and len(b.text) >= LONG else x for x, b in zip(out, page.blocks, strict=True)]
    return _inherited(page.blocks, out, shares, [inside[b.place] for b in page.blocks])


def _inherited(blocks: list[Block], found: list[str], shares: list[float], frames: list[str]) -> list[str]:
    """The second pass: ambiguous blocks take the label of the nearest decided one.

    The borders of a page count as decided against, those of an article and of a main element for. In an article only text
    and the borders count, so every ambiguous block of it is text.
    """
    seen = [i for i, x in enumerate(found) if x]
    before, after = {}, {}
    for order, near in ((seen, before), (seen[::-1], after)):
        label, apart = "", 0
        frame = None
        for i in order:
            apart += 1
            if frames[i] != frame:
                frame, label, apart = frames[i], GOOD if frames[i] else BAD, 1
            near[i] = (apart, label)
            if found[i] != UNSURE:
                label, apart = found[i], 0
    out = []
    for i, (block, label) in enumerate(zip(blocks, found, strict=True)):
        if label == UNSURE:
            (back, left), (ahead, right) = before[i], after[i]
            if frames[i] == "article" or left == right:
                label = GOOD if frames[i] == "article" else left
            elif block.tag in HEADINGS:
                label = right  # a heading goes with what follows it
            elif back != ahead:
                label = left if back < ahead else right
            else:
                label = GOOD if shares[i] >= SOME_STOPS else BAD
        out.append(GOOD if label == GOOD else BAD)
    return out


def extract(text: str, stop_words: frozenset[str] = STOP_WORDS) -> tuple[str, int, int]:
    """The main text of a page, the number of its blocks and of those kept."""
    page = Page(text)
    kept = [b.text for b, x in zip(page.blocks, labels(page, stop_words), strict=True) if x == GOOD]
    return " ".join(kept), len(page.blocks), len(kept)


def main_text(pages: DataFrame, column: str = "html", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """``pages`` with ``text``, ``n_chars`` (its code points), ``n_blocks`` and ``n_kept``.

    Character references are decoded, white space in a block becomes one blank, blocks are joined by one in the order
    of the page. A null or empty page has the empty text. Comments, tags that never end and scripts
    that never end reach to the end of the page, as in a browser. Every row is read alone: repeated rows give
    repeated results, ids are not read, columns named like the result are replaced, an empty table gives an empty one.
    """

    @pandas_udf(RESULT)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(text or "", stop_words) for text in batch]
            yield pd.DataFrame(
                [(text, len(text), blocks, kept) for text, blocks, kept in found],
                columns=["text", "n_chars", "n_blocks", "n_kept"],
            )

    rows = pages.withColumn("__read", read(F.col(f"`{column}`")))
    names = ("text", "n_chars", "n_blocks", "n_kept")
    return replaced(rows, {c: F.col(f"__read.{c}") for c in names}).drop("__read")
