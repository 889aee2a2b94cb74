"""HTML extraction by line-block distribution.

Markup is stripped to lines, one per block of the page.  Elements that are not
article text (menus, headers, footers, sidebars, adverts, notices, forms, reader
comments, by element name or by the words of class, id and role) become gaps of
empty lines, but for those between two lines of one parent.  The lengths of a few
lines in a row are summed; text begins where the sum surges and ends where it
dives to nothing, and what stands between is kept.  The short lines before a surge belong
to it as far as they have the parent of its first line, so that a heading or a short first
paragraph is not lost.

Element names weigh the lines.  Where the page names its article (an article or
main element), lines outside count as empty, all lines inside have it as their
parent, and a surge needs a fixed sum, so that a named element without one goes where
another has one.  Elsewhere lines that are mostly links count as empty, a surge also needs a share of
the page's highest sum, short lines of other parents do not begin a region unless they are headings,
and the regions that compare with the largest are kept.  If nothing is left, class words are ignored.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitaplate.llm import common as C

#: Lines whose lengths are summed.
WINDOW = 3
#: Least sum of a surge in characters, and where no article is named also as a share of the highest sum.
SURGE_CHARS = 60
SURGE_SHARE = 0.15
#: Shorter lines do not begin a region there unless they are headings.
SHORT_CHARS = 25
#: Regions of this share of the largest are kept too.
REGION_SHARE = 0.35
#: A line with more of its characters in links is a menu line (where no article is named).
LINK_SHARE = 0.6

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+|[0-9]+")

#: Elements that end a line, that hold no article text, and that have no end tag.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_NOISE = frozenset("aside button datalist dialog fieldset footer form head header input label menu nav select textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("article body div main section td".split())
_SPACES = frozenset("br td th img wbr hr".split())
#: Words of class, id and role that mark other content.
_NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice paywall popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())

#: Words that tell of a layout around such content, not of the content.
_LAYOUT_WORDS = frozenset("column columns has hide layout no show with without".split())


class Line(NamedTuple):
    """A line of a page; gaps are lines without text and parent."""

    text: str
    parent: int
    named: bool
    links: float
    heading: bool


_GAP = Line("", -1, False, 0.0, False)


def _is_noise(name: str, attributes: str, in_article: bool, by_words: bool) -> bool:
    if name in _NOISE:
        # an article's own header holds its title
        return not (name == "header" and in_article)
    if not by_words or not attributes or name in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    for values in _ATTR.findall(attributes):
        for token in "".join(values).lower().split():
            words = set(_PART.findall(token))
            if words & _NOISE_WORDS and not words & _LAYOUT_WORDS:
                return True
    return False


def lines_of(page: str, by_words: bool = True) -> list[Line]:
    """The lines of a page; other content leaves gaps (``by_words``: class, id and role tell it too)."""
    page = _DROP.sub(" ", page)
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    in_link = 0
    heading = False
    skip, depth = "", 0
    # open containers: (element name, number, number of the outermost named article or 0)
    above: list[tuple[str, int, int]] = [("", 0, 0)]
    number = 0

    def end_line(gap: int = 0):
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, own, article = above[-1]
            out.append(Line(text, article or own, article > 0, min(1.0, linked / len(text)), heading))
        out.extend([_GAP] * gap)
        parts.clear()
        linked = 0

    def leave(name: str):
        """Close the innermost container of that name; none but article, main and body closes a named article."""
        for k in range(len(above) - 1, 0, -1):
            if above[k][0] == name:
                del above[k:]
                return
            if above[k][0] in ("article", "main") and name not in ("article", "main", "body"):
                return

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if lt > at and not skip:
            parts.append(page[at:lt])
            linked += (lt - at) * (in_link > 0)
        if lt == len(page):
            break
        tag = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)
        if not tag:  # a lone "<" is text; an unfinished tag at the very end is not
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]) and page.find(">", lt) < 0:
                break
            if not skip:
                parts.append("<")
            at = lt + 1
            continue
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag.group(1)), tag.group(3) or ""
        if skip:
            if name == skip and name not in _VOID:
                depth += -1 if closing else 1
            ends = depth == 0 or name == "body" or (not closing and name in ("article", "main") and skip != "article")
            if skip in ("p", "li", "dt", "dd", "label", "option") and name in _BLOCKS and name != skip:
                ends = True
            if not ends:
                continue
            was, skip = skip, ""
            if name == was or closing:
                continue
        article = above[-1][2] > 0
        if not closing and name not in _VOID and _is_noise(name, attributes, article, by_words):
            end_line(WINDOW)
            skip, depth = name, 1
            continue
        if name in _BLOCKS:
            outer = name in ("article", "main")
            end_line(WINDOW if outer else 0)
            heading = name in _HEADINGS and not closing
            if name in _CONTAINERS and closing:
                leave(name)
            elif name in _CONTAINERS:
                number += 1
                above.append((name, number, above[-1][2] or (number if outer else 0)))
        elif name in _SPACES:
            parts.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
    end_line()
    return out


def _joined(lines: list[Line]) -> list[Line]:
    """``lines`` without the gaps between two lines of one parent."""
    out: list[Line] = []
    gap: list[Line] = []
    last = None
    for line in lines:
        if not line.text:
            gap.append(line)
            continue
        if line.parent != last:
            out.extend(gap)
        gap = []
        out.append(line)
        last = line.parent
    return out


def _between(lines: list[Line]) -> list[str]:
    """The lines from each surge to its dive."""
    lines = _joined(lines)
    named = any(line.named for line in lines)
    sizes = [len(line.text) if (line.named if named else line.links <= LINK_SHARE) else 0 for line in lines]
    n = len(sizes)
    sums = [sum(sizes[i : i + WINDOW]) for i in range(n)]
    if not n or not max(sums):
        return []
    surge = SURGE_CHARS if named else max(SURGE_CHARS, SURGE_SHARE * max(sums))
    if max(sums) < surge:  # a page of little text: any of it surges
        surge = 1
    regions, i, after = [], 0, 0
    while i < n:
        if sums[i] < surge:
            i += 1
            continue
        j = i
        while j < n and (sizes[j] or any(sizes[j + 1 : j + WINDOW])):
            j += 1
        first = next((k for k in range(i, j) if sizes[k] >= SHORT_CHARS or lines[k].heading), i)
        while i > after and lines[i - 1].text and lines[i - 1].parent == lines[first].parent:
            i -= 1
        while surge > 1 and i < first and lines[i].parent != lines[first].parent:
            i += 1
        regions.append((sum(sizes[i:j]), i, j))
        i = after = max(j, i + 1)
    largest = max(r[0] for r in regions)
    return [lines[k].text for total, i, j in regions if named or total >= REGION_SHARE * largest for k in range(i, j) if sizes[k]]


def main_text(page: str | None) -> str:
    """Main text of a whole page: kept lines joined by one newline; empty for null, empty and textless pages."""
    page = page or ""
    return "\n".join(_between(lines_of(page)) or _between(lines_of(page, by_words=False)))


_FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and its length ``n_chars`` in code points.

    Every page is read whole; null and empty pages give the empty text.
    Repeated rows each give a row; columns of the same names are replaced.
    """

    def step(texts: C.TextStep) -> list[pa.Array]:
        got = [main_text(texts.doc_bytes(i).tobytes().decode()) for i in range(texts.n)]
        return [pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())]

    return C.add_columns(pages, _FIELDS, html_col, step)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pages.select("page_id", "url", "text", "n_chars")
