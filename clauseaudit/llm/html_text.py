"""Main text of web pages from streaming parser events, by smoothed text-to-tag ratios.

A page is read once by the standard library's event parser.  Block elements cut it into lines: each has its words, the number of tags
that begin or end in it, the characters inside links and the element that holds it.  What is no prose by its element (navigation, page
headers and footers, sidebars, forms, scripts, styles, templates) or by a word of its class, id or role (adverts, menus, notices, comments) is
set aside, unless an article or main element lies in it.

The ratio of a line is its text outside links over its tags.  Ratios are smoothed along the page by a Gaussian, and a threshold between
the two clusters of the smoothed ratios (Lloyd's steps in one dimension) marks dense lines.  They vote, by their text, for the elements around
them: the region is the innermost element that holds over 0.6 of the dense text, or the article around it.  All lines of the region that are not set aside, and headings just
before it, are the text, short ones too, so a low ratio inside an article loses nothing.

Null, empty and blank pages, and pages without a line of text, give an empty text.  An element that a page leaves open ends with its parent, or where
HTML says so (``p``, ``li`` and table parts); stray ends are ignored.  Rows are read alone, so ties and repeated rows give equal
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Set
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5
ROWS = 500  # pages of a batch of results

# Names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead title tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg head iframe object canvas audio video select textarea button datalist".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
HEAD = frozenset("title base meta link style script noscript template head html".split())
REGIONS = frozenset("article main section div body td html".split())
_ROW, _PART = frozenset(["td", "th", "tr"]), frozenset(["td", "th", "tr", "thead", "tbody", "tfoot"])
#: What begins these ends an open one of the first names, up to an element of the second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": (_ROW, {"table"}), "tbody": (_PART, {"table"}), "thead": (_PART, {"table"}), "tfoot": (_PART, {"table"})}
#: What begins these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption body html title legend summary figcaption".split())

# Words of classes, ids and roles that name what is no main text.
COMMENTS = frozenset("comment comments commentlist commentary disqus respond replies reply".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion promoted".split())
MENUS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars toolbar topbar pagination pager paging toc footer footers header masthead widget widgets skip".split())
NOTICES = frozenset("notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations trending disclaimer copyright tooltip hidden".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
LAYOUT = frozenset("with has no without content".split())
OWN_HEADER = frozenset("post article entry story".split())

_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """An element of a page: its parent, why it is set aside if it is, whether an article or main element lies in it."""

    __slots__ = ("tag", "up", "depth", "why", "silent", "holds", "votes", "kept", "article", "inside")

    def __init__(self, tag: str, up: Element | None, why: str):
        self.tag, self.up, self.why = tag, up, why
        self.depth = up.depth + 1 if up else 0
        self.silent = why == "silent" or (up is not None and up.silent)
        self.holds, self.votes, self.kept, self.article, self.inside = False, 0, True, False, False


class Line:
    __slots__ = ("text", "tags", "linked", "element")

    def __init__(self, text: str, tags: int, linked: int, element: Element):
        self.text, self.tags, self.linked, self.element = text, tags, linked, element


def _why(tag: str, attrs: dict[str, str | None]) -> str:
    """Why an element is set aside: "silent" (no text at all), "comments", "name", "element" or ""."""
    if tag in SILENT or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or _UNSEEN.search(attrs.get("style") or ""):
        return "silent"
    if tag in ("html", "body", "main"):
        return ""
    for name in [*(attrs.get("class") or "").split(), attrs.get("id") or ""]:
        found = {w.lower() for w in _NAMES.findall(name)}
        if found & COMMENTS:
            return "comments"
        if found & (ADVERTS | NOTICES) or (found & MENUS and not found & LAYOUT and not (found & MENUS == {"header"} and found & OWN_HEADER)):
            return "name"
    return "element" if tag in ASIDE or (attrs.get("role") or "").lower() in ROLES else ""


class Events(HTMLParser):
    """Collects the lines and elements of a page from the parser's events; the work is linear in the page but for stray ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = Element("", None, "")
        self.elements, self.lines = [self.at], []
        self.held: list[str] = []
        self.open: Counter[str] = Counter()
        self.tags, self.linked = 0, 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.held)).strip()
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.at))
            self.tags, self.linked = 0, 0
        self.held.clear()

    def leave(self, tags: Set[str], up_to: Set[str]) -> bool:
        """Close the innermost open element of ``tags``, and all inside it, unless one of ``up_to`` stands before it."""
        if not any(self.open[t] for t in tags):
            return False
        e: Element | None = self.at
        while e is not None and e.tag not in tags:
            if e.tag in up_to:
                return False
            e = e.up
        if e is None:
            return False
        while self.at.depth >= e.depth:
            if self.at.tag in BLOCKS:
                self.flush()
            self.open[self.at.tag] -= 1
            self.at = self.at.up or self.at
        return True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.open["head"] and tag not in HEAD:
            self.leave({"head"}, set())
        if tag in ENDS:
            self.leave(*ENDS[tag])
        if tag in ENDS_P:
            self.leave({"p"}, {"td", "th", "table", "button", "object", "caption"})
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.held.append(" ")
            return
        why = _why(tag, dict(attrs))
        if tag in BLOCKS:
            self.flush()
        elif why:
            why = "silent"  # no line of its own
        self.at = Element(tag, self.at, why)
        self.elements.append(self.at)
        self.open[tag] += 1
        e: Element | None = self.at if tag in ("article", "main") and not why else None
        while e is not None and not e.holds:
            e.holds = True
            e = e.up

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open["svg"]:  # elsewhere the slash means nothing
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.leave({tag}, set() if tag in BLOCKS or tag in SILENT else BLOCKS) and tag in ("p", "br"):
            self.held.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.at.silent:
            self.held.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())

    def judge(self) -> None:
        """Set ``kept``: nothing around an element is set aside.  What holds an article or main element is not, nor the header of an article,
        unless it is comments or silent."""
        for e in self.elements[1:]:
            assert e.up is not None
            e.article = e.up.article or e.tag == "article"
            spared = not e.why or (e.why in ("name", "element") and (e.holds or (e.tag == "header" and e.up.article)))
            e.kept = e.up.kept and spared


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian mean along the page; the weights inside the page are scaled to one."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratios)
    return np.convolve(ratios, kernel)[reach : reach + n] / np.convolve(np.ones(n), kernel)[reach : reach + n]


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of the values; all are dense if they are equal."""
    low, high = float(values.min()), float(values.max())
    cut = (low + high) / 2
    for _ in range(50):
        above = values >= cut
        if above.all() or not above.any():
            break
        new = (values[above].mean() + values[~above].mean()) / 2
        if new == cut:
            break
        cut = float(new)
    return cut


def main_lines(html: str) -> list[str]:
    """Lines of the region with the dense text."""
    events = Events()
    events.feed(html)
    events.close()
    events.flush()
    events.judge()
    lines = [x for x in events.lines if x.element.kept]
    if not lines:
        return []
    ratio = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) if x.element.kept else 0.0 for x in events.lines])
    smoothed = smooth(ratio)
    dense = (ratio > 0) & (smoothed >= threshold(smoothed))
    marked = [x for x, d in zip(events.lines, dense) if d] or lines
    for x in marked:
        x.element.votes += len(x.text)
    total = sum(len(x.text) for x in marked)
    for e in reversed(events.elements):  # children come after their parents
        if e.up is not None:
            e.up.votes += e.votes
    best = max((e for e in events.elements if e.votes > 0.6 * total and (e.tag in REGIONS or e.up is None)), key=lambda e: e.depth)
    at = best
    while at.up is not None and at.tag != "article":
        at = at.up
    best = at if at.tag == "article" else best
    for e in events.elements:
        e.inside = e is best or (e.up is not None and e.up.inside)
    # Headings that stand alone before the region, in the elements around it, are its own.
    begin = next(i for i, x in enumerate(lines) if x.element.inside)
    while begin and lines[begin - 1].element.tag in ("h1", "h2") and best.tag != "article":
        begin -= 1
        lines[begin].element.inside = True
    return [x.text for x in lines if x.element.inside]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                text = ["\n\n".join(main_lines(h)) if h else "" for h in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


#: The same for pages that mark their text as one plain article of paragraphs and headings, as the given table does.
SQL = r"""WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS blocks FROM pages),
r AS (SELECT page_id, url, list_transform(blocks, lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS blocks FROM a),
b AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM r),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c"""
