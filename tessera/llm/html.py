"""Main text of web pages by line-block distribution.

A linear scanner reads the markup: attributes are known by their exact names, unquoted values end at
white space or `>`, and where a tag is never closed the rest of the page is read with tags that end at
the next bracket. Text is cut into lines, one per block element; elements that hold menus, footers,
asides, forms, notices, adverts, scripts or reader comments (by element name, role, or whole class and
id names) leave a gap in their place. A `<header>` outside of the article goes; of one inside it the
headings stay.

What is kept is decided by the lines' lengths. A line counts what is not in links if it is mostly links,
else all of it. Lengths are summed over sliding windows of WINDOW lines; where the sum surges from nothing
a stretch begins, where it dives back to nothing it ends, at lines that count. A stretch is kept if its
peak reaches a threshold. Lines of the root weigh WEIGHT, so that every stretch of it reaches it, however
short its paragraphs are; a list of links in it still counts nothing, so that the sums dive there and
the list goes, while a line of links between paragraphs lies inside their stretch. The root is the
<article> and <main> elements if they hold at least half of what counts on the page; then stretches outside of
them need FAR characters in a window. On other pages it is the element with the most text directly in
it: lines in it, and paragraphs, headings and list items below it, weigh; all others need PEAK.

Works on whole pages, one row at a time in Arrow batches; time is linear in the page's length.

Defined results: null or empty html, or a page without content, gives an empty text; repeated rows
and null ids pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, PEAK, FAR = 3, 60, 400
#: What a character in the root counts.
WEIGHT = 60
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[^>=]++)*+)>")
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)>?")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
#: Element names.
RAW = frozenset("script style iframe noembed noframes textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dd dt td th figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("nav footer aside form menu dialog button select datalist template noscript svg math canvas object audio video head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Class and id names; one may be joined by - or _ to other such names, numbers and the words in WITH.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer footers header headers masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus respond replies reply "
    "share sharing social related newsletter subscribe subscription signup login search promo promotion sponsor sponsored pagination pager toolbar widget widgets form".split()
)
WITH = frozenset("site page main top bottom left right container wrapper wrap box list section area block bar links buttons inner outer primary secondary global post posts article articles content form footer header".split())
_COMMENTS = frozenset("comment comments reply replies respond disqus".split())
_CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


class Line(NamedTuple):
    text: str
    counts: int
    marked: bool  # inside <article> or <main>
    holder: int  # the element that directly holds its block
    prose: bool
    above: tuple  # holders that it lies in


def _named(value: str, names: frozenset) -> bool:
    """Whether a class or id list has a name that says what is dropped."""
    for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        parts = [p for p in re.split(r"[-_:]+", token) if p and not p.isdigit()]
        if any(p in names for p in parts) and all(p in names or p in NAMES or p in WITH for p in parts):
            return True
    return False


def _fate(name: str, attributes: str, marked: bool) -> str:
    """'' for an element that stays, 'gone', or 'header' for one of which headings stay."""
    if name in DROPPED:
        return "gone"
    fate = "" if name != "header" else "header" if marked else "gone"
    if not attributes or name in ("html", "body", "main"):
        return fate
    for match in _ATTRIBUTE.finditer(attributes):
        key, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and re.search(r"(?:^|;)\s*display\s*:\s*none\b", value, re.I)):
            return "gone"
        if key == "role" and value.strip().lower() in ROLES:
            return "gone"
        # An id on a heading, a paragraph or a list item is an anchor; a heading's class is its looks.
        if name not in HEADINGS and (key == "class" or (key == "id" and name not in PROSE)):
            if _named(value, NAMES if name != "article" else _COMMENTS):
                only_header = _named(value, frozenset(("header", "headers"))) and not _named(value, NAMES - {"header", "headers"})
                if not (only_header and marked):
                    return "gone"
                fate = "header"
    return fate


class _Reader:
    """The lines of a page, from a stack of its open elements."""

    def __init__(self) -> None:
        self.lines: list[Line | None] = []  # None is a gap
        self.open: list[tuple[str, str, int]] = []  # name, fate in force, holder
        self.count: dict[str, int] = {}
        self.holders, self.above = 1, {0: ()}
        self.text: list[str] = []
        self.linked, self.in_link, self.marks = 0, False, 0

    def add(self, text: str) -> None:
        if not self.open or not self.open[-1][1]:
            text = entities.unescape(text)
            self.text.append(text)
            if self.in_link:
                self.linked += len(text.strip())

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                names = [n for n, _, _ in self.open[-2:]]
                holder = self.open[-1][2] if self.open else 0
                plain = max(0, len(line) - self.linked)
                counts = plain if 2 * self.linked > len(line) else len(line)
                prose = bool(names) and (names[-1] in PROSE or (len(names) > 1 and names[-2] in HEADINGS))
                self.lines.append(Line(line, counts, self.marks > 0, holder, prose, self.above[holder]))
            self.text.clear()
        self.linked = 0

    def gap(self) -> None:
        if self.lines and self.lines[-1] is not None:
            self.lines.append(None)

    def pop(self) -> None:
        name, fate, _ = self.open.pop()
        self.count[name] -= 1
        self.marks -= name in ("article", "main")
        if fate:
            self.text.clear()

    def pop_to(self, names: tuple | list, until: tuple) -> None:
        """Close the innermost open element of these names, if no `until` lies inside of it."""
        if any(self.count.get(n) for n in names):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in until:
                    return
                if self.open[k][0] in names:
                    self.end_line()
                    while len(self.open) > k:
                        self.pop()
                    return

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.add(" ")
            return
        if name in VOID:
            if name == "hr":
                self.end_line()
            return
        block = name in BLOCKS
        if block:
            if self.count.get("p"):
                self.pop_to(("p",), ("td", "th", "table", "button", "object"))
            if name in _CLOSED_BY:
                names, until = _CLOSED_BY[name]
                self.pop_to(names.split(), until)
        above = self.open[-1][1] if self.open else ""
        if above == "gone" or (above == "header" and name not in HEADINGS):
            fate = above
            if block:
                self.end_line()
        else:
            fate = "" if above == "header" else _fate(name, attributes, self.marks > 0)
        if block or (fate and not above):
            self.end_line()
        if fate and not above:
            self.gap()
        if name == "a" and not fate:
            self.in_link = True
        if (not block and not fate) or attributes.endswith("/"):
            return
        holder = self.open[-1][2] if self.open else 0
        if block and not fate and name not in PROSE:
            self.above[self.holders] = (*self.above[holder][-60:], holder)
            holder, self.holders = self.holders, self.holders + 1
        self.open.append((name, fate, holder))
        self.count[name] = self.count.get(name, 0) + 1
        self.marks += name in ("article", "main")

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if self.count.get(name):
            self.pop_to((name,), ())
        elif name in BLOCKS:
            self.end_line()


def read(page: str) -> list[Line | None]:
    """The lines of a page and the gaps between them."""
    reader, at, tag, broken = _Reader(), 0, _TAG, False
    while True:
        begin = page.find("<", at)
        if begin < 0:
            reader.add(page[at:])
            break
        if begin > at:
            reader.add(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = len(page) if end < 0 else end + 1
            continue
        match = tag.match(page, begin)
        if not match and not broken and re.match(r"</?[a-zA-Z]", page[begin : begin + 3]):
            tag, broken = _BROKEN, True
            match = tag.match(page, begin)
        if not match:  # a bracket that is text
            reader.add("<")
            at = begin + 1
            continue
        at, name = match.end(), match[2].lower()
        if match[1]:
            reader.end(name)
        elif name in RAW and not match[3].endswith("/"):
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else len(page)
        else:
            reader.start(name, match[3])
    reader.end_line()
    return reader.lines


def weigh(lines: list[Line | None]) -> tuple[list[str], list[int], list[int]]:
    """Texts, lengths that count, and the peak that a stretch of each line needs. Gaps are empty lines."""
    real = [x for x in lines if x is not None]
    inner = sum(x.counts for x in real if x.marked)
    marked = inner > 0 and 2 * inner >= sum(x.counts for x in real)
    direct: dict[int, int] = {}
    for x in real:
        direct[x.holder] = direct.get(x.holder, 0) + x.counts
    root = max(direct, key=lambda h: (direct[h], -h), default=-1)
    texts, lengths, needs, before = [], [], [], None
    for x in lines:
        inside = x is not None and (x.marked if marked else x.holder == root or (x.prose and root in x.above))
        if x is None or (before is not None and before != inside):  # sums don't run over a gap or the root's edge
            texts += [""] * WINDOW
            lengths += [0] * WINDOW
            needs += [0] * WINDOW
        if x is not None:
            texts.append(x.text)
            lengths.append(WEIGHT * x.counts if inside else x.counts)
            needs.append(FAR if marked and not inside else PEAK)
        before = None if x is None else inside
    return texts, lengths, needs


def main_text(page: str | None) -> str:
    if not page:
        return ""
    texts, lengths, needs = weigh(read(page))
    half = WINDOW // 2
    sums = [sum(lengths[max(0, k - half) : k + half + 1]) for k in range(len(lengths))]
    kept: list[str] = []
    at = 0
    while at < len(sums):
        if not sums[at]:
            at += 1
            continue
        surge = at
        while at < len(sums) and sums[at]:
            at += 1
        counted = [k for k in range(surge, at) if lengths[k]]
        if max(sums[surge:at]) >= needs[counted[0]]:
            kept += [t for t in texts[counted[0] : counted[-1] + 1] if t]
    if not kept:  # a page of short lines only
        kept = [t for t, n in zip(texts, lengths, strict=True) if n]
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each whole page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string())], schema=schema)

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
