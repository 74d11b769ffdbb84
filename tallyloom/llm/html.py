"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, and each line has a length: its
characters outside links (those of headings count).  The lengths are summed over sliding windows of WINDOW lines.  A
main part surges where such a sum exceeds SURGE and dives where a whole window is empty; all
between is kept, links and short lines too.  Of several parts those count whose highest sum
is at least PEAK of the highest of all.

What a page says of itself shapes the distribution:

* Lines in elements that are never text of an article (menus, footers, asides, dialogs and
  so on) have no length and are no text.
* So have lines in elements whose class, id or role names a surrounding (and in forms), but
  only while something surges without them: else the largest of them that a name may hide by
  mistake counts again, and so on.  Where nothing at all is left, any of them does.
* Within an article (or main) element links have length as well, and a line weighs so much
  that it surges by itself; its borders are dives.  Elsewhere is text only if no line is in
  such an element.

Defined results: null, empty and textless pages give an empty text with 0 characters; where
no window surges, the part with the largest sum is kept; ties go to the earlier part;
repeated rows come out alike; an empty table gives an empty table; other columns travel
along.  Pages are whole, and a page is one row's work, in time linear in its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import set_apart, table

WINDOW, SURGE, PEAK = 3, 60, 0.15

#: Elements of HTML by what they are here.
_RAW = frozenset("script style textarea title xmp".split())
_SILENT = frozenset("noscript template svg iframe object canvas audio video".split())
_AROUND = frozenset("nav footer aside menu dialog button select datalist".split())
_MAIN = frozenset("article main".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the first kind is ended by a start of the second, unless one of the third is between.
_ENDED_BY = {
    "p": (_BLOCKS - {"body", "html"}, frozenset("td th button object".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(("dt", "dd")), frozenset(["dl"])),
    "dd": (frozenset(("dt", "dd")), frozenset(["dl"])),
    "td": (frozenset("td th tr tbody tfoot thead".split()), frozenset(["table"])),
    "th": (frozenset("td th tr tbody tfoot thead".split()), frozenset(["table"])),
    "tr": (frozenset("tr tbody tfoot thead".split()), frozenset(["table"])),
    "head": (frozenset(["body"]), frozenset()),
}
#: Words of class, id and role that name what surrounds a text.  The first ones hide text even if little else is left.
_COMMENTS = frozenset("comment comments commentlist commentarea commentform commentsection commentthread".split())
_CERTAIN = _COMMENTS | frozenset("ad ads advert adverts advertisement cookie cookies disqus footer menu nav navbar navigation newsletter sidebar".split())
_LIKELY = _CERTAIN | frozenset("banner breadcrumb breadcrumbs complementary consent contentinfo gdpr header masthead modal notice notices pagination popup promo promos promoted related respond search share sharing social sponsor sponsored subscribe toolbar widget".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>"
    r"|<[!?][^>]*+>",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


@dataclass
class Wrapper:
    """An element that is named as a surrounding; ``inside``: the wrappers that hold it."""

    certain: bool
    inside: tuple[int, ...]
    hides: bool = True


@dataclass
class Line:
    text: str
    #: Characters outside links.
    plain: int
    #: The article or main element that holds it, from 1, or 0.
    main: int
    #: The wrappers that hold it; and whether it is in an element that is no text anyway.
    wrappers: tuple[int, ...]
    outside: bool


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    wrappers: list[Wrapper] = field(default_factory=list)


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's names tell a surrounding at all, for certain, and reader comments."""
    likely = certain = comment = False
    for m in _NAMES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            certain |= token in _CERTAIN
            parts = re.split(r"[-_]", token)
            likely |= any(p in _LIKELY for p in parts)
            comment |= token in _COMMENTS
    return likely, certain, comment


def parsed(page: str) -> Page:
    """The lines of a page in order, and its wrappers."""
    out = Page()
    parts: list[str] = []
    linked: list[str] = []
    # open elements: name, kind, number of the wrapper
    stack: list[tuple[str, str, int]] = []
    open_: Counter[str] = Counter()
    wrappers: tuple[int, ...] = ()
    silent = outside = links = main = mains = 0
    at = 0

    def end_line() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            link = len(" ".join(unescape("".join(linked)).split())) if linked else 0
            out.lines.append(Line(text, max(0, len(text) - link), main if mains else 0, wrappers, bool(outside)))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        if text and not silent:
            parts.append(text)
            if links:
                linked.append(text)

    def close(upto: int) -> None:
        nonlocal wrappers, silent, outside, links, mains
        while len(stack) > upto:
            name, kind, _ = stack.pop()
            open_[name] -= 1
            if name in _BLOCKS or kind in ("around", "wrapper"):
                end_line()
            silent -= kind == "silent"
            outside -= kind == "around"
            links -= kind == "link"
            mains -= kind == "main"
            if kind == "wrapper":
                wrappers = wrappers[:-1]

    def last(name: str, until: frozenset[str] = frozenset()) -> int:
        """The place of the innermost open element of a name, or -1."""
        for i in range(len(stack) - 1, -1, -1) if open_[name] else ():
            if stack[i][0] == name:
                return i
            if stack[i][0] in until:
                return -1
        return -1

    pos = 0
    while m := _TOKEN.search(page, pos):
        add(page[at : m.start()])
        pos = at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in _BLOCKS:
                end_line()
            if (i := last(name)) >= 0:
                close(i)
            continue
        if name in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos)
            # without its end a title has no more than its line
            pos = at = end.end() if end else (pos + len(page[pos:].split("<", 1)[0]) if name == "title" else len(page))
            continue
        if name == "br":
            add(" ")
            continue
        for ended, (by, until) in _ENDED_BY.items():
            if name in by and (i := last(ended, until)) >= 0:
                close(i)
        if name in _BLOCKS:
            end_line()
        if name in _VOID or m[3].endswith("/"):
            continue
        likely, certain, comment = _named(m[3]) if "=" in m[3] and name not in ("html", "body") else (False, False, False)
        if name in _MAIN:
            likely = certain = comment
        if name in _SILENT:
            stack.append((name, "silent", -1))
            silent += 1
        elif name in _AROUND or name == "header" and not mains:
            end_line()
            stack.append((name, "around", -1))
            outside += 1
        elif likely or name == "form":
            end_line()
            stack.append((name, "wrapper", len(out.wrappers)))
            out.wrappers.append(Wrapper(certain, wrappers))
            wrappers = (*wrappers, len(out.wrappers) - 1)
        elif name in _MAIN:
            main += not mains
            mains += 1
            stack.append((name, "main", -1))
        elif name == "a" and not any(open_[h] for h in _HEADINGS):
            stack.append((name, "link", -1))
            links += 1
        elif name in _BLOCKS:
            stack.append((name, "block", -1))
        else:
            continue
        open_[name] += 1
    add(page[at:])
    close(0)
    end_line()
    return out


def window_sums(lengths: np.ndarray) -> np.ndarray:
    """The length of each line and of those that follow it, WINDOW in all."""
    return np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :] if len(lengths) else lengths


def _settle(page: Page) -> None:
    """Lets names hide lines only while something surges without them (see above)."""
    inside = [x for x in page.lines if x.main and not x.outside] or [x for x in page.lines if not x.outside]
    if any(x.main for x in inside):
        inside = [x for x in inside if x.main]
    held = [0] * len(page.wrappers)
    for x in inside:
        for w in x.wrappers:
            held[w] += x.plain
    while True:
        free = [x for x in inside if not any(page.wrappers[w].hides for w in x.wrappers)]
        if len(free) and window_sums(np.array([x.plain for x in free], np.int64)).max() > SURGE:
            return
        # those that nothing else hides
        outer = [i for i, w in enumerate(page.wrappers) if w.hides and held[i] and not any(page.wrappers[v].hides for v in w.inside)]
        rest = sum(x.plain for x in free)
        outer = [i for i in outer if not rest or not page.wrappers[i].certain and held[i] > rest]
        if not outer:
            return
        page.wrappers[max(outer, key=lambda i: (not page.wrappers[i].certain, held[i], -i))].hides = False


def parts_of(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, end, highest sum) of each part between surge and dive; where nothing surges, of each part between dives."""
    sums = window_sums(lengths)
    found = []
    for least in (SURGE, 0):
        at, n = 0, len(lengths)
        while at < n:
            if sums[at] <= least:
                at += 1
                continue
            end = at
            while end < n and sums[end]:
                end += 1
            filled = np.flatnonzero(lengths[at:end])
            found.append((at + int(filled[0]), at + int(filled[-1]) + 1, int(sums[at:end].max())))
            at = end
        if found:
            break
    return found


def main_text(html: str | None) -> str:
    """The main text of one page."""
    page = parsed(html or "")
    _settle(page)
    lengths: list[int] = []
    place: list[int] = []

    def put(length: int, line: int) -> None:
        lengths.append(length)
        place.append(line)

    before = 0
    named = any(x.main and not x.outside and not any(page.wrappers[w].hides for w in x.wrappers) for x in page.lines)
    for i, x in enumerate(page.lines):
        hidden = x.outside or any(page.wrappers[w].hides for w in x.wrappers)
        if x.main != before:
            for _ in range(WINDOW):
                put(0, -1)
            before = x.main
        if not hidden and (x.main or not named):
            put(len(x.text) + SURGE if x.main else x.plain, i)
        elif not x.main:
            put(0, -1)
    found = parts_of(np.array(lengths, np.int64))
    if not found:
        return ""
    peak = max(p[2] for p in found)
    surged = [p for p in found if p[2] > SURGE and (named or p[2] >= PEAK * peak)]
    kept = surged or [max(found, key=lambda p: (p[2], -p[0]))]
    return "\n\n".join(page.lines[place[i]].text for a, b, _ in kept for i in range(a, b) if place[i] >= 0)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column("_lbd_html")]
        kept = [(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if c != "_lbd_html"]
        yield pa.RecordBatch.from_arrays(
            [*(c for _, c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [*(n for n, _ in kept), "text", "n_chars"],
        )


def extracted(df: DataFrame, html_column: str = "html") -> DataFrame:
    """``df`` without its html, with ``text`` and ``n_chars``, in place of columns of these names; others travel along under any name."""
    held, back = set_apart(df, [html_column])
    held = held.withColumnRenamed(html_column, "_lbd_html")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in held.drop("_lbd_html").schema.fields]
    found = held.mapInArrow(_extract, ", ".join([*fields, "text string", "n_chars long"]))
    kept = [b for c, b in zip(df.columns, back, strict=True) if c != html_column and c.lower() not in ("text", "n_chars")]
    return found.select(*kept, "text", "n_chars")


def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
