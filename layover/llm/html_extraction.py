"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags; scripts, styles, comments
and other content that is never shown are left out.  Inline tags do not
end a block; two line breaks in a row do.

Pass 1 decides each block by itself: blocks inside menus, headers, footers,
sidebars, notices, adverts, forms and reader comments (by element, role or
the words of class and id) are boilerplate, as are blocks made of links;
long blocks with many stop words and few links are text.  What stays is
ambiguous.  Then runs are decided: where no boilerplate stands between them
and their code points come to a long block, two or more unlinked blocks that
are at least of medium length, or short sentences, are text in any language.
Runs count in the regions of a page (its article and main elements) and,
if no region has text, on the page outside of them.

Pass 2 gives an ambiguous block the label of the nearest decided blocks of
its region; if they differ, the nearer one decides, and at equal distance
the block is text if it has stop words or is a heading.  It works alike in
and outside of articles, so an unmarked advert or notice among links goes;
only boilerplate elements nested in an article, which say themselves where
they end, decide nothing about their neighbours.
Where an article has no text by then, its ambiguous blocks are text; where
the page has none, those of medium length without links are.  If nothing on
a page is text, the text is empty.

Edge cases: null or empty html gives an empty text; unclosed and misnested
tags are closed by the next matching end tag or by the page's end, and an
unclosed script or style runs to the page's end; pages of any length are
read whole; repeated rows are treated alike; columns named in ``keep`` pass
through (others are dropped, so names cannot clash); an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from layover.llm.common import prepare

# Frequent function words of English, French, German, Spanish.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i in is it its not of on one or she that the their
there they this to was were which who will with would you your
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qui
que sa se ses son sont sur un une vous
als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach
nicht noch nur oder sich sie sind so über um und uns von vor war werden wie wir zu zum zur
al como con del el ella ellos era es esta este han hay la las lo los más me mi muy no o para pero por que se sin sobre
su sus también un una y ya
""".split())

# HTML element names by role.
_BLOCK = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul
""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAD_ELEMENT = frozenset("nav aside footer form menu dialog button fieldset".split())
_BAD_WORD = frozenset("""
ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
copyright discussion disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices
notification pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar
signin signup skip social sponsor sponsored subscribe toolbar widget widgets
""".split())
_BAD_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "select", "object", "canvas", "audio", "video", "button")
_RAW_START = re.compile(r"<(?:%s)\b" % "|".join(_RAW), re.I)
_RAW_END = {name: re.compile(r"</%s\s*>" % name, re.I) for name in _RAW}
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile("[>\"']")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG = 70, 200  # code points
FEW_STOPS, MANY_STOPS = 0.15, 0.30  # share of the words
MANY_LINKS = 0.4  # share of the code points
_SENTENCE_END = tuple(".!?…。！？।؟")

GOOD, BAD, OPEN = 1, 0, -1


@dataclass
class Block:
    text: str
    linked: int  # code points inside links
    bad: bool  # inside a boilerplate element
    region: int  # 0 outside, else the number of the article or main element
    heading: bool


def _marks_bad(name: str, attrs: str, in_region: bool) -> bool:
    if name in _BAD_ELEMENT or name == "header" and not in_region:
        return True
    for key, value in _ATTR.findall(attrs) if attrs else ():
        value = value.strip("\"'").lower()
        if key.lower() == "role":
            if value in _BAD_ROLE:
                return True
        elif name not in ("html", "body") and not _BAD_WORD.isdisjoint(_WORD.findall(value)):
            return True
    return False


class _Ahead:
    """First match of a pattern from a place on; asked for rising places, it
    reads every character once."""

    def __init__(self, find):
        self.find, self.since, self.at = find, 0, -1

    def __call__(self, place: int) -> int:
        """Its start, or -1 if there is none."""
        if self.at < 0 and self.since or self.since <= place <= self.at:
            return self.at
        self.at = self.find(place)
        self.since = max(place, 1)
        return self.at


def tags(html: str):
    """(start, end, name, closing, attributes) of the page's markup in order;
    name is empty for comments, declarations and elements without text for the
    reader, which are taken with their content.  A ``<`` that starts none of
    these is text.  Each character is read a bounded number of times."""
    gt = _Ahead(lambda i: html.find(">", i))
    dead: set[int] = set()  # places behind an attribute from which a tag does not end

    def quoted_end(i: int) -> int:
        """End of a tag whose attributes go on at ``i``, ``>`` in quotes not
        counting; -1 if a quote is left open or the page ends before."""
        been = []
        while i not in dead:
            been.append(i)
            m = _SPECIAL.search(html, i)
            if m and m[0] == ">":
                return m.end()
            close = html.find(m[0], m.end()) if m else -1
            if close < 0:
                break
            i = close + 1
        dead.update(been)
        return -1

    i = html.find("<")
    while i >= 0:
        end, name, closing, attrs = -1, "", False, ""
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            end = len(html) if end < 0 else end + 3
        elif gt(i) < 0:  # no tag ends any more; only a comment may still begin
            i = html.find("<!--", i)
            continue
        elif (m := _RAW_START.match(html, i)):
            close = _RAW_END[html[i + 1:m.end()].lower()].search(html, gt(m.end()) + 1)
            end = close.end() if close else len(html)
        elif (m := _NAME.match(html, i)):
            end = quoted_end(m.end())
            if end < 0:
                end = gt(m.end()) + 1
            closing, name, attrs = bool(m[1]), m[2].lower(), html[m.end():end - 1]
        elif html[i + 1:i + 2] in ("!", "?", "/"):
            end = gt(i + 2) + 1
        if end > i:
            yield i, end, name, closing, attrs
            i = html.find("<", end)
        else:
            i = html.find("<", i + 1)


def blocks(html: str, exempt: frozenset[int] = frozenset()) -> tuple[list[Block], dict[int, tuple[int, bool]]]:
    """Blocks of a page in order, without empty ones, and its marked elements
    by number: (unlinked code points under it, whether it holds an article or
    main element).  The marks of ``exempt`` elements do not count."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # element, bad, region, nearest marked element
    bad, region, regions, links, breaks, heading = False, 0, 0, 0, 0, False
    number, linked_at = 0, 0  # of elements; depth of the stack where the open link began
    prose, above, holds = {}, {}, set()  # by marked element: unlinked code points, the marked one around it

    def flush() -> None:
        nonlocal breaks
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, len(" ".join("".join(linked).split())), bad, region, heading))
            if stack and stack[-1][3]:
                prose[stack[-1][3]] += len(text) - out[-1].linked
        parts.clear()
        linked.clear()
        breaks = 0

    def add(raw: str) -> None:
        nonlocal breaks
        text = unescape(raw)
        parts.append(text)
        if links:
            linked.append(text)
        if breaks and text.strip():
            breaks = 0

    end = 0
    for start, stop, name, closing, attrs in tags(html):
        if start > end:
            add(html[end:start])
        end = stop
        if not name:
            continue
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                flush()
            continue
        if name == "a":
            links, linked_at = 0 if closing else 1, len(stack)
            continue
        if name not in _BLOCK:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in ("p", "li", "dd", "dt", "td", "th", "tr") and stack and stack[-1][0] == name:
                stack.pop()  # these end where the next one begins
            up_bad, up_region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            number, mark = number + 1, stack[-1][3] if stack else 0
            marked = _marks_bad(name, attrs, up_region > 0)
            now_bad = up_bad or marked and number not in exempt
            if name in ("article", "main"):
                holds.add(mark)
                if not now_bad and not up_region:
                    regions += 1
                    up_region = regions
            if marked and name not in _VOID:
                above[number], prose[number], mark = mark, 0, number
            if name not in _VOID:
                stack.append((name, now_bad, up_region, mark))
        if links and len(stack) < linked_at:
            links = 0  # a link ends with the element that it began in
        bad, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        heading = any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-2:])
    if end < len(html):
        rest = html[end:]
        cut = rest.rfind("<")  # a tag that the page's end cuts off
        add(rest if cut < 0 or ">" in rest[cut:] or not re.match(r"<[/!a-zA-Z]", rest[cut:]) else rest[:cut])
    flush()
    for k in sorted(above, reverse=True):
        if above[k]:
            prose[above[k]] += prose[k]
            if k in holds:
                holds.add(above[k])
    return out, {k: (n, k in holds) for k, n in prose.items()}


def _stops(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'«»") in STOP_WORDS for w in words) / len(words)


def classify(b: Block) -> int:
    """Pass 1."""
    n = len(b.text)
    if b.bad or b.linked > MANY_LINKS * n:
        return BAD
    if b.text.startswith(("©", "(c) ")):
        return OPEN if b.region else BAD
    if n < SHORT:
        return OPEN if b.region or not b.linked else BAD
    return GOOD if n >= LONG and _stops(b.text) >= MANY_STOPS else OPEN


def _prose(b: Block) -> bool:
    """Unlinked, and of medium length or a sentence."""
    return not b.linked and (len(b.text) >= SHORT or b.text.endswith(_SENTENCE_END) and len(b.text.split()) > 3)


def _decides(b: Block) -> bool:
    """A boilerplate element in an article says itself where it ends, so that
    lists and captions next to it stay."""
    return not (b.bad and b.region)


def _runs(page: list[Block], first: list[int], regions: set[int]) -> None:
    """Ambiguous blocks of runs of prose become text."""
    runs: list[list[int]] = []
    of: dict[int, list[int]] = {}
    for i, b in enumerate(page):
        if b.region not in regions:
            continue
        if first[i] == BAD:
            if _decides(b):
                of.pop(b.region, None)
        elif _prose(b):
            if b.region not in of:
                of[b.region] = []
                runs.append(of[b.region])
            of[b.region].append(i)
    for run in runs:
        if len(run) > 1 and sum(len(page[i].text) for i in run) >= LONG:
            for i in run:
                first[i] = GOOD


def labels(page: list[Block]) -> list[int]:
    """Pass 1, runs and pass 2."""
    first = [classify(b) for b in page]
    regions = {b.region for b in page if b.region}
    _runs(page, first, regions)
    for r in regions - {b.region for b, label in zip(page, first, strict=True) if label == GOOD}:
        for i, b in enumerate(page):
            if b.region == r and first[i] == OPEN:
                first[i] = GOOD
    if not any(label == GOOD and b.region for b, label in zip(page, first, strict=True)):
        _runs(page, first, {0})
        if GOOD not in first:
            first = [GOOD if label == OPEN and not b.linked and len(b.text) >= SHORT else label for b, label in zip(page, first, strict=True)]
    out, n = list(first), len(page)
    left, right = [-1] * n, [-1] * n  # nearest decided block of the region
    for side, order in ((left, range(n)), (right, range(n - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in order:
            side[i] = last.get(page[i].region, -1)
            if first[i] == GOOD or first[i] == BAD and _decides(page[i]):
                last[page[i].region] = i
    for i, b in enumerate(page):
        if first[i] != OPEN:
            continue
        a, z = left[i], right[i]
        if a < 0 and z < 0:
            out[i] = BAD
        elif a < 0 or z < 0 or first[a] == first[z]:
            out[i] = first[max(a, z) if a < 0 or z < 0 else a]
        elif i - a != z - i:
            out[i] = first[a if i - a < z - i else z]
        else:
            out[i] = GOOD if b.heading or _stops(b.text) >= FEW_STOPS else BAD
    return out


def _text(page: list[Block]) -> str:
    return "\n\n".join(b.text for b, label in zip(page, labels(page), strict=True) if label == GOOD)


def main_text(html: str | None) -> str:
    """A mark is evidence, not a verdict: where an element that is marked by its
    name, class or role holds most of the page's unlinked text, and the page
    has no text without it or its only article or main element is in it, the
    mark is that of a wrapper and does not count."""
    page, marked = blocks(html or "")
    text = _text(page)
    most = sum(len(b.text) - b.linked for b in page) / 2
    no_region = not any(b.region for b in page)
    wrappers = frozenset(k for k, (n, holds) in marked.items() if n and n >= most and (not text or holds and no_region))
    return _text(blocks(html, wrappers)[0]) if wrappers else text


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text`` of every row."""
    prepare(df.sparkSession)
    keep = list(keep)

    def run(batches):
        for b in batches:
            text = pa.array([main_text(h.as_py()) for h in b.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], text], [*keep, "text"])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    return df.select(*keep, html).mapInArrow(run, schema)
