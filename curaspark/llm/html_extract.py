"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Menus, adverts, notices, forms, comments and the like lose their
text at this step but stay as empty lines. The lengths of the remaining texts are summed over sliding windows of WINDOW lines:
the text of a page begins where the sums surge and ends where they dive to nothing, and what lies between is kept.

- If the page marks its article (``article``, or else ``main``), lines outside of it count as empty, and every surge inside
  belongs to the article, however small. Reader comments and teasers that are articles by name are not meant.
- A form that marks an article or main part, or has more paragraphs than fields, wraps the page and is no form to fill in.
- Otherwise lines that are mostly link text count as empty, a surge must reach a share of what a window of short paragraphs
  sums to, and every stretch with a paragraph is kept. Stretches with no links between them are one, whatever was dropped there.

Null, empty and text-free pages give the empty string. Cut-off pages keep what came before the cut; an unfinished tag
is dropped. Work is proportional to the page; rows are read where they lie and repeated rows repeat.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import DataFrame

from curaspark.llm.common import per_row

WINDOW = 3
#: Share of the sum of a window of short paragraphs that a surge must reach when no article is marked.
SURGE = 0.1
#: Characters from which a line counts as a paragraph, if the page has such lines; else its longest lines do.
PARAGRAPH = 80
#: A line counts as a menu if link text makes up at least this share of it.
LINK_SHARE = 0.6

# Element names of the HTML standard and usual names of page parts.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead title tr ul".split()
)
_DROPPED = frozenset("head title nav footer aside form menu select option button textarea noscript template iframe object svg canvas dialog audio video".split())
_RAW = frozenset("script style xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs comment comments disqus replies reply respond cookie cookies consent gdpr notice notices notification alert"
    " popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations footer"
    " header masthead toolbar pagination pager copyright disclaimer skip widget widgets form search".split()
)
_OWN = frozenset("article entry post story content main".split())
_SMALL_ARTICLES = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo teaser related".split())
_NEGATIONS = frozenset("no has with without".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[A-Za-z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _is_part(name: str, rest: str, inside: bool) -> bool:
    """Whether an element is no content of the page, by its name or by what its attributes call it."""
    if name in _DROPPED or (name == "header" and not inside):
        return True
    if not rest or name in ("html", "body", "main"):
        return False
    usual = _SMALL_ARTICLES if name == "article" else _PARTS
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in _ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id"):
            for label in value.split():
                parts = set(re.split(r"[^a-z]+", label))
                named = parts & usual
                if named and not parts & _NEGATIONS and not (named <= {"header", "form", "search"} and parts & _OWN):
                    return True
    return False


_FORM_END = re.compile(r"</form\b", re.I)
_CONTENT = re.compile(r"<(?:article|main|p)\b", re.I)
_FIELD = re.compile(r"<(?:input|select|textarea|button|option|label)\b", re.I)


class _Forms:
    """Tells forms that hold the page from forms to fill in, by what stands before their end. Positions are found once a page."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.ends: list[int] | None = None

    def wraps(self, at: int) -> bool:
        """Whether the form that opens before ``at`` marks an article or main part, or has more paragraphs than fields."""
        if self.ends is None:
            self.ends = [m.start() for m in _FORM_END.finditer(self.page)]
            self.content = [m.start() for m in _CONTENT.finditer(self.page)]
            self.marked = [m for m in self.content if self.page[m + 1] in "amAM"]
            self.fields = [m.start() for m in _FIELD.finditer(self.page)]
        i = bisect_left(self.ends, at)
        end = self.ends[i] if i < len(self.ends) else len(self.page)

        def count(places: list[int]) -> int:
            return bisect_left(places, end) - bisect_left(places, at)

        return count(self.marked) > 0 or count(self.content) > max(2, count(self.fields))


def page_lines(page: str | None) -> list[tuple[str, int, int]]:
    """Lines of a page as (text, characters of link text, place): 2 inside an article, 1 inside the main part only, 0 else.

    Lines without text stand for page parts that were dropped.
    """
    lines: list[tuple[str, int, int]] = []
    if not page:
        return lines
    buffer: list[str] = []
    at, links, in_link = 0, 0, False
    dropped, depth = "", 0  # the element being dropped, and how many of its name are open within
    inside = {"article": 0, "main": 0}
    forms = _Forms(page)

    def place() -> int:
        return 2 if inside["article"] else 1 if inside["main"] else 0

    def end_line() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                lines.append((text, links, place()))
        links = 0

    while True:
        m = _TAG.search(page, at)
        if not dropped and (piece := page[at : m.start() if m else len(page)]):
            piece = html.unescape(piece)
            buffer.append(piece)
            if in_link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, rest = bool(m["close"] or m["close2"]), m["rest"] or m["rest2"] or ""
        if name in _RAW:
            if not closing and not rest.endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if name in inside and not closing and dropped and not re.compile(rf"</{dropped}\b", re.I).search(page, at):
            dropped = ""  # what is dropped was never closed, and the article is not part of it
        if name in inside and not dropped and not (not closing and _is_part(name, rest, False)):
            end_line()
            inside[name] = max(0, inside[name] + (-1 if closing else 1))
            continue
        if dropped:
            if name == dropped:
                depth += -1 if closing else (name not in _VOID and not rest.endswith("/"))
            if depth == 0 or (closing and name in ("body", "html")):
                dropped = ""
            elif dropped == "head" and name == "body":
                dropped = ""
            continue
        if name in _BLOCKS:
            end_line()
        elif name == "br":
            buffer.append(" ")
        if name == "a":
            in_link = not closing
        if name == "form" and not closing and forms.wraps(at):
            continue
        if not closing and name not in _VOID and not rest.endswith("/") and _is_part(name, rest, place() > 0):
            if name in _BLOCKS or not buffer:
                end_line()
                lines.append(("", 0, place()))
            dropped, depth = name, 1
    end_line()
    return lines


def text_stretch(lengths: list[int], surge: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches (from, to) of lines between a surge and the dive that follows it.

    A line's sum is that of the window it begins. A surge is a line with text whose sum is above ``surge``; the dive is
    the first line after it whose whole window is empty.
    """
    n = len(lengths)
    sums, run = [0] * n, 0
    for i in range(n - 1, -1, -1):
        run += lengths[i] - (lengths[i + window] if i + window < n else 0)
        sums[i] = run
    out, i = [], 0
    while i < n:
        if lengths[i] and sums[i] > surge:
            j = i
            while j < n and sums[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def main_blocks(page: str | None, window: int = WINDOW) -> list[str]:
    """The blocks of a page's main text in page order."""
    lines = page_lines(page)
    marked = max((place for text, _, place in lines if text), default=0)
    if marked:
        lengths = [len(t) if place == marked else 0 for t, _, place in lines]
        stretches = text_stretch(lengths, 0, window)
    else:
        lengths = [0 if links >= LINK_SHARE * len(t) else len(t) for t, links, _ in lines]
        paragraph = min(PARAGRAPH, max(lengths, default=0))
        stretches = []
        for a, b in text_stretch(lengths, SURGE * window * paragraph - 1, window):
            gap = range(stretches[-1][1], a) if stretches else ()
            if stretches and not any(lines[i][0] and not lengths[i] for i in gap):
                stretches[-1] = (stretches[-1][0], b)  # only dropped parts and short lines lie between
            else:
                stretches.append((a, b))
        stretches = [(a, b) for a, b in stretches if max(lengths[a:b]) >= paragraph]
    return [lines[i][0] for a, b in stretches for i in range(a, b) if lengths[i]]


def extract_text(df: DataFrame, keys: Sequence[str] = ("page_id",), page: str = "html", window: int = WINDOW) -> DataFrame:
    """(keys, blocks array<string>): the blocks of the main text of every page, beside its key columns."""
    keys = list(keys)

    def run(*values):
        return dict(zip(keys, values)) | {"blocks": main_blocks(values[-1], window)}

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return per_row(df, [*keys, page], run, f"{schema}, blocks array<string>")
