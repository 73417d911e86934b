"""Main text of HTML pages by the distribution of text over lines.

Markup is stripped to lines: one per block of text, in page order. Text lengths are summed
over windows of neighbouring lines; where the sum rises over ``SURGE``, text surges, and
where the lines of a window are all under ``DIVE``, it dives. All stretches from a surge to
its dive are kept, short lines inside them too; lines under ``DIVE`` at their ends are not.

The length of a line is that of its text outside links (a main heading may be a link);
short lines of paragraphs, list items and the like count as ``DIVE``. Only elements that
never hold the article (menus, headers, footers, sidebars, forms, scripts, styles) count as
empty whatever they say. Everything else weighs: a line outside the page's article or main
element counts an eighth, and so does one inside a box whose class or id sounds like an
advert, notice or comment; what is left of it must still reach ``DIVE`` and an eighth of the
page's longest line, else it lies in the dive. Marks and names that the page's text does not
bear out (a teaser marked as an article, a story in a box called "related") weigh nothing.
Inside a kept stretch a box of such a name goes if it is short against the stretch. What
never is the article does not end the text inside an article. A page whose windows are all
short surges at half its longest one; without any line of ``DIVE`` all lines but the empty
ones count as they are.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by one space. Null and empty pages have an empty text; a page of any length and depth
is read in one pass.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pultwerk.llm.common import spare, whole_text

WINDOW, SURGE, DIVE = 3, 80, 16
# what text outside the article, or in a box of a suspicious name, counts; the share of the
# page's text from which marks and unsuspicious boxes count at all, and of a stretch up to
# which such a box goes
PART, SHARE = 8, 4

# fixed values: element names and words of class and id attributes
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_APART = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
_BLOCKS -= {"br"}
_HEADINGS = {"h1", "h2"}
_PROSE = _HEADINGS | {"h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "td", "th", "blockquote", "pre", "caption", "figcaption"}
_APART_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pagination", "popup", "promo",
    "promoted", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}

_APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<loose>/?[a-zA-Z][^>]*+>)|[!?/][^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_TARGET = re.compile(r"\bhref\s*+=", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _is_apart(name: str, rest: str, marked: bool) -> bool:
    """Whether an element never holds the article; inside it, a header holds the headline."""
    if name in _APART and not (marked and name == "header"):
        return True
    return "=" in rest and any(kind.lower() == "role" and "".join(values).lower() in _APART_ROLES for kind, *values in _ATTRIBUTE.findall(rest))


def _is_suspicious(name: str, rest: str, marked: bool) -> bool:
    """Whether an element's class or id sounds like something beside the article."""
    if "=" not in rest or name in {"html", "body", "main"}:
        return False
    for kind, *values in _ATTRIBUTE.findall(rest):
        for one in () if kind.lower() == "role" else "".join(values).split():
            # "with-sidebar" tells about the page, not about the element
            found = [w.lower() for w in _WORD.findall(one)]
            if found and found[0] not in {"has", "is", "no", "with", "without"} and not _APART_WORDS.isdisjoint(found) and not (marked and "header" in found):
                return True
    return False


class Line(NamedTuple):
    """A block's text, the length of it that counts, and where it stands: apart if inside an
    element that is never the article, marked if inside an article or main element, in the
    box of a suspicious name with that number (0: in none)."""

    text: str
    length: int
    apart: bool
    marked: bool
    in_article: bool
    box: int = 0
    title: bool = False


def lines_of(page: str) -> list[Line]:
    out: list[Line] = []
    parts: list[str] = []
    plain: list[str] = []
    open_: list[tuple[str, bool, bool, bool]] = []
    apart = marked = articles = inside = boxes = box = in_boxes = 0
    linked, block = False, ""
    at = 0

    def add(text: str) -> None:
        parts.append(text)
        if not linked or block in _HEADINGS:
            plain.append(text)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                length = len(text) if len(plain) == len(parts) else len(" ".join(entities.unescape("".join(plain)).split()))
                if length and block in _PROSE:
                    length = max(length, DIVE)
                out.append(Line(text, length, apart > 0, marked > 0, articles > 0, box if in_boxes else 0, block == "h1"))
            parts.clear()
            plain.clear()

    while tag := _TAG.search(page, at):
        if tag.start() > at:
            add(page[at: tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if tag["loose"]:
            name = re.match(r"/?([a-zA-Z][^\s/>]*)", tag["loose"])[1].lower()
        if not name:
            continue
        closing = tag["close"] or (tag["loose"] or "").startswith("/")
        if name == "br":
            add(" ")
            continue
        if name in _BLOCKS:
            flush()
            block = "" if closing else name
            # a link that is left open ends with the block it stands in
            inside += -1 if closing else 1
            linked = linked and inside >= 0
        if name == "a":
            linked, inside = not closing and bool(_TARGET.search(tag["rest"] or "")), 0
        if closing:
            if any(o[0] == name for o in open_):
                while True:
                    was, its_apart, its_mark, its_box = open_.pop()
                    if was in _BLOCKS:
                        flush()
                    apart -= its_apart
                    marked -= its_mark
                    articles -= its_mark and was == "article"
                    in_boxes -= its_box
                    if was == name:
                        break
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        its_apart = _is_apart(name, tag["rest"] or "", marked > 0)
        its_mark = name in {"article", "main"} and not its_apart
        its_box = not its_apart and _is_suspicious(name, tag["rest"] or "", marked > 0)
        if (its_apart or its_box) and name not in _BLOCKS:
            flush()
        # only elements that count are kept open; text ends at the next block anyway
        if its_apart or its_mark or its_box or name in _BLOCKS and name not in {"p", "li", "dt", "dd", "tr", "td", "th", "option"}:
            open_.append((name, its_apart, its_mark, its_box))
            # boxes inside a box belong to the outer one
            if its_box and not in_boxes:
                boxes += 1
                box = boxes
            in_boxes += its_box
            apart += its_apart
            marked += its_mark
            articles += its_mark and name == "article"
    add(page[at:])
    flush()
    return out


def stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> list[tuple[int, int]]:
    """(first line, line behind the last) of every stretch from a surge to its dive."""
    sums = [sum(n for n in lengths[i: i + window] if n >= dive) for i in range(len(lengths))]
    surge = min(surge, max(sums, default=0) // 2 + 1)
    out, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        end = i
        while end < len(sums) and sums[end]:
            end += 1
        if max(sums[i:end]) >= surge:
            out.append((i, end))
        i = end
    return out


def weights(lines: list[Line]) -> list[int]:
    """Lengths of the lines as surge and dive see them."""
    total = lambda kept: sum(line.length for line in lines if not line.apart and kept(line))
    everything = total(lambda line: True)
    # a mark, and a name, must be borne out by the text that it sets apart
    by_mark = SHARE * total(lambda line: line.marked) >= everything
    by_name = SHARE * total(lambda line: not line.box or line.title) >= everything
    parts = [(PART if by_mark and not line.marked else 1) * (PART if by_name and line.box and not line.title else 1) for line in lines]
    peak = max((line.length for line, part in zip(lines, parts) if part == 1 and not line.apart), default=0)
    out = []
    for line, part in zip(lines, parts):
        left = line.length // part
        if line.apart or part > 1 and left < max(DIVE, peak // PART):
            left = 0
        # a box inside an article does not end it
        out.append(max(left, DIVE) if line.in_article and (line.apart or line.box) else left)
    return out


def main_text(page: str) -> str:
    lines = lines_of(page)
    lengths, dive = weights(lines), DIVE
    if not any(n >= dive for n, line in zip(lengths, lines) if not line.apart):
        named = all(line.box for line in lines if not line.apart)
        lengths, dive = [0 if line.apart or line.box and not named else len(line.text) for line in lines], 1
    kept: list[Line] = []
    for first, end in stretches(lengths, dive=dive):
        solid = [i for i in range(first, end) if lengths[i] >= dive and not lines[i].apart]
        if solid:
            mine = [line for line in lines[solid[0]: solid[-1] + 1] if not line.apart]
            sizes: dict[int, int] = {}
            for line in mine:
                sizes[line.box] = sizes.get(line.box, 0) + len(line.text)
            whole = sum(sizes.values())
            kept += [line for line in mine if not line.box or line.title or SHARE * sizes[line.box] >= whole]
    return " ".join(line.text for line in kept)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns but the page itself, with ``text``."""
    kept = [c for c in pages.columns if c not in {html, "text"}]
    rows = pages.select(*kept, whole_text(html).alias(spare(kept, "page")))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "text string"])

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(run, schema)
