"""Main text of web pages by line-block distribution.

1. *Lines.* Markup is stripped. Every block ends a line; the start and the end of a container (``div``, ``section``,
   ``ul``, ...) leave a blank line each. Menus, site headers and footers, sidebars, forms, scripts and styles leave one
   blank line, as do elements whose class, id or role says notice, advert, share bar or reader comment.
2. *Distribution.* A line's weight is its text length, or 0 where more than ``LINK_SHARE`` of it is links. Weights are
   summed over a window that slides over the lines. A *dive* is where a whole window weighs nothing, a *surge* where
   the next line with weight starts; the lines between the two are a run. Blank lines of one boundary don't fill a
   window, those of a change of containers do, and so does a list of links.
3. *Choice.* Where ``article`` or ``main`` elements hold most of the weight, lines outside weigh nothing and every run
   inside stays. On other pages a run stays if its greatest window sum is at least ``SURGE`` of the page's greatest.

Everything is one pass over the characters: the time grows in proportion to the page, broken pages included.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, lean

WINDOW = 3
SURGE = 0.25
LINK_SHARE = 0.5

# Elements whose content is no article text, elements that hold blocks, blocks of text, elements without
# content and elements whose content is read as it is, up to their end tag.
DROPPED = frozenset("head title script style noscript template nav header footer aside menu iframe object embed svg canvas button select textarea dialog audio video map math datalist".split())
CONTAINERS = frozenset("article blockquote body center details div dl fieldset figure form hgroup html main ol search section table tbody td tfoot th thead tr ul".split())
BLOCKS = CONTAINERS | frozenset("address br caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li p pre summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification notifications overlay pager pagination popup promo promotion recommended related replies respond searchform share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
STATE_FIRST = frozenset("has with without no is not hide show".split())
STATE_LAST = frozenset("open closed enabled disabled on off active inactive left right none count free".split())
NOISE_ROLE = frozenset("navigation banner complementary contentinfo search form alert dialog menu menubar toolbar".split())

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
QUOTE_OR_END = re.compile(r"[\"'>]")
BLANK = re.compile(r"\s+")


def noise_token(token: str) -> int:
    """How a class or id token names noise: 2 as a word of its own, 1 as the head or tail of a compound, 0 not at all.

    ``has-sidebar`` and ``comments-open`` state something about the whole page and are no noise.
    """
    token = token.lower()
    if token in NOISE:
        return 2
    parts = re.split(r"[-_]+", token)
    if len(parts) < 2 or parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
        return 0
    return int(parts[0] in NOISE or parts[-1] in NOISE)


def _noise(attributes: str) -> int:
    found = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            found = max(found, max(map(noise_token, value.split()), default=0))
        elif name == "role" and value.lower() in NOISE_ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            found = 2
    return found


@dataclass
class _Mark:
    """An element that may be noise: how sure its name is, the marked element around it (-1: none), the length of the
    page's text where it starts and ends, whether it holds an article."""

    sure: int
    outer: int
    begin: int
    end: int = -1
    article: bool = False


@dataclass
class _Lines:
    """The lines of a page: text, length of its links, whether it stands in an article, the marked element around it."""

    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    part: list[str] = field(default_factory=list)
    linked: int = 0
    place: tuple[bool, int] = (False, -1)
    chars: int = 0

    def add(self, raw: str, in_link: bool, place: tuple[bool, int]) -> None:
        if not self.part:
            self.place = place
        self.part.append(raw)
        self.chars += len(raw)
        if in_link:
            self.linked += len(BLANK.sub("", raw))

    def end(self, place: tuple[bool, int], blank: bool = False) -> None:
        text = BLANK.sub(" ", _html.unescape("".join(self.part))).strip() if self.part else ""
        if text:
            self._line(text, self.linked, self.place)
        self.part, self.linked = [], 0
        if blank:
            self._line("", 0, place)

    def _line(self, text: str, linked: int, place: tuple[bool, int]) -> None:
        self.text.append(text)
        self.links.append(linked)
        self.inside.append(place[0])
        self.marks.append(place[1])


def _tag_end(page: str, at: int, quotes: dict[str, int]) -> int:
    """Index behind the ``>`` of the tag whose attributes start at ``at``; a quote that never closes is a plain sign.

    ``quotes`` remembers the last place of each quote sign, so a missing one is looked for once.
    """
    while True:
        found = QUOTE_OR_END.search(page, at)
        if not found:
            return len(page)
        sign = found[0]
        if sign == ">":
            return found.end()
        last = quotes.setdefault(sign, page.rfind(sign))
        at = page.index(sign, found.end()) + 1 if last >= found.end() else found.end()


def lines_of(page: str) -> tuple[_Lines, list[_Mark]]:
    """Strip the markup of a page: its lines, and the elements that may be noise."""
    out, marks, at, n = _Lines(), [], 0, len(page)
    stack: list[tuple[str, bool, bool, int]] = []  # name, dropped, article, mark
    opened: Counter[str] = Counter()
    dropped = article = headed = 0  # open dropped elements, articles, headings within an article's header
    links = False
    around = -1  # the innermost marked element
    quotes: dict[str, int] = {}

    def place() -> tuple[bool, int]:
        return article > 0, around

    def pop() -> None:
        nonlocal dropped, article, around
        name, was_dropped, was_article, mark = stack.pop()
        opened[name] -= 1
        dropped -= was_dropped
        article -= was_article
        if mark >= 0:
            marks[mark].end = out.chars
            around = marks[mark].outer

    while at < n:
        begin = page.find("<", at)
        stop = n if begin < 0 else begin
        if stop > at and (not dropped or headed):
            out.add(page[at:stop], links, place())
        if begin < 0:
            break
        if page.startswith("<!--", begin):
            close = page.find("-->", begin + 4)
            at = n if close < 0 else close + 3
            continue
        found = TAG.match(page, begin)
        if not found:
            if page.startswith(("<!", "<?"), begin):
                close = page.find(">", begin)
                at = n if close < 0 else close + 1
            else:  # a lone sign
                if not dropped:
                    out.add("<", links, place())
                at = begin + 1
            continue
        name, closing = found[1].lower(), page[begin + 1] == "/"
        at = _tag_end(page, found.end(), quotes)
        block = name in BLOCKS or name in DROPPED
        if closing:
            if name == "a":
                links = False
            if name in HEADINGS and headed:
                headed -= 1
                out.end(place())
            if not opened[name]:
                if block and not dropped:
                    out.end(place())
                continue
            if not dropped:
                out.end(place(), blank=name in CONTAINERS)
            was = dropped
            while stack[-1][0] != name:
                pop()
            pop()
            if was and not dropped:
                out.end(place(), blank=True)
            continue
        if name == "a":
            links = True
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            pop()
        attributes = page[found.end() : at - 1]
        if block and not dropped:
            out.end(place(), blank=name in CONTAINERS)
            links = links and name not in CONTAINERS
        if dropped and name in HEADINGS and article and any(s[0] == "header" for s in stack[-4:]):
            headed += 1
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else n
            continue
        main = name in ("article", "main")
        sure = 0 if name in ("html", "body", "main") else _noise(attributes) if attributes.strip(" /") else 0
        if name == "form":
            sure = max(sure, 1)
        if name in VOID or not (block or sure) or attributes.endswith("/") and name not in BLOCKS:
            continue
        gone = name in DROPPED
        if main and not sure and not dropped and around >= 0:
            marks[around].article = True
        mark = -1
        if sure and not gone and not dropped:
            mark = len(marks)
            marks.append(_Mark(sure, around, out.chars))
            around = mark
        if gone and not dropped:
            out.end(place(), blank=True)
        stack.append((name, gone, main, mark))
        opened[name] += 1
        dropped += gone
        article += main
    out.end(place())
    for m in reversed(marks):
        m.end = out.chars if m.end < 0 else m.end
        if m.article and m.outer >= 0:
            marks[m.outer].article = True
    return out, marks


def _quiet(out: _Lines, marks: list[_Mark]) -> list[int]:
    """The lines that are left when noise is out: of each noisy stretch one blank line stays (the index -1)."""
    noise: list[bool] = []
    for m in marks:  # an outer element comes before its inner ones
        own = not m.article and (m.sure == 2 or 2 * (m.end - m.begin) <= out.chars)
        noise.append(own or m.outer >= 0 and noise[m.outer])
    kept: list[int] = []
    for i, around in enumerate(out.marks):
        if around < 0 or not noise[around]:
            kept.append(i)
        elif kept and kept[-1] != -1:
            kept.append(-1)
    return kept


def runs_of(weights: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Runs [start, end) between surge and dive points, with the greatest window sum of each.

    A surge is a line with weight whose window of lines before it weighs nothing; a dive is the line after which a
    whole window weighs nothing.
    """
    heavy = np.flatnonzero(weights)
    if not len(heavy):
        return []
    sums = np.convolve(weights, np.ones(window, dtype=np.int64))  # sums[i]: lines i - window + 1 .. i
    new = np.concatenate([[True], np.diff(heavy) > window])
    starts = heavy[new]
    ends = np.concatenate([heavy[:-1][new[1:]], heavy[-1:]]) + 1
    return [(a, b, int(sums[a : b + window - 1].max())) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The article text of one page; empty for null, empty and textless pages."""
    if not page:
        return ""
    out, marks = lines_of(page)
    lines = _quiet(out, marks)
    if not lines:
        return ""
    size = np.array([len(out.text[i]) if i >= 0 else 0 for i in lines], dtype=np.int64)
    linked = np.array([out.links[i] if i >= 0 else 0 for i in lines], dtype=np.int64)
    inside = np.array([i >= 0 and out.inside[i] for i in lines], dtype=bool)
    weights = np.where(linked > LINK_SHARE * size, 0, size)
    articled = 2 * weights[inside].sum() >= weights.sum()
    if inside.any() and articled:
        weights = np.where(inside, weights, 0)
        least = 0.0
    else:
        inside[:] = True
        least = SURGE * max((peak for _, _, peak in runs_of(weights, window)), default=0)
    chosen = [k for a, b, peak in runs_of(weights, window) if peak >= least for k in range(a, b) if inside[k]]
    return " ".join(out.text[lines[k]] for k in chosen if lines[k] >= 0 and out.text[lines[k]])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), text_col: str = "text") -> DataFrame:
    """Main text of every page: ``id_col``, the columns of ``keep``, ``text_col`` and ``n_chars``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order
    by one space. One map over the input, no shuffle. Of a ``header`` within an article the headings stay, byline and
    buttons go.

    Edge cases: null and empty pages give the empty text, as do pages without any; very long and broken pages (open
    quotes, end tags without a start, thousands of open elements) are read whole, in time proportional to their
    length. Nothing depends on ids, so repeated and null ids are allowed. Columns not named are ignored.
    """
    bounded_batches(pages.sparkSession)
    columns = [id_col, *keep]
    fields = ", ".join(f"`{n}` {t}" for n, t in pages.select(*columns).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p.as_py()) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*columns, text_col, "n_chars"])

    return pages.select(*columns, F.col(html_col).cast("string").alias("__siltstone_html")).mapInArrow(lean(run), f"{fields}, `{text_col}` string, n_chars long")
