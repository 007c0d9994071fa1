"""Main-text extraction by line-block distribution.

Markup is stripped so that each block element starts a new line, and a removed region (menus, headers and footers,
sidebars, adverts, forms, comments) leaves a gap of empty lines; what is never shown, such as scripts, leaves none. The
length of text outside links in a sliding window of lines surges where the main text begins and dives where it ends: all
between the first surge and the last dive is the text, with the headings and short paragraphs that adjoin it. Where a page
marks its article, the windows run over the article.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame

from kinetable.llm.common import annotated

#: Lines of a window, and empty lines that a removed region leaves, so that windows never reach across one.
WINDOW = GAP = 3
#: Windows of so many characters outside links are main text; where a page has none, its fullest ones are.
SURGE = 80

_BREAKS = frozenset(
    "address article blockquote body br center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr "
    "html li main ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_REMOVED = frozenset(
    "aside button canvas datalist embed footer form head header iframe input map math menu nav noscript object option "
    "script select style svg template textarea title video audio".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Removed elements that show nothing or are drawn inside a line: they leave no gap.
_UNSEEN = frozenset("datalist head input map math noscript script style svg template title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: a short one next to the main text belongs to it, where a bare div may be a menu or a notice.
_PROSE = _HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption".split())
_REGION = (
    "ad|ads|advert|adverts|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|complementary|consent|cookie|cookies|disqus|"
    "footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|related|replies|respond|"
    "search|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget")
#: A whole class, id or role that names a region beside the main text, with words of place before it and of kind after it.
#: Other words make it something else: ``has-sidebar`` is a layout, ``entry-header`` a part of the text.
_ASIDE = re.compile(
    rf"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|sticky|mobile|sub|{_REGION})[_-]+)*(?:{_REGION})"
    r"(?:[_-]+(?:area|author|bar|block|body|card|entry|meta|teaser|teasers|thread|box|button|buttons|container|content|form|holder|icons|inner|item|items|left|right|top|bottom|"
    r"link|links|list|main|menu|panel|primary|secondary|section|slot|text|title|unit|widget|wrap|wrapper|posts|articles|stories|"
    rf"{_REGION}))*(?:[_-]*\d[\w-]*)?", re.I)
#: Regions that never hold a page's own article.
_FOREIGN = re.compile(r"(?:ad|ads|advert|adverts|advertisement|comment|comments|disqus|promo|related|replies|respond|sponsor|sponsored)(?![a-z])", re.I)
_BLANKS = re.compile(r"\s+")
#: Elements whose content is text up to their own end tag.
_RAW = frozenset("script style textarea title noscript iframe".split())
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.I | re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class _Line(NamedTuple):
    text: str
    #: Characters outside links.
    plain: int
    #: 0 outside what the page marks, -1 in ``main``, else the number of the outermost ``article``.
    marked: int
    #: The block element that the text stands in, its number and that of the element around it.
    tag: str
    block: int
    parent: int


_GAP = _Line("", 0, 0, "", -1, -1)


class _Open(NamedTuple):
    tag: str
    gone: bool
    #: Removed for its class, id or role: 1, or 2 where that says that the page's own article cannot be inside.
    named: int
    number: int


class _Page:
    """Lines of text of a page and their lengths outside links; a removed region leaves ``GAP`` empty lines.

    Where the page marks its article (``article`` or ``main``), all outside it counts as removed, and a region removed
    inside it leaves no gap. Unclosed tags end with what encloses them; stray end tags end a line and nothing else.
    ``unwrap``: elements that enclose an article are not removed for their names.
    """

    def __init__(self, html: str, unwrap: bool = False):
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.plain = self.started = 0
        #: Open elements; where those of a tag, and those that break lines, stand among them.
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        #: Numbers of open elements that are removed, that are removed by name, and that are foreign.
        self.hidden = self.named = self.foreign = 0
        self.articles = self.numbered = self.mains = self.links = self.headings = 0
        self.unwrap, self.wrapped, self.titled = unwrap, False, False
        at = 0
        while m := _TAG.search(html, at):
            self._text(html[at: m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._close(tag)
                continue
            attrs = m[3] or m[6] or ""
            self._start(tag, attrs)
            if tag in _RAW and not attrs.endswith("/"):
                end = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
                if tag not in _REMOVED:
                    self._text(html[at: end.start() if end else len(html)])
                at = end.end() if end else len(html)
                self._close(tag)
        self._text(html[at:])
        self._end_line()

    def _text(self, data: str) -> None:
        if data and not self.hidden:
            data = unescape(data) if "&" in data else data
            self.parts.append(data)
            if not self.links:
                self.plain += len(data)

    def _end_line(self) -> None:
        text = _BLANKS.sub(" ", "".join(self.parts)).strip()
        if text:
            own = self.open[self.blocks[-1]] if self.blocks else None
            around = self.open[self.blocks[-2]] if len(self.blocks) > 1 else None
            marked = self.numbered if self.articles else -1 if self.mains else 0
            self.lines.append(_Line(text, min(self.plain, len(text)), marked, own.tag if own else "", own.number if own else 0, around.number if around else 0))
        self.parts.clear()
        self.plain = 0

    def _shown(self) -> None:
        """Open elements that were removed for their names are shown from here on."""
        self.open = [x._replace(gone=False, named=0) if x.named else x for x in self.open]
        self.hidden -= self.named
        self.named = self.foreign = 0

    def _start(self, tag: str, attrs: str) -> None:
        inside = self.articles or self.mains
        if tag in ("article", "main") and self.hidden and not inside and self.hidden == self.named and not self.foreign:
            self.wrapped = True
            if self.unwrap:
                self._shown()
        if tag == "h1" and inside and not self.titled:
            # What encloses the heading of the marked article is no region beside it.
            if self.hidden and self.hidden == self.named and not self.foreign:
                self._shown()
            self.titled = not self.hidden
        gone = tag in _REMOVED and not (tag == "header" and inside)
        named = 0
        if not gone and attrs and tag not in ("html", "body", "main") and not (inside and (self.headings or tag in _HEADINGS or tag == "header")):
            names = [name for _, a, b, c in _ATTR.findall(attrs) for name in (a or b or c).split() if _ASIDE.fullmatch(name)]
            foreign = any(map(_FOREIGN.search, names))
            # An outermost article may be called a widget or a main section; a comment or a teaser is another's.
            named = 2 if foreign else int(bool(names) and (tag != "article" or bool(inside)))
            gone = named > 0
        if not self.hidden and (gone and tag not in _UNSEEN or tag in _BREAKS):
            self._end_line()
        if gone and not self.hidden and not inside and tag not in _UNSEEN:
            self.lines += [_GAP] * GAP
        if tag in _VOID or attrs.endswith("/") and tag not in _BREAKS:
            return
        self.started += 1
        if tag == "article" and not self.articles:
            self.numbered += 1
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in _BREAKS:
            self.blocks.append(len(self.open))
        self.open.append(_Open(tag, gone, named, self.started))
        self._count(self.open[-1], 1)

    def _count(self, x: _Open, by: int) -> None:
        self.hidden += by * x.gone
        self.named += by * (x.named > 0)
        self.foreign += by * (x.named > 1)
        self.articles += by * (x.tag == "article")
        self.mains += by * (x.tag == "main")
        self.links += by * (x.tag == "a")
        self.headings += by * (x.tag in _HEADINGS)

    def _close(self, tag: str) -> None:
        if tag in _BREAKS and not self.hidden:
            self._end_line()
        # Known places, not a walk: a page may have any number of stray end tags.
        at = (self.places.get(tag) or [-1])[-1]
        if at < 0 or tag == "p" and self.blocks[-1] > at:
            return
        while len(self.open) > at:
            x = self.open.pop()
            self.places[x.tag].pop()
            if x.tag in _BREAKS:
                self.blocks.pop()
            self._count(x, -1)


def _text_like(line: _Line) -> bool:
    return line.tag in _PROSE and 2 * line.plain > len(line.text)


def _span(lines: list[_Line]) -> tuple[int, int]:
    """First line of the main text and the line after its last: the first surge, the last dive, and what adjoins them."""
    lengths = [x.plain for x in lines] + [0] * WINDOW
    sums = [sum(lengths[i: i + WINDOW]) for i in range(len(lines))]
    surge = min(SURGE, max(sums, default=0))
    if not surge:
        return 0, len(lines)
    full = [i for i, n in enumerate(sums) if n >= surge]
    first, last = full[0], min(full[-1] + WINDOW, len(lines))
    # Short lines at either edge of the outermost windows did not make them full.
    while sum(lengths[first + 1: full[0] + WINDOW]) >= surge:
        first += 1
    while sum(lengths[full[-1]: last - 1]) >= surge:
        last -= 1
    blocks = {x.block for x in lines[first:last] if x.text}
    parents = {x.parent for x in lines[first:last] if x.text and x.parent}
    for step in (-1, 1):
        at, gap = (first - 1 if step < 0 else last), False
        while 0 <= at < len(lines):
            x = lines[at]
            if not x.text:
                gap = True
            elif _text_like(x) and (not gap or x.parent in parents or step < 0 and x.tag in _HEADINGS) or not gap and x.block in blocks and 2 * x.plain > len(x.text):
                first, last = min(first, at), max(last, at + 1)
            else:
                break
            at += step
    return first, last


def _surges(lines: list[_Line]) -> bool:
    return any(sum(x.plain for x in lines[i: i + WINDOW]) >= SURGE for i in range(len(lines)))


def _of_article(lines: list[_Line]) -> list[_Line]:
    """What the page marks as its article, or all, where it marks none or only what is small beside the rest.

    Of several articles the largest counts, and such as are half as large: the others are teasers of other pages.
    """
    sizes: dict[int, int] = {}
    for x in lines:
        sizes[x.marked] = sizes.get(x.marked, 0) + x.plain * (x.marked != 0 or _text_like(x))
    articles = {k: n for k, n in sizes.items() if k > 0}
    rest = [x for x in lines if x.marked <= 0]
    if not articles:
        return [x for x in lines if x.marked] or lines
    largest = max(articles.values())
    if -1 in sizes and sizes[-1] > 2 * largest:
        return [x for x in lines if x.marked < 0]
    if sizes.get(0, 0) > 2 * largest and _surges(rest):
        return rest
    return [x for x in lines if x.marked > 0 and 2 * articles[x.marked] >= largest]


def main_text(html: str | None) -> str:
    """Lines from the first surge to the last dive of the article, or of the page where none is marked, joined by line feeds."""
    if not html:
        return ""
    page = _Page(html)
    lines = page.lines
    # A last resort: the page's only text is in an article that stands in a region named as if it were none.
    if page.wrapped and not any(x.marked for x in lines) and not _surges(lines):
        lines = _Page(html, unwrap=True).lines
    lines = _of_article(lines)
    first, last = _span(lines)
    return "\n".join(x.text for x in lines[first:last] if x.text)


def extracted(df: DataFrame, html: str = "html") -> DataFrame:
    """Columns ``row`` (all of ``df``) and ``main_text``, one row for each row of ``df``.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by line feeds
    in page order. Null, empty and textless pages give an empty text. Whole pages are read, of any length. Rows are judged
    alone, so repeated pages come out alike. An empty table gives an empty result, and columns of ``df`` stay inside ``row``,
    where names cannot clash.
    """
    return annotated(df, lambda: lambda pages: [[main_text(p) for p in pages]], html, "main_text string")
