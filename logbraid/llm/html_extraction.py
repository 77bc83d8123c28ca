"""Main text of web pages by the distribution of text over lines.

A page is cut into lines at block tags; markup, scripts and styles go. A line's weight is its text outside links. The sum of
weights over a sliding window of lines surges where the main text begins and dives to zero where it ends; all lines in
between stay. What the page itself marks weighs nothing and is never kept: menus, footers, forms, adverts and the
like. Each line of an article that the page marks weighs half a surge more; lines outside weigh what they weigh on any page.
Neither counts in the other's windows.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbraid.llm.arrow_text import slices

#: Lines of a window, and the weight of a window where text surges: this much, or a share of the heaviest window if that is less.
WINDOW, SURGE, SURGE_SHARE = 3, 86, 0.2
#: What the mark of an article adds to a line, as a share of the surge: two lines surge by it, one short line alone does not.
ARTICLE_BONUS = 0.5

def _markup(quoted: str) -> re.Pattern:
    """Markup: `open` is there if a comment or script has no end, `torn` if a tag ends at its first `>` as its quotes do not close."""
    return re.compile(
        r"<!--(?:-?>|.*?(?:--!?>|(?P<open>$)))"
        r"|<(?P<raw>script|style)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|(?P<open_raw>$))"
        rf"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>{quoted}|(?P<torn>[^>]*))>"
        r"|<[!?][^>]*>",
        re.I | re.S,
    )


_MARKUP = _markup(r"""(?:[^>"']|"[^"]*"|'[^']*')*+""")
#: On a page with quotes that do not close: a quoted value holds no `<`.
_TORN_MARKUP = _markup(r"""(?:[^<>"']|"[^"<]*"|'[^'<]*')*+""")


def _tags(page: str) -> tuple[list[re.Match], int, int]:
    """All markup, and where the text behind it begins and ends. Linear in the page: no tag begins behind the last `>`, and a tag is looked for to the end of the
    page in vain only once."""
    last, at, pattern, found = page.rfind(">") + 1, 0, _MARKUP, []
    while at < last and (m := pattern.search(page, at, last)):
        found.append(m)
        at = m.end()
        if m["open"] is not None or m["open_raw"] is not None:
            return found, len(page), len(page)
        if m["torn"] is not None:
            pattern = _TORN_MARKUP
    comment = page.find("<!--", at)
    return found, at, comment if comment >= 0 else len(page)


_P, _LI, _DD, _OPTION, _CELL, _ROW, _ROWS = range(7)
#: Elements whose end tag may be left out, what ends them, and what hides those outside it.
_OPEN = {"p": _P, "li": _LI, "dt": _DD, "dd": _DD, "option": _OPTION, "td": _CELL, "th": _CELL, "tr": _ROW, "thead": _ROWS, "tbody": _ROWS, "tfoot": _ROWS}
_ENDS = {
    **dict.fromkeys(
        "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
        "ol p pre search section summary table ul".split(), (_P,),
    ),
    "li": (_LI, _P), "dt": (_DD, _P), "dd": (_DD, _P), "option": (_OPTION,), "optgroup": (_OPTION,), "td": (_CELL,), "th": (_CELL,),
    "tr": (_ROW, _CELL), "thead": (_ROWS, _ROW, _CELL), "tbody": (_ROWS, _ROW, _CELL), "tfoot": (_ROWS, _ROW, _CELL),
}
_HIDES = {
    "table": range(7), **dict.fromkeys(("td", "th", "caption"), (_P, _LI, _DD, _OPTION)), **dict.fromkeys(("button", "object", "template"), (_P,)), "select": (_OPTION,),
    **dict.fromkeys("ul ol menu dl section article aside nav main blockquote figure form fieldset header footer details".split(), (_LI, _DD)),
}
#: Content that is not text, if it has an end tag of its own.
_SKIPPED = frozenset("noscript template svg iframe object canvas math title".split())
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea "
    "tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OTHER = frozenset("nav footer aside form menu dialog button select textarea option label title".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_OTHER_WORD = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar|footer|masthead|breadcrumbs?|cookies?|consent|"
    r"notices?|disclaimer|alert|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|disqus|respond|"
    r"repl(?:y|ies)|login|signup|search|toolbar|pager|pagination|widgets?|copyright|header)"
)
_OTHER_NAME = re.compile(rf"(?:^|[-_\s]){_OTHER_WORD}(?:$|[-_\s])", re.I)
#: Inside an article a class is a name as a whole: words of the list, and words for a piece of a page. Ids there are mostly slugs of headings.
_PIECE = r"(?:block|box|bar|body|unit|slot|list|item|card|area|form|buttons?|links?|icons?|posts?|articles?|stories)"
_OTHER_CLASS = re.compile(rf"{_OTHER_WORD}(?:[-_]+(?:{_OTHER_WORD}|{_PIECE}))*", re.I)
_OTHER_ID = re.compile(r"side-?bar|nav-?bar|masthead|breadcrumbs?|disqus(?:[-_]thread)?", re.I)
_COMMENT_CLASS = re.compile(rf"(?:comments?|disqus|respond|repl(?:y|ies)|related|teaser)(?:[-_]+(?:comments?|related|{_PIECE}))*", re.I)
_COMMENTS = re.compile(r"(?:^|[-_\s])(?:comments?|disqus|respond|repl(?:y|ies)|related|teaser)(?:$|[-_\s])", re.I)
_WRAPPER = re.compile(r"(?:^|[-_\s])(?:content|article|main|post|entry|story|page|wrap(?:per)?|container|layout|with|has)(?:$|[-_\s])", re.I)
_ARTICLE_NAME = re.compile(r"(?:^|\s)(?:article-?body|post-?body|entry-?content|article-?content|post-?content|story-?body|main-?content)(?:$|\s)", re.I)


def _roles(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(is it something else than main text, does it mark the article)."""
    found = {}
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), value.strip("\"'"))
    names = f"{found.get('class', '')} {found.get('id', '')}"
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    classes = found.get("class", "").split()
    if tag in ("html", "body"):
        return False, False
    if tag in ("article", "main") or role in ("main", "article"):
        other = hidden or (any(_COMMENT_CLASS.fullmatch(c) or c.lower().endswith("teaser") for c in classes) if in_article else bool(_COMMENTS.search(names)))
        return other, not other
    other = hidden or tag in _OTHER or role in _OTHER_ROLES or (tag == "header" and not in_article)
    if in_article:
        other = other or bool(_OTHER_ID.fullmatch(found.get("id", ""))) or any(_OTHER_CLASS.fullmatch(c) and "header" not in c.lower() for c in classes)
    elif names.strip() and not other and _OTHER_NAME.search(names):
        other = not _WRAPPER.search(names) or bool(_COMMENTS.search(names))
    return other, not other and (bool(_ARTICLE_NAME.search(names)) or found.get("itemprop", "").lower() == "articlebody")


def _skips(tags: list[re.Match]) -> dict[int, int]:
    """Of each start tag of _SKIPPED that has an end tag, the number of that end tag."""
    opened, ends = {}, {}
    for i, m in enumerate(tags):
        tag = (m["tag"] or "").lower()
        if tag not in _SKIPPED:
            continue
        if m["end"]:
            if opened.get(tag):
                ends[opened[tag].pop()] = i
        elif not (tag in ("svg", "math") and m[0].endswith("/>")):
            opened.setdefault(tag, []).append(i)
    return ends


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside the article) of each line with main text; a line of something else is empty."""
    lines, words, at = [], [], 0
    stack: list[tuple[str, bool, bool, list[int]]] = []
    names: Counter[str] = Counter()  # open elements
    #: Where in the stack the last open element of each kind of _OPEN is, or -1.
    opened = [-1] * 7
    other = article = links = 0
    linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            words.append(unescape(raw))
            if links:
                linked += len(words[-1].strip())

    def end_line() -> None:
        nonlocal linked
        line = " ".join("".join(words).split())
        if line:
            lines.append(("", 0, article > 0) if other else (line, max(0, len(line) - linked), article > 0))
        words.clear()
        linked = 0

    def pop() -> str:
        nonlocal other, article, opened
        name, was_other, was_article, opened = stack.pop()
        names[name] -= 1
        other -= was_other
        article -= was_article
        return name

    tags, behind, end = _tags(page)
    skips, until = _skips(tags), -1
    for i, m in enumerate(tags):
        if i <= until:
            at = m.end()
            continue
        text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if stack and stack[-1][0] == "title":  # without an end tag: any tag ends it
            end_line()
            pop()
        if i in skips:
            if tag == "title":
                end_line()
            until = skips[i]
            continue
        # The head has no text of its own: what is not dropped anyway already belongs to the body.
        if not tag or tag == "head" or tag in _SKIPPED and tag != "title":
            continue
        if tag == "a":
            links = max(0, links + (-1 if m["end"] else 1))
        if tag in _BLOCKS:
            end_line()
        if m["end"]:
            if names[tag]:
                end_line() if tag not in _BLOCKS and other else None
                while pop() != tag:
                    pass
            continue
        for kind in _ENDS.get(tag, ()):
            if opened[kind] >= 0:
                end_line()
                for _ in range(len(stack) - opened[kind]):
                    pop()
        if tag not in _VOID and not m[0].endswith("/>"):
            is_other, is_article = _roles(tag, m["attributes"], article > 0)
            if is_other and tag not in _BLOCKS:
                end_line()
            stack.append((tag, is_other, is_article, opened))
            names[tag] += 1
            if tag in _OPEN or tag in _HIDES:
                opened = [-1 if kind in _HIDES.get(tag, ()) else place for kind, place in enumerate(opened)]
                if tag in _OPEN:
                    opened[_OPEN[tag]] = len(stack) - 1
            other += is_other
            article += is_article
    text(page[max(at, behind) : end])
    end_line()
    return lines


def _text_lines(weights: list[float], surge: float) -> list[bool]:
    """Which lines lie between a surge of the text and its dive."""
    sums, inside, found = [sum(weights[i : i + WINDOW]) for i in range(len(weights))], False, []
    for weight, total in zip(weights, sums, strict=True):
        inside = total > 0 if inside else total >= surge and weight > 0
        found.append(inside)
    return found


def main_text(page: str | None) -> str:
    lines = page_lines(page or "")
    surge = min(SURGE, SURGE_SHARE * max((sum(w for _, w, _ in lines[i : i + WINDOW]) for i in range(len(lines))), default=0))
    runs = [[i for i, _ in run] for marked, run in groupby(enumerate(lines), key=lambda x: x[1][2]) if marked]
    keep = set()
    for run in runs:
        run = [i for i in run if lines[i][0]]
        keep.update(i for i, inside in zip(run, _text_lines([lines[i][1] + ARTICLE_BONUS * surge for i in run], surge), strict=True) if inside)
    rest = [i for i, (_, _, in_article) in enumerate(lines) if not in_article]
    found = _text_lines([lines[i][1] for i in rest], surge)
    keep.update(i for i, inside in zip(rest, found, strict=True) if inside and lines[i][0])
    return " ".join(lines[i][0] for i in sorted(keep))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html): the main text, its blocks joined by one space.

    Character references are decoded, and white space inside a block becomes one space. A null or empty page, and one without main text,
    gives an empty text and 0. Broken markup is read as far as it goes. Repeated pages are read one by one; null
    ids and urls stay null; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return typed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
