"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. The text lengths of the lines are summed over a
sliding window; the main text begins at a surge (a window sum that reaches the threshold where the one
before did not) and ends at the following dive (the window sum falls below it for good or to nothing).
Lines that cannot be main text weigh nothing: those inside scripts, styles, navigation, headers, footers,
sidebars, forms and comments, inside elements whose class, id or role names such a part, and, where the page
marks one or more articles, those outside them. A line of a marked article weighs THRESHOLD more than its
length. The threshold is THRESHOLD, or half of the page's largest window sum where that is less.

Defined results: a null, empty or text-free page gives the empty text; repeated rows repeat; an empty
table stays empty; markup that never ends is text or runs to the end of the page as browsers read it;
columns besides the id, the address and the page play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm._common import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>"  # foreign elements may close themselves
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|math|textarea|select|object|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9-]*+)(?:(?P<rest>(?!=)[^>\"'=]{0,256}+(?:(?<![\s/\"'])=(?:\"[^\"]{0,512}\"|'[^']{0,512}'|[^\s>\"'][^\s>\"']{0,256}+)[^>\"'=]{0,256}+){0,16}+)>)?"
    r"|<[!?][^>]*>|</[^>]*>",
    re.I | re.S,
)
#: One attribute, or what stands between two. A quote opens a value after = only, and only if it closes.
_ATTRIBUTE = re.compile(r"[\s/]++|[^\s/>][^\s/>=]{0,255}+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+")
_SPACE = re.compile(r"\s+")
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|=\s*+(?:\"[^\"]*+\"|'[^']*+')", re.I)

#: Elements that end a line, elements without an end, elements that never hold main text.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer aside form menu head title button dialog fieldset".split())
#: Words of a class, id or role that name a part outside the main text, and words for what holds such a part.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar rail nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot copyright "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended widget comment comments commentlist disqus replies "
    "respond pagination pager toolbar complementary contentinfo search alert dialog form".split()
)
HOLDERS = frozenset("list box container wrapper wrap area slot section block bar links posts articles stories buttons unit panel inner content items".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _names_chrome(names: str, tag: str, inside: bool) -> bool:
    """Whether an element's names call it a part outside the main text.

    Outside a marked article one such word in any name will do. Inside, where a section may well be called
    related-work or header-image, the word must be the whole name or its last part, or be followed by a word for
    a holder; headings are text there.
    """
    if inside and tag in _HEADINGS:
        return False
    for name in names.split():
        parts = re.split(r"[^a-z]+", name)
        hit = [p in CHROME_WORDS for p in parts]
        if any(hit) and (not inside or hit[-1] or (hit[0] and parts[-1] in HOLDERS)):
            return True
    return False


_MAIN_WORDS = re.compile(r"(?<![a-z])(?:article-body|articlebody|post-content|post-body|entry-content|article-content|story-body|main-content)(?![a-z])")
_MARKS = frozenset(("article", "main"))

WINDOW = 3
THRESHOLD = 86


def _names(rest: str) -> str:
    return " ".join(a or b or c for a, b, c in _NAMED.findall(rest)).lower() if "=" in rest else ""


def _tag_end(page: str, at: int, last: int, dead: set[int]) -> int:
    """The place of the > that ends the tag whose attributes start at `at`, or -1; `dead`: places that lead to none."""
    seen = []
    while at not in dead and at <= last:
        if page[at] == ">":
            return at
        seen.append(at)
        at = _ATTRIBUTE.match(page, at).end()
    dead.update(seen)
    return -1


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """start, end, tag, closing, rest of all markup in page order."""
    last = page.rfind(">")
    dead: set[int] = set()
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        rest = m["rest"]
        if m["tag"] and rest is None:  # long, or quoted in an odd way
            end = _tag_end(page, at, last, dead)
            if end < 0:
                continue
            rest, at = page[at:end], end + 1
        yield m.start(), at, (m["tag"] or "").lower(), bool(m["end"]), rest or ""


def _lines(page: str) -> list[tuple[str, int, int, int]]:
    """Lines in page order: text, whether it is chrome, the number of its outermost article or -1, link characters."""
    tokens = list(_tokens(page))
    opened: dict[str, list[int]] = {}
    close: dict[int, int] = {}
    for k, (_, _, tag, closing, rest) in enumerate(tokens):
        if not tag or tag in VOID:
            continue
        if closing:
            if opened.get(tag):
                close[opened[tag].pop()] = k
        elif not rest.endswith("/"):
            opened.setdefault(tag, []).append(k)
    n = len(tokens)
    chrome_until = -1
    article, article_until, links_until = -1, -1, -1
    found = 0
    out: list[tuple[str, int, int, int]] = []
    text: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal link
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append((line, state[0], state[1], link))
            text.clear()
        link = 0

    state = (0, -1)
    at = 0
    for k in range(n + 1):
        start = tokens[k][0] if k < n else len(page)
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if k <= links_until:
                link += len(piece.strip())
        if k == n:
            break
        _, at, tag, closing, rest = tokens[k]
        if tag in BLOCKS:
            flush()
        if tag and not closing and k > chrome_until:
            names = _names(rest)
            marked = tag in _MARKS or (names and (_MAIN_WORDS.search(names) or "main" in names.split()))
            inside = k <= article_until
            named = bool(names) and not marked and _names_chrome(names, tag, inside) or tag == "article" and "comment" in names
            if tag not in ("html", "body") and (named or (tag in CHROME and not (tag == "header" and inside))):
                end = close.get(k)
                if end is None and tag in ("p", "li", "dd", "dt", "td", "th"):
                    end = next((j for j in range(k + 1, n) if tokens[j][2] in BLOCKS and tokens[j][2] != "br"), n) - 1
                if end is not None:  # an element that never ends hides nothing
                    flush()
                    chrome_until = end
            elif marked and not inside:
                flush()
                article, found, article_until = found, found + 1, close.get(k, n)
            elif tag == "a" and k > links_until:
                links_until = close.get(k, k)
        new = (int(k < chrome_until), article if k < article_until else -1)
        if new != state:
            flush()
            state = new
    flush()
    return out


def window_sums(lengths: list[int], window: int = WINDOW) -> list[int]:
    """For each line, the sum of the lengths from it on over the window."""
    total, sums = sum(lengths[:window]), []
    for i in range(len(lengths)):
        sums.append(total)
        total += (lengths[i + window] if i + window < len(lengths) else 0) - lengths[i]
    return sums


def surges(lengths: list[int], window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Runs (first line, line after the last) between surge and dive points of the windowed length sums.

    A run starts at a line with text whose sum reaches the threshold, and ends at the next line without text whose sum does not.
    """
    runs, start = [], None
    for i, (length, ahead) in enumerate(zip(lengths, window_sums(lengths, window))):
        if start is None:
            if length and ahead >= threshold:
                start = i
        elif not length and ahead < threshold:
            runs.append((start, i))
            start = None
    if start is not None:
        runs.append((start, len(lengths)))
    return runs


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by one space."""
    lines = _lines(page or "")
    marked = any(article >= 0 and not chrome for _, chrome, article, _ in lines)
    weights = []
    for line, chrome, article, link in lines:
        if chrome or (article < 0 if marked else 2 * link > len(line)):
            weights.append(0)
        else:  # the page's own mark is as good a sign as a window full of text
            weights.append(len(line) + THRESHOLD * marked)
    # the page's own distribution sets the threshold where all of its blocks are short
    threshold = min(THRESHOLD, (max(window_sums(weights), default=0) + 1) // 2)
    return " ".join(lines[i][0] for a, b in surges(weights, threshold=max(1, threshold)) for i in range(a, b) if weights[i])


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, text and n_chars, one row per page; no shuffle."""
    own = [c for c in keep if c not in ("text", "n_chars")]
    source = pages.select(F.col(page).cast("string").alias("_html"), *own)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts = [main_text(x) for x in batch.column(0).to_pylist()]
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*own, "text", "n_chars"])

    return source.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
