"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element, in page order. Lines inside elements that are never article
text (scripts, styles, menus, page headers, footers, sidebars, notices, adverts, forms, reader comments, by tag, role,
class or id) have length zero, and so has link text. Lengths are summed over sliding windows of ``LINES`` lines: where the
sum rises over ``SURGE`` a stretch begins (with the heading before it), where the sum falls to ``DIVE`` it ends, and the
longest stretch is the main text. Where the page names its article (``article``, ``main``), only its lines take part, and the
text goes from the first surge (and the short lines right before it) to the last dive in it, so that a gap inside an
article cuts nothing out.

A class or id counts by its whole name or its head word: ``sidebar``, ``left-sidebar`` and ``sidebar-box``, but not
``with-sidebar``, ``ad-free`` or ``search-algorithms``. Where nothing is left that surges, the elements dropped for their
names alone come back, those with most text first.

Everything between the points is kept: character references decoded, white space inside a block one space, blocks joined
by one space. Nothing is cut or capped.

Edge cases: null or empty HTML and pages without article text give an empty text; unclosed tags, comments and scripts
end with the page; a page of plain text is one line; repeated rows and null ids and URLs pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fieldbook.llm.common import column, values

#: Lines in a window, and the characters in it at which a stretch begins and ends.
LINES, SURGE, DIVE = 4, 80, 0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never article text.
NEVER = frozenset("head script style noscript template svg math nav footer aside form button select textarea input iframe object canvas menu dialog".split())
#: Words of class and id names, and roles, of what is never article text.
NEVER_NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside rail "
    "header masthead topbar footer copyright colophon "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search "
    "comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended widget toolbar".split()
)
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words before a name that say what is beside or absent, and words after one that say what part of it this is.
BESIDE = frozenset("with without has have no not non is".split())
PARTS = frozenset("left right top bottom main inner outer primary secondary wrapper wrap container content box block area section region bar list item items group links link form panel inner holder row col column widget widgets posts post text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-z][^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Line:
    """Text of a block, its length without links, and the elements it stands in that may take it out or name it."""

    __slots__ = ("parts", "plain", "heading", "dropped", "article")

    def __init__(self, heading: bool, dropped: tuple[int, ...], article: int | None):
        self.parts: list[str] = []
        self.plain, self.heading, self.dropped, self.article = 0, heading, dropped, article

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


class Element:
    __slots__ = ("tag", "drops", "article")

    def __init__(self, tag: str, drops: int | None, article: int | None):
        self.tag, self.drops, self.article = tag, drops, article


def _named(name: str) -> bool:
    """Whether a class or id names something that is never article text."""
    words = [w.lower() for w in _NAME.findall(name)]
    if not words or words[0] in BESIDE:
        return False
    return "".join(words) in NEVER_NAMED or words[-1] in NEVER_NAMED or words[0] in NEVER_NAMED and all(w in PARTS or w in NEVER_NAMED for w in words[1:])


def _unwanted(tag: str, attrs: str, inside: bool) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if tag == "header":
        return not inside
    for name, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        if name.lower() == "role":
            if value.lower() in NEVER_ROLES:
                return True
        elif tag not in HEADINGS and not (inside and value.lower() == "header") and any(map(_named, value.split())):
            return True
    return False


def lines_of(page: str) -> tuple[list[Line], set[int]]:
    """The page's blocks in order, with the marks that the choice needs, and the elements dropped for their names alone."""
    soft: set[int] = set()
    lines: list[Line] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    drops: list[int] = []  # unwanted elements that are open
    articles: list[int] = []
    forgiven: set[int] = set()
    count = links = at = 0
    fresh, heading, named = True, False, False

    def say(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        if fresh:
            if raw.isspace():
                return
            lines.append(Line(heading, tuple(drops), articles[0] if articles else None))
            fresh = False
        line = lines[-1]
        line.parts.append(raw)
        if not links:
            line.plain += len(raw.strip())

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            top = stack.pop()
            opened[top.tag] -= 1
            if top.drops is not None:
                drops.pop()
            if top.article is not None:
                articles.pop()
            links -= top.tag == "a"

    def end(tag: str) -> None:
        if opened[tag]:
            close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))

    for token in _TOKEN.finditer(page):
        say(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            if token["raw"] is None and not token[0].startswith("<!--"):
                fresh = fresh or not token[0].startswith(("<!", "<?"))
            continue
        if tag not in INLINE:
            fresh, heading = True, tag in HEADINGS and not token["end"]
        if token["end"]:
            end(tag)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and opened["p"] and tag != "p":
            end("p")
        if tag in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and stack and opened[tag]:
            nearest = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag)
            if not any(e.tag in ("ul", "ol", "table", "dl", "div", "section", "article", "blockquote") for e in stack[nearest:]):
                close(nearest)
        if token["attrs"].endswith("/") and tag not in ("p", "div", "a"):
            continue
        count += 1
        article = count if tag in ("article", "main") or re.search(r"\brole\s*=\s*[\"']?main\b|\bitemprop\s*=\s*[\"']?articleBody\b", token["attrs"]) else None
        if article is not None and named and _unwanted("div", token["attrs"], bool(articles)):
            article = None  # a comment or teaser that comes as an article of its own
            unwanted = True
        else:
            unwanted = article is None and _unwanted(tag, token["attrs"], bool(articles))
        if article is not None:
            if not named:
                # What holds the first article is a frame, whatever its class says.
                forgiven.update(e.drops for e in stack if e.drops is not None and e.tag not in NEVER)
            named = True
            articles.append(count)
        if unwanted:
            drops.append(count)
            if tag not in NEVER and not re.search(r"\brole\s*=", token["attrs"]):
                soft.add(count)
        stack.append(Element(tag, count if unwanted else None, article))
        opened[tag] += 1
        links += tag == "a"
    say(page[at:])
    for line in lines:
        line.dropped = tuple(d for d in line.dropped if d not in forgiven)
    return lines, soft


def stretches(lengths: list[int]) -> list[tuple[int, int]]:
    """[start, end) of each stretch between a surge and a dive point."""
    sums = [sum(lengths[k : k + LINES]) for k in range(len(lengths))]
    found, at = [], 0
    while at < len(sums):
        if sums[at] < SURGE or not lengths[at]:
            at += 1
            continue
        start = at
        while at < len(sums) and sums[at] > DIVE:
            at += 1
        found.append((start, at))
    return found


def bounds(lengths: list[int], headings: list[bool], whole: bool) -> tuple[int, int]:
    """[start, end) of the longest stretch, or with ``whole`` from the first surge to the last dive; with the headings right
    before it."""
    found = stretches(lengths)
    if not found:
        return (0, len(lengths)) if any(lengths) else (0, 0)  # too little text for a surge: all of it
    longest = max(found, key=lambda f: (sum(lengths[f[0] : f[1]]), -f[0]))
    start, end = (found[0][0], found[-1][1]) if whole else longest
    while whole and start and sum(lengths[max(start - LINES, 0) : start]) > DIVE:
        start -= 1  # short lines at the beginning of a named article belong to it, up to a dive
    while start and headings[start - 1] and lengths[start - 1]:
        start -= 1
    return start, end


def _surging(lines: list[Line], soft: set[int]) -> list[Line]:
    """Lines that are not dropped; where none of them surges, elements dropped for their names alone are taken back."""
    while True:
        kept = [x for x in lines if not x.dropped]
        if stretches([x.plain for x in kept]):
            return kept
        held: Counter[int] = Counter()
        for x in lines:
            if x.dropped and all(d in soft for d in x.dropped):
                held[x.dropped[0]] += x.plain
        most = max(held, key=lambda d: (held[d], -d), default=None)
        if most is None or held[most] < SURGE:
            return kept
        for x in lines:
            x.dropped = tuple(d for d in x.dropped if d != most)


def main_text(page: str | None) -> str:
    """The article's text; empty if there is none."""
    if not page:
        return ""
    lines = _surging(*lines_of(page))
    named: Counter[int] = Counter()
    for x in lines:
        if x.article is not None:
            named[x.article] += x.plain
    if named:
        most = max(named.values())
        # The page's article, or all of them where it shows several as parts of one text.
        lines = [x for x in lines if x.article is not None and 4 * named[x.article] >= most]
    start, end = bounds([x.plain for x in lines], [x.heading for x in lines], bool(named))
    return " ".join(t for t in (x.text for x in lines[start:end]) if t)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of each row with ``text`` and ``n_chars`` (its code points)."""
    part = pages.select(*[column(pages, c) for c in keep], column(pages, html_col).cast("string").alias("__html"))
    schema = T.StructType([*part.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page) for page in values(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=schema.fieldNames())

    return part.mapInArrow(run, schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
