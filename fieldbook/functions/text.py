"""Text expressions.

Whitespace means Unicode whitespace; the class is spelled out because Java's
``\\s`` covers ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Characters cleaned from page text.
SOFT_HYPHEN = "\u00ad"
NONCHAR = "\ufffe"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
LIGATURES = [("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")]
BULLETS = "•▶"

# Markers of a daily report and of its sections, in order.
REPORT_MARKERS = ["daily well operation", "drilling original", "operation summary"]
SECTION_MARKERS = [
    ("operation_summary", ["operation summary"]), ("personnel_data", ["personnel data"]),
    ("weather", ["weather", "current weather"]), ("planned_time_summary", ["planned time summary"]),
    ("materials", ["material", "materials"]), ("support_vessels", ["support vessels"]),
    ("formation_data", ["formation data"]),
    ("general_notes", ["general notes", "rig / equipment info", "rig equipment info"]),
    ("safety_checks", ["safety meeting", "safety observations", "permit observations"]),
]

# Words ignored when a question is reduced to its entities.
QUESTION_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that",
    "the", "to", "was", "what", "when", "where", "which", "who", "why", "with", "year", "did", "do", "does", "were",
    "had", "has", "have", "within", "between", "during", "reported", "report", "show", "shown", "stated", "figure",
    "value", "total",
]

# Token spellings folded together when reranking.
TOKEN_CANON = {
    "spent": "spend", "spending": "spend", "costs": "cost", "amounts": "amount", "totals": "total",
    "figures": "figure", "percentages": "percent", "percent": "percent", "percentage": "percent",
    "proportion": "percent", "proportions": "percent", "values": "value", "deficits": "deficit",
    "surpluses": "surplus", "assets": "asset", "liabilities": "liability", "equivalents": "equivalent",
    "overspent": "overspend", "under-spend": "underspend", "non-recurring": "nonrecurring",
    "one-off": "nonrecurring", "oneoff": "nonrecurring",
}

# Section titles folded to one name, tested in order.
SECTION_TITLES = [
    ("FINANCIAL STATEMENTS", (
        r"financial statements|consolidated statement of|statement of consolidated|statement of financial position|"
        r"statement of comprehensive net expenditure|statement of cash flow|statement of cashflows|"
        r"statement of changes in taxpayer|notes to the accounts|^note |^accounting policies|^accounting convention")),
    ("PERFORMANCE REPORT", "performance report"),
    ("ACCOUNTABILITY REPORT", "accountability report"),
    ("INDEPENDENT AUDITOR'S REPORT", "independent auditor"),
    ("DIRECTIONS BY THE SCOTTISH MINISTERS", "directions by the scottish ministers"),
]

# Lines left by signing services.
SIGNATURE_PATTERN = (
    r"(?i)^\s*(?:docusign\s+envelope\s+id\s*:\s*|digitally\s+signed\b|electronic(?:ally)?\s+signed\b|"
    r"signature\s+verified\b|verification\s+(?:code|id|url|link|status)\b|certificate(?:\s+of\s+completion)?\b|"
    r"certification\s+stamp\b)"
)


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of whitespace to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def page_text(c: Column) -> Column:
    """Page text without soft hyphens, zero-width marks and ligatures."""
    t = F.translate(c, SOFT_HYPHEN + NONCHAR + ZERO_WIDTH, "")
    for glyph, plain in LIGATURES:
        t = F.replace(t, F.lit(glyph), F.lit(plain))
    for b in BULLETS:
        t = F.replace(t, F.lit(b), F.lit("- "))
    return collapse(t)


def dehyphenate(lines: Column) -> Column:
    """Join ``x-`` with a following line that starts in lower case.

    Pairwise: a line taken as the second half is not joined again."""
    def step(acc: Column, ln: Column) -> Column:
        last = F.element_at(acc["out"], -1)
        nxt = F.ltrim(ln)
        join = (F.size(acc["out"]) > 0) & acc["open"] & last.endswith("-") & nxt.rlike(r"^\p{Ll}")
        merged = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1),
                          F.array(F.concat(F.regexp_replace(last, "-$", ""), nxt)))
        return F.struct(F.when(join, merged).otherwise(F.concat(acc["out"], F.array(ln))).alias("out"), (~join).alias("open"))

    init = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("open"))
    return F.aggregate(lines, init, step, lambda a: a["out"])


def slug(c: Column) -> Column:
    """Non-alphanumerics to single dashes; empty is ``UNKNOWN``."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(t == "", "UNKNOWN").otherwise(t)


def short_hash(c: Column) -> Column:
    """First eight hex digits of the SHA-1."""
    return F.substring(F.sha1(c.cast("binary")), 1, 8)


# -- vocabulary ------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Domain vocabulary (A8); read from a file with ``sources.read_vocabulary``."""

    stop_words: list[str] = field(default_factory=list)
    unit_tokens: list[str] = field(default_factory=list)
    compounds: list[tuple[str, str]] = field(default_factory=list)
    abbreviations: dict[str, str | None] = field(default_factory=dict)
    op_codes: dict[str, str] = field(default_factory=dict)
    activity_codes: dict[str, str] = field(default_factory=dict)
    min_token_len: int = 3


def _escape(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in s)


def vocab_normalize(c: Column, v: Vocabulary) -> Column:
    """Lower case, compounds in file order, then abbreviations per token.

    An abbreviation without expansion drops its token."""
    t = F.lower(F.coalesce(c, F.lit("")))
    for src, dst in v.compounds:
        t = F.regexp_replace(t, r"\b" + _escape(src) + r"\b", dst.replace("\\", "\\\\").replace("$", "\\$"))
    tokens = F.filter(F.split(collapse(t), " "), lambda x: x != "")
    if v.abbreviations:
        known = F.create_map(*[F.lit(x) for k, d in v.abbreviations.items() for x in (k, d or "")])

        def expand(tok: Column) -> Column:
            return F.coalesce(F.element_at(known, F.regexp_replace(tok, r"""^[.,;:()\[\]"']+|[.,;:()\[\]"']+$""", "")), tok)

        tokens = F.filter(F.transform(tokens, expand), lambda x: x != "")
    return collapse(F.array_join(tokens, " "))


MEASUREMENT = (
    r"^\d[\d,./'-]*(?:ft|psi|ppg|gpm|bpm|rpm|klbs|lbs|bbls?|kft|mins?|hrs?|ppge|btu|kips?|gal|kpa|bar|mpa)?$"
)


def graph_tokens(c: Column, v: Vocabulary) -> Column:
    """Terms for the co-occurrence graph; numbers, units and stop words go."""
    words = F.transform(
        F.split(vocab_normalize(c, v), " "), lambda x: F.regexp_replace(x, r"""^[.,;:()\[\]"'/*+-]+|[.,;:()\[\]"'/*+-]+$""", "")
    )
    stop = F.array(*[F.lit(s) for s in v.stop_words]) if v.stop_words else F.array().cast("array<string>")
    skip = F.array(*[F.lit(s) for s in v.stop_words + v.unit_tokens]) if v.stop_words + v.unit_tokens else F.array().cast("array<string>")

    def keep(x: Column) -> Column:
        plain = (x != "") & ~x.rlike(r"^\d")  # a measurement always starts with a digit
        return plain & F.when(
            x.contains("-"), (F.length(x) >= v.min_token_len) & ~F.array_contains(stop, x)
        ).otherwise(x.rlike(r"^[a-z][a-z0-9'-]{2,}") & ~F.array_contains(skip, x))

    return F.filter(words, keep)


# -- retrieval tokens ------------------------------------------------------


def bm25_tokens(c: Column) -> Column:
    """Lower-case terms of at least two characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]{1,}"), F.lit(0))


def rerank_norm(c: Column) -> Column:
    """Lower case, straight apostrophes, single blanks."""
    return F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("’"), F.lit("'")), WS + "+", " ")


def _stem(tok: Column) -> Column:
    canon = F.create_map(*[F.lit(x) for kv in TOKEN_CANON.items() for x in kv])
    t = F.coalesce(F.element_at(canon, tok), tok)
    n = F.length(t)
    s = (
        F.when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when(t.endswith("es") & (n > 4) & ~t.endswith("ses"), F.substring(t, F.lit(1), n - 2))
        .when(t.endswith("s") & (n > 3) & ~t.endswith("ss") & ~(t.endswith("es") & (n > 4) & ~t.endswith("ses")), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )
    return F.coalesce(F.element_at(canon, s), s)


def rerank_tokens(c: Column) -> Column:
    """Stemmed tokens with spellings folded."""
    raw = F.regexp_extract_all(rerank_norm(c), F.lit(r"[a-z0-9][a-z0-9'%\-]{1,}"), F.lit(0))
    return F.filter(F.transform(raw, _stem), lambda t: t != "")


def question_entities(c: Column) -> Column:
    """Distinct content tokens of a question, in order."""
    stop = F.array(*[F.lit(s) for s in QUESTION_STOPWORDS])
    return F.array_distinct(F.filter(
        rerank_tokens(c),
        lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t) & ~(t.rlike(r"^\d+$") & (F.length(t) < 3)),
    ))


def numeric_density(c: Column) -> Column:
    """Share of tokens that hold a digit."""
    toks = F.regexp_extract_all(rerank_norm(c), F.lit(r"[a-z0-9.,%-]+"), F.lit(0))
    hits = F.size(F.filter(toks, lambda t: t.rlike(r"\d")))
    return F.when(F.size(toks) > 0, hits / F.size(toks)).otherwise(0.0)


# -- snippets --------------------------------------------------------------

_CLOCK_LINE = r"(?m)^\d{2}:\d{2}\s[\d.]+[^\n]*\n?"
_EDGE = rf"^{WS}+|{WS}+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def first_sentence(c: Column, max_chars: int = 180) -> Column:
    """Text up to the first full stop, bullet or newline that falls after 20
    and before ``max_chars`` characters, else the first ``max_chars``."""
    t = strip(F.regexp_replace(F.coalesce(c, F.lit("")), _CLOCK_LINE, ""))
    out = None
    for sep in (".", "•", "\n"):
        i = F.instr(t, sep) - 1
        cond = (i > 20) & (i < max_chars)
        cut = strip(F.substring(t, F.lit(1), i))
        out = F.when(cond, cut) if out is None else out.when(cond, cut)
    return out.otherwise(strip(F.substring(t, 1, max_chars)))


def first_words(c: Column, max_chars: int = 120) -> Column:
    """Whole words within ``max_chars``, with an ellipsis when cut."""
    t = F.regexp_replace(strip(F.regexp_replace(F.coalesce(c, F.lit("")), _CLOCK_LINE, "")), WS + "+", " ")
    head = F.substring(t, 1, max_chars)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(t) <= max_chars, t).otherwise(F.concat(cut, F.lit("…")))


def snippet(c: Column, pattern: str, before: int, after: int) -> Column:
    """Text from ``before`` characters ahead of the first match to ``after``
    characters past its end; null without a match."""
    at = F.regexp_instr(c, F.lit(pattern))
    hit = F.length(F.regexp_substr(c, F.lit(pattern)))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.trim(F.substring(c, start, at + hit + after - start)))


# -- character counts ------------------------------------------------------


def alpha_ratio(c: Column) -> Column:
    """Letters over length."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.length(c)).otherwise(0.0)


def digit_ratio(c: Column) -> Column:
    """Digits over length."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\d]", "")) / F.length(c)).otherwise(0.0)


def many_numbers(c: Column, ratio: float = 0.10) -> Column:
    """Digits over non-blank characters above ``ratio``."""
    solid = F.length(F.regexp_replace(c, WS, ""))
    return F.length(F.regexp_replace(c, r"[^\d]", "")) / F.greatest(solid, F.lit(1)) > ratio


def _count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def artifacts(c: Column) -> Column:
    """Counts of soft hyphens, zero-width marks and ligatures."""
    return F.struct(
        _count(c, SOFT_HYPHEN).alias("soft_hyphen"), _count(c, ZERO_WIDTH).alias("zero_width"),
        _count(c, "".join(g for g, _ in LIGATURES)).alias("ligature"),
    )


# -- pages and embedding text ----------------------------------------------


def pages_list(pages: Column) -> Column:
    """Sorted distinct page numbers, nulls dropped."""
    return F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))


def pages_span(start: Column, end: Column) -> Column:
    """All pages between both ends; empty when one is missing."""
    span = F.sequence(F.least(start, end), F.greatest(start, end))
    return F.when(start.isNotNull() & end.isNotNull(), span).otherwise(F.array().cast("array<int>"))


def embedding_text(section: Column, subsection: Column, body: Column, is_table: Column) -> Column:
    """Headings (not ``unknown``) above the body; tables keep only the section."""
    def known(c: Column) -> Column:
        t = F.trim(c)
        return F.when((t != "") & (F.lower(t) != "unknown"), t)

    return F.concat_ws("\n", known(section), F.when(~is_table, known(subsection)), F.coalesce(body, F.lit("")))


# -- citations and labels --------------------------------------------------


def citation(doc_id: Column, page: Column, start: Column, end: Column, shift: Column) -> Column:
    """``DDR-n · p.k · time``; report number or truncated id as fallback."""
    n1, n2 = F.regexp_extract(doc_id, r"(?i)DDR-?(\d+)", 1), F.regexp_extract(doc_id, r"-R(\d{2,4})-", 1)
    head = F.when(n1 != "", F.concat(F.lit("DDR-"), n1)).when(n2 != "", F.concat(F.lit("DDR R"), n2)).otherwise(
        F.coalesce(F.nullif(F.substring(doc_id, 1, 20), F.lit("")), F.lit("—"))
    )
    s, e = F.trim(F.coalesce(start, F.lit(""))), F.trim(F.coalesce(end, F.lit("")))
    when = F.when((s != "") & (e != ""), F.concat(s, F.lit("–"), e)).when(s != "", s).otherwise(F.coalesce(shift, F.lit("")))
    return F.concat(
        head, F.coalesce(F.concat(F.lit(" · p."), page.cast("string")), F.lit("")),
        F.when(when != "", F.concat(F.lit(" · "), when)).otherwise(""),
    )


def event_key(doc_id: Column, start: Column, end: Column) -> Column:
    """Stable key of one lost-time event."""
    e = F.lit("")
    return F.concat(F.coalesce(doc_id, e), F.lit("::"), F.coalesce(start, e), F.lit("-"), F.coalesce(end, e))


def is_daily_report(c: Column) -> Column:
    """At least two of the three markers."""
    t = F.lower(F.coalesce(c, F.lit("")))
    hits = sum((t.contains(m).cast("int") for m in REPORT_MARKERS), F.lit(0))
    return hits >= 2


def section_label(c: Column) -> Column:
    """First section whose marker occurs."""
    t = F.lower(F.coalesce(c, F.lit("")))
    chain = None
    for label, markers in SECTION_MARKERS:
        hit = t.rlike("|".join(_escape(m) for m in markers))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def asks_aggregate(c: Column) -> Column:
    """The question asks for an aggregate."""
    from fieldbook import dims

    return F.lower(c).rlike("|".join(dims.AGGREGATE_KEYWORDS))


def strength_band(score: Column, high: float = 0.60, medium: float = 0.40) -> Column:
    """Match-strength band of a score."""
    return F.when(score >= high, "Strong match").when(score >= medium, "Moderate match").otherwise("Weak match")


# -- titles ----------------------------------------------------------------


def title_norm(c: Column) -> Column:
    """Lower-case title with punctuation folded."""
    t = F.lower(collapse(F.coalesce(c, F.lit(""))))
    t = F.replace(F.translate(t, "’`", "''"), F.lit("&"), F.lit(" and "))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s.']", " "), r"\s+", " "))
    t = F.regexp_replace(t, r"\bthe accountability report\b", "accountability report")
    return F.regexp_replace(t, r"\bthe performance report\b", "performance report")


def title_jaccard(a: Column, b: Column) -> Column:
    """Token-set overlap of two titles."""
    ta = F.array_distinct(F.regexp_extract_all(title_norm(a), F.lit("[a-z0-9]+"), F.lit(0)))
    tb = F.array_distinct(F.regexp_extract_all(title_norm(b), F.lit("[a-z0-9]+"), F.lit(0)))
    union = F.size(F.array_union(ta, tb))
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), F.size(F.array_intersect(ta, tb)) / union).otherwise(0.0)


def title_match(a: Column, b: Column, overlap: float = 0.6, sequence: float = 0.75) -> Column:
    """struct(ok, score); sequence similarity is 1 - edit distance / length."""
    na, nb = title_norm(a), title_norm(b)
    longest = F.greatest(F.length(na), F.length(nb))
    seq = F.when(longest > 0, 1 - F.levenshtein(na, nb) / longest).otherwise(0.0)
    tok = title_jaccard(a, b)
    return F.struct(((tok >= overlap) | (seq >= sequence)).alias("ok"), F.greatest(tok, seq).alias("score"))


def clean_heading(c: Column) -> Column:
    t = F.regexp_replace(collapse(F.coalesce(c, F.lit(""))), r"(?i)\(\s*cont(?:inued)?\.?\s*\)", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)\bcontinued\b", ""), r"\s+", " "))
    return with_value(t, lambda t: F.when((t == "") | (F.lower(t) == "unknown"), "Unknown").otherwise(t))


def canonical_section(c: Column) -> Column:
    """Section title folded to a fixed name, else upper case."""

    def named(s: Column, n: Column) -> Column:
        chain = F.when(s == "Unknown", s)
        for name, pattern in SECTION_TITLES:
            chain = chain.when(n.rlike(pattern), name)
        return chain.otherwise(F.upper(s))

    return with_value(clean_heading(c), lambda s: with_value(title_norm(s), lambda n: named(s, n)))


def note_subsection(c: Column) -> Column:
    """``Note n. title`` of a note heading, else null."""
    s = collapse(c)
    num = F.regexp_extract(s, r"(?i)^\s*note\s+(\d+)\.?\s*(.*)$", 1)
    tail = collapse(F.regexp_extract(s, r"(?i)^\s*note\s+(\d+)\.?\s*(.*)$", 2))
    return F.when(num != "", F.concat(F.lit("Note "), num, F.when(tail != "", F.concat(F.lit(". "), tail)).otherwise("")))


def canonical_subsection(c: Column) -> Column:
    """Note, ``A) TITLE``, ``iv) TITLE`` or upper case."""
    s = clean_heading(c)
    letter = r"^\s*([A-Za-z])[.)]?\s+(.+)$"
    roman = r"(?i)^\s*(i|ii|iii|iv|v|vi|vii|viii|ix|x)[.)]?\s+(.+)$"
    return (
        F.when(s == "Unknown", s)
        .when(note_subsection(s).isNotNull(), F.upper(note_subsection(s)))
        .when(s.rlike(letter), F.concat(F.upper(F.regexp_extract(s, letter, 1)), F.lit(") "), F.upper(F.regexp_extract(s, letter, 2))))
        .when(s.rlike(roman), F.concat(F.lower(F.regexp_extract(s, roman, 1)), F.lit(") "), F.upper(F.regexp_extract(s, roman, 2))))
        .otherwise(F.upper(s))
    )


def is_signature_line(c: Column) -> Column:
    """Text left by a signing service."""
    return collapse(c).rlike(SIGNATURE_PATTERN)


# -- headings --------------------------------------------------------------

# Anchor words, excluded words, heading lengths.
ANCHOR_WORDS = "REPORT|ANALYSIS|STATEMENT|GOVERNANCE|SUMMARY|DATA|NOTES|MATERIAL|VESSELS"
EXCLUDED_WORDS = "ANNUAL|ACCOUNTS|YEAR|ENDED|HARBOUR|ENERGY|DAILY"
MONTHS = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC"
HEADING_MIN, HEADING_MAX = 4, 110
NUMBERED = r"^\s*\d+(\.\d+)*\s+.+"


def part_label(c: Column) -> Column:
    """Part A or Part B."""
    return F.when(c.rlike(r"(?i)\bPart\s+A\b"), "Part A").when(c.rlike(r"(?i)\bPart\s+B\b"), "Part B")


def is_numbered_heading(c: Column) -> Column:
    """``1.2 Title``."""
    return c.rlike(NUMBERED)


def _heading_shape(t: Column) -> Column:
    n = F.length(t)
    return (n >= HEADING_MIN) & (n <= HEADING_MAX) & ~t.contains("•") & ~t.rlike(r"(?i)\bpage\s+\d+\b")


def is_title_heading(c: Column) -> Column:
    """Short line, mostly capitalised words, little punctuation."""
    t = strip(c)
    words = F.filter(F.split(t, WS + "+"), lambda w: w != "")
    caps = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    need = F.greatest(F.lit(2), F.floor(F.size(words) / 2))
    return (
        _heading_shape(t) & ~t.rlike(r"[.:;]$") & ~F.lower(t).isin("contents", "table of contents")
        & (F.size(words) > 0) & ~t.rlike(r"[.,;]") & ((caps >= need) | t.rlike(NUMBERED))
    )


def is_lettered_heading(c: Column) -> Column:
    """``A. Title``."""
    t = strip(c)
    return _heading_shape(t) & t.rlike(r"^[A-Z](?:[.)])?\s+.+")


def is_anchor_line(c: Column) -> Column:
    """An upper-case section marker such as OPERATION SUMMARY."""
    s = collapse(c)
    up = F.upper(s)
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    word = lambda alt: rf"(?:^|[^A-Za-z])(?:{alt})(?:$|[^A-Za-z])"
    return F.coalesce(
        F.length(s).between(8, 48) & up.rlike(word(ANCHOR_WORDS)) & ~up.rlike(word(EXCLUDED_WORDS))
        & ~s.rlike(r"\b(?:19|20)\d{2}\b") & ~up.rlike(rf"\b(?:{MONTHS})\b") & (upper / F.greatest(F.length(letters), F.lit(1)) >= 0.80),
        F.lit(False),
    )


def is_boilerplate_heading(c: Column) -> Column:
    """A line with words of the report's running title."""
    return F.coalesce(F.upper(collapse(c)).rlike(rf"(?:^|[^A-Za-z])(?:{EXCLUDED_WORDS})(?:$|[^A-Za-z])"), F.lit(False))


# -- tables ----------------------------------------------------------------


def md_cell(c: Column) -> Column:
    """One cell for a pipe table."""
    return F.trim(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|")))


def md_row(cells: Column) -> Column:
    """Pipe row of all cells."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, md_cell), " | "), F.lit(" |"))


def is_blank_cell(c: Column) -> Column:
    """Empty or a placeholder."""
    return F.lower(collapse(F.coalesce(c, F.lit("")))).isin("", "-", "—", "n/a", "na", "none")


def is_numeric_cell(c: Column) -> Column:
    """Holds a digit and is not a placeholder."""
    return F.coalesce(c.rlike(r"\d"), F.lit(False))


def is_unit_fragment(c: Column) -> Column:
    """A currency or percent sign, or a short unit word."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t != "") & ~t.contains(" ") & (t.rlike("[£$€%]") | t.rlike(r"^[A-Za-z/().,-]{1,8}$"))
