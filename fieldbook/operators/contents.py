"""Contents lists: entries from a stream of lines, and where printed page numbers lie in the file (K2–K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import text
from fieldbook.operators import ordered

# Patterns of contents lines, title prefixes and major titles, words that say nothing in a title.
DOTTED, SPACED = r"^\s*(.+?)\s?\.{2,}\s?(\d{1,4})\s*$", r"^\s*(.+?)\s+(\d{1,4})\s*$"
LEVEL3 = r"(?i)^\s*(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)[.)]\s+.+$"
LEVEL2 = r"(?i)^\s*[a-z][.)]\s+.+$"
MAJOR = ["performance report", "accountability report", "financial statements", "independent auditor", "directions by the scottish ministers"]
PLAIN_WORDS = ["the", "and", "for", "year", "to", "of", "report", "statement", "accounts"]


def title_level(title: Column) -> Column:
    """K2: 3 or 2 by its prefix, 1 for a major title or mostly capitals, else 2."""
    letters = F.length(F.regexp_replace(title, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(title, r"[^\p{Lu}]", ""))
    norm = text.title_norm(title)
    major = F.lit(False)
    for m in MAJOR:
        major |= norm.contains(m)
    return F.when(title.rlike(LEVEL3), 3).when(title.rlike(LEVEL2), 2).when(major, 1).when((letters > 0) & (capitals / F.greatest(letters, F.lit(1)) >= 0.75), 1).otherwise(2)


def contents_line(line: Column, n_pages: Column) -> Column:
    """K2: struct(title, page) of a line that ends in a page number, else null."""
    pattern = F.when(line.rlike(DOTTED), F.struct(F.regexp_extract(line, DOTTED, 1).alias("t"), F.regexp_extract(line, DOTTED, 2).alias("p"))).when(
        line.rlike(SPACED), F.struct(F.regexp_extract(line, SPACED, 1).alias("t"), F.regexp_extract(line, SPACED, 2).alias("p")))
    title, page = text.collapse(pattern["t"]), pattern["p"].cast("int")
    good = page.between(1, F.greatest(n_pages + 30, F.lit(250))) & F.length(title).between(3, 180)
    return F.when(good, F.struct(title.alias("title"), page.alias("page")))


def title_tokens(norm: Column) -> Column:
    """K4: words of three letters or more that say something; all such words where none does."""
    words = F.filter(F.regexp_extract_all(norm, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    telling = F.filter(words, lambda w: ~w.isin(PLAIN_WORDS))
    return F.when(F.size(telling) > 0, telling).otherwise(words)


def page_offset(items: DataFrame, pages: DataFrame, toc_pages: DataFrame, most: int = 5, least: float = 0.34) -> DataFrame:
    """K4: (doc_id, offset, confidence, support_count): what to add to a printed page number to get the page in the file.

    The ``most`` longest titles of a document vote: each for the page (not a contents page) that holds the largest share of
    its words, at least two of them. ``items``: doc_id, title_norm, start_printed_page; ``pages``: doc_id, page, clean_text;
    ``toc_pages``: doc_id, page. Every page meets its document's few titles as one row, so the work is linear in the pages."""
    c = F.col
    items = ordered.stored(items.select("doc_id", "title_norm", "start_printed_page"))  # the titles are read twice
    it = ordered.once(items, tokens=title_tokens(c("title_norm")))
    order = [F.desc("enough"), F.desc(F.length("title_norm")), F.desc("start_printed_page"), F.asc("title_norm")]
    ranked = ordered.top_n_per(it.withColumn("enough", F.size("tokens") >= 2), ["doc_id"], order, most)
    # Titles of one word vote only where no longer one is there.
    any_ = ranked.groupBy("doc_id").agg(F.max("enough").alias("some"), F.sort_array(F.collect_list(F.struct("rank", "enough", "start_printed_page", "tokens"))).alias("all"))
    asked = any_.select("doc_id", F.filter("all", lambda x: (x["enough"] | ~c("some")) & (x["start_printed_page"] > 0) & (F.size(x["tokens"]) > 0)).alias("asked"))
    body = pages.join(toc_pages, ["doc_id", "page"], "left_anti").join(asked, "doc_id")
    body = ordered.once(body.select("doc_id", "page", "asked", "clean_text"), norm=text.title_norm(c("clean_text")))

    def vote(x: Column) -> Column:
        hit = F.size(F.filter(x["tokens"], lambda t: c("norm").contains(t)))
        n = F.size(x["tokens"])
        return F.struct(x["rank"].alias("rank"), (c("page") - x["start_printed_page"]).cast("int").alias("offset"), hit.alias("hit"), (hit / n).alias("ratio"), (hit >= F.least(F.lit(2), n)).alias("enough"))

    votes = body.select("doc_id", "page", F.inline(F.transform("asked", vote))).filter(c("enough") & (c("hit") > 0) & (c("ratio") >= least))
    best = votes.groupBy("doc_id", "rank").agg(F.max_by("offset", F.struct(c("ratio"), -c("page"))).alias("offset"))
    by = best.groupBy("doc_id", "offset").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    won = by.groupBy("doc_id").agg(F.max_by("offset", F.struct(c("n"), -c("first"))).alias("offset"), F.max("n").alias("support_count"), F.sum("n").alias("all"))
    strength = items.groupBy("doc_id").agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 12).alias("strength"))
    conf = F.when(c("all").isNull(), 0.15).otherwise(0.5 * c("support_count") / c("all") + 0.5 * c("strength"))
    return strength.join(won, "doc_id", "left").select("doc_id", F.coalesce("offset", F.lit(0)).alias("offset"), conf.alias("confidence"), F.coalesce("support_count", F.lit(0)).alias("support_count"))


# Titles after which a merged segment begins anew, in order; marks of a numbered segment.
BANDS = ["Financial Statements", "Independent Auditor", "Accountability Report", "Performance Report"]
MARK = r"(?i)(?=(?:\b[a-z]\)|\b(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\)|\b\d+(?:\.\d+)+\b))"
ENTRY = "struct<title:string,page:int,level:int>"


def _page_number(line: Column, n_pages: Column) -> Column:
    return F.when(line.rlike(r"^\d{1,9}$") & line.cast("int").between(1, F.greatest(n_pages + 30, F.lit(250))), line.cast("int"))


def segment_title(segment: Column) -> Column:
    """K3: title of a stretch between two page numbers: what follows its last mark, then its last major title."""
    s = text.collapse(segment)
    s = F.when(F.lower(s).startswith("page "), text.collapse(F.substring(s, 6, 1 << 20))).otherwise(s)
    last = text.collapse(F.element_at(F.split(s, MARK), -1))
    s = F.when(last != "", last).otherwise(s)
    for band in BANDS:
        late = F.regexp_extract(s, rf"(?i)^.+({band}.*)$", 1)
        s = F.when(late != "", text.collapse(late)).otherwise(s)
    return s


def inline_entries(blob: Column, n_pages: Column) -> Column:
    """K3: entries of a contents page that came as one line: the words before each page number, two at least."""
    toks = F.filter(F.split(text.collapse(F.coalesce(blob, F.lit(""))), " "), lambda t: t != "")
    toks = F.when(F.lower(F.get(toks, F.lit(0))) == "page", F.slice(toks, 2, F.size(toks))).otherwise(toks)
    start = F.struct(F.array().cast("array<string>").alias("words"), F.array().cast("array<struct<segment:string,page:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        page = _page_number(t, n_pages)
        closed = F.struct(F.array().cast("array<string>").alias("words"), F.concat(a["out"], F.array(F.struct(F.array_join(a["words"], " ").alias("segment"), page.alias("page")))).alias("out"))
        return F.when(page.isNotNull(), closed).otherwise(F.struct(F.concat(a["words"], F.array(t)).alias("words"), a["out"].alias("out")))

    found = F.transform(F.aggregate(toks, start, step)["out"], lambda x: F.struct(segment_title(x["segment"]).alias("title"), x["page"].alias("page")))
    found = F.filter(found, lambda x: x["title"].contains(" "))
    return F.transform(found, lambda x: F.struct(x["title"].alias("title"), x["page"].alias("page"), title_level(x["title"]).alias("level")))


def _fold(lines: Column) -> Column:
    """Entries of an island of lines: text lines, then at most one line with a page number."""
    start = F.struct(F.lit("").alias("carry"), F.array().cast(f"array<struct<at:struct<page:int,line_no:int>,e:{ENTRY}>>").alias("out"))
    entry = lambda x, title, page, level: F.array(F.struct(x["at"].alias("at"), F.struct(title.alias("title"), page.cast("int").alias("page"), level.cast("int").alias("level")).alias("e")))
    glued = lambda a, b: F.trim(F.concat_ws(" ", a, b))
    state = lambda carry, out: F.struct(carry.alias("carry"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        open_ = a["carry"] != ""
        text_, none = x["kind"] == "text", F.lit(None)
        new_major = open_ & (x["level"] == 1) & (title_level(a["carry"]) >= 2)
        return (
            F.when(text_ & new_major, state(x["title"], F.concat(a["out"], entry(x, a["carry"], none, title_level(a["carry"])))))
            .when(text_, state(glued(a["carry"], x["title"]), a["out"]))
            .when((x["kind"] == "number") & ~open_, a)
            .when(x["kind"] == "number", state(F.lit(""), F.concat(a["out"], entry(x, a["carry"], x["page"], title_level(a["carry"])))))
            .when(open_, state(F.lit(""), F.concat(a["out"], entry(x, glued(a["carry"], x["title"]), x["page"], title_level(a["carry"])))))
            .otherwise(state(F.lit(""), F.concat(a["out"], entry(x, x["title"], x["page"], x["level"])))))

    return F.aggregate(lines, start, step)


def contents_items(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """K3: (doc_id, pos, toc_page, start_printed_page, title_raw, title_norm, level) of the entries of contents pages.

    ``lines`` (doc_id, page, line_no, text) are the lines of contents pages, ``pages`` (doc_id, page, clean_text, n_pages) these
    pages whole and the number of pages of the document. A title may wrap over lines, over pages too, and end with a number
    on the same or on the next line; a major title cuts off a wrapped one and takes its page from the next entry, else from the
    one before. A document with fewer than three entries so far is read once more as one line.

    Lines between two page numbers are an island; islands are numbered by a two-level scan and folded each by itself."""
    c = F.col
    lines = lines.join(pages.select("doc_id", "page", "n_pages"), ["doc_id", "page"])
    line = text.collapse(F.coalesce("text", F.lit("")))
    rows = ordered.once(lines.select("doc_id", "page", "line_no", "n_pages", line.alias("line")).filter(~F.lower("line").isin("", "contents", "page")), number=_page_number(c("line"), c("n_pages")), parsed=contents_line(c("line"), c("n_pages")))
    plain = ~c("line").rlike(r"\b\d{1,4}\s*$") & c("line").contains(" ") & ~F.lower("line").startswith("note:")
    kind = F.when(c("number").isNotNull(), "number").when(c("parsed").isNotNull(), "entry").when(plain, "text")
    rows = ordered.once(rows, kind=kind, title=F.coalesce("parsed.title", "line"), entry_page=F.coalesce("number", "parsed.page")).filter(c("kind").isNotNull())
    rows = ordered.stored(ordered.once(rows, level=title_level(c("title"))))
    ends = F.when(c("kind") == "text", 0).otherwise(1)
    rows = ordered.prefix_sum(rows, ["doc_id"], "page", ["line_no"], ends, "upto").withColumn("island", c("upto") - ends)
    one = F.struct(F.struct("page", "line_no").alias("at"), "kind", "title", c("entry_page").alias("page"), "level")
    islands = rows.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(one)).alias("all"))
    islands = ordered.stored(ordered.once(islands, f=_fold(c("all"))).select("doc_id", "island", "f", F.element_at("all", -1)["at"].alias("end")))
    found = islands.select("doc_id", F.inline("f.out")).select("doc_id", c("at.page").alias("toc_page"), F.lit(0).alias("kind"), c("at.line_no").alias("line_no"), "e")
    last = pages.groupBy("doc_id").agg(F.max("page").alias("toc_page"))
    rest = islands.filter(c("f.carry") != "").join(last, "doc_id").select("doc_id", "toc_page", F.lit(2).alias("kind"), F.lit(0).alias("line_no"), F.struct(c("f.carry").alias("title"), F.lit(None).cast("int").alias("page"), title_level(c("f.carry")).alias("level")).alias("e"))
    rest = rest.filter(c("e.level") == 1)

    # Read once more as one line: contents pages up to which fewer than three entries were found.
    own = found.groupBy("doc_id", c("toc_page").alias("page")).agg(F.count(F.lit(1)).alias("own"))
    blobs = ordered.once(pages.select("doc_id", "page", "clean_text", "n_pages"), inline=inline_entries(c("clean_text"), c("n_pages"))).drop("clean_text")
    each = blobs.join(own, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", F.coalesce("own", F.lit(0)).alias("own"), F.size("inline").cast("long").alias("more")))).alias("all"))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("used"))
    few = lambda a, x: a["n"] + x["own"] < 3
    used = F.aggregate("all", begin, lambda a, x: F.struct(
        (a["n"] + x["own"] + F.when(few(a, x), x["more"]).otherwise(0)).alias("n"), F.when(few(a, x), F.concat(a["used"], F.array(x["page"].cast("int")))).otherwise(a["used"]).alias("used")))["used"]
    again = blobs.join(each.select("doc_id", F.explode(used).alias("page")), ["doc_id", "page"]).select("doc_id", c("page").alias("toc_page"), F.lit(1).alias("kind"), F.posexplode("inline").alias("line_no", "e"))

    # A contents list is short: one row for each heading of one document.
    every = found.unionByName(again).unionByName(rest)
    order = ["k", "toc_page", "kind", "line_no", "sub"]
    every = every.withColumns({"k": F.when(c("kind") == 2, 1).otherwise(0), "sub": c("e.title")})
    w = Window.partitionBy("doc_id").orderBy(*order)
    nearest = F.coalesce(
        c("e.page"), F.first("e.page", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.last("e.page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = every.select("doc_id", "toc_page", F.row_number().over(w).alias("pos"), nearest.alias("start_printed_page"), c("e.title").alias("title_raw"), text.title_norm(c("e.title")).alias("title_norm"), c("e.level").alias("level"))
    return ordered.first_by(out.filter(c("start_printed_page") > 0), ["doc_id", "title_norm", "start_printed_page"], ["pos"])
