"""Page cleaning, sections, page labels and page-range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import text
from fieldbook.operators import ordered


def strip_margins(lines: DataFrame, frac: float = 0.08, rotated_frac: float = 0.02) -> DataFrame:
    """Drop lines whose middle lies in the outer band of the page; rotated or
    landscape pages are cut at the sides."""
    c = F.col
    side = c("rotation").isin(90, 270) | (c("page_width") > c("page_height"))
    pos = F.when(side, (c("x0") + c("x1")) / 2 / c("page_width")).otherwise((c("y0") + c("y1")) / 2 / c("page_height"))
    cut = F.when(side, rotated_frac).otherwise(frac)
    return lines.filter((pos >= cut) & (pos <= 1 - cut))


def repeated_lines(lines: DataFrame, share: float = 0.4, depth: int = 5) -> DataFrame:
    """Lines among the first (``top``) or last (``bottom``) ``depth`` non-blank
    lines of a page on at least ``int(share * pages)`` pages; anchors are exempt.

    The ends of a page come from two group limits, the rest is counting."""
    l = lines.select("doc_id", "page", "line_no", text.collapse(F.col("text")).alias("norm")).filter("norm <> ''")
    k = ["doc_id", "page"]
    top = ordered.top_n_per(l, k, [F.asc("line_no")], depth).withColumn("place", F.lit("top"))
    bottom = ordered.top_n_per(l, k, [F.desc("line_no")], depth).withColumn("place", F.lit("bottom"))
    seen = top.unionByName(bottom).groupBy("doc_id", "place", "norm").agg(F.count(F.lit(1)).alias("n_lines"))
    total = lines.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("__p"))
    hit = seen.join(total, "doc_id").filter(F.col("n_lines") >= F.floor(share * F.col("__p"))).drop("__p")
    return hit.filter(~text.is_anchor_line(F.col("norm")))


def drop_repeated(lines: DataFrame, repeated: DataFrame, depth: int = 5) -> DataFrame:
    """Lines without repeated headers at the top and footers at the bottom."""
    l = lines.withColumn("norm", text.collapse(F.col("text"))).filter("norm <> ''")
    page = Window.partitionBy("doc_id", "page")
    l = l.withColumn("__i", F.row_number().over(page.orderBy("line_no"))).withColumn("__j", F.row_number().over(page.orderBy(F.desc("line_no"))))
    r = repeated.groupBy("doc_id", "norm").agg(F.max(F.col("place") == "top").alias("__t"), F.max(F.col("place") == "bottom").alias("__b"))
    gone = (F.col("__t") & (F.col("__i") <= depth)) | (F.col("__b") & (F.col("__j") <= depth))
    return l.join(r, ["doc_id", "norm"], "left").filter(~F.coalesce(gone, F.lit(False))).drop("norm", "__i", "__j", "__t", "__b")


def needs_ocr(clean_text: Column, min_chars: int = 80) -> Column:
    """Page text that is too short, holds replacement marks or few letters."""
    t = text.collapse(F.coalesce(clean_text, F.lit("")))
    return (F.length(t) < min_chars) | t.contains("\ufffd") | (text.alpha_ratio(t) < 0.15)


def sections(labels: DataFrame, width: int = 256) -> DataFrame:
    """Runs of equal labels over consecutive pages, with their word count.

    Runs are numbered by a two-level scan over page blocks; word counts add up, so
    no section text is gathered to count it."""
    lab = labels.withColumn("__b", F.floor(F.col("page") / width))
    here = F.struct("section_title", "subsection_title", "page")
    p = ordered.lag_across(lab, ["doc_id"], "__b", ["page"], here, "p")
    same = (F.col("p.section_title") == F.col("section_title")) & (F.col("p.subsection_title") == F.col("subsection_title")) & (F.col("p.page") + 1 == F.col("page"))
    runs = ordered.prefix_sum(p, ["doc_id"], "__b", ["page"], F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1), "run")
    words = F.size(F.filter(F.split(text.collapse(F.col("clean_text")), " "), lambda w: w != ""))
    return runs.groupBy("doc_id", "run", "section_title", "subsection_title").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum(words).alias("word_count"))


def page_sections(pages: DataFrame, spans: DataFrame, latest: bool = True, block: int = 16) -> DataFrame:
    """D9 (``latest``) / D10: the last or first span that covers a page.

    Spans are spread over blocks of pages, so the range condition runs inside an
    equi-join on (document, block)."""
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("page_start") / block), F.floor(F.col("page_end") / block))))
    p = pages.withColumn("__b", F.floor(F.col("page") / block))
    hit = p.join(s, ["doc_id", "__b"], "left").withColumn("__in", F.col("page").between(F.col("page_start"), F.col("page_end")))
    val = F.when(F.col("__in"), F.col("section_title"))
    key = F.when(F.col("__in"), F.col("page_start"))
    pick = F.max_by(val, key) if latest else F.min_by(val, key)
    return hit.groupBy("doc_id", "page").agg(F.coalesce(pick, F.lit("Unknown")).alias("section_title"))


def toc_spans(items: DataFrame, last_page: DataFrame) -> DataFrame:
    """K5: each entry runs to the page before the next one; a contents list is short
    (one row per heading of one document)."""
    w = Window.partitionBy("doc_id").orderBy("start_page", "title")
    nxt = F.lead("start_page").over(w)
    return items.join(last_page, "doc_id").select(
        "doc_id", "title", "level", F.col("start_page").alias("page_start"),
        F.greatest("start_page", F.coalesce(nxt - 1, F.col("last_page"))).alias("page_end"),
        F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("section_title"))


def corpus_metrics(chunks: DataFrame) -> DataFrame:
    """Chunk and page counts and word statistics per document."""
    from fieldbook.operators import quantiles

    chunks = ordered.stored(chunks.select("doc_id", "page", "word_count"))  # the texts are read once
    a = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("page").alias("n_pages"), F.avg("word_count").alias("mean_words"),
        F.max("word_count").alias("max_words"), F.count_if(F.col("word_count") > 300).alias("n_over_300"))
    return a.join(quantiles.exact_quantiles(chunks, ["doc_id"], "word_count", {"median_words": 0.5, "p95_words": 0.95}), "doc_id")


def key_alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only."""
    x = a.select(key).distinct().withColumn("in_a", F.lit(True))
    y = b.select(key).distinct().withColumn("in_b", F.lit(True))
    j = x.join(y, key, "full_outer")
    return j.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"),
                 F.count_if(F.col("in_a") & F.col("in_b")).alias("both"))


def allowed_title(title: Column, allowed: Column, overlap: float = 0.6, sequence: float = 0.75) -> Column:
    """K6: struct(ok, title, score) of the first allowed title that matches, else of the best one."""
    scored = F.transform(allowed, lambda a: F.struct(text.title_match(title, a, overlap, sequence).alias("m"), a.alias("title")))
    first = F.get(F.filter(scored, lambda s: s["m"]["ok"]), F.lit(0))
    best = F.array_max(F.transform(scored, lambda s: s["m"]["score"]))
    return F.struct(first.isNotNull().alias("ok"), first["title"].alias("title"), F.coalesce(first["m"]["score"], best, F.lit(0.0)).alias("score"))


def page_labels(pages: DataFrame, cross_major: bool = False, width: int = 256) -> DataFrame:
    """K6: part, section and subsection of every page, carried forward through its document.

    ``pages``: doc_id, page, what was found on the page (part_found, section_found, subsection_found; null: nothing), what the
    contents list says (prior_section, prior_subsection; null: nothing), whether the list is trusted (toc_active) and the
    subsection titles it allows (allowed).

    A trusted list sets the labels first; a section found on the page overrides it (only one that the list agrees with, but
    for ``cross_major``) and clears the subsection; then a subsection found on the page sets the subsection, unless the
    section holds notes only or the title is not among the allowed ones: a refused title falls back to the list.

    Whether a title is refused depends on the carried section, never the other way round, so the state machine is three
    two-level carries in sequence: part, section, and with the section known the subsection. No document is put in
    order in one task."""
    c, unknown = F.col, F.lit("Unknown")
    active = F.coalesce(c("toc_active"), F.lit(False))
    prior = lambda name: F.when(active & (c(name) != "Unknown"), c(name))
    differs = lambda a, b: a.isNotNull() & b.isNotNull() & (text.title_norm(a) != text.title_norm(b))
    rows = pages.withColumns({"__b": F.floor(c("page") / width), "__ps": prior("prior_section"), "__pu": prior("prior_subsection")})
    other = differs(c("__ps"), c("section_found"))
    checked = active & (F.size(F.coalesce("allowed", F.array().cast("array<string>"))) > 0) & ~text.is_numbered_heading(c("subsection_found"))
    rows = ordered.once(
        rows, __other=other, __taken=c("section_found").isNotNull() & (F.lit(cross_major) | ~other),
        __match=F.when(c("subsection_found").isNotNull() & checked, allowed_title(c("subsection_found"), c("allowed"))))
    title = F.when(c("__taken"), c("section_found")).otherwise(c("__ps"))
    rows = ordered.once(ordered.once(rows, __title=title), __set=F.when(c("__title").isNotNull(), text.canonical_section(c("__title"))))
    rows = ordered.stored(rows)
    rows = ordered.carry_last(rows, ["doc_id"], "__b", ["page"], c("part_found"), "part")
    rows = ordered.carry_last(rows, ["doc_id"], "__b", ["page"], c("__set"), "__section")

    refused = F.coalesce(~c("__match.ok"), F.lit(False))
    notes_only = (c("__section") == "FINANCIAL STATEMENTS") & text.note_subsection(c("subsection_found")).isNull()
    accepted = c("subsection_found").isNotNull() & ~refused & ~F.coalesce(notes_only, F.lit(False))
    rows = ordered.once(rows, rejected=refused, score=F.when(refused, c("__match.score")), __accepted=accepted, __chosen=F.coalesce(F.when(c("__match.ok"), c("__match.title")), c("subsection_found")))
    title = F.when(c("__accepted"), c("__chosen")).when(c("subsection_found").isNotNull() & active, F.coalesce("__pu", unknown)).when(c("__taken"), unknown).otherwise(c("__pu"))
    rows = ordered.once(ordered.once(rows, __title=title), __set=F.when(c("__title").isNotNull(), text.canonical_subsection(c("__title"))))
    again = c("__accepted") & differs(c("__pu"), c("__chosen"))
    rows = ordered.once(rows, overrides=F.when(c("__taken") & c("__other"), 1).otherwise(0) + F.when(again, 1).otherwise(0))
    rows = ordered.carry_last(ordered.stored(rows), ["doc_id"], "__b", ["page"], c("__set"), "__subsection")
    rows = ordered.once(rows, toc_prior_section=text.canonical_section(F.coalesce("__ps", unknown)))
    rows = ordered.once(rows, toc_prior_subsection=text.canonical_subsection(F.coalesce("__pu", unknown)))
    # What was set is canonical already.
    return rows.select(
        "doc_id", "page", F.coalesce("part", unknown).alias("part"), F.coalesce("__section", unknown).alias("section_title"), F.coalesce("__subsection", unknown).alias("subsection_title"),
        "toc_prior_section", "toc_prior_subsection", "overrides", "rejected", "score")


def label_diagnostics(labels: DataFrame) -> DataFrame:
    """K6: pages that the contents list labels, overrides of it and refused subsections, by document."""
    listed = (F.col("toc_prior_section") != "Unknown") | (F.col("toc_prior_subsection") != "Unknown")
    return labels.groupBy("doc_id").agg(F.count_if(listed).alias("toc_coverage_pages"), F.sum("overrides").alias("toc_override_count"), F.count_if("rejected").alias("subsection_reject_count"))
