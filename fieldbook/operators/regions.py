"""Regions of a page and overlaps of neighbouring chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.operators import ordered

# Least gap, gap in line heights, lines of a region that stands alone, gap over which a small one joins.
MIN_GAP, GAP_HEIGHTS, MIN_LINES, JOIN_GAP = 18.0, 1.8, 2, 10.0
_GROUPS = "array<struct<first:int,n:int,top:double,bottom:double>>"


def _last(groups: Column) -> Column:
    return F.element_at(groups, -1)


def _extend(groups: Column, n: Column, top: Column, bottom: Column) -> Column:
    """``groups`` with the last one widened."""
    last = _last(groups)
    wide = F.struct(last["first"].alias("first"), (last["n"] + n).alias("n"), F.least(last["top"], top).alias("top"), F.greatest(last["bottom"], bottom).alias("bottom"))
    return F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(wide))


def page_regions(lines: DataFrame, min_gap: float = MIN_GAP, gap_heights: float = GAP_HEIGHTS, min_lines: int = MIN_LINES, join_gap: float = JOIN_GAP) -> DataFrame:
    """Regions of each page, cut where the gap to the line before exceeds ``min_gap`` and ``gap_heights`` times the median
    line height of that page.

    A region of fewer than ``min_lines`` lines joins the one before it when it is near (``join_gap``), after that whatever
    the gap; only the first of a page may stay small. ``lines``: doc_id, page, line_no, text, x0, y0, x1, y1. The fold
    runs over the coordinates of one page; texts are put together per region."""
    c = F.col
    zero = lambda n: F.coalesce(c(n), F.lit(0.0)).cast("double").alias(n)
    order = ["y0", "x0", "line_no"]
    spots = lines.select("doc_id", "page", F.struct(zero("y0"), zero("x0"), "line_no", zero("y1"), zero("x1")).alias("l"))
    pages = spots.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("l")).alias("all"))
    tall = F.sort_array(F.filter(F.transform("all", lambda l: F.greatest(l["y1"] - l["y0"], F.lit(0.0))), lambda h: h > 0))
    pages = ordered.once(pages, all=c("all"), tall=tall)
    n = F.size("tall")
    median = F.when(n == 0, F.lit(10.0)).otherwise((F.get("tall", ((n - 1) / 2).cast("int")) + F.get("tall", (n / 2).cast("int"))) / 2)
    pages = ordered.once(pages.select("doc_id", "page", "all", F.greatest(F.lit(min_gap), F.greatest(median, F.lit(1.0)) * gap_heights).alias("gap")), gap=c("gap"))

    none = F.array().cast(_GROUPS)
    one = lambda i, top, bottom: F.array(F.struct(i.cast("int").alias("first"), F.lit(1).alias("n"), top.alias("top"), bottom.alias("bottom")))

    def line_step(a: Column, x: Column) -> Column:
        l, groups = x["l"], a["groups"]
        away = F.when(a["y1"] == 0, F.lit(0.0)).otherwise(l["y0"] - a["y1"])
        new = (F.size(groups) == 0) | (away > c("gap"))
        return F.struct(F.when(new, F.concat(groups, one(x["i"], l["y0"], l["y1"]))).otherwise(_extend(groups, F.lit(1), l["y0"], l["y1"])).alias("groups"), l["y1"].alias("y1"))

    def join_step(near: bool):
        def step(out: Column, g: Column) -> Column:
            small = (F.size(out) > 0) & (g["n"] < min_lines)
            if near:
                small &= g["top"] - _last(out)["bottom"] <= join_gap
            return F.when(small, _extend(out, g["n"], g["top"], g["bottom"])).otherwise(F.concat(out, F.array(g)))
        return step

    numbered = F.transform("all", lambda l, i: F.struct(i.alias("i"), l.alias("l")))
    pages = ordered.once(pages, groups=F.aggregate(numbered, F.struct(none.alias("groups"), F.lit(0.0).alias("y1")), line_step)["groups"])
    pages = ordered.once(pages, groups=F.aggregate("groups", none, join_step(True)))
    pages = ordered.once(pages, groups=F.aggregate("groups", none, join_step(False)))
    cut = lambda g: F.slice("all", g["first"] + 1, g["n"])
    regions = pages.select("doc_id", "page", F.posexplode(F.transform("groups", lambda g: cut(g))).alias("region_index", "own"))
    members = regions.select("doc_id", "page", "region_index", F.inline("own"))
    body = F.trim(F.coalesce("text", F.lit("")))
    texts = members.join(lines.select("doc_id", "page", "line_no", body.alias("text")), ["doc_id", "page", "line_no"])
    shape = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).cast("int").alias("line_count")]
    all_ = F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda l: l["text"] != ""), lambda l: l["text"]), "\n")
    out = texts.groupBy("doc_id", "page", "region_index").agg(*shape, all_.alias("text"))
    return out.withColumn("region_id", F.format_string("p%04d_r%02d", "page", "region_index"))


def display_tokens(c: Column) -> Column:
    """Words with the space after them; leading space is a token."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+\s*|\s+"), F.lit(0))


def border(left: list[str], right: list[str]) -> int:
    """Length of the longest suffix of ``left`` that is a prefix of ``right``, by the prefix function: linear."""
    if not len(left) or not len(right):
        return 0
    fall, k = [0] * len(right), 0
    for i in range(1, len(right)):
        while k and right[i] != right[k]:
            k = fall[k - 1]
        k += right[i] == right[k]
        fall[i] = k
    k = 0
    for token in left[-len(right) :]:
        while k and (k == len(right) or token != right[k]):
            k = fall[k - 1]
        k += token == right[k]
    return k


@F.pandas_udf(T.IntegerType())
def _borders(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([0 if a is None or b is None else border(list(a), list(b)) for a, b in zip(left, right, strict=True)], dtype="int32")


def chunk_overlaps(chunks: DataFrame) -> DataFrame:
    """Tokens that each chunk of a page shares with the next and the one before, and where it begins on the page.

    ``chunks``: doc_id, page, chunk_id, chunk_text. The overlap is the longest run of tokens that ends one chunk and begins
    the next; a chunk begins where the one before ends, less their overlap. Chunks of one page are few."""
    c = F.col
    page = Window.partitionBy("doc_id", "page").orderBy("chunk_id")
    rows = ordered.once(chunks, n=F.size(display_tokens(c("chunk_text"))), tokens=F.transform(display_tokens(c("chunk_text")), lambda t: F.trim(F.regexp_replace(t, r"\s+", ""))))
    rows = rows.withColumn("next", F.lead("tokens").over(page)).withColumn("overlap_next_tokens", F.coalesce(_borders("tokens", "next"), F.lit(0)))
    before = F.coalesce(F.lag("overlap_next_tokens").over(page), F.lit(0))
    start = F.coalesce(F.sum(c("n") - c("overlap_next_tokens")).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return rows.select("doc_id", "page", "chunk_id", c("n").alias("token_count"), before.alias("overlap_prev_tokens"), "overlap_next_tokens", start.alias("token_start"), (start + c("n")).alias("token_end"))
