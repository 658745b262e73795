"""Sections inside report tables and their column headers, located by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.operators import ordered

#: A strictly found keyword fills its cell but for so many characters.
SPARE = 20
KEY = ["doc_id", "page", "table_no"]


def _filled(cells: Column) -> Column:
    return F.filter(F.transform(F.coalesce(cells, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


def _hits(keywords: list[str], strict: bool) -> Column:
    """Whether a row (``__line``, ``__first``) begins a section of these keywords."""
    out = F.lit(False)
    for k in (k.upper() for k in keywords):
        hit = F.col("__line").contains(k)
        if strict:
            hit &= F.col("__first").startswith(k) | (F.length("__first") < len(k) + SPARE)
        out |= hit
    return out


def locate_sections(rows: DataFrame, sections: dict[str, list[str]], strict: bool = False) -> DataFrame:
    """(doc_id, page, table_no, section, start_row, end_row): where each section begins in each table, and the row before
    which it ends (null: the table's end).

    ``rows``: doc_id, page, table_no, row_no, cells. A section begins with the first row that holds one of its keywords; with
    ``strict`` the first cell must begin with the keyword or hold little else. It ends at the next row whose first cell
    begins with a keyword of any section. Keywords are few (they come from a profile), so each row is read once for all
    sections; a table has one start for each section, and meets the rows that may end one by an equality join."""
    c = F.col
    low = ordered.once(rows.select(*KEY, "row_no", _filled(c("cells")).alias("__filled")).filter(F.size("__filled") > 0), __line=F.upper(F.array_join("__filled", " ")), __first=F.upper(F.get("__filled", F.lit(0))))
    begins = F.array_compact(F.array(*[F.when(_hits(words, strict), name) for name, words in sections.items()]))
    ends = F.lit(False)
    for k in sorted({k.upper() for words in sections.values() for k in words}):
        ends |= c("__first").startswith(k)
    marked = ordered.once(low.select(*KEY, "row_no", "__line", "__first"), begins=begins, ends=ends).select(*KEY, "row_no", "begins", "ends")
    marked = ordered.stored(marked.filter((F.size("begins") > 0) | c("ends")))
    starts = marked.select(*KEY, "row_no", F.explode("begins").alias("section")).groupBy(*KEY, "section").agg(F.min("row_no").alias("start_row"))
    stops = marked.filter("ends").select(*KEY, c("row_no").alias("stop"))
    after = F.min(F.when(c("stop") > c("start_row"), c("stop"))).alias("end_row")
    return starts.join(stops, KEY, "left").groupBy(*KEY, "section", "start_row").agg(after)


def _column_map(cells: Column, columns: dict[str, list[str]]) -> Column:
    """Position (from 1) of each column in a row, null where none: cells in order, each takes the first free column whose
    keywords its label (what stands before a line break) holds; a keyword in ``^...$`` must be the whole label."""
    def fits(label: Column, words: list[str]) -> Column:
        out = F.lit(False)
        for k in (w.lower().strip() for w in words):
            out |= label == k[1:-1] if k.startswith("^") and k.endswith("$") else label.contains(k)
        return out

    names = list(columns)
    label = lambda x: F.lower(F.get(F.split(F.trim(x), "\n", 2), F.lit(0)))
    kinds = F.transform(cells, lambda x, i: F.struct((i + 1).alias("i"), F.array(*[fits(label(x), columns[n]) for n in names]).alias("fits")))
    kinds = F.filter(F.when(cells.isNotNull(), kinds), lambda x: F.array_contains(x["fits"], True))

    def step(taken: Column, x: Column) -> Column:
        free = F.transform(taken, lambda t, k: t.isNull() & F.get(x["fits"], k))
        at = F.array_position(free, True)
        return F.transform(taken, lambda t, k: F.when(k + 1 == at, x["i"]).otherwise(t))

    return F.aggregate(kinds, F.array_repeat(F.lit(None).cast("int"), len(names)), step)


def section_headers(rows: DataFrame, located: DataFrame, columns: dict[str, dict[str, list[str]]], least: int = 2) -> DataFrame:
    """``located`` sections with header_row and column_map (column → position from 1) of the first row inside the section in
    which at least ``least`` of its columns are found; null where there is none.

    A row meets the sections of its own table only, of which there are a few."""
    c = F.col
    inside = rows.select(*KEY, "row_no", "cells").join(located, KEY).filter((c("row_no") > c("start_row")) & (c("end_row").isNull() | (c("row_no") < c("end_row"))))
    found = F.lit(None).cast("array<int>")
    names = F.lit(None).cast("array<string>")
    for section, cols in columns.items():
        found = F.when(c("section") == section, _column_map(c("cells"), cols)).otherwise(found)
        names = F.when(c("section") == section, F.array(*map(F.lit, cols))).otherwise(names)
    inside = ordered.once(inside, found=found, names=names)
    pairs = F.filter(F.arrays_zip("names", "found"), lambda x: x["found"].isNotNull())
    heads = ordered.once(inside.select(*KEY, "section", "row_no", "names", "found"), pairs=pairs).filter(F.size("pairs") >= least)
    first = heads.groupBy(*KEY, "section").agg(F.min("row_no").alias("header_row"), F.min_by("pairs", "row_no").alias("pairs"))
    return located.join(first, [*KEY, "section"], "left").select(*KEY, "section", "start_row", "end_row", "header_row", F.map_from_entries("pairs").alias("column_map"))


def section_cells(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, section, row_no, column, value) of the rows below each header; of a cell with a label line
    the value is what follows it."""
    c = F.col
    below = rows.select(*KEY, "row_no", "cells").join(headers.filter(c("header_row").isNotNull()), KEY).filter((c("row_no") > c("header_row")) & (c("end_row").isNull() | (c("row_no") < c("end_row"))))
    each = below.select(*KEY, "section", "row_no", "cells", F.explode("column_map").alias("column", "at"))
    lines = F.split(F.trim(F.coalesce(F.try_element_at("cells", "at"), F.lit(""))), "\n")
    value = F.when(F.size(lines) > 1, F.array_join(F.filter(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x)), lambda x: x != ""), " ")).otherwise(F.get(lines, F.lit(0)))
    return each.select(*KEY, "section", "row_no", "column", value.alias("value"))
