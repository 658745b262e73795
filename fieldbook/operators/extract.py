"""Operation rows from the cells of report tables."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import dates
from fieldbook.operators import ordered

# Patterns of shift headers, clock times and durations; longest text of a row.
SHIFT = r"^\d{2}:\d{2}-\d{2}:\d{2}"
CLOCK = r"^\d{1,2}:\d{2}$"
DURATION = r"^\d+(?:\.\d+)?$"
OPERATION_CHARS = 800
FIELDS = ("start_time", "end_time", "dur_hr", "phase", "op_code", "activity_code", "pt_x", "operation")
#: Rows of a table in one window.
WIDTH = 4096


#: What white-space cleaning may change in a cell: other characters than printable ASCII ones, two blanks, blanks at an end.
UNCLEAN = r"[^ -~]|  |^ | $"
# Header cells of the fields after the two times; of several that fit, the first.
KINDS = [
    ("dur_hr", lambda c: c.startswith("dur") and "hr" in c),
    ("phase", lambda c: c == "phase"),
    ("op_code", lambda c: "op code" in c or c == "op_code"),
    ("activity_code", lambda c: "activity" in c),
    ("pt_x", lambda c: "p-t-x" in c or "ptx" in c),
    ("operation", lambda c: c.startswith("operation")),
]


@functools.lru_cache(maxsize=4096)
def column_map(cells: tuple[str, ...]) -> tuple[int, ...] | None:
    """The position (from 1; 0: none) of each field in a header row's ``cells``, None for other rows.

    The first cell with start and time, the first other one with end and time; of the rest the last that fits."""
    low = [c.lower() for c in cells]
    if not all(w in " ".join(low) for w in ("dur", "phase")):
        return None
    start = next((i for i, c in enumerate(low, 1) if "start" in c and "time" in c), 0)
    end = next((i for i, c in enumerate(low, 1) if "end" in c and "time" in c and i != start), 0)
    found = {next((n for n, fits in KINDS if fits(c)), ""): i for i, c in enumerate(low, 1) if i not in (start, end)} | {"start_time": start, "end_time": end}
    at = tuple(found.get(n, 0) for n in FIELDS)
    return at if start and found.get("dur_hr") and found.get("operation") else None


def _read(batches):
    """Cells with white space collapsed, how many are filled, the first, the line they make, and ``map`` of header rows."""
    for b in batches:
        cells = b.column(b.num_columns - 1)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(cells.value_lengths(), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        flat = pc.fill_null(cells.flatten(), "")
        odd = pc.match_substring_regex(flat, UNCLEAN)
        flat = pc.replace_with_mask(flat, odd, pa.array([" ".join(c.split()) for c in flat.filter(odd).to_pylist()], flat.type))
        full = np.concatenate([[0], np.cumsum(pc.not_equal(flat, "").to_numpy(zero_copy_only=False))])
        cells = pa.ListArray.from_arrays(pa.array(ends), flat)
        line = pc.binary_join(cells, " ")
        some = np.flatnonzero(pc.and_(pc.match_substring(line, "dur", ignore_case=True), pc.match_substring(line, "phase", ignore_case=True)).to_numpy(zero_copy_only=False))
        # Clean cells hold no line break, so it parts the cells of a row; equal rows are looked at once.
        heads = pc.binary_join(cells.take(pa.array(some)), "\n").dictionary_encode()
        maps = [column_map(tuple(h.split("\n"))) for h in heads.dictionary.to_pylist()]
        at, none = np.zeros((len(FIELDS), b.num_rows), np.int32), np.ones(b.num_rows, bool)
        if maps:
            which = heads.indices.to_numpy()
            at[:, some] = np.array([m or (0,) * len(FIELDS) for m in maps], np.int32)[which].T
            none[some] = np.array([m is None for m in maps])[which]
        first = pa.array(np.where(ends[1:] > ends[:-1], ends[:-1], -1), mask=ends[1:] == ends[:-1])
        cols = [*b.columns[:-1], cells, pa.array((full[ends[1:]] - full[ends[:-1]]).astype(np.int32)), pc.fill_null(flat.take(first), ""), line,
                pa.StructArray.from_arrays([pa.array(x) for x in at], list(FIELDS), mask=pa.array(none))]
        yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "filled", "head", "line", "map"])


def read_cells(table_rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, page, table_no, row_no, cells) with their cells cleaned, and what is read off them."""
    own = ["doc_id", "page", "table_no", "row_no"]
    fields = ", ".join(f"{n}: int" for n in FIELDS)
    schema = ", ".join(f"{c} {table_rows.schema[c].dataType.simpleString()}" for c in own)
    return table_rows.select(*own, "cells").mapInArrow(_read, f"{schema}, cells array<string>, filled int, head string, line string, map struct<{fields}>")


def _quoted(c: Column) -> Column:
    """A value as a literal: in single quotes, in double ones where it holds only single ones."""
    back = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    single = c.contains("'") & ~c.contains('"')
    return F.when(single, F.concat(F.lit('"'), back, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(back, F.lit("'"), F.lit("\\'")), F.lit("'")))


def operation_rows(table_rows: DataFrame, across: bool = False, width: int = WIDTH) -> DataFrame:
    """Operation rows of ``table_rows`` (doc_id, page, table_no, row_no, cells).

    A shift header carries down through the document and ends the column map; a column header carries its map down to the
    end of the table (of the document with ``across``, for tables that go on over a page). A row without start and duration
    is a continuation: its text is appended to the row before it in the same reach, or dropped where there is none. Only
    tables that name an operation summary or hold a clock time with a decimal number after it are read.

    Whole rows are dealt out once, by stretches of ``width`` rows of a table. Everything that crosses a stretch (which tables
    count, the headers on entry, the row that leading continuations belong to) is worked out on one small row per stretch."""
    c = F.col
    rows = read_cells(table_rows)
    title = F.upper("head").startswith("OPERATION SUMMARY") & (c("filled") <= 2)
    shift = ~title & c("head").rlike(SHIFT) & (c("filled") <= 2)
    rows = ordered.once(
        rows, title=title, shift=shift, part=F.coalesce(F.floor(c("row_no") / width), F.lit(-1)), clock_at=F.when(c("line").rlike(r"\d{1,2}:\d{2}"), c("row_no")),
        number_at=F.when(c("line").rlike(r"\d+\.\d+"), c("row_no")), here=F.upper("line").contains("OPERATION SUMMARY") | c("line").rlike(r"\d:\d{2}.*?\d\.\d"))
    rows = ordered.stored(rows.drop("line").withColumn("header", ~c("title") & ~c("shift") & c("map").isNotNull()))
    event = F.when(c("shift"), F.struct(F.lit(None).cast(rows.schema["map"].dataType).alias("map"))).when(c("header"), F.struct("map"))
    shift_head = F.when(c("shift"), c("head"))

    table, doc = ["doc_id", "page", "table_no"], ["doc_id"]
    at, place = [*table, "part"], ["page", "table_no", "part"]
    inside = Window.partitionBy(*at).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    reach = Window.partitionBy(*(doc if across else table)).orderBy(*(place if across else ["part"])).rowsBetween(Window.unboundedPreceding, -1)
    whole, above = Window.partitionBy(*table), Window.partitionBy(*doc).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct("row_no")
    state = rows.groupBy(*at).agg(
        F.max("here").alias("here"), F.min("clock_at").alias("first"), F.max("number_at").alias("last"),
        F.max_by(shift_head, F.when(c("shift"), order)).alias("shift_tail"), F.max_by(event, F.when(event.isNotNull(), order)).alias("event_tail"))
    counts = F.max("here").over(whole) | F.coalesce(F.min("first").over(whole) < F.max("last").over(whole), F.lit(False))
    state = state.withColumn("counts", counts).filter("counts").select(
        *at, F.last("shift_tail", ignorenulls=True).over(above).alias("shift_in"), F.last("event_tail", ignorenulls=True).over(reach).alias("event_in"))
    rows = rows.select(*at, "row_no", "cells", "title", "shift", "header", "filled", F.last(shift_head, ignorenulls=True).over(inside).alias("shift_head"), F.last(event, ignorenulls=True).over(inside).alias("event"))
    rows = rows.join(state, at).withColumn("map", F.coalesce("event", "event_in")["map"]).withColumn("shift_head", F.coalesce("shift_head", "shift_in"))
    rows = rows.filter(c("map").isNotNull() & ~c("title") & ~c("shift") & ~c("header") & (c("filled") >= 2))

    cell = {n: F.coalesce(F.try_element_at("cells", F.nullif(c(f"map.{n}"), F.lit(0))), F.lit("")) for n in FIELDS}
    rows = ordered.once(rows.select(*at, "row_no", "cells", "map", "shift_head"), **cell).drop("cells", "map")
    rows = ordered.once(rows, clock=c("start_time").rlike(CLOCK), hours=c("dur_hr").rlike(DURATION), goes_on=(c("start_time") == "") & (c("dur_hr") == "") & (c("operation") != ""))
    rows = rows.filter(c("goes_on") | (((c("start_time") != "") | (c("operation") != "")) & ((c("start_time") == "") | c("clock") | c("hours"))))
    # A run is a row and its continuations; run 0 of a stretch goes to the last run of an earlier one in the same reach.
    rows = rows.withColumn("run", F.sum(F.when(c("goes_on"), 0).otherwise(1)).over(inside))
    rows = rows.groupBy(*at, "run").agg(
        F.first(F.when(~c("goes_on"), F.struct("row_no", "shift_head", "clock", "hours", *FIELDS)), ignorenulls=True).alias("kept"),
        F.sort_array(F.collect_list(F.when(c("goes_on"), F.struct("row_no", "operation")))).alias("more"))
    rows = rows.withColumn("more", F.transform("more", lambda x: x["operation"])).withColumn("last", c("run") == F.max("run").over(Window.partitionBy(*at)))
    rows = ordered.stored(rows)
    ends = rows.filter("last OR run = 0").groupBy(*at).agg(F.max("run").alias("run"), F.max(F.when(c("run") == 0, c("more"))).alias("lead"))
    owner = F.last(F.when(c("run") > 0, F.struct(*[c(x).alias(f"o_{x}") for x in at])), ignorenulls=True).over(reach)
    lead = ends.withColumn("owner", owner).filter(c("lead").isNotNull() & c("owner").isNotNull()).groupBy(*[c(f"owner.o_{x}").alias(x) for x in at]).agg(
        F.sort_array(F.collect_list(F.struct(*[c(x).alias(f"p_{x}") for x in place], "lead"))).alias("lead"))
    lead = lead.select(*at, F.flatten(F.transform("lead", lambda x: x["lead"])).alias("lead"))
    ending = rows.filter("last AND run > 0").join(lead, at, "left").withColumn("more", F.concat("more", F.coalesce("lead", F.array().cast("array<string>")))).drop("lead")
    rows = rows.filter("NOT last AND run > 0").unionByName(ending).select("doc_id", "page", "table_no", "kept.*", "more")
    body = F.concat_ws(" ", F.substring("operation", 1, OPERATION_CHARS), F.array_join("more", " "))
    warn = F.concat_ws(
        " ", F.when((c("start_time") != "") & ~c("clock"), F.concat(F.lit("unexpected start_time "), _quoted(c("start_time")))),
        F.when((c("dur_hr") != "") & ~c("hours"), F.concat(F.lit("unparsed duration "), _quoted(c("dur_hr")))))
    return rows.select(
        "doc_id", "page", "table_no", "row_no", F.coalesce("shift_head", dates.shift_block(c("start_time"))).alias("shift_block"), "start_time", "end_time",
        F.when(c("hours"), c("dur_hr").cast("double")).alias("duration_hr"), "phase", "op_code", "activity_code", "pt_x", (F.upper("pt_x") == "T").alias("is_npt"),
        F.when(F.size("more") == 0, F.substring("operation", 1, OPERATION_CHARS)).otherwise(body).alias("operation_text"), warn.alias("parse_warning"))
