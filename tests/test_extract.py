"""Operation rows and page labels against hand-made tables and plain loops."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldbook.functions import text
from fieldbook.operators import extract, pages

CELLS = "doc_id string, page int, table_no int, row_no int, cells array<string>"
HEAD = ["Start Time", "End Time", "Dur (hr)", "Phase", "Op Code", "Activity Code", "P-T-X", "Operation"]


def rows_of(spark, *tables, **kw):
    data = [("d", page, no, k, cells) for (page, no), table in tables for k, cells in enumerate(table)]
    return [r.asDict() for r in extract.operation_rows(spark.createDataFrame(data, CELLS), **kw).orderBy("page", "table_no", "row_no").collect()]


def row(start="06:00", end="08:00", dur="2.0", text="Drilled ahead", ptx="P"):
    return [start, end, dur, "PROD1", "Drilling", "DRLG", ptx, text]


def test_operation_rows_by_hand(spark):
    first = [["OPERATION SUMMARY"], ["06:00-12:00", "", None], HEAD, row(), [None, "", "", "", "", "x", "", "to 7,390 ft"], ["", "", "", "", "", "", " ", "alone"], row("Total", "", "", "24"), row("it's", ptx="t")]
    second = [["Operation summary"], ["", "", "", "", "", "x", "", "no header yet"], HEAD, ["", "", "", "", "", "x", "", "no row yet"], row(dur="two", text="w" * 900), ["", "", "", "", "", "x", "", "tail"]]
    third = [["Company", "Count"], ["Crew", "12"], ["18:00-00:00"]]
    got = rows_of(spark, ((1, 0), first), ((2, 0), second), ((3, 0), third), width=2)
    assert [(r["page"], r["operation_text"][:20], r["shift_block"], r["duration_hr"], r["is_npt"]) for r in got] == [
        (1, "Drilled ahead to 7,3", "06:00-12:00", 2.0, False), (1, "Drilled ahead", "06:00-12:00", 2.0, True), (2, "w" * 20, "06:00-12:00", None, False)]
    assert got[1]["parse_warning"] == "unexpected start_time \"it's\"" and got[2]["parse_warning"] == "unparsed duration 'two'"
    assert len(got[2]["operation_text"]) == 805 and got[2]["operation_text"].endswith(" tail")


def test_operation_rows_across_pages_and_edges(spark):
    table = [HEAD, row("13:10", text="began")]
    more = [["", "", "", "", "", "x", "", "went on"], row("19:00", text="next")]
    assert [r["operation_text"] for r in rows_of(spark, ((1, 0), table), ((2, 0), more), across=True)] == ["began went on", "next"]
    alone = rows_of(spark, ((1, 0), table), ((2, 0), more))
    assert [(r["operation_text"], r["shift_block"]) for r in alone] == [("began", "12:00-18:00")]
    assert rows_of(spark, ((1, 0), [None, [], ["", None]])) == []
    assert extract.operation_rows(spark.createDataFrame([], CELLS)).count() == 0


SECTIONS = {"Performance Report": "PERFORMANCE REPORT", "Notes to the Accounts": "FINANCIAL STATEMENTS", "Remuneration": "REMUNERATION"}
SUBS = {"a. overview": ("A) OVERVIEW", False, None), "note 4. leases": ("NOTE 4. LEASES", True, None), "Strategic plans": ("STRATEGIC PLANS", False, "Strategic plan"), "Weather log": ("WEATHER LOG", False, None)}


def plain_labels(rows, cross):
    """One pass over the pages of a document in order."""
    out, part, section, sub = [], "Unknown", "Unknown", "Unknown"
    for doc, page, p, s, u, ps, pu, active, allowed in sorted(rows):
        part = p or part
        ps, pu = (ps if active else None), (pu if active else None)
        section, sub = SECTIONS[ps] if ps else section, pu.upper() if pu else sub
        n = 0
        if s and (cross or not ps or ps == s):
            n += bool(ps and ps != s)
            section, sub = SECTIONS[s], "Unknown"
        rejected = False
        if u:
            name, note, match = SUBS[u]
            ok = section != "FINANCIAL STATEMENTS" or note
            if active and allowed:
                rejected = match is None
                ok, name, u = ok and not rejected, (match or name).upper() if match else name, match or u
            if ok:
                n += bool(pu and pu.lower() != u.lower())
                sub = name
            elif active:
                sub = pu.upper() if pu else "Unknown"
        out.append((doc, page, part, section, sub, n, rejected))
    return out


@pytest.mark.parametrize("cross", [False, True])
def test_page_labels_equal_a_plain_loop(spark, cross):
    rng = random.Random(4)
    rows = []
    for doc, n in (("a", 70), ("b", 9), ("c", 1)):
        active = doc != "b"
        for page in sorted(rng.sample(range(1, 200), n)):
            pick = lambda xs, p: rng.choice(list(xs)) if rng.random() < p else None
            rows.append((doc, page, pick(["Part A", "Part B"], 0.1), pick(SECTIONS, 0.25), pick(SUBS, 0.4), pick(SECTIONS, 0.3), pick(["Strategic plan", "Risk review"], 0.3), active, ["Strategic plan", "Risk review"] if page % 3 else []))
    frame = spark.createDataFrame(rows, "doc_id string, page int, part_found string, section_found string, subsection_found string, prior_section string, prior_subsection string, toc_active boolean, allowed array<string>")
    got = pages.page_labels(frame, cross_major=cross, width=16).orderBy("doc_id", "page").collect()
    want = [x for doc in "abc" for x in plain_labels([r for r in rows if r[0] == doc], cross)]
    assert [(r.doc_id, r.page, r.part, r.section_title, r.subsection_title, r.overrides, r.rejected) for r in got] == want
    assert pages.label_diagnostics(pages.page_labels(frame, cross)).agg(F.sum("subsection_reject_count")).first()[0] == sum(x[6] for x in want)


def test_equal_headers_are_mapped_once(spark):
    head = [" Start  Time", "End Time", "Dur (hr)", "Phase ", "Op Code", "Activity Code", "P-T-X", "Operation Details"]
    cells = [None, [], [None, " a\t b\u0085"], *[head] * 500, ["dur", "phase"], ["x​y", "", "  "]]
    batch = pa.RecordBatch.from_pydict({"row_no": list(range(len(cells))), "cells": pa.array(cells, pa.list_(pa.string()))})
    extract.column_map.cache_clear()
    (got,) = extract._read([batch])
    seen = extract.column_map.cache_info()
    assert seen.hits + seen.misses == 2
    rows = got.to_pylist()
    assert [(r["cells"], r["filled"], r["head"], r["line"]) for r in rows[:3]] == [([], 0, "", ""), ([], 0, "", ""), (["", "a b"], 1, "", " a b")]
    assert rows[-1]["cells"] == ["x​y", "", ""] and rows[-1]["map"] is rows[-2]["map"] is rows[0]["map"] is None
    assert all(list(r["map"].values()) == [1, 2, 3, 4, 5, 6, 7, 8] and r["line"] == "Start Time End Time Dur (hr) Phase Op Code Activity Code P-T-X Operation Details" for r in rows[3:503])
    assert got.num_rows == extract.read_cells(spark.createDataFrame([("d", 1, 0, k, c) for k, c in enumerate(cells)], CELLS)).count()


def test_cells_are_cleaned_as_by_collapse(spark):
    blanks = [chr(k) for k in range(0x3100) if not 0xD800 <= k < 0xE000]
    rows = spark.createDataFrame([("d", 1, 0, k, [f"{c}a{c}{c}b{c}", f"a{c}b", f" {c}"]) for k, c in enumerate(blanks)], CELLS)
    want = rows.select("row_no", F.transform("cells", text.collapse).alias("cells"))
    assert extract.read_cells(rows).select("row_no", "cells").exceptAll(want).count() == 0
