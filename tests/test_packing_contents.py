"""Packing, the state scan, contents items and page offsets against plain loops and planted cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fieldbook.operators import contents, ordered, packing


def greedy(rows, target, most, facts):
    """(first, last) of row blocks, row by row."""
    def total(group):
        names = []
        for r in group:
            if r[5] and r[5].lower() != "general" and r[5] not in names:
                names.append(r[5])
        lines = [f for r in group for f in r[4]][:facts]
        heading = 0 if not names else 2 + len(names[0].split()) if len(names) == 1 else 3 + len(" | ".join(names[:4]).split())
        return group[0][2] + sum(r[3] for r in group) + (sum(r[6] for r in group) if len(names) > 1 else 0) + heading + (1 + sum(lines) if lines else 0)

    out, group = [], []
    for r in rows:
        if group and (len(group) >= most or total([*group, r]) > target):
            out.append((group[0][1], group[-1][1], total(group)))
            group = []
        group.append(r)
    return [*out, (group[0][1], group[-1][1], total(group))]


SCHEMA = "t string, idx int, head int, words int, facts array<int>, category string, shown int"


def table(t, n, seed):
    rng = random.Random(seed)
    return [(t, k, 9, rng.choice([1, 5, 30, 80, 400]), [rng.randrange(1, 5) for _ in range(rng.randrange(9))], rng.choice([None, "General", "costs", "costs of fuel", "staff"]), rng.randrange(3)) for k in range(n)]


def test_row_blocks_equal_greedy_packing(spark):
    tables = {"a": table("a", 700, 1), "b": table("b", 33, 2), "c": table("c", 1, 3)}
    frame = spark.createDataFrame([r for rows in tables.values() for r in rows], SCHEMA)
    got = packing.row_blocks(frame, ["t"], block=16).orderBy("t", "row_start_idx").collect()
    want = [(t, a, b) for t, rows in tables.items() for a, b, _ in greedy(rows, 320, 10, 24)]
    assert [(r.t, r.row_start_idx, r.row_end_idx) for r in got] == want
    hard = packing.row_blocks(frame, ["t"], target=320, hard=200, block=64).orderBy("t", "row_start_idx").collect()
    want = [(t, x, y) for t, rows in tables.items() for a, b, n in greedy(rows, 320, 10, 24) for x, y in ([(a, b)] if a == b or n <= 200 else [(k, k) for k in range(a, b + 1)])]
    assert [(r.t, r.row_start_idx, r.row_end_idx) for r in hard] == want
    assert packing.row_blocks(frame.limit(0), ["t"]).count() == 0


def test_budget_blocks_and_texts(spark):
    rng = random.Random(6)
    rows = [("a", k, 3, rng.choice([1, 2, 9, 60]), f"line {k}") for k in range(300)]
    frame = spark.createDataFrame(rows, "t string, idx int, head int, tokens int, line string")
    blocks = packing.budget_blocks(frame, ["t"], 10, block=50)
    want, group = [], []
    for r in rows:
        if group and 3 + sum(x[3] for x in group) + r[3] > 40:
            want.append(group)
            group = []
        group.append(r)
    want = ["\n".join(["HEAD", *(x[4] for x in g)]) for g in [*want, group]]
    assert [r.chunk_text for r in packing.chunk_texts(frame, blocks, ["t"], F.lit("HEAD")).orderBy("row_start_idx").collect()] == want


def test_state_scan_over_several_levels(spark):
    rng = random.Random(2)
    rows = [(t, b, [rng.randrange(4) for _ in range(4)]) for t, n in (("a", 60), (None, 7), ("c", 1)) for b in range(n)]
    got = {(r.t, r.b): r.entry for r in ordered.state_scan(spark.createDataFrame(rows, "t string, b int, m array<int>"), ["t"], "b", "m", start=2, fan=3).collect()}
    state, last = 2, "a"
    for t, b, m in rows:
        state = state if t == last else 2
        last = t
        assert got[t, b] == state
        state = m[state]


LINES = "doc_id string, page int, line_no int, text string"


def items(spark, lines, blob="", n_pages=80):
    frame = spark.createDataFrame([("d", p, k, t) for p, ts in lines.items() for k, t in enumerate(ts)], LINES)
    pages = spark.createDataFrame([("d", p, blob, n_pages) for p in lines], "doc_id string, page int, clean_text string, n_pages int")
    return [(r.title_raw, r.start_printed_page, r.level) for r in contents.contents_items(frame, pages).orderBy("pos").collect()]


def test_contents_items_in_every_form(spark):
    lines = {2: ["Contents", "Page", "Performance Report", "5", "a) Overview of the", "year ........ 6", "Our strategic plans", "and the", "risks to it", "risks", None, "12", "Staff costs", "ACCOUNTABILITY REPORT"],
             3: ["i) Governance statement 20", "note: all figures", "word", "Notes 1999 to 4321", "Audit opinion", "31", "Audit opinion 31", "FINANCIAL STATEMENTS"]}
    assert items(spark, lines) == [
        ("Performance Report", 5, 1), ("a) Overview of the year", 6, 2), ("Our strategic plans and the risks to it", 12, 2), ("Staff costs", 20, 2),
        ("ACCOUNTABILITY REPORT i) Governance statement", 20, 1), ("Audit opinion", 31, 2), ("FINANCIAL STATEMENTS", 31, 1)]


def test_contents_of_one_line_and_edges(spark):
    blob = "Page Introduction to it 3 b) Staff and people 14 Some text Performance Report overview 20 1999 x 21"
    assert items(spark, {1: ["nothing"]}, blob) == [("Introduction to it", 3, 2), ("b) Staff and people", 14, 2), ("Performance Report overview", 20, 1), ("1999 x", 21, 2)]
    assert items(spark, {1: [None, ""]}) == []


def test_page_offset_planted(spark):
    body = {p: f"plain page number {p}" for p in range(1, 31)}
    titles = [("strategic energy review", 4), ("remuneration of senior staff", 9), ("independent auditor opinion", 15), ("cash flow tables", 21)]
    for t, p in titles:
        body[p + 3] = f"{t} and more words"
    body[2] = " ".join(t for t, _ in titles)
    pages = spark.createDataFrame([("d", p, t) for p, t in body.items()], "doc_id string, page int, clean_text string")
    frame = spark.createDataFrame([("d", t, p) for t, p in [*titles, ("the year", 40)]] + [("none", "missing words here", 3)], "doc_id string, title_norm string, start_printed_page int")
    toc = spark.createDataFrame([("d", 2)], "doc_id string, page int")
    got = {r.doc_id: (r.offset, round(r.confidence, 4), r.support_count) for r in contents.page_offset(frame, pages, toc).collect()}
    assert got == {"d": (3, round(0.5 + 0.5 * 5 / 12, 4), 4), "none": (0, 0.15, 0)}
