"""Numeric answers, page regions, chunk overlaps and sleeves by hand and against plain loops."""

from __future__ import annotations

import datetime
import random

from fieldbook.operators import answers, regions, sleeves


def test_numeric_answers_by_hand(spark):
    asked = spark.createDataFrame([(1, "What was the budget deficit?"), (2, "Which percentage of posts is vacant?"), (3, "What did fuel cost?"), (4, "How many boats?"), (5, None)], "query_id int, question string")
    hits = spark.createDataFrame([
        (1, "a", 1, False, "In 2019/20 the budget variance £000 was a deficit of (1,250) overall"), (1, "b", 2, True, "total cash requirement £9 million"), (1, "c", 3, False, None),
        (2, "d", 1, False, "Of posts 12.50% were vacant, 3 more"), (3, "e", 4, False, "fuel 450000 litres cost"), (4, "f", 9, False, "Boats 20/2021 only"), (4, "g", 30, False, "seen in 1999")],
        "query_id int, chunk_id string, rank int, is_table boolean, chunk_text string")
    found = answers.numeric_candidates(asked, hits)
    picks, top = answers.numeric_answers(asked, found)
    got = {r.query_id: (r.reason, r.raw, r.canonical) for r in picks.collect()}
    assert got == {1: ("selected", "(1,250) (£000)", "-£1,250,000"), 2: ("selected", "12.50%", "12.5%"), 3: ("currency_unit_not_supported", None, None), 4: ("low_confidence", None, None), 5: ("no_numeric_candidates", None, None)}
    assert {r.query_id: r.candidate_count for r in picks.collect()}[4] == 1
    assert [r.place for r in top.filter("query_id = 1").orderBy("place").collect()] == [1, 2]


def plain_regions(lines):
    lines = sorted(lines, key=lambda l: (l[1], l[0], l[4]))
    heights = sorted(h for h in (l[3] - l[1] for l in lines) if h > 0)
    mid = (heights[(len(heights) - 1) // 2] + heights[len(heights) // 2]) / 2 if heights else 10
    gap = max(18, max(mid, 1) * 1.8)
    groups, last = [], None
    for l in lines:
        if groups and not l[1] - (last or l[1]) > gap:
            groups[-1].append(l)
        else:
            groups.append([l])
        last = l[3]
    for near in (True, False):
        out = []
        for g in groups:
            if out and len(g) < 2 and (not near or min(x[1] for x in g) - max(x[3] for x in out[-1]) <= 10):
                out[-1] += g
            else:
                out.append(list(g))
        groups = out
    return [(len(g), min(x[0] for x in g), min(x[1] for x in g), max(x[2] for x in g), max(x[3] for x in g)) for g in groups]


def test_page_regions_equal_a_loop(spark):
    rng = random.Random(7)
    pages = {}
    for page in range(30):
        y, pages[page] = 0.0, []
        for k in range(rng.randrange(1, 25)):
            y += rng.choice([0, 8, 12, 20, 60])
            pages[page].append((float(rng.randrange(50)), y, 100.0 + k, y + rng.choice([0, 6, 10, 30, 90]), k))
            y += 6
    frame = spark.createDataFrame([("d", p, l[4], f"t{l[4]}", *l[:4]) for p, ls in pages.items() for l in ls], "doc_id string, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    got = regions.page_regions(frame).orderBy("page", "region_index").collect()
    want = [(p, k, *r) for p, ls in pages.items() for k, r in enumerate(plain_regions(ls))]
    assert [(r.page, r.region_index, r.line_count, r.x0, r.y0, r.x1, r.y1) for r in got] == want
    assert got[0].region_id == "p0000_r00" and regions.page_regions(frame.limit(0)).count() == 0


def test_border_is_the_longest_overlap():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(9))] for _ in range(2))
        assert regions.border(a, b) == max((k for k in range(min(len(a), len(b)) + 1) if not k or a[-k:] == b[:k]))


def test_sleeves_by_hand(spark):
    day = lambda n: datetime.date(2024, 5, n)
    ops = [
        ("w", 1, day(3), 2, "Packer not set at sleeve #1"), ("w", 2, day(2), 1, "Unable to locate sleeve 1"), ("w", 3, day(4), 1, "Observed sleeve 1 open at 3,500 psi, ISIP = 2,100 psi"), ("w", 4, day(5), 1, "packer not sealing, sleeve 1"),
        ("w", 5, day(4), 3, "Main frac on sleeve 2: 12,000 lbs proppant, 500 lbs sand; 300 bbls of linear gel"), ("w", 6, day(6), 1, "Packer set on sleeve 3. Injected 30.5 bbls"), ("w", 7, day(6), 2, "sleeve 19 seen"), ("w", 8, None, 1, None), ("v", 9, day(1), 1, "no sleeves")]
    ops = spark.createDataFrame(ops, "well_id string, seq int, report_date date, page int, operation_text string")
    nos = spark.createDataFrame([(day(2), 12)], "report_date date, report_no int")
    rows = {(r.well_id, r.sleeve_no): r for r in sleeves.sleeve_status(sleeves.sleeve_folds(ops, nos), ops).collect()}
    assert len(rows) == 36
    one, two, three = rows["w", 1], rows["w", 2], rows["w", 3]
    assert (one.status, one.open_psi, one.isip_psi, one.notes, one.ddr_citation) == ("OPENED", 3500.0, 2100.0, "packer sealing issue", "DDR-12 · p.1 · 2024-05-02")
    assert one.review_reason.startswith("Opening pressure recorded") and (one.first_date, one.last_date) == ("02/05/2024", "05/05/2024")
    assert (two.status, two.proppant_lbs_total, two.fluid_vol_bbl, two.notes) == ("OPENED", 12000.0, 300.0, "proppant injected — sleeve confirmed open") and two.review_flag
    assert (three.status, three.review_reason) == ("LOCATED", "Fluid injected (30 bbl) but sleeve not confirmed open")
    assert rows["v", 18].status == "NOT FRACKED" and not rows["v", 18].review_flag
