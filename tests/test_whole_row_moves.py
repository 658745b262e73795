"""Operation rows: continuations over several stretches, and how often whole rows are moved."""

from __future__ import annotations

import random

from fieldbook.operators import extract

CELLS = "doc_id string, page int, table_no int, row_no int, cells array<string>"
HEAD = ["Start Time", "End Time", "Dur (hr)", "Phase", "Op Code", "Activity Code", "P-T-X", "Operation"]


def _row(start, text):
    return [start, "", "2.0" if start else "", "P", "Drilling", "DRLG", "P", text]


def _written(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    s = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(s.apply(i).shuffleWriteRecords() for i in range(s.size()))


def test_continuations_over_several_stretches(spark):
    table = [HEAD, _row("06:00", "a"), _row("07:00", "b")] + [_row("", f"t{k}") for k in range(7)] + [_row("08:00", "c"), _row("", "u")]
    data = [("d", 1, 0, k, cells) for k, cells in enumerate(table)] + [("d", 2, 0, 0, _row("", "v")), ("d", 2, 0, 1, _row("09:00", "e"))]
    for across, last in ((False, "c u"), (True, "c u v")):
        got = extract.operation_rows(spark.createDataFrame(data, CELLS), across=across, width=2).orderBy("page", "row_no").collect()
        assert [r.operation_text for r in got][:3] == ["a", "b t0 t1 t2 t3 t4 t5 t6", last]


def test_whole_rows_move_seldom(spark):
    rng = random.Random(3)
    data = [(f"d{k % 40}", 1, 0, k // 40, HEAD if k < 40 else _row("06:00" if rng.random() < 0.8 else "", f"x{rng.random()}")) for k in range(6000)]
    rows = spark.createDataFrame(data, CELLS)
    for across in (False, True):
        before = _written(spark)
        assert extract.operation_rows(rows, across=across, width=32).count() > 4000
        assert _written(spark) - before < 2 * len(data)
