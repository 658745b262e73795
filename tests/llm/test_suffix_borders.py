"""Each suffix at the border of a task is there once."""

from __future__ import annotations

import pyarrow as pa
import pytest

from fieldbook.llm import suffixes


@pytest.mark.parametrize("cuts", [[1], [3], [1, 2], [4, 1], [5, 2], [20]])
def test_border_suffixes_come_once(cuts):
    n = sum(cuts)
    rows = [(k, 7, 0, b"abcd" * 50, b"") for k in range(n)]
    starts = [sum(cuts[:k]) for k in range(len(cuts))]
    batches = [suffixes._suffix_batch(rows[s : s + c]) for s, c in zip(starts, cuts, strict=True)]
    out = pa.Table.from_batches(suffixes._neighbours(50, True)(iter(batches))).to_pylist()
    got = sorted(r["row"] for r in out if r["start"] is None)
    head, tail = range(min(suffixes.DEPTH, cuts[0])), range(max(n - suffixes.DEPTH, 0), n)
    assert got == sorted({*head, *tail})
