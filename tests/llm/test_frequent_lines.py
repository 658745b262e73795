"""Passages made of frequent lines, whose suffixes have many neighbours, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from fieldbook.llm import suffixes


@pytest.mark.parametrize(("lines", "size", "docs"), [(20, 18, 260), (3, 12, 60)])
def test_frequent_lines_hide_nothing(spark, tmp_path, lines, size, docs):
    rng = random.Random(lines)
    line = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(size)) for _ in range(lines)]
    texts = [" ".join(rng.choice(line) for _ in range(rng.randrange(3, 9))) for _ in range(docs)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(path)
    words = [t.split() for t in texts]
    seen = Counter(" ".join(w[i : i + 50]) for w in words for i in range(len(w) - 49))
    want = {}
    for k, w in enumerate(words):
        hit = [False] * len(w)
        for i in range(len(w) - 49):
            if seen[" ".join(w[i : i + 50])] > 1:
                hit[i : i + 50] = [True] * 50
        want[k] = sum(hit)
    assert {r.id: r.n_repeated for r in suffixes.repeated_passages(spark.read.parquet(path)).collect()} == want
    assert any(want.values()) and not all(want.values())
    left = Counter()
    for r in suffixes.cut_repeats(spark.read.parquet(path)).collect():
        w = r.text.split()
        left.update(" ".join(w[i : i + 50]) for i in range(len(w) - 49))
    assert set(left.values()) <= {1, 2}  # a cut may bring two halves together anew
