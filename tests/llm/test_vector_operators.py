"""Hard negatives and near-duplicate embeddings against brute force over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.llm import covertree, hardnegatives

SCHEMA = "vec_id long, embedding array<double>, label int, row long, node long, cell int, job long, n long, score double"
CLASH = (9, 9, 9, 9, 9, 0.5)


def table(seed: int = 5, clusters: int = 6, each: int = 40, dim: int = 6) -> list[tuple]:
    """Clusters of near copies with chains in them, scattered vectors, a very common vector, ties and unsound rows."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(clusters):
        centre, step = rng.standard_normal(dim), rng.standard_normal(dim) * 0.06
        for k in range(each):
            out.append((centre + step * k * rng.random() + rng.standard_normal(dim) * 0.02) * rng.choice([0.5, 1.0, 2.0]))
    out += list(rng.standard_normal((120, dim)))
    out += [out[3]] * 50 + [out[3] * 2.0, out[7] * 0.5, out[7] * 0.25]
    labels = random.Random(seed)
    rows = [(k, v.tolist(), labels.choice([0, 0, 0, 1, 2])) for k, v in enumerate(out)]
    rows += [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [math.nan] + [1.0] * (dim - 1), 1), (1003, [math.inf] + [1.0] * (dim - 1), 1)]
    rows += [(1004, [None] + [1.0] * (dim - 1), 1), (1005, [], 1), (1006, rows[3][1], None), (None, rows[3][1], rows[3][2]), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0)]
    return [(*r, *CLASH) for r in [*rows, rows[5], rows[5]]]


def sound(r, zero=False):
    v = r[1]
    return r[2] is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def brute_links(rows, least=0.98):
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n = [0] * len(rows)
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if not sound(a) or not sound(b) or a[2] != b[2] or len(a[1]) != len(b[1]):
                continue
            x, y = np.array(a[1]), np.array(b[1])
            if (x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())) >= least:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    first = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            first[find(k)] = min(first.get(find(k), r[0]), r[0])
    return sorted(((r[0], n[k], first.get(find(k)), r[0] is not None and r[0] == first.get(find(k))) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("cell", "tile"), [(covertree.CELL, covertree.TILE_BYTES), (40, 1)])
def test_near_vectors_match_all_pairs(spark, tmp_path, monkeypatch, cell, tile):
    rows = table()
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    monkeypatch.setattr(covertree, "TILE_BYTES", tile)
    got = sorted((tuple(r) for r in covertree.near_vectors(spark.read.parquet(path), cell=cell).collect()), key=str)
    assert got == brute_links(rows)
    assert max(n for _, n, _, _ in got) >= 30


def test_near_vectors_edges(spark):
    rows = table()
    unsound = [r for r in rows if not sound(r)]
    assert sorted((tuple(r) for r in covertree.near_vectors(spark.createDataFrame(unsound, SCHEMA)).collect()), key=str) == brute_links(unsound)
    assert covertree.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_dual_traversal_finds_exactly_the_pairs(seed):
    rng = np.random.default_rng(seed)
    raw = np.concatenate([rng.standard_normal((1, 5)) + rng.standard_normal((60, 5)) * s for s in (0.01, 0.1, 0.3, 3)])
    raw = np.concatenate([raw, raw[:9] * 2.0])[rng.permutation(249)]
    for shift in (0, 100):
        x, links = covertree.unit(raw), covertree.Links(np.arange(1, 250))
        near = np.array([covertree.cosines(raw, np.broadcast_to(r, raw.shape)) for r in raw]) >= 0.98
        np.fill_diagonal(near, False)
        if shift:
            covertree.dual(covertree.CoverTree(x[:shift]), covertree.CoverTree(x[shift:]), raw, shift, links)
            near[:shift, :shift] = near[shift:, shift:] = False
        else:
            covertree.dual(covertree.CoverTree(x), None, raw, 0, links)
        assert (links.sum == near @ np.arange(1, 250)).all()
        child, root = links.forest()
        label = np.arange(249)
        label[child] = root
        assert all(label[a] == label[b] for a, b in zip(*np.nonzero(near), strict=True))
        assert all(near[a].any() for a in child.tolist())


def brute_negatives(rows, every=10, scale=256):
    own = [(r[0], r[2], [math.floor(scale * x) for x in r[1]], k) for k, r in enumerate(rows) if r[0] is not None and sound(r, True) and len(r[1]) == 6]
    out = []
    for a in own:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1] == a[1]) for b in own if b[3] != a[3])
        for s, p, _ in [x for x in scored if x[2]][:5]:
            inside = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("leaf", "tile"), [(hardnegatives.LEAF, hardnegatives.TILE_BYTES), (8, 1)])
def test_hard_negatives_match_all_pairs(spark, tmp_path, monkeypatch, leaf, tile):
    rows = table(9)
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    monkeypatch.setattr(hardnegatives, "LEAF", leaf)
    monkeypatch.setattr(hardnegatives, "TILE_BYTES", tile)
    got = sorted(tuple(r) for r in hardnegatives.hard_negatives(spark.read.parquet(path), F.col("id") % 10 == 0).collect())
    assert got == brute_negatives(rows) and len(got) > 300


def test_hard_negatives_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hardnegatives.hard_negatives(empty, F.col("id") % 10 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, *CLASH), (1, [0.9, 0.1], 1, *CLASH), (2, [0.8, 0.5], 2, *CLASH), (3, [1e12, 0.0], 2, *CLASH)], SCHEMA)
    got = hardnegatives.hard_negatives(few, F.col("id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 58880, 52224)]
    assert hardnegatives.hard_negatives(few, F.col("id") == 77).collect() == []


def test_siblings_are_eliminated():
    rng = np.random.default_rng(2)
    x = (np.concatenate([c + rng.standard_normal((400, 3)) * 0.02 for c in rng.standard_normal((12, 3)) * 4]) * 256).astype(np.int64)
    most = float((x * x).sum(1).max())
    seen = {}
    tree = hardnegatives.Tree(most).fit(hardnegatives.lifted(x, most), 10)
    leaf = tree.place(hardnegatives.lifted(x, most), seen)
    for number, node in enumerate(tree.nodes):
        node.low, node.high = seen[number]
    scores = hardnegatives.inner(x[:50], x)
    low = np.sort(scores, 1)[:, -20].astype(float)
    one, met = tree.meet(x[:50], low, np.full(50, 1e12))
    pairs = set(zip(one.tolist(), met.tolist(), strict=True))
    assert all((a, int(leaf[b])) in pairs for a, b in zip(*np.nonzero(scores >= low[:, None]), strict=True))
    assert len(pairs) < 50 * tree.leaves / 3
