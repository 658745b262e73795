"""The Merkle manifest against plain hashing, with small superblocks so that several rounds are needed."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fieldbook.llm import manifest

from test_llm_operators import SCHEMA, corpus


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return sha(*(enc(v) for v in (r[0], r[3], r[2], r[4], text)))


def tree(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + fan]) for i in range(0, len(last), fan)])
    return levels


def way(levels, at, fan):
    out = []
    for nodes in levels[:-1]:
        first = at - at % fan
        out.append((nodes[first:at], nodes[at + 1 : first + fan]))
        at //= fan
    return out


def brute(rows, fan=8):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], leaf(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree([x[1] for x in by[lang]], fan) for lang in langs]
    top = tree([t[-1][0] for t in trees], fan) if trees else [[None]]
    out = []
    for k, lang in enumerate(langs):
        for at, (id_, own, r) in enumerate(by[lang]):
            path = way(trees[k], at, fan) + way(top, k, fan)
            hit = id_ is not None and r[1] is not None and zlib.crc32(str(id_).encode()) % 3 == 0
            node = leaf(r, r[1].translate(lower)) if hit else own
            for left, right in path:
                node = sha(*left, node, *right)
            out.append((id_, own, trees[k][-1][0], top[-1][0], sha(*(x for p in path for side in p for x in side)), node, node == top[-1][0]))
    return sorted(out, key=str)


def found(docs, **kw):
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return sorted((tuple(r) for r in manifest.manifest(docs, lowered, **kw).collect()), key=str)


@pytest.mark.parametrize(("fan", "depth"), [(8, 4), (3, 2)])
def test_manifest_matches_plain_hashing(spark, tmp_path, fan, depth):
    rows = corpus() + [(500 + k, "Upper Case %d" % k, f"l{k % 12}", None, k, *[None] * 7) for k in range(60)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    got = found(spark.read.parquet(path), fan=fan, depth=depth)
    assert got == brute(rows, fan)
    assert {r[6] for r in got} == {True, False}


def test_unstored_frame_and_edges(spark):
    rows = corpus()
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert found(spark.createDataFrame(rows[:1], SCHEMA)) == brute(rows[:1])
    assert found(spark.createDataFrame([], SCHEMA)) == []
