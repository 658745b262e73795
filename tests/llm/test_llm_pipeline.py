"""The corpus pipeline, stage by stage, on the small tables, and its edge cases."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from fieldbook.llm.langid import letters

from test_llm_operators import SCHEMA, brute_hits, corpus
from test_near_copies import brute_firsts

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tests = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs.collect())
        assert docs.columns[: len(columns)] == columns
    before, after = seen["language_id"]
    assert {r.doc_id for r in before if letters(r.text)} == {r.doc_id for r in after}
    before, after = seen["near_dedup"]
    assert brute_firsts([(r.doc_id, r.text) for r in before]) == sorted((r.doc_id is None, r.doc_id or 0) for r in after)
    before, after = seen["decontamination"]
    left = {r.doc_id: r.text for r in after}
    for r in before:
        n, hit, _ = brute_hits(r.text, tests)
        if not hit:
            assert left[r.doc_id] == r.text
        elif hit <= n / 2:
            assert brute_hits(left[r.doc_id], tests)[1] == 0
        else:
            assert r.doc_id not in left
    before, after = seen["mixing"]
    times = Counter(r.doc_id for r in after)
    assert set(times) <= {r.doc_id for r in before} and max(times.values()) <= 2
    before, after = seen["sharding"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after) and {r.shard for r in after} <= set(range(16))
    assert len({(r.shard, r.slot) for r in after}) == len(after)


def test_run_and_edge_cases(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    items = spark.createDataFrame([(1, corpus()[2][1])], "item_id long, text string")
    for at in "ab":
        items.write.parquet(f"{tmp_path}/{at}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert out.columns[-2:] == ["shard", "slot"] and out.where(F.col("text").isNull()).count() == 0 and out.count() > 20
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
