"""Rows keep their number when scans are split anew, and frames that are not stored give the same results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldbook.llm import common, mixing, nearcopies, sharding, simhash, suffixes

from test_llm_operators import SCHEMA, corpus


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("numbered") / "documents.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(5).write.option("parquet.block.size", 4096).parquet(at)
    return at


OPERATORS = {
    "mixed": mixing.mixed,
    "sharded": lambda d: sharding.sharded(d, 4),
    "near_copies": nearcopies.drop_near_copies,
    "near_duplicates": simhash.drop_near_duplicates,
    "repeated": suffixes.repeated_passages,
    "cut": suffixes.cut_repeats,
}


def seen(df):
    return sorted(map(str, df.collect()))


def test_numbers_do_not_depend_on_splits(spark, path):
    found = []
    for size in ("8m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        numbered = common.numbered(spark.read.parquet(path), "__row")
        found.append(seen(numbered))
        assert numbered.select("__row").distinct().count() == len(corpus())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    assert found[0] == found[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_scans_split_anew_give_the_same_rows(spark, path, monkeypatch, name):
    want = seen(OPERATORS[name](spark.read.parquet(path)))
    sizes, plain = ["3k", "8m", "11k"], common.settle

    def settle(df, label):
        out = plain(df, label)
        sizes.append(sizes.pop(0))
        spark.conf.set("spark.sql.files.maxPartitionBytes", sizes[0])
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(len(sizes[0])))
        return out

    for module in (common, mixing, sharding, nearcopies, simhash, suffixes):
        monkeypatch.setattr(module, "settle", settle)
    try:
        assert seen(OPERATORS[name](spark.read.parquet(path))) == want and want
        if name != "sharded":  # equal rows are dealt to slots in any order
            assert seen(OPERATORS[name](spark.createDataFrame(corpus(), SCHEMA).coalesce(1))) == want or name in ("cut", "mixed")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_unstored_frames(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    out = sharding.sharded(docs, 4)
    assert out.count() == len(corpus()) and out.select("shard", "slot").distinct().count() == len(corpus())
    assert mixing.mixed(docs).count() > 20


@pytest.mark.parametrize("limit", [common.BITMAPS, 0])
def test_flagged(spark, path, limit):
    docs = common.numbered(spark.read.parquet(path), "__row")
    chosen = docs.where("doc_id % 3 = 1").select(F.col("__row").alias("row"))
    rows = common.flagged(docs, "__row", chosen.unionByName(chosen.limit(2)), "hit", limit).collect()
    assert len(rows) == len(corpus()) and all(r.hit == (r.doc_id is not None and r.doc_id % 3 == 1) for r in rows)
