"""Steps whose work or memory once grew faster than their input."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fieldbook.functions import text
from fieldbook.operators import audit, ordered, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_counts_of_numbers_are_not_broadcast(spark):
    names = ["RigAlpha DDR 1 FLDX RB 12.04.2024.pdf", "RigAlpha DDR 1 FLDX R2 13.04.2024.pdf", "RigAlpha DDR 3 FLDX RB 14.04.2024.pdf", "notes.txt"]
    files = spark.createDataFrame([(n, 1) for n in names], "source_filename string, file_size_bytes bigint")
    found = audit.issues(ordered.stored(audit.parse_filenames(files)))
    kinds = sorted((r.issue_type, r.ddr_number) for r in found.collect())
    assert kinds == [("duplicate_ddr_number", 1), ("duplicate_ddr_number", 1), ("missing_report", 2), ("unparsed_filename", None)]
    keys = [line.split("BroadcastHashJoin ")[1].split("]")[0] for line in plan(found).splitlines() if "BroadcastHashJoin " in line]
    assert not any("ddr_number" in k or "safe_doc_id" in k for k in keys)


def test_section_titles_are_cleaned_once(spark):
    rows = [("Notes to the accounts (cont.)", "FINANCIAL STATEMENTS"), ("the  performance report continued", "PERFORMANCE REPORT"), ("unknown", "Unknown"), (None, "Unknown"), ("Weather log", "WEATHER LOG")]
    titles = spark.createDataFrame(rows, "t string, v string")
    found = titles.select("v", text.canonical_section(F.col("t")).alias("got"))
    assert all(r.got == r.v for r in found.collect())
    made = found._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("regexp_replace") <= 10


def test_scores_of_chunks_are_summed_where_their_tokens_are(spark):
    chunks = spark.createDataFrame([(1, "mud pump failed"), (2, "mud losses mud"), (3, "")], "chunk_key long, chunk_text string")
    asked = spark.createDataFrame([(7, "mud pump"), (8, "losses")], "query_id long, question string")
    found = retrieval.bm25(chunks, asked)
    assert {(r.query_id, r.chunk_key) for r in found.collect()} == {(7, 1), (7, 2), (8, 2)}
    made = plan(found).split("Initial Plan")[-1]
    assert "hashpartitioning(query_id" not in made
    assert made.count("hashpartitioning(chunk_key") == 1


def test_lengths_of_vectors_are_summed_once(spark):
    """The sum stands outside of the loop over the components."""
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)]
    found = spark.createDataFrame(rows, "v array<float>").select(retrieval.l2_normalize(F.col("v")).alias("u"))
    assert [r.u and [round(x, 9) for x in r.u] for r in found.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
    made = found._jdf.queryExecution().analyzed().toString()
    assert made.index("aggregate(") < made.index("transform(v#")


def _written(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    s = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(s.apply(i).shuffleWriteRecords() for i in range(s.size()))


def _corpus(spark, folder):
    words = ["mud", "pump", "valve", "torque", "brake", "crane", "liner", "packer"]
    docs = [(k, f"src{k % 3}", " ".join(words[(k * j + j) % 8] for j in range(1, 3 + k % 20)) + " Mud") for k in range(1200)] + [(1200, None, "mud crane"), (1201, "src1", None)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    asked = [(k, f"{words[k % 8]} {words[k // 2]} pump mud?") for k in range(12)]
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["bm25_scores", "rank_documents", "retrieval_margin", "bm25_scoped"])
def test_tokens_are_not_shuffled(spark, tmp_path, name):
    folder = _corpus(spark, tmp_path)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    before = _written(spark)
    got = __spark_entry__.queries()[name](spark, folder)
    rows = sorted(map(repr, (tuple(r) for r in got.collect())))
    assert _written(spark) - before < 8000  # two tasks' lists of 12 questions; the tokens of the documents are 13,000
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert rows == sorted(map(repr, want))


def test_best_chunks_in_slices_of_questions(spark, tmp_path, monkeypatch):
    folder = _corpus(spark, tmp_path)
    monkeypatch.setattr(retrieval, "SLICE", 5)
    monkeypatch.setattr(retrieval, "BLOCK", 64)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.concat(F.lit("k"), "doc_id").alias("chunk_key"), F.col("text").alias("chunk_text"))
    asked = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.col("text").alias("question"))
    lists = [retrieval.rank(f, 7).select("query_id", "rank", "chunk_key", F.round("score", 8)) for f in (retrieval.bm25_best(docs, asked, 7), retrieval.bm25(docs, asked))]
    got, want = (sorted(map(tuple, x.collect())) for x in lists)
    assert got == want and len(got) == 84
    assert retrieval.bm25_best(docs, asked.limit(0), 7).count() == retrieval.bm25_best(docs.limit(0), asked, 7).count() == 0
