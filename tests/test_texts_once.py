"""Texts are read once, however often an operator uses what it finds in them."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from fieldbook.functions.text import Vocabulary
from fieldbook.operators import contents, events, graph, hours, pages, sleeves

N, DAY = 60, datetime.date(2024, 1, 1)
OPS = "well_id string, seq int, report_date date, report_hour double, page int, phase string, op_code string, is_npt boolean, npt_category string, npt_cat_label string, duration_hr double, text string"


def _frame(spark, text):
    data = [(f"W{k % 2}", k, DAY + datetime.timedelta(k % 5), float(k % 7), 1, "P1", "Drilling", k % 3 > 0, "equipment", "Equipment", 30.0, text) for k in range(N)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(t):
        seen.add(1)
        return t

    return spark.createDataFrame(data, OPS).withColumn("operation_text", read.asNondeterministic()("text")).drop("text"), seen


def _items(df):
    t = df.select(F.col("well_id").alias("doc_id"), F.col("operation_text").alias("title_norm"), F.col("seq").alias("start_printed_page"))
    body = df.sparkSession.createDataFrame([("W0", 5, "pump brake torque")], "doc_id string, page int, clean_text string")
    return contents.page_offset(t, body, body.select("doc_id", "page").limit(0))


def _chunks(df):
    return pages.corpus_metrics(df.select(F.col("well_id").alias("doc_id"), "page", F.length("operation_text").alias("word_count")))


NOS = "report_date date, report_no int"
CASES = {
    "takeaways": ("pump failed", hours.takeaways),
    "metric_summary": ("ROP 30 ft/hr with WOB 12 klbs", lambda df: events.metric_summary(events.metrics(df))),
    "sleeve_folds": ("Packer not set, sleeve 4", lambda df: sleeves.sleeve_folds(df, df.sparkSession.createDataFrame([], NOS))),
    "prune": ("pump brake torque failed", lambda df: graph.prune(graph.cooccurrence(graph.row_terms(df, Vocabulary())))),
    "norm_weights": ("pump brake torque failed", lambda df: graph.norm_weights(graph.cooccurrence(graph.row_terms(df, Vocabulary())))),
    "page_offset": ("pump brake torque", _items),
    "corpus_metrics": ("pump brake torque", _chunks),
}


@pytest.mark.parametrize("name", CASES)
def test_texts_are_read_once(spark, name):
    text, run = CASES[name]
    df, seen = _frame(spark, text)
    assert run(df).count() > 0
    run_rows = seen.value
    assert run_rows == N


def test_window_pairs_of_equal_lists(spark):
    rows = spark.createDataFrame([("P1", DAY, "d", float(k), k, ["a", "b"] if k % 2 else ["b", "c"]) for k in range(8)], "phase string, report_date date, doc_id string, report_hour double, seq int, terms array<string>")
    got = {(r.a, r.b): r.weight for r in graph.cooccurrence(rows).collect()}
    assert got == {("a", "b"): 4, ("b", "c"): 4}
    wide = {(r.a, r.b): r.weight for r in graph.cooccurrence(rows, window=1).collect()}
    assert wide == {("a", "b"): 8, ("b", "c"): 7, ("a", "c"): 7}
