"""Queries over lookups and vocabulary checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.operators import lookups as lk
from fieldbook.operators import ordered
from fieldbook.plans.registry import query
from fieldbook.plans.views import table, view


@query("op_code_labels", "C24", "WITH {ops} SELECT seq, CASE trim(op_code) WHEN 'Trips' THEN 'Tripping' WHEN 'Other' THEN 'Other work' ELSE trim(op_code) END AS label FROM ops")
def _(s, d):
    return view(s, d, "ops").select("seq", lk.label_of(F.col("op_code"), {"Trips": "Tripping", "Other": "Other work"}).alias("label"))


# Every well numbers its reports differently, and the order of ingest is not that of the ids.
@query("report_no_by_date", "D6", "WITH {headers}, h AS (SELECT report_date, doc_id, report_no * 10 + CAST(substr(well_id, 2, 1) AS INTEGER) AS report_no, CAST(head_count AS INTEGER) * 7919 % 101 AS ingest FROM headers) SELECT report_date, report_no FROM h QUALIFY row_number() OVER (PARTITION BY report_date ORDER BY ingest DESC, doc_id DESC) = 1")
def _(s, d):
    h = view(s, d, "headers").withColumns({"report_no": F.col("report_no") * 10 + F.substring("well_id", 2, 1).cast("int"), "ingest": F.col("head_count").cast("int") * 7919 % 101})
    return lk.report_no_by_date(h, "ingest")


@query("first_occurrence", "E20", "SELECT source, doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def _(s, d):
    return ordered.first_by(table(s, d, "documents").select("source", "doc_id", "lang", "n_chars"), ["source"], ["doc_id"])


@query("frequent_bigrams", "M28", "WITH {ops}, w AS (SELECT seq, regexp_extract_all(lower(operation_text), '[a-z][a-z''-]+') AS w FROM ops), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w WHERE len(w) >= 2) SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 8")
def _(s, d):
    return lk.frequent_ngrams(view(s, d, "ops"))


@query("frequent_trigrams", "M28", "WITH {ops}, w AS (SELECT seq, regexp_extract_all(lower(operation_text), '[a-z][a-z''-]+') AS w FROM ops), g AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w WHERE len(w) >= 3) SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 8")
def _(s, d):
    return lk.frequent_ngrams(view(s, d, "ops"), 3)
