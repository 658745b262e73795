"""Queries over parsers, labels and small lookups on generated cell texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import dates, numeric, text
from fieldbook.operators import lookups
from fieldbook.operators import pages as pg
from fieldbook.operators import retrieval as rt
from fieldbook.plans import oracle as o
from fieldbook.plans.hours_queries import auto6
from fieldbook.plans.registry import query
from fieldbook.plans.retrieval_queries import _dr, dense
from fieldbook.plans.views import VIEWS, table, view

_Y, _M, _D = "CAST(year(o_orderdate) AS STRING)", "CAST(month(o_orderdate) AS STRING)", "CAST(day(o_orderdate) AS STRING)"
# One order is one cell: a date in one of eight forms, a weight, a quarter and a figure.
VIEWS["cells"] = f"""
SELECT o_orderkey AS seq, CAST(o_orderkey % 8 AS INT) AS form, CAST(o_orderdate AS DATE) AS real_date,
  CASE o_orderkey % 8 WHEN 0 THEN {_Y} || '-' || lpad({_M}, 2, '0') || '-' || lpad({_D}, 2, '0') WHEN 1 THEN {_D} || '/' || {_M} || '/' || {_Y}
    WHEN 2 THEN lpad({_D}, 2, '0') || '.' || lpad({_M}, 2, '0') || '.' || {_Y} WHEN 3 THEN {_D} || '-' || {_M} || '-' || {_Y} WHEN 4 THEN {_M} || '/' || {_D} || '/' || {_Y}
    WHEN 5 THEN {_D} || ' ' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3) || ' ' || {_Y} WHEN 6 THEN 'undated' ELSE '' END AS date_text,
  CASE o_orderkey % 5 WHEN 0 THEN 'Recovered ' || CAST(o_custkey AS STRING) || ' g' WHEN 1 THEN CAST(1 + o_custkey % 9 AS STRING) || '.' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || 'g of swarf'
    WHEN 2 THEN CAST(1 + o_custkey % 9 AS STRING) || ',' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || ' g' WHEN 3 THEN CAST(o_custkey AS STRING) || '.5 g' ELSE 'none found' END AS weight_text,
  CASE o_orderkey % 6 WHEN 0 THEN 'Result Q' || CAST(1 + o_custkey % 4 AS STRING) || ' up 4 percent' WHEN 1 THEN 'Paid £40' WHEN 2 THEN '12%' WHEN 3 THEN 'USD 5' WHEN 4 THEN 'q4 and Q2 units' ELSE '7 units' END AS figure_text,
  CASE o_orderkey % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN ' - ' WHEN 2 THEN '' WHEN 3 THEN '£m' WHEN 4 THEN '12.5' WHEN 5 THEN 'per cent' ELSE 'psi' END AS cell_text
FROM orders"""


def _cells(name, ids, expr, sql):
    query(name, ids, f"WITH {{cells}} SELECT seq, {sql} AS v FROM cells")(lambda s, d: view(s, d, "cells").select("seq", expr().alias("v")))


_SWAP = "make_date(year(real_date), day(real_date), month(real_date))"
_cells("report_date", "C7", lambda: dates.report_date(F.col("date_text")), f"CASE WHEN form >= 6 THEN NULL WHEN form = 4 AND day(real_date) <= 12 THEN {_SWAP} ELSE real_date END")
_cells("header_date", "C8", lambda: dates.header_date(F.col("date_text")), f"CASE WHEN form IN (0, 4, 5) THEN real_date::VARCHAR WHEN form = 1 AND day(real_date) <= 12 THEN ({_SWAP})::VARCHAR ELSE '' END")
_cells("grams", "C13", lambda: numeric.grams(F.col("weight_text")), "CASE WHEN regexp_matches(weight_text, '\\d\\.\\d{3}g') THEN replace(regexp_extract(weight_text, '[\\d.]+'), '.', '')::DOUBLE ELSE TRY_CAST(regexp_extract(replace(weight_text, ',', ''), '(\\d+(?:\\.\\d+)?)\\s*g', 1) AS DOUBLE) END")
_cells("quarter", "C16", lambda: numeric.quarter(F.col("figure_text")), "CASE WHEN contains(lower(figure_text), 'q1') THEN 'q1' WHEN contains(lower(figure_text), 'q2') THEN 'q2' WHEN contains(lower(figure_text), 'q3') THEN 'q3' WHEN contains(lower(figure_text), 'q4') THEN 'q4' END")
_cells("dimension", "C17", lambda: numeric.dimension(F.col("figure_text")), "CASE WHEN regexp_matches(lower(figure_text), '%|percent') THEN 'percent' WHEN regexp_matches(lower(figure_text), '£|\\$|eur|usd') THEN 'currency' ELSE 'count' END")
_cells("cell_kind", "C50", lambda: F.concat_ws(",", *[f(F.col("cell_text")).cast("string") for f in (text.is_blank_cell, text.is_numeric_cell, text.is_unit_fragment)]),
       "(trim(cell_text) IN ('n/a', '-', ''))::VARCHAR || ',' || regexp_matches(cell_text, '\\d')::VARCHAR || ',' || (trim(cell_text) <> '' AND NOT contains(trim(cell_text), ' ') AND (regexp_matches(cell_text, '[£$€%]') OR regexp_full_match(trim(cell_text), '[A-Za-z/().,-]{1,8}')))::VARCHAR")


_P = "loss(?:es)?|overpull"


@query("match_snippet", "C32", f"WITH {{narr}}, m AS (SELECT seq, operation_text AS t, regexp_extract(operation_text, '{_P}') AS h FROM narr) SELECT seq, CASE WHEN h <> '' THEN trim(substr(t, greatest(strpos(t, h) - 20, 1)::INT, (strpos(t, h) + length(h) + 50 - greatest(strpos(t, h) - 20, 1))::INT)) END AS v FROM m")
def _(s, d):
    return view(s, d, "narr").select("seq", text.snippet(F.col("operation_text"), _P, 20, 50).alias("v"))


@query("page_lists", "C34", "WITH {docpages} SELECT rec_id, array_to_string(list_sort(list_distinct([page, page + 2, page, 1])), ',') AS pages, array_to_string(CASE WHEN page % 5 = 0 THEN [] ELSE range(least(page, rec_id % 7), greatest(page, rec_id % 7) + 1) END, ',') AS span FROM docpages")
def _(s, d):
    p = F.col("page")
    lst = text.pages_list(F.array(p, p + 2, F.lit(None).cast("int"), p, F.lit(1)))
    span = text.pages_span(p, F.when(p % 5 != 0, (F.col("rec_id") % 7).cast("int")))
    return view(s, d, "docpages").select("rec_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(n) for c, n in ((lst, "pages"), (span, "span"))])


@query("embedding_text", "C35", "WITH {docpages} SELECT rec_id, CASE WHEN page % 3 = 0 THEN '' ELSE lang || chr(10) END || CASE WHEN page % 2 = 0 OR page % 5 = 0 THEN '' ELSE 'Part ' || page || chr(10) END || clean_text AS v FROM docpages")
def _(s, d):
    p = F.col("page")
    section = F.when(p % 3 == 0, " Unknown ").otherwise(F.col("lang"))
    sub = F.when(p % 5 != 0, F.concat(F.lit("Part "), p.cast("string"))).otherwise("")
    return view(s, d, "docpages").select("rec_id", text.embedding_text(section, sub, F.col("clean_text"), p % 2 == 0).alias("v"))


_SEC = o.case([(" OR ".join(f"contains(lower(operation_text), {o.q(m)})" for m in ms), o.q(n)) for n, ms in text.SECTION_MARKERS], "NULL")


@query("section_label", "C45", f"WITH {{ops}} SELECT seq, {_SEC} AS v FROM ops")
def _(s, d):
    return view(s, d, "ops").select("seq", text.section_label(F.col("operation_text")).alias("v"))


@query("strength_band", "C51", f"WITH x AS (SELECT 1){_dr(10)} SELECT query_id, chunk_key, CASE WHEN round(score, 6) >= 0.6 THEN 'Strong match' WHEN round(score, 6) >= 0.4 THEN 'Moderate match' ELSE 'Weak match' END AS v FROM dr")
def _(s, d):
    return dense(s, d).select("query_id", "chunk_key", text.strength_band(F.round("score", 6)).alias("v"))


# Every vector is cited by the question of its number, and every retrieved chunk by its question; some pages are wrong.
@query("valid_citations", "D20", f"""WITH x AS (SELECT 1){_dr(10)}, c AS (SELECT item_id AS query_id, vec_id AS chunk_key, unnest([vec_id % 9, item_id % 5]) AS page FROM embeddings JOIN benchmark ON item_id = vec_id % 50
UNION ALL SELECT query_id, chunk_key, unnest([chunk_key % 9 + 1, chunk_key % 9 + 2]) AS page FROM dr) SELECT c.* FROM c JOIN dr USING (query_id, chunk_key) WHERE page IN (chunk_key % 9, chunk_key % 9 + 1)""")
def _(s, d):
    key = F.col("chunk_key")
    page = (key % 9).cast("int")
    found = dense(s, d)
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"))
    cited = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_key"), (F.col("vec_id") % 50).alias("query_id")).join(q, "query_id")
    said = cited.select("query_id", "chunk_key", F.explode(F.array(key % 9, F.col("query_id") % 5)).alias("page"))
    said = said.unionByName(found.select("query_id", "chunk_key", F.explode(F.array(key % 9 + 1, key % 9 + 2)).alias("page")))
    return lookups.valid_citations(said, found.withColumn("pages", F.array(page, page + 1)))


@query("toc_spans", "K5", """WITH {docpages}, i AS (SELECT doc_id, 'T' || rec_id AS title, (1 + rec_id % 2)::INT AS level, page AS start_page FROM docpages), lp AS (SELECT doc_id, max(page) + 4 AS last_page FROM docpages GROUP BY 1)
SELECT doc_id, title, level, start_page AS page_start, greatest(start_page, coalesce(lead(start_page) OVER w - 1, last_page)) AS page_end, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start_page, title ROWS UNBOUNDED PRECEDING) AS section_title
FROM i JOIN lp USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start_page, title)""")
def _(s, d):
    p = view(s, d, "docpages")
    i = p.select("doc_id", F.concat(F.lit("T"), F.col("rec_id").cast("string")).alias("title"), (1 + F.col("rec_id") % 2).cast("int").alias("level"), F.col("page").alias("start_page"))
    return pg.toc_spans(i, p.groupBy("doc_id").agg((F.max("page") + 4).alias("last_page")))


@query("context_packing", "M17", f"""WITH x AS (SELECT 1){_dr(10)}, t AS (SELECT query_id, rank, chunk_key, trim(text) AS t FROM dr JOIN documents ON doc_id = chunk_key), b AS (SELECT query_id, rank, chunk_key, length(t) > 900 AS truncated, CASE WHEN length(t) > 900 THEN rtrim(substr(t, 1, 900), ' ') || ' ...' ELSE t END AS block FROM t WHERE t <> ''),
w AS (SELECT *, sum(length(block)) OVER v AS used, count(*) OVER v AS pos FROM b WINDOW v AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)) SELECT query_id, rank::INT AS rank, chunk_key, truncated, used::BIGINT AS used FROM w WHERE used <= 4000 AND pos <= 6""")
def _(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("chunk_key"), F.col("text").alias("chunk_text"))
    return rt.context_packing(dense(s, d).join(t, "chunk_key"), 6, 4000, 900).select("query_id", "rank", "chunk_key", "truncated", "used")


@query("metadata_filter", "B1", "WITH {docpages} SELECT rec_id FROM docpages WHERE lower(doc_id) LIKE 'src1%' AND page % 2 = 0 AND contains(lang, 'e')")
def _(s, d):
    m = view(s, d, "docpages").select("rec_id", F.substring("doc_id", 1, 4).alias("trust_id"), (F.col("page") % 2 == 0).alias("is_table"), F.col("lang").alias("section_title"))
    return rt.metadata_filter(m, trust_id="SRC1", is_table=True, section_contains="E").select("rec_id")
