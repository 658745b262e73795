"""Queries over tables inside pages, chunk bounds and result logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.operators import tables as tb
from fieldbook.plans.hours_queries import auto6
from fieldbook.plans.registry import query
from fieldbook.plans.views import VIEWS, table, view

# Tables with blank rows, header rows and closing rows.
VIEWS["rawrows"] = """
SELECT l_orderkey AS table_id, CAST(l_linenumber AS INT) AS row_no,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN ' Item ' WHEN l_partkey % 9 = 0 THEN '' WHEN l_partkey % 9 = 1 THEN 'Total hrs' WHEN l_partkey % 9 = 2 THEN ' page 7 of 9' ELSE CAST(l_partkey AS STRING) END AS c0,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN 'Price' WHEN l_partkey % 9 = 0 THEN '  ' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',5' END AS c1,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 6 = 0 THEN 'Unit' WHEN l_partkey % 9 = 0 THEN '' ELSE CAST(l_suppkey AS STRING) END AS c2
FROM lineitem"""
_C = ["c0", "c1", "c2"]
_WORD = lambda c: f"(t{c} <> '' AND NOT regexp_full_match(regexp_replace(t{c}, '[,.-]', '', 'g'), '\\d+'))::INT"


@query("clean_table_rows", "L8", f"""WITH {{rawrows}}, t AS (SELECT table_id, row_no, trim(c0) AS tc0, trim(c1) AS tc1, trim(c2) AS tc2 FROM rawrows), k AS (SELECT * FROM t WHERE tc0 <> '' OR tc1 <> '' OR tc2 <> ''),
h AS (SELECT *, count(*) OVER w AS n, min(row_no) OVER w AS f, {' + '.join(_WORD(c) for c in _C)} AS wd FROM k WINDOW w AS (PARTITION BY table_id))
SELECT table_id, row_no, tc0 AS c0, tc1 AS c1, tc2 AS c2, n > 1 AND row_no = f AND wd / 3 > 0.5 AS is_header FROM h""")
def _(s, d):
    return tb.clean_rows(view(s, d, "rawrows"), ["table_id"], _C)


@query("drop_trailing_rows", "L9", """WITH {rawrows}, x AS (SELECT *, array_to_string(list_filter([c0, c1, c2], lambda v: trim(v) <> ''), ' ') AS t FROM rawrows)
SELECT table_id, row_no FROM x WHERE NOT regexp_matches(t, 'total\\s+ho?u?rs?', 'i') AND NOT regexp_matches(t, '^\\s*page\\s+\\d+', 'i')""")
def _(s, d):
    return tb.drop_trailing(view(s, d, "rawrows"), _C, [*tb.TRAILING, r"(?i)^\s*page\s+\d+"]).select("table_id", "row_no")



@query("markdown_rows", "L16", f"WITH {{rawrows}} SELECT table_id, (row_number() OVER (PARTITION BY table_id ORDER BY row_no, '| ' || trim(c0) || ' | ' || trim(c1) || ' | ' || trim(c2)) - 1)::INT AS row_no, 'A/B/' AS header, trim(c0) || '/' || trim(c1) || '/' || trim(c2) AS cells FROM rawrows WHERE table_id % 7 <> 0")
def _(s, d):
    line = F.concat(F.lit("| "), F.trim("c0"), F.lit(" | "), F.trim("c1"), F.lit(" | "), F.trim("c2"), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("l")))), lambda x: x["l"]), "\n")
    md = view(s, d, "rawrows").groupBy("table_id").agg(rows.alias("rows"))
    md = md.select("table_id", F.concat(F.when(F.col("table_id") % 7 == 0, "").otherwise("Some text\n| A | B |\n|---|:-:|\n"), F.col("rows")).alias("table_md"))
    r = tb.markdown_rows(md)
    return r.withColumn("header", F.array_join("header", "/")).withColumn("cells", F.array_join("cells", "/"))


@query("page_bound", "L7", "WITH {docpages} SELECT count(*) FILTER (rec_id % 3 > 0) AS n_multi_page, count(*) FILTER (rec_id % 3 > 0) = 0 AS ok FROM docpages")
def _(s, d):
    return tb.page_bound(view(s, d, "docpages").select(F.col("page").alias("page_start"), (F.col("page") + F.col("rec_id") % 3).alias("page_end")))


@query("section_diagnostics", "K8", "WITH {docpages} SELECT doc_id, count(*) AS n_pages, round(avg((page % 2 = 0)::INT), 6) AS coverage, round(avg((page % 5 = 1)::INT), 6) AS override_rate, round(avg((lang = 'fr' OR page % 4 = 0)::INT), 6) AS unknown_pct FROM docpages GROUP BY 1")
def _(s, d):
    p = F.col("page")
    sub = F.when(F.col("lang") == "fr", "Unknown").when(p % 4 == 0, F.lit(None)).otherwise(F.col("lang"))
    return auto6(tb.section_diagnostics(view(s, d, "docpages").select("doc_id", (p % 2 == 0).alias("covered"), (p % 5 == 1).alias("overridden"), sub.alias("subsection_title"))))


@query("page_listing", "L22", "WITH {docpages} SELECT doc_id, page, rec_id FROM docpages WHERE page = 3")
def _(s, d):
    return tb.listing(view(s, d, "docpages").select("doc_id", "page", "rec_id"), page=3)


@query("generation_counters", "M26", """WITH l AS (SELECT CASE turn % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' WHEN 2 THEN 'insufficient_evidence' WHEN 3 THEN 'timeout' END AS status, turn AS parsed, turn // 2 AS valid, turn - turn // 2 AS rejected, length(text)::DOUBLE AS latency_ms FROM conversations)
SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'insufficient_evidence') AS insufficient_evidence, count(*) FILTER (status IS NULL OR status = 'timeout') AS error,
sum(parsed)::BIGINT AS parsed, sum(valid)::BIGINT AS valid, sum(rejected)::BIGINT AS rejected, round(sum(valid) / sum(parsed), 6) AS valid_rate, round(sum(rejected) / sum(parsed), 6) AS rejected_rate, round(sum(latency_ms) / count(*), 6) AS mean_latency FROM l""")
def _(s, d):
    t = F.col("turn")
    half = F.floor(t / 2)
    status = F.when(t % 5 == 0, "ok").when(t % 5 == 1, "skipped").when(t % 5 == 2, "insufficient_evidence").when(t % 5 == 3, "timeout")
    log = table(s, d, "conversations").select(status.alias("status"), t.alias("parsed"), half.alias("valid"), (t - half).alias("rejected"), F.length("text").cast("double").alias("latency_ms"))
    return auto6(tb.generation_counters(log))
