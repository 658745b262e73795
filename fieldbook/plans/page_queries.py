"""Queries over pages, lines, sections and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.operators import pages as pg
from fieldbook.operators import retrieval as rt
from fieldbook.plans.hours_queries import auto6
from fieldbook.plans.registry import query
from fieldbook.plans.views import table, view
from fieldbook.sources import sinks, tables

LAB = """{docpages}, lab AS (SELECT doc_id, page, clean_text, lang AS section_title, CASE WHEN rec_id % 3 = 0 THEN 'A' ELSE 'B' END AS subsection_title FROM docpages)"""
_W = "len(list_filter(string_split_regex(clean_text, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> ''))"


def labels(s, d):
    return view(s, d, "docpages").select("doc_id", "page", "clean_text", F.col("lang").alias("section_title"),
                                         F.when(F.col("rec_id") % 3 == 0, "A").otherwise("B").alias("subsection_title"))


SEC = LAB + f""", x AS (SELECT *, CASE WHEN lag(section_title) OVER w = section_title AND lag(subsection_title) OVER w = subsection_title AND lag(page) OVER w + 1 = page THEN 0 ELSE 1 END AS nw FROM lab WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
y AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM x),
sec AS (SELECT doc_id, run, section_title, subsection_title, min(page) AS page_start, max(page) AS page_end, sum({_W})::BIGINT AS word_count FROM y GROUP BY 1, 2, 3, 4)"""


@query("sections_from_labels", "K7 E13", f"WITH {SEC} SELECT * FROM sec")
def _(s, d):
    return pg.sections(labels(s, d), width=4)


for _n, _i, _o, _l in (("page_section_last", "D9", "DESC", True), ("page_section_first", "D10", "ASC", False)):
    query(_n, _i, f"""WITH {SEC}, sp AS (SELECT doc_id, section_title || run AS t, page_start, page_end + 2 AS page_end FROM sec),
j AS (SELECT lab.doc_id, page, t, page_start FROM lab LEFT JOIN sp ON lab.doc_id = sp.doc_id AND page BETWEEN page_start AND page_end)
SELECT doc_id, page, coalesce(t, 'Unknown') AS section_title FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY page_start {_o}) = 1""")(
        lambda s, d, latest=_l: pg.page_sections(labels(s, d).select("doc_id", "page"), pg.sections(labels(s, d), width=4).select(
            "doc_id", F.concat("section_title", F.col("run").cast("string")).alias("section_title"), "page_start", (F.col("page_end") + 2).alias("page_end")), latest, 4))


@query("page_needs_ocr", "J4", "WITH {docpages} SELECT rec_id, length(trim(regexp_replace(clean_text, '[\\s\\x{a0}]+', ' ', 'g'))) < 400 OR contains(clean_text, chr(65533)) OR len(regexp_extract_all(clean_text, '\\p{L}')) / greatest(length(trim(regexp_replace(clean_text, '[\\s\\x{a0}]+', ' ', 'g'))), 1) < 0.15 AS needs_ocr FROM docpages")
def _(s, d):
    return view(s, d, "docpages").select("rec_id", pg.needs_ocr(F.col("clean_text"), 400).alias("needs_ocr"))


_LN = """{docpages}, ln AS (SELECT doc_id, page, unnest(string_split(clean_text, chr(10))) AS text, unnest(range(len(string_split(clean_text, chr(10)))))::INT AS line_no FROM docpages)"""


def _lines(s, d):
    return view(s, d, "docpages").select("doc_id", "page", F.posexplode(F.split("clean_text", "\n")).alias("line_no", "text"))


@query("repeated_page_lines", "J2")
def _(s, d):
    return pg.repeated_lines(_lines(s, d), share=0.1)


@query("strip_page_margins", "J1", f"WITH {_LN} SELECT doc_id, page, line_no FROM ln WHERE (line_no * 10 + 5) / 800 BETWEEN 0.08 AND 0.92")
def _(s, d):
    l = _lines(s, d).select("*", F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1"), (F.col("line_no") * 10.0).alias("y0"), (F.col("line_no") * 10.0 + 10).alias("y1"),
                            F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), F.lit(0).alias("rotation"))
    return pg.strip_margins(l).select("doc_id", "page", "line_no")


@query("corpus_metrics", "N54 L21", None)
def _(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), F.col("text").alias("clean_text"))
    return auto6(pg.corpus_metrics(rt.word_chunks(docs)))


@query("key_alignment", "D21 A5", "SELECT (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS only_a, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS only_b, (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id)) AS both")
def _(s, d):
    return pg.key_alignment(table(s, d, "documents"), table(s, d, "labels"), "doc_id")


@query("resume_status", "A14", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped_existing' ELSE 'processed' END AS status FROM documents")
def _(s, d):
    return tables.resume_status(table(s, d, "documents").select("doc_id"), table(s, d, "labels"))


@query("index_manifest", "A15", "SELECT count(DISTINCT label) AS n_docs, count(*) AS n_chunks, max(len(embedding))::INT AS dim FROM embeddings")
def _(s, d):
    return sinks.index_manifest(table(s, d, "embeddings").withColumnRenamed("label", "doc_id"))


@query("row_minimums", "N45", "SELECT 'documents' AS table_name, count(*) AS n_rows, count(*) >= 500 AS ok FROM documents UNION ALL SELECT 'labels', count(*), count(*) >= 1000000 FROM labels")
def _(s, d):
    return sinks.row_minimums({t: table(s, d, t) for t in ("documents", "labels")}, {"documents": 500, "labels": 1000000})


@query("missing_artefacts", "N46", "SELECT doc_id, 'labels' AS kind FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'vector' FROM documents ANTI JOIN (SELECT vec_id AS doc_id FROM embeddings) e USING (doc_id)")
def _(s, d):
    have = table(s, d, "labels").select("doc_id", F.lit("labels").alias("kind")).unionByName(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("vector").alias("kind")))
    return sinks.missing_artefacts(table(s, d, "documents").select("doc_id"), have, ["labels", "vector"])


@query("annotation_upsert", "N28 D19", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 9 FROM documents ANTI JOIN labels USING (doc_id)")
def _(s, d):
    old = table(s, d, "documents").select("doc_id", F.lit(9).alias("quality"))
    return sinks.upsert(old, table(s, d, "labels").select("doc_id", "quality"), "doc_id")
