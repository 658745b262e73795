"""Queries over scalar functions, each on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import dates, npt, numeric, text
from fieldbook.plans import oracle as o
from fieldbook.plans.hours_queries import auto6
from fieldbook.plans.registry import query
from fieldbook.plans.views import table, view

WS = text.WS
NORM = lambda c: f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"
T = lambda: F.col("text")


def _doc(name, ids, expr, sql, alias="v", places=6):
    query(name, ids, f"SELECT doc_id, {sql} AS {alias} FROM documents" if sql else None)(
        lambda s, d: auto6(table(s, d, "documents").select("doc_id", expr().alias(alias)), places))


def _nar(name, ids, expr, sql, alias="v", src="narr"):
    query(name, ids, f"WITH {{{src}}} SELECT seq, {sql} AS {alias} FROM {src}" if sql else None)(
        lambda s, d: auto6(view(s, d, src).select("seq", expr().alias(alias))))


_doc("normalize_line", "C1", lambda: text.collapse(T()), NORM("text"))
_doc("normalize_page_text", "C2", lambda: text.page_text(T()), NORM("replace(replace(replace(replace(replace(replace(replace(translate(text, '\u00ad\ufffe\u200b\u200c\u200d\ufeff', ''), '\ufb00', 'ff'), '\ufb01', 'fi'), '\ufb02', 'fl'), '\ufb03', 'ffi'), '\ufb04', 'ffl'), '•', '- '), '▶', '- ')"))
_doc("dehyphenate_lines", "C3", lambda: F.array_join(text.dehyphenate(F.split(T(), "\n")), "\n"), None)
_nar("parse_first_number", "C12", lambda: numeric.first_number(F.col("operation_text")), "replace(regexp_extract(operation_text, '\\d[\\d,]*(?:\\.\\d+)?'), ',', '')")
_doc("bm25_tokens", "C27", lambda: F.array_join(text.bm25_tokens(T()), " "), "array_to_string(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-]{1,}'), ' ')")
_RN = f"regexp_replace(replace(lower(trim(text)), '’', ''''), '{WS}+', ' ', 'g')"
_TOKS = f"regexp_extract_all({_RN}, '[a-z0-9.,%-]+')"
_doc("numeric_density", "C30", lambda: text.numeric_density(T()), f"round(CASE WHEN len({_TOKS}) > 0 THEN len(list_filter({_TOKS}, lambda x: regexp_matches(x, '\\d'))) / len({_TOKS}) ELSE 0 END, 6)")
_doc("rerank_tokens", "C28", lambda: F.array_join(text.rerank_tokens(T()), " "), None)
_doc("question_entities", "C29", lambda: F.array_join(text.question_entities(T()), " "), None)
_doc("char_ratios", "C33", lambda: text.digit_ratio(T()), "round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\d]', '', 'g')) / length(text) ELSE 0 END, 6)")
_doc("many_numbers", "C33", lambda: text.many_numbers(T()), f"length(regexp_replace(text, '[^\\d]', '', 'g')) / greatest(length(regexp_replace(text, '{WS}', '', 'g')), 1) > 0.10")
_doc("artifact_counts", "C36", lambda: text.artifacts(T())["zero_width"], "(length(text) - length(translate(text, '\u200b\u200c\u200d\ufeff', '')))::INTEGER")
_doc("is_daily_report", "B9", lambda: text.is_daily_report(T()), "(contains(lower(text), 'daily well operation')::INT + contains(lower(text), 'drilling original')::INT + contains(lower(text), 'operation summary')::INT) >= 2")
_doc("asks_aggregate", "B10", lambda: text.asks_aggregate(T()), "regexp_matches(lower(text), 'maximum|minimum|highest|lowest|total|average|how many|most|least|all phases|across all|entire well|cumulative|sum of|count of')")
_doc("year_range", "C5", lambda: dates.year_range(T()), None)
_doc("period_end_date", "C6", lambda: dates.period_end(T()), None)


def _lines(name, ids, expr):
    """One row for each line of each text."""
    query(name, ids, None)(
        lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", expr(F.col("line")).alias("v")))


_lines("title_normalize", "C42", text.title_norm)
_lines("canonical_section_title", "C52", text.canonical_section)
_lines("heading_flags", "C44", lambda c: F.concat_ws(",", *[f(c).cast("string") for f in (text.is_title_heading, text.is_lettered_heading, text.is_anchor_line, text.is_numbered_heading)]))
_nar("first_sentence", "C31", lambda: text.first_sentence(F.col("operation_text"), 60), None, src="ops")
_nar("report_hour", "C22", lambda: dates.report_hour(F.col("start_time")), f"round({o.HOUR('start_time')}, 6)", src="ops")
_nar("shift_block", "C21", lambda: dates.shift_block(F.col("start_time")), "CASE WHEN start_time < '06' THEN '00:00-06:00' WHEN start_time < '12' THEN '06:00-12:00' WHEN start_time < '18' THEN '12:00-18:00' ELSE '18:00-00:00' END", src="ops")
_nar("citation_text", "C41", lambda: text.citation(F.col("doc_id"), F.col("page"), F.col("start_time"), F.col("end_time"), F.lit("")), "'DDR-' || regexp_extract(doc_id, 'DDR-?(\\d+)', 1) || ' · p.' || page || ' · ' || start_time || '–' || end_time", src="ops")
_nar("event_key", "C41", lambda: text.event_key(F.col("doc_id"), F.col("start_time"), F.col("end_time")), "doc_id || '::' || start_time || '-' || end_time", src="ops")
_nar("filename_year", "C4", lambda: dates.filename_year(F.col("source_filename")), "CASE WHEN len(regexp_extract_all(source_filename, '(?:19|20)\\d{2}')) >= 2 THEN regexp_extract_all(source_filename, '(?:19|20)\\d{2}')[1] || '-' || regexp_extract_all(source_filename, '(?:19|20)\\d{2}')[2] ELSE regexp_extract_all(source_filename, '(?:19|20)\\d{2}')[1] END", src="filenames")
_nar("slug_hash", "C23", lambda: F.concat_ws("|", text.slug(F.col("source_filename")), text.short_hash(F.col("source_filename"))), "regexp_replace(regexp_replace(source_filename, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '|' || left(sha1(source_filename), 8)", src="filenames")
_nar("equipment_subtype", "C46", lambda: npt.equipment_subtype(F.col("operation_text")), o.subtype("operation_text"), src="ops")
_nar("canonical_figure", "C18 C19 C20", lambda: numeric.canonical_figure(F.col("operation_text")), None)

_num = "TRY_CAST(replace(regexp_replace({c}, '^[()%]+|[()%]+$', '', 'g'), ',', '') AS DOUBLE)"


@query("table_cell_numbers", "C14 C15 L15", "WITH {trows}, x AS (SELECT doc_id, row_no, c0, unnest(['c1', 'c2', 'c3']) AS col, unnest([c1, c2, c3]) AS raw FROM trows) SELECT doc_id, row_no, trim(regexp_replace(replace(lower(c0), '&', ' and '), '[^a-z0-9]+', '_', 'g'), '_') AS row_label_norm, col, CASE WHEN raw LIKE '(%' THEN -1 ELSE 1 END * " + _num.format(c="raw") + " AS value_num, raw LIKE '%\\%' ESCAPE '\\' AS is_percent FROM x WHERE regexp_matches(raw, '^\\(?-?\\d[\\d,]*(?:\\.\\d+)?\\)?%?$')")
def _(s, d):
    t = view(s, d, "trows")
    long = t.select("doc_id", "row_no", "c0", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("raw")) for c in ("c1", "c2", "c3")])).alias("x"))
    n = long.select("doc_id", "row_no", numeric.key_norm(F.col("c0")).alias("row_label_norm"), "x.col", numeric.table_number(F.col("x.raw")).alias("n"))
    return n.filter("n.value IS NOT NULL").select("doc_id", "row_no", "row_label_norm", "col", F.col("n.value").alias("value_num"), F.col("n.is_percent").alias("is_percent"))


@query("table_row_text", "C49", "WITH {trows} SELECT doc_id, row_no, '| ' || array_to_string([trim(c0), c1, c2, c3], ' | ') || ' |' AS row_md FROM trows")
def _(s, d):
    return view(s, d, "trows").select("doc_id", "row_no", text.md_row(F.array("c0", "c1", "c2", "c3")).alias("row_md"))
