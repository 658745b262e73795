"""Queries over file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import text
from fieldbook.operators import audit, hours, ordered
from fieldbook.plans import oracle as o
from fieldbook.plans.registry import query
from fieldbook.plans.views import view

_A = audit.NAME_A.replace("(?i)", "")
_B = audit.NAME_B.replace("(?i)", "")
_ga = lambda i: f"regexp_extract(source_filename, {o.q(_A)}, {i}, 'i')"
_gb = lambda i: f"regexp_extract(source_filename, {o.q(_B)}, {i}, 'i')"


def _cd(tok, names):
    """mddyyyy split search for 4-, 3- and 2-digit heads."""
    y, h = f"right({tok}, 4)", f"left({tok}, length({tok}) - 4)"
    return f"""(SELECT arg_min(d, (CASE WHEN (y = 2020 AND month(d) IN (10,11,12)) OR (y = 2021 AND month(d) = 1) THEN 0 ELSE 1 END) * 100 + i) FROM (
      SELECT i, {y}::INT AS y, TRY_CAST({y} || '-' || lpad(CAST(TRY_CAST(substr({h}, 1, i) AS INT) AS VARCHAR), 2, '0') || '-' || lpad(CAST(TRY_CAST(substr({h}, i + 1) AS INT) AS VARCHAR), 2, '0') AS DATE) AS d
      FROM (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE i < length({h})) WHERE d IS NOT NULL)"""


REC = f"""{{filenames}},
fb0 AS (SELECT source_filename, seq, file_size_bytes, {_gb(2)} AS ph, {_gb(3)} AS blob, {_gb(4)} AS second, {_gb(5)} AS rno, {_gb(6)} AS rev, {_gb(8)} AS cp FROM filenames WHERE regexp_matches(source_filename, {o.q(_B)}, 'i')),
fb1 AS (SELECT *, second = '' AND length(blob) % 2 = 0 AND left(blob, (length(blob) // 2)::INT) = right(blob, (length(blob) // 2)::INT) AS dbl FROM fb0),
fb2 AS (SELECT *, CASE WHEN dbl THEN left(blob, (length(blob) // 2)::INT) ELSE blob END AS t1, CASE WHEN dbl THEN left(blob, (length(blob) // 2)::INT) WHEN second <> '' THEN second END AS t2 FROM fb1),
fb3 AS (SELECT *, {_cd('t1', '')} AS d1, {_cd('t2', '')} AS d2 FROM fb2),
recb AS (SELECT source_filename, true AS parsed, 'NorthSite-DDR-SITE-16A-78-32-' || upper(left(ph, 1)) || lower(substr(ph, 2)) || '-' || d1 || '-R' || printf('%03d', rno::INT) || '-' || left(sha1(source_filename), 8) AS safe_doc_id,
  'NorthSite' AS rig, 'DDR' AS report_type, (d1 - DATE '2020-10-21' + 1)::BIGINT AS ddr_number, 'SITE' AS asset_or_project, '16A-78-32' AS wellbore_suffix, 'SITE-16A-78-32' AS wellbore, 'SITE-16A-78-32' AS block_wellbore,
  d1 AS report_date, CASE WHEN second <> '' THEN blob || '_' || second ELSE blob END AS date_text, file_size_bytes,
  array_to_string(list_filter([CASE WHEN d1 <> d2 THEN 'filename_start_end_date_mismatch' END, CASE WHEN cp <> '' THEN 'filename_copy_marker' END, CASE WHEN rev <> '' THEN 'filename_source_revision_marker' END], lambda x: x IS NOT NULL), ';') AS warnings, '' AS parse_error FROM fb3),
fa0 AS (SELECT source_filename, file_size_bytes, {_ga(1)} AS rig, {_ga(3)} AS no, upper({_ga(4)}) AS asset, upper({_ga(5)}) AS suf, {_ga(6)} AS dt, {_ga(7)} AS dots FROM filenames WHERE regexp_matches(source_filename, {o.q(_A)}, 'i')),
reca AS (SELECT source_filename, true, rig || '-DDR-' || CASE WHEN length(no) < 3 THEN lpad(no, 3, '0') ELSE no END || '-' || asset || '-' || suf || '-' || strptime(dt, '%d.%m.%Y')::DATE, rig, 'DDR', no::BIGINT, asset, suf, asset || '-' || suf, '00/00a-' || suf,
  strptime(dt, '%d.%m.%Y')::DATE, dt, file_size_bytes,
  array_to_string(list_filter([CASE WHEN dots <> '' THEN 'extra_dot_before_pdf_extension' END, CASE WHEN regexp_matches(source_filename, '\\bDDR\\s+\\d+[A-Za-z]') THEN 'missing_space_after_ddr_number' END], lambda x: x IS NOT NULL), ';'), '' FROM fa0),
recn AS (SELECT source_filename, false, '', '', 'DDR', NULL, '', '', '', '', NULL, '', file_size_bytes, '', CASE WHEN regexp_matches(source_filename, '\\.pdf$', 'i') THEN 'filename_does_not_match_expected_ddr_pattern' ELSE 'unsupported_file_extension' END
  FROM filenames WHERE source_filename NOT IN (SELECT source_filename FROM recb UNION ALL SELECT source_filename FROM reca)),
rec AS MATERIALIZED (SELECT * FROM recb UNION ALL SELECT * FROM reca UNION ALL SELECT * FROM recn)"""

NUMB = """,
one AS (SELECT * FROM rec WHERE parsed QUALIFY row_number() OVER (PARTITION BY ddr_number ORDER BY source_filename DESC) = 1),
sp AS (SELECT min(ddr_number) AS n0, max(ddr_number) AS n1, arg_min(report_date, ddr_number) AS d0 FROM one),
mm AS (SELECT one.*, d0 + (ddr_number - n0)::INT AS expected_date FROM one, sp WHERE report_date <> d0 + (ddr_number - n0)::INT),
ms AS (SELECT n AS number, d0 + (n - n0)::INT AS expected_report_date, p.*, x.source_filename AS nxt FROM sp, range(n0, n1) t(n)
  ANTI JOIN one a ON a.ddr_number = t.n
  ASOF JOIN one p ON t.n > p.ddr_number ASOF JOIN one x ON t.n < x.ddr_number)"""
ISS = NUMB + """,
dup AS (SELECT 'x' AS k, r.* FROM rec r),
iss AS (
 SELECT 'error' AS severity, 'unparsed_filename' AS issue_type, parse_error AS message, source_filename, safe_doc_id, ddr_number, coalesce(report_date::VARCHAR, '') AS report_date, wellbore FROM rec WHERE NOT parsed
 UNION ALL SELECT 'warning', w, replace(w, '_', ' '), source_filename, safe_doc_id, ddr_number, coalesce(report_date::VARCHAR, ''), wellbore FROM (SELECT *, unnest(string_split(warnings, ';')) AS w FROM rec WHERE warnings <> '')
 UNION ALL SELECT 'error', 'pdf_file_quality', 'zero_byte_file', source_filename, safe_doc_id, ddr_number, coalesce(report_date::VARCHAR, ''), wellbore FROM rec WHERE file_size_bytes <= 0
 UNION ALL SELECT CASE WHEN rig = 'NorthSite' THEN 'warning' ELSE 'error' END, 'duplicate_ddr_number', 'Duplicate ddr_number=' || ddr_number || ': ' || n || ' files', source_filename, safe_doc_id, ddr_number, report_date::VARCHAR, wellbore
   FROM (SELECT *, count(*) OVER (PARTITION BY rig = 'NorthSite', ddr_number) AS n FROM rec WHERE parsed) WHERE n > 1
 UNION ALL SELECT CASE WHEN rig = 'NorthSite' THEN 'warning' ELSE 'error' END, 'duplicate_report_date', 'Duplicate report_date=' || report_date || ': ' || n || ' files', source_filename, safe_doc_id, ddr_number, report_date::VARCHAR, wellbore
   FROM (SELECT *, count(*) OVER (PARTITION BY rig = 'NorthSite', report_date) AS n FROM rec WHERE parsed) WHERE n > 1
 UNION ALL SELECT 'error', 'duplicate_safe_doc_id', 'Duplicate safe_doc_id=' || safe_doc_id || ': ' || n || ' files', source_filename, safe_doc_id, ddr_number, report_date::VARCHAR, wellbore
   FROM (SELECT *, count(*) OVER (PARTITION BY safe_doc_id) AS n FROM rec WHERE parsed) WHERE n > 1
 UNION ALL SELECT 'error', 'date_sequence_mismatch', 'DDR ' || ddr_number || ' has date ' || report_date || '; expected ' || expected_date || ' from sequence.', source_filename, safe_doc_id, ddr_number, report_date::VARCHAR, wellbore FROM mm
 UNION ALL SELECT 'warning', 'missing_report', 'Missing DDR ' || number || ' for ' || expected_report_date || ' (' || wellbore || ').', '', '', number, expected_report_date::VARCHAR, wellbore FROM ms)"""


def recs(s, d):
    return audit.parse_filenames(view(s, d, "filenames"))


@query("filename_manifest", "F1 F2 F3 C9 C10 C23", f"WITH {REC} SELECT source_filename, parsed, safe_doc_id, rig, report_type, ddr_number, asset_or_project, wellbore_suffix, wellbore, block_wellbore, report_date, date_text, file_size_bytes, warnings, parse_error FROM rec")
def _(s, d):
    return recs(s, d).withColumn("warnings", F.array_join("warnings", ";"))


@query("filename_duplicates", "F4", f"WITH {REC} SELECT 'error' AS severity, 'duplicate_report_date' AS issue_type, 'Duplicate report_date=' || report_date || ': ' || n || ' files' AS message, source_filename, safe_doc_id, ddr_number, report_date::VARCHAR AS report_date, wellbore FROM (SELECT *, count(*) OVER (PARTITION BY report_date) AS n FROM rec WHERE parsed) WHERE n > 1")
def _(s, d):
    return audit.duplicate_issues(recs(s, d).filter("parsed"), "report_date", "duplicate_report_date", "error")


@query("missing_reports", "F5 D13 D18", f"WITH {REC}{NUMB} SELECT 'warning' AS severity, 'missing_report' AS issue_type, number AS expected_ddr_number, expected_report_date, rig, asset_or_project, wellbore_suffix, wellbore, block_wellbore, rig || ' DDR ' || number || ' ' || asset_or_project || ' ' || wellbore_suffix || ' ' || strftime(expected_report_date, '%d.%m.%Y') || '.pdf' AS inferred_filename, source_filename AS previous_source_filename, nxt AS next_source_filename FROM ms")
def _(s, d):
    return audit.missing_reports(recs(s, d).filter("parsed"))


@query("date_sequence_mismatches", "F6", f"WITH {REC}{NUMB} SELECT ddr_number, source_filename, safe_doc_id, wellbore, report_date, expected_date FROM mm")
def _(s, d):
    return audit.sequence_mismatches(recs(s, d).filter("parsed"))


@query("audit_issues", "F7", f"WITH {REC}{ISS} SELECT * FROM iss")
def _(s, d):
    return audit.issues(ordered.stored(recs(s, d)))


@query("audit_summary", "F8", f"""WITH {REC}{ISS}, r AS (SELECT count(*) AS pdf_count, count(*) FILTER (parsed) AS parsed_count, count(*) FILTER (NOT parsed) AS unparsed_count, min(report_date) AS date_range_start, max(report_date) AS date_range_end, min(ddr_number) AS ddr_number_min, max(ddr_number) AS ddr_number_max FROM rec)
SELECT r.*, (SELECT count(*) FROM iss WHERE severity = 'error') AS blocking_issue_count, (SELECT count(*) FROM iss WHERE severity = 'warning') AS warning_count, (SELECT count(*) FROM iss WHERE issue_type = 'missing_report') AS missing_report_count FROM r""")
def _(s, d):
    r = ordered.stored(recs(s, d))
    return audit.summary(r, audit.issues(r))


@query("audit_wellbore_counts", "F8 E8", f"WITH {REC} SELECT wellbore, count(*) AS n FROM rec WHERE parsed AND wellbore <> '' GROUP BY 1")
def _(s, d):
    return audit.counts(recs(s, d).filter("parsed"), "wellbore")


@query("canonical_copies", "F9", f"""WITH {REC} SELECT rig, wellbore, report_date, source_filename, file_size_bytes FROM rec WHERE parsed QUALIFY row_number() OVER (PARTITION BY rig, wellbore, report_date ORDER BY
 contains(warnings, 'filename_copy_marker')::INT, contains(source_filename, '[')::INT, contains(warnings, 'filename_source_revision_marker')::INT, -file_size_bytes, source_filename) = 1""")
def _(s, d):
    return audit.canonical_copies(recs(s, d)).select("rig", "wellbore", "report_date", "source_filename", "file_size_bytes")


_GAPS = """{events_meta}, rp0 AS (SELECT 'W' || (user_id % 4) AS well_id, user_id AS number, max(d) AS report_date, max_by(event_type, event_id) AS phase, CAST(max(floor(value)) AS BIGINT) AS depth, CAST(count(*) AS VARCHAR) || ' rows' AS summary FROM events_meta GROUP BY 1, 2),
rp AS (SELECT * FROM rp0)"""


@query("gap_blocks", "F10", f"""WITH {_GAPS}, l AS (SELECT *, lag(number) OVER w AS pn, lag(report_date) OVER w AS pd, lag(phase) OVER w AS pp, lag(depth) OVER w AS pz, lag(summary) OVER w AS ps FROM rp WINDOW w AS (PARTITION BY well_id ORDER BY number))
SELECT well_id, pn + 1 AS first_missing, number - 1 AS last_missing, number - pn - 1 AS num_missing, pd AS date_before, report_date AS date_after, pp AS phase_before, phase AS phase_after, pp <> phase AS cross_phase, pz AS depth_before, depth AS depth_after, ps AS summary_before, summary AS summary_after FROM l WHERE number - pn > 1""")
def _(s, d):
    e = view(s, d, "events_meta")
    rp = e.groupBy(F.concat(F.lit("W"), (F.col("user_id") % 4).cast("string")).alias("well_id"), F.col("user_id").alias("number")).agg(
        F.max("d").alias("report_date"), F.max_by("event_type", "event_id").alias("phase"), F.max(F.floor("value")).alias("depth"),
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" rows")).alias("summary"))
    return audit.gap_blocks(rp, width=16)


_COMB = """comb AS (SELECT o_custkey % 40 AS doc_id, CAST(o_orderkey AS INT) AS page, CASE WHEN o_orderkey % 5 = 0 THEN 'DAILY WELL OPERATION Report No: ' || (o_orderkey % 300) || ' Date: ' || strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 5 = 1 THEN 'Report No: ' || o_orderkey ELSE 'continued text' END AS clean_text FROM orders)"""
_PN, _PD, _PM = r"Report No:?\s*(\d+)", r"Date:\s*(\d{2}[/.-]\d{2}[/.-]\d{4})", r"(?i)DAILY\s+WELL\s+OPERATION"


@query("split_combined_reports", "F11", f"""WITH {_COMB}, h AS (SELECT doc_id, page, TRY_CAST(regexp_extract(clean_text, {o.q(_PN)}, 1) AS BIGINT) AS report_no, translate(regexp_extract(clean_text, {o.q(_PD)}, 1), '/-', '..') AS date_text FROM comb WHERE regexp_matches(left(clean_text, 800), 'DAILY\\s+WELL\\s+OPERATION', 'i')),
st AS (SELECT doc_id, report_no, min(page) AS page_start, arg_min(date_text, page) AS date_text FROM h WHERE report_no IS NOT NULL AND date_text <> '' GROUP BY 1, 2), l AS (SELECT doc_id, max(page) AS lp FROM comb GROUP BY 1)
SELECT doc_id, report_no, date_text, page_start, coalesce(lead(page_start) OVER (PARTITION BY doc_id ORDER BY page_start) - 1, lp)::INTEGER AS page_end FROM st JOIN l USING (doc_id)""")
def _(s, d):
    o_ = s.read.parquet(f"{d}/orders.parquet")
    k, dt = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    comb = o_.select((F.col("o_custkey") % 40).alias("doc_id"), k.cast("int").alias("page"), F.when(k % 5 == 0, F.concat(
        F.lit("DAILY WELL OPERATION Report No: "), (k % 300).cast("string"), F.lit(" Date: "), dt)).when(
        k % 5 == 1, F.concat(F.lit("Report No: "), k.cast("string"))).otherwise("continued text").alias("clean_text"))
    return audit.split_combined(comb, _PN, _PD, _PM)


@query("detect_profile", "F12", "WITH {filenames} SELECT source_filename, CASE WHEN regexp_matches(source_filename, '^RigAlpha ') THEN 'alpha' WHEN regexp_matches(source_filename, '^North_Site_') THEN 'compact' ELSE 'generic' END AS profile FROM filenames")
def _(s, d):
    return audit.detect_profile(view(s, d, "filenames"), [("compact", "^North_Site_"), ("alpha", "^RigAlpha ")], "generic").select("source_filename", "profile")
