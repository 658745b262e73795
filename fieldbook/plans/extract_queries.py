"""Queries over extracted table cells and page signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.operators import answers as an
from fieldbook.operators import citations as ci
from fieldbook.operators import contents as ct
from fieldbook.operators import extract as ex
from fieldbook.operators import packing as pk
from fieldbook.operators import pages as pg
from fieldbook.operators import regions as rg
from fieldbook.operators import sleeves as sv
from fieldbook.operators import wellsections as ws
from fieldbook.plans.registry import query
from fieldbook.plans.views import table, view


def _cells(s, d):
    v = view(s, d, "opcells")
    return v.select("doc_id", "page", "table_no", "row_no", F.array(*[f"c{k}" for k in range(8)]).alias("cells"))


def _operations(across: bool) -> str:
    reach = "doc_id" if across else "doc_id, page, table_no"
    return f"""WITH {{opcells}},
x AS (SELECT doc_id, page, table_no, row_no, list_transform([c0, c1, c2, c3, c4, c5, c6, c7], lambda c: trim(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g'))) AS r FROM opcells),
f AS (SELECT *, len(list_filter(r, lambda c: c <> '')) AS k, array_to_string(r, ' ') AS j, list_transform(r, lambda c: lower(c)) AS lc FROM x),
tab AS (SELECT doc_id, page, table_no FROM f GROUP BY ALL HAVING bool_or(contains(upper(j), 'OPERATION SUMMARY')) OR regexp_matches(string_agg(j, ' ' ORDER BY row_no), '\\d{{1,2}}:\\d{{2}}.*?\\d+\\.\\d+')),
g AS (SELECT f.*, starts_with(upper(r[1]), 'OPERATION SUMMARY') AND k <= 2 AS title, regexp_matches(r[1], '^\\d{{2}}:\\d{{2}}-\\d{{2}}:\\d{{2}}') AND k <= 2 AS shift,
  {{{{'st': list_position(list_transform(lc, lambda c: contains(c, 'start') AND contains(c, 'time')), true), 'en': list_position(list_transform(lc, lambda c: contains(c, 'end') AND contains(c, 'time')), true),
   'du': list_position(list_transform(lc, lambda c: c LIKE 'dur%hr%'), true), 'ph': list_position(lc, 'phase'), 'oc': list_position(lc, 'op code'), 'ac': list_position(list_transform(lc, lambda c: contains(c, 'activity')), true),
   'pt': list_position(lc, 'p-t-x'), 'op': list_position(list_transform(lc, lambda c: starts_with(c, 'operation')), true)}}}} AS m FROM f SEMI JOIN tab USING (doc_id, page, table_no)),
h AS (SELECT *, coalesce(NOT title AND NOT shift AND m.st > 0 AND m.du > 0 AND m.ph > 0 AND m.op > 0, false) AS header FROM g),
c AS (SELECT * EXCLUDE (m), last_value(CASE WHEN shift AND NOT title THEN r[1] END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, table_no, row_no) AS sh,
  last_value(CASE WHEN shift AND NOT title THEN {{{{'ok': false, 'm': m}}}} WHEN header THEN {{{{'ok': true, 'm': m}}}} END IGNORE NULLS) OVER (PARTITION BY {reach} ORDER BY page, table_no, row_no) AS e FROM h),
v AS (SELECT doc_id, page, table_no, row_no, sh, r[e.m.st] AS st, CASE WHEN e.m.en > 0 THEN r[e.m.en] ELSE '' END AS en, r[e.m.du] AS du, r[e.m.ph] AS ph, r[e.m.oc] AS oc, r[e.m.ac] AS ac, r[e.m.pt] AS pt, r[e.m.op] AS op
  FROM c WHERE e.ok AND NOT title AND NOT shift AND NOT header AND k >= 2),
w AS (SELECT *, st = '' AND du = '' AND op <> '' AS goes, regexp_matches(st, '^\\d{{1,2}}:\\d{{2}}$') AS clock, regexp_matches(du, '^\\d+(\\.\\d+)?$') AS hours FROM v),
y AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY {reach} ORDER BY page, table_no, row_no) AS run FROM w WHERE goes OR ((st <> '' OR op <> '') AND (st = '' OR clock OR hours))),
z AS (SELECT *, string_agg(CASE WHEN goes THEN ' ' || op ELSE left(op, 800) END, '' ) OVER (PARTITION BY {reach}, run ORDER BY page, table_no, row_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS body FROM y WHERE run > 0)
SELECT doc_id, page, table_no, row_no, coalesce(sh, CASE WHEN TRY_CAST(split_part(st, ':', 1) AS INT) IS NULL THEN 'unknown' WHEN CAST(split_part(st, ':', 1) AS INT) < 6 THEN '00:00-06:00' WHEN CAST(split_part(st, ':', 1) AS INT) < 12 THEN '06:00-12:00'
  WHEN CAST(split_part(st, ':', 1) AS INT) < 18 THEN '12:00-18:00' ELSE '18:00-00:00' END) AS shift_block, st AS start_time, en AS end_time, CASE WHEN hours THEN CAST(du AS DOUBLE) END AS duration_hr,
  ph AS phase, oc AS op_code, ac AS activity_code, pt AS pt_x, upper(pt) = 'T' AS is_npt, body AS operation_text,
  trim(CASE WHEN st <> '' AND NOT clock THEN 'unexpected start_time ' || CASE WHEN contains(st, '''') THEN '"' || st || '"' ELSE '''' || st || '''' END ELSE '' END || CASE WHEN du <> '' AND NOT hours THEN ' unparsed duration ''' || du || '''' ELSE '' END) AS parse_warning
FROM z WHERE NOT goes""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")


@query("operation_rows", "G8", _operations(False))
def _(s, d):
    return ex.operation_rows(_cells(s, d), width=32)


@query("operation_rows_across_pages", "G8", _operations(True))
def _(s, d):
    return ex.operation_rows(_cells(s, d), across=True)


# Signals of pages by rule, and what each title folds to, written by hand.
_SIGNALS = """SELECT doc_id, page, CASE rec_id % 13 WHEN 0 THEN 'Part A' WHEN 5 THEN 'Part B' END AS part_found,
  CASE rec_id % 7 WHEN 0 THEN 'The Performance Report' WHEN 2 THEN 'Notes to the Accounts' WHEN 5 THEN 'Remuneration (continued)' END AS section_found,
  CASE rec_id % 8 WHEN 0 THEN 'a. overview' WHEN 2 THEN 'note 4. leases' WHEN 3 THEN '2.1 Risks' WHEN 5 THEN 'Strategic plans' WHEN 6 THEN 'Weather log' END AS subsection_found,
  CASE WHEN page % 6 < 2 THEN 'Performance Report' WHEN page % 6 = 4 THEN 'Remuneration' WHEN page % 6 = 5 THEN 'Unknown' END AS prior_section,
  CASE WHEN page % 5 = 1 THEN 'Strategic plan' WHEN page % 5 = 3 THEN 'Unknown' END AS prior_subsection,
  CAST(floor(rec_id / 40) AS BIGINT) % 3 <> 0 AS toc_active
  FROM (SELECT rec_id, 'B' || CAST(CAST(floor(rec_id / 40) AS BIGINT) AS STRING) AS doc_id, CAST(1 + rec_id % 40 AS INT) AS page FROM docpages) p"""
_LABELS = f"""WITH {{docpages}}, sg AS ({_SIGNALS}),
sec(t, canon, norm) AS (VALUES ('The Performance Report', 'PERFORMANCE REPORT', 'performance report'), ('Performance Report', 'PERFORMANCE REPORT', 'performance report'),
  ('Notes to the Accounts', 'FINANCIAL STATEMENTS', 'notes to the accounts'), ('Remuneration (continued)', 'REMUNERATION', 'remuneration continued'), ('Remuneration', 'REMUNERATION', 'remuneration')),
sub(t, canon, note, allowed, norm) AS (VALUES ('a. overview', 'A) OVERVIEW', false, false, 'x1'), ('note 4. leases', 'NOTE 4. LEASES', true, false, 'x2'), ('2.1 Risks', '2.1 RISKS', false, true, 'x3'),
  ('Strategic plans', 'STRATEGIC PLAN', false, true, 'strategic plan'), ('Weather log', 'WEATHER LOG', false, false, 'x5')),
a AS (SELECT sg.*, CASE WHEN toc_active THEN nullif(prior_section, 'Unknown') END AS ps, CASE WHEN toc_active THEN nullif(prior_subsection, 'Unknown') END AS pu FROM sg),
b AS (SELECT a.*, f.canon AS fc, p.canon AS pc, coalesce(f.norm <> p.norm, false) AS other FROM a LEFT JOIN sec f ON f.t = section_found LEFT JOIN sec p ON p.t = ps),
c AS (SELECT *, section_found IS NOT NULL AND NOT other AS taken, CASE WHEN section_found IS NOT NULL AND NOT other THEN fc ELSE pc END AS st FROM b),
d AS (SELECT c.*, last_value(st IGNORE NULLS) OVER w AS section_, last_value(part_found IGNORE NULLS) OVER w AS part_ FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
e AS (SELECT d.*, u.canon AS uc, u.norm AS un, coalesce(toc_active AND NOT u.allowed, false) AS rejected,
  u.t IS NOT NULL AND NOT (toc_active AND NOT u.allowed) AND NOT (coalesce(section_, '') = 'FINANCIAL STATEMENTS' AND NOT u.note) AS ok FROM d LEFT JOIN sub u ON u.t = subsection_found),
f AS (SELECT *, CASE WHEN ok THEN CASE WHEN toc_active THEN uc ELSE upper(CASE WHEN subsection_found = 'a. overview' THEN 'a) overview' ELSE subsection_found END) END
  WHEN subsection_found IS NOT NULL AND toc_active THEN coalesce(upper(pu), 'Unknown') WHEN taken THEN 'Unknown' ELSE upper(pu) END AS ut FROM e)
SELECT doc_id, page, coalesce(part_, 'Unknown') AS part, coalesce(section_, 'Unknown') AS section_title,
  coalesce(last_value(ut IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page), 'Unknown') AS subsection_title,
  coalesce(pc, 'Unknown') AS toc_prior_section, coalesce(upper(pu), 'Unknown') AS toc_prior_subsection,
  CAST(CASE WHEN ok AND pu IS NOT NULL AND un <> 'strategic plan' THEN 1 ELSE 0 END AS INTEGER) AS overrides, rejected FROM f"""


def _page_labels(s, d):
    docs = view(s, d, "docpages")
    docs.createOrReplaceTempView("docpages")
    return pg.page_labels(s.sql(_SIGNALS).withColumn("allowed", F.array(F.lit("Strategic plan"), F.lit("Risk review"))), width=4)


@query("page_labels", "K6", _LABELS)
def _(s, d):
    return _page_labels(s, d).drop("score")


@query("page_label_diagnostics", "K6", f"""SELECT doc_id, count(*) FILTER (toc_prior_section <> 'Unknown' OR toc_prior_subsection <> 'Unknown') AS toc_coverage_pages, CAST(sum(overrides) AS BIGINT) AS toc_override_count,
  count(*) FILTER (rejected) AS subsection_reject_count FROM ({_LABELS}) GROUP BY doc_id""")
def _(s, d):
    return pg.label_diagnostics(_page_labels(s, d))


# Documents as table rows: two hundred to a table; a row's words, facts and category by rule.
_PACK = """SELECT CAST(floor(doc_id / 200) AS BIGINT) AS table_id, doc_id % 200 AS idx, CAST(12 + floor(doc_id / 200) AS INT) AS head, CAST(1 + n_chars % 97 + CASE WHEN doc_id % 31 = 0 THEN 400 ELSE 0 END AS INT) AS words,
  CAST(doc_id % 5 AS INT) AS n_facts, CASE WHEN lang = 'en' AND doc_id % 3 > 0 THEN 'General' ELSE 'group ' || lang END AS category, CASE WHEN lang = 'en' AND doc_id % 3 > 0 THEN 0 ELSE 3 END AS shown FROM documents"""
_WORDS = "CASE WHEN len({c}) = 1 THEN 4 WHEN len({c}) > 1 THEN 2 + 3 * least(len({c}), 4) ELSE 0 END"
_FACTS = "CASE WHEN {f} > 0 THEN 1 + 4 * least({f}, 24) ELSE 0 END"


def _rows(s, d):
    table(s, d, "documents").createOrReplaceTempView("documents")
    rows = s.sql(_PACK)
    return rows.withColumn("facts", F.when(F.col("n_facts") > 0, F.array_repeat(F.lit(4), F.col("n_facts"))).otherwise(F.array().cast("array<int>")))


def _groups(kind: str, extend: str, first: str, next_: str) -> str:
    return f"""WITH RECURSIVE p AS ({_PACK}), g AS ({first} FROM p WHERE idx = 0 UNION ALL SELECT {next_} FROM (SELECT p.*, g.table_id AS t, g.start AS s0, g.n AS n0, g.a AS a0, g.f AS f0, g.sh AS sh0, g.c AS c0,
  CASE WHEN p.category <> 'General' AND NOT list_contains(g.c, p.category) THEN list_append(g.c, p.category) ELSE g.c END AS c1 FROM g JOIN p ON p.table_id = g.table_id AND p.idx = g.idx + 1) x, LATERAL (SELECT {extend} AS more) y)
SELECT table_id, start AS row_start_idx, max(idx) AS row_end_idx, CAST(count(*) AS INTEGER) AS n_rows FROM g GROUP BY table_id, start"""


_OWN = "CASE WHEN category = 'General' THEN [] ELSE [category] END"
_TOTAL = f"head + a0 + words + CASE WHEN len(c1) > 1 THEN sh0 + shown ELSE 0 END + {_WORDS.format(c='c1')} + {_FACTS.format(f='(f0 + n_facts)')}"


@query("table_row_blocks", "L12", _groups(
    "rows", f"n0 < 10 AND {_TOTAL} <= 320", f"SELECT table_id, idx, idx AS start, 1 AS n, words AS a, n_facts AS f, shown AS sh, {_OWN} AS c",
    f"t, idx, CASE WHEN more THEN s0 ELSE idx END, CASE WHEN more THEN n0 + 1 ELSE 1 END, CASE WHEN more THEN a0 ELSE 0 END + words, CASE WHEN more THEN f0 ELSE 0 END + n_facts, CASE WHEN more THEN sh0 ELSE 0 END + shown, CASE WHEN more THEN c1 ELSE {_OWN} END"))
def _(s, d):
    return pk.row_blocks(_rows(s, d), ["table_id"], block=32)


@query("table_budget_blocks", "L13", _groups(
    "tokens", "head + a0 + words <= 224", "SELECT table_id, idx, idx AS start, 1 AS n, words AS a, 0 AS f, 0 AS sh, ['x'] AS c",
    "t, idx, CASE WHEN more THEN s0 ELSE idx END, 1, CASE WHEN more THEN a0 ELSE 0 END + words, 0, 0, c0"))
def _(s, d):
    return pk.budget_blocks(_rows(s, d).withColumnRenamed("words", "tokens"), ["table_id"], 224)


# Every document is a page of a book of fifty, whose contents list names its pages' first words and a printed number that
# is off by two (by five in every third book, by a page of its own for every seventh entry).
_BOOK = """SELECT 'B' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING) AS doc_id, CAST(1 + doc_id % 50 AS INT) AS page, doc_id AS rec_id, text AS clean_text FROM documents"""
_ITEMS = """SELECT doc_id, lower(array_to_string(list_slice(regexp_extract_all(clean_text, '[A-Za-z]+'), 1, CAST(1 + rec_id % 9 AS INT)), ' ')) AS title_norm,
  CAST(page - CASE WHEN rec_id % 7 = 0 THEN page WHEN CAST(floor(rec_id / 50) AS BIGINT) % 3 = 0 THEN 5 ELSE 2 END AS INT) AS start_printed_page FROM bk WHERE page > 2"""
_TOKENS = "list_filter(regexp_extract_all(title_norm, '[a-z0-9]+'), lambda w: length(w) >= 3)"


@query("page_offset", "K4", f"""WITH bk AS ({_BOOK}), it0 AS ({_ITEMS}), it1 AS (SELECT *, {_TOKENS} AS a, list_filter({_TOKENS}, lambda w: w NOT IN ('the', 'and', 'for', 'year', 'to', 'of', 'report', 'statement', 'accounts')) AS b FROM it0),
it AS (SELECT * EXCLUDE (a, b), CASE WHEN len(b) > 0 THEN b ELSE a END AS toks FROM it1),
pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(toks) >= 2 DESC, length(title_norm) DESC, start_printed_page DESC, title_norm) AS r, bool_or(len(toks) >= 2) OVER (PARTITION BY doc_id) AS any_ FROM it QUALIFY r <= 5),
pg AS (SELECT doc_id, page, trim(regexp_replace(regexp_replace(replace(translate(lower(trim(regexp_replace(clean_text, '\\s+', ' ', 'g'))), '’`', ''''''), '&', ' and '), '[^a-z0-9\\s.'']', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM bk WHERE page > 2),
v AS (SELECT pk.doc_id, r, page, page - start_printed_page AS off, len(list_filter(toks, lambda t: contains(norm, t))) AS hit, len(toks) AS n FROM pk JOIN pg USING (doc_id) WHERE (len(toks) >= 2 OR NOT any_) AND start_printed_page > 0 AND len(toks) > 0),
w AS (SELECT * FROM v WHERE hit >= least(2, n) AND hit / n >= 0.34 QUALIFY row_number() OVER (PARTITION BY doc_id, r ORDER BY hit / n DESC, page) = 1),
x AS (SELECT doc_id, off, count(*) AS k, min(r) AS f FROM w GROUP BY ALL), y AS (SELECT doc_id, off, k, sum(k) OVER (PARTITION BY doc_id) AS t FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, f) = 1),
z AS (SELECT doc_id, count(*) AS m FROM it GROUP BY 1)
SELECT doc_id, coalesce(off, 0)::INTEGER AS "offset", round(CASE WHEN t IS NULL THEN 0.15 ELSE 0.5 * k / t + 0.5 * least(1.0, m / 12) END, 6) AS confidence, coalesce(k, 0) AS support_count FROM z LEFT JOIN y USING (doc_id)""")
def _(s, d):
    table(s, d, "documents").createOrReplaceTempView("documents")
    s.sql(_BOOK).createOrReplaceTempView("bk")
    words = F.regexp_extract_all("clean_text", F.lit("[A-Za-z]+"), F.lit(0))
    off = F.when(F.col("rec_id") % 7 == 0, F.col("page")).when(F.floor(F.col("rec_id") / 50) % 3 == 0, 5).otherwise(2)
    items = s.table("bk").filter("page > 2").select(
        "doc_id", F.lower(F.array_join(F.slice(words, 1, (1 + F.col("rec_id") % 9).cast("int")), " ")).alias("title_norm"), (F.col("page") - off).cast("int").alias("start_printed_page"))
    out = ct.page_offset(items, s.table("bk"), s.table("bk").filter("page <= 2").select("doc_id", "page"))
    return out.withColumn("confidence", F.round("confidence", 6))


# Lines of contents pages, twenty-five documents to a page and two pages to a book, in every form that an entry may take.
_TOCLINES = """SELECT 'B' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING) AS doc_id, CAST(1 + floor((doc_id % 50) / 25) AS INT) AS page, CAST(doc_id % 25 AS INT) AS line_no,
  CASE (doc_id * 5 + CAST(floor(doc_id / 12) AS BIGINT)) % 12 WHEN 0 THEN 'Item of ' || source || ' ..... ' || CAST(1 + doc_id % 60 AS STRING) WHEN 1 THEN 'Wrapped title ' || lang WHEN 2 THEN CAST(1 + doc_id % 60 AS STRING)
    WHEN 3 THEN 'MAJOR BAND ' || upper(source) WHEN 4 THEN 'Plain item ' || lang || ' ' || CAST(2 + doc_id % 50 AS STRING) WHEN 5 THEN 'a) lettered ' || lang WHEN 6 THEN 'more of it' WHEN 7 THEN 'Performance  Report'
    WHEN 8 THEN 'Page' WHEN 9 THEN 'note: see ' || source WHEN 10 THEN 'single' ELSE 'year of ' || lang || ' 9999' END AS text FROM documents"""
_LEVEL = """CASE WHEN regexp_matches({t}, '(?i)^(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)[.)]\\s+.+$') THEN 3 WHEN regexp_matches({t}, '(?i)^[a-z][.)]\\s+.+$') THEN 2 WHEN contains(lower({t}), 'performance report') THEN 1
  WHEN length(regexp_replace({t}, '[^A-Z]', '', 'g')) >= 0.75 * length(regexp_replace({t}, '[^A-Za-z]', '', 'g')) AND length(regexp_replace({t}, '[^A-Za-z]', '', 'g')) > 0 THEN 1 ELSE 2 END"""


@query("contents_items", "K3 K2", f"""WITH RECURSIVE tl AS ({_TOCLINES}), l0 AS (SELECT doc_id, page, line_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM tl),
l1 AS (SELECT *, CASE WHEN regexp_matches(t, '^\\d+$') THEN 'number' WHEN regexp_matches(t, '^.+ \\d{{1,3}}$') THEN 'entry' WHEN regexp_matches(t, '\\b\\d{{1,4}}$') OR NOT contains(t, ' ') OR starts_with(t, 'note:') THEN 'skip' ELSE 'text' END AS kind,
  trim(regexp_replace(regexp_replace(t, ' \\d{{1,3}}$', ''), ' \\.+$', '')) AS ti, TRY_CAST(regexp_extract(t, '(\\d+)$', 1) AS INTEGER) AS pg FROM l0),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS i FROM l1 WHERE kind <> 'skip'),
g AS (SELECT doc_id, 0::BIGINT AS i, '' AS carry, 0 AS page, NULL::VARCHAR AS et, NULL::INTEGER AS ep, NULL::INTEGER AS el FROM (SELECT DISTINCT doc_id FROM l)
  UNION ALL SELECT x.doc_id, x.i, CASE WHEN kind <> 'text' THEN '' WHEN cut THEN ti ELSE trim(carry || ' ' || ti) END, x.page,
    CASE WHEN kind = 'text' AND cut THEN carry WHEN kind = 'number' AND carry <> '' THEN carry WHEN kind = 'entry' THEN trim(carry || ' ' || ti) END, CASE WHEN kind <> 'text' THEN pg END,
    CASE WHEN carry <> '' THEN {_LEVEL.format(t="carry")} ELSE {_LEVEL.format(t="ti")} END
  FROM (SELECT l.*, g.carry, carry <> '' AND {_LEVEL.format(t="ti")} = 1 AND {_LEVEL.format(t="carry")} >= 2 AS cut FROM g JOIN l ON l.doc_id = g.doc_id AND l.i = g.i + 1) x),
e AS (SELECT doc_id, i, page, et, ep, el FROM g WHERE et IS NOT NULL UNION ALL
  SELECT doc_id, i + 1, 2, carry, NULL, 1 FROM g WHERE carry <> '' AND {_LEVEL.format(t="carry")} = 1 QUALIFY i = max(i) OVER (PARTITION BY doc_id) AND i = (SELECT max(i) FROM l WHERE l.doc_id = g.doc_id)),
f AS (SELECT doc_id, page AS toc_page, i, et AS title_raw, trim(regexp_replace(regexp_replace(lower(et), '[^a-z0-9\\s.'']', ' ', 'g'), '\\s+', ' ', 'g')) AS title_norm, el AS level,
  coalesce(ep, first_value(ep IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), last_value(ep IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS start_printed_page FROM e)
SELECT doc_id, toc_page, start_printed_page, title_raw, title_norm, level FROM f WHERE start_printed_page > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, title_norm, start_printed_page ORDER BY i) = 1""")
def _(s, d):
    table(s, d, "documents").createOrReplaceTempView("documents")
    lines = s.sql(_TOCLINES)
    pages = lines.groupBy("doc_id", "page").agg(F.lit("no numbers here").alias("clean_text"), F.lit(60).alias("n_pages"))
    return ct.contents_items(lines, pages).drop("pos")


# Line items as printed lines: four orders to a page, heights and gaps by rule, some lines reaching down over the next.
_SPOTS = """SELECT 'D' || CAST(CAST(floor(l_orderkey / 200) AS BIGINT) AS STRING) AS doc_id, CAST(floor((l_orderkey % 200) / 4) AS INT) AS page, CAST(n AS INT) AS line_no, 'line ' || CAST(l_partkey AS STRING) AS text,
  CAST(l_suppkey % 9 AS DOUBLE) AS x0, CAST(100 + l_partkey % 50 AS DOUBLE) AS x1, CAST(n * 30 + l_partkey % 23 AS DOUBLE) AS y0, CAST(n * 30 + l_partkey % 23 + l_suppkey % 15 + CASE WHEN l_partkey % 11 = 0 THEN 60 ELSE 0 END AS DOUBLE) AS y1
FROM (SELECT *, row_number() OVER (PARTITION BY floor(l_orderkey / 4) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) l"""


@query("page_regions", "J12", f"""WITH RECURSIVE sp AS ({_SPOTS}), s AS (SELECT *, row_number() OVER w AS i, y0 - CASE WHEN lag(y1) OVER w = 0 THEN y0 ELSE lag(y1) OVER w END AS away FROM sp WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, line_no)),
m AS (SELECT doc_id, page, greatest(18, 1.8 * greatest(coalesce(median(y1 - y0) FILTER (y1 > y0), 10), 1)) AS gap FROM sp GROUP BY ALL),
g0 AS (SELECT s.*, sum(CASE WHEN away > gap THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id, s.page ORDER BY i) AS g FROM s JOIN m USING (doc_id, page)),
g AS (SELECT doc_id, page, g, min(y0) AS top, max(y1) AS bottom, count(*) AS n FROM g0 GROUP BY ALL),
r1 AS (SELECT doc_id, page, g, g AS j, bottom, n FROM g WHERE g = 0 UNION ALL SELECT g.doc_id, g.page, g.g, CASE WHEN g.n < 2 AND g.top - r1.bottom <= 10 THEN r1.j ELSE g.g END, CASE WHEN g.n < 2 AND g.top - r1.bottom <= 10 THEN greatest(r1.bottom, g.bottom) ELSE g.bottom END, g.n FROM r1 JOIN g ON g.doc_id = r1.doc_id AND g.page = r1.page AND g.g = r1.g + 1),
j AS (SELECT doc_id, page, j, sum(n) AS n FROM r1 GROUP BY ALL), k AS (SELECT *, sum(CASE WHEN n >= 2 OR j = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY j) - 1 AS region_index FROM j),
z AS (SELECT g0.*, k.region_index FROM g0 JOIN r1 USING (doc_id, page, g) JOIN k USING (doc_id, page, j))
SELECT doc_id, page, CAST(region_index AS INTEGER) AS region_index, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(count(*) AS INTEGER) AS line_count, string_agg(text, chr(10) ORDER BY y0, x0, line_no) AS text,
  format('p{{:04d}}_r{{:02d}}', page, CAST(region_index AS INTEGER)) AS region_id FROM z GROUP BY doc_id, page, region_index""".replace("{{", "{").replace("}}", "}"))
def _(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("lineitem")
    return rg.page_regions(s.sql(_SPOTS))


# Chunks of a document's words that overlap by none, one, some and all tokens.
@query("chunk_overlaps", "L20", """WITH w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g'), ' +'), lambda x: x <> '') AS a FROM documents),
c AS (SELECT doc_id, k, CASE WHEN k = 3 THEN list_slice(a, 30 + 1, 60) WHEN k = 4 THEN ['and'] ELSE list_slice(a, k * (20 - CAST(doc_id % 20 AS INT)) + 1, k * (20 - CAST(doc_id % 20 AS INT)) + 20) END AS t FROM w, (SELECT unnest(range(5)) AS k) WHERE len(a) > 0),
n AS (SELECT *, CAST(len(t) AS INTEGER) AS token_count, lead(t) OVER (PARTITION BY doc_id ORDER BY k) AS nx FROM c),
o AS (SELECT *, CAST(coalesce(list_max(list_filter(range(1, least(len(t), len(nx)) + 1), lambda q: list_slice(t, len(t) - q + 1, len(t)) = list_slice(nx, 1, q))), 0) AS INTEGER) AS overlap_next_tokens FROM n),
p AS (SELECT *, coalesce(lag(overlap_next_tokens) OVER v, 0)::INTEGER AS overlap_prev_tokens, coalesce(sum(token_count - overlap_next_tokens) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS token_start FROM o WINDOW v AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, 1 AS page, 'c' || k AS chunk_id, token_count, overlap_prev_tokens, overlap_next_tokens, token_start, token_start + token_count AS token_end FROM p""")
def _(s, d):
    w = table(s, d, "documents").select("doc_id", F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]+", " "), " +"), lambda x: x != "").alias("a")).filter(F.size("a") > 0)
    step = (20 - F.col("doc_id") % 20).cast("int")
    cut = [F.slice("a", F.lit(k) * step + 1, 20) for k in range(3)] + [F.slice("a", 31, 30), F.array(F.lit("and"))]
    c = w.select("doc_id", F.posexplode(F.array(*cut)).alias("k", "t"))
    return rg.chunk_overlaps(c.select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("chunk_id"), F.array_join("t", " ").alias("chunk_text")))


# Line items as reports on sleeves: a well of eighteen, a few sentences to a sleeve.
_SLEEVES = """SELECT 'W' || CAST(l_orderkey % 300 AS STRING) AS well_id, CAST(l_shipdate AS DATE) AS report_date, CAST(l_linenumber AS INT) AS page, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS seq, CASE (l_orderkey + l_linenumber * 5 + l_suppkey) % 16
  WHEN 0 THEN 'Observed sleeve #' || n || ' open at ' || CAST(3 + l_suppkey % 3 AS STRING) || ',' || CAST(100 + l_partkey % 900 AS STRING) || ' psi' WHEN 1 THEN 'Breakover at ' || CAST(l_partkey AS STRING) || ' psi on Sleeve ' || n || ', ISIP of ' || CAST(1000 + l_suppkey AS STRING) || ' psi'
  WHEN 2 THEN 'Injected ' || CAST(l_suppkey % 40 AS STRING) || '.5 bbls into sleeve ' || n || '; inject 3 bbl' WHEN 3 THEN 'Main frac at sleeve ' || n || ': 12,' || CAST(100 + l_partkey % 900 AS STRING) || ' lbs of 100 mesh, 900 lbs sand, 300 bbls linear gel'
  WHEN 4 THEN 'Staged up rate to ' || CAST(10 + l_suppkey % 9 AS STRING) || '.5 bpm, 4,' || CAST(100 + l_partkey % 900 AS STRING) || ' psi, sleeve ' || n || ' and sleeve #7' WHEN 5 THEN 'No positive indication at sleeve ' || n WHEN 6 THEN 'Packer did not set at sleeve ' || n
  WHEN 7 THEN 'Packer set, located into sleeve ' || n WHEN 8 THEN 'NCS confirmed sleeve open, sleeve ' || n WHEN 9 THEN 'sleeve 45 and sleeve 0 checked' WHEN 10 THEN '5,000 lbs proppant planned for sleeve ' || n WHEN 11 THEN 'unable to find sleeve ' || n || ', packer not sealing'
  WHEN 12 THEN NULL ELSE 'Packer not set, sleeve ' || n END AS operation_text FROM (SELECT *, CAST(1 + l_partkey % 18 AS STRING) AS n FROM lineitem) l"""
_NUM = lambda p, g=1: f"list_transform(regexp_extract_all(t, '(?i){p}', {g}), lambda x: CAST(replace(x, ',', '') AS DOUBLE))"


@query("sleeve_status", "I17 I18", f"""WITH o AS ({_SLEEVES}), x AS (SELECT *, coalesce(operation_text, '') AS t FROM o),
r AS (SELECT well_id, report_date, page, seq, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(t, '(?i)sleeve\\s*#?\\s*(\\d+)', 1), lambda n: CAST(n AS INTEGER)), lambda n: n BETWEEN 1 AND 18))) AS sleeve_no,
  {_NUM("sleeve #\\d+ open at ([0-9,]+) psi")}[1] AS op, regexp_matches(t, '(?i)open at|NCS confirmed') AS opens, {_NUM("breakover at ([0-9,]+) psi")}[1] AS bo, {_NUM("ISIP of ([0-9,]+) psi")}[1] AS isip,
  list_sum({_NUM("inject(?:ed)? ([0-9.]+) bbl")}) AS vol, CASE WHEN contains(t, 'Main frac') THEN list_sum(list_filter({_NUM("([0-9,]+) lbs (?:of 100 mesh|sand)")}, lambda v: v > 1000)) END AS lbs, CASE WHEN contains(t, 'Main frac') THEN 300.0::DOUBLE END AS fl,
  {_NUM("rate to ([0-9.]+) bpm")}[1] AS rate, {_NUM("bpm, ([0-9,]+) psi")}[1] AS treat, regexp_matches(t, 'Packer did not set|packer not sealing|Packer not set') AS fails, regexp_matches(t, 'No positive|unable to find') AS ns, regexp_matches(t, 'Packer set, located') AS loc FROM x),
e AS (SELECT *, row_number() OVER (PARTITION BY well_id, sleeve_no ORDER BY report_date, page, seq) AS k FROM r),
f AS (SELECT *, min(k) FILTER (opens) OVER w AS ko FROM e WINDOW w AS (PARTITION BY well_id, sleeve_no)),
a AS (SELECT well_id, sleeve_no, bool_or(opens) AS opened, arg_min(CASE WHEN ns THEN 'NO INDICATION' ELSE 'LOCATED' END, k) FILTER (ns OR fails OR loc) AS other, min(op) AS open_psi, max(bo) AS breakover_psi, max(isip) AS isip_psi, max(treat) AS max_treat_psi, max(rate) AS max_rate_bpm,
  sum(vol) AS vol_injected_bbl, sum(lbs) AS proppant_lbs_total, sum(fl) AS fluid_vol_bbl, min(report_date) AS fd, max(report_date) AS ld, arg_min(page, k) AS pg, count(*) FILTER (fails AND (ko IS NULL OR k < ko)) AS nf FROM f GROUP BY ALL),
b AS (SELECT w.well_id, w.sleeve_no, a.* EXCLUDE (well_id, sleeve_no), coalesce(CASE WHEN opened THEN 'OPENED' ELSE other END, 'NOT FRACKED') AS s0, coalesce(proppant_lbs_total > 0, false) AS tr FROM (SELECT DISTINCT well_id, unnest(range(1, 19))::INTEGER AS sleeve_no FROM o) w LEFT JOIN a USING (well_id, sleeve_no)),
c AS (SELECT *, CASE WHEN tr THEN 'OPENED' ELSE s0 END AS status FROM b),
d AS (SELECT *, list_filter([CASE WHEN tr AND open_psi IS NULL THEN 'OPENED inferred from proppant injection only — no opening pressure in DDR text' END, CASE WHEN status = 'OPENED' AND open_psi IS NOT NULL AND NOT tr THEN 'Opening pressure recorded but no proppant volume extracted — check DDR for frac design' END,
  CASE WHEN vol_injected_bbl > 20 AND status IN ('NO INDICATION', 'LOCATED') THEN 'Fluid injected (' || CAST(round_even(vol_injected_bbl, 0) AS BIGINT) || ' bbl) but sleeve not confirmed open' END,
  CASE WHEN status = 'LOCATED' AND open_psi IS NULL AND vol_injected_bbl IS NULL THEN 'Packer located but no opening/failure outcome recorded — incomplete DDR coverage' END], lambda v: v IS NOT NULL) AS why FROM c)
SELECT well_id, sleeve_no, status, open_psi, breakover_psi, isip_psi, max_treat_psi, max_rate_bpm, vol_injected_bbl, proppant_lbs_total, fluid_vol_bbl, strftime(fd, '%d/%m/%Y') AS first_date, strftime(ld, '%d/%m/%Y') AS last_date,
  coalesce('DDR-' || CASE WHEN day(fd) % 5 = 0 THEN '?' ELSE CAST(day(fd) AS VARCHAR) END || ' · p.' || pg || ' · ' || fd, '') AS ddr_citation, array_to_string(list_concat(list_transform(range(coalesce(nf, 0)), lambda i: 'packer sealing issue'), CASE WHEN tr AND s0 <> 'OPENED' THEN ['proppant injected — sleeve confirmed open'] ELSE [] END), '; ') AS notes,
  len(why) > 0 AS review_flag, array_to_string(why, ' | ') AS review_reason FROM d""")
def _(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("lineitem")
    ops = s.sql(_SLEEVES)
    nos = ops.select("report_date").distinct().filter(F.dayofmonth("report_date") % 5 != 0).withColumn("report_no", F.dayofmonth("report_date"))
    return sv.sleeve_status(sv.sleeve_folds(ops, nos), ops)


# Orders as retrieved chunks of forty questions, sentences with figures of every kind.
_ASKED = """SELECT q AS query_id, CASE q % 6 WHEN 0 THEN 'What was the budget deficit?' WHEN 1 THEN 'What percentage of posts were staff?' WHEN 2 THEN 'How many pages in the published report?' WHEN 3 THEN 'Total cash requirement for services' WHEN 4 THEN 'What did income amount to?' ELSE 'Spending difference on estates and fleet' END AS question
FROM (SELECT DISTINCT o_orderkey % 40 AS q FROM orders) x"""
_HITS = """SELECT o_orderkey % 40 AS query_id, o_orderkey AS chunk_id, CAST(1 + floor(o_orderkey / 40) % 20 AS INT) AS rank, o_custkey % 7 = 0 AS is_table, CASE CAST(floor(o_orderkey / 40) AS BIGINT) % 11
  WHEN 0 THEN 'The budget variance was a deficit of £' || n || ' million against plan' WHEN 1 THEN 'Staff share rose to ' || n || '.5% of posts; was ' || m || ' percent' WHEN 2 THEN 'Total cash requirement £' || n || ',000 for services' WHEN 3 THEN 'Spending (£000) on estates ' || n || ' and fleet (' || m || ')'
  WHEN 4 THEN 'Report published 2021 with ' || n || ' pages' WHEN 5 THEN 'Retained reserves: reported a surplus of £' || n || 'k, variance surplus' WHEN 6 THEN 'In 2019/20 the rate and 20/2021 no more; then ' || n WHEN 7 THEN '' WHEN 8 THEN 'Income ' || n || ' thousand, cost 1,234,567.80'
  WHEN 9 THEN NULL ELSE 'core revenue resource underspend 12 bn; £000' END AS chunk_text FROM (SELECT *, CAST(o_custkey % 900 AS STRING) AS n, CAST(o_custkey % 90 AS STRING) AS m FROM orders) o"""
_FIGURE = "(?i)(?:£\\s*)?(?:\\(\\s*)?[-+]?\\d[\\d,]*(?:\\.\\d+)?(?:\\s*\\))?(?:\\s*(?:\\((?:£)?000\\)|%|percent(?:age)?|k|m|bn|million|millions|billion|billions|thousand|thousands))?"
_HAS = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_CUES = "list_distinct(list_concat(list_concat(CASE WHEN {b} THEN ['variance', 'surplus', 'deficit', 'overspend', 'underspend', 'budget'] ELSE [] END, CASE WHEN {r} THEN ['deficit', 'surplus', 'overspend', 'shortfall', 'variance'] ELSE [] END), CASE WHEN contains(lq, 'total') THEN ['total', 'cash requirement'] ELSE [] END))".format(
    b=_HAS("lq", ["budget", "spending", "spend", "differ"]), r=_HAS("lq", ["deficit", "surplus"]))
_CANDIDATES = f"""WITH asked AS ({_ASKED}), hits AS ({_HITS}), h AS (SELECT *, string_split_regex(chunk_text, '{_FIGURE}') AS pc, regexp_extract_all(chunk_text, '{_FIGURE}') AS fd FROM hits WHERE chunk_text IS NOT NULL),
u AS (SELECT h.* EXCLUDE (pc, fd), fd[i] AS f, CAST(list_sum(list_transform(pc[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(fd[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM h, LATERAL (SELECT unnest(range(1, len(fd) + 1)) AS i) t),
v AS (SELECT *, trim(f) AS found, substr(chunk_text, greatest(start - 120, 0) + 1, start + length(f) + 120 - greatest(start - 120, 0)) AS context, regexp_replace(substr(chunk_text, greatest(start - 6, 0) + 1, start + length(f) + 6 - greatest(start - 6, 0)), '\\s+', '', 'g') AS tight FROM u),
w AS (SELECT *, lower(context) AS near, lower(found) AS lf FROM v WHERE NOT regexp_matches(tight, '(?:19|20)\\d{{2}}/\\d{{1,2}}|\\d{{1,2}}/(?:19|20)\\d{{2}}') AND regexp_replace(lower(found), '\\s+', '', 'g') NOT IN ('£000', '(000)', '(£000)', '000')),
x AS (SELECT *, CASE WHEN NOT regexp_matches(lf, '£000|\\(000\\)|\\b(million|thousand|bn|m|k)\\b|%|percent') AND (contains(near, '£000') OR contains(near, '(000)')) THEN found || ' (£000)' ELSE found END AS raw FROM w),
y AS (SELECT *, lower(raw) AS lr, TRY_CAST(regexp_extract(replace(raw, ',', ''), '[-+]?\\d+(?:\\.\\d+)?') AS DOUBLE) * CASE WHEN regexp_matches(raw, '^\\(\\d+\\)') THEN -1 ELSE 1 END AS b FROM x),
z AS (SELECT y.*, b * CASE WHEN regexp_matches(lr, '£000|\\(000\\)|thousand|\\dk') THEN 1e3 WHEN regexp_matches(lr, '\\d\\s*m') THEN 1e6 WHEN contains(lr, 'bn') THEN 1e9 ELSE 1 END AS value, CASE WHEN regexp_matches(lr, '%|percent') THEN 'percent' WHEN contains(lr, '£') THEN 'currency' ELSE 'count' END AS dimension, lower(question) AS lq FROM y JOIN asked USING (query_id)),
q AS (SELECT *, CASE WHEN {_HAS("lq", ["percent", "share", "rate"])} THEN 'percent' WHEN {_HAS("lq", ["cost", "spend", "budget", "deficit", "income"])} THEN 'currency' END AS expected, {_CUES} AS cues, {_HAS("lq", ["budget", "spend", "differ"])} AS ab,
  len(list_filter(list_distinct(list_filter(regexp_extract_all(lq, '[a-z][a-z0-9-]{{2,}}'), lambda k: k NOT IN ('what', 'was', 'the', 'were', 'how', 'many', 'report', 'total', 'for', 'did', 'amount', 'difference', 'and'))), lambda k: contains(near, k))) AS kw FROM z),
sc AS (SELECT *, len(list_filter(cues, lambda k: contains(near, k))) AS nc FROM q),
cand AS (SELECT query_id, chunk_id, rank, start, raw, context, expected, dimension, value, round(0::DOUBLE + greatest(0, 3.0 - 0.2 * (rank - 1)) + 0.9 * kw + CASE WHEN expected = dimension AND dimension <> 'count' THEN 1.5 WHEN expected IS NOT NULL THEN -1 ELSE 0 END
  + CASE WHEN nc > 0 THEN 1.1 * nc WHEN {_HAS("near", ["deficit", "surplus", "overspend", "shortfall", "budget", "spend", "income", "cost", "expenditure"])} THEN 0.6 ELSE 0 END
  + CASE WHEN ab AND contains(near, 'variance') AND {_HAS("near", ["surplus", "deficit"])} THEN 2.2 ELSE 0 END + CASE WHEN ab AND contains(near, 'core revenue resource') THEN 0.8 ELSE 0 END + CASE WHEN ab AND {_HAS("near", ["reported a surplus", "retained reserves"])} THEN -2.4 ELSE 0 END
  + CASE WHEN NOT contains(lq, 'total') AND {_HAS("near", ["total", "cash requirement"])} THEN -1.8 ELSE 0 END + CASE WHEN is_table THEN -0.15 ELSE 0 END
  + CASE WHEN regexp_matches(near, '\\d{{4}}\\s*/\\s*\\d{{1,2}}') AND length(regexp_replace(raw, '[^0-9]', '', 'g')) BETWEEN 1 AND 2 THEN -2.5 WHEN regexp_matches(raw, '^(19|20)\\d{{2}}$') THEN -2.0 ELSE 0 END
  + CASE WHEN expected = 'currency' AND abs(value) > 0 AND abs(value) < 100000 THEN -0.8 ELSE 0 END, 6) AS score FROM sc)"""


def _figures_of(s, d):
    table(s, d, "orders").createOrReplaceTempView("orders")
    return s.sql(_ASKED), an.numeric_candidates(s.sql(_ASKED), s.sql(_HITS))


@query("numeric_candidates", "M14", _CANDIDATES + " SELECT query_id, chunk_id, rank, start, raw, expected, dimension, value, score FROM cand")
def _(s, d):
    return _figures_of(s, d)[1].drop("context")


@query("numeric_answers", "M14", _CANDIDATES + """, p AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS k FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id, start) = 1),
r AS (SELECT query_id, coalesce(k, 0) AS candidate_count, CASE WHEN score IS NULL THEN 'no_numeric_candidates' WHEN score < 1.5 THEN 'low_confidence' WHEN expected = 'currency' AND NOT contains(context, '£') AND NOT regexp_matches(raw, '(?i)£|\\b(m|bn|million|billion|thousand)\\b') THEN 'currency_unit_not_supported' ELSE 'selected' END AS reason, p.* EXCLUDE (query_id) FROM asked LEFT JOIN p USING (query_id))
SELECT query_id, candidate_count, reason, score, CASE WHEN reason = 'selected' THEN chunk_id END AS chunk_id, CASE WHEN reason = 'selected' THEN raw END AS raw, CASE WHEN reason = 'selected' THEN value END AS value FROM r""")
def _(s, d):
    return an.numeric_answers(*_figures_of(s, d))[0].drop("canonical")


# Orders as generated answers, in every form that an answer and its citations may take.
_SAID = """SELECT o_orderkey AS query_id, CASE o_custkey % 11 WHEN 10 THEN 'timeout' WHEN 9 THEN NULL ELSE ' OK ' END AS raw_status, o_orderkey % 13 > 0 AS requested, CASE o_orderkey % 16
  WHEN 0 THEN 'Rose by 4 [chunk_id=' || c || ', page=' || p || '] and [chunk_id: other; pages=3]' WHEN 1 THEN 'See (chunk_id: ' || c || ', page: ' || p || ') or chunk_id=' || c || ' page=' || p WHEN 2 THEN '{"answer": "It rose", "citations": [{"chunk_id": "' || c || '", "page": ' || p || '}, {"chunk": "' || c || '", "page_no": "9"}]}'
  WHEN 3 THEN '```json ' || chr(10) || '{"answer": "Fenced", "citations": ["[chunk_id=' || c || ', page=' || p || ']", 5]} ```' WHEN 4 THEN '{"answer": null, "citations": []}' WHEN 5 THEN 'Insufficient evidence in retrieved context.' WHEN 6 THEN '  ' WHEN 7 THEN NULL
  WHEN 8 THEN '{"answer": "Pages", "citations": [{"chunk_id": "' || c || '", "pages": [' || p || ', 99]}, {"chunk_id": "", "page": 1}, {"chunk_id": "x", "page": "two"}]}' WHEN 9 THEN '[1, 2] chunk_id=' || c || '; page=' || p WHEN 10 THEN '{"answer": "none cited"} chunk_id=' || c || ', page=' || p
  WHEN 11 THEN '{"answer": "text cites chunk_id=' || c || ' page=' || p || '", "citations": []}' ELSE 'no citation at all' END AS raw_answer FROM (SELECT *, 'doc:c' || CAST(o_orderkey % 9 AS STRING) AS c, CAST(o_orderkey % 5 + o_custkey % 3 AS STRING) AS p FROM orders) o"""


@query("answer_outcomes", "M18 D20", f"""WITH a AS (SELECT *, trim(coalesce(raw_answer, '')) AS t, 'doc:c' || CAST(query_id % 9 AS VARCHAR) AS own FROM ({_SAID})),
b AS (SELECT *, CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT' THEN t WHEN json_valid(regexp_extract(t, '```json\\s*(\\{{.*\\}})\\s*```', 1, 's')) THEN regexp_extract(t, '```json\\s*(\\{{.*\\}})\\s*```', 1, 's') END AS j FROM a),
w AS (SELECT query_id, list_distinct(list_transform(regexp_extract_all(t, 'chunk_id\\s*[:=]\\s*[^,; \\]\\)]+[,; ]+pages?\\s*[:=]\\s*\\d+'), lambda m: regexp_extract(m, '[:=]\\s*([^,; ]+)', 1) || '#' || regexp_extract(m, '(\\d+)$', 1))) AS ws FROM b),
i AS (SELECT query_id, unnest(json_extract(j, '$.citations[*]')) AS it FROM b WHERE j IS NOT NULL),
k AS (SELECT query_id, CASE WHEN json_type(it) = 'VARCHAR' THEN regexp_replace(it ->> '$', '^.chunk_id=(.*), page=(\\d+).$', '\\1#\\2') ELSE nullif(coalesce(nullif(it ->> '$.chunk_id', ''), it ->> '$.chunk', ''), '') || '#' || CAST(TRY_CAST(coalesce(it ->> '$.page', it ->> '$.page_no', it ->> '$.pages[0]') AS BIGINT) AS VARCHAR) END AS s FROM i WHERE json_type(it) IN ('OBJECT', 'VARCHAR')),
l AS (SELECT query_id, list(s) AS ls FROM k WHERE s IS NOT NULL GROUP BY 1),
c AS (SELECT b.*, CASE WHEN len(l.ls) > 0 THEN l.ls ELSE w.ws END AS cs, CASE WHEN t = '' THEN 'empty' WHEN j IS NOT NULL THEN 'json' ELSE 'text_fallback' END AS parse_mode, CASE WHEN j IS NOT NULL THEN trim(j ->> '$.answer') ELSE nullif(t, '') END AS ans FROM b JOIN w USING (query_id) LEFT JOIN l USING (query_id)),
d AS (SELECT *, list_filter(cs, lambda x: x = own || '#' || CAST(query_id % 5 AS VARCHAR) OR x = own || '#' || CAST(query_id % 5 + 1 AS VARCHAR)) AS good FROM c),
e AS (SELECT *, CASE WHEN NOT requested THEN 'skipped' WHEN coalesce(lower(trim(raw_status)), '') <> 'ok' OR coalesce(ans, '') = '' THEN coalesce(lower(trim(raw_status)), 'error') WHEN lower(ans) LIKE 'insufficient evidence%' OR len(good) = 0 THEN 'insufficient_evidence' ELSE 'ok' END AS status FROM d)
SELECT query_id, status, CASE WHEN status = 'ok' THEN ans END AS answer, CASE WHEN status = 'ok' THEN array_to_string(list_sort(good), ' ') ELSE '' END AS citations, CASE WHEN status = 'ok' AND len(good) > 0 THEN len(good) / greatest(len(cs), 1) END AS confidence,
  CAST(len(cs) AS INTEGER) AS citations_parsed, len(good) AS citations_valid, len(cs) - len(good) AS citations_rejected, parse_mode FROM e""")
def _(s, d):
    table(s, d, "orders").createOrReplaceTempView("orders")
    said = s.sql(_SAID)
    page = (F.col("query_id") % 5).cast("int")
    chunk = lambda n: F.concat(F.lit("doc:c"), (F.col("query_id") % 9 + n).cast("string"))
    found = said.select("query_id", F.lit(1).alias("rank"), chunk(0).alias("chunk_id"), F.array(page, page + 1).alias("pages")).unionByName(
        said.select("query_id", F.lit(2).alias("rank"), chunk(20).alias("chunk_id"), F.array(F.lit(7)).alias("pages")))
    return ci.answer_outcomes(said, found)


# Orders as tables of four to a page: section titles, header rows (some of one column only), data rows, blank rows.
SECTION_WORDS = {"casing": ["CASING STRINGS", "CASING DATA"], "mud": ["MUD DATA"], "crew": ["PERSONNEL"]}
SECTION_COLUMNS = {
    "casing": {"size": ["size", "od"], "depth": ["depth"], "grade": ["^grade$"]}, "mud": {"weight": ["weight", "density"], "type": ["type"]}, "crew": {"company": ["company"], "count": ["count", "no."]}}
_WELLCELLS = """SELECT 'R' || CAST(CAST(floor(l_orderkey / 20) AS BIGINT) AS STRING) AS doc_id, CAST(floor((l_orderkey % 20) / 4) AS INT) AS page, CAST(l_orderkey % 4 AS INT) AS table_no, CAST(n AS INT) AS row_no,
  CASE l_partkey % 12 WHEN 0 THEN 'Casing Strings' WHEN 1 THEN ' MUD DATA (last)' WHEN 2 THEN 'Size' || chr(10) || CAST(l_suppkey AS STRING) WHEN 3 THEN 'Weight' WHEN 4 THEN 'Company' WHEN 5 THEN NULL WHEN 6 THEN 'personnel on board' WHEN 7 THEN 'OD in depth' ELSE 'row ' || CAST(l_partkey AS STRING) END AS c0,
  CASE l_partkey % 12 WHEN 2 THEN 'Set depth' WHEN 3 THEN 'Mud type' || chr(10) || 'OBM' WHEN 4 THEN 'No. of people' WHEN 7 THEN 'Size ' WHEN 0 THEN '' WHEN 8 THEN 'see the mud data of the day before' WHEN 9 THEN NULL ELSE 'b' || chr(10) || ' c ' || CAST(l_suppkey % 10 AS STRING) END AS c1,
  CASE WHEN l_partkey % 12 = 5 THEN ' ' WHEN l_partkey % 24 = 2 THEN 'Grade' WHEN l_partkey % 12 = 2 THEN 'Grades' ELSE CAST(l_suppkey % 7 AS STRING) END AS c2
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) l"""
_LOCATED = f"""WITH wc AS ({_WELLCELLS}), f AS (SELECT *, list_filter([trim(coalesce(c0, '')), trim(coalesce(c1, '')), trim(coalesce(c2, ''))], lambda x: x <> '') AS r FROM wc),
g AS (SELECT *, upper(array_to_string(r, ' ')) AS line, upper(r[1]) AS head FROM f WHERE len(r) > 0),
w(section, kw) AS (VALUES ('casing', 'CASING STRINGS'), ('casing', 'CASING DATA'), ('mud', 'MUD DATA'), ('crew', 'PERSONNEL')),
s AS (SELECT doc_id, page, table_no, section, min(row_no) AS start_row FROM g, w WHERE contains(line, kw) AND (NOT {{strict}} OR starts_with(head, kw) OR length(head) < length(kw) + 20) GROUP BY ALL),
e AS (SELECT DISTINCT doc_id, page, table_no, row_no AS stop FROM g, w WHERE starts_with(head, kw)),
loc AS (SELECT s.*, min(stop) AS end_row FROM s LEFT JOIN e ON s.doc_id = e.doc_id AND s.page = e.page AND s.table_no = e.table_no AND stop > start_row GROUP BY ALL)"""
_HEADS = _LOCATED.format(strict="true") + """, i AS (SELECT loc.*, row_no, c0, c1, c2, lower(split_part(trim(c0), chr(10), 1)) AS a, lower(split_part(trim(c1), chr(10), 1)) AS b, lower(split_part(trim(c2), chr(10), 1)) AS c FROM loc JOIN wc USING (doc_id, page, table_no) WHERE row_no > start_row AND (end_row IS NULL OR row_no < end_row)),
m AS (SELECT *, CASE section WHEN 'casing' THEN CASE WHEN starts_with(a, 'size') THEN [1, 2, CASE WHEN c = 'grade' THEN 3 END] WHEN starts_with(a, 'od in') THEN [1, NULL, NULL] END WHEN 'mud' THEN CASE WHEN a = 'weight' THEN [1, 2] END ELSE CASE WHEN a = 'company' THEN [1, 2] END END AS found FROM i),
h AS (SELECT doc_id, page, table_no, section, start_row, end_row, min(row_no) AS header_row, arg_min(found, row_no) AS pos FROM m WHERE len(list_filter(found, lambda x: x IS NOT NULL)) >= 2 GROUP BY ALL)"""


def _wellcells(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("lineitem")
    return s.sql(_WELLCELLS).select("doc_id", "page", "table_no", "row_no", F.array("c0", "c1", "c2").alias("cells"))


for _name, _strict in (("sections_strict", True), ("sections_loose", False)):
    query(_name, "G15", _LOCATED.format(strict=str(_strict).lower()) + " SELECT * FROM loc")(
        lambda s, d, strict=_strict: ws.locate_sections(_wellcells(s, d), SECTION_WORDS, strict))


@query("section_cells", "G15 G16", _HEADS + """, k AS (SELECT h.*, unnest(CASE section WHEN 'casing' THEN ['size', 'depth', 'grade'] WHEN 'mud' THEN ['weight', 'type'] ELSE ['company', 'count'] END) AS "column", unnest(pos) AS spot FROM h WHERE header_row IS NOT NULL),
v AS (SELECT k.*, row_no, string_split(trim(coalesce([c0, c1, c2][spot], '')), chr(10)) AS ls FROM k JOIN wc USING (doc_id, page, table_no) WHERE spot IS NOT NULL AND row_no > header_row AND (end_row IS NULL OR row_no < end_row))
SELECT doc_id, page, table_no, section, row_no, "column", CASE WHEN len(ls) > 1 THEN array_to_string(list_filter(list_transform(ls[2:], lambda x: trim(x)), lambda x: x <> ''), ' ') ELSE ls[1] END AS value FROM v""")
def _(s, d):
    rows = _wellcells(s, d)
    heads = ws.section_headers(rows, ws.locate_sections(rows, SECTION_WORDS, True), SECTION_COLUMNS)
    return ws.section_cells(rows, heads)
