"""Queries over operation rows, headers and weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook import dims
from fieldbook.functions import npt
from fieldbook.operators import hours, ordered, quantiles, weather
from fieldbook.plans import oracle as o
from fieldbook.plans.registry import query
from fieldbook.plans.views import view

RULE = npt.CorpusRule(doc_pattern=r"^W[01]-DDR-", well_pattern=r"^W[01]$", field="none")
DEC = 6


def enr(spark, d):
    return hours.load_ops(view(spark, d, "ops", spread=True), RULE)


def phase_dim(spark):
    return spark.createDataFrame([(f"P{i}", i, f"Phase {i}") for i in range(1, 7)], "phase string, ord int, label string")


PH = "phd AS (SELECT 'P' || i AS phase, i::INTEGER AS ord, 'Phase ' || i AS label FROM range(1, 7) t(i))"


def auto6(df, places=DEC):
    """Round double columns for comparison."""
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.select(*[F.round(c, places).alias(c) if c in doubles else F.col(c) for c in df.columns])


def R(*names):
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


@query("scan_sorted_ops", "A1 S2", f"WITH {{ops}} SELECT doc_id, seq, phase, round({o.HOUR('start_time')}, 6) AS report_hour FROM ops")
def _(s, d):
    return auto6(hours.sorted_corpus(view(s, d, "ops")).select("doc_id", "seq", "phase", "report_hour"))


@query("scan_headers_typed", "A2 C11", f"WITH {o.TH} SELECT doc_id, report_no, daily_cost_num, cum_cost_num, end_depth_num FROM th")
def _(s, d):
    return hours.typed_headers(view(s, d, "headers")).select("doc_id", "report_no", "daily_cost_num", "cum_cost_num", "end_depth_num")


@query("scan_ops_classified", "A3 H3 H4 H5 H6", f"WITH {o.ENR} SELECT seq, well_id, is_npt, npt_category, npt_cat_label, round(report_hour, 6) AS report_hour FROM enr")
def _(s, d):
    return auto6(enr(s, d).select("seq", "well_id", "is_npt", "npt_category", "npt_cat_label", "report_hour"))


@query("scan_headers_pruned", "A4", "WITH {headers} SELECT report_date, report_no FROM headers")
def _(s, d):
    return view(s, d, "headers").select("report_date", "report_no")


@query("npt_narrative_class", "H1", f"WITH {{ops}}, x AS (SELECT seq, {o.narrative('operation_text', 'op_code', 'activity_code', 'pt_x')} AS category FROM ops) SELECT seq, category <> 'productive' AS is_npt, category FROM x")
def _(s, d):
    c = F.col
    f = npt.classify_narrative(c("operation_text"), c("op_code"), c("activity_code"), c("pt_x"))
    return view(s, d, "ops").select("seq", f.alias("f")).select("seq", "f.is_npt", "f.category")


@query("npt_category_rules", "H2", f"WITH {{ops}} SELECT seq, {o.category('operation_text', 'op_code', 'activity_code')} AS category FROM ops")
def _(s, d):
    c = F.col
    return view(s, d, "ops").select("seq", npt.category(c("operation_text"), c("op_code"), c("activity_code")).alias("category"))


@query("phase_timeline", "N39 E1 E2 M25", f"""WITH {o.ENR}, {PH},
g AS (SELECT well_id, phase, min(report_date) AS date_start, max(report_date) AS date_end, count(DISTINCT report_date) AS n_days, count(*) AS n_ops,
  sum(duration_hr) AS t, sum(CASE WHEN is_npt THEN duration_hr ELSE 0 END) AS n FROM enr GROUP BY 1, 2)
SELECT well_id, g.phase, ord, label, date_start, date_end, n_days, n_ops, round_even(t, 1) AS total_hrs, round_even(n, 1) AS npt_hrs,
  CASE WHEN t <> 0 THEN round_even(100 * n / t, 1) ELSE 0 END AS npt_pct FROM g JOIN phd USING (phase)""")
def _(s, d):
    return hours.phase_timeline(enr(s, d), phase_dim(s))


@query("daily_npt", "N10", f"WITH {o.ENR}{o.DAILY} SELECT well_id, report_date, {R('total_h', 'npt_h', 'npt_pct')} FROM dnpt")
def _(s, d):
    return auto6(hours.daily_npt(enr(s, d)))


@query("phase_date_ranges", "E23", "WITH {ops} SELECT well_id, phase, min(report_date) AS d0, max(report_date) AS d1 FROM ops GROUP BY 1, 2")
def _(s, d):
    return hours.date_ranges(view(s, d, "ops"))


@query("dominant_op_code", "E4", """WITH {ops}, g AS (SELECT well_id, report_date, op_code, sum(duration_hr) AS h FROM ops GROUP BY 1, 2, 3)
SELECT well_id, report_date, op_code AS dominant_op FROM g QUALIFY row_number() OVER (PARTITION BY well_id, report_date ORDER BY h DESC, op_code) = 1""")
def _(s, d):
    return hours.dominant(view(s, d, "ops"), ["well_id", "report_date"], "op_code", "dominant_op")


@query("mode_phase_per_day", "E3 S16", """WITH {ops}, g AS (SELECT well_id, report_date, activity_code, count(*) AS n FROM ops GROUP BY 1, 2, 3)
SELECT well_id, report_date, activity_code AS top_code FROM g QUALIFY row_number() OVER (PARTITION BY well_id, report_date ORDER BY n DESC, activity_code) = 1""")
def _(s, d):
    return hours.mode_by(view(s, d, "ops"), ["well_id", "report_date"], "activity_code", "top_code")


@query("operation_blocks", "N9 E13", f"WITH {o.BLOCKS} SELECT well_id, report_date, block, step, phase, op_code, npt_category, description, n_ops, {R('total_h', 'npt_h', 'npt_pct')} FROM steps")
def _(s, d):
    return auto6(hours.blocks(enr(s, d)).select("well_id", "report_date", "block", "step", "phase", "op_code", "npt_category", "description", "n_ops", "total_h", "npt_h", "npt_pct"))


@query("step_filter", "B7", f"""WITH {o.BLOCKS} SELECT well_id, step, phase, npt_category, round(total_h, 6) AS total_h FROM steps
WHERE npt_pct >= 50 AND total_h >= 0.5 AND npt_category IN ('equipment', 'fishing') AND npt_h > 0 AND report_date <= DATE '2024-01-20' AND report_date >= DATE '2024-01-05'""")
def _(s, d):
    return auto6(hours.step_filter(hours.blocks(enr(s, d)), min_pct=50, min_hours=0.5, categories=["equipment", "fishing"],
                                   npt_only=True, d0="2024-01-05", d1="2024-01-20").select("well_id", "step", "phase", "npt_category", "total_h"))


@query("step_root_causes", "H8 C46", f"""WITH {o.BLOCKS},
k AS (SELECT *, CASE WHEN npt_category = 'equipment' AND {o.subtype('description')} <> 'Unspecified' THEN 'equipment:' || {o.subtype('description')} ELSE npt_category END AS root_cause FROM steps)
SELECT well_id, step, root_cause, root_cause <> '' AND count(*) OVER (PARTITION BY well_id, root_cause) >= 2 AS repeat FROM k""")
def _(s, d):
    return hours.repeat_causes(hours.blocks(enr(s, d))).select("well_id", "step", "root_cause", "repeat")


@query("npt_streaks", "N13 E15 D11", f"""WITH {o.BLOCKS},
r0 AS (SELECT *, sum(CASE WHEN npt_pct > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY well_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM steps),
r1 AS (SELECT well_id, run, min(step) AS step_first, max(step) AS step_last, count(*) AS n_steps, sum(npt_h) AS npt_h, sum(total_h) AS total_h,
  min(report_date) AS d0, max(report_date) AS d1, arg_min(phase, step) AS phase FROM r0 WHERE npt_pct > 50 GROUP BY 1, 2 HAVING count(*) >= 2),
c0 AS (SELECT r1.well_id, run, e.npt_category, sum(duration_hr) AS h FROM r1 JOIN enr e ON e.well_id = r1.well_id AND e.report_date BETWEEN d0 AND d1 WHERE e.is_npt GROUP BY 1, 2, 3),
c1 AS (SELECT well_id, run, npt_category AS cause FROM c0 QUALIFY row_number() OVER (PARTITION BY well_id, run ORDER BY h DESC, npt_category) = 1)
SELECT r1.well_id, step_first, step_last, n_steps, {R('npt_h', 'total_h')}, d0, d1, phase, cause FROM r1 LEFT JOIN c1 USING (well_id, run)""")
def _(s, d):
    e = ordered.stored(enr(s, d).select("well_id", "report_date", "report_hour", "seq", "phase", "op_code", "npt_category", "is_npt", "duration_hr", "operation_text"))
    return auto6(hours.npt_streaks(hours.blocks(e), e))


@query("depth_progress", "N21 E9 E24", f"""WITH {o.TH}{o.DEPTH},
x AS (SELECT *, depth_ft - lag(depth_ft) OVER (PARTITION BY well_id ORDER BY report_date) AS depth_delta, row_number() OVER (PARTITION BY well_id ORDER BY report_date) AS rn FROM dd)
SELECT well_id, report_date, depth_ft, report_type, depth_delta, coalesce(greatest(depth_delta, 0), 0)::DOUBLE AS advance_ft,
 coalesce(greatest(depth_delta, 0), 0) > 0.1 AS is_advance, coalesce(depth_delta, 0) <= 0.1 AND rn > 1 AS is_hold FROM x""")
def _(s, d):
    return hours.depth_progress(view(s, d, "headers"))


@query("flat_days", "D4", f"WITH {o.ENR}, {o.TH}{o.DAILY}{o.FLAT} SELECT well_id, report_date, depth_ft, depth_delta, round(npt_pct, 6) AS npt_pct FROM fl")
def _(s, d):
    return auto6(hours.flat_days(view(s, d, "headers"), enr(s, d)).select("well_id", "report_date", "depth_ft", "depth_delta", "npt_pct"))


_LIST = lambda xs: "(" + ", ".join(o.q(x) for x in xs) + ")"
_FLATB = f""",
dom0 AS (SELECT well_id, report_date, op_code, sum(duration_hr) AS h FROM enr GROUP BY 1, 2, 3),
dom AS (SELECT well_id, report_date, op_code AS dominant_op FROM dom0 QUALIFY row_number() OVER (PARTITION BY well_id, report_date ORDER BY h DESC, op_code) = 1),
fb AS (SELECT well_id, report_date, npt_pct, dominant_op, total_h, CASE WHEN npt_pct > 50 THEN 'NPT' WHEN trim(dominant_op) IN {_LIST(dims.FLAT_EXPECTED)} THEN {o.q(dims.FLAT_BUCKETS[0])}
  WHEN trim(dominant_op) IN {_LIST(dims.FLAT_SUPPORT)} THEN {o.q(dims.FLAT_BUCKETS[1])} ELSE {o.q(dims.FLAT_BUCKETS[2])} END AS bucket
  FROM fl LEFT JOIN dom USING (well_id, report_date) LEFT JOIN daily USING (well_id, report_date) WHERE npt_pct IS NOT NULL)"""


@query("flat_day_classes", "N11 N50", f"WITH {o.ENR}, {o.TH}{o.DAILY}{o.FLAT}{_FLATB} SELECT well_id, report_date, dominant_op, bucket, round(total_h, 6) AS total_h FROM fb")
def _(s, d):
    return auto6(hours.flat_day_classes(view(s, d, "headers"), enr(s, d)).select("well_id", "report_date", "dominant_op", "bucket", "total_h"))


@query("flat_reconciliation", "N50", f"WITH {o.ENR}, {o.TH}{o.DAILY}{o.FLAT}{_FLATB} SELECT well_id, bucket, count(*) AS n_days FROM fb GROUP BY 1, 2")
def _(s, d):
    return hours.flat_reconciliation(view(s, d, "headers"), enr(s, d))


@query("flat_sections", "N12 E14 C47 D11", f"""WITH {o.ENR}, {o.TH}{o.DAILY}{o.FLAT},
g0 AS (SELECT *, CASE WHEN report_date - lag(report_date) OVER (PARTITION BY well_id ORDER BY report_date) > 1 THEN 1 ELSE 0 END AS g FROM fl),
g1 AS (SELECT *, sum(g) OVER (PARTITION BY well_id ORDER BY report_date ROWS UNBOUNDED PRECEDING) AS run FROM g0),
se AS (SELECT well_id, run, min(report_date) AS d0, max(report_date) AS d1, avg(npt_pct) AS mean_npt, avg(depth_ft) AS mean_depth FROM g1 GROUP BY 1, 2 HAVING max(report_date) - min(report_date) >= 1),
ix AS (SELECT se.well_id, run, op_code, npt_category, is_npt, duration_hr FROM se JOIN enr e ON e.well_id = se.well_id AND report_date BETWEEN d0 AND d1),
a AS (SELECT well_id, run, op_code, sum(duration_hr) AS h FROM ix GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY well_id, run ORDER BY sum(duration_hr) DESC, op_code) = 1),
b AS (SELECT well_id, run, npt_category, sum(duration_hr) AS h FROM ix WHERE is_npt GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY well_id, run ORDER BY sum(duration_hr) DESC, npt_category) = 1)
SELECT se.well_id, d0, d1, (d1 - d0 + 1)::INTEGER AS n_days, round(mean_depth, 6) AS mean_depth,
 CASE WHEN mean_npt > 50 THEN coalesce('NPT — ' || {o.label('b.npt_category')}, 'NPT event') WHEN trim(a.op_code) IN {_LIST(dims.FLAT_EXPECTED + dims.FLAT_SUPPORT)} THEN trim(a.op_code) ELSE 'No depth gain — needs review' END AS label
FROM se LEFT JOIN a USING (well_id, run) LEFT JOIN b USING (well_id, run)""")
def _(s, d):
    return auto6(hours.flat_sections(view(s, d, "headers"), enr(s, d)))


@query("unflagged_flat_time", "N16 D17", f"""WITH {o.ENR}, {o.TH}{o.DAILY}{o.FLAT}, fd AS (SELECT * FROM fl WHERE npt_pct <= 50)
SELECT well_id, count(*) AS n_days, round(coalesce(max(hh), 0), 6) AS hours FROM fd LEFT JOIN
 (SELECT well_id, sum(duration_hr) AS hh FROM enr SEMI JOIN fd USING (well_id, report_date) WHERE NOT is_npt GROUP BY 1) USING (well_id) GROUP BY 1""")
def _(s, d):
    return auto6(hours.unflagged_flat_time(view(s, d, "headers"), enr(s, d)))


@query("depth_reference", "N56", f"""WITH {o.TH}{o.DEPTH}, e AS (SELECT well_id, min(report_date) d0, max(report_date) d1, arg_min(depth_ft, report_date) z0, arg_max(depth_ft, report_date) z1 FROM dd GROUP BY 1)
SELECT well_id, report_date, depth_ft, round(z0 + (z1 - z0) * CASE WHEN d1 > d0 THEN (report_date - d0) / (d1 - d0) ELSE 0 END, 6) AS reference_ft FROM dd JOIN e USING (well_id)""")
def _(s, d):
    return auto6(hours.depth_reference(view(s, d, "headers")))


_KPI = """,
ko AS (SELECT well_id, count(DISTINCT report_date) AS n_days, sum(duration_hr) AS total_h, sum(CASE WHEN is_npt THEN duration_hr ELSE 0 END) AS npt_h FROM enr GROUP BY 1),
kh AS (SELECT well_id, coalesce(max(end_depth_num), 0) AS max_depth, coalesce(max(cum_cost_num), 0) AS cost, count(DISTINCT report_date) AS n_reports FROM th GROUP BY 1),
kp AS (SELECT *, CASE WHEN total_h <> 0 THEN 100 * npt_h / total_h ELSE 0 END AS npt_pct FROM ko LEFT JOIN kh USING (well_id))"""


@query("campaign_kpis", "N2", f"WITH {o.ENR}, {o.TH}{_KPI} SELECT well_id, n_days, n_reports, max_depth, cost, {R('total_h', 'npt_h', 'npt_pct')} FROM kp")
def _(s, d):
    return auto6(hours.campaign_kpis(enr(s, d), view(s, d, "headers")))


_PH = """,
ph AS (SELECT well_id, phase, sum(duration_hr) AS total_h, sum(CASE WHEN is_npt THEN duration_hr ELSE 0 END) AS npt_h FROM enr GROUP BY 1, 2)"""


@query("phase_performance", "N4", f"WITH {o.ENR}{_PH} SELECT well_id, phase, {R('total_h', 'npt_h')}, round(total_h - npt_h, 6) AS prod_h, round_even(100 * npt_h / greatest(total_h, 1), 1) AS npt_pct FROM ph")
def _(s, d):
    return auto6(hours.phase_performance(enr(s, d)))


@query("superintendent_takeaways", "N3", f"""WITH {o.ENR}{_PH},
c AS (SELECT well_id, npt_cat_label AS cause, sum(duration_hr) AS cause_h FROM enr WHERE is_npt GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY sum(duration_hr) DESC, npt_cat_label) = 1),
e AS (SELECT well_id, operation_text AS event_text, duration_hr AS event_h, report_date AS event_date FROM enr WHERE is_npt QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY duration_hr DESC, seq) = 1),
r AS (SELECT well_id, phase AS risk_phase, 100 * npt_h / total_h AS risk_pct FROM ph WHERE total_h >= 24 QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY 100 * npt_h / total_h DESC, phase) = 1),
s0 AS (SELECT well_id, {o.subtype('operation_text')} AS issue, duration_hr FROM enr WHERE is_npt AND npt_category = 'equipment'),
s1 AS (SELECT well_id, issue, sum(duration_hr) AS issue_h, count(*) AS issue_n FROM s0 WHERE issue <> 'Unspecified' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY sum(duration_hr) DESC, issue) = 1)
SELECT c.well_id, cause, round(cause_h, 6) AS cause_h, event_text, round(event_h, 6) AS event_h, event_date, risk_phase, round(risk_pct, 6) AS risk_pct, issue, round(issue_h, 6) AS issue_h, issue_n
FROM c LEFT JOIN e USING (well_id) LEFT JOIN r USING (well_id) LEFT JOIN (SELECT * FROM s1 WHERE issue_n >= 2) s USING (well_id)""")
def _(s, d):
    return auto6(hours.takeaways(enr(s, d)))


@query("equipment_repeats", "H7", f"""WITH {o.ENR}, x AS (SELECT well_id, {o.subtype('operation_text')} AS subtype, duration_hr FROM enr WHERE is_npt AND npt_category = 'equipment')
SELECT well_id, subtype, round(sum(duration_hr), 6) AS hours, count(*) AS n_events FROM x WHERE subtype <> 'Unspecified' GROUP BY 1, 2""")
def _(s, d):
    return auto6(hours.equipment_repeats(enr(s, d)))


@query("top_causes", "N5 E17", f"""WITH {o.ENR}, g AS (SELECT well_id, npt_cat_label, sum(duration_hr) AS hours FROM enr WHERE is_npt GROUP BY 1, 2)
SELECT well_id, npt_cat_label, round(hours, 6) AS hours, (row_number() OVER w)::INTEGER AS rank, round(100 * hours / sum(hours) OVER (PARTITION BY well_id), 6) AS share_pct FROM g
WINDOW w AS (PARTITION BY well_id ORDER BY hours DESC, npt_cat_label) QUALIFY row_number() OVER w <= 5""")
def _(s, d):
    return auto6(hours.top_causes(enr(s, d)))


@query("major_npt_days", "N6", f"""WITH {o.ENR}, g AS (SELECT well_id, report_date, phase, npt_cat_label, sum(duration_hr) AS hours FROM enr WHERE is_npt GROUP BY 1, 2, 3, 4)
SELECT well_id, report_date, phase, npt_cat_label, round(hours, 6) AS hours, (row_number() OVER w)::INTEGER AS rank FROM g WINDOW w AS (PARTITION BY well_id ORDER BY hours DESC, report_date, npt_cat_label) QUALIFY row_number() OVER w <= 8""")
def _(s, d):
    return auto6(hours.major_days(enr(s, d)))


@query("compare_wells", "N7", f"""WITH {o.ENR}, {o.TH}{_KPI}{_PH},
s AS (SELECT a.phase AS best_phase, a.npt_h - b.npt_h AS best_save_h FROM ph a JOIN ph b ON a.phase = b.phase AND a.well_id = 'W0' AND b.well_id = 'W2' WHERE a.npt_h > b.npt_h ORDER BY 2 DESC, 1 LIMIT 1)
SELECT a.n_reports AS n_reports_1, round(a.total_h, 6) AS total_h_1, round(a.npt_h, 6) AS npt_h_1, round(a.npt_pct, 6) AS npt_pct_1, a.cost AS cost_1,
 b.n_reports AS n_reports_2, round(b.total_h, 6) AS total_h_2, round(b.npt_h, 6) AS npt_h_2, round(b.npt_pct, 6) AS npt_pct_2, b.cost AS cost_2,
 best_phase, round(best_save_h, 6) AS best_save_h, a.n_reports - b.n_reports AS days_delta, a.cost - b.cost AS cost_delta, round(a.npt_pct - b.npt_pct, 6) AS npt_delta
FROM kp a JOIN kp b ON a.well_id = 'W0' AND b.well_id = 'W2' CROSS JOIN s""")
def _(s, d):
    return auto6(hours.compare_wells(enr(s, d), view(s, d, "headers"), "W0", "W2"))


@query("phase_by_well", "N7 E7", f"""WITH {o.ENR}{_PH}, p AS (SELECT *, round_even(100 * npt_h / greatest(total_h, 1), 1) AS p FROM ph)
SELECT phase, coalesce(max(CASE WHEN well_id = 'W0' THEN p END), 0) AS "W0", coalesce(max(CASE WHEN well_id = 'W2' THEN p END), 0) AS "W2" FROM p WHERE well_id IN ('W0', 'W2') GROUP BY 1""")
def _(s, d):
    return hours.phase_by_well(enr(s, d), ["W0", "W2"])


@query("cause_comparison", "N7", f"""WITH {o.ENR}, g AS (SELECT npt_category, sum(CASE WHEN well_id = 'W0' THEN duration_hr ELSE 0 END) AS h1, sum(CASE WHEN well_id = 'W2' THEN duration_hr ELSE 0 END) AS h2 FROM enr WHERE is_npt AND well_id IN ('W0', 'W2') GROUP BY 1)
SELECT {o.label('npt_category')} AS cause, {R('h1', 'h2')}, CASE WHEN h1 > 5 AND h2 > 5 THEN 'recurring' WHEN h1 > 5 THEN 'resolved' WHEN h2 > 5 THEN 'new' END AS status FROM g WHERE h1 >= 5 OR h2 >= 5""")
def _(s, d):
    return auto6(hours.cause_comparison(enr(s, d), "W0", "W2"))


_ROLL = """,
rr0 AS (SELECT well_id, report_date, avg(is_npt::INT) AS rate FROM enr GROUP BY 1, 2),
rr AS (SELECT *, CASE WHEN count(rate) OVER w >= 3 THEN avg(rate) OVER w END AS rolling FROM rr0 WINDOW w AS (PARTITION BY well_id ORDER BY report_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


@query("rolling_npt_rate", "E11 S19", f"WITH {o.ENR}{_ROLL} SELECT well_id, report_date, {R('rate', 'rolling')} FROM rr")
def _(s, d):
    return auto6(hours.rolling_rate(enr(s, d)))


@query("narrative_metrics", "N8", f"""WITH {o.ENR}, {o.TH}{_KPI}{_PH}{_ROLL},
pp AS (SELECT *, 100 * npt_h / CASE WHEN total_h = 0 THEN 1 ELSE total_h END AS p FROM ph),
w AS (SELECT well_id, phase AS worst_phase, npt_h AS worst_h FROM pp QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY npt_h DESC, phase) = 1),
dm AS (SELECT well_id, phase AS dominant_phase, total_h AS dominant_h FROM pp QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY total_h DESC, phase) = 1),
bs AS (SELECT well_id, phase AS best_phase, p AS best_pct FROM pp WHERE total_h > 100 QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY p, phase) = 1),
u AS (SELECT e.well_id, npt_category, sum(duration_hr) AS h FROM enr e JOIN w ON e.well_id = w.well_id AND e.phase = w.worst_phase WHERE is_npt AND npt_category NOT IN {_LIST(dims.PROGRAMME_CATEGORIES)} GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY e.well_id ORDER BY sum(duration_hr) DESC, npt_category) = 1),
br AS (SELECT well_id, report_date AS best_date, rolling AS best_rate FROM rr WHERE rolling IS NOT NULL QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY rolling, report_date) = 1)
SELECT w.well_id, worst_phase, round(worst_h, 6) AS worst_h, dominant_phase, round(dominant_h, 6) AS dominant_h, best_phase, round(best_pct, 6) AS best_pct,
 {o.label('u.npt_category')} AS primary_cause, round(u.h, 6) AS primary_cause_h, best_date, round(best_rate, 6) AS best_rate, n_days, max_depth
FROM w JOIN dm USING (well_id) LEFT JOIN bs USING (well_id) LEFT JOIN u USING (well_id) LEFT JOIN br USING (well_id) LEFT JOIN kp USING (well_id)""")
def _(s, d):
    return auto6(hours.narrative_metrics(enr(s, d), view(s, d, "headers")))


@query("time_sinks", "N14 E17", f"""WITH {o.ENR} SELECT well_id, seq, report_date, phase, activity_code, duration_hr, npt_cat_label, (row_number() OVER w)::INTEGER AS rank,
 round(100 * duration_hr / sum(duration_hr) OVER (PARTITION BY well_id), 6) AS share_pct, row_number() OVER w <= 3 AS recoverable FROM enr WHERE is_npt
 WINDOW w AS (PARTITION BY well_id ORDER BY duration_hr DESC, seq) QUALIFY row_number() OVER w <= 10""")
def _(s, d):
    return auto6(hours.time_sinks(enr(s, d)))


@query("trip_cycles", "N15", f"""WITH {o.ENR}, t AS (SELECT * FROM enr WHERE activity_code IN ('TRIP','POOH','RIH','TDTRIP')),
g AS (SELECT well_id, report_date, count(*) AS n_trips FROM t GROUP BY 1, 2 HAVING count(*) >= 5),
top AS (SELECT *, (row_number() OVER (PARTITION BY well_id ORDER BY n_trips DESC, report_date))::INTEGER AS rank FROM g QUALIFY rank <= 5),
f AS (SELECT well_id, report_date, operation_text AS first_text FROM t QUALIFY row_number() OVER (PARTITION BY well_id, report_date ORDER BY report_hour, seq) = 1),
m AS (SELECT well_id, report_date, phase, count(*) AS n FROM t GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY well_id, report_date ORDER BY count(*) DESC, phase) = 1)
SELECT well_id, report_date, n_trips, first_text, rank, m.phase FROM top JOIN f USING (well_id, report_date) JOIN m USING (well_id, report_date)""")
def _(s, d):
    return hours.trip_cycles(enr(s, d))


@query("recurring_causes", "N17", f"""WITH {o.ENR}, g AS (SELECT well_id, npt_category, phase, sum(duration_hr) AS h FROM enr WHERE is_npt GROUP BY 1, 2, 3 HAVING sum(duration_hr) > 0)
SELECT well_id, npt_category, count(*) AS n_phases, round(sum(h), 6) AS hours FROM g GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(s, d):
    return auto6(hours.recurring_causes(enr(s, d)))


@query("safety_overhead", "N18", """WITH {ops} SELECT well_id, phase, round(sum(CASE WHEN activity_code = 'SFTY' THEN duration_hr ELSE 0 END), 6) AS code_h, round(sum(duration_hr), 6) AS total_h,
 round(100 * sum(CASE WHEN activity_code = 'SFTY' THEN duration_hr ELSE 0 END) / sum(duration_hr), 6) AS share_pct FROM ops GROUP BY 1, 2 HAVING sum(duration_hr) > 0""")
def _(s, d):
    return auto6(hours.overhead_share(view(s, d, "ops")))


@query("npt_category_breakdown", "N25", f"""WITH {o.ENR}, g AS (SELECT well_id, npt_category, sum(duration_hr) AS hours FROM enr WHERE is_npt GROUP BY 1, 2)
SELECT well_id, npt_category, {o.label('npt_category')} AS label, round(hours, 6) AS hours, round_even(100 * hours / sum(hours) OVER (PARTITION BY well_id), 1) AS share_pct FROM g""")
def _(s, d):
    return auto6(hours.category_breakdown(enr(s, d)))


@query("hours_by_op_code", "N26", f"""WITH {o.ENR}, g AS (SELECT well_id, coalesce(nullif(trim(op_code), ''), '(unclassified)') AS code, sum(duration_hr) AS total_h, sum(CASE WHEN is_npt THEN duration_hr ELSE 0 END) AS npt_h, count(*) AS n_ops FROM enr GROUP BY 1, 2)
SELECT well_id, code, {R('total_h', 'npt_h')}, n_ops, round(total_h - npt_h, 6) AS prod_h, round(npt_h / CASE WHEN total_h = 0 THEN 1 ELSE total_h END * 100, 6) AS npt_pct FROM g""")
def _(s, d):
    return auto6(hours.hours_by_op_code(enr(s, d)))


_SEA = lambda c: f"CASE WHEN {c} IS NULL THEN '—' WHEN {c} < 2 THEN 'Calm' WHEN {c} < 5 THEN 'Slight' WHEN {c} < 8 THEN 'Moderate' WHEN {c} < 13 THEN 'Rough' ELSE 'Very Rough' END"


@query("day_card", "N52", f"""WITH {o.ENR}, {o.TH}{o.DAILY}, {{weather}},
c AS (SELECT well_id, report_date, max(daily_cost_num) AS cost FROM th GROUP BY 1, 2),
m AS (SELECT well_id, report_date, phase, count(*) AS n FROM enr GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY well_id, report_date ORDER BY count(*) DESC, phase) = 1)
SELECT well_id, report_date, {R('total_h', 'npt_h')}, cost, m.phase, {R('wind_speed_kn', 'wave_height_ft')}, {_SEA('wave_height_ft')} AS sea_state
FROM daily LEFT JOIN c USING (well_id, report_date) LEFT JOIN m USING (well_id, report_date) LEFT JOIN weather USING (report_date)""")
def _(s, d):
    return auto6(hours.day_card(enr(s, d), view(s, d, "headers"), view(s, d, "weather")))


@query("operations_log_filter", "B6 D2 C40", f"""WITH {o.ENR}, {{weather}}, j AS (SELECT enr.*, {_SEA('wave_height_ft')} AS sea_state FROM enr LEFT JOIN weather USING (report_date))
SELECT seq, sea_state, npt_category FROM j WHERE is_npt AND sea_state = 'Slight' AND regexp_matches(operation_text, 'stuck|fishing|PUMP', 'i') AND report_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'""")
def _(s, d):
    j = weather.ops_with_weather(enr(s, d), view(s, d, "weather"))
    return hours.ops_log(j, npt_class="Flagged NPT", sea_state="Slight", text="stuck|fishing|PUMP", d0="2024-01-03", d1="2024-01-25").select("seq", "sea_state", "npt_category")


@query("rolling_cost_median", "E12", f"""WITH {o.TH} SELECT well_id, report_date, daily_cost_num, CASE WHEN count(*) OVER w >= 3 THEN round(quantile_cont(daily_cost_num, 0.5) OVER w, 6) END AS rolling_median
FROM th WHERE daily_cost_num > 0 WINDOW w AS (PARTITION BY well_id ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def _(s, d):
    return auto6(hours.rolling_cost_median(view(s, d, "headers")))


@query("cost_anomalies", "N20", f"""WITH {o.ENR}, {o.TH}{o.DAILY},
m AS (SELECT well_id, report_date, daily_cost_num, CASE WHEN count(*) OVER w >= 3 THEN quantile_cont(daily_cost_num, 0.5) OVER w END AS med FROM th WHERE daily_cost_num > 0 WINDOW w AS (PARTITION BY well_id ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
st AS (SELECT well_id, avg(daily_cost_num) AS avg_cost FROM m GROUP BY 1),
pk AS (SELECT well_id, report_date AS peak_date FROM m QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY daily_cost_num DESC, report_date) = 1),
tp AS (SELECT * FROM m),
cs AS (SELECT well_id, report_date, npt_category AS cause, sum(duration_hr) AS h FROM enr WHERE is_npt GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY well_id, report_date ORDER BY sum(duration_hr) DESC, npt_category) = 1),
sp AS (SELECT tp.*, avg_cost, cause, total_h, npt_h FROM tp JOIN st USING (well_id) JOIN pk USING (well_id) JOIN cs USING (well_id, report_date) LEFT JOIN daily USING (well_id, report_date) WHERE daily_cost_num >= 1.6 * avg_cost AND tp.report_date <> peak_date)
SELECT well_id, report_date, daily_cost_num, cause, floor(100 * npt_h / greatest(total_h, 1))::BIGINT AS npt_pct, daily_cost_num > 3 * coalesce(med, avg_cost) AS bulk FROM sp
QUALIFY row_number() OVER (PARTITION BY well_id, cause, month(report_date) ORDER BY daily_cost_num DESC, report_date) = 1""")
def _(s, d):
    return hours.cost_anomalies(view(s, d, "headers"), enr(s, d))


@query("headcount_by_phase", "N24 D3", f"""WITH {{ops}}, {{headers}}, m AS (SELECT well_id, report_date, phase, count(*) AS c FROM ops GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY well_id, report_date ORDER BY count(*) DESC, phase) = 1),
j AS (SELECT well_id, report_date, CAST(head_count AS DOUBLE) AS n, phase FROM headers LEFT JOIN m USING (well_id, report_date))
SELECT well_id, phase, round(avg(n), 6) AS avg_pob, min(n) AS min_pob, max(n) AS peak_pob, first(report_date ORDER BY n DESC, report_date) AS peak_date, count(*) AS n_days FROM j GROUP BY 1, 2""")
def _(s, d):
    return auto6(hours.headcount_by_phase(view(s, d, "headers"), view(s, d, "ops")))


_PERS = """pers AS (SELECT 'Co' || CAST(l_suppkey % 15 AS STRING) AS company, CASE WHEN l_returnflag = 'A' THEN 'COND1' WHEN l_returnflag = 'R' THEN 'PROD1' ELSE 'COMPZN' END AS phase, l_quantity AS n_people FROM lineitem)"""


@query("company_by_phase", "N24 E7", f"""WITH {_PERS}, t AS (SELECT company FROM pers GROUP BY 1 ORDER BY sum(n_people) DESC, company LIMIT 10)
SELECT company, round(coalesce(avg(CASE WHEN phase = 'COND1' THEN n_people END), 0), 6) AS "COND1", round(coalesce(avg(CASE WHEN phase = 'PROD1' THEN n_people END), 0), 6) AS "PROD1",
 round(coalesce(avg(CASE WHEN phase = 'COMPZN' THEN n_people END), 0), 6) AS "COMPZN" FROM pers SEMI JOIN t USING (company) GROUP BY 1""")
def _(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    pers = li.select(
        F.concat(F.lit("Co"), (F.col("l_suppkey") % 15).cast("string")).alias("company"),
        F.when(F.col("l_returnflag") == "A", "COND1").when(F.col("l_returnflag") == "R", "PROD1").otherwise("COMPZN").alias("phase"),
        F.col("l_quantity").alias("n_people"),
    )
    return auto6(hours.company_by_phase(pers, ["COND1", "PROD1", "COMPZN"]))


@query("vessel_visits_by_month", "N23 E22", """WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS vessel_type, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT month, vessel_type, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT month FROM g) CROSS JOIN (SELECT DISTINCT vessel_type FROM g) LEFT JOIN g USING (month, vessel_type)""")
def _(s, d):
    v = s.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderpriority", "vessel_type")
    return hours.visits_by_month(v, F.date_format("o_orderdate", "yyyy-MM"), "vessel_type")


@query("calls_per_vessel", "N23 E8", "SELECT o_custkey AS vessel, count(*) AS calls FROM orders GROUP BY 1")
def _(s, d):
    v = s.read.parquet(f"{d}/orders.parquet")
    return v.groupBy(F.col("o_custkey").alias("vessel")).agg(F.count(F.lit(1)).alias("calls"))


@query("assign_well_by_prefix", "D8 N1", """WITH {ops}, man(prefix, well, ord) AS (VALUES ('W0-', 'Well Zero', 1), ('W1-DDR', 'Well One', 2), ('W0-DDR-01', 'Never First', 3), ('W2-DDR-00', 'Well Two Early', 4)),
x AS (SELECT DISTINCT doc_id FROM ops) SELECT doc_id, coalesce(arg_min(well, ord), 'Unknown') AS well FROM x LEFT JOIN man ON starts_with(doc_id, prefix) GROUP BY 1""")
def _(s, d):
    man = s.createDataFrame([("W0-", "Well Zero", 1), ("W1-DDR", "Well One", 2), ("W0-DDR-01", "Never First", 3), ("W2-DDR-00", "Well Two Early", 4)], "prefix string, well string, ord int")
    return hours.assign_well(view(s, d, "ops").select("doc_id").distinct(), man).select("doc_id", "well")


_CUM = f"WITH {o.ENR}{o.DAILY}, cu AS (SELECT well_id, report_date, sum(total_h) OVER w AS cumulative_hrs, 100 * sum(npt_h) OVER w / sum(total_h) OVER w AS cumulative_npt_pct FROM daily WINDOW w AS (PARTITION BY well_id ORDER BY report_date ROWS UNBOUNDED PRECEDING))"


@query("planned_time_plausible", "B11", _CUM + " SELECT well_id, report_date, round(cumulative_hrs, 6) AS cumulative_hrs, round(cumulative_npt_pct, 6) AS cumulative_npt_pct FROM cu WHERE cumulative_npt_pct IS NOT NULL AND NOT (cumulative_npt_pct > 95 AND coalesce(cumulative_hrs, 0) > 500)")
def _(s, d):
    return auto6(hours.planned_cumulative(hours.cumulative_npt(enr(s, d))))


@query("npt_trajectory", "N19", _CUM + " SELECT well_id, first(report_date ORDER BY cumulative_npt_pct, report_date) AS best_date, round(min(cumulative_npt_pct), 6) AS best_pct, count(*) FILTER (cumulative_npt_pct > 50) AS n_above_50, count(*) AS n_rows FROM cu WHERE NOT (cumulative_npt_pct > 95 AND cumulative_hrs > 500) GROUP BY 1")
def _(s, d):
    return auto6(hours.npt_trajectory(hours.cumulative_npt(enr(s, d))))


@query("unwrap_reporting_day", "N51", f"""WITH {{ops}}, a AS (SELECT well_id, report_date, seq, {o.HOUR('start_time')} AS sh, {o.HOUR('end_time')} AS eh FROM ops),
b AS (SELECT *, CASE WHEN eh < sh THEN eh + 24 ELSE eh END AS er FROM a),
c AS (SELECT *, CASE WHEN sh + 12 < lag(er) OVER (PARTITION BY well_id, report_date ORDER BY sh, seq) THEN 24 ELSE 0 END AS t FROM b),
e AS (SELECT *, sum(t) OVER (PARTITION BY well_id, report_date ORDER BY sh, seq ROWS UNBOUNDED PRECEDING) AS off FROM c)
SELECT well_id, report_date, seq, round(sh + off, 6) AS start_h, round(er + off, 6) AS end_h, round(er - sh, 6) AS dur_h FROM e""")
def _(s, d):
    return auto6(hours.unwrap_day(view(s, d, "ops")))


# -- weather ---------------------------------------------------------------

_WCL = "CASE WHEN wind_speed_kn < 7 THEN 'Light (0-6kn)' WHEN wind_speed_kn < 14 THEN 'Moderate (7-13kn)' WHEN wind_speed_kn < 22 THEN 'Fresh (14-21kn)' WHEN wind_speed_kn < 28 THEN 'Strong (22-27kn)' ELSE 'Gale+ (28kn+)' END"
_SCL = "CASE WHEN wave_height_ft < 2 THEN 'Calm (<2ft)' WHEN wave_height_ft < 5 THEN 'Slight (2-4ft)' WHEN wave_height_ft < 8 THEN 'Moderate (5-7ft)' WHEN wave_height_ft < 13 THEN 'Rough (8-12ft)' ELSE 'Very Rough (13ft+)' END"
_MER = f"""{o.ENR}, {{weather}},
fd0 AS (SELECT report_date, sum(duration_hr) AS total_h, sum(CASE WHEN is_npt THEN duration_hr ELSE 0 END) AS npt_h, count(*) AS n_ops, count(*) FILTER (is_npt) AS n_npt_ops FROM enr GROUP BY 1),
fm AS (SELECT report_date, phase, count(*) AS n FROM enr GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY report_date ORDER BY count(*) DESC, phase) = 1),
mer AS (SELECT w.*, total_h, npt_h, n_ops, n_npt_ops, phase, 100 * npt_h / greatest(total_h, 1) AS npt_pct, {_WCL} AS wind_class, {_SCL} AS sea_class FROM weather w JOIN fd0 USING (report_date) JOIN fm USING (report_date))"""


def merged(s, d):
    return weather.with_daily(view(s, d, "weather"), enr(s, d))


@query("weather_derived", "G14 E10 C37 C38 C39", f"""WITH {{weather}}, b AS (SELECT *, CASE {' '.join(f"WHEN wind_speed_kn <= {l} THEN {i}" for i, l in enumerate([1,3,6,10,16,21,27,33,40,47,55,63,999]))} ELSE 12 END AS bn FROM weather)
SELECT report_date, list_extract(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'], (round_even(wind_direction_deg / 22.5, 0) % 16)::INT + 1) AS wind_cardinal,
 bn AS beaufort_num, list_extract(['Calm','Light air','Light breeze','Gentle breeze','Moderate breeze','Fresh breeze','Strong breeze','Near gale','Gale','Strong gale','Storm','Violent storm','Hurricane'], bn + 1) AS beaufort_label,
 CASE WHEN ((wind_direction_deg - vessel_heading_deg + 360) % 360) > 180 THEN ((wind_direction_deg - vessel_heading_deg + 360) % 360) - 360 ELSE ((wind_direction_deg - vessel_heading_deg + 360) % 360) END AS head_to_wind_angle,
 CASE WHEN wave_period_s > 0 THEN round_even(wave_height_ft * 0.3048 / (9.81 * wave_period_s * wave_period_s / (2 * pi())), 4) END AS wave_steepness,
 round_even(swell_height_ft / nullif(wave_height_ft, 0), 3) AS swell_dominance,
 round_even(wind_speed_kn - lag(wind_speed_kn) OVER (ORDER BY report_date), 1) AS wind_delta_kn, round_even(wave_height_ft - lag(wave_height_ft) OVER (ORDER BY report_date), 2) AS wave_delta_ft FROM b""")
def _(s, d):
    return weather.derived(view(s, d, "weather")).select("report_date", "wind_cardinal", "beaufort_num", "beaufort_label", "head_to_wind_angle", "wave_steepness", "swell_dominance", "wind_delta_kn", "wave_delta_ft")


@query("weather_npt_daily", "D1", f"WITH {_MER} SELECT report_date, phase, n_ops, n_npt_ops, wind_class, sea_class, {R('npt_pct', 'total_h')} FROM mer")
def _(s, d):
    return auto6(merged(s, d).select("report_date", "phase", "n_ops", "n_npt_ops", "wind_class", "sea_class", "npt_pct", "total_h"))


for _key in ("wind_class", "sea_class"):
    query(f"npt_by_{_key}", "I20 C40", f"WITH {_MER} SELECT {_key}, count(npt_pct) AS n_days, round(avg(npt_pct), 8) AS avg_npt_pct, round(avg(npt_h), 8) AS avg_npt_h FROM mer GROUP BY 1")(
        lambda s, d, k=_key: auto6(weather.by_class(merged(s, d), k), 8))


@query("weather_correlation", "E6 I20", f"WITH {_MER} SELECT round(corr(wind_speed_kn, npt_pct), 6) AS wind_corr, round(corr(wave_height_ft, npt_pct), 6) AS wave_corr FROM mer")
def _(s, d):
    return auto6(weather.correlation(merged(s, d)))


@query("high_wind_split", "I20 E5", f"""WITH {_MER}, q AS (SELECT quantile_cont(wind_speed_kn, 0.75) AS p75 FROM mer)
SELECT wind_speed_kn >= p75 AS high_wind, count(*) AS n_days, round(avg(npt_pct), 6) AS avg_npt_pct, round(avg(wind_speed_kn), 6) AS avg_wind_kn, round(max(p75), 6) AS p75 FROM mer, q GROUP BY 1""")
def _(s, d):
    return auto6(weather.high_wind_split(merged(s, d)))


@query("weather_phase_summary", "N22 I20", f"""WITH {_MER} SELECT phase, count(*) AS n_days, round_even(avg(wind_speed_kn), 1) AS avg_wind, round_even(max(wind_speed_kn), 1) AS max_wind, round_even(avg(wave_height_ft), 1) AS avg_wave,
 round_even(max(wave_height_ft), 1) AS max_wave, round_even(avg(npt_pct), 1) AS avg_npt FROM mer GROUP BY 1""")
def _(s, d):
    return weather.phase_summary(merged(s, d))


@query("windiest_days", "I20 E17", f"WITH {_MER} SELECT report_date, phase, {R('wind_speed_kn', 'wave_height_ft', 'swell_height_ft', 'npt_pct')} FROM mer ORDER BY mer.wind_speed_kn DESC, report_date LIMIT 8")
def _(s, d):
    return auto6(weather.windiest(merged(s, d)))


@query("weather_mentions", "B8", f"WITH {o.ENR} SELECT phase, count(*) AS n_ops, round(sum(duration_hr), 6) AS hours FROM enr WHERE is_npt AND regexp_matches(operation_text, 'sea state|weather|wind|wave|swell|crane.*rest|unable.*vessel|vessel.*unable', 'i') GROUP BY 1")
def _(s, d):
    return auto6(weather.mentions(enr(s, d)))


@query("duration_quantiles", "E5", "WITH {ops} SELECT phase, round(quantile_cont(duration_hr, 0.5), 6) AS p50, round(quantile_cont(duration_hr, 0.9), 6) AS p90 FROM ops GROUP BY 1")
def _(s, d):
    return auto6(quantiles.exact_quantiles(view(s, d, "ops"), ["phase"], "duration_hr", {"p50": 0.5, "p90": 0.9}))


@query("pivot_category_phase", "E7", f"""WITH {o.ENR} SELECT npt_category, {', '.join(f"round(coalesce(sum(CASE WHEN phase = 'P{i}' THEN duration_hr END), 0), 6) AS P{i}" for i in range(1, 7))} FROM enr WHERE is_npt GROUP BY 1""")
def _(s, d):
    return auto6(enr(s, d).filter("is_npt").groupBy("npt_category").pivot("phase", [f"P{i}" for i in range(1, 7)]).agg(F.sum("duration_hr")).na.fill(0.0))
