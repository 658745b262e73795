"""Queries over event and measurement extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook import dims
from fieldbook.operators import events as ev
from fieldbook.operators import hours
from fieldbook.plans import oracle as o
from fieldbook.plans.hours_queries import auto6
from fieldbook.plans.registry import query
from fieldbook.plans.views import view

_D = "list_filter(list_transform(regexp_extract_all(operation_text, '([\\d,]+)\\s*ft(?:OTH|MD|TVD)?(?:\\b|,)', 1, 'i'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda v: v BETWEEN 50 AND 30000)"
_HOLE = f"""CASE WHEN {o.rx('operation_text', ev.CASED.removeprefix('(?i)'))} THEN 'cased' WHEN {o.rx('operation_text', ev.OPEN.removeprefix('(?i)'))} THEN 'open' WHEN phase = 'COND1' THEN 'open' WHEN phase = 'COMPZN' THEN 'cased' WHEN {o.rx('operation_text', ev.LINER.removeprefix('(?i)'))} THEN 'cased' ELSE 'open' END"""
_rx = lambda p: o.rx("operation_text", p.removeprefix("(?i)"))
_ex = lambda p, g: f"regexp_extract(operation_text, {o.q(p.removeprefix('(?i)'))}, {g}, 'i')"
_N = lambda p, g=1: f"TRY_CAST({_ex(p, g)} AS DOUBLE)"
_SEV = "CASE WHEN r >= 50 THEN 'total' WHEN r >= 10 THEN 'partial' ELSE 'seepage' END"
EVT = f"""{{narr}},
b AS MATERIALIZED (SELECT *, {_D} AS ds, {_HOLE} AS hole_type FROM narr),
res AS (SELECT *, 'restriction' AS sub_type, {_N('restriction at ([0-9]+)ft')} AS depth_ft, {_N('([0-9]+)klbs restriction')} AS force_klbs FROM b WHERE contains(operation_text, 'klbs restriction at')
 UNION ALL SELECT *, 'restriction', {_N('instability, packoff at ([0-9]+)ft')}, NULL FROM b WHERE contains(operation_text, 'instability, packoff at')
 UNION ALL SELECT *, 'restriction', {_N('tight spot at ([0-9]+) ft')}, 15 FROM b WHERE contains(operation_text, 'Tight spot at')
 UNION ALL SELECT *, 'restriction', {_N('ft and packoff at ([0-9]+) ft')}, 15 FROM b WHERE contains(operation_text, 'ft and packoff at')
 UNION ALL SELECT *, 'tag', {_N('tagged bottom at ([0-9]+)ft')}, 25 FROM b WHERE contains(operation_text, 'tagged bottom at')),
evt AS MATERIALIZED (
 SELECT seq, report_date, phase, hole_type, 'mud_loss' AS event_type, 'full_losses' AS sub_type, ds[1] AS depth_ft, NULL::DOUBLE AS loss_rate_bbl_hr, 'total' AS severity, NULL::DOUBLE AS ecd_ppge, NULL::DOUBLE AS force_klbs FROM b WHERE {_rx(ev.FULL_LOSS)}
 UNION ALL SELECT seq, report_date, phase, hole_type, 'mud_loss', 'rate', ds[1], r, {_SEV}, NULL, NULL FROM (SELECT *, {_N('loss rate of ([0-9]+) bbls/hr')} AS r FROM b) WHERE r IS NOT NULL
 UNION ALL SELECT seq, report_date, phase, hole_type, 'mud_loss', 'volume', ds[1], NULL, {_SEV}, NULL, NULL FROM (SELECT *, {_N('([0-9]+) bbls losses while')} AS r FROM b) WHERE r IS NOT NULL
 UNION ALL SELECT seq, report_date, phase, hole_type, 'mud_loss', 'static', ds[1], r, CASE WHEN r < 5 THEN 'seepage' ELSE 'partial' END, NULL, NULL FROM (SELECT *, {_N('static loss rate of ([0-9.]+) gpm')} AS r FROM b) WHERE r IS NOT NULL
 UNION ALL SELECT seq, report_date, phase, hole_type, 'mud_loss', 'lcm', ds[1], NULL, 'lcm_treatment', NULL, NULL FROM b WHERE contains(operation_text, 'LCM sweep')
 UNION ALL SELECT seq, report_date, phase, hole_type, 'formation', 'high_ecd', ds[1], NULL, NULL, e, NULL FROM (SELECT *, {_N('ECD[^.]{0,30}?([0-9]{2}[.][0-9]{2,3})')} AS e FROM b) WHERE e > 11
 UNION ALL SELECT seq, report_date, phase, hole_type, 'formation', k, ds[1], NULL, NULL, NULL, NULL FROM (SELECT *, unnest(list_filter([CASE WHEN {_rx(ev.FORMATION[0][1])} THEN 'gas_influx' END, CASE WHEN {_rx(ev.FORMATION[1][1])} THEN 'instability' END, CASE WHEN {_rx(ev.FORMATION[2][1])} THEN 'ballooning' END, CASE WHEN {_rx(ev.FORMATION[3][1])} THEN 'diff_sticking' END], lambda x: x IS NOT NULL)) AS k FROM b)
 UNION ALL SELECT seq, report_date, phase, hole_type, 'overpull', 'overpull', {_N('overpull at ([0-9]+)ft')}, NULL, NULL, NULL, {_N('12-([0-9]+)klbs overpull')} FROM b WHERE contains(operation_text, 'klbs overpull at')
 UNION ALL SELECT seq, report_date, phase, hole_type, 'restriction', sub_type, depth_ft, NULL, NULL, NULL, force_klbs FROM res)"""
COLS = ["seq", "hole_type", "event_type", "sub_type", "depth_ft", "loss_rate_bbl_hr", "severity", "ecd_ppge"]


def evs(s, d):
    return ev.extract_events(view(s, d, "narr", spread=True))


@query("extract_depths_hole", "I1 I2", f"WITH {{narr}} SELECT seq, {_HOLE} AS hole_type, array_to_string(list_transform({_D}, lambda x: x::BIGINT), ',') AS depths FROM narr")
def _(s, d):
    return view(s, d, "narr", spread=True).select("seq", ev.hole_type().alias("hole_type"), F.array_join(F.transform(ev.depths(), lambda x: x.cast("bigint").cast("string")), ",").alias("depths"))


@query("loss_formation_events", "I5 I6 S7", f"WITH {EVT} SELECT {', '.join(COLS)} FROM evt WHERE event_type IN ('mud_loss', 'formation')")
def _(s, d):
    return evs(s, d).filter("event_type IN ('mud_loss', 'formation')").select(*COLS)


@query("restriction_events", "I3", f"WITH {EVT} SELECT seq, hole_type, sub_type, depth_ft, force_klbs FROM evt WHERE event_type = 'restriction'")
def _(s, d):
    return evs(s, d).filter("event_type = 'restriction'").select("seq", "hole_type", "sub_type", "depth_ft", "force_klbs")


@query("overpull_events", "I4", f"WITH {EVT} SELECT seq, hole_type, depth_ft, force_klbs FROM evt WHERE event_type = 'overpull'")
def _(s, d):
    return evs(s, d).filter("event_type = 'overpull'").select("seq", "hole_type", "depth_ft", "force_klbs")


@query("fit_lot", "I7 I9", f"""WITH {{narr}}, x AS (SELECT seq, report_date, phase, CASE WHEN contains(operation_text, 'LOT') THEN 'LOT' ELSE 'FIT' END AS test_type, {_N('(1[2-6][.][0-9]{1,3}) ppge')} AS limit_ppge,
 CASE WHEN contains(operation_text, 'until divergen') THEN 'initiation' ELSE 'pass' END AS result FROM narr WHERE regexp_matches(operation_text, 'Performed (FIT|LOT)'))
SELECT min(seq) AS seq, report_date, phase, arg_min(test_type, seq) AS test_type, limit_ppge, arg_min(result, seq) AS result FROM x GROUP BY report_date, phase, limit_ppge""")
def _(s, d):
    return ev.fit_lot(view(s, d, "narr", spread=True)).select("seq", "report_date", "phase", "test_type", "limit_ppge", "result")


@query("trip_speed", "I12", f"""WITH {{narr}}, x AS (SELECT seq, phase, operation_text AS t, unnest(list_transform(regexp_extract_all(operation_text, '([0-9]+) ft/min', 1), lambda v: v::DOUBLE)) AS value FROM narr)
SELECT seq, phase, value, CASE WHEN contains(t, 'open hole') THEN 'OH' WHEN regexp_matches(t, 'cased hole|casing') THEN 'CH' END AS hole_type FROM x WHERE value BETWEEN 1 AND 500""")
def _(s, d):
    return ev.trip_speed(view(s, d, "narr", spread=True)).select("seq", "phase", "value", "hole_type")


@query("event_summary", "I10 N27", f"""WITH {EVT} SELECT event_type, sub_type, count(*) AS n_events, min(depth_ft) AS min_depth, max(depth_ft) AS max_depth, max(force_klbs) AS max_force, max(loss_rate_bbl_hr) AS max_rate, max(ecd_ppge) AS max_ecd, count(*) FILTER (hole_type = 'open') AS n_open, count(*) FILTER (hole_type = 'cased') AS n_cased FROM evt GROUP BY 1, 2""")
def _(s, d):
    return ev.summary(evs(s, d))


_HD = "hd AS (SELECT o_orderdate::DATE AS report_date, CAST(max(o_custkey) AS DOUBLE) * 10 AS header_depth_ft FROM orders GROUP BY 1)"


@query("event_assembly", "I8 D5 E18 S3", f"""WITH {EVT}, {_HD}, j AS (SELECT evt.* EXCLUDE (depth_ft), coalesce(depth_ft, header_depth_ft) AS depth_ft FROM evt LEFT JOIN hd USING (report_date))
SELECT report_date, phase, event_type, sub_type, round_even(coalesce(depth_ft, -1) / 20, 0) AS bucket, force_klbs, min(seq) AS seq FROM j GROUP BY 1, 2, 3, 4, 5, 6""")
def _(s, d):
    hd = s.read.parquet(f"{d}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("report_date")).agg((F.max("o_custkey") * 10.0).alias("header_depth_ft"))
    return ev.assemble(evs(s, d), hd).select("report_date", "phase", "event_type", "sub_type", "bucket", "force_klbs", "seq")


@query("risk_flags", "N5", f"WITH {EVT} SELECT max(force_klbs) FILTER (event_type = 'overpull') AS max_overpull, max(ecd_ppge) AS max_ecd, count(*) FILTER (severity = 'total') AS n_total_losses, count(*) FILTER (sub_type = 'gas_influx') AS n_gas, coalesce(max(force_klbs) FILTER (event_type = 'overpull') > 100, false) AS flag_overpull, coalesce(max(ecd_ppge) > 14.5, false) AS flag_ecd, count(*) FILTER (severity = 'total') > 0 AS flag_losses, count(*) FILTER (sub_type = 'gas_influx') > 0 AS flag_gas FROM evt")
def _(s, d):
    return hours.risk_flags(evs(s, d))


_V = lambda p: f"unnest(list_transform(regexp_extract_all(operation_text, {o.q(p.removeprefix('(?i)'))}, 1, 'i'), lambda x: x::DOUBLE)) AS value"
MET = f"""{{narr}}, m AS MATERIALIZED (SELECT seq, phase, 'rop_inst' AS metric_type, {_V(ev.ROP_INST)}, 'ft/hr' AS unit, operation_text FROM narr UNION ALL SELECT seq, phase, 'rop_avg', {_V(ev.ROP_AVG)}, 'ft/hr', operation_text FROM narr
 UNION ALL SELECT seq, phase, 'wob', {_V(ev.WOB)}, 'klbs', operation_text FROM narr UNION ALL SELECT seq, phase, 'flow_rate', {_V(ev.FLOW)}, 'gpm', operation_text FROM narr
 UNION ALL SELECT seq, phase, 'rop_gen', {_V(ev.ROP_GEN)}, 'ft/hr', operation_text FROM narr WHERE starts_with(operation_text, 'ROP ')
 UNION ALL SELECT seq, phase, 'running_speed', {_V(ev.JOINTS)}, 'joints/hr', operation_text FROM narr)"""


@query("drilling_metrics", "I11 I13 I14 I15", f"WITH {MET} SELECT seq, phase, metric_type, value, unit, TRY_CAST({_ex('from ([0-9]+) ft to ([0-9]+) ft', 1)} AS DOUBLE) AS depth_from_ft, TRY_CAST({_ex('from ([0-9]+) ft to ([0-9]+) ft', 2)} AS DOUBLE) AS depth_to_ft FROM m")
def _(s, d):
    return ev.metrics(view(s, d, "narr", spread=True)).drop("report_date")


@query("metric_summary", "I16 E5", f"WITH {MET} SELECT metric_type, phase, count(*) AS n, min(value) AS min_v, max(value) AS max_v, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM m GROUP BY 1, 2")
def _(s, d):
    return auto6(ev.metric_summary(ev.metrics(view(s, d, "narr", spread=True))))


@query("decision_sentences", "I19", f"WITH {{narr}}, x AS (SELECT seq, phase, list_filter(list_transform(regexp_split_to_array(operation_text, '[.•\\n]'), lambda x: trim(x)), lambda x: regexp_matches(x, {o.q(dims.DECISION_PATTERN)}, 'i') AND length(x) > 20)[1:2] AS ss FROM narr) SELECT seq, phase, (unnest(range(len(ss))))::INT AS pos, unnest(ss) AS sentence FROM x")
def _(s, d):
    return ev.decisions(view(s, d, "narr", spread=True))
