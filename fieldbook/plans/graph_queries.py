"""Queries over term graphs and transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import dates
from fieldbook.functions.text import Vocabulary
from fieldbook.operators import graph
from fieldbook.plans import oracle as o
from fieldbook.plans.hours_queries import PH, auto6, enr, phase_dim
from fieldbook.plans.registry import query
from fieldbook.plans.views import view

VOCAB = Vocabulary(
    stop_words=["the", "and", "with", "from", "for", "ahead", "number"], unit_tokens=["bbls", "klbs", "minutes"],
    compounds=[("mud pump", "mud-pump"), ("top drive", "top-drive"), ("run in hole", "rih")],
    abbreviations={"bha": "bottom-hole-assembly", "npt": None, "pooh": "pull-out"},
)
_STRIP = ".,;:()[]\"''/*+-"
TERMS = f"""{o.ENR},
tv0 AS (SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(lower(operation_text), '\\bmud pump\\b', 'mud-pump', 'g'), '\\btop drive\\b', 'top-drive', 'g'), '\\brun in hole\\b', 'rih', 'g'), ' ') AS w0 FROM enr),
tv1 AS (SELECT *, list_filter(list_transform(w0, lambda x: CASE trim(x, '.,;:()[]"''') WHEN 'bha' THEN 'bottom-hole-assembly' WHEN 'npt' THEN '' WHEN 'pooh' THEN 'pull-out' ELSE x END), lambda x: x <> '') AS w1 FROM tv0),
tv2 AS (SELECT *, list_filter(list_transform(w1, lambda x: trim(x, '{_STRIP}')), lambda x: x <> '' AND NOT regexp_matches(x, '^\\d') AND CASE WHEN contains(x, '-') THEN length(x) >= 3 AND x NOT IN ('the','and','with','from','for','ahead','number')
   ELSE regexp_matches(x, '^[a-z][a-z0-9''-]{{2,}}') AND x NOT IN ('the','and','with','from','for','ahead','number','bbls','klbs','minutes') END) AS w2 FROM tv1),
rt AS MATERIALIZED (SELECT * EXCLUDE (w0, w1, w2), list_sort(list_distinct(CASE WHEN trim(op_code) <> '' THEN list_append(w2, 'op:' || trim(op_code)) ELSE w2 END)) AS terms FROM tv2),
ex AS MATERIALIZED (SELECT seq, phase, is_npt, duration_hr, report_date, unnest(terms) AS term FROM rt)"""
EDGES = TERMS + """,
ed AS MATERIALIZED (SELECT x.phase, x.term AS a, y.term AS b, count(*) AS weight FROM ex x JOIN ex y ON x.seq = y.seq AND x.term < y.term GROUP BY 1, 2, 3 HAVING count(*) >= 3),
dg AS (SELECT phase, term, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT phase, a AS term, weight FROM ed UNION ALL SELECT phase, b, weight FROM ed) GROUP BY 1, 2)"""


def rows(s, d):
    return graph.row_terms(enr(s, d), VOCAB)


def edge_rows(s, d):
    """Rows for edges alone, which do not ask whether time was lost."""
    return graph.row_terms(view(s, d, "ops", spread=True).withColumn("report_hour", dates.report_hour(F.col("start_time"))), VOCAB)


@query("graph_terms", "C25 C26", f"WITH {TERMS} SELECT seq, array_to_string(terms, ' ') AS terms FROM rt")
def _(s, d):
    return rows(s, d).select("seq", F.array_join("terms", " ").alias("terms"))


@query("cooccurrence_edges", "N29", f"WITH {EDGES} SELECT phase, a, b, weight FROM ed")
def _(s, d):
    return graph.cooccurrence(edge_rows(s, d))


@query("cooccurrence_window2", "N29", TERMS.join(["WITH ", """, rn AS (SELECT phase, terms, row_number() OVER (PARTITION BY phase ORDER BY report_date, doc_id, report_hour, seq) AS rn FROM rt WHERE len(terms) > 0),
wx AS (SELECT phase, rn, unnest(list_distinct(flatten(list(terms) OVER (PARTITION BY phase ORDER BY rn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)))) AS term FROM rn)
SELECT x.phase, x.term AS a, y.term AS b, count(*) AS weight FROM wx x JOIN wx y ON x.phase = y.phase AND x.rn = y.rn AND x.term < y.term GROUP BY 1, 2, 3 HAVING count(*) >= 3"""]))
def _(s, d):
    return graph.cooccurrence(edge_rows(s, d), window=2)


@query("graph_node_stats", "N30", f"WITH {TERMS} SELECT phase, term, count(*) AS n_rows, round_even(avg(is_npt::INT), 3) AS npt_ratio, CASE WHEN starts_with(term, 'op:') THEN 'op_code' ELSE 'term' END AS node_type, CASE WHEN starts_with(term, 'op:') THEN substr(term, 4) ELSE term END AS label FROM ex GROUP BY 1, 2")
def _(s, d):
    return graph.node_stats(rows(s, d))


@query("graph_degrees", "N32", f"WITH {EDGES} SELECT phase, term, degree, strength FROM dg")
def _(s, d):
    return graph.degrees(graph.cooccurrence(edge_rows(s, d)))


@query("graph_pruned", "N31 N36", f"""WITH {EDGES}, e1 AS (SELECT ed.* FROM ed JOIN dg x ON x.phase = ed.phase AND x.term = a AND x.degree >= 2 JOIN dg y ON y.phase = ed.phase AND y.term = b AND y.degree >= 2),
d1 AS (SELECT phase, term, sum(weight) AS st FROM (SELECT phase, a AS term, weight FROM e1 UNION ALL SELECT phase, b, weight FROM e1) GROUP BY 1, 2)
SELECT phase, a, b, weight FROM e1""")
def _(s, d):
    return graph.prune(graph.cooccurrence(edge_rows(s, d)), max_nodes=None)


@query("graph_norm_weights", "N32", f"WITH {EDGES} SELECT phase, a, b, weight, round_even(weight / max(weight) OVER (PARTITION BY phase), 4) AS norm_weight FROM ed")
def _(s, d):
    return graph.norm_weights(graph.cooccurrence(edge_rows(s, d)))


@query("strongest_edges", "N57", f"WITH {EDGES} SELECT phase, a, b, weight, (row_number() OVER (PARTITION BY phase ORDER BY weight DESC, a, b))::INT AS rank FROM ed QUALIFY rank <= 15")
def _(s, d):
    return graph.strongest_edges(graph.cooccurrence(edge_rows(s, d)))


@query("graph_communities", "N33")
def _(s, d):
    return graph.communities(graph.cooccurrence(edge_rows(s, d)))


WIN = TERMS + f""", {PH},
bd AS (SELECT phase, min(report_date) AS d0, max(report_date) AS d1, any_value(ord) AS ord FROM rt JOIN phd USING (phase) GROUP BY 1),
tr AS (SELECT a.phase AS phase_from, b.phase AS phase_to, a.d1 AS cut, b.d0 AS start FROM bd a JOIN bd b ON b.ord = a.ord + 1),
wn AS (SELECT phase_from, phase_to, 'pre' AS side, rt.* FROM rt JOIN tr ON phase = phase_from AND report_date >= cut - 2 UNION ALL SELECT phase_from, phase_to, 'post', rt.* FROM rt JOIN tr ON phase = phase_to AND report_date <= start + 2),
pf AS (SELECT phase_from, phase_to, side, term, count(*) AS freq, count(*) FILTER (is_npt) AS npt_cnt, round_even(sum(CASE WHEN is_npt THEN duration_hr ELSE 0 END), 1) AS npt_hrs FROM (SELECT *, unnest(terms) AS term FROM wn) GROUP BY 1, 2, 3, 4)"""


def windows(s, d):
    return graph.transition_windows(rows(s, d), phase_dim(s).drop("label"), days=3)


@query("transition_windows", "N40", f"WITH {WIN} SELECT phase_from, phase_to, side, seq FROM wn")
def _(s, d):
    return windows(s, d).select("phase_from", "phase_to", "side", "seq")


@query("term_profiles", "N41", f"WITH {WIN} SELECT phase_from, phase_to, side, term, freq, npt_cnt, round(npt_cnt / freq, 6) AS npt_ratio FROM pf")
def _(s, d):
    return auto6(graph.term_profile(windows(s, d), ["phase_from", "phase_to", "side"]).drop("npt_hrs"))


@query("term_carryover", "N42 D14 S10", f"""WITH {WIN} SELECT phase_from, phase_to, term, x.freq AS pre_freq, y.freq AS post_freq, x.npt_hrs AS pre_npt_hrs, y.npt_hrs AS post_npt_hrs, round_even(x.npt_cnt / x.freq, 3) AS pre_npt_ratio, round_even(y.npt_cnt / y.freq, 3) AS post_npt_ratio,
 round_even(y.npt_cnt / y.freq - x.npt_cnt / x.freq, 3) AS npt_delta, round_even(y.freq / greatest(x.freq, 1), 2) AS freq_ratio, y.npt_cnt / y.freq >= 0.5 AS is_npt_signal, y.freq / greatest(x.freq, 1) >= 1.5 AS is_escalating, round_even(y.freq * (y.npt_cnt / y.freq), 1) AS persistence_score
 FROM (SELECT * FROM pf WHERE side = 'pre') x JOIN (SELECT * FROM pf WHERE side = 'post') y USING (phase_from, phase_to, term) WHERE greatest(x.freq, y.freq) >= 5""")
def _(s, d):
    return graph.carryover(windows(s, d), min_freq=5, signal=0.5, escalation=1.5)
