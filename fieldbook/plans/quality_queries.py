"""Queries over checks, samples, lookups and result shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.operators import events as ev
from fieldbook.operators import graph, ordered, quality
from fieldbook.operators import retrieval as rt
from fieldbook.plans import oracle as o
from fieldbook.plans.event_queries import EVT, evs
from fieldbook.plans.graph_queries import EDGES, rows
from fieldbook.plans.hours_queries import auto6, enr
from fieldbook.plans.registry import query
from fieldbook.plans.retrieval_queries import _dr, dense
from fieldbook.plans.text_queries import NORM
from fieldbook.plans.views import VIEWS, table, view
from fieldbook import dims

# Operation texts that reach every rung of the phase ladder.
VIEWS["phaseops"] = """
SELECT o_orderkey AS seq, CASE o_orderkey % 12 WHEN 0 THEN 'No activity today' WHEN 1 THEN 'Rig up floor' WHEN 2 THEN 'Drill out cement' WHEN 3 THEN 'Ran PRODUCTION casing'
  WHEN 4 THEN 'Production hole section' WHEN 5 THEN 'Intermediate casing cemented' WHEN 6 THEN 'Drilled intermediate section' WHEN 7 THEN 'Surface casing set'
  WHEN 8 THEN 'Surface hole drilled' WHEN 9 THEN 'Tested BOP, surface casing next' WHEN 10 THEN 'Routine work' ELSE '' END AS operation_text
FROM orders"""


def _ladder(col, rules, other):
    return o.case([(" OR ".join(f"contains(lower({col}), {o.q(w)})" for w in ws), o.q(n)) for n, ws in rules], o.q(other))


@query("phase_inference", "G7", f"WITH {{phaseops}} SELECT seq, {_ladder('operation_text', quality.PHASE_WORDS, '')} AS phase FROM phaseops")
def _(s, d):
    return view(s, d, "phaseops").select("seq", quality.phase_of(F.col("operation_text")).alias("phase"))


@query("community_names", "C48", f"""WITH {EDGES}, m AS (SELECT phase, CASE WHEN starts_with(term, 'op:') THEN 'op' ELSE left(term, 1) END AS community, term, strength FROM dg),
t AS (SELECT phase, community, string_agg(term, ' ' ORDER BY strength DESC, term) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY phase, community ORDER BY strength DESC, term) AS rn FROM m) WHERE rn <= 6 GROUP BY 1, 2)
SELECT *, {_ladder('top_terms', quality.COMMUNITY_WORDS, 'Mixed Operations')} AS name FROM t""")
def _(s, d):
    m = graph.degrees(graph.cooccurrence(rows(s, d)))
    return quality.community_names(m.withColumn("community", F.when(F.col("term").startswith("op:"), "op").otherwise(F.substring("term", 1, 1))))


@query("filter_fallback", "B2", f"WITH x AS (SELECT 1){_dr(10)} SELECT query_id, chunk_key FROM (SELECT *, chunk_key % 17 = query_id % 17 AS p, bool_or(chunk_key % 17 = query_id % 17) OVER (PARTITION BY query_id) AS one_passes FROM dr) WHERE p OR NOT one_passes")
def _(s, d):
    return quality.filter_or_base(dense(s, d), F.col("chunk_key") % 17 == F.col("query_id") % 17).select("query_id", "chunk_key")


@query("spread_sample", "B12", "WITH {headers}, r AS (SELECT doc_id, report_date, row_number() OVER (ORDER BY report_date, doc_id) - 1 AS rn, count(*) OVER () AS n FROM headers) SELECT doc_id, report_date FROM r WHERE n <= 25 OR rn IN (SELECT floor(i * (n / 25))::BIGINT FROM (SELECT unnest(range(25)) AS i), (SELECT any_value(n) AS n FROM r))")
def _(s, d):
    return quality.spread_sample(view(s, d, "headers").select("doc_id", "report_date"), 25)


@query("header_lookup", "D7", "WITH {ops}, {headers} SELECT seq, coalesce(rig_name, '') AS rig_name, coalesce(head_count, '') AS head_count FROM ops LEFT JOIN headers h USING (doc_id)")
def _(s, d):
    h = view(s, d, "headers")
    return quality.header_lookup(view(s, d, "ops").select("seq", "doc_id"), h, ["rig_name", "head_count"]).select("seq", "rig_name", "head_count")


@query("overlapping_chunks", "D12", "WITH {docpages}, c AS (SELECT doc_id, rec_id AS chunk, page AS a, page + rec_id % 3 AS b FROM docpages) SELECT p.doc_id, p.page, chunk FROM docpages p JOIN c ON c.doc_id = p.doc_id AND p.page BETWEEN a AND b")
def _(s, d):
    p = view(s, d, "docpages")
    c = p.select("doc_id", F.col("rec_id").alias("chunk"), F.col("page").alias("page_start"), (F.col("page") + F.col("rec_id") % 3).alias("page_end"))
    return quality.overlapping_chunks(c, p, block=4).select("doc_id", "page", "chunk")


@query("chunk_text_lookup", "D16", """WITH h AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'g' || doc_id END AS g, 'c' || doc_id AS c FROM labels), k AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'g' || doc_id END AS g, 'c' || doc_id AS c, text FROM documents)
SELECT doc_id, length(k.text) AS n_chars FROM h LEFT JOIN k ON coalesce(h.g, h.c) = k.g OR coalesce(h.g, h.c) = k.c""")
def _(s, d):
    g, c = F.concat(F.lit("g"), F.col("doc_id").cast("string")), F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    hits = table(s, d, "labels").select("doc_id", F.when(F.col("doc_id") % 3 > 0, g).alias("chunk_id_global"), c.alias("chunk_id"))
    chunks = table(s, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, g).alias("chunk_id_global"), c.alias("chunk_id"), F.col("text").alias("chunk_text"))
    return quality.chunk_text(hits, chunks).select("doc_id", F.length("chunk_text").cast("long").alias("n_chars"))


_REQ = ["report_date", "report_no", "daily_cost", "rig_name"]


@query("completeness", "G10", f"""WITH {{ops}}, {{headers}}, a AS (SELECT doc_id, count(*) AS n, sum(duration_hr) AS hours, count(*) FILTER (coalesce(phase, '') = '') AS no_phase FROM ops GROUP BY 1)
SELECT coalesce(h.doc_id, a.doc_id) AS doc_id, round_even(coalesce(hours, 0), 2) AS hours, round_even(abs(24 - coalesce(hours, 0)), 2) AS gap, ({' + '.join(f"(coalesce({c}::VARCHAR, '') <> '')::INT" for c in _REQ)})::INT AS fields_found,
array_to_string(list_filter([{', '.join(f"CASE WHEN coalesce({c}::VARCHAR, '') = '' THEN '{c} not found' END" for c in _REQ)}, CASE WHEN n IS NULL THEN 'no operation rows' END, CASE WHEN hours < 20 OR hours > 31 THEN 'hours outside 20-31' END, CASE WHEN no_phase > 0 THEN no_phase || ' rows missing phase' END], lambda x: x IS NOT NULL), '; ') AS issues
FROM headers h FULL JOIN a ON h.doc_id = a.doc_id""")
def _(s, d):
    c = quality.completeness(view(s, d, "headers"), view(s, d, "ops"), _REQ)
    return c.withColumn("issues", F.array_join("issues", "; "))


@query("dense_post_filter", "M8", f"WITH x AS (SELECT 1){_dr(40)} SELECT query_id, chunk_key, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key))::INT AS rank FROM dr WHERE chunk_key % 3 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key) <= 10")
def _(s, d):
    return auto6(quality.post_filtered(dense(s, d, 40), F.col("chunk_key") % 3 == 0, 10))


@query("pair_score_blend", "M9", f"""WITH x AS (SELECT 1){_dr(60)}, p AS (SELECT query_id, chunk_key, score, rank, ((chunk_key * 7 + query_id * 13) % 101)::DOUBLE / 101 AS ps FROM dr),
n AS (SELECT *, min(ps) FILTER (rank <= 50) OVER (PARTITION BY query_id) AS lo, max(ps) FILTER (rank <= 50) OVER (PARTITION BY query_id) AS hi FROM p),
b AS (SELECT query_id, chunk_key, score + CASE WHEN rank <= 50 THEN 0.2 * CASE WHEN hi > lo THEN (ps - lo) / (hi - lo) ELSE 0 END ELSE 0 END AS score FROM n)
SELECT query_id, chunk_key, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key))::INT AS rank FROM b""")
def _(s, d):
    pair = ((F.col("chunk_key") * 7 + F.col("query_id") * 13) % 101).cast("double") / 101
    return auto6(quality.blend(dense(s, d, 60).withColumn("pair_score", pair)))


@query("snippets", "M21", f"WITH t AS (SELECT doc_id, {NORM('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 280 THEN rtrim(substr(t, 1, 280), ' ') || '...' ELSE t END AS snippet FROM t")
def _(s, d):
    return table(s, d, "documents").select("doc_id", quality.snippet(F.col("text")).alias("snippet"))


_TERMS = ["the", "ention", "que", "der"]


@query("best_sentence", "M16", f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents),
c AS (SELECT *, list_transform(ss, lambda x: {' + '.join(f"contains(lower(x), '{t}')::INT" for t in _TERMS)}) AS sc FROM p) SELECT doc_id, ss[list_position(sc, list_max(sc))] AS best_sentence, list_max(sc)::INT AS overlap FROM c""")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", "text", F.array(*[F.lit(x) for x in _TERMS]).alias("terms"))
    return quality.best_sentence(t, "text", "terms").select("doc_id", "best_sentence", "overlap")


@query("unknown_capitals", "M27", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS token FROM documents) WHERE regexp_full_match(token, '[A-Z]{2,6}') AND lower(token) NOT IN ('the', 'mit', 'license') GROUP BY 1")
def _(s, d):
    return quality.unknown_capitals(table(s, d, "documents"), "text", ["the", "MIT", "license"])


_NW = EDGES + """, nw AS (SELECT phase, a, b, weight, round_even(weight / max(weight) OVER (PARTITION BY phase), 4) AS norm_weight FROM ed),
nd AS (SELECT phase, term, count(*) AS n_rows, round_even(avg(is_npt::INT), 3) AS npt_ratio, CASE WHEN starts_with(term, 'op:') THEN 'op_code' ELSE 'term' END AS node_type FROM ex GROUP BY 1, 2)"""


def _view(terms, mode):
    """The terms of the rows are read for edges and for nodes."""
    terms = ordered.stored(terms.select("phase", "is_npt", "terms"))
    return quality.graph_view(graph.norm_weights(graph.cooccurrence(terms)), graph.node_stats(terms), mode, 0.05)


_has = lambda ws: " OR ".join(f"contains(term, '{w}')" for w in ws)
for _mode, _cond in (("all", None), ("risk", "npt_ratio > 0.35"), ("workflow", "node_type = 'op_code'"), ("pressure", _has(quality.PRESSURE_TERMS)), ("completion", _has(quality.COMPLETION_TERMS))):
    _sql = f"WITH {_NW}, k AS MATERIALIZED (SELECT * FROM nw WHERE norm_weight >= 0.05)" + (" SELECT * FROM k" if _cond is None else f""",
sd AS MATERIALIZED (SELECT phase, term FROM nd WHERE ({_cond}) AND (phase, term) IN (SELECT (phase, a) FROM k UNION SELECT (phase, b) FROM k)),
kp AS MATERIALIZED (SELECT phase, term FROM sd UNION SELECT phase, a FROM k WHERE (phase, b) IN (SELECT (phase, term) FROM sd) UNION SELECT phase, b FROM k WHERE (phase, a) IN (SELECT (phase, term) FROM sd))
SELECT * FROM k WHERE phase NOT IN (SELECT phase FROM sd) OR ((phase, a) IN (SELECT (phase, term) FROM kp) AND (phase, b) IN (SELECT (phase, term) FROM kp))""")
    query(f"graph_view_{_mode}", "N36", _sql)(
        lambda s, d, m=_mode: _view(rows(s, d), m).select("phase", "a", "b", "weight", "norm_weight"))


@query("graph_summary", "N35", f"""WITH {_NW}, t AS (SELECT phase, string_agg(term, ' ' ORDER BY n_rows DESC, term) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY n_rows DESC, term) AS rn FROM nd) WHERE rn <= 8 GROUP BY 1)
SELECT phase, n_nodes, n_edges, total_weight, top_terms FROM (SELECT phase, count(*) AS n_nodes FROM nd GROUP BY 1) LEFT JOIN (SELECT phase, count(*) AS n_edges, sum(weight)::BIGINT AS total_weight FROM ed GROUP BY 1) USING (phase) LEFT JOIN t USING (phase)""")
def _(s, d):
    return quality.graph_summary(graph.cooccurrence(rows(s, d)), graph.node_stats(rows(s, d)))


@query("index_shape", "N47", "SELECT n_vectors, n_chunks, bad = 0 AS dim_ok, n_vectors >= 13000 AS size_ok, n_vectors = n_chunks AS equal_ok FROM (SELECT count(*) AS n_vectors, count(*) FILTER (len(embedding) <> 64) AS bad FROM embeddings), (SELECT count(*) AS n_chunks FROM documents)")
def _(s, d):
    return quality.index_shape(table(s, d, "embeddings"), table(s, d, "documents"), 64, 13000)


@query("contract_checks", "N48", """WITH {ops} SELECT coalesce((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM ops GROUP BY doc_id, start_time, end_time, operation_text)), 0)::BIGINT AS duplicate_rows, count(*) FILTER (end_time < start_time) AS times_out_of_order,
count(*) FILTER (duration_hr > 24 OR duration_hr < 0) AS impossible_values, count(*) FILTER (coalesce(op_code, '') = '' OR coalesce(phase, '') = '') AS missing_critical FROM ops""")
def _(s, d):
    return quality.contract_checks(view(s, d, "ops"), ["doc_id", "start_time", "end_time", "operation_text"], ["op_code", "phase"], (F.col("duration_hr") > 24) | (F.col("duration_hr") < 0), "start_time", "end_time")


@query("recommendations", "N53", f"""WITH {o.ENR}, {EVT}, t AS (SELECT sum(duration_hr) AS a, sum(CASE WHEN is_npt THEN duration_hr ELSE 0 END) AS n FROM enr),
c AS (SELECT npt_category AS cause, sum(duration_hr) AS h FROM enr WHERE is_npt GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
e AS (SELECT max(force_klbs) FILTER (event_type = 'overpull') AS pull, count(*) FILTER (event_type = 'mud_loss') AS losses, max(loss_rate_bbl_hr) FILTER (event_type = 'mud_loss') AS rate, max(ecd_ppge) FILTER (sub_type = 'high_ecd') AS ecd FROM evt),
dc AS (SELECT coalesce(sum(len(list_filter(list_transform(regexp_split_to_array(operation_text, '[.•\\n]'), lambda x: trim(x)), lambda x: regexp_matches(x, {o.q(dims.DECISION_PATTERN)}, 'i') AND length(x) > 20)[1:2])), 0)::BIGINT AS n FROM narr),
h AS (SELECT list_filter([CASE WHEN 100 * t.n / t.a > 30 THEN 'NPT ' || printf('%.0f', 100 * t.n / t.a) || '%: ' || cause || ' ' || printf('%.0f', h) || ' hrs' END, CASE WHEN pull > 200 THEN 'peak overpull ' || printf('%.0f', pull) || ' klbs' END,
 CASE WHEN losses > 0 THEN losses || ' mud losses, peak ' || printf('%.0f', rate) || ' bbl/hr' END, CASE WHEN ecd IS NOT NULL THEN 'high ECD, max ' || printf('%.2f', ecd) || ' ppge' END, CASE WHEN dc.n > 0 THEN dc.n || ' decisions recorded' END], lambda x: x IS NOT NULL) AS hs FROM t, c, e, dc)
SELECT unnest(CASE WHEN len(hs) > 0 THEN hs ELSE ['no specific risks'] END) AS hint FROM h""")
def _(s, d):
    n = ev.decisions(view(s, d, "narr", spread=True)).agg(F.count(F.lit(1)).alias("n_decisions"))
    return quality.recommendations(enr(s, d), evs(s, d), n)
