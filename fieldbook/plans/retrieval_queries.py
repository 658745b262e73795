"""Queries over chunks, vectors and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.operators import retrieval as rt
from fieldbook.plans.hours_queries import auto6
from fieldbook.plans.registry import query
from fieldbook.plans.views import table, view

CH = """ch AS (SELECT doc_id AS chunk_key, source AS scope_id, text AS chunk_text FROM documents)"""
TOK = CH + """,
qs AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS scope_id, text AS question FROM benchmark),
tk AS (SELECT chunk_key, scope_id, unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9][a-z0-9\\-]{1,}')) AS term FROM ch),
po AS MATERIALIZED (SELECT chunk_key, scope_id, term, count(*) AS tf FROM tk GROUP BY ALL),
dl AS (SELECT chunk_key, scope_id, sum(tf)::BIGINT AS dl FROM po GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, scope_id, unnest(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9\\-]{1,}')) AS term FROM qs)"""
SC = TOK + """,
nn AS (SELECT count(*) AS n, (SELECT sum(dl) FROM dl) / count(*) AS avgdl FROM ch),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS MATERIALIZED (SELECT query_id, chunk_key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN po USING (term) JOIN df USING (term) JOIN dl USING (chunk_key), nn GROUP BY 1, 2)"""
VV = """,
vv AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-12)) AS v FROM embeddings),
dn AS MATERIALIZED (SELECT item_id AS query_id, b.vec_id AS chunk_key, list_dot_product(a.v, b.v) AS score FROM benchmark JOIN vv a ON a.vec_id = item_id, vv b)"""
DEPTH = rt.fusion_depth(10)


def _dr(n):
    return f"{VV}, dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key) AS rank FROM dn QUALIFY rank <= {n})"


DN = _dr(10)


def chunks(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("chunk_key"), F.col("source").alias("scope_id"), F.col("text").alias("chunk_text"))


def questions(s, d):
    b = table(s, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("scope_id"), F.col("text").alias("question"))


def lexical(s, d, k):
    return rt.rank(rt.bm25_best(chunks(s, d), questions(s, d), k), k)


def dense(s, d, k=10):
    """Questions are the benchmark items; an item's vector is the one with its number."""
    e = table(s, d, "embeddings")
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id")).join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id")
    return rt.dense_top(e.select(F.col("vec_id").alias("chunk_key"), "embedding"), q, k)


@query("word_chunks", "L1 L2 L4", """WITH d AS (SELECT doc_id, (doc_id % 7 + 1)::INT AS page, string_split(trim(regexp_replace(text, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), ' ') AS w FROM documents),
c AS (SELECT doc_id, page, w, unnest(range(0, len(w), 126)) AS s FROM d WHERE w[1] <> '')
SELECT doc_id, page, (s // 126)::INT AS chunk_no, printf('p%04d_%03d', page, (s // 126)::INT) AS chunk_id, array_to_string(w[s + 1 : s + 168], ' ') AS chunk_text, len(w[s + 1 : s + 168])::INT AS word_count FROM c WHERE s = 0 OR s + 42 < len(w)""")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 7 + 1).cast("int").alias("page"), F.col("text").alias("clean_text"))
    return rt.word_chunks(docs)


@query("bm25_postings", "M1 C27", f"WITH {TOK} SELECT chunk_key, term, tf FROM po")
def _(s, d):
    return rt.postings(chunks(s, d))


@query("bm25_term_stats", "M1", f"WITH {SC} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, nn")
def _(s, d):
    c = chunks(s, d)
    p = rt.postings(c)
    return auto6(rt.term_stats(p, rt.totals(c, rt.doc_lengths(p))))


@query("bm25_scores", "M2", f"WITH {SC} SELECT query_id, chunk_key, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key))::INT AS rank FROM sc QUALIFY rank <= {DEPTH}")
def _(s, d):
    return auto6(lexical(s, d, DEPTH))


@query("bm25_scoped", "M3 B3", f"""WITH {TOK}, nn AS (SELECT scope_id, count(*) AS n, any_value(t) / count(*) AS avgdl FROM ch JOIN (SELECT scope_id, sum(dl) AS t FROM dl GROUP BY 1) USING (scope_id) GROUP BY 1),
df AS (SELECT scope_id, term, count(*) AS df FROM po GROUP BY 1, 2)
SELECT query_id, chunk_key, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key))::INT AS rank FROM (
SELECT query_id, chunk_key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
FROM qt JOIN po USING (scope_id, term) JOIN df USING (scope_id, term) JOIN dl USING (scope_id, chunk_key) JOIN nn USING (scope_id) GROUP BY 1, 2) QUALIFY rank <= {DEPTH}""")
def _(s, d):
    return auto6(rt.rank(rt.bm25_best(chunks(s, d), questions(s, d), DEPTH, scope=["scope_id"]), DEPTH))


@query("dense_top10", "M4 C43", f"WITH {CH}{DN} SELECT query_id, chunk_key, round(score, 6) AS score, rank::INT AS rank FROM dr")
def _(s, d):
    return auto6(dense(s, d))


_FU = f"""WITH {SC}{_dr(DEPTH)}, br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key) AS rank FROM sc QUALIFY rank <= {DEPTH})"""


@query("rank_fusion", "M5 D15", _FU + """, fu AS (SELECT query_id, chunk_key, dr.rank::INT AS dense_rank, br.rank::INT AS bm25_rank, coalesce(0.5 / (20 + dr.rank), 0) + coalesce(2.0 / (20 + br.rank), 0) AS score FROM dr FULL JOIN br USING (query_id, chunk_key))
SELECT query_id, chunk_key, dense_rank, bm25_rank, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key))::INT AS rank FROM fu QUALIFY rank <= 10""")
def _(s, d):
    return auto6(rt.rank(rt.rrf(dense(s, d, DEPTH), lexical(s, d, DEPTH)), 10))


for _name, _ids, _wd, _wb in (("score_fusion", "M6 E21", 0.5, 2.0), ("corpus_fusion", "M7", 0.7, 0.3)):
    query(_name, _ids, _FU + f""", a AS (SELECT query_id, chunk_key, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS dn FROM dr WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, chunk_key, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS bn FROM br WINDOW w AS (PARTITION BY query_id)),
fu AS (SELECT query_id, chunk_key, {_wd} * coalesce(dn, 0) + {_wb} * coalesce(bn, 0) AS score FROM a FULL JOIN b USING (query_id, chunk_key))
SELECT query_id, chunk_key, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key))::INT AS rank FROM fu QUALIFY rank <= 10""")(
        lambda s, d, x=_wd, y=_wb: auto6(rt.rank(rt.score_fusion(dense(s, d, DEPTH), lexical(s, d, DEPTH), x, y), 10)))


@query("retrieval_margin", "M19", _FU + " SELECT query_id, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin, coalesce(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) < 0.002, false) AS low_margin FROM br GROUP BY 1")
def _(s, d):
    return auto6(rt.margins(lexical(s, d, 10)))


@query("rank_documents", "M20", f"""WITH {SC}, g AS (SELECT query_id, scope_id AS doc_id, max(score) AS score FROM sc JOIN ch USING (chunk_key) GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id))::INT AS rank FROM g QUALIFY rank <= 5""")
def _(s, d):
    c = chunks(s, d).withColumnRenamed("scope_id", "doc_id")
    return auto6(rt.rank_documents(rt.bm25_best(c, questions(s, d), by="doc_id"), 5))


_HIT = f"""WITH {CH}{DN}, h AS (SELECT query_id, coalesce(min(rank) FILTER (b.label = a.label AND chunk_key <> query_id), 0) AS hit_rank, any_value(a.label) AS label FROM dr JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_key GROUP BY 1)"""


def _hits(s, d):
    e = table(s, d, "embeddings")
    r = dense(s, d).join(e.select(F.col("vec_id").alias("chunk_key"), F.col("label").alias("cl")), "chunk_key").join(
        e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return rt.hit_rank(r, (F.col("cl") == F.col("label")) & (F.col("chunk_key") != F.col("query_id"))).join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")


@query("first_hit_rank", "M22", _HIT + " SELECT query_id, hit_rank::INT AS hit_rank, label FROM h")
def _(s, d):
    return _hits(s, d)


@query("recall_at_k", "M23", _HIT + " SELECT label, count(*) AS n, " + ", ".join(f"round(avg((hit_rank BETWEEN 1 AND {k})::INT), 6) AS recall_{k}" for k in (1, 3, 5, 10)) + " FROM h GROUP BY 1")
def _(s, d):
    return auto6(rt.recall(_hits(s, d), ["label"]))


@query("missed_questions", "M24", _HIT + " SELECT query_id, label FROM h WHERE hit_rank = 0")
def _(s, d):
    return _hits(s, d).filter("hit_rank = 0").select("query_id", "label")


@query("report_family", "B4", "WITH {ops} SELECT seq, trim(replace(split_part(doc_id, '-', 1), '_', ' ')) AS trust_id FROM ops")
def _(s, d):
    return view(s, d, "ops").select("seq", rt.trust_id(F.col("doc_id")).alias("trust_id"))


@query("corpus_filter", "B5", "WITH {ops} SELECT seq FROM ops WHERE starts_with(doc_id, 'W1-DDR') AND report_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def _(s, d):
    o = view(s, d, "ops").withColumn("report_date", F.col("report_date").cast("string"))
    return rt.corpus_filter(o, "W1-DDR", "2024-01-05", "2024-01-12").select("seq")
