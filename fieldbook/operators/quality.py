"""Checks, samples, lookups and result shaping over typed rows (B2, B12, C48, D7, D12, D16, G7, G10, M8, M9, M16, M21,
M27, N35, N36, N47, N48, N53)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import text
from fieldbook.operators import ordered

# Wording of the phase ladder, first fit wins.
PHASE_WORDS = [
    ("No Activity", ["no activity"]),
    ("Rig Move In", ["rig up", "rigged up", "move in", "matting", "man lift", "subbase", "mud pit", "delivered", "frontier rig 16", "bope", "bop"]),
    ("Drillout", ["drill out", "drillout"]),
    ("Production Casing", ["production casing"]),
    ("Production Drilling", ["production"]),
    ("Intermediate Casing", ["intermediate casing"]),
    ("Intermediate Drilling", ["intermediate"]),
    ("Surface Casing", ["surface casing"]),
    ("Surface Drilling", ["surface"]),
]
# Wording of community names, first fit wins.
COMMUNITY_WORDS = [
    ("Fishing & Recovery", ["fishing", "magnet", "junk", "mill", "stacey", "htpac"]),
    ("Rig Equipment", ["cable", "profibus", "prs", "drag chain", "rider"]),
    ("Stimulation & Completion", ["frac", "sleeve", "ncs", "packer", "flow-in-area", "stim"]),
    ("Casing & Cementing", ["casing", "liner", "cement", "centralizer"]),
    ("Drilling Parameters", ["torque", "rop", "pick-up-weight", "slack-off", "parameters"]),
    ("Tripping & Assembly", ["rih", "pooh", "drill-pipe", "bha", "top-drive", "make-up"]),
    ("Logistics & Marine", ["weather", "vessel", "crane", "aukra", "skandi", "tide"]),
    ("Rig Systems", ["hydraulic", "position", "tilt", "valaris", "rig system"]),
    ("Pressure Management", ["sbp", "choke", "mpd", "flowrate", "surface-back", "ecd"]),
    ("Pressure & Circulation", ["pressure", "pump", "flow", "test", "annulus"]),
]
# Terms of the graph views.
PRESSURE_TERMS = ["pressure", "pump", "choke", "sbp", "mpd", "flowrate", "surface-back", "ecd", "mud-weight", "flow"]
COMPLETION_TERMS = ["sleeve", "packer", "frac", "ncs", "rih", "compression", "wash-pipe", "mule-shoe", "flow-in-area", "tubing"]


def ladder(value: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """The first rule of which a word stands in the lower-cased value."""
    low, out = F.lower(F.coalesce(value, F.lit(""))), F.lit(other)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def phase_of(operation: Column) -> Column:
    """Phase from operation text; empty when nothing fits."""
    return ladder(operation, PHASE_WORDS, "")


def community_names(members: DataFrame, n: int = 6) -> DataFrame:
    """Name of each (phase, community) from its ``n`` strongest terms."""
    top = ordered.top_n_per(members, ["phase", "community"], [F.desc("strength"), F.asc("term")], n)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ")
    return top.groupBy("phase", "community").agg(words.alias("top_terms")).withColumn("name", ladder(F.col("top_terms"), COMMUNITY_WORDS, "Mixed Operations"))


def filter_or_base(candidates: DataFrame, passes: Column) -> DataFrame:
    """B2: candidates that pass the filter; all of a question's candidates where none passes."""
    marked = candidates.withColumn("__pass", F.coalesce(passes, F.lit(False)))
    none = marked.groupBy("query_id").agg(F.bool_or("__pass").alias("__some"))
    return marked.join(none, "query_id").filter(F.col("__pass") | ~F.col("__some")).drop("__pass", "__some")


def spread_sample(docs: DataFrame, n: int, date: str = "report_date", key: str = "doc_id") -> DataFrame:
    """``n`` documents evenly spaced by (date, key); all of them if there are no more."""
    placed = ordered.position(docs, [], date, [key], "__rn")
    total = docs.agg(F.count(F.lit(1)).alias("__all"))
    want = total.select("__all", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__i")).select(
        F.floor(F.col("__i") * (F.col("__all") / n)).alias("__at"), "__all")
    few = placed.join(total).filter(F.col("__all") <= n).drop("__all")
    many = placed.join(want.filter(F.col("__all") > n).select((F.col("__at") + 1).alias("__rn")).distinct(), "__rn", "left_semi")
    return few.unionByName(many).drop("__rn")


def header_lookup(rows: DataFrame, headers: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Header fields by document, empty where a document has none."""
    h = headers.groupBy("doc_id").agg(*[F.max(F.col(f).cast("string")).alias(f) for f in fields])
    return rows.join(h, "doc_id", "left").withColumns({f: F.coalesce(f, F.lit("")) for f in fields})


def overlapping_chunks(chunks: DataFrame, pages: DataFrame, block: int = 16) -> DataFrame:
    """Chunks that touch a page; the range condition runs inside an equality on (document, block of pages)."""
    c = chunks.withColumn("__b", F.explode(F.sequence(F.floor(F.col("page_start") / block), F.floor(F.col("page_end") / block))))
    p = pages.select("doc_id", "page", F.floor(F.col("page") / block).alias("__b"))
    return p.join(c, ["doc_id", "__b"]).filter(F.col("page").between(F.col("page_start"), F.col("page_end"))).drop("__b")


def chunk_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk text by global id, else by local id."""
    wide = chunks.select(F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("chunk_id_global").alias("id")), F.struct(F.lit(1).alias("o"), F.col("chunk_id").alias("id")))).alias("k"), "chunk_text")
    by = wide.filter("k.id IS NOT NULL").groupBy("k.id").agg(F.min_by("chunk_text", F.struct("k.o", "chunk_text")).alias("chunk_text"))
    return hits.withColumn("id", F.coalesce("chunk_id_global", "chunk_id")).join(by, "id", "left").drop("id")


def completeness(headers: DataFrame, ops: DataFrame, required: Sequence[str], codes: Sequence[str] = ("P", "T", "X", "N", "")) -> DataFrame:
    """Hours, gap to a day, fields found and the issues of each document."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    agg = ops.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("duration_hr"), F.lit(0.0)).alias("hours"), F.count_if(empty("phase")).alias("no_phase"),
        F.array_sort(F.collect_set(F.when(~F.coalesce("pt_x", F.lit("")).isin(list(codes)), F.col("pt_x")))).alias("bad_codes"))
    h = headers.groupBy("doc_id").agg(*[F.max(F.when(~empty(c), F.lit(1)).otherwise(0)).alias(c) for c in required])
    j = h.join(agg, "doc_id", "full_outer")
    hours, rows = F.coalesce("hours", F.lit(0.0)), F.coalesce("n_rows", F.lit(0))
    issues = [F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.lit(f"{c} not found")) for c in required]
    issues += [
        F.when(rows == 0, "no operation rows"),
        F.when((rows > 0) & ((hours < 20) | (hours > 31)), "hours outside 20-31"),
        F.when(F.size("bad_codes") > 0, F.concat(F.lit("unexpected codes: "), F.array_join("bad_codes", ","))),
        F.when(F.col("no_phase") > 0, F.concat(F.col("no_phase").cast("string"), F.lit(" rows missing phase"))),
    ]
    found = sum((F.coalesce(F.col(c), F.lit(0)) for c in required), F.lit(0))
    return j.select("doc_id", F.bround(hours, 2).alias("hours"), F.bround(F.abs(24.0 - hours), 2).alias("gap"), found.alias("fields_found"), F.array_compact(F.array(*issues)).alias("issues"))


def post_filtered(ranked: DataFrame, passes: Column, k: int) -> DataFrame:
    """M8: of the first ``4 k`` of each ranked list, the first ``k`` that pass."""
    return ordered.top_n_per(ranked.filter(F.col("rank") <= 4 * k).filter(passes).drop("rank"), ["query_id"], [F.desc(F.round("score", 9)), F.asc("chunk_key")], k)


def blend(ranked: DataFrame, weight: float = 0.2, top: int = 50) -> DataFrame:
    """M9: adds the min-max of a second score (``pair_score``) over the first ``top`` of each list, and ranks anew."""
    head = ranked.filter(F.col("rank") <= top).groupBy("query_id").agg(F.min("pair_score").alias("__lo"), F.max("pair_score").alias("__hi"))
    norm = F.when(F.col("__hi") > F.col("__lo"), (F.col("pair_score") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    score = F.col("score") + F.when(F.col("rank") <= top, weight * norm).otherwise(0.0)
    out = ranked.join(head, "query_id").select("query_id", "chunk_key", score.alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("chunk_key"))))


def snippet(body: Column, n: int = 280) -> Column:
    """One line of at most ``n`` characters."""
    t = text.collapse(F.coalesce(body, F.lit("")))
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("..."))).otherwise(t)


def best_sentence(rows: DataFrame, body: str, terms: str) -> DataFrame:
    """The first sentence that holds most of the terms; sentences end at . ! ? before white space or at line ends."""
    s = F.filter(F.transform(F.split(F.col(body), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    scored = F.transform(s, lambda x, i: F.struct(F.size(F.filter(F.col(terms), lambda t: F.lower(x).contains(t))).alias("score"), (-i).alias("at"), x.alias("sentence")))
    best = F.array_max(scored)
    return rows.withColumn("best_sentence", best["sentence"]).withColumn("overlap", best["score"])


def unknown_capitals(rows: DataFrame, body: str, known: Sequence[str], n: int | None = None) -> DataFrame:
    """Capital tokens of two to six letters that no vocabulary covers, by count."""
    t = rows.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("token"))
    out = t.filter(F.col("token").rlike("^[A-Z]{2,6}$") & ~F.lower("token").isin([k.lower() for k in known])).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), F.asc("token")).limit(n) if n else out


def graph_view(edges: DataFrame, nodes: DataFrame, mode: str = "all", min_weight: float = 0.0) -> DataFrame:
    """Edges from ``min_weight`` on, between the seeds of a view and their neighbours; without seeds all of them.
    ``nodes`` holds npt_ratio and node_type, ``edges`` norm_weight."""
    kept = edges.filter(F.col("norm_weight") >= min_weight)
    if mode == "all":
        return kept
    kept = ordered.stored(kept)  # read six times below
    nodes = ordered.stored(nodes.select("phase", "term", "npt_ratio", "node_type"))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.col("term").contains(w))
    seed = {"risk": F.col("npt_ratio") > 0.35, "workflow": F.col("node_type") == "op_code", "pressure": has(PRESSURE_TERMS), "completion": has(COMPLETION_TERMS)}[mode]
    ends = kept.select("phase", F.col("a").alias("term")).unionByName(kept.select("phase", F.col("b").alias("term"))).distinct()
    seeds = nodes.filter(seed).select("phase", "term").join(ends, ["phase", "term"], "left_semi")
    a, b = (seeds.select("phase", F.col("term").alias(c), F.lit(True).alias(f"__{c}")) for c in "ab")
    mark = kept.join(a, ["phase", "a"], "left").join(b, ["phase", "b"], "left")
    near = mark.filter("__a OR __b")
    keep = seeds.unionByName(near.select("phase", F.col("a").alias("term"))).unionByName(near.select("phase", F.col("b").alias("term"))).distinct()
    some = seeds.select("phase").distinct().withColumn("__some", F.lit(True))
    ka, kb = (keep.select("phase", F.col("term").alias(c), F.lit(True).alias(f"__k{c}")) for c in "ab")
    out = kept.join(some, "phase", "left").join(ka, ["phase", "a"], "left").join(kb, ["phase", "b"], "left")
    return out.filter(F.col("__some").isNull() | (F.col("__ka") & F.col("__kb"))).drop("__some", "__ka", "__kb")


def graph_summary(edges: DataFrame, nodes: DataFrame, n: int = 8) -> DataFrame:
    """Nodes, edges, total weight and the ``n`` most frequent terms per phase."""
    e = edges.groupBy("phase").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("total_weight"))
    m = nodes.groupBy("phase").agg(F.count(F.lit(1)).alias("n_nodes"))
    top = ordered.top_n_per(nodes, ["phase"], [F.desc("n_rows"), F.asc("term")], n)
    t = top.groupBy("phase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("top_terms"))
    return m.join(e, "phase", "left").join(t, "phase", "left")


def index_shape(vectors: DataFrame, chunks: DataFrame, dim: int, least: int) -> DataFrame:
    """Vectors, chunks and the checks of the index shape."""
    v = vectors.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_if(F.size("embedding") != dim).alias("bad_dim"))
    c = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    return v.join(c).select("n_vectors", "n_chunks", (F.col("bad_dim") == 0).alias("dim_ok"), (F.col("n_vectors") >= least).alias("size_ok"), (F.col("n_vectors") == F.col("n_chunks")).alias("equal_ok"))


def contract_checks(rows: DataFrame, key: Sequence[str], critical: Sequence[str], impossible: Column, start: str, end: str) -> DataFrame:
    """Counts of duplicate rows, times out of order, impossible values and missing critical fields."""
    dup = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    missing = F.lit(False)
    for c in critical:
        missing = missing | F.col(c).isNull() | (F.col(c).cast("string") == "")
    one = rows.agg(F.count_if(F.col(end) < F.col(start)).alias("times_out_of_order"), F.count_if(impossible).alias("impossible_values"), F.count_if(missing).alias("missing_critical"))
    return dup.join(one)


def recommendations(ops: DataFrame, events: DataFrame, n_decisions: DataFrame) -> DataFrame:
    """Rule-based hints from one row of totals each."""
    ops = ordered.stored(ops.groupBy("npt_category", "is_npt").agg(F.sum("duration_hr").alias("duration_hr")))
    cat = ops.filter("is_npt").groupBy("npt_category").agg(F.sum("duration_hr").alias("h"))
    top = cat.agg(F.min_by("npt_category", F.struct((-F.col("h")).alias("h"), "npt_category")).alias("cause"), F.max("h").alias("cause_h"))
    tot = ops.agg(F.sum("duration_hr").alias("all_h"), F.sum(F.when(F.col("is_npt"), F.col("duration_hr")).otherwise(0.0)).alias("npt_h"))
    ev = events.agg(
        F.max(F.when(F.col("event_type") == "overpull", F.col("force_klbs"))).alias("pull"), F.count_if(F.col("event_type") == "mud_loss").alias("losses"),
        F.max(F.when(F.col("event_type") == "mud_loss", F.col("loss_rate_bbl_hr"))).alias("rate"), F.max(F.when(F.col("sub_type") == "high_ecd", F.col("ecd_ppge"))).alias("ecd"))
    j = tot.join(top).join(ev).join(n_decisions)
    pct = 100 * F.col("npt_h") / F.col("all_h")
    whole = lambda c: F.format_string("%.0f", c)
    hints = F.array_compact(F.array(
        F.when((pct > 30) & F.col("cause").isNotNull(), F.concat(F.lit("NPT "), whole(pct), F.lit("%: "), F.col("cause"), F.lit(" "), whole(F.col("cause_h")), F.lit(" hrs"))),
        F.when(F.col("pull") > 200, F.concat(F.lit("peak overpull "), whole(F.col("pull")), F.lit(" klbs"))),
        F.when(F.col("losses") > 0, F.concat(F.col("losses").cast("string"), F.lit(" mud losses, peak "), whole(F.col("rate")), F.lit(" bbl/hr"))),
        F.when(F.col("ecd").isNotNull(), F.concat(F.lit("high ECD, max "), F.format_string("%.2f", F.col("ecd")), F.lit(" ppge"))),
        F.when(F.col("n_decisions") > 0, F.concat(F.col("n_decisions").cast("string"), F.lit(" decisions recorded"))),
    ))
    return j.select(F.explode(F.when(F.size(hints) > 0, hints).otherwise(F.array(F.lit("no specific risks")))).alias("hint"))
