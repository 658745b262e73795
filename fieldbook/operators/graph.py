"""Term graphs and phase transitions.

Term lists per row are short (one sentence group), so pairs are made inside the
row; everything across rows is a grouped count with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import text
from fieldbook.operators import ordered
from fieldbook.session import ensure_checkpoint_dir


def row_terms(ops: DataFrame, v: text.Vocabulary, op_codes: bool = True) -> DataFrame:
    """Distinct terms per operation row, op codes as ``op:<code>``."""
    terms = text.graph_tokens(F.col("operation_text"), v)
    code = F.trim(F.coalesce("op_code", F.lit("")))
    if op_codes:
        terms = F.concat(terms, F.when(code != "", F.array(F.concat(F.lit("op:"), code))).otherwise(F.array().cast("array<string>")))
    return ordered.once(ops, terms=F.array_sort(F.array_distinct(terms)))


def _pairs(terms: str) -> Column:
    n = F.size(terms)
    firsts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    made = F.flatten(F.transform(firsts, lambda i: F.transform(
        F.slice(terms, i + 1, n), lambda b: F.struct(F.element_at(terms, i.cast("int")).alias("a"), b.alias("b")))))
    return F.when(n >= 2, made).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def cooccurrence(rows: DataFrame, window: int = 0, min_weight: int = 3) -> DataFrame:
    """Pair counts per phase over a row and its ``window`` following rows.

    With a window the rows after a row come from its (phase, date) bucket and, at
    the end of a bucket, from the first rows of later buckets; only those head
    rows cross buckets."""
    kept = rows.filter(F.size("terms") > 0)
    if window > 0:
        kept = ordered.stored(kept.select("phase", "report_date", "doc_id", "report_hour", "seq", "terms"))
        day = Window.partitionBy("phase", "report_date").orderBy("doc_id", "report_hour", "seq")
        nxt = kept.withColumn("__t", F.collect_list("terms").over(day.rowsBetween(0, window)))
        heads = ordered.top_n_per(kept.select("phase", "report_date", "doc_id", "report_hour", "seq", "terms"),
                                  ["phase", "report_date"], [F.asc("doc_id"), F.asc("report_hour"), F.asc("seq")], window, "__rn")
        # At most ``window`` rows per bucket, gathered per phase in date order.
        hd = heads.groupBy("phase", "report_date").agg(F.array_sort(F.collect_list(F.struct("__rn", "terms"))).alias("h"))
        later = hd.select("phase", "report_date", F.slice(F.flatten(F.collect_list("h").over(
            Window.partitionBy("phase").orderBy("report_date").rowsBetween(1, window))), 1, window).alias("lt"))
        j = nxt.join(later, ["phase", "report_date"], "left")
        short = window + 1 - F.size("__t")
        more = F.transform(F.slice(F.coalesce("lt", F.array()), F.lit(1), F.greatest(short, F.lit(0))), lambda x: x["terms"])
        kept = j.withColumn("terms", F.array_sort(F.array_distinct(F.flatten(F.concat("__t", more)))))
    # Equal lists are folded first: a list makes as many pairs as the square of its length.
    lists = kept.groupBy("phase", "terms").agg(F.count(F.lit(1)).alias("__n"))
    p = lists.select("phase", "__n", F.explode(_pairs("terms")).alias("p"))
    return p.groupBy("phase", "p.a", "p.b").agg(F.sum("__n").alias("weight")).filter(F.col("weight") >= min_weight)


def node_stats(rows: DataFrame) -> DataFrame:
    """Rows, lost-time ratio, type and label per term."""
    t = rows.select("phase", "is_npt", F.explode("terms").alias("term"))
    g = t.groupBy("phase", "term").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("is_npt").cast("double")).alias("__r"))
    op = F.col("term").startswith("op:")
    return g.select("phase", "term", "n_rows", F.bround("__r", 3).alias("npt_ratio"), F.when(op, "op_code").otherwise("term").alias("node_type"),
                    F.when(op, F.expr("substring(term, 4)")).otherwise(F.col("term")).alias("label"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("phase", F.col("a").alias("term"), F.col("b").alias("other"), "weight").unionByName(
        edges.select("phase", F.col("b").alias("term"), F.col("a").alias("other"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree and weighted degree."""
    return _ends(edges).groupBy("phase", "term").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def _keep(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select("phase", F.col("term").alias("a"))
    b = nodes.select("phase", F.col("term").alias("b"))
    return edges.join(a, ["phase", "a"], "left_semi").join(b, ["phase", "b"], "left_semi")


def prune(edges: DataFrame, min_degree: int = 2, max_nodes: int | None = None) -> DataFrame:
    """One degree cut, then, if ``max_nodes`` is given, all op codes plus the strongest terms up to it per phase;
    nodes left without edge disappear with their edges."""
    edges = ordered.stored(edges)
    e = _keep(edges, degrees(edges).filter(F.col("degree") >= min_degree))
    if max_nodes is None:
        return e
    d = degrees(e).withColumn("op", F.col("term").startswith("op:"))
    n_op = d.filter("op").groupBy("phase").agg(F.count(F.lit(1)).alias("n_op"))
    ranked = ordered.top_n_per(d.filter(~F.col("op")), ["phase"], [F.desc("strength"), F.asc("term")], max_nodes)
    terms = ranked.join(n_op, "phase", "left").filter(F.col("rank") <= max_nodes - F.coalesce("n_op", F.lit(0))).select("phase", "term")
    return _keep(e, d.filter("op").select("phase", "term").unionByName(terms))


def norm_weights(edges: DataFrame) -> DataFrame:
    """Weight over the phase's largest weight."""
    edges = ordered.stored(edges)
    m = edges.groupBy("phase").agg(F.max("weight").alias("__m"))
    return edges.join(m, "phase").withColumn("norm_weight", F.bround(F.col("weight") / F.col("__m"), 4)).drop("__m")


def strongest_edges(edges: DataFrame, n: int = 15) -> DataFrame:
    """Heaviest edges per phase."""
    return ordered.top_n_per(edges, ["phase"], [F.desc("weight"), F.asc("a"), F.asc("b")], n)


def communities(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Label propagation over the edge table (in place of a modularity solver).

    A node wants the label with most weight among its neighbours (the smallest on ties) if that outweighs its own. In
    each round about half of the nodes, drawn by a hash of term and round, may move, so that two neighbours do not
    swap for ever. The loop ends when no node wants to move, and fails if that does not happen in ``most_rounds``.
    A checkpoint per round cuts the lineage, so a lost executor replays one round."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    ends = _ends(edges).checkpoint()
    labels = ends.select("phase", "term").distinct().withColumn("community", F.col("term")).checkpoint()
    for k in range(most_rounds):
        votes = ends.join(labels.select("phase", F.col("term").alias("other"), "community"), ["phase", "other"]).groupBy(
            "phase", "term", "community").agg(F.sum("weight").alias("w"))
        own = labels.withColumnRenamed("community", "own")
        best = votes.join(own, ["phase", "term"]).groupBy("phase", "term", "own").agg(
            F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("best"),
            F.coalesce(F.max(F.when(F.col("community") == F.col("own"), F.col("w"))), F.lit(0)).alias("kept"))
        wants = -F.col("best.w") > F.col("kept")
        free = F.pmod(F.xxhash64("phase", "term", F.lit(k)), F.lit(2)) == 0
        new = best.select("phase", "term", F.when(wants & free, F.col("best.community")).otherwise(F.col("own")).alias("community"), wants.alias("wants")).checkpoint()
        labels = new.select("phase", "term", "community")
        if new.filter("wants").isEmpty():
            return labels
    raise RuntimeError(f"labels still move after {most_rounds} rounds")



def term_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, lost rows and lost hours per term."""
    t = rows.select(*keys, "is_npt", "duration_hr", F.explode("terms").alias("term"))
    n = F.col("is_npt")
    return t.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("freq"), F.count_if(n).alias("npt_cnt"),
                                        F.bround(F.sum(F.when(n, F.col("duration_hr")).otherwise(0.0)), 1).alias("npt_hrs")).withColumn(
        "npt_ratio", F.col("npt_cnt") / F.col("freq"))


def transition_windows(rows: DataFrame, phases: DataFrame, days: int = 14) -> DataFrame:
    """Rows of the last ``days`` of a phase (``pre``) and the first of the next
    (``post``), per transition."""
    b = rows.groupBy("phase").agg(F.min("report_date").alias("d0"), F.max("report_date").alias("d1")).join(phases, "phase")
    a = b.select(F.col("ord").alias("o1"), F.col("phase").alias("phase_from"), F.col("d1").alias("cut"))
    n = b.select((F.col("ord") - 1).alias("o1"), F.col("phase").alias("phase_to"), F.col("d0").alias("start"))
    tr = a.join(n, "o1").drop("o1")  # one row per phase pair
    pre = rows.join(tr.select("*", F.col("phase_from").alias("phase")), "phase").filter(
        F.col("report_date") >= F.date_sub("cut", days - 1)).withColumn("side", F.lit("pre"))
    post = rows.join(tr.select("*", F.col("phase_to").alias("phase")), "phase").filter(
        F.col("report_date") <= F.date_add("start", days - 1)).withColumn("side", F.lit("post"))
    return pre.unionByName(post)


def carryover(windows: DataFrame, min_freq: int = 3, signal: float = 0.40, escalation: float = 1.5) -> DataFrame:
    """Terms on both sides of a transition with their change.

    Both sides are one grouped pass; a term counts when it occurs on each side."""
    p = term_profile(windows, ["phase_from", "phase_to", "side"])
    k = ["phase_from", "phase_to", "term"]
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    j = p.groupBy(*k).agg(
        side("pre", "freq").alias("pre_freq"), side("pre", "npt_ratio").alias("a"), side("pre", "npt_hrs").alias("pre_npt_hrs"),
        side("post", "freq").alias("post_freq"), side("post", "npt_ratio").alias("b"), side("post", "npt_hrs").alias("post_npt_hrs"),
    ).filter(F.col("pre_freq").isNotNull() & F.col("post_freq").isNotNull() & (F.greatest("pre_freq", "post_freq") >= min_freq))
    ratio = F.col("post_freq") / F.greatest("pre_freq", F.lit(1))
    return j.select(
        *k, "pre_freq", "post_freq", "pre_npt_hrs", "post_npt_hrs", F.bround("a", 3).alias("pre_npt_ratio"), F.bround("b", 3).alias("post_npt_ratio"),
        F.bround(F.col("b") - F.col("a"), 3).alias("npt_delta"), F.bround(ratio, 2).alias("freq_ratio"),
        (F.col("b") >= signal).alias("is_npt_signal"), (ratio >= escalation).alias("is_escalating"),
        F.bround(F.col("post_freq") * F.col("b"), 1).alias("persistence_score"),
    )
