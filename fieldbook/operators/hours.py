"""Operation rows and their hour rollups (A1–A3, E, H4–H8, N1–N28, N39, N50–N56).

Every rollup groups first; windows then run on one row per day, block or phase.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook import dims
from fieldbook.functions import dates, npt, numeric
from fieldbook.operators import ordered

def _lost() -> Column:
    return F.col("is_npt")


def _dur() -> Column:
    return F.col("duration_hr")


def _npt_h() -> Column:
    return F.sum(F.when(_lost(), _dur()).otherwise(0.0))


def sorted_corpus(ops: DataFrame) -> DataFrame:
    """A1: operation rows in (document, date, report hour) order."""
    return ops.withColumn("report_hour", dates.report_hour(F.col("start_time"))).orderBy(
        "doc_id", "report_date", "report_hour", "seq"
    )


def apply_corpus_rule(ops: DataFrame, rule: npt.CorpusRule, wellbore: str = "well_id") -> DataFrame:
    """H3–H6: members get flag and category from their text, other rows keep the
    flag; everything without lost time is ``productive``."""
    c = F.col
    field = c("field_name") if "field_name" in ops.columns else F.lit("")
    member = rule.member(c("doc_id"), c(wellbore), field)
    words = [c("operation_text"), c("op_code"), c("activity_code")]
    kept = [x for x in ops.columns if x not in ("is_npt", "npt_category", "npt_cat_label")]
    # The joined texts and the category are computed once a row, not once for each pattern and each use.
    out = ordered.once(
        ops, __member=member, __flag=F.coalesce(c("is_npt"), F.lit(False)), __short=npt.joined(*words), __line=npt.joined(*words, c("pt_x")), __codes=npt.joined(*words[1:]))
    found = npt.narrative_category(*words, c("pt_x"), c("__line"), c("__codes"), c("__short"))
    out = ordered.once(out, __cat=F.when(c("__member"), found).when(~c("__flag"), "productive").otherwise(npt.category(*words, c("__short"))))
    return out.select(
        *kept, F.when(c("__member"), c("__cat") != "productive").otherwise(c("__flag")).alias("is_npt"), c("__cat").alias("npt_category")
    ).withColumn(
        "npt_cat_label", npt.category_label(c("npt_category"))
    )


def load_ops(ops: DataFrame, rule: npt.CorpusRule) -> DataFrame:
    """A3: classified operation rows with report hour."""
    return apply_corpus_rule(ops, rule).withColumn("report_hour", dates.report_hour(F.col("start_time")))


def typed_headers(headers: DataFrame) -> DataFrame:
    """A2: headers with numeric cost and depth columns."""
    n = numeric.leading_number
    return headers.select(
        "*",
        n(F.col("daily_cost")).alias("daily_cost_num"),
        n(F.col("cumulative_cost")).alias("cum_cost_num"),
        n(F.col("end_depth_md_ft")).alias("end_depth_num"),
    )


def hours_by(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total, lost and productive hours and row count per key."""
    return ops.groupBy(*keys).agg(
        F.sum(_dur()).alias("total_h"), _npt_h().alias("npt_h"), F.count(F.lit(1)).alias("n_ops")
    ).withColumn("prod_h", F.col("total_h") - F.col("npt_h"))


def pct(num: str, den: str, zero: Column | None = None) -> Column:
    """Share in percent; a zero denominator gives ``zero`` (0 by default)."""
    return F.when(F.col(den) != 0, 100.0 * F.col(num) / F.col(den)).otherwise(F.lit(0.0) if zero is None else zero)


def phase_timeline(ops: DataFrame, phases: DataFrame) -> DataFrame:
    """Per well and phase, in phase order; 0 % when no hours."""
    agg = ops.groupBy("well_id", "phase").agg(
        F.min("report_date").alias("date_start"), F.max("report_date").alias("date_end"),
        F.countDistinct("report_date").alias("n_days"), F.count(F.lit(1)).alias("n_ops"),
        F.sum(_dur()).alias("__t"), _npt_h().alias("__n"),
    )
    return agg.join(phases, "phase").select(
        "well_id", "phase", "ord", "label", "date_start", "date_end", "n_days", "n_ops",
        F.bround("__t", 1).alias("total_hrs"), F.bround("__n", 1).alias("npt_hrs"),
        F.bround(pct("__n", "__t"), 1).alias("npt_pct"),
    )


def daily_npt(ops: DataFrame) -> DataFrame:
    """Hours and lost share per well and day; a zero total divides by 1."""
    return hours_by(ops, ["well_id", "report_date"]).select(
        "well_id", "report_date", "total_h", "npt_h",
        (F.col("npt_h") / F.when(F.col("total_h") == 0, 1.0).otherwise(F.col("total_h")) * 100).alias("npt_pct"),
    )


def date_ranges(ops: DataFrame) -> DataFrame:
    """First and last report date per phase."""
    return ops.filter(F.col("report_date").isNotNull()).groupBy("well_id", "phase").agg(
        F.min("report_date").alias("d0"), F.max("report_date").alias("d1")
    )


def dominant(ops: DataFrame, keys: Sequence[str], what: str, out: str) -> DataFrame:
    """The ``what`` with most hours per key; ties go to the smallest name."""
    sums = ops.groupBy(*keys, what).agg(F.sum(_dur()).alias("__h")).filter(F.col(what).isNotNull())
    return sums.groupBy(*keys).agg(F.min_by(what, F.struct(-F.col("__h"), F.col(what))).alias(out))


def mode_by(ops: DataFrame, keys: Sequence[str], what: str, out: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest."""
    n = ops.filter(F.col(what).isNotNull()).groupBy(*keys, what).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(what, F.struct(-F.col("__n"), F.col(what))).alias(out))


# -- operation blocks ------------------------------------------------------


def blocks(ops: DataFrame) -> DataFrame:
    """Runs of equal phase and op code inside a day, numbered per well.

    A block never crosses a date, so the change flag needs only (well, date)
    windows; the running step number comes from per-day block counts.
    """
    day = Window.partitionBy("well_id", "report_date").orderBy("report_hour", "seq")
    same = (F.lag("phase").over(day) == F.col("phase")) & (F.lag("op_code").over(day) == F.col("op_code"))
    marked = ops.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(
        "block", F.sum("__new").over(day.rowsBetween(Window.unboundedPreceding, 0))
    )
    keys = ["well_id", "report_date", "block"]
    text = F.col("operation_text")
    by_cat = marked.groupBy(*keys, "phase", "op_code", "npt_category", "is_npt").agg(
        F.sum(_dur()).alias("h"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(text.isNotNull(), F.struct((-F.length(text)).alias("l"), F.col("report_hour").alias("o"),
                                                F.col("seq").alias("s"), text.alias("t")))).alias("txt"),
    )
    out = by_cat.groupBy(*keys).agg(
        F.min("phase").alias("phase"), F.min("op_code").alias("op_code"),
        F.sum("h").alias("total_h"), F.sum(F.when(_lost(), F.col("h")).otherwise(0.0)).alias("npt_h"),
        F.coalesce(
            F.min_by("npt_category", F.when(_lost(), F.struct(-F.col("h"), F.col("npt_category")))), F.lit("")
        ).alias("npt_category"),
        F.coalesce(F.min("txt")["t"], F.lit("")).alias("description"),
        F.sum("n").alias("n_ops"),
    ).withColumn("npt_pct", F.when(F.col("total_h") > 0, 100.0 * F.col("npt_h") / F.col("total_h")).otherwise(0.0))
    return ordered.position(ordered.stored(out), ["well_id"], "report_date", ["block"], "step")


def step_filter(
    steps: DataFrame, *, phase: str | None = None, min_pct: float = 0, op_codes: Sequence[str] = (),
    categories: Sequence[str] = (), min_hours: float = 0, npt_only: bool = False, d0=None, d1=None,
) -> DataFrame:
    """Programme-step filter; unset parameters keep every row."""
    out, c = steps, F.col
    if phase is not None:
        out = out.filter(c("phase") == phase)
    if min_pct > 0:
        out = out.filter(c("npt_pct") >= min_pct)
    if op_codes:
        out = out.filter(c("op_code").isin(list(op_codes)))
    if categories:
        out = out.filter(c("npt_category").isin(list(categories)))
    if min_hours > 0:
        out = out.filter(c("total_h") >= min_hours)
    if npt_only:
        out = out.filter(c("npt_h") > 0)
    if d0 is not None and d1 is not None:
        out = out.filter((c("report_date") <= F.lit(d1).cast("date")) & (c("report_date") >= F.lit(d0).cast("date")))
    return out


def repeat_causes(steps: DataFrame) -> DataFrame:
    """H8: root-cause key per step and whether it occurs at least twice.

    The count is an aggregate joined back, so a frequent cause is combined
    before it is shuffled."""
    keyed = steps.withColumn("root_cause", npt.root_cause_key(F.col("npt_category"), F.col("description")))
    n = keyed.filter(F.col("root_cause") != "").groupBy("well_id", "root_cause").agg(F.count(F.lit(1)).alias("n_same"))
    return keyed.join(n, ["well_id", "root_cause"], "left").withColumn(
        "repeat", F.coalesce(F.col("n_same") >= 2, F.lit(False))
    ).drop("n_same")


def npt_streaks(steps: DataFrame, ops: DataFrame, threshold: float = 50.0, min_len: int = 2) -> DataFrame:
    """Runs of at least ``min_len`` consecutive steps above ``threshold`` %.

    A run is named by the number of breaks before it (a two-level running sum)."""
    hot = F.col("npt_pct") > threshold
    steps = ordered.stored(steps)
    numbered = ordered.prefix_sum(
        steps, ["well_id"], "report_date", ["block"], F.when(hot, 0).otherwise(1), "run"
    )
    runs = numbered.filter(hot).groupBy("well_id", "run").agg(
        F.min("step").alias("step_first"), F.max("step").alias("step_last"),
        F.count(F.lit(1)).alias("n_steps"), F.sum("npt_h").alias("npt_h"), F.sum("total_h").alias("total_h"),
        F.min("report_date").alias("d0"), F.max("report_date").alias("d1"),
        F.min_by("phase", "step").alias("phase"),
    ).filter(F.col("n_steps") >= min_len)
    # Dominant category inside the date window, joined per (well, day, category) rollup. Runs share days only at
    # their ends, so a run's days are at most one row a run and day.
    per_day = ops.filter(_lost()).groupBy("well_id", "report_date", "npt_category").agg(F.sum(_dur()).alias("h"))
    days = runs.select("well_id", "run", F.explode(F.sequence("d0", "d1")).alias("report_date"))
    inside = days.join(per_day, ["well_id", "report_date"]).groupBy("well_id", "run", "npt_category").agg(F.sum("h").alias("h"))
    cause = inside.groupBy("well_id", "run").agg(
        F.min_by("npt_category", F.struct(-F.col("h"), F.col("npt_category"))).alias("cause")
    )
    return runs.join(cause, ["well_id", "run"], "left").drop("run")


# -- flat days -------------------------------------------------------------


def depth_days(headers: DataFrame) -> DataFrame:
    """Deepest depth per well and date with the last header's type."""
    h = typed_headers(headers).filter(F.col("report_date").isNotNull() & (F.col("end_depth_num") > 0))
    return h.groupBy("well_id", "report_date").agg(
        F.max("end_depth_num").alias("depth_ft"),
        F.max_by("report_type", "report_no").alias("report_type"),
    )


def depth_progress(headers: DataFrame) -> DataFrame:
    """Depth change and clipped advance day by day."""
    w = Window.partitionBy("well_id").orderBy("report_date")
    d = depth_days(headers)
    delta = F.col("depth_ft") - F.lag("depth_ft").over(w)
    return d.withColumn("depth_delta", delta).withColumn(
        "advance_ft", F.coalesce(F.greatest(F.col("depth_delta"), F.lit(0.0)), F.lit(0.0))
    ).withColumn("is_advance", F.col("advance_ft") > 0.1).withColumn(
        "is_hold", (F.coalesce("depth_delta", F.lit(0.0)) <= 0.1) & (F.row_number().over(w) > 1)
    )


def flat_days(headers: DataFrame, ops: DataFrame) -> DataFrame:
    """Days whose depth moved less than 1 ft, with the day's lost share."""
    w = Window.partitionBy("well_id").orderBy("report_date")
    d = depth_days(headers).withColumn(
        "depth_delta", F.abs(F.col("depth_ft") - F.lag("depth_ft").over(w))
    ).filter(F.col("depth_delta") < 1)
    return d.join(daily_npt(ops).select("well_id", "report_date", "npt_pct"), ["well_id", "report_date"], "left")


def flat_bucket(dominant_op: Column) -> Column:
    """Class of a flat day by its dominant op code."""
    expected, support, review = dims.FLAT_BUCKETS
    op = F.trim(dominant_op)
    return F.when(op.isin(dims.FLAT_EXPECTED), expected).when(op.isin(dims.FLAT_SUPPORT), support).otherwise(review)


def flat_day_classes(headers: DataFrame, ops: DataFrame) -> DataFrame:
    """N50: flat days as confirmed lost time or one of the three classes."""
    dom = dominant(ops, ["well_id", "report_date"], "op_code", "dominant_op")
    hrs = hours_by(ops, ["well_id", "report_date"]).select("well_id", "report_date", "total_h")
    return flat_days(headers, ops).join(dom, ["well_id", "report_date"], "left").join(
        hrs, ["well_id", "report_date"], "left"
    ).withColumn(
        "bucket", F.when(F.col("npt_pct") > 50, "NPT").when(F.col("npt_pct") <= 50, flat_bucket(F.col("dominant_op")))
    ).filter(F.col("bucket").isNotNull())


def flat_reconciliation(headers: DataFrame, ops: DataFrame) -> DataFrame:
    """N50: number of flat days per class."""
    return flat_day_classes(headers, ops).groupBy("well_id", "bucket").agg(F.count(F.lit(1)).alias("n_days"))


def flat_sections(headers: DataFrame, ops: DataFrame) -> DataFrame:
    """Runs of flat days at most one day apart, at least two days long."""
    w = Window.partitionBy("well_id").orderBy("report_date")
    gap = F.datediff("report_date", F.lag("report_date").over(w)) > 1
    runs = flat_days(headers, ops).withColumn("__g", F.when(gap, 1).otherwise(0)).withColumn(
        "run", F.sum("__g").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    sec = runs.groupBy("well_id", "run").agg(
        F.min("report_date").alias("d0"), F.max("report_date").alias("d1"),
        F.avg("npt_pct").alias("mean_npt"), F.avg("depth_ft").alias("mean_depth"),
    ).withColumn("n_days", F.datediff("d1", "d0") + 1).filter(F.col("n_days") >= 2)
    per_day = ops.groupBy("well_id", "report_date", "op_code", "npt_category", "is_npt").agg(F.sum(_dur()).alias("h"))
    s, p = sec.select("well_id", "run", "d0", "d1").alias("s"), per_day.alias("p")
    inside = s.join(
        p, (F.col("s.well_id") == F.col("p.well_id")) & F.col("p.report_date").between(F.col("s.d0"), F.col("s.d1"))
    )
    dom = inside.filter(F.col("op_code").isNotNull()).groupBy("s.well_id", "run", "op_code").agg(F.sum("h").alias("h")).groupBy(
        "well_id", "run"
    ).agg(F.min_by("op_code", F.struct(-F.col("h"), F.col("op_code"))).alias("dom_op"))
    cat = inside.filter(_lost()).groupBy("s.well_id", "run", "npt_category").agg(F.sum("h").alias("h")).groupBy(
        "well_id", "run"
    ).agg(F.min_by("npt_category", F.struct(-F.col("h"), F.col("npt_category"))).alias("dom_cat"))
    op = F.trim("dom_op")
    label = F.when(
        F.col("mean_npt") > 50,
        F.when(F.col("dom_cat").isNotNull(), F.concat(F.lit("NPT — "), npt.category_label(F.col("dom_cat")))).otherwise("NPT event"),
    ).when(op.isin(dims.FLAT_EXPECTED + dims.FLAT_SUPPORT), op).otherwise("No depth gain — needs review")
    return sec.join(dom, ["well_id", "run"], "left").join(cat, ["well_id", "run"], "left").select(
        "well_id", "d0", "d1", "n_days", "mean_depth", label.alias("label")
    )


def unflagged_flat_time(headers: DataFrame, ops: DataFrame) -> DataFrame:
    """Productive hours on flat days with at most 50 % lost time."""
    days = flat_days(headers, ops).filter(F.col("npt_pct") <= 50).select("well_id", "report_date")
    hrs = ops.filter(~_lost()).join(days, ["well_id", "report_date"], "left_semi").groupBy("well_id").agg(F.sum(_dur()).alias("hours"))
    n = days.groupBy("well_id").agg(F.count(F.lit(1)).alias("n_days"))
    return n.join(hrs, "well_id", "left").withColumn("hours", F.coalesce("hours", F.lit(0.0)))


def depth_reference(headers: DataFrame) -> DataFrame:
    """Straight line between first and last depth day, per day."""
    d = depth_days(headers).select("well_id", "report_date", "depth_ft")
    ends = d.groupBy("well_id").agg(
        F.min("report_date").alias("d0"), F.max("report_date").alias("d1"),
        F.min_by("depth_ft", "report_date").alias("z0"), F.max_by("depth_ft", "report_date").alias("z1"),
    )
    span = F.datediff("d1", "d0")
    frac = F.when(span > 0, F.datediff("report_date", "d0") / span).otherwise(0.0)
    return d.join(ends, "well_id").select(
        "well_id", "report_date", "depth_ft", (F.col("z0") + (F.col("z1") - F.col("z0")) * frac).alias("reference_ft")
    )


# -- campaign --------------------------------------------------------------


def campaign_kpis(ops: DataFrame, headers: DataFrame) -> DataFrame:
    """Days, hours, lost hours and share, greatest depth and cost per well."""
    o = ops.groupBy("well_id").agg(
        F.countDistinct("report_date").alias("n_days"), F.sum(_dur()).alias("total_h"), _npt_h().alias("npt_h")
    )
    h = typed_headers(headers).groupBy("well_id").agg(
        F.coalesce(F.max("end_depth_num"), F.lit(0.0)).alias("max_depth"),
        F.coalesce(F.max("cum_cost_num"), F.lit(0.0)).alias("cost"),
        F.countDistinct("report_date").alias("n_reports"),
    )
    return o.join(h, "well_id", "left").withColumn("npt_pct", pct("npt_h", "total_h"))


def phase_performance(ops: DataFrame) -> DataFrame:
    """Productive and lost hours per phase; denominator at least 1."""
    return hours_by(ops, ["well_id", "phase"]).select(
        "well_id", "phase", "total_h", "npt_h", "prod_h",
        F.bround(100 * F.col("npt_h") / F.greatest("total_h", F.lit(1.0)), 1).alias("npt_pct"),
    )


def takeaways(ops: DataFrame, min_phase_h: float = 24.0) -> DataFrame:
    """Primary cause, largest event, riskiest phase, repeat equipment issue per well."""
    ops = ordered.stored(ops.select("well_id", "seq", "report_date", "phase", "is_npt", "npt_category", "npt_cat_label", "duration_hr", "operation_text"))
    lost = ops.filter(_lost())
    cause = lost.groupBy("well_id", "npt_cat_label").agg(F.sum(_dur()).alias("h")).groupBy("well_id").agg(
        F.min_by("npt_cat_label", F.struct(-F.col("h"), F.col("npt_cat_label"))).alias("cause"), F.max("h").alias("cause_h")
    )
    event = lost.groupBy("well_id").agg(
        F.min_by(F.struct("operation_text", "duration_hr", "report_date"), F.struct(-_dur(), F.col("seq"))).alias("e")
    ).select("well_id", F.col("e.operation_text").alias("event_text"), F.col("e.duration_hr").alias("event_h"),
             F.col("e.report_date").alias("event_date"))
    risk = hours_by(ops, ["well_id", "phase"]).filter(F.col("total_h") >= min_phase_h).withColumn(
        "p", 100 * F.col("npt_h") / F.col("total_h")
    ).groupBy("well_id").agg(F.min_by("phase", F.struct(-F.col("p"), F.col("phase"))).alias("risk_phase"), F.max("p").alias("risk_pct"))
    sub = lost.filter(F.col("npt_category") == "equipment").withColumn("sub", npt.equipment_subtype(F.col("operation_text"))).filter(
        F.col("sub") != "Unspecified"
    ).groupBy("well_id", "sub").agg(F.sum(_dur()).alias("h"), F.count(F.lit(1)).alias("n")).groupBy("well_id").agg(
        F.min_by(F.struct("sub", "h", "n"), F.struct(-F.col("h"), F.col("sub"))).alias("s")
    ).filter(F.col("s.n") >= 2).select("well_id", F.col("s.sub").alias("issue"), F.col("s.h").alias("issue_h"), F.col("s.n").alias("issue_n"))
    return cause.join(event, "well_id", "left").join(risk, "well_id", "left").join(sub, "well_id", "left")


def equipment_repeats(ops: DataFrame) -> DataFrame:
    """H7: lost equipment hours and events per named sub-type."""
    return ops.filter(_lost() & (F.col("npt_category") == "equipment")).withColumn(
        "subtype", npt.equipment_subtype(F.col("operation_text"))
    ).filter(F.col("subtype") != "Unspecified").groupBy("well_id", "subtype").agg(
        F.sum(_dur()).alias("hours"), F.count(F.lit(1)).alias("n_events")
    )


def top_causes(ops: DataFrame, n: int = 5) -> DataFrame:
    """The largest lost-time causes per well with their share."""
    lost = ops.filter(_lost()).groupBy("well_id", "npt_cat_label").agg(F.sum(_dur()).alias("hours"))
    tot = lost.groupBy("well_id").agg(F.sum("hours").alias("__t"))
    return ordered.top_n_per(lost, ["well_id"], [F.desc("hours"), F.asc("npt_cat_label")], n).join(tot, "well_id").withColumn(
        "share_pct", 100 * F.col("hours") / F.col("__t")
    ).drop("__t")


def risk_flags(events: DataFrame, max_overpull: float = 100, max_ecd: float = 14.5) -> DataFrame:
    """Peak overpull and ECD, total losses and gas events against thresholds."""
    t, s = F.col("event_type"), F.col("sub_type")
    agg = events.agg(
        F.max(F.when(t == "overpull", F.col("force_klbs"))).alias("max_overpull"),
        F.max(F.when((t == "formation") & (s == "high_ecd"), F.col("ecd_ppge"))).alias("max_ecd"),
        F.count_if((t == "mud_loss") & (F.col("severity") == "total")).alias("n_total_losses"),
        F.count_if((t == "formation") & (s == "gas_influx")).alias("n_gas"),
    )
    return agg.select(
        "*",
        F.coalesce(F.col("max_overpull") > max_overpull, F.lit(False)).alias("flag_overpull"),
        F.coalesce(F.col("max_ecd") > max_ecd, F.lit(False)).alias("flag_ecd"),
        (F.col("n_total_losses") > 0).alias("flag_losses"), (F.col("n_gas") > 0).alias("flag_gas"),
    )


def major_days(ops: DataFrame, n: int = 8) -> DataFrame:
    """Largest (date, phase, cause) lost-time sums per well."""
    g = ops.filter(_lost()).groupBy("well_id", "report_date", "phase", "npt_cat_label").agg(F.sum(_dur()).alias("hours"))
    return ordered.top_n_per(
        g, ["well_id"], [F.desc("hours"), F.asc("report_date"), F.asc("npt_cat_label")], n
    )


def compare_wells(ops: DataFrame, headers: DataFrame, w1: str, w2: str) -> DataFrame:
    """Two wells' KPIs side by side, with deltas and the best phase saving."""
    k = campaign_kpis(ops, headers)
    cols = ["n_reports", "total_h", "npt_h", "npt_pct", "cost"]
    a = k.filter(F.col("well_id") == w1).select(*[F.col(c).alias(f"{c}_1") for c in cols])
    b = k.filter(F.col("well_id") == w2).select(*[F.col(c).alias(f"{c}_2") for c in cols])
    ph = ops.filter(F.col("well_id").isin(w1, w2)).groupBy("phase").agg(
        F.sum(F.when((F.col("well_id") == w1) & _lost(), _dur()).otherwise(0.0)).alias("a"),
        F.sum(F.when((F.col("well_id") == w2) & _lost(), _dur()).otherwise(0.0)).alias("b"),
        F.max(F.col("well_id") == w1).alias("ha"), F.max(F.col("well_id") == w2).alias("hb"),
    ).filter(F.col("ha") & F.col("hb")).withColumn("save", F.col("a") - F.col("b")).filter(F.col("save") > 0)
    best = ph.agg(F.min_by(F.struct("phase", "save"), F.struct(-F.col("save"), F.col("phase"))).alias("s")).select(
        F.col("s.phase").alias("best_phase"), F.col("s.save").alias("best_save_h")
    )
    return a.join(b).join(best).select(
        "*", (F.col("n_reports_1") - F.col("n_reports_2")).alias("days_delta"),
        (F.col("cost_1") - F.col("cost_2")).alias("cost_delta"), (F.col("npt_pct_1") - F.col("npt_pct_2")).alias("npt_delta"),
    )


def phase_by_well(ops: DataFrame, wells: Sequence[str]) -> DataFrame:
    """Lost share per phase, one column per well."""
    g = hours_by(ops.filter(F.col("well_id").isin(list(wells))), ["phase", "well_id"]).withColumn(
        "p", F.bround(100 * F.col("npt_h") / F.greatest("total_h", F.lit(1.0)), 1)
    )
    return g.groupBy("phase").pivot("well_id", list(wells)).agg(F.max("p")).na.fill(0.0)


def cause_comparison(ops: DataFrame, w1: str, w2: str, min_h: float = 5.0) -> DataFrame:
    """Causes as recurring, resolved or new between two wells."""
    g = ops.filter(_lost() & F.col("well_id").isin(w1, w2)).groupBy("npt_category").agg(
        F.sum(F.when(F.col("well_id") == w1, _dur()).otherwise(0.0)).alias("h1"),
        F.sum(F.when(F.col("well_id") == w2, _dur()).otherwise(0.0)).alias("h2"),
    ).filter((F.col("h1") >= min_h) | (F.col("h2") >= min_h))
    status = F.when((F.col("h1") > min_h) & (F.col("h2") > min_h), "recurring").when(F.col("h1") > min_h, "resolved").when(
        F.col("h2") > min_h, "new")
    return g.select(npt.category_label(F.col("npt_category")).alias("cause"), "h1", "h2", status.alias("status"))


def narrative_metrics(ops: DataFrame, headers: DataFrame, min_phase_h: float = 100.0) -> DataFrame:
    """One row of narrative figures per well."""
    ops = ordered.stored(ops.select("well_id", "report_date", "phase", "is_npt", "npt_category", "duration_hr"))
    ph = hours_by(ops, ["well_id", "phase"]).withColumn(
        "p", 100 * F.col("npt_h") / F.when(F.col("total_h") == 0, 1.0).otherwise(F.col("total_h"))
    )
    f = ph.groupBy("well_id").agg(
        F.min_by("phase", F.struct(-F.col("npt_h"), F.col("phase"))).alias("worst_phase"), F.max("npt_h").alias("worst_h"),
        F.min_by("phase", F.struct(-F.col("total_h"), F.col("phase"))).alias("dominant_phase"), F.max("total_h").alias("dominant_h"),
        F.min_by("phase", F.when(F.col("total_h") > min_phase_h, F.struct(F.col("p"), F.col("phase")))).alias("best_phase"),
        F.min(F.when(F.col("total_h") > min_phase_h, F.col("p"))).alias("best_pct"),
    )
    un = ops.filter(_lost() & ~F.col("npt_category").isin(dims.PROGRAMME_CATEGORIES)).join(
        f.select("well_id", F.col("worst_phase").alias("phase")), ["well_id", "phase"], "left_semi"
    ).groupBy("well_id", "npt_category").agg(F.sum(_dur()).alias("h")).groupBy("well_id").agg(
        F.min_by("npt_category", F.struct(-F.col("h"), F.col("npt_category"))).alias("c"), F.max("h").alias("primary_cause_h")
    ).select("well_id", npt.category_label(F.col("c")).alias("primary_cause"), "primary_cause_h")
    best = rolling_rate(ops).filter(F.col("rolling").isNotNull()).groupBy("well_id").agg(
        F.min_by("report_date", F.struct("rolling", "report_date")).alias("best_date"), F.min("rolling").alias("best_rate")
    )
    k = campaign_kpis(ops, headers).select("well_id", "n_days", "max_depth")
    return f.join(un, "well_id", "left").join(best, "well_id", "left").join(k, "well_id", "left")


def rolling_rate(ops: DataFrame) -> DataFrame:
    """Trailing 7-row mean of the daily lost-row rate, at least 3 rows."""
    d = ops.groupBy("well_id", "report_date").agg(F.avg(_lost().cast("double")).alias("rate"))
    w = Window.partitionBy("well_id").orderBy("report_date").rowsBetween(-6, 0)
    return d.withColumn("rolling", F.when(F.count("rate").over(w) >= 3, F.avg("rate").over(w)))


def time_sinks(ops: DataFrame, n: int = 10, recover: int = 3) -> DataFrame:
    """Largest single lost-time rows per well with shares."""
    lost = ops.filter(_lost())
    tot = lost.groupBy("well_id").agg(F.sum(_dur()).alias("__t"))
    top = ordered.top_n_per(
        lost.select("well_id", "seq", "report_date", "phase", "activity_code", "duration_hr", "npt_cat_label"),
        ["well_id"], [F.desc("duration_hr"), F.asc("seq")], n,
    )
    return top.join(tot, "well_id").withColumn("share_pct", 100 * _dur() / F.col("__t")).withColumn(
        "recoverable", F.col("rank") <= recover
    ).drop("__t")


def trip_cycles(ops: DataFrame, min_ops: int = 5, n: int = 5) -> DataFrame:
    """Days with at least ``min_ops`` trip rows, top ``n`` per well."""
    t = ops.filter(F.col("activity_code").isin(dims.TRIP_CODES))
    g = t.groupBy("well_id", "report_date").agg(
        F.count(F.lit(1)).alias("n_trips"), F.min_by("operation_text", F.struct("report_hour", "seq")).alias("first_text")
    ).filter(F.col("n_trips") >= min_ops)
    top = ordered.top_n_per(g, ["well_id"], [F.desc("n_trips"), F.asc("report_date")], n)
    return top.join(mode_by(t, ["well_id", "report_date"], "phase", "phase"), ["well_id", "report_date"], "left")


def recurring_causes(ops: DataFrame, min_phases: int = 3) -> DataFrame:
    """Causes with hours in at least ``min_phases`` phases."""
    g = ops.filter(_lost()).groupBy("well_id", "npt_category", "phase").agg(F.sum(_dur()).alias("h")).filter(F.col("h") > 0)
    return g.groupBy("well_id", "npt_category").agg(
        F.count(F.lit(1)).alias("n_phases"), F.sum("h").alias("hours")
    ).filter(F.col("n_phases") >= min_phases)


def overhead_share(ops: DataFrame, code: str = "SFTY") -> DataFrame:
    """Share of one activity code per phase with hours."""
    return ops.groupBy("well_id", "phase").agg(
        F.sum(F.when(F.col("activity_code") == code, _dur()).otherwise(0.0)).alias("code_h"), F.sum(_dur()).alias("total_h")
    ).filter(F.col("total_h") > 0).withColumn("share_pct", 100 * F.col("code_h") / F.col("total_h"))


def category_breakdown(ops: DataFrame) -> DataFrame:
    """Lost hours per category with share."""
    g = ops.filter(_lost()).groupBy("well_id", "npt_category").agg(F.sum(_dur()).alias("hours"))
    t = g.groupBy("well_id").agg(F.sum("hours").alias("__t"))
    return g.join(t, "well_id").select(
        "well_id", "npt_category", npt.category_label(F.col("npt_category")).alias("label"), "hours",
        F.bround(F.when(F.col("__t") != 0, 100 * F.col("hours") / F.col("__t")).otherwise(0.0), 1).alias("share_pct"),
    )


def hours_by_op_code(ops: DataFrame) -> DataFrame:
    """Hours per op code; blank codes are ``(unclassified)``."""
    code = F.coalesce(F.nullif(F.trim("op_code"), F.lit("")), F.lit("(unclassified)"))
    return hours_by(ops.withColumn("code", code), ["well_id", "code"]).withColumn(
        "npt_pct", F.col("npt_h") / F.when(F.col("total_h") == 0, 1.0).otherwise(F.col("total_h")) * 100
    )


def day_card(ops: DataFrame, headers: DataFrame, weather: DataFrame) -> DataFrame:
    """One row per well and day: hours, cost, phase, weather."""
    from fieldbook.functions import weather as wx

    k = ["well_id", "report_date"]
    cost = typed_headers(headers).groupBy(*k).agg(F.max("daily_cost_num").alias("cost"))
    w = weather.select("report_date", "wind_speed_kn", "wave_height_ft", wx.sea_state(F.col("wave_height_ft")).alias("sea_state"))
    return hours_by(ops, k).select(*k, "total_h", "npt_h").join(cost, k, "left").join(
        mode_by(ops, k, "phase", "phase"), k, "left"
    ).join(w, "report_date", "left")


def ops_log(
    ops: DataFrame, *, phase: str | None = None, npt_class: str | None = None, op_code: str | None = None,
    category: str | None = None, sea_state: str | None = None, text: str | None = None, d0=None, d1=None,
) -> DataFrame:
    """Operations-log filter; ``text`` is a case-insensitive pattern."""
    out, c = ops, F.col
    if phase:
        out = out.filter(c("phase") == phase)
    if npt_class == "Flagged NPT":
        out = out.filter(_lost())
    elif npt_class == "Normal operation":
        out = out.filter(~_lost())
    if op_code:
        out = out.filter(c("op_code") == op_code)
    if category:
        out = out.filter(c("npt_category") == category)
    if sea_state:
        out = out.filter(c("sea_state") == sea_state)
    if text:
        out = out.filter(F.coalesce(c("operation_text").rlike("(?i)" + text), F.lit(False)))
    if d0 is not None and d1 is not None:
        out = out.filter(c("report_date").between(F.lit(d0).cast("date"), F.lit(d1).cast("date")))
    return out


# -- cost, people, vessels -------------------------------------------------


def rolling_cost_median(headers: DataFrame) -> DataFrame:
    """Centred 7-row median of the daily cost, at least 3 rows.

    The frame holds at most seven rows; the window runs over one row per day."""
    h = typed_headers(headers).filter(F.col("daily_cost_num") > 0)
    w = Window.partitionBy("well_id").orderBy("report_date").rowsBetween(-3, 3)
    return h.select(
        "well_id", "report_date", "daily_cost_num",
        F.when(F.count("daily_cost_num").over(w) >= 3, F.percentile("daily_cost_num", F.lit(0.5)).over(w)).alias("rolling_median"),
    )


def cost_anomalies(headers: DataFrame, ops: DataFrame, factor: float = 1.6, bulk: float = 3.0, n: int | None = None) -> DataFrame:
    """Cost spikes with the day's dominant cause, one per (cause, month); the
    peak day itself is left out. ``n`` looks at the ``n`` dearest days of a well only (a chart's limit); by default at all."""
    c = rolling_cost_median(headers)
    stat = c.groupBy("well_id").agg(
        F.avg("daily_cost_num").alias("avg_cost"),
        F.min_by("report_date", F.struct(-F.col("daily_cost_num"), F.col("report_date"))).alias("peak_date"),
    )
    top = ordered.top_n_per(c, ["well_id"], [F.desc("daily_cost_num"), F.asc("report_date")], n).drop("rank") if n else c
    cause = dominant(ops.filter(_lost()), ["well_id", "report_date"], "npt_category", "cause")
    hrs = hours_by(ops, ["well_id", "report_date"]).select("well_id", "report_date", "total_h", "npt_h")
    spikes = top.join(stat, "well_id").filter(
        (F.col("daily_cost_num") >= factor * F.col("avg_cost")) & (F.col("report_date") != F.col("peak_date"))
    ).join(cause, ["well_id", "report_date"]).join(hrs, ["well_id", "report_date"], "left")
    kept = ordered.first_by(
        spikes.withColumn("month", F.month("report_date")), ["well_id", "cause", "month"],
        [-F.col("daily_cost_num"), F.col("report_date")],
    )
    return kept.select(
        "well_id", "report_date", "daily_cost_num", "cause",
        F.floor(100 * F.col("npt_h") / F.greatest("total_h", F.lit(1.0))).alias("npt_pct"),
        (F.col("daily_cost_num") > bulk * F.coalesce("rolling_median", "avg_cost")).alias("bulk"),
    )


def headcount_by_phase(headers: DataFrame, ops: DataFrame) -> DataFrame:
    """People on board per phase, with the peak day."""
    hc = headers.select("well_id", "report_date", F.col("head_count").try_cast("double").alias("n")).filter(F.col("n").isNotNull())
    j = hc.join(mode_by(ops, ["well_id", "report_date"], "phase", "phase"), ["well_id", "report_date"], "left")
    return j.filter(F.col("phase").isNotNull()).groupBy("well_id", "phase").agg(
        F.avg("n").alias("avg_pob"), F.min("n").alias("min_pob"), F.max("n").alias("peak_pob"),
        F.min_by("report_date", F.struct(-F.col("n"), F.col("report_date"))).alias("peak_date"), F.count(F.lit(1)).alias("n_days"),
    )


def company_by_phase(personnel: DataFrame, phases: Sequence[str], n: int = 10) -> DataFrame:
    """Mean head count of the ``n`` largest companies, one column per phase."""
    top = personnel.groupBy("company").agg(F.sum("n_people").alias("t")).orderBy(F.desc("t"), "company").limit(n).select("company")
    return personnel.join(top, "company", "left_semi").groupBy("company").pivot("phase", list(phases)).agg(
        F.avg("n_people")
    ).na.fill(0.0)


def visits_by_month(visits: DataFrame, month: Column, kind: str) -> DataFrame:
    """Visits per month and type, months without a visit as 0."""
    g = visits.withColumn("month", month).groupBy("month", kind).agg(F.count(F.lit(1)).alias("n"))
    months, kinds = g.select("month").distinct(), g.select(kind).distinct()
    return months.crossJoin(kinds).join(g, ["month", kind], "left").withColumn("n", F.coalesce("n", F.lit(0)))


# -- field rollup and planned time -----------------------------------------


def assign_well(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """First manifest entry (lowest ``ord``) whose prefix the id starts with.

    Prefixes are compared by equality on each prefix length present, so a large
    manifest joins by hash instead of by nested loop. The lengths are a short
    list (one value per distinct prefix length) read from the manifest."""
    lens = manifest.select(F.length("prefix").alias("n")).distinct()
    arr = lens.agg(F.collect_set("n").alias("lens"))  # at most one entry per prefix length
    keyed = docs.select("doc_id").distinct().join(arr).select(
        "doc_id", F.explode("lens").alias("n")
    ).select("doc_id", F.substring(F.col("doc_id"), F.lit(1), F.col("n")).alias("prefix"))
    hit = keyed.join(manifest, "prefix").groupBy("doc_id").agg(F.min_by("well", "ord").alias("well"))
    return docs.join(hit, "doc_id", "left").withColumn("well", F.coalesce("well", F.lit("Unknown")))


def planned_cumulative(planned: DataFrame) -> DataFrame:
    """Plausible cumulative lost share rows."""
    bad = (F.col("cumulative_npt_pct") > 95) & (F.coalesce("cumulative_hrs", F.lit(0.0)) > 500)
    return planned.filter(F.col("cumulative_npt_pct").isNotNull() & ~bad)


def npt_trajectory(planned: DataFrame) -> DataFrame:
    """Best row and days above 50 % per well."""
    p = planned_cumulative(planned)
    return p.groupBy("well_id").agg(
        F.min_by("report_date", F.struct("cumulative_npt_pct", "report_date")).alias("best_date"),
        F.min("cumulative_npt_pct").alias("best_pct"),
        F.count_if(F.col("cumulative_npt_pct") > 50).alias("n_above_50"), F.count(F.lit(1)).alias("n_rows"),
    )


def cumulative_npt(ops: DataFrame) -> DataFrame:
    """Running hours and lost share per well, day by day (input of N19)."""
    w = Window.partitionBy("well_id").orderBy("report_date").rowsBetween(Window.unboundedPreceding, 0)
    return hours_by(ops, ["well_id", "report_date"]).select(
        "well_id", "report_date", F.sum("total_h").over(w).alias("cumulative_hrs"),
        (100 * F.sum("npt_h").over(w) / F.sum("total_h").over(w)).alias("cumulative_npt_pct"),
    )


def unwrap_day(ops: DataFrame) -> DataFrame:
    """Start and end of each row on one axis per reporting day.

    A row that ends before it starts ends next day (+24). A start more than 12 h
    behind the previous row's end opens another 24 h turn; both sides carry the
    same offset, so the test needs only the neighbour and the offset is a
    running count of turns."""
    sh, eh = dates.report_hour(F.col("start_time")), dates.report_hour(F.col("end_time"))
    day = Window.partitionBy("well_id", "report_date").orderBy("sh", "seq")
    rel = ops.select("well_id", "report_date", "seq", sh.alias("sh"), eh.alias("eh")).withColumn(
        "er", F.when(F.col("eh") < F.col("sh"), F.col("eh") + 24.0).otherwise(F.col("eh"))
    )
    turn = rel.withColumn("t", F.when(F.col("sh") + 12 < F.lag("er").over(day), 1).otherwise(0)).withColumn(
        "off", 24.0 * F.sum("t").over(day.rowsBetween(Window.unboundedPreceding, 0))
    )
    return turn.select(
        "well_id", "report_date", "seq", (F.col("sh") + F.col("off")).alias("start_h"),
        (F.col("er") + F.col("off")).alias("end_h"), (F.col("er") - F.col("sh")).alias("dur_h"),
    )
