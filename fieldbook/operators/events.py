"""Events and measurements out of operation text.

One row becomes many through arrays of matches; the patterns run once per row
and nothing crosses rows before the final grouping.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook import dims
from fieldbook.operators import ordered, quantiles

# Event wording.
DEPTH = r"(?i)([\d,]+)\s*ft(?:OTH|MD|TVD)?(?:\b|,)"
KLBS = r"(?i)([\d]+(?:[–\-][\d]+)?(?:\.\d+)?)\s*[Kk]lbs?\b"
RESTRICT_FD = r"(?i)([\d]+(?:[–\-][\d]+)?)\s*[Kk]lbs?\s+(?:restriction|tight|packoff)\s+(?:at|@)\s*([\d,]+)\s*ft"
RESTRICT_D = r"(?i)(?:restriction|packoff|tight\s+spot)\s+(?:at|@)\s*([\d,]+)\s*ft"
TAG = r"(?i)tagged\s+\w+\s+at\s+([\d,]+)\s*ft\s+with\s+([\d]+(?:\.\d+)?)\s*[Kk]lbs?"
OVERPULL = r"(?i)([\d]+(?:[–\-][\d]+)?(?:\.\d+)?)\s*[Kk](?:lbs?)?\s+overpull|overpull\s+(?:of\s+)?([\d]+(?:\.\d+)?)\s*[Kk](?:lbs?)?"
OVERPULL_DEPTH = r"(?i)overpull\s+(?:at|to|from)\s+([\d,]+)\s*ft|([\d,]+)\s*ft[^.]{0,40}?overpull"
LATCHED = r"(?i)confirm(?:ed)?\s+(?:latched|engaged|landed)|lockdown\s+dogs"
LATCH_FORCE = r"(?i)\b[1-9]\s*[Kk]lbs?\s+overpull"
LOSS_RATE = (
    r"(?i)(?:loss\s+rate\s+of\s+[\d]+(?:[–\-][\d]+)?(?:\.\d+)?\s*bbls?(?:/hr)?|[\d]+(?:[–\-][\d]+)?\s*bbls?\s+loss(?:es)?|"
    r"observed\s+[\d]+(?:[–\-][\d]+)?\s*bbls?\s+loss)"
)
FULL_LOSS = r"(?i)(?:observed\s+)?full\s+loss(?:es)?|no\s+returns\b"
STATIC_LOSS = r"(?i)static\s+loss\s+rate\s+of\s+([\d.]+)\s*(?:bbls?/hr|gpm)"
LCM = r"(?i)\bLCM\b|lost\s+circulation\s+material"
NO_LOSS = (
    r"(?i)no\s+loss(?:es)?\s+observed|none\s+observed|loss\s+of\s+(?:signal|communication|contact|near.bit|inclination|"
    r"string\s+weight|comms|power|visibility)|monitoring\s+for\s+loss.*none\s+observed"
)
HIGH_ECD = r"(?i)(?:ECD[^.]{0,30}?[\d]{2}\.[\d]{2,3}\s*ppge?|[\d]{2}\.[\d]{2,3}\s*ppge?\s+(?:at|observed|ECD|at\s+PWD))"
FORMATION = [
    ("gas_influx", r"(?i)gas\s+(?:cut|influx|in\s+mud|on\s+shakers)|evacuate\s+gas\s+from\s+well|gas\s+(?:kick|bubble)|(?:high|elevated)\s+background\s+gas"),
    ("instability", r"(?i)wellbore\s+instab|caving|sloughing|spalling|heaving\s+(?:shale|formation)|unconsolidated\s+formation"),
    ("ballooning", r"(?i)ballooning|breathing\s+formation|wellbore\s+breathing"),
    ("diff_sticking", r"(?i)differential\s+st(?:ick|uck)|wall\s+stick|diff\s+st(?:ick|uck)"),
]
#: Plain words without which a pattern above cannot match.
FORMATION_WORDS = {"gas_influx": ["gas"], "instability": ["instab", "caving", "sloughing", "spalling", "heaving", "unconsolidated"], "ballooning": ["ballooning", "breathing"], "diff_sticking": ["diff", "wall"]}
CASED = r"(?i)inside casing|inside liner|inside 9-7/8|inside 7\"|inside the liner|cased hole|through tubing|inside completion|frac sleeve|ncs sleeve"
OPEN = r"(?i)open hole|below shoe|below casing shoe|in formation|rat hole|below 9-7/8|open-hole|below 13-3/8"
LINER = r"(?i)rih liner|set packer|liner hanger|running liner|liner deployment"
PHASE_HOLE = {"MIRU": "surface", "COND1": "open", "INTRM1": "open", "INTRM2": "open", "COMPZN": "cased"}

# Integrity and leak-off tests.
TEST = r"(?i)\b(?:dynamic\s+)?(?:FIT|DFIT|LOT|leak[\s\-]?off\s+test|formation\s+integrity\s+test)\b"
TEST_LIMIT = r"(?i)(1[2-6]\.\d{1,3})\s*ppge\b"
TEST_SHOE = r"(?i)(20\"\s*(?:shoe|conductor)|13[\-\s]3/8\"\s*(?:casing|shoe)|9[\-\s]7/8\"\s*(?:casing|liner|shoe)|7\"\s*(?:liner|shoe))"
TEST_PASS = r"(?i)good\s+(?:FIT|DFIT|LOT)|no\s+losses\s+observed|converge\s+to\s+stable"
TEST_INIT = r"(?i)until\s+divergen|diversion|leak[\s\-]?off|initiat"

# Measurement wording.
TRIP = r"(?i)(\d+)\s*ft/min"
TRIP_OPEN = r"(?i)\bopen\s*hole\b|\boh\b"
TRIP_CASED = r"(?i)\bcased\s*hole\b|\bcasing\b|\bliner\b|inside.*liner|through.*casing|\binside\s+\d+[\"′]|in\s+liner"
TRIP_PHASE = {"COND1": "OH", "INTRM1": "OH", "INTRM2": "OH", "COMPZN": "CH"}
ROP_INST = r"(?i)(?:instantaneous|inst\.?)\s+rop[^\d]{0,12}(\d+\.?\d*)\s*ft/h"
ROP_AVG = r"(?i)(?:average|avg\.?)\s+rop[^\d]{0,12}(\d+\.?\d*)\s*ft/h"
ROP_GEN = r"(?i)\brop\b[^\d]{0,12}(\d+\.?\d*)\s*ft/h"
JOINTS = r"(?i)(\d+\.?\d*)\s*(?:joints?|jts?|stands?)\s*/\s*hr"
WOB = r"(?i)\bwob\b[^\d]{0,6}(\d+\.?\d*)\s*klbs?"
FLOW = r"(?i)(\d{3,4})\s*gpm"
TUBING = r"(?i)\btubing\b|\bwash.?pipe\b|\b3-1/2\"\b|\b4-1/2\"\b|\b5-1/2\"\s+dp\b|\b5-1/2\"\s+tubing"
CASING = r"(?i)\bcasing\b|\bliner\b|\b20\"\b|\b13-3/8\"\b|\b9-7/8\"\b|\b7\"\b"
INTERVAL = r"(?i)(?:from|rih from)\s+([\d,]+)\s*ft[^.]{0,30}to\s+([\d,]+)\s*ft"

EVENT = "struct<event_type:string,sub_type:string,depth_ft:double,force_klbs:double,loss_volume_bbl:double,loss_rate_bbl_hr:double,severity:string,lcm_flag:boolean,ecd_ppge:double>"


def _t() -> Column:
    return F.col("operation_text")


def _num(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def _all(p: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_t(), F.lit(p), F.lit(group))


def range_value(raw: Column) -> Column:
    """``7-15`` counts as its upper bound."""
    return F.element_at(F.split(F.replace(raw, F.lit(","), F.lit("")), r"[–\-]"), -1).try_cast("double")


def depths() -> Column:
    """Depths between 50 and 30 000 ft."""
    return F.filter(F.transform(_all(DEPTH), _num), lambda v: v.between(50, 30000))


def _has(low: Column):
    """Whether one of some plain words stands in a lower-cased text: a pattern is tried only where its word does."""
    return lambda *words: functools.reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def hole_type(low: Column | None = None) -> Column:
    """By wording, else by phase."""
    t, has = _t(), _has(F.lower(_t()) if low is None else low)
    chain = F.when(has("inside", "cased", "tubing", "sleeve") & t.rlike(CASED), "cased").when(has("open", "below", "formation", "rat hole") & t.rlike(OPEN), "open")
    for ph, h in PHASE_HOLE.items():
        chain = chain.when(F.col("phase") == ph, h)
    return chain.when(F.col("phase") == "PROD1", F.when(has("liner", "packer") & t.rlike(LINER), "cased").otherwise("open")).otherwise("unknown")


def _event(kind: str, sub, depth=None, force=None, volume=None, rate=None, severity=None, lcm=None, ecd=None) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("event_type"), c(sub).alias("sub_type"), *[c(x).cast("double").alias(n) for x, n in (
        (depth, "depth_ft"), (force, "force_klbs"), (volume, "loss_volume_bbl"), (rate, "loss_rate_bbl_hr"))],
        c(severity).cast("string").alias("severity"), c(lcm).cast("boolean").alias("lcm_flag"), c(ecd).cast("double").alias("ecd_ppge"))


def _none() -> Column:
    return F.array().cast(f"array<{EVENT}>")


def _first_depth() -> Column:
    return F.get(F.col("__d"), 0)


def _forced() -> Column:
    z = F.arrays_zip(_all(RESTRICT_FD, 1).alias("f"), _all(RESTRICT_FD, 2).alias("d"))
    made = F.transform(z, lambda x: _event("restriction", "restriction", _num(x["d"]), range_value(x["f"])))
    return F.when(_t().rlike(RESTRICT_FD), made).otherwise(_none())


def spans(pattern: str) -> Column:
    """Matches of a pattern with their places: array of (m, s, e), from the lengths of what stands before them."""
    pieces, found = F.split(_t(), pattern, -1), _all(pattern, 0)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))

    def one(m: Column, i: Column) -> Column:
        s = total(F.slice(pieces, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))
        return F.struct(m.alias("m"), s.alias("s"), (s + F.length(m)).alias("e"))

    return F.transform(found, one)


def around(x: Column, width: int) -> Column:
    """The match with ``width`` characters on either side."""
    s = F.greatest(x["s"] - width, F.lit(0))
    return F.substring(_t(), s + 1, x["e"] + width - s)


def _group(text: Column, pattern: str, *groups: int) -> Column:
    """The first of the groups that took part in the first match; NULL without match."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups])


def _depth_only() -> Column:
    """Forced restrictions, then the mentions of a depth alone in their order, unless within 50 ft of an event so far."""
    made = F.transform(spans(RESTRICT_D), lambda x: _event(
        "restriction", "restriction", _num(F.regexp_extract(x["m"], RESTRICT_D, 1)), range_value(_group(around(x, 80), KLBS, 1))))
    near = lambda acc, x: F.exists(acc, lambda e: (e["depth_ft"] != 0) & (F.abs(e["depth_ft"] - x["depth_ft"]) < 50))
    folded = F.aggregate(made, _forced(), lambda acc, x: F.when(near(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return F.when(_t().rlike(RESTRICT_D), folded).otherwise(_forced())


def overpulls() -> Column:
    """I4: each overpull force with the depth named beside it, else the first plausible depth within 200 characters;
    small pulls that only confirm a latch are left out."""

    def one(x: Column) -> Column:
        named = _num(_group(around(x, 120), OVERPULL_DEPTH, 1, 2))
        parts = F.regexp_replace(around(x, 200), r"[.•\n]", "|")  # depths do not cross sentences
        plausible = F.filter(F.transform(F.regexp_extract_all(parts, F.lit(DEPTH), F.lit(1)), _num), lambda v: v.between(50, 30000))
        depth = F.coalesce(F.when(named.between(50, 30000), named), F.get(plausible, 0))
        return _event("overpull", "overpull", depth, range_value(_group(x["m"], OVERPULL, 1, 2)))

    made = F.filter(F.transform(spans(OVERPULL), one), lambda e: e["force_klbs"].isNotNull())
    minor = _t().rlike(LATCHED) & _t().rlike(LATCH_FORCE)
    return F.when(_t().rlike(OVERPULL) & ~minor, made).otherwise(_none())


def _tags() -> Column:
    z = F.arrays_zip(_all(TAG, 1).alias("d"), _all(TAG, 2).alias("f"))
    made = F.transform(z, lambda x: _event("restriction", "tag", _num(x["d"]), range_value(x["f"])))
    return F.when(_t().rlike(TAG), F.filter(made, lambda e: e["force_klbs"] >= 20)).otherwise(_none())


def restrictions() -> Column:
    """Force with depth, depth alone (not within 50 ft of an event so far; force within 80 characters), tags of at
    least 20 klbs, else a pack-off mention."""
    found = F.concat("__do", "__tg")
    pack = F.array(_event("restriction", "packoff", _first_depth()))
    return F.when((F.size(found) == 0) & F.col("__low").contains("packoff") & _t().rlike(r"(?i)\bpackoff\b"), pack).otherwise(found)


def _rated() -> Column:
    wide = "(?i)(" + LOSS_RATE.removeprefix("(?i)") + ")(?=(.{0,10}))"

    def one(x: Column) -> Column:
        v = range_value(F.regexp_extract(x["m"], r"([\d]+(?:[–\-][\d]+)?(?:\.\d+)?)", 1))
        return F.struct(v.alias("v"), (x["m"].rlike(r"(?i)loss\s+rate") | F.concat(x["m"], x["r"]).rlike(r"(?i)bbls?/hr")).alias("is_rate"))

    z = F.arrays_zip(_all(wide, 1).alias("m"), _all(wide, 2).alias("r"))
    return F.when(_t().rlike(LOSS_RATE), F.transform(z, one)).otherwise(F.array().cast("array<struct<v:double,is_rate:boolean>>"))


def losses() -> Column:
    """Full, rate or volume, static and LCM losses; negations are skipped."""
    t, d, lcm, full_hit = _t(), _first_depth(), F.col("__lcm"), F.col("__full")

    def rated(x: Column) -> Column:
        v, is_rate = x["v"], x["is_rate"]
        sev = F.when(v >= 50, "total").when(v >= 10, "partial").otherwise("seepage")
        return _event("mud_loss", F.when(is_rate, "rate").otherwise("volume"), d, volume=F.when(~is_rate, v), rate=F.when(is_rate, v), severity=sev, lcm=lcm)

    full = F.when(full_hit, F.array(_event("mud_loss", "full_losses", d, severity="total", lcm=lcm))).otherwise(_none())
    some = F.concat(full, F.transform("__rt", rated))
    empty = ~full_hit & (F.size("__rt") == 0)
    sv = F.col("__sv")
    static = F.array(_event("mud_loss", "static", d, rate=sv, severity=F.when(sv < 5, "seepage").otherwise("partial"), lcm=False))
    treat = F.array(_event("mud_loss", "lcm", d, severity="lcm_treatment", lcm=True))
    return F.when(empty & _has(F.col("__low"))("loss", "observed") & t.rlike(NO_LOSS), _none()).when(~empty, some).when(sv.isNotNull(), static).when(lcm, treat).otherwise(_none())


def formation() -> Column:
    """ECD above 11 ppge and formation wording."""
    ecd = F.filter(F.transform(F.transform(_all(HIGH_ECD, 0), lambda m: F.regexp_extract(m, r"([\d]{2}\.[\d]{2,3})\s*ppge?", 1).try_cast("double")),
                               lambda v: _event("formation", "high_ecd", _first_depth(), ecd=v)), lambda e: e["ecd_ppge"] > 11.0)
    has = _has(F.col("__low"))
    flags = F.array_compact(F.array(*[F.when(has(*FORMATION_WORDS[n]) & _t().rlike(p), _event("formation", n, _first_depth())) for n, p in FORMATION]))
    return F.concat(F.when(has("ecd"), ecd).otherwise(_none()), flags)


def extract_events(ops: DataFrame) -> DataFrame:
    """One row per event with hole type."""
    t = _t()
    has = _has(F.col("__low"))
    base = ordered.once(ops.filter(t.isNotNull()).select("seq", "report_date", "phase", "operation_text"), __low=F.lower(t))
    base = ordered.once(
        base, __d=F.when(has("ft"), depths()).otherwise(F.array().cast("array<double>")), hole_type=hole_type(F.col("__low")),
        __do=F.when(has("restriction", "tight", "packoff"), _depth_only()).otherwise(_none()), __op=F.when(has("overpull"), overpulls()).otherwise(_none()),
        __tg=F.when(has("tagged"), _tags()).otherwise(_none()), __rt=F.when(has("loss"), _rated()).otherwise(F.array().cast("array<struct<v:double,is_rate:boolean>>")),
        __full=has("loss", "returns") & t.rlike(FULL_LOSS), __lcm=has("lcm", "lost") & t.rlike(LCM), __sv=F.when(has("static"), F.regexp_extract(t, STATIC_LOSS, 1).try_cast("double")),
    )
    base = ordered.once(base, __found=F.concat(restrictions(), F.col("__op"), losses(), formation()))
    return base.select("seq", "report_date", "phase", "hole_type", F.inline("__found"))


def assemble(events: DataFrame, header_depth: DataFrame) -> DataFrame:
    """Header depth as fallback, then the first event per (date, phase,
    type, sub-type, 20 ft bucket, force); a missing depth is its own bucket."""
    j = events.join(header_depth, "report_date", "left").withColumn("depth_ft", F.coalesce("depth_ft", "header_depth_ft"))
    b = j.withColumn("bucket", F.bround(F.coalesce("depth_ft", F.lit(-1.0)) / 20.0, 0))
    keys = ["report_date", "phase", "event_type", "sub_type", "bucket", "force_klbs"]
    return ordered.first_by(b, keys, ["seq", "depth_ft", "loss_rate_bbl_hr", "ecd_ppge"])


def summary(events: DataFrame) -> DataFrame:
    """Counts and ranges per type."""
    return events.groupBy("event_type", "sub_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("depth_ft").alias("min_depth"), F.max("depth_ft").alias("max_depth"),
        F.max("force_klbs").alias("max_force"), F.max("loss_rate_bbl_hr").alias("max_rate"), F.max("ecd_ppge").alias("max_ecd"),
        F.count_if(F.col("hole_type") == "open").alias("n_open"), F.count_if(F.col("hole_type") == "cased").alias("n_cased"))


def fit_lot(ops: DataFrame) -> DataFrame:
    """Integrity tests; each trigger takes the nearest limit, a limit counts once per row and once per (date,
    phase), the earliest row first."""
    t = _t()
    limits = F.transform(spans(TEST_LIMIT), lambda x: F.struct(x["s"].alias("s"), F.regexp_extract(x["m"], TEST_LIMIT, 1).try_cast("double").alias("v")))
    kind = lambda m: F.when(F.upper(m).contains("LOT"), "LOT").when(F.upper(m).contains("DFIT"), "DFIT").otherwise("FIT")

    def one(x: Column) -> Column:
        middle = F.floor((x["s"] + x["e"]) / 2)
        near = F.array_min(F.transform("__lim", lambda p: F.struct(F.abs(p["s"] - middle).alias("gap"), p["s"].alias("s"), p["v"].alias("v"))))
        return F.struct(kind(x["m"]).alias("test_type"), near["v"].alias("limit_ppge"))

    base = ordered.once(ops.filter(t.rlike(TEST) & t.rlike(TEST_LIMIT)), __lim=limits)
    base = ordered.once(base, __tests=F.transform(spans(TEST), one))
    once = F.filter("__tests", lambda x, i: ~F.exists(F.slice("__tests", F.lit(1), i), lambda y: y["limit_ppge"] == x["limit_ppge"]))
    result = F.when(t.rlike(TEST_INIT), "initiation").when(t.rlike(TEST_PASS), "pass").otherwise("unknown")
    rows = base.select("seq", "report_date", "phase", result.alias("result"), _group(t, TEST_SHOE, 1).alias("casing_shoe"), F.posexplode(once).alias("pos", "x"))
    rows = rows.select("seq", "report_date", "phase", "pos", "x.test_type", "x.limit_ppge", "result", "casing_shoe")
    return ordered.first_by(rows, ["report_date", "phase", "limit_ppge"], ["seq", "pos"])


def trip_speed(ops: DataFrame) -> DataFrame:
    """Trip speeds up to 500 ft/min with the hole named within 40 characters, else in the row, else by phase."""
    by_text = lambda c: F.when(c.rlike(TRIP_OPEN) & ~c.rlike(TRIP_CASED), "OH").when(c.rlike(TRIP_CASED) & ~c.rlike(TRIP_OPEN), "CH")
    by_phase = F.lit(None).cast("string")
    for phase, hole in TRIP_PHASE.items():
        by_phase = F.when(F.col("phase") == phase, hole).otherwise(by_phase)
    whole = F.coalesce(by_text(_t()), by_phase, F.lit("unknown"))
    made = F.transform(spans(TRIP), lambda x: F.struct(F.regexp_extract(x["m"], TRIP, 1).try_cast("double").alias("value"), F.coalesce(by_text(around(x, 40)), whole).alias("hole_type")))
    rows = ops.filter(_t().rlike(TRIP)).select(
        "seq", "phase", _num(F.regexp_extract(_t(), INTERVAL, 1)).alias("depth_from_ft"), _num(F.regexp_extract(_t(), INTERVAL, 2)).alias("depth_to_ft"), F.inline(made))
    return rows.filter(F.col("value").between(1, 500))


def metrics(ops: DataFrame) -> DataFrame:
    """Penetration rate, running speed, bit weight, flow with the depth interval."""
    def vals(p: str, kind, unit: str, lo: float, hi: float) -> Column:
        k = kind if isinstance(kind, Column) else F.lit(kind)
        a = F.transform(_all(p), lambda v: F.struct(k.alias("metric_type"), v.try_cast("double").alias("value"), F.lit(unit).alias("unit")))
        return F.filter(a, lambda x: (x["value"] >= lo) & (x["value"] <= hi))

    tiny = 1e-9
    kind = "array<struct<metric_type:string,value:double,unit:string>>"
    # A pattern is tried only where its plain word stands in the text.
    where = lambda word, found: F.when(F.col("__low").contains(word), found).otherwise(F.array().cast(kind))
    ops = ordered.once(ops.filter(_t().isNotNull()), __low=F.lower(_t()))
    ops = ordered.once(ops, __own=where("rop", F.concat(vals(ROP_INST, "rop_inst", "ft/hr", tiny, 2000), vals(ROP_AVG, "rop_avg", "ft/hr", tiny, 2000))))
    rop = F.when(F.size("__own") > 0, F.col("__own")).otherwise(where("rop", vals(ROP_GEN, "rop_gen", "ft/hr", tiny, 2000)))
    run = F.when(_t().rlike(TUBING), "tubing_speed").when(_t().rlike(CASING), "casing_speed").otherwise("running_speed")
    every = F.concat(rop, where("hr", vals(JOINTS, run, "joints/hr", tiny, 200)), where("wob", vals(WOB, "wob", "klbs", tiny, 100)), where("gpm", vals(FLOW, "flow_rate", "gpm", 100, 2000)))
    return ops.select("seq", "report_date", "phase", _num(F.regexp_extract(_t(), INTERVAL, 1)).alias("depth_from_ft"),
                      _num(F.regexp_extract(_t(), INTERVAL, 2)).alias("depth_to_ft"), F.inline(every))


def metric_summary(m: DataFrame) -> DataFrame:
    """I16: count, range, median and 90th percentile per type and phase."""
    k = ["metric_type", "phase"]
    m = ordered.stored(m.groupBy(*k, "value").agg(F.count(F.lit(1)).alias("times")))  # the texts are read once
    a = m.groupBy(*k).agg(F.sum("times").alias("n"), F.min("value").alias("min_v"), F.max("value").alias("max_v"))
    return a.join(quantiles.exact_quantiles(m, k, "value", {"p50": 0.5, "p90": 0.9}, weight="times"), k)


def decisions(ops: DataFrame, limit: int = 2) -> DataFrame:
    """First decision sentences longer than 20 characters per row."""
    s = F.filter(F.transform(F.split(_t(), r"[.•\n]"), lambda x: F.trim(x)), lambda x: x.rlike("(?i)" + dims.DECISION_PATTERN) & (F.length(x) > 20))
    return ops.select("seq", "phase", F.posexplode(F.slice(s, 1, limit)).alias("pos", "sentence"))
