"""Status of numbered sleeves from operation text."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.operators import ordered

# Patterns of what is reported on a sleeve, how many sleeves there are, least proppant that counts, fluid that needs a reason.
SLEEVE = r"(?i)sleeve\s*#?\s*(\d+)"
OPEN_AT = r"(?i)sleeve\s*#?\s*\d+\s+open\s+at\s+([\d,]+)\s*psi"
BREAKOVER = r"(?i)breakover\s+at\s+([\d,]+)\s*psi"
CONFIRMED = r"(?i)NCS\s+confirm(?:ed)?\s+sleeve\s+open|sleeve\s+confirm(?:ed)?\s+open"
INJECTED = r"(?i)inject(?:ed)?\s+([\d,]+\.?\d*)\s*bbls?"
STAGE = r"(?i)staged?\s+(?:up\s+)?(?:rate|flowrate)\s+to\s+([\d.]+)\s*bpm[,\s]+([\d,]+)\s*psi"
NO_SIGN = r"(?i)no\s+positive\s+indication|unable\s+to\s+(?:locate|open|find)|no\s+indication\s+of\s+(?:the\s+)?sleeve"
PACKER = r"(?i)packer\s+not\s+seal(?:ing)?|packer\s+did\s+not\s+set|packer\s+not\s+set|integrity\s+(?:not\s+)?(?:confirmed|achieved)"
ISIP = r"(?i)ISIP\D{0,20}?([\d,]+)\s*psi"
PROPPANT = r"(?i)([\d,]+)\s*lbs?\s+(?:of\s+)?(?:2/40|100[\s-]*mesh|proppant|sand\b|resin)"
FLUID = r"(?i)([\d,]+)\s*bbls?\s+(?:of\s+)?(?:clean\s+pad|linear\s+gel|crosslink|gel\s+pad|pad)"
MAIN_FRAC = r"(?i)main\s+frac|carried\s+out\s+(?:main\s+)?frac"
LOCATED = r"(?i)packer set|packer confirmed|located into sleeve|sleeve located"
SLEEVES, LEAST_LBS, MUCH_BBL = 18, 1000, 20


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def _numbers(c: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), _number)


def _total(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x))


def sleeve_folds(ops: DataFrame, report_nos: DataFrame, sleeves: int = SLEEVES) -> DataFrame:
    """What was reported on each sleeve of each well, before review.

    ``ops``: well_id, seq, report_date, page, operation_text; ``report_nos``: report_date, report_no. The status machine is
    mergeable: an opening wins whenever it comes, else the first of the other events does; a packer that fails counts only
    before the first opening. So the fold is one aggregate, rows in any order, and no well is put in order."""
    c, t, low = F.col, F.col("__t"), F.col("__low")
    # A pattern is tried only where its plain word stands in the text.
    has = lambda *words: functools.reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    ops = ordered.once(ops, __t=F.coalesce("operation_text", F.lit("")))
    ops = ordered.once(ops, __low=F.lower("__t")).filter(has("sleeve"))
    each = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(SLEEVE), F.lit(1)), lambda n: n.try_cast("int"))), lambda n: n.between(1, sleeves))
    first = lambda word, pattern: F.when(has(word), F.get(_numbers(t, pattern), F.lit(0)))
    main = has("frac") & t.rlike(MAIN_FRAC)
    rows = ordered.once(
        ops, __each=each, __main=main, __open=first("open", OPEN_AT), __open_at=has("open") & t.rlike(OPEN_AT), __fails=has("packer", "integrity") & t.rlike(PACKER))
    rows = rows.filter(F.size("__each") > 0).select(
        "well_id", "report_date", "page", F.struct("report_date", "page", "seq").alias("at"), F.explode("__each").alias("sleeve_no"),
        c("__open").alias("open_psi"), (c("__open_at") | (has("confirm") & t.rlike(CONFIRMED))).alias("opens"), first("breakover", BREAKOVER).alias("breakover_psi"), first("isip", ISIP).alias("isip_psi"),
        F.when(has("inject"), _total(_numbers(t, INJECTED))).alias("vol"), F.when(c("__main"), _total(F.filter(_numbers(t, PROPPANT), lambda x: x > LEAST_LBS))).alias("lbs"), F.when(c("__main"), _total(_numbers(t, FLUID))).alias("fluid"),
        F.when(has("stage"), F.array_max(_numbers(t, STAGE))).alias("rate"), F.when(has("stage"), F.array_max(_numbers(t, STAGE, 2))).alias("treat"), c("__fails").alias("fails"),
        F.when(has("indication", "unable") & t.rlike(NO_SIGN), "NO INDICATION").when(c("__fails") | (has("packer", "located") & t.rlike(LOCATED)), "LOCATED").alias("other"))
    rows = ordered.stored(rows)  # read for the fold and for the failures before an opening
    key = ["well_id", "sleeve_no"]
    cite = F.struct("report_date", "page")
    agg = rows.groupBy(*key).agg(
        F.min(F.when(c("opens"), c("at"))).alias("opened"), F.min_by("other", F.when(c("other").isNotNull(), c("at"))).alias("other"),
        F.min("open_psi").alias("open_psi"), F.max("breakover_psi").alias("breakover_psi"), F.max("isip_psi").alias("isip_psi"), F.max("treat").alias("max_treat_psi"), F.max("rate").alias("max_rate_bpm"),
        F.sum("vol").alias("vol_injected_bbl"), F.sum("lbs").alias("proppant_lbs_total"), F.sum("fluid").alias("fluid_vol_bbl"),
        F.min("report_date").alias("first_date"), F.max("report_date").alias("last_date"), F.min_by(cite, F.when(c("report_date").isNotNull(), c("at"))).alias("cite"))
    fails = rows.filter("fails").join(agg.select(*key, "opened"), key).filter(c("opened").isNull() | (c("at") < c("opened"))).groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("fails"))
    nos = report_nos.select(F.col("report_date").alias("first_date"), F.col("report_no").cast("string").alias("no"))
    out = agg.join(fails, key, "left").join(nos, "first_date", "left")
    status = F.when(c("opened").isNotNull(), "OPENED").otherwise(F.coalesce("other", F.lit("NOT FRACKED")))
    dot = F.lit(" · ")
    where = F.concat(F.lit("DDR-"), F.coalesce("no", F.lit("?")), dot, F.lit("p."), F.coalesce(c("cite.page").cast("string"), F.lit("?")), dot, c("first_date").cast("string"))
    return out.select(
        *key, status.alias("status"), "open_psi", "breakover_psi", "isip_psi", "max_treat_psi", "max_rate_bpm", "vol_injected_bbl", "proppant_lbs_total", "fluid_vol_bbl", "first_date", "last_date",
        F.coalesce(where, F.lit("")).alias("ddr_citation"), F.coalesce("fails", F.lit(0)).alias("packer_issues"))


def sleeve_status(folds: DataFrame, wells: DataFrame, sleeves: int = SLEEVES) -> DataFrame:
    """One row for each sleeve of each well (``wells``: well_id), with proppant taken as an opening and reasons to review."""
    c = F.col
    every = wells.select("well_id").distinct().withColumn("sleeve_no", F.explode(F.sequence(F.lit(1), F.lit(sleeves))))
    rows = every.join(folds, ["well_id", "sleeve_no"], "left")
    treated = F.coalesce(c("proppant_lbs_total") > 0, F.lit(False))
    before = F.coalesce("status", F.lit("NOT FRACKED"))
    inferred = treated & (before != "OPENED")
    rows = rows.withColumns({"status": F.when(inferred, "OPENED").otherwise(before), "inferred": inferred, "treated": treated})
    status, much = c("status"), F.coalesce(c("vol_injected_bbl"), F.lit(0.0))
    reasons = F.array_compact(F.array(
        F.when(c("treated") & c("open_psi").isNull() & (status == "OPENED"), "OPENED inferred from proppant injection only — no opening pressure in DDR text"),
        F.when((status == "OPENED") & c("open_psi").isNotNull() & ~c("treated"), "Opening pressure recorded but no proppant volume extracted — check DDR for frac design"),
        F.when((much > MUCH_BBL) & status.isin("NO INDICATION", "LOCATED"), F.concat(F.lit("Fluid injected ("), F.bround(much, 0).cast("long").cast("string"), F.lit(" bbl) but sleeve not confirmed open"))),
        F.when((status == "LOCATED") & (F.coalesce("open_psi", F.lit(0.0)) == 0) & (much == 0), "Packer located but no opening/failure outcome recorded — incomplete DDR coverage")))
    notes = F.concat(F.array_repeat(F.lit("packer sealing issue"), F.coalesce("packer_issues", F.lit(0))), F.when(c("inferred"), F.array(F.lit("proppant injected — sleeve confirmed open"))).otherwise(F.array().cast("array<string>")))
    day = lambda n: F.date_format(n, "dd/MM/yyyy").alias(n)
    return rows.select(
        "well_id", "sleeve_no", "status", "open_psi", "breakover_psi", "isip_psi", "max_treat_psi", "max_rate_bpm", "vol_injected_bbl", "proppant_lbs_total", "fluid_vol_bbl", day("first_date"), day("last_date"),
        F.coalesce("ddr_citation", F.lit("")).alias("ddr_citation"), F.array_join(notes, "; ").alias("notes"), (F.size(reasons) > 0).alias("review_flag"), F.array_join(reasons, " | ").alias("review_reason"))
