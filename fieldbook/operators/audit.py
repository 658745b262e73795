"""File-name audit and document selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import numeric, text
from fieldbook.operators import ordered

# The two file-name layouts.
NAME_A = (
    r"(?i)^([A-Za-z0-9_-]+)\s+(DDR)\s+(\d+)\s*([A-Za-z][A-Za-z0-9_-]*)\s+(RB|R\d+)\s+(\d{2}\.\d{2}\.\d{4})(\.*)\.pdf$"
)
NAME_B = (
    r"(?i)^North_Site_(SITE_16A_[\[(]\d+[\])]-\d+)_([A-Za-z]+)-C_(\d{6,16})(?:_(\d{6,8}))?_(\d+)(_\d+)?_(reporttmp|tmp)( 2)?\.pdf$"
)
RECORD = [
    "source_filename", "parsed", "safe_doc_id", "rig", "report_type", "ddr_number", "asset_or_project",
    "wellbore_suffix", "wellbore", "block_wellbore", "report_date", "date_text", "file_size_bytes", "warnings", "parse_error",
]


@dataclass(frozen=True)
class CompactNames:
    """Parameters of the compact-date layout: names and first campaign day."""

    rig: str = "NorthSite"
    asset: str = "SITE"
    suffix: str = "16A-78-32"
    wellbore: str = "SITE-16A-78-32"
    first_day: str = "2020-10-21"


def _warn(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def _groups(name: Column, pattern: str, n: int) -> Column:
    """All capture groups of one match as an array."""
    sep = "\u0001"
    return F.split(F.regexp_replace(name, pattern, sep.join(f"${i}" for i in range(1, n + 1))), sep)


def parse_filenames(files: DataFrame, block_id: str = "00/00a", b: CompactNames = CompactNames()) -> DataFrame:
    """One manifest row per file; the layout that matches first wins.

    Three stages, each evaluated once per row: layout and groups, dates, record."""
    c, n = F.col, F.col("source_filename")
    layout = F.when(~n.rlike(r"(?i)\.pdf$"), "x").when(n.rlike(NAME_B), "b").when(n.rlike(NAME_A), "a").otherwise("n")
    g = ordered.once(files.select("source_filename", "file_size_bytes"), layout=layout)
    g = ordered.once(g, g=F.when(c("layout") == "b", _groups(n, NAME_B, 8)).when(c("layout") == "a", _groups(n, NAME_A, 7)))
    grp = lambda i: F.get(c("g"), i - 1)

    # Layout B: a doubled date blob is one date twice.
    blob, second = grp(3), grp(4)
    half = (F.length(blob) / 2).cast("int")
    doubled = (second == "") & (F.length(blob) % 2 == 0) & (F.substring(blob, F.lit(1), half) == F.substring(blob, half + 1, half))
    is_b = c("layout") == "b"
    t = ordered.once(
        g, t1=F.when(is_b, F.when(doubled, F.substring(blob, F.lit(1), half)).otherwise(blob)),
        t2=F.when(is_b, F.when(doubled, F.substring(blob, F.lit(1), half)).when(second != "", second)),
    )
    t = ordered.once(
        t, d1=F.when(is_b, numeric.compact_date(c("t1"))).otherwise(F.try_to_date(F.when(c("layout") == "a", grp(6)), "dd.MM.yyyy")),
        d2=F.when(c("t2").isNotNull(), numeric.compact_date(c("t2"))),
    )
    d1, d2 = c("d1"), c("d2")
    bad_b = d1.isNull() | (c("t2").isNotNull() & d2.isNull())
    rec_b = F.struct(
        (~bad_b).alias("parsed"),
        F.when(~bad_b, F.concat(F.lit(f"{b.rig}-DDR-{b.wellbore}-"), F.initcap(F.lower(grp(2))), F.lit("-"), d1.cast("string"), F.lit("-R"),
                                F.format_string("%03d", grp(5).try_cast("int")), F.lit("-"), text.short_hash(n))).alias("safe_doc_id"),
        F.lit(b.rig).alias("rig"), F.lit("DDR").alias("report_type"),
        (F.datediff(d1, F.lit(b.first_day).cast("date")) + 1).cast("bigint").alias("ddr_number"), F.lit(b.asset).alias("asset_or_project"),
        F.lit(b.suffix).alias("wellbore_suffix"), F.lit(b.wellbore).alias("wellbore"), F.lit(b.wellbore).alias("block_wellbore"),
        d1.alias("report_date"), F.when(second != "", F.concat_ws("_", blob, second)).otherwise(blob).alias("date_text"),
        _warn((d1 != d2, "filename_start_end_date_mismatch"), (grp(8) != "", "filename_copy_marker"),
              (grp(6) != "", "filename_source_revision_marker")).alias("warnings"),
        F.when(bad_b, "invalid_compact_date").otherwise("").alias("parse_error"),
    )
    asset, suffix = F.upper(grp(4)), F.upper(grp(5))
    num = grp(3).try_cast("bigint")
    rec_a = F.struct(
        F.lit(True).alias("parsed"),
        F.concat_ws("-", text.slug(grp(1)), F.lit("DDR"), F.when(num < 1000, F.lpad(num.cast("string"), 3, "0")).otherwise(num.cast("string")),
                    text.slug(asset), text.slug(suffix), d1.cast("string")).alias("safe_doc_id"),
        grp(1).alias("rig"), F.upper(grp(2)).alias("report_type"), num.alias("ddr_number"), asset.alias("asset_or_project"),
        suffix.alias("wellbore_suffix"), F.concat_ws("-", asset, suffix).alias("wellbore"),
        (F.concat(F.lit(block_id + "-"), suffix) if block_id else F.lit("")).alias("block_wellbore"),
        d1.alias("report_date"), grp(6).alias("date_text"),
        _warn((grp(7) != "", "extra_dot_before_pdf_extension"), (n.rlike(r"\bDDR\s+\d+[A-Za-z]"), "missing_space_after_ddr_number")).alias("warnings"),
        F.lit("").alias("parse_error"),
    )
    empty = F.lit("")
    none = F.struct(
        F.lit(False).alias("parsed"), empty.alias("safe_doc_id"), empty.alias("rig"), F.lit("DDR").alias("report_type"),
        F.lit(None).cast("bigint").alias("ddr_number"), empty.alias("asset_or_project"), empty.alias("wellbore_suffix"),
        empty.alias("wellbore"), empty.alias("block_wellbore"), F.lit(None).cast("date").alias("report_date"), empty.alias("date_text"),
        F.array().cast("array<string>").alias("warnings"),
        F.when(c("layout") == "x", "unsupported_file_extension").otherwise("filename_does_not_match_expected_ddr_pattern").alias("parse_error"),
    )
    rec = F.when(is_b, rec_b).when(c("layout") == "a", rec_a).otherwise(none)
    return t.select("source_filename", "file_size_bytes", F.inline(F.array(rec))).select(*RECORD)


def _issue(df: DataFrame, severity, kind, message) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        lit(severity).alias("severity"), lit(kind).alias("issue_type"), lit(message).alias("message"),
        "source_filename", "safe_doc_id", "ddr_number", F.coalesce(F.col("report_date").cast("string"), F.lit("")).alias("report_date"), "wellbore",
    )


def duplicate_issues(parsed: DataFrame, field: str, kind: str, severity) -> DataFrame:
    """one issue per record whose key occurs more than once.

    Group sizes are counted with map-side combine and joined back, so the records
    of a frequent key are never gathered in one place."""
    key = F.col(field)
    keyed = parsed.filter(key.isNotNull() & (key.cast("string") != ""))
    dup = keyed.groupBy(field).agg(F.count(F.lit(1)).alias("n_same")).filter("n_same > 1")
    hit = keyed.join(dup, field)
    return _issue(hit, severity, kind, F.concat(F.lit(f"Duplicate {field}="), key.cast("string"), F.lit(": "), F.col("n_same").cast("string"), F.lit(" files")))


def numbered(parsed: DataFrame) -> DataFrame:
    """One record per report number (the last file name wins)."""
    p = parsed.filter(F.col("ddr_number").isNotNull() & F.col("report_date").isNotNull())
    rest = [c for c in p.columns if c != "ddr_number"]
    return p.groupBy("ddr_number").agg(F.max_by(F.struct(*rest), "source_filename").alias("r")).select("ddr_number", "r.*")


def _span(one: DataFrame) -> DataFrame:
    """First number and date, last number (one row)."""
    return one.agg(F.min("ddr_number").alias("n0"), F.max("ddr_number").alias("n1"), F.min_by("report_date", "ddr_number").alias("d0"))


def sequence_mismatches(parsed: DataFrame) -> DataFrame:
    """reports whose date differs from the date their number implies."""
    one = numbered(parsed)
    j = one.join(F.broadcast(_span(one)))  # a single row
    want = F.date_add("d0", (F.col("ddr_number") - F.col("n0")).cast("int"))
    return j.filter(F.col("report_date") != want).select(
        "ddr_number", "source_filename", "safe_doc_id", "wellbore", "report_date", want.alias("expected_date")
    )


def missing_reports(parsed: DataFrame, width: int = 1000) -> DataFrame:
    """Numbers between first and last without a report, with both
    neighbours and an inferred file name.

    Each present number opens its own gap up to the next present one, so the
    missing numbers come from the gaps rather than from one long sequence, and
    neighbours need no search."""
    one = numbered(parsed).withColumn("__b", F.floor(F.col("ddr_number") / width))
    here = F.struct("ddr_number", "rig", "asset_or_project", "wellbore_suffix", "wellbore", "block_wellbore", "source_filename")
    prev = ordered.lag_across(one, [], "__b", ["ddr_number"], here, "prev", coarser=F.floor(F.col("__b") / width))
    gaps = prev.filter(F.col("ddr_number") - F.col("prev.ddr_number") > 1)
    span = _span(numbered(parsed))
    # A gap is cut into pieces first: one mistyped number must not become one huge array.
    last = F.col("ddr_number") - 1
    pieces = gaps.select(F.explode(F.sequence(F.col("prev.ddr_number") + 1, last, F.lit(width).cast("long"))).alias("lo"), last.alias("last"), "prev", "source_filename")
    rows = pieces.select(
        F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + width - 1, F.col("last")))).alias("number"),
        "prev", F.col("source_filename").alias("next_source_filename"),
    ).join(F.broadcast(span))
    date = F.date_add("d0", (F.col("number") - F.col("n0")).cast("int"))
    p = lambda c: F.col(f"prev.{c}")
    return rows.select(
        F.lit("warning").alias("severity"), F.lit("missing_report").alias("issue_type"),
        F.col("number").alias("expected_ddr_number"), date.alias("expected_report_date"),
        p("rig").alias("rig"), p("asset_or_project").alias("asset_or_project"), p("wellbore_suffix").alias("wellbore_suffix"),
        p("wellbore").alias("wellbore"), p("block_wellbore").alias("block_wellbore"),
        F.concat(F.concat_ws(" ", p("rig"), F.lit("DDR"), F.col("number").cast("string"), p("asset_or_project"), p("wellbore_suffix"),
                             F.date_format(date, "dd.MM.yyyy")), F.lit(".pdf")).alias("inferred_filename"),
        p("source_filename").alias("previous_source_filename"), "next_source_filename",
    )


def issues(records: DataFrame, free_rig: str = CompactNames.rig) -> DataFrame:
    """all issues; ``free_rig`` may repeat numbers and dates (warning only).

    Row-level issues come from one pass over the records joined with the key
    counts; only missing reports need their own branch. ``records`` is read
    several times and should be stored (``ordered.stored``)."""
    c = F.col
    free = c("rig") == free_rig
    parsed = records.filter("parsed").withColumn("free", free)
    # Numbers and ids grow with the files, and their sizes can't be told from the plan: their counts are never broadcast.
    # One row a number holds both counts and the last file.
    of_no = parsed.groupBy("ddr_number").agg(
        F.count_if("free").alias("n_free"), F.count_if(~c("free")).alias("n_rest"),
        F.max(F.when(c("report_date").isNotNull(), c("source_filename"))).alias("last_file"))
    n_dt = parsed.groupBy("free", "report_date").agg(F.count(F.lit(1)).alias("n_dt"))
    n_id = parsed.groupBy("safe_doc_id").agg(F.count(F.lit(1)).alias("n_id"))
    # Files that did not parse have no keys; they stay out of the joins, where all would meet under NULL.
    known = (
        parsed.join(n_id.hint("merge"), "safe_doc_id", "left").join(of_no.hint("merge"), "ddr_number", "left")
        .join(n_dt, ["free", "report_date"], "left").withColumn("n_no", F.when(c("free"), c("n_free")).otherwise(c("n_rest")))
    )
    j = known.unionByName(records.filter(~F.coalesce("parsed", F.lit(False))), allowMissingColumns=True).join(
        F.broadcast(_span(numbered(parsed.drop("free")))))  # a single row
    want = F.date_add("d0", (c("ddr_number") - c("n0")).cast("int"))
    sev = F.when(c("free"), "warning").otherwise("error")

    def one(cond: Column, severity: Column, kind: str, message: Column) -> Column:
        return F.when(cond, F.struct(severity.alias("severity"), F.lit(kind).alias("issue_type"), message.alias("message")))

    def dup(n: str, key: str) -> Column:
        return F.concat(F.lit(f"Duplicate {key}="), c(key).cast("string"), F.lit(": "), c(n).cast("string"), F.lit(" files"))

    err = F.lit("error")
    fixed = F.array_compact(F.array(
        one(~c("parsed"), err, "unparsed_filename", c("parse_error")),
        one(c("file_size_bytes") <= 0, err, "pdf_file_quality", F.lit("zero_byte_file")),
        one(c("n_no") > 1, sev, "duplicate_ddr_number", dup("n_no", "ddr_number")),
        one(c("n_dt") > 1, sev, "duplicate_report_date", dup("n_dt", "report_date")),
        one(c("parsed") & (c("n_id") > 1), err, "duplicate_safe_doc_id", dup("n_id", "safe_doc_id")),
        one((c("last_file") == c("source_filename")) & (c("report_date") != want), err, "date_sequence_mismatch", F.concat(
            F.lit("DDR "), c("ddr_number").cast("string"), F.lit(" has date "), c("report_date").cast("string"),
            F.lit("; expected "), want.cast("string"), F.lit(" from sequence."))),
    ))
    warned = F.transform("warnings", lambda w: F.struct(
        F.lit("warning").alias("severity"), w.alias("issue_type"), F.replace(w, F.lit("_"), F.lit(" ")).alias("message")))
    rows = j.select("source_filename", "safe_doc_id", "ddr_number", "report_date", "wellbore", F.inline(F.concat(fixed, warned)))
    out = _issue(rows, c("severity"), c("issue_type"), c("message"))
    ms = missing_reports(records.filter("parsed")).select(
        c("expected_ddr_number").alias("ddr_number"), c("expected_report_date").alias("report_date"), "wellbore",
        F.lit("").alias("source_filename"), F.lit("").alias("safe_doc_id"))
    return out.unionByName(_issue(ms, "warning", "missing_report", F.concat(
        F.lit("Missing DDR "), c("ddr_number").cast("string"), F.lit(" for "), c("report_date").cast("string"),
        F.lit(" ("), c("wellbore"), F.lit(")."))))


def summary(records: DataFrame, found: DataFrame) -> DataFrame:
    """F8: one row of counts and ranges."""
    r = records.agg(
        F.count(F.lit(1)).alias("pdf_count"), F.count_if("parsed").alias("parsed_count"), F.count_if(~F.col("parsed")).alias("unparsed_count"),
        F.min(F.when(F.col("parsed"), F.col("report_date"))).alias("date_range_start"), F.max(F.when(F.col("parsed"), F.col("report_date"))).alias("date_range_end"),
        F.min(F.when(F.col("parsed"), F.col("ddr_number"))).alias("ddr_number_min"), F.max(F.when(F.col("parsed"), F.col("ddr_number"))).alias("ddr_number_max"),
    )
    i = found.agg(
        F.count_if(F.col("severity") == "error").alias("blocking_issue_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count_if(F.col("issue_type") == "missing_report").alias("missing_report_count"),
    )
    return r.join(i)


def counts(df: DataFrame, key: str) -> DataFrame:
    """Value counts, the map columns of the summary."""
    return df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def canonical_copies(records: DataFrame) -> DataFrame:
    """the preferred file per (rig, wellbore, date)."""
    has = lambda w: F.array_contains("warnings", w).cast("int")
    order = [has("filename_copy_marker"), F.col("source_filename").contains("[").cast("int"), has("filename_source_revision_marker"),
             -F.coalesce("file_size_bytes", F.lit(0)), F.col("source_filename")]
    return ordered.first_by(records.filter(F.col("parsed") & F.col("report_date").isNotNull()), ["rig", "wellbore", "report_date"], order)


def gap_blocks(reports: DataFrame, width: int = 1000) -> DataFrame:
    """consecutive missing numbers as one block with what lies on both sides.

    ``reports`` has number, report_date, phase, depth and summary per report."""
    r = reports.withColumn("__b", F.floor(F.col("number") / width))
    side = F.struct("number", "report_date", "phase", "depth", "summary")
    j = ordered.lag_across(r, ["well_id"], "__b", ["number"], side, "p").filter(F.col("number") - F.col("p.number") > 1)
    pb, pa = F.coalesce(F.col("p.phase"), F.lit("")), F.coalesce(F.col("phase"), F.lit(""))
    return j.select(
        "well_id", (F.col("p.number") + 1).alias("first_missing"), (F.col("number") - 1).alias("last_missing"),
        (F.col("number") - F.col("p.number") - 1).alias("num_missing"), F.col("p.report_date").alias("date_before"),
        F.col("report_date").alias("date_after"), pb.alias("phase_before"), pa.alias("phase_after"),
        ((pb != pa) & (pb != "") & (pa != "")).alias("cross_phase"), F.col("p.depth").alias("depth_before"), F.col("depth").alias("depth_after"),
        F.col("p.summary").alias("summary_before"), F.col("summary").alias("summary_after"),
    )


def split_combined(pages: DataFrame, number_pattern: str, date_pattern: str, marker_pattern: str, width: int = 1000) -> DataFrame:
    """page range of each report inside a combined document: the first page
    per report number that shows number, date and a marker near its top."""
    t = F.col("clean_text")
    no = F.regexp_extract(t, number_pattern, 1).try_cast("bigint")
    hit = pages.withColumn("report_no", no).withColumn("date_text", F.translate(F.regexp_extract(t, date_pattern, 1), "/-", "..")).filter(
        F.col("report_no").isNotNull() & (F.col("date_text") != "") & F.substring(t, 1, 800).rlike(marker_pattern)
    )
    starts = hit.groupBy("doc_id", "report_no").agg(F.min("page").alias("page_start"), F.min_by("date_text", "page").alias("date_text"))
    last = pages.groupBy("doc_id").agg(F.max("page").alias("__last"))
    # Reversed order turns "next start" into a lag.
    rev = starts.withColumn("__r", -F.col("page_start")).withColumn("__b", F.floor(F.col("__r") / width))
    nxt = ordered.lag_across(rev, ["doc_id"], "__b", ["__r", "report_no"], F.col("page_start"), "__next")
    return nxt.join(last, "doc_id").select(
        "doc_id", "report_no", "date_text", "page_start", F.coalesce(F.col("__next") - 1, F.col("__last")).alias("page_end")
    )


def detect_profile(files: DataFrame, profiles: list[tuple[str, str]], default: str) -> DataFrame:
    """first profile, by name, whose file-name pattern matches."""
    chain = None
    for name, pattern in sorted(profiles):
        hit = F.col("source_filename").rlike(pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return files.withColumn("profile", chain.otherwise(default) if chain is not None else F.lit(default))
