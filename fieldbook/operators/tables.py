"""Tables inside pages, chunk bounds and result logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: rows that close a table; a report's own foot lines are further patterns of the caller.
TRAILING = [r"(?i)total\s+ho?u?rs?"]


def row_text(cells: Sequence[str]) -> Column:
    """Non-blank cells of a row, joined by a blank."""
    parts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells])
    return F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), " ")


def clean_rows(rows: DataFrame, table: Sequence[str], cells: Sequence[str], order: str = "row_no") -> DataFrame:
    """Trimmed cells without blank rows; ``is_header`` marks the first row of a table of two rows or more if over half
    of its cells are words rather than numbers. Decided by aggregates, so a long table is not gathered."""
    t = rows.withColumns({c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cells})
    t = t.filter(" OR ".join(f"`{c}` <> ''" for c in cells))
    wordy = sum((((F.col(c) != "") & ~F.regexp_replace(F.col(c), "[,.-]", "").rlike(r"^\d+$")).cast("int") for c in cells), F.lit(0))
    head = t.groupBy(*table).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    j = t.join(head, list(table))
    return j.withColumn("is_header", (F.col("__n") > 1) & (F.col(order) == F.col("__first")) & (wordy / len(cells) > 0.5)).drop("__n", "__first")


def drop_trailing(rows: DataFrame, cells: Sequence[str], patterns: Sequence[str] = TRAILING) -> DataFrame:
    """Rows without the closing ones."""
    text = row_text(cells)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return rows.filter(~hit)


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))


def markdown_rows(tables: DataFrame, body: str = "table_md") -> DataFrame:
    """(…, row_no, header, cells) of pipe tables; the header stands before the first rule line, short rows are filled up.

    One table is one row; its lines are cut inside the row."""
    lines = F.filter(F.split(F.coalesce(F.col(body), F.lit("")), r"\r\n|\n|\r"), lambda x: x.contains("|"))
    rule = lambda x: F.forall(_cells(x), lambda c: c.rlike("^[-: ]*-[-: ]*$"))
    keep = [c for c in tables.columns if c != body]
    t = tables.select(*keep, lines.alias("__l")).withColumn("__at", F.array_position(F.transform("__l", rule), True).cast("int"))
    t = t.filter(F.col("__at") > 1)
    t = t.select(*keep, _cells(F.element_at("__l", F.col("__at") - 1)).alias("header"), F.transform(F.filter(F.slice("__l", F.col("__at") + 1, F.size("__l")), lambda x: ~rule(x)), _cells).alias("__r"))
    width = F.greatest(F.size("header"), F.coalesce(F.array_max(F.transform("__r", lambda r: F.size(r))), F.lit(1)))
    fill = lambda a, n: F.slice(F.concat(a, F.array_repeat(F.lit(""), n)), 1, n)
    t = t.withColumn("__w", width)
    return t.select(*keep, fill(F.col("header"), F.col("__w")).alias("header"), "__w", F.posexplode("__r").alias("row_no", "r")).select(
        *keep, "row_no", "header", fill(F.col("r"), F.col("__w")).alias("cells"))


def page_bound(chunks: DataFrame, allowed: bool = False) -> DataFrame:
    """Number of chunks over several pages, and whether that is allowed."""
    bad = F.count_if(F.col("page_start") != F.col("page_end"))
    return chunks.agg(bad.alias("n_multi_page"), (F.lit(allowed) | (bad == 0)).alias("ok"))


def section_diagnostics(labels: DataFrame) -> DataFrame:
    """K8: pages, share covered by contents, share overridden and share without subsection, per document."""
    n = F.count(F.lit(1))
    return labels.groupBy("doc_id").agg(
        n.alias("n_pages"), (F.count_if("covered") / n).alias("coverage"), (F.count_if("overridden") / n).alias("override_rate"),
        (F.count_if(F.lower(F.coalesce("subsection_title", F.lit("unknown"))).isin("", "unknown")) / n).alias("unknown_pct"))


def listing(rows: DataFrame, page: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a page (or of all), in order, up to a limit."""
    out = rows.filter(F.col("page") == page) if page is not None else rows
    out = out.orderBy("doc_id", "page")
    return out.limit(limit) if limit is not None else out


def generation_counters(log: DataFrame) -> DataFrame:
    """Outcomes, citations and derived rates of a result log; an unknown status counts as an error."""
    known = ["ok", "skipped", "insufficient_evidence"]
    s = F.col("status")
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("parsed", "valid", "rejected")}
    a = log.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(s == k).alias(k) for k in known], F.count_if(~F.coalesce(s, F.lit("")).isin(known)).alias("error"),
        *[v.alias(k) for k, v in sums.items()], F.sum("latency_ms").alias("latency"))
    rate = lambda c: F.when(F.col("parsed") > 0, F.col(c) / F.col("parsed"))
    return a.select("total", *known, "error", "parsed", "valid", "rejected", rate("valid").alias("valid_rate"), rate("rejected").alias("rejected_rate"),
                    F.when(F.col("total") > 0, F.col("latency") / F.col("total")).alias("mean_latency"))
