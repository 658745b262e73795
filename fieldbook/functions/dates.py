"""Date and clock expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def report_date(text: Column) -> Column:
    """ISO text is read as ISO; anything else day first, then month first and the other common forms."""
    t = F.trim(text.cast("string"))
    iso = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    day_first = F.coalesce(
        F.try_to_date(t, "d/M/yyyy"), F.try_to_date(t, "d.M.yyyy"), F.try_to_date(t, "d-M-yyyy"),
        F.try_to_date(t, "d MMM yyyy"), F.try_to_date(t, "d MMMM yyyy"),
    )
    other = F.coalesce(*[F.try_to_date(t, f) for f in ("M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd HH:mm:ss")])
    return F.when(iso, F.try_to_date(t, "yyyy-M-d")).otherwise(F.coalesce(day_first, other))


def header_date(text: Column) -> Column:
    """Month-first or ISO header date as ISO text, empty when unreadable."""
    t = F.trim(F.coalesce(text, F.lit("")))
    # Accepted header formats, in order.
    formats = ["M/d/yyyy", "M/d/yy", "yyyy-M-d", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy"]
    parsed = F.coalesce(*[F.try_to_date(t, f) for f in formats])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lit(""))


def clock_hours(hhmm: Column) -> Column:
    """``HH:MM`` as hours; anything unreadable is 0."""
    t = F.trim(hhmm)
    h = F.regexp_extract(t, r"^(\d+):(\d+)", 1).try_cast("double")
    m = F.regexp_extract(t, r"^(\d+):(\d+)", 2).try_cast("double")
    return F.coalesce(h + m / 60.0, F.lit(0.0))


def report_hour(hhmm: Column) -> Column:
    """Hours since 06:00 in [0, 24), the order inside a reporting day."""
    return F.pmod(clock_hours(hhmm) - 6.0, F.lit(24.0))


def shift_block(hhmm: Column) -> Column:
    """Six-hour block of the start hour."""
    h = F.element_at(F.split(hhmm, ":", 2), 1).try_cast("int")
    return (
        F.when(h.isNull(), "unknown")
        .when(h < 6, "00:00-06:00").when(h < 12, "06:00-12:00")
        .when(h < 18, "12:00-18:00").otherwise("18:00-00:00")
    )


def filename_year(name: Column) -> Column:
    """C4: years in a file name; the first two joined by a dash."""
    years = F.regexp_extract_all(name, F.lit(r"((?:19|20)\d{2})"), 1)
    return (
        F.when(F.size(years) >= 2, F.concat_ws("-", F.get(years, 0), F.get(years, 1)))
        .when(F.size(years) == 1, F.get(years, 0))
    )


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def year_range(text: Column) -> Column:
    """``2022-23``, ``2022-2023`` or ``2022 to 2023``, in that order."""
    t = F.translate(F.trim(F.regexp_replace(text, r"\s+", " ")), "–—", "--")
    short = r"\b((?:19|20)\d{2})\s*[-/]\s*(\d{2})\b"
    full = r"\b((?:19|20)\d{2})\s*-\s*((?:19|20)\d{2})\b"
    words = r"\b((?:19|20)\d{2})\s*(?:to|TO)\s*((?:19|20)\d{2})\b"
    return F.coalesce(*[
        F.concat(_group(t, p, 1), F.lit("-"), _group(t, p, 2)) for p in (short, full, words)
    ])


def period_end(text: Column) -> Column:
    """Date of ``period ended D Month YYYY`` as ISO text."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    p = r"(?i)\bperiod\s+ended\s+(\d{1,2})\s+([A-Za-z]+)\s+((?:19|20)\d{2})\b"
    month = F.initcap(F.lower(_group(t, p, 2)))
    spelled = F.concat_ws(" ", _group(t, p, 1), month, _group(t, p, 3))
    return F.date_format(F.when(month.isNotNull(), F.try_to_date(spelled, "d MMMM yyyy")), "yyyy-MM-dd")
