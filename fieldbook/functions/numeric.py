"""Numbers out of report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_number(text: Column) -> Column:
    """C11: digits and points of the first token as a number."""
    first = F.get(F.split(F.trim(text.cast("string")), r"\s+"), F.lit(0))
    return F.regexp_replace(first, r"[^\d.]", "").try_cast("double")


def first_number(text: Column) -> Column:
    """First number without thousands commas, as text; empty when none."""
    return F.replace(F.coalesce(F.regexp_substr(text, F.lit(r"\d[\d,]*(?:\.\d+)?")), F.lit("")), F.lit(","), F.lit(""))


def cell_number(text: Column) -> Column:
    """Numeric cell; trailing unit dropped, ``14.950`` is 14 950."""
    t = F.regexp_replace(F.trim(text), r"\.+$", "")
    t = F.regexp_replace(t, r"(?i)\s*(ppg|psi|ft|m|kips|klbs|lb/ft|in|bbl)\b.*", "")
    t = F.replace(F.trim(t), F.lit(","), F.lit(""))
    return F.when(t.rlike(r"^\d+\.\d{3}$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t).try_cast("double")


def grams(text: Column) -> Column:
    """First ``n g``; one point with three digits marks thousands."""
    raw = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)\s*g", 1)
    return F.when(raw.rlike(r"^\d+\.\d{3}$"), F.replace(raw, F.lit("."), F.lit(""))).otherwise(raw).try_cast("double")


NUMERIC_CELL = r"^\(?-?\d[\d,]*(?:\.\d+)?\)?%?$"


def table_number(text: Column) -> Column:
    """C14: struct(value, is_percent); ``(1,234)`` is negative, other text null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    v = F.replace(F.regexp_replace(t, r"^[()%]+|[()%]+$", ""), F.lit(","), F.lit("")).try_cast("double")
    v = F.when(t.startswith("(") & t.endswith(")"), -v).otherwise(v)
    ok = t.rlike(NUMERIC_CELL) & v.isNotNull()
    return F.struct(F.when(ok, v).alias("value"), (ok & t.endswith("%")).alias("is_percent"))


def key_norm(text: Column) -> Column:
    """Lower-case key with underscores."""
    t = F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def quarter(text: Column) -> Column:
    """First of q1..q4 that occurs."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("q1"), "q1").when(t.contains("q2"), "q2").when(t.contains("q3"), "q3").when(t.contains("q4"), "q4")


def dimension(text: Column) -> Column:
    """C17: percent, currency or count."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike("%|percent"), "percent").when(t.rlike(r"£|\$|eur|usd"), "currency").otherwise("count")


def multiplier(text: Column) -> Column:
    """Scale named by the text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    tight = F.regexp_replace(t, r"\s+", "")
    num = r"(?<![a-z])[-+]?\d+(?:\.\d+)?\s*"
    return (
        F.when(tight.rlike(r"£000|\(\$000\)|usd000|eur000|\(000\)|\[000\]") | t.rlike(r"\b(thousand|thousands)\b") | t.rlike(num + r"k\b"), 1e3)
        .when(t.rlike(num + r"m\b") | t.rlike(r"\b(mn|million|millions)\b"), 1e6)
        .when(t.rlike(num + r"bn\b") | t.rlike(r"\b(billion|billions)\b"), 1e9)
        .otherwise(1.0)
    )


def normalized(text: Column) -> Column:
    """struct(value, dimension, multiplier); null without a number."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    raw = F.regexp_substr(F.replace(t, F.lit(","), F.lit("")), F.lit(r"[-+]?\d+(?:\.\d+)?")).try_cast("double")
    neg = t.rlike(r"\(\s*[-+]?\d[\d,]*(?:\.\d+)?\s*\)")
    v = F.when(neg & (raw > 0), -raw).otherwise(raw)
    return F.when(v.isNotNull(), F.struct((v * multiplier(t)).alias("value"), dimension(t).alias("dimension"), multiplier(t).alias("multiplier")))


# Words allowed inside a bare figure.
FIGURE_WORDS = "m|mn|bn|million|millions|billion|billions|thousand|thousands|percent|percentage|eur|usd"


def is_bare_figure(text: Column) -> Column:
    """C20: a short figure without prose."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))
    fine = F.size(F.filter(words, lambda w: ~w.rlike(f"^(?:{FIGURE_WORDS})$"))) == 0
    rest = F.trim(F.regexp_replace(t, r"[\d\s,.\-+£$()%/a-zA-Z]", ""))
    return (t != "") & (F.length(t) <= 64) & fine & (rest == "") & normalized(t).isNotNull()


def canonical_figure(text: Column) -> Column:
    """C20: figure printed with separators, at most two decimals, unit sign."""
    n = normalized(text)
    v, d = n["value"], n["dimension"]

    def body(x: Column) -> Column:
        whole = x == F.floor(x)
        return F.when(whole, F.format_number(x, 0)).otherwise(F.regexp_replace(F.format_number(x, 2), r"\.?0+$", ""))

    sign = F.when(v < 0, "-").otherwise("")
    pct = F.concat(sign, F.replace(body(F.abs(v)), F.lit(","), F.lit("")), F.lit("%"))
    return F.when(n.isNull(), None).when(d == "percent", pct).when(d == "currency", F.concat(sign, F.lit("£"), body(F.abs(v)))).otherwise(
        F.concat(sign, body(F.abs(v))))


def _in_months(months: list[int]):
    return lambda d: F.month(d).isin(months)


def compact_date(token: Column, prefer: dict[int, list[int]] | None = None) -> Column:
    """``mddyyyy`` with unpadded month and day.

    All splits of the part before the year are tried; ``prefer`` names months that
    win for a year, otherwise the first valid split counts."""
    # Preferred months of the campaign.
    prefer = {2020: [10, 11, 12], 2021: [1]} if prefer is None else prefer
    ok = token.rlike(r"^\d{6,}$")
    year = F.substring(token, -4, 4).try_cast("int")
    head = F.substring(token, F.lit(1), F.greatest(F.length(token) - 4, F.lit(0)))
    splits = F.sequence(F.lit(1), F.greatest(F.length(head) - 1, F.lit(1)))
    days = F.filter(
        F.transform(splits, lambda i: F.try_to_date(
            F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.substring(head, F.lit(1), i).try_cast("int").cast("string"), 2, "0"),
                        F.lpad(F.substring(head, i + 1, F.length(head)).try_cast("int").cast("string"), 2, "0")), "yyyy-MM-dd")),
        lambda d: d.isNotNull(),
    )
    out = F.get(days, 0)
    for y, months in prefer.items():
        out = F.when(year == y, F.coalesce(F.get(F.filter(days, _in_months(months)), 0), out)).otherwise(out)
    return F.when(ok, out)
