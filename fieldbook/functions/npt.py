"""Lost-time classification as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldbook import dims


@dataclass(frozen=True)
class CorpusRule:
    """Which rows are classified from their text rather than from a stored flag (H3)."""

    doc_pattern: str = r"(?i)^NorthSite-DDR-SITE-16A-78-32-"
    well_pattern: str = r"(?i)\bSITE-16A-78-32\b"
    field: str = "northsite"

    def member(self, doc_id: Column, wellbore: Column, field_name: Column) -> Column:
        return (
            F.coalesce(doc_id.rlike(self.doc_pattern), F.lit(False))
            | F.coalesce(wellbore.rlike(self.well_pattern), F.lit(False))
            | F.coalesce(F.lower(F.replace(field_name, F.lit(" "), F.lit(""))) == self.field, F.lit(False))
        )


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _joined(*cols: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[_text(c) for c in cols]))


def joined(*cols: Column) -> Column:
    """What the rules below read: the columns in one line."""
    return _joined(*cols)


def category(text: Column, op_code: Column, activity: Column, line: Column | None = None) -> Column:
    """H2: first matching rule group, else the op-code table, else ``other_npt``.

    One alternation per group keeps the expression at one branch per category. ``line``: the columns joined, where the
    caller has computed that already.
    """
    combined = _joined(text, op_code, activity) if line is None else line
    chain = F.when(combined == "", "other_npt")
    for name, patterns in dims.CATEGORY_PATTERNS:
        chain = chain.when(combined.rlike(dims.alternation(patterns)), name)
    code = F.upper(F.trim(_text(op_code)))
    for key, name in dims.OP_CODE_CATEGORY.items():
        chain = chain.when(code == key, name)
    return chain.otherwise("other_npt")


def classify_narrative(text: Column, op_code: Column, activity: Column, npt_code: Column) -> Column:
    """H1: struct(is_npt, category) read from the report text."""
    cat = narrative_category(text, op_code, activity, npt_code)
    return F.struct((cat != "productive").alias("is_npt"), cat.alias("category"))


def narrative_category(
    text: Column, op_code: Column, activity: Column, npt_code: Column, line: Column | None = None, codes: Column | None = None, short: Column | None = None,
) -> Column:
    """H1: category read from the report text. ``line``, ``codes`` and ``short`` are all columns, the two codes and all but
    the last joined, where the caller has computed that already."""
    combined = _joined(text, op_code, activity, npt_code) if line is None else line
    codes = _joined(op_code, activity) if codes is None else codes
    hit = {k: "(?i)" + p for k, p in dims.TROUBLE_PATTERNS.items()}
    return (
        F.when(combined == "", "productive")
        .when(F.upper(F.trim(_text(npt_code))).isin(dims.EXPLICIT_NPT_CODES), category(text, op_code, activity, short))
        .when(codes.rlike(hit["repair_code"]), "equipment")
        .when(combined.rlike(hit["wait_repairs"]), "equipment")
        .when(combined.rlike(hit["breakdown"]), "equipment")
        .when(combined.rlike(hit["downhole"]), "downhole_tools")
        .when(combined.rlike(hit["wellbore"]), "wellbore_condition")
        .when(combined.rlike(hit["fishing"]), "fishing")
        .when(combined.rlike(hit["waiting"]), "waiting_logistics")
        .when(combined.rlike(hit["explicit"]), "other_npt")
        .otherwise("productive")
    )


def category_label(cat: Column) -> Column:
    """H6: label of a category, itself when unknown."""
    pairs = [F.lit(x) for kv in dims.CATEGORY_LABELS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), cat), cat)


def equipment_subtype(text: Column) -> Column:
    """First equipment type the text names."""
    t = F.lower(_text(text))
    chain = None
    for label, pattern in dims.EQUIPMENT_SUBTYPES:
        chain = F.when(t.rlike(pattern), label) if chain is None else chain.when(t.rlike(pattern), label)
    return chain.otherwise("Unspecified")


def root_cause_key(cat: Column, description: Column) -> Column:
    """H8: category, refined to ``equipment:<subtype>`` where the text names one."""
    c = F.trim(_text(cat))
    sub = equipment_subtype(description)
    return F.when((c == "equipment") & (sub != "Unspecified"), F.concat(F.lit("equipment:"), sub)).otherwise(c)
