"""Small lookups and vocabulary checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import text


def label_of(code: Column, labels: dict[str, str]) -> Column:
    """Label of a code, the trimmed code itself when unknown."""
    c = F.trim(F.coalesce(code, F.lit("")))
    if not labels:
        return c
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(known, c), c)


def report_no_by_date(headers: DataFrame, order: str = "doc_id") -> DataFrame:
    """The number of the last document of each date in the order of ingest, a column (ties: by id)."""
    return headers.groupBy("report_date").agg(F.max_by("report_no", F.struct(order, "doc_id") if order != "doc_id" else F.col("doc_id")).alias("report_no"))


def frequent_ngrams(rows: DataFrame, n: int = 2, min_count: int = 8) -> DataFrame:
    """Word n-grams of at least ``min_count`` occurrences; grams are made inside
    a row and counted with map-side combine."""
    w = F.regexp_extract_all(F.lower(F.coalesce("operation_text", F.lit(""))), F.lit("[a-z][a-z'-]+"), F.lit(0))
    r = rows.select(w.alias("w")).filter(F.size("w") >= n)
    g = r.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("gram"))
    out = g.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    return out


def valid_citations(citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Citations whose (chunk, page) was retrieved."""
    pages = retrieved.select("query_id", "chunk_key", F.explode(text.pages_list(F.col("pages"))).alias("page"))
    return citations.join(pages, ["query_id", "chunk_key", "page"], "left_semi")
