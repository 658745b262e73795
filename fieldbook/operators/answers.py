"""Numeric answers: figures in retrieved chunks, scored against the question."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import numeric
from fieldbook.operators import ordered

# What a figure looks like, the words around questions and figures that count, and the weights of the score.
FIGURE = (
    r"(?:£\s*)?(?:\(\s*)?[-+]?\d[\d,]*(?:\.\d+)?(?:\s*\))?"
    r"(?:\s*(?:\((?:£)?000\)|%|percent(?:age)?|k|m|bn|million|millions|billion|billions|thousand|thousands))?"
)
YEARS = r"(?:19|20)\d{2}/\d{1,2}|\d{1,2}/(?:19|20)\d{2}"
SKIPPED = [
    "what", "which", "who", "where", "when", "why", "how", "much", "many", "did", "does", "do", "was", "were", "is", "are", "the", "for", "from", "with",
    "during", "year", "report", "reported", "amount", "number", "value", "total", "of", "in", "on", "to", "by", "and", "difference",
]
PERCENT_WORDS = ["%", "percent", "percentage", "proportion", "share", "rate", "ratio"]
MONEY_WORDS = ["£", "cost", "spend", "spending", "budget", "deficit", "surplus", "overspend", "shortfall", "income", "expenditure", "funding"]
BUDGET_CUE, BUDGET_CUES = ["budget", "spending", "spend", "differ", "difference", "underspend", "overspend"], ["variance", "surplus", "deficit", "overspend", "underspend", "budget"]
RESULT_CUE, RESULT_CUES = ["deficit", "surplus", "overspend", "shortfall"], ["deficit", "surplus", "overspend", "shortfall", "variance"]
WEAK_CUES = ["deficit", "surplus", "overspend", "shortfall", "budget", "spend", "spending", "income", "cost", "expenditure"]
TABLE_WORDS, RESERVES = ["memorandum", "in year out-turn", "core revenue resource"], ["reported a surplus", "reported a deficit", "retained reserves", "general reserves", "earmarked reserves"]
TOTALS = ["total", "cash requirement", "resource limit"]
LEAST_SCORE = 1.5


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found |= text.contains(w)
    return found


def question_features(questions: DataFrame) -> DataFrame:
    """Keywords, expected dimension and cue words of each question (query_id, question)."""
    q = F.lower(F.coalesce("question", F.lit("")))
    keywords = F.array_distinct(F.filter(F.regexp_extract_all(q, F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0)), lambda w: ~w.isin(SKIPPED)))
    cues = lambda when, words: F.when(when, F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>"))
    all_cues = F.array_distinct(F.concat(
        cues(_any(q, BUDGET_CUE), BUDGET_CUES), cues(_any(q, RESULT_CUE), RESULT_CUES), cues(_any(q, ["total", "overall total", "sum"]), ["total"]), cues(q.contains("cash requirement"), ["cash requirement"])))
    expected = F.when(_any(q, PERCENT_WORDS), "percent").when(_any(q, MONEY_WORDS), "currency")
    budget = _any(q, ["budget", "spending", "spend", "differ", "difference", "overspend", "underspend"])
    return questions.select("query_id", keywords.alias("keywords"), expected.alias("expected"), all_cues.alias("cues"), budget.alias("asks_budget"), _any(q, TOTALS).alias("asks_total"))


def _figures(width: int):
    pattern, years = re.compile(FIGURE, re.I), re.compile(YEARS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for q, c, r, table, body in zip(*(frame[n] for n in ("query_id", "chunk_id", "rank", "is_table", "chunk_text")), strict=True):
                for m in pattern.finditer(body if isinstance(body, str) else ""):
                    near = re.sub(r"\s+", "", body[max(0, m.start() - 6) : m.end() + 6])
                    if not years.search(near):
                        out.append((q, c, r, table, m.start(), m[0].strip(), body[max(0, m.start() - width) : m.end() + width]))
            yield pd.DataFrame(out, columns=["query_id", "chunk_id", "rank", "is_table", "start", "found", "context"])

    return run


def numeric_candidates(questions: DataFrame, hits: DataFrame, width: int = 120) -> DataFrame:
    """Figures in the retrieved chunks of each question, with their scores.

    ``hits``: query_id, chunk_id, rank, is_table, chunk_text. Parts of a year such as 2019/20 are no figures. A figure without
    a scale of its own takes the table's (£000). The score adds rank, keywords near by, the expected dimension and cues, and
    takes away for totals, years, narrative and small sums. Places of matches are found in Python; all else is columns."""
    c = F.col
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, rank int, is_table boolean, start int, found string, context string"
    rows = hits.select("query_id", "chunk_id", F.coalesce(c("rank").cast("int"), F.lit(9999)).alias("rank"), F.coalesce("is_table", F.lit(False)).alias("is_table"), "chunk_text").mapInPandas(_figures(width), schema)
    low_found, near = F.lower("found"), F.lower("context")
    rows = rows.filter(~F.regexp_replace(low_found, r"\s+", "").isin("£000", "(000)", "(£000)", "000"))
    scaled = low_found.rlike(r"£000|\(000\)") | low_found.rlike(r"\b(million|millions|billion|billions|thousand|thousands|bn|m|k)\b") | low_found.rlike("%|percent")
    raw = F.when(~scaled & near.rlike(r"£000|\(000\)"), F.concat("found", F.lit(" (£000)"))).otherwise(c("found"))
    rows = ordered.once(rows, raw=raw, near=near)
    rows = ordered.once(rows, norm=numeric.normalized(c("raw"))).filter(c("norm").isNotNull()).join(question_features(questions), "query_id")

    near, dim = c("near"), c("norm.dimension")
    hit = lambda words: F.size(F.filter(words, lambda w: near.contains(w)))
    agrees = c("expected") == dim
    hint = F.when(agrees & dim.isin("currency", "percent"), 1.5).when(agrees, 0.25).when(c("expected").isNotNull(), -1.0).otherwise(0.0)
    cue = F.when(hit(c("cues")) > 0, 1.1 * hit(c("cues"))).when(_any(near, WEAK_CUES), 0.6).otherwise(0.0)
    budget = lambda words, v: F.when(c("asks_budget") & words, v).otherwise(0.0)
    boost = budget(near.contains("variance") & _any(near, ["surplus", "deficit", "overspend", "underspend"]), 2.2) + budget(_any(near, TABLE_WORDS), 0.8)
    told = budget(_any(near, RESERVES), -2.4) + budget(near.contains("underspend against the revenue budget"), -1.2)
    digits = F.regexp_replace("raw", r"[^\d]", "")
    year = F.when(near.rlike(r"\d{4}\s*/\s*\d{1,2}") & F.length(digits).between(1, 2), -2.5).when(F.trim(F.replace(c("raw"), F.lit(","), F.lit(""))).rlike(r"^(?:19|20)\d{2}$"), -2.0).otherwise(0.0)
    size = F.abs(c("norm.value"))
    small = F.when((c("expected") == "currency") & (size > 0) & (size < 100000), -0.8).otherwise(0.0)
    parts = [
        F.greatest(F.lit(0.0), 3.0 - 0.2 * F.greatest(c("rank") - 1, F.lit(0))), 0.9 * hit(c("keywords")), hint, cue, boost, told,
        F.when(~c("asks_total") & _any(near, TOTALS), -1.8).otherwise(0.0), F.when(c("is_table"), -0.15).otherwise(0.0), year, small,
    ]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return rows.select("query_id", "chunk_id", "rank", "start", "raw", "context", "expected", dim.alias("dimension"), c("norm.value").alias("value"), F.round(score, 6).alias("score"))


def _printed(value: Column, dimension: Column) -> Column:
    """A figure with separators, two decimals at most and the sign of its unit."""
    size = F.abs(value)
    body = F.when(size == F.floor(size), F.format_number(size, 0)).otherwise(F.regexp_replace(F.format_number(size, 2), r"\.?0+$", ""))
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(dimension == "percent", F.concat(sign, F.replace(body, F.lit(","), F.lit("")), F.lit("%"))).when(dimension == "currency", F.concat(sign, F.lit("£"), body)).otherwise(F.concat(sign, body))


def numeric_answers(questions: DataFrame, candidates: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """The pick of each question with the reason, and its ``top`` candidates.

    The best score wins (then rank, then the order of results); under ``LEAST_SCORE`` there is no answer, nor for a question
    about money when neither the figure nor its surroundings name a unit."""
    c = F.col
    best = ordered.top_n_per(candidates, ["query_id"], [F.desc("score"), F.asc("rank"), F.asc("chunk_id"), F.asc("start")], top, "place")
    best = ordered.once(best, canonical=_printed(c("value"), c("dimension")))
    counts = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    unit = c("raw").rlike(r"(?i)£|\b(?:m|bn|million|billion|thousand)\b|\(£?000\)") | c("context").contains("£")
    one = questions.select("query_id").distinct().join(counts, "query_id", "left").join(best.filter("place = 1"), "query_id", "left")
    reason = F.when(c("score").isNull(), "no_numeric_candidates").when(c("score") < LEAST_SCORE, "low_confidence").when((c("expected") == "currency") & ~unit, "currency_unit_not_supported").otherwise("selected")
    kept = lambda n: F.when(c("reason") == "selected", c(n)).alias(n)
    picks = one.withColumn("reason", reason).select("query_id", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), "reason", "score", kept("chunk_id"), kept("raw"), kept("canonical"), kept("value"))
    return picks, best.select("query_id", "place", "chunk_id", "rank", "start", "raw", "canonical", "score")
