"""Citations in generated answers: parsing, checking against what was retrieved, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import numeric
from fieldbook.operators import ordered

# The three written forms of a citation, in order; what an answer without evidence says.
FORMS = [
    r"(?i)\[\s*chunk_id\s*[:=]\s*([^,\]\)]+)\s*[,;]\s*page(?:s)?\s*[:=]\s*(\d+)\s*\]",
    r"(?i)\(\s*chunk_id\s*[:=]\s*([^,\]\)]+)\s*[,;]\s*page(?:s)?\s*[:=]\s*(\d+)\s*\)",
    r"(?i)chunk_id\s*[:=]\s*([A-Za-z0-9:_\-.]+)\s*[,; ]+\s*page(?:s)?\s*[:=]\s*(\d+)",
]
FENCED = r"(?i)```(?:json)?\s*([\s\S]*?)\s*```"
NO_EVIDENCE = "insufficient evidence in retrieved context."
CITATION = "struct<chunk_id:string,page:bigint>"


def written_citations(text: Column) -> Column:
    """Citations written in a text, each once, in the order of the forms."""
    found = [F.arrays_zip(F.regexp_extract_all(text, F.lit(f), F.lit(1)).alias("chunk_id"), F.regexp_extract_all(text, F.lit(f), F.lit(2)).alias("page")) for f in FORMS]
    each = F.transform(F.concat(*found), lambda x: F.struct(F.trim(x["chunk_id"]).alias("chunk_id"), x["page"].try_cast("bigint").alias("page")))
    return F.array_distinct(F.filter(each, lambda x: (x["chunk_id"] != "") & x["page"].isNotNull()))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _listed(item: Column) -> Column:
    """Citations of one element of a payload's list: an object, or a text with written citations."""
    def key(name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "variant")

    name = F.trim(F.coalesce(F.nullif(_text(item, "$.chunk_id"), F.lit("")), _text(item, "$.chunk"), F.lit("")))
    page = F.coalesce(key("page"), key("page_no"), key("pages"))
    page = F.when(_kind(page).startswith("ARRAY"), F.try_variant_get(page, "$[0]", "variant")).otherwise(page)
    number = F.trim(F.try_variant_get(page, "$", "string"))
    number = F.when(_kind(page) == "STRING", number.try_cast("bigint")).otherwise(F.floor(number.try_cast("double")).cast("bigint"))
    one = F.when((name != "") & number.isNotNull(), F.array(F.struct(name.alias("chunk_id"), number.alias("page")))).otherwise(F.array().cast(f"array<{CITATION}>"))
    return F.when(_kind(item).startswith("OBJECT"), one).when(_kind(item) == "STRING", written_citations(_text(item, "$"))).otherwise(F.array().cast(f"array<{CITATION}>"))


def _object(text: Column) -> Column:
    """The JSON object that a text is, else null; read as the one element of a list, for a parser stops at the end of the
    first value and would pass over what follows it."""
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when((F.size(one) == 1) & _kind(F.get(one, F.lit(0))).startswith("OBJECT"), F.get(one, F.lit(0)))


def parsed_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (with raw_answer) with answer, citations and parse_mode.

    A JSON object (plain or in a fenced block) gives its answer and its list of citations; an answer that is none is
    text. Where the payload lists nothing, citations are read from the whole text in three written forms."""
    c = F.col
    rows = ordered.once(answers, __t=F.trim(F.coalesce("raw_answer", F.lit(""))))
    rows = ordered.once(rows, __j=_object(c("__t")), __f=_object(F.regexp_extract("__t", FENCED, 1)))
    rows = rows.withColumn("__j", F.coalesce("__j", "__f"))
    mode = F.when(c("__t") == "", "empty").when(c("__j").isNotNull(), "json").otherwise("text_fallback")
    answer = F.when(c("__j").isNotNull(), F.trim(_text(c("__j"), "$.answer"))).otherwise(F.nullif("__t", F.lit("")))
    items = F.coalesce(F.try_variant_get("__j", "$.citations", "array<variant>"), F.array().cast("array<variant>"))
    rows = ordered.once(rows, parse_mode=mode, answer=answer, __l=F.flatten(F.transform(items, _listed)), __w=written_citations(c("__t")))
    return rows.withColumn("citations", F.when(F.size("__l") > 0, c("__l")).otherwise(c("__w"))).drop("__t", "__j", "__f", "__l", "__w")


def answer_outcomes(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Outcome of each answer (query_id, raw_answer, raw_status, requested).

    A citation is valid when its page belongs to its chunk among ``retrieved`` (query_id, rank, chunk_id, pages; of a chunk
    that is there twice the later counts). An answer is ok with one valid citation at least; its confidence is the valid
    share. Bare figures are printed in one form. Citations are checked by an equality join, not in lists of all results."""
    c = F.col
    rows = parsed_answers(answers)
    pages = retrieved.groupBy("query_id", F.trim("chunk_id").alias("chunk_id")).agg(F.max_by("pages", "rank").alias("pages"))
    said = rows.select("query_id", F.posexplode("citations").alias("pos", "x")).select("query_id", "pos", "x.*")
    checked = said.join(pages, ["query_id", "chunk_id"], "left").withColumn("good", F.coalesce(F.array_contains("pages", c("page").cast("int")), F.lit(False)))
    one = F.struct("pos", "chunk_id", "page")
    # The citations of one answer are few.
    counts = checked.groupBy("query_id").agg(F.count_if("good").alias("valid"), F.sort_array(F.collect_list(F.when(c("good"), one))).alias("kept"))
    rows = rows.join(counts, "query_id", "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    status, body = F.lower(F.trim(F.coalesce("raw_status", F.lit("")))), F.trim(F.coalesce("answer", F.lit("")))
    outcome = (
        F.when(~F.coalesce("requested", F.lit(False)), "skipped").when((status != "ok") | (body == ""), F.when(status == "", "error").otherwise(status))
        .when((F.lower(body) == NO_EVIDENCE) | (c("valid") == 0), "insufficient_evidence").otherwise("ok"))
    accepted = (outcome == "ok") & (body != "") & (c("valid") > 0)
    rows = ordered.once(rows, status=outcome, accepted=accepted, figure=F.when(numeric.is_bare_figure(c("answer")), numeric.canonical_figure(c("answer"))))
    ok, n = c("accepted"), F.size("citations")
    kept = F.when(ok, F.transform("kept", lambda x: F.concat_ws("#", x["chunk_id"], x["page"].cast("string"))))
    return rows.select(
        "query_id", "status", F.when(ok, F.coalesce("figure", "answer")).alias("answer"), F.array_join(F.coalesce(kept, F.array().cast("array<string>")), " ").alias("citations"),
        F.when(ok, c("valid") / F.greatest(n, F.lit(1))).alias("confidence"), n.alias("citations_parsed"), c("valid").alias("citations_valid"), (n - c("valid")).alias("citations_rejected"), "parse_mode")
