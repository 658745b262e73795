"""Sources (A1, A4–A10, A14)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.text import Vocabulary


def report_table(spark: SparkSession, root: str) -> DataFrame:
    """A1: one table per kind over all documents; an unreadable file fails the read."""
    return spark.read.option("mergeSchema", True).parquet(root)


def raw_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """File listing with size; file contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return f.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("source_filename"), F.col("length").alias("file_size_bytes"),
        "modificationTime", (F.col("length") == 0).alias("is_empty"),
    )


ITEM = (
    "query_id string, doc_id string, question string, category string, difficulty string, evidence_keyword string, "
    "expected_pages array<int>, expected_answer string, answer_type string, expected_section string, expected_subsection string"
)


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Question files that hold a list or an object with ``queries``."""
    raw = spark.read.text(path, wholetext=True)  # one question file is one row
    text = F.col("value")
    listed = F.from_json(text, f"array<struct<{ITEM.replace(' string', ':string').replace(' array', ':array')}>>")
    boxed = F.from_json(text, f"struct<queries:array<struct<{ITEM.replace(' string', ':string').replace(' array', ':array')}>>>")["queries"]
    is_list = F.ltrim(text).startswith("[")
    return raw.select(F.inline(F.when(is_list, listed).otherwise(boxed)))


def read_vocabulary(path: str) -> Vocabulary:
    """Vocabulary file with stop_words, unit_tokens, compound_terms,
    abbreviation_map and label tables."""
    import yaml

    y = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return Vocabulary(
        stop_words=[str(w) for w in y.get("stop_words", [])],
        unit_tokens=[str(w) for w in y.get("unit_tokens", [])],
        compounds=[(str(e["from"]), str(e["to"])) for e in y.get("compound_terms", [])],
        abbreviations={str(e["abbr"]): e.get("expands_to") for e in y.get("abbreviation_map", [])},
        op_codes={str(k): str(v) for k, v in (y.get("op_code_labels") or {}).items()},
        activity_codes={str(k): str(v) for k, v in (y.get("activity_code_labels") or {}).items()},
        min_token_len=int(y.get("min_token_len", 3)),
    )


def read_profile(path: str) -> dict:
    """Report profile (phase order, labels, header labels, file-name pattern)."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def well_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A10: document prefixes, one per line, in files named after their well."""
    f = spark.read.text(root).withColumn("file", F.input_file_name())
    return f.select(F.trim("value").alias("prefix"), F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).alias("well")).filter("prefix <> ''")


def unprocessed(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents without output."""
    return docs.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def resume_status(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Per document, whether it was already there."""
    d = done.select("doc_id").distinct().withColumn("__d", F.lit(True))
    return docs.join(d, "doc_id", "left").withColumn(
        "status", F.when(F.col("__d"), "skipped_existing").otherwise("processed")).drop("__d")
