"""The numbered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldbook.llm import ann, covertree, decontam, hardnegatives, htmltext, langid, manifest, mixing, sharding, simhash, suffixes, tokencount, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_passages": suffixes.op1_repeated_passages,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_neighbours": ann.op4_neighbours,
    "op5_token_counts": tokencount.op5_token_counts,
    "op6_url_filter": urlfilter.op6_url_filter,
    "op7_mixing": mixing.op7_mixing,
    "op8_sharding": sharding.op8_sharding,
    "op9_language_id": langid.op9_language_id,
    "op10_html_text": htmltext.op10_html_text,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_hard_negatives": hardnegatives.op12_hard_negatives,
    "op13_embedding_neardup": covertree.op13_embedding_neardup,
}

SQL: dict[str, str] = {
    "op3_decontamination": decontam.OP3_SQL,
    "op6_url_filter": urlfilter.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
    "op12_hard_negatives": hardnegatives.OP12_SQL,
    "op13_embedding_neardup": covertree.OP13_SQL,
}
