"""Sinks (A11–A13, A15, N28, N45, N46)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, partitioned by well or month rather than by document."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Fixed field order, missing values empty."""
    cols = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]
    df.select(*cols).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def index_manifest(chunks: DataFrame) -> DataFrame:
    """Document and chunk count, vector width."""
    return chunks.agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_chunks"), F.max(F.size("embedding")).alias("dim"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def row_minimums(tables: Mapping[str, DataFrame], minimum: Mapping[str, int]) -> DataFrame:
    """Row count per table against its minimum."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", (F.col("n_rows") >= minimum.get(name, 0)).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def missing_artefacts(docs: DataFrame, present: DataFrame, required: Sequence[str]) -> DataFrame:
    """(document, kind) pairs that are required but absent."""
    need = docs.select("doc_id", F.explode(F.array(*[F.lit(r) for r in required])).alias("kind"))
    return need.join(present.select("doc_id", "kind"), ["doc_id", "kind"], "left_anti")
