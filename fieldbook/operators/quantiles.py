"""Exact linear-interpolated quantiles per key without holding a key in one task.

Equal values are first folded to (key, value, count). Each key's value range is
cut into equal-width cells; a window over the cells (a fixed number per key)
finds the cells that hold the wanted ranks, and only those are ranked row by
row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.operators import ordered


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    cells: int = 1024,
    weight: str | None = None,
) -> DataFrame:
    """keys → one column per ``probs`` entry (name → probability); ``weight`` counts a row that often."""
    counts = ordered.stored(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__x"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    )
    span = counts.groupBy(*keys).agg(
        F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.sum("__n").alias("__tot")
    )
    span = span.select(*[F.col(k).alias(f"__s_{k}") for k in keys], "__lo", "__hi", "__tot")
    if keys:
        cond = None
        for k in keys:
            part = F.col(k).eqNullSafe(F.col(f"__s_{k}"))
            cond = part if cond is None else cond & part
        joined = counts.join(span, cond).drop(*[f"__s_{k}" for k in keys])
    else:
        joined = counts.join(span)  # one-row side
    placed = joined.withColumn(
        "__c",
        F.when(F.col("__hi") > F.col("__lo"),
               F.least(F.lit(cells - 1),
                       F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * cells)))
        .otherwise(0),
    )
    per_cell = placed.groupBy(*keys, "__c").agg(F.sum("__n").alias("__cn"))
    run = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)
    offs = per_cell.withColumn("__end", F.sum("__cn").over(run)).select(
        *[F.col(k).alias(f"__o_{k}") for k in keys],
        F.col("__c").alias("__oc"),
        (F.col("__end") - F.col("__cn")).alias("__beg"),
        "__end",
    )
    cond = F.col("__c") == F.col("__oc")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    rows = placed.join(offs, cond).drop("__oc", *[f"__o_{k}" for k in keys])
    # 0-based target ranks of both neighbours of each probability
    wanted = F.lit(False)
    for p in probs.values():
        pos = (F.col("__tot") - 1) * F.lit(float(p))
        for t in (F.floor(pos), F.ceil(pos)):
            wanted = wanted | ((t >= F.col("__beg")) & (t < F.col("__end")))
    kept = rows.filter(wanted)
    inner = Window.partitionBy(*keys, "__c").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = kept.withColumn("__e", F.col("__beg") + F.sum("__n").over(inner)).withColumn(
        "__b", F.col("__e") - F.col("__n")
    )
    aggs = []
    for name, p in probs.items():
        pos = (F.col("__tot") - 1) * F.lit(float(p))
        lo = F.max(F.when((F.floor(pos) >= F.col("__b")) & (F.floor(pos) < F.col("__e")), F.col("__x")))
        hi = F.max(F.when((F.ceil(pos) >= F.col("__b")) & (F.ceil(pos) < F.col("__e")), F.col("__x")))
        frac = F.max(pos - F.floor(pos))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
