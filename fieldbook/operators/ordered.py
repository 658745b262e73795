"""Ordered computations over keys that may hold a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of one key in one
task. Here the caller names a *bucket*: a column that never decreases along the
order (a report date, an hour, ``line_no div 4096``). Rows are windowed inside
(key, bucket); one small row per bucket carries the running state across
buckets; both meet again in an equi-join on (key, bucket). The widest task then
holds one bucket of one key, and the bucket-level window holds one row per
bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.session import ensure_checkpoint_dir


def once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    A projection is copied into every filter and expression above it. Rows of a
    one-element generator are not, so costly expressions (pattern ladders,
    parsers) keep one evaluation however often their result is used."""
    kept = [c for c in df.columns if c not in exprs]
    return df.select(*kept, F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: what is joined with an aggregate of itself (as
    every scan below does) is then computed once, and a lost executor costs no rerun of what stands before."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small file out to all cores: texts compress well, so a file of a few MB may hold rows that cost
    minutes. A scan with a task for every second core stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * n) if 2 * df.rdd.getNumPartitions() < n else df


def _join_bucket(df: DataFrame, side: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys without duplicating the key columns."""
    renamed = side.select(
        *[F.col(c).alias(f"__k_{c}") for c in on],
        *[c for c in side.columns if c not in on],
    )
    cond = None
    for c in on:
        part = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        cond = part if cond is None else cond & part
    return df.join(renamed, cond, "left").drop(*[f"__k_{c}" for c in on])


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in (bucket, order) sequence."""
    on = [*keys, bucket]
    src = df.withColumn("__v", value)
    local = src.withColumn(
        "__run",
        F.sum("__v").over(
            Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        src.groupBy(*on)
        .agg(F.sum("__v").alias("__tot"))
        .withColumn("__off", F.coalesce(F.sum("__tot").over(before), F.lit(0)))
        .drop("__tot")
    )
    return (
        _join_bucket(local, offsets, on)
        .withColumn(out, F.col("__run") + F.col("__off"))
        .drop("__v", "__run", "__off")
    )


def position(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], out: str) -> DataFrame:
    """1-based row number per key in (bucket, order) sequence."""
    return prefix_sum(df, keys, bucket, order, F.lit(1), out)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: Column,
    out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Last non-null ``value`` seen so far (``inclusive`` counts the row itself)."""
    on = [*keys, bucket]
    hi = 0 if inclusive else -1
    # Wrapped in a struct so that struct-typed and scalar values take one path.
    src = df.withColumn("__v", value)
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    local = src.withColumn("__loc", F.last("__v", ignorenulls=True).over(w))
    tail = src.filter(F.col("__v").isNotNull()).groupBy(*on).agg(
        F.max_by("__v", F.struct(*order)).alias("__tail")
    )
    all_buckets = src.select(*on).distinct()
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    state = _join_bucket(all_buckets, tail, on).select(
        *on, F.last("__tail", ignorenulls=True).over(before).alias("__prev")
    )
    return (
        _join_bucket(local, state, on)
        .withColumn(out, F.coalesce("__loc", "__prev"))
        .drop("__v", "__loc", "__prev")
    )


def lag_across(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: Column,
    out: str,
    coarser: Column | None = None,
) -> DataFrame:
    """Previous row's ``value`` per key; the first row of a bucket looks into the
    bucket before it. ``coarser`` (of the bucket, never decreasing) puts a second
    level above the buckets, so that no task sees all buckets of a key."""
    on = [*keys, bucket]
    src = df.withColumn("__v", F.struct(value.alias("v")))
    w = Window.partitionBy(*on).orderBy(*order)
    local = src.withColumn("__loc", F.lag("__v").over(w))
    tail = src.groupBy(*on).agg(F.max_by("__v", F.struct(*order)).alias("__tail"))
    if coarser is None:
        state = tail.select(
            *on, F.lag("__tail").over(Window.partitionBy(*keys).orderBy(bucket)).alias("__prev")
        )
    else:
        wide = tail.withColumn("__wide", coarser)
        state = lag_across(wide, keys, "__wide", [bucket], F.col("__tail"), "__back").select(*on, F.col("__back").alias("__prev"))
    return (
        _join_bucket(local, state, on)
        .withColumn(out, F.coalesce("__loc", "__prev")["v"])
        .drop("__v", "__loc", "__prev")
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in ``order`` (a total order). An aggregate, not a
    window, so a hot key is combined before the shuffle. Null orders first."""
    cols = df.columns
    rest = [c for c in cols if c not in keys]
    ord_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    packed = df.select(
        *keys, F.struct(*rest).alias("__row"), F.struct(*ord_cols).alias("__ord")
    )
    return (
        packed.groupBy(*keys)
        .agg(F.min_by("__row", "__ord").alias("__row"))
        .select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in cols])
    )


def top_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key; the rank filter becomes a group limit that runs
    before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def state_scan(blocks: DataFrame, keys: Sequence[str], block: str, maps: str, start: int = 0, fan: int = 256) -> DataFrame:
    """State on entry to each block of each key, in a column ``entry``.

    ``maps`` (an array) says which state a block leaves for each state it is entered with. Maps are composed over ``fan``
    neighbouring blocks, these again, and so on, until one is left for each key; the entries are handed down on the way back.
    A group holds ``fan`` maps at most, whatever the number of blocks."""
    levels = [blocks.select(*keys, F.col(block).cast("long").alias("__b"), F.col(maps).alias("__m"))]
    top = levels[0].agg(F.max("__b")).first()[0] or 0
    gather = F.sort_array(F.collect_list(F.struct("__b", "__m"))).alias("__all")
    while top > 0:
        wide = levels[-1].withColumn("__w", F.floor(F.col("__b") / fan).cast("long")).groupBy(*keys, "__w").agg(gather)
        after = F.aggregate("__all", F.sequence(F.lit(0), F.size(F.col("__all")[0]["__m"]) - 1), lambda s, x: F.transform(s, lambda k: F.get(x["__m"], k)))
        levels.append(stored(wide.select(*keys, F.col("__w").alias("__b"), after.alias("__m"), "__all")))
        top //= fan
    state = levels[-1].select(*keys, "__b", F.lit(start).alias("entry"))
    for level in reversed(levels[1:]):
        above = _join_bucket(level.select(*keys, "__b", "__all"), state, [*keys, "__b"])
        into = F.aggregate(
            "__all", F.struct(F.col("entry").alias("s"), F.array().cast("array<struct<b:bigint,entry:int>>").alias("out")),
            lambda a, x: F.struct(F.get(x["__m"], a["s"]).alias("s"), F.concat(a["out"], F.array(F.struct(x["__b"].alias("b"), a["s"].alias("entry")))).alias("out")))["out"]
        state = above.select(*keys, F.inline(into)).withColumnRenamed("b", "__b")
    return _join_bucket(blocks, state.withColumnRenamed("__b", block), [*keys, block])
