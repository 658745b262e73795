"""Sharding by sampled splitters: near-equal bytes, equal texts side by side. DataFrame functions only.

Rows are ordered by a key: 40 bits of the text's hash, then, for a heavy text alone, 23 bits of the row's own hash. A
text is heavy when all its copies hold more than ``HEAVY`` of one shard; there are at most shards / HEAVY such texts.
Splitters come from a size-weighted sample of keys: each row enters with a chance in proportion to its size, and
quantiles of the sample cut the key line into ranges of about equal bytes. Overfull ranges are subdivided by the key
once more. Exact sizes of the ranges then place every row on the line of all bytes, and a shard is an equal
stretch of that line. Copies of a text that is not heavy share one place, so they stay together; a heavy text is split
only where a shard ends. The sample decides how the work is dealt, never the result.

Edge cases: a null text has size 1 and is one group with all null texts; an empty text likewise has size 1, in a group
of its own; null ids and repeated rows are rows like any other (slots of equal rows are dealt in any order); with
fewer texts than shards some shards are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import column, drop, fresh, numbered, settle

SHARDS = 16
#: A text is heavy when its copies hold more than this share of a shard's bytes.
HEAVY = 0.005
#: Ranges to each shard, and sampled rows to each range (both on average).
RANGES, SAMPLES = 32, 32
#: A range is overfull beyond so many times the mean range; its parts are PARTS slices of the key.
OVERFULL, PARTS = 2.0, 64


def _group(docs: DataFrame, row: str, id_col: str, text_col: str) -> tuple[Column, Column]:
    """40 bits of the text's hash and 23 bits of the row's own."""
    text = column(docs, text_col).cast("string")
    return F.shiftright(F.xxhash64(text, text.isNull()), 24), F.xxhash64(column(docs, id_col).cast("string"), F.col(row)).bitwiseAND(F.lit((1 << 23) - 1))


def sized(docs: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    """(row, id, size, crc, group, own) of each numbered row."""
    text = column(docs, text_col).cast("string")
    group, own = _group(docs, row, id_col, text_col)
    rows = docs.select(
        F.col(row).alias("row"), column(docs, id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"), group.alias("group"), own.alias("own"),
    )
    return settle(rows, "sizes")


def heavy_groups(rows: DataFrame, shards: int) -> DataFrame:
    """Groups that hold more than HEAVY of a shard: shards / HEAVY rows at most, so they fit a broadcast at any size."""
    share = rows.agg(F.sum("size").alias("all"))
    heavy = rows.groupBy("group").agg(F.sum("size").alias("n")).join(share, F.lit(True))
    return settle(heavy.where(F.col("n") > F.col("all") * HEAVY / shards).select("group", F.lit(True).alias("heavy")), "heavy")


def keyed(rows: DataFrame, heavy: DataFrame, group: str = "group", own: str = "own", key: str = "key") -> DataFrame:
    """``rows`` with ``key`` in place of ``group`` and ``own``."""
    (flag,) = fresh(rows, "heavy")
    last = F.when(F.col(flag), F.col(own) + 1).otherwise(0)
    rows = rows.join(F.broadcast(heavy.select(F.col("group").alias(group), F.col("heavy").alias(flag))), group, "left")
    return rows.withColumn(key, F.shiftleft(F.col(group), 24) + last).drop(group, own, flag)


def splitters(rows: DataFrame, shards: int, ranges: int = RANGES, samples: int = SAMPLES) -> list[int]:
    """Quantiles of a size-weighted sample of keys; at most shards x ranges - 1 of them."""
    wanted = shards * ranges
    all_bytes = rows.agg(F.sum("size")).first()[0] or 0
    draw = F.shiftrightunsigned(F.xxhash64("row", "size"), 11) / F.lit(float(1 << 53))
    chance = F.col("size") * (wanted * samples / max(all_bytes, 1))
    # A row above the sample's step counts for its whole size, a drawn row for one step.
    weight = F.greatest(F.lit(1), F.round(chance).cast("long"))
    drawn = rows.where(draw < chance).select("key", F.explode(F.array_repeat(F.lit(1), F.least(weight, F.lit(wanted * samples)).cast("int"))))
    marks = [k / wanted for k in range(1, wanted)]
    found = drawn.agg(F.percentile_approx("key", marks, 20 * wanted)).first()[0] or []
    return sorted(set(found))


def range_of(key: Column, bounds: list[int], lo: int = 0) -> Column:
    """Number of ``bounds`` that are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(lo)
    mid = len(bounds) // 2
    return F.when(key < F.lit(bounds[mid]), range_of(key, bounds[:mid], lo)).otherwise(range_of(key, bounds[mid + 1 :], lo + mid + 1))


class Layout:
    """Where the shards lie on the line of keys: heavy groups, ranges and their parts, all of bounded number."""

    def __init__(self, docs: DataFrame, row: str, shards: int, id_col: str, text_col: str):
        """``docs`` are numbered by ``row``."""
        self.shards = shards
        sizes = sized(docs, row, id_col, text_col)
        self.heavy = heavy_groups(sizes, shards)
        self.rows = settle(keyed(sizes, self.heavy), "keys")
        drop(sizes)
        self.bounds = splitters(self.rows, shards)
        rows = self.rows.withColumn("range", range_of(F.col("key"), self.bounds))
        span = rows.groupBy("range").agg(F.sum("size").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        span = span.withColumn("over", F.col("n") > F.avg("n").over(Window.partitionBy()) * OVERFULL)
        self.span = settle(span.select("range", "lo", "hi", "over"), "ranges")  # one row for each of at most shards x RANGES ranges
        rows = self.parted(self.rows)
        upto = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, 0)
        parts = rows.groupBy("range", "part").agg(F.sum("size").alias("n"), F.count("*").alias("m"))
        everything = Window.partitionBy()
        parts = parts.select("range", "part", (F.sum("n").over(upto) - F.col("n")).alias("bytes_before"), (F.sum("m").over(upto) - F.col("m")).alias("rows_before"), F.sum("n").over(everything).alias("all"))
        self.parts = settle(parts, "parts")  # at most shards x RANGES x PARTS rows

    def parted(self, rows: DataFrame, key: str = "key", range_: str = "range", part: str = "part") -> DataFrame:
        """``rows`` with the range and part of their key."""
        lo, hi, over = fresh(rows, "lo", "hi", "over")
        rows = rows.withColumn(range_, range_of(F.col(key), self.bounds))
        span = self.span.select(F.col("range").alias(range_), F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("over").alias(over))
        rows = rows.join(F.broadcast(span), range_)
        step = (F.col(key).cast("double") - F.col(lo)) / (F.col(hi).cast("double") - F.col(lo) + 1.0)
        return rows.withColumn(part, F.when(F.col(over), F.least(F.floor(step * PARTS), F.lit(PARTS - 1))).otherwise(0)).drop(lo, hi, over)

    def placed(self) -> DataFrame:
        """(row, id, size, crc, key, shard, rank) of each row; rank is its place on the whole line."""
        own = Window.partitionBy("range", "part")
        peers = F.sum("size").over(Window.partitionBy("range", "part", "key"))
        middle = F.col("bytes_before") + F.sum("size").over(own.orderBy("key")) - peers / 2
        rows = self.parted(self.rows).join(F.broadcast(self.parts), ["range", "part"]).withColumn("middle", middle)
        rows = rows.withColumn("rank", F.col("rows_before") + F.row_number().over(own.orderBy("key", "id", "size", "row")) - 1)
        rows = rows.withColumn("shard", F.least(F.floor(F.col("middle") * self.shards / F.col("all")), F.lit(self.shards - 1)).cast("int"))
        return settle(rows.select("row", "id", "size", "crc", "key", "shard", "rank"), "placed")


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, size, crc, shard, slot) of each row of ``docs``."""
    (row,) = fresh(docs, "row")
    rows = Layout(numbered(docs, row), row, shards, id_col, text_col).placed()
    first = rows.groupBy("shard").agg(F.min("rank").alias("first"))
    return rows.join(F.broadcast(first), "shard").select("row", "id", "size", "crc", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns, ``shard`` and ``slot`` (own columns of these names are replaced).

    A shard is a stretch of the line of keys, so it is told in the scan; whole rows are moved once, to the part of the key
    range that they lie in, where their slots are counted.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    row, group, own, key, range_, part, before = fresh(docs, "row", "group", "own", "key", "range", "part", "before")
    rows = numbered(docs, row)
    layout = Layout(rows, row, shards, id_col, text_col)
    lean = layout.placed()
    starts = lean.groupBy("shard").agg(F.min("key").alias("key"), F.min("rank").alias("rank")).orderBy("shard").collect()  # one row a shard
    drop(lean, layout.rows)
    hashes = dict(zip((group, own), _group(rows, row, id_col, text_col), strict=True))
    out = rows.select(*[column(docs, c) for c in kept], F.col(row), *[c.alias(n) for n, c in hashes.items()])
    out = layout.parted(keyed(out, layout.heavy, group, own, key), key, range_, part)
    parts = layout.parts.select(F.col("range").alias(range_), F.col("part").alias(part), F.col("rows_before").alias(before))
    out = out.join(F.broadcast(parts), [range_, part])
    rank = F.col(before) + F.row_number().over(Window.partitionBy(range_, part).orderBy(key, row)) - 1
    number = range_of(F.col(key), [r.key for r in starts[1:]])
    of = lambda name: F.element_at(F.array(*[F.lit(r[name]) for r in starts]), number + 1)
    if not starts:
        return out.select(*[column(docs, c) for c in kept], F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    return out.select(*[column(docs, c) for c in kept], of("shard").cast("int").alias("shard"), (rank - of("rank")).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, with near-equal bytes in each of 16 shards."""
    found = place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
