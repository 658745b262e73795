"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.session import ensure_checkpoint_dir

#: Rows of a batch whose texts are Python values at one time.
SLICE = 256
#: Row sets of up to so many bytes are broadcast as bitmaps of 4 KB for each 32768 neighbouring rows.
BITMAPS = 64 << 20
#: Rows of a batch that goes to Python where whole texts go.
BATCH = 1000


def lean_batches(spark: SparkSession) -> None:
    """At most ``BATCH`` rows in a batch for Python from now on: an executor holds a batch of whole texts several times for
    each running task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor costs no rerun of what stands before) and lets a costly frame be used twice.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete settled frames after their last use; nothing that is still to be computed may read them."""
    for df in frames:
        remove(df.sparkSession, df.settled_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with a long column ``name`` that numbers its rows by file and place in the file.

    The number does not depend on how a scan is split, so scans that are planned anew (after a lost executor, say) agree.
    ``docs`` is a Parquet table of which columns and rows may be left out; a frame that is not stored is written first.
    One row for each input file is broadcast.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["file_path"], meta["row_index"]).schema  # noqa: B018
    except AnalysisException:
        docs = settle(docs, "rows")
        meta = docs.metadataColumn("_metadata")
    path, at, file = fresh(docs, "path", "at", "file")
    placed = docs.withColumns({path: meta["file_path"], at: meta["row_index"]})
    files = placed.select(path).distinct().withColumn(file, F.row_number().over(Window.orderBy(path)).cast("long"))
    placed = placed.join(F.broadcast(settle(files, "files")), path)
    return placed.select(*[column(docs, c) for c in docs.columns if c != name], F.shiftleft(file, 40).bitwiseOR(F.col(at)).alias(name))


def flagged(docs: DataFrame, row: str, chosen: DataFrame, name: str, limit: int = BITMAPS) -> DataFrame:
    """``docs`` (numbered by ``row``) with a boolean column ``name``: whether the row is among ``chosen`` (column row).

    The chosen rows are packed into bitmaps. Up to ``limit`` bytes of these are broadcast, so that the rows of ``docs`` stay
    where they are; beyond that the rows are joined by their number.
    """
    packed = chosen.groupBy(F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))
    bits = settle(packed, "bitmaps")
    if bits.count() * 4096 > limit:
        drop(bits)
        hit = chosen.select(F.col("row").alias(row), F.lit(True).alias(name)).distinct()
        return docs.join(hit, row, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    bucket, map_ = fresh(docs, "bucket", "bits")
    at = F.bitmap_bit_position(F.col(row))
    byte = F.conv(F.hex(F.substring(F.col(map_), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1, F.lit(False))
    out = docs.withColumn(bucket, F.bitmap_bucket_number(F.col(row)))
    out = out.join(F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(map_))), bucket, "left")
    return out.select(*[column(docs, c) for c in docs.columns], hit.alias(name))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"__{name}"
        while candidate.lower() in taken:
            candidate = f"_{candidate}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def column(df: DataFrame, name: str):
    """The column exactly named ``name``, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def values(array: pa.Array) -> Iterator:
    """Python values of a column, made for ``SLICE`` rows at a time: a batch of long texts is not copied as a whole."""
    for at in range(0, len(array), SLICE):
        yield from array.slice(at, SLICE).to_pylist()


def texts(batch: pa.RecordBatch, name: str | int) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column."""
    return values(batch.column(name).cast(pa.binary()))


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; None has none."""
    return text.lower().split() if text else []


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; ``label`` maps each index to the smallest of its set."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        la, lb = la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, label[label]):
            label = label[label]


def components(links: DataFrame) -> DataFrame:
    """Connected components by contraction: links (a, b) of longs → (node, root), root the smallest node.

    Only nodes that are not their component's root are listed. Each round hooks a node to its smallest smaller
    neighbour, jumps pointers until all point at roots, and contracts the links; every frame is written, so no lineage
    grows. Links between the same two nodes and loops are allowed.
    """
    oriented = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = settle(oriented, "links")
    found = None
    while not left.isEmpty():
        parent = settle(left.groupBy("a").agg(F.min("b").alias("b")), "parents")
        while True:
            up = parent.select(F.col("a").alias("b"), F.col("b").alias("c"))
            jumped = settle(parent.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "parents")
            drop(parent)
            parent = jumped
            if jumped.where("moved").isEmpty():
                break
        to = parent.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, found = found, to
        if before is not None:
            moved = before.join(to.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
            found = settle(moved.select("node", F.coalesce("above", "root").alias("root")).unionByName(to), "roots")
        rest = left.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").withColumn("a", F.coalesce("ra", "a"))
        rest = rest.join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left").withColumn("b", F.coalesce("rb", "b"))
        rest = settle(rest.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        drop(left)
        if before is not None:
            drop(parent)
        if hasattr(before, "settled_at"):
            drop(before)
        left = rest
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def pairs_of(n: int) -> list[tuple[int, int]]:
    return list(combinations(range(n), 2))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by ``key`` into tables that hold whole groups; at most one group waits in memory
    beside the current batch."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if kept and kept[-1].column(key)[-1].as_py() != keys[0] and cut == 0:
            yield pa.Table.from_batches(kept)
            kept = []
        if cut:
            kept.append(batch.slice(0, cut))
            yield pa.Table.from_batches(kept)
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)
