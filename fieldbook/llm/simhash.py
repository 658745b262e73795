"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Fingerprints link when at most ``RADIUS`` bits differ. Equal fingerprints are folded first. The bits are cut into six
blocks; two fingerprints within four bits agree on at least two whole blocks, so the comparison runs inside cells of
(block pair, block values) and loses no link. A cell of at most ``TILE`` fingerprints is one tile; a larger cell is cut
into tiles ordered by bit count, and a tile pair is skipped where the bit counts differ by more than the radius.
Tiles are compared with numpy exclusive-or and bit counts, and a tile reports a spanning forest of its links, never all
its pairs. Components are then found by contraction.

Edge cases: a null or blank text has fingerprint zero and links like any other; a null id never becomes a component id
unless all ids of the component are null; repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.common import ascii_words, column, components, flagged, fresh, numbered, pairs_of, settle, texts, union, whole_groups

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bits of the six blocks; RADIUS differing bits leave at least two blocks untouched.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints in a tile.
TILE = 4096
#: Runs up to this length are compared by shifted arrays, longer ones by tiles.
SHORT = 32
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    words = ascii_words(text)
    if not words:
        return 0
    canon = b" ".join(words)
    size = min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(canon[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(part: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, id, fp) for each row of ``part`` (row, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in texts(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(found)], ["row", "id", "fp"])

    return part.mapInArrow(run, T.StructType([part.schema["row"], part.schema["id"], T.StructField("fp", T.LongType())]))


def within(fp: np.ndarray, other: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in fp, j in other) at most ``radius`` bits apart, both sorted by bit count; slabs of the tile whose
    bit counts differ beyond the radius are skipped."""
    pop, pop2 = np.bitwise_count(fp).astype(int), np.bitwise_count(other).astype(int)
    for at in range(0, len(fp), 256):
        rows = fp[at : at + 256]
        lo = int(np.searchsorted(pop2, pop[at] - radius))
        hi = int(np.searchsorted(pop2, pop[at + len(rows) - 1] + radius, "right"))
        if lo < hi:
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ other[None, lo:hi]) <= radius)
            yield i + at, j + lo


def _ordered(fp: np.ndarray) -> np.ndarray:
    return fp[np.lexsort((fp, np.bitwise_count(fp)))]


def _forest(fp: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    child = np.flatnonzero(label != np.arange(len(label)))
    return fp[child], fp[label[child]]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside a tile (right None) or between two tiles."""
    left = _ordered(left)
    if right is None:
        label = np.arange(len(left))
        for i, j in within(left, left, radius):
            label = union(label, i, j)
        return _forest(left, label)
    right = _ordered(right)
    label = np.arange(len(left) + len(right))
    for i, j in within(left, right, radius):
        label = union(label, i, j + len(left))
    return _forest(np.concatenate([left, right]), label)


def run_links(cell: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the links inside each run of equal ``cell``."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    short = np.repeat(sizes <= SHORT, sizes)
    c, f = cell[short], fp[short]
    label = np.arange(len(c))
    for d in range(1, min(SHORT, len(c))):
        near = np.flatnonzero(c[d:] == c[:-d])
        if not len(near):
            break
        near = near[np.bitwise_count(f[near] ^ f[near + d]) <= radius]
        label = union(label, near, near + d)
    out = [_forest(f, label)]
    for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
        out.append(tile_links(fp[s : s + n], None, radius))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=LINK)


def _compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "cell"):
        yield _batch(*run_links(table.column("cell").to_numpy(), table.column("fp").to_numpy().view(np.uint64)))


def _compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "job"):
        job, fp, side = (table.column(c).to_numpy() for c in ("job", "fp", "side"))
        bounds = np.flatnonzero(np.r_[True, job[1:] != job[:-1], True])
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part, at = fp[s:e].view(np.uint64), side[s:e]
            right = part[at == 1]
            yield _batch(*tile_links(part[at == 0], right if len(right) else None))


def _cells(nodes: DataFrame) -> DataFrame:
    starts = np.cumsum((0, *BLOCKS[:-1])).tolist()
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in zip(starts, BLOCKS, strict=True)]
    keys = [F.shiftleft(F.lit(t).cast("long"), 24).bitwiseOR(F.shiftleft(block[i], 11)).bitwiseOR(block[j]) for t, (i, j) in enumerate(pairs_of(len(BLOCKS)))]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("cell"))


def links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``nodes`` (fp) that keep every component connected."""
    cells = _cells(nodes)
    large = settle(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > tile), "large-cells")
    few = cells.join(large.select("cell"), "cell", "left_anti").repartition("cell").sortWithinPartitions("cell")
    inside = few.select("cell", "fp").mapInArrow(_compare_cells, "a long, b long")

    # Large cells: tiles in the order of bit counts; a tile's place comes from counts and a hash, not from a sort.
    rows = cells.join(large, "cell").withColumn("pop", F.bit_count("fp"))
    pops = rows.groupBy("cell", "pop").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("cell").orderBy("pop")) - F.col("m")
    pops = pops.select("cell", "pop", "m", before.alias("before"))
    share = F.shiftrightunsigned(F.xxhash64("fp"), 11) / F.lit(float(1 << 53))
    rows = rows.join(pops, ["cell", "pop"]).withColumn("tile", F.floor((F.col("before") + share * F.col("m")) / F.lit(tile // 2)))
    rows = settle(rows.select("cell", "tile", "pop", "fp"), "tiles")
    tiles = rows.groupBy("cell", "tile").agg(F.min("pop").alias("lo"), F.max("pop").alias("hi"))
    right = tiles.select("cell", F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    jobs = tiles.join(right, "cell").where((F.col("tile") <= F.col("tile2")) & (F.col("lo2") - F.col("hi") <= RADIUS))
    jobs = jobs.select("cell", "tile", "tile2", F.xxhash64("cell", "tile", "tile2").alias("job"))
    sides = [jobs.select("cell", "tile", "job", F.lit(0).alias("side")), jobs.where("tile < tile2").select("cell", F.col("tile2").alias("tile"), "job", F.lit(1).alias("side"))]
    dealt = rows.join(sides[0].unionByName(sides[1]), ["cell", "tile"]).repartition("job").sortWithinPartitions("job")
    across = dealt.select("job", "fp", "side").mapInArrow(_compare_tiles, "a long, b long")
    return inside.unionByName(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has (row, id, fp) of each row; groups maps each fp to (root, keep): the fingerprint that
    names its component, and the component's first row by (id, nulls last, row)."""
    (row,) = fresh(docs, "row")
    return _groups(parts(numbered(docs, row), row, id_col, text_col), shingle, tile)


def parts(rows: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text) of numbered rows."""
    return rows.select(F.col(row).alias("row"), column(rows, id_col).alias("id"), column(rows, text_col).cast("string").alias("text"))


def _groups(part: DataFrame, shingle: int = SHINGLE, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    rows = settle(fingerprints(part, shingle), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = settle(rows.groupBy("fp").agg(first), "nodes")
    found = components(links(nodes.select("fp"), tile))
    found = found.select(F.col("node").alias("fp"), "root")
    members = settle(found.unionByName(found.select(F.col("root").alias("fp"), "root").distinct()).join(nodes, "fp"), "members")
    best = members.groupBy("root").agg(F.min("first").alias("best"))
    joined = members.select("fp", "root").join(best, "root")
    groups = nodes.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("best", "first").alias("keep"))
    return rows, settle(groups, "groups")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component (the smallest id; of repeated ids the first row); columns unchanged."""
    row, hit = fresh(docs, "row", "gone")
    docs, names = numbered(docs, row), docs.columns
    rows, groups = _groups(parts(docs, row, id_col, text_col))
    gone = rows.join(groups.select("fp", F.col("keep.row").alias("keep")), "fp").where("row <> keep").select("row")
    return flagged(docs, row, gone, hit).where(~F.col(hit)).select(*[column(docs, c) for c in names])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component (smallest doc_id) of every document."""
    rows, groups = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.join(groups, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keep.id").alias("component_id"))
