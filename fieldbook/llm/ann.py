"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are scaled to length one, turned by a random rotation and kept in lists around centroids. A query probes its
nearest lists, as many as hold most true neighbours of a sample and, where these are small, further ones until there is a
plenty of candidates. Inside a list, candidates are scanned in blocks of ``BLOCK`` columns: after d of D dimensions the scaled
partial distance is an estimate of the whole one, and a candidate is abandoned when the estimate exceeds the k-th best
distance so far by more than the test allows (factor 1 + EPSILON / sqrt(d)). What survives is scored exactly, as the
cosine of the original vectors in double precision.

The index is fitted on a bounded sample (``SAMPLE_BYTES`` of vectors): centroids by k-means, and the number of probed
lists, the smallest that finds ``TARGET`` of the sample's true neighbours. Every row is indexed. Lists are cut into
chunks and the queries of a list into blocks, so a task compares bounded tiles however large a list is; each tile reports its k best for each query.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; ties go to the smaller id; repeated rows are candidates of their own (a query leaves out its own row only); null
ids take no part; with fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import column, settle, whole_groups

K, LISTS, BLOCK, EPSILON = 5, 64, 16, 2.1
#: Of the sampled vectors' true neighbours, those that the probed lists must hold; vectors, in k, that the probed lists of
#: every query hold at least (all there are, if fewer).
TARGET, PLENTY = 0.97, 8
SAMPLE_BYTES, ROUNDS, SEED = 16 << 20, 8, 7
#: Candidates and queries of a tile.
CHUNK, QUERIES = 4096, 512
EVERY = 50


def matrix(vectors: pa.Array) -> np.ndarray:
    """List column (equal lengths, no nulls) → double matrix."""
    if not len(vectors):
        return np.zeros((0, 0))
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    return values.reshape(len(vectors), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of tiny or huge components leave the range of doubles
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with the rows of x, each summed in the same order whatever the block."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(1, keepdims=True)
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


class Index:
    """Centroids (unit vectors) and the number of lists to probe."""

    def __init__(self, centroids: np.ndarray, probes: int):
        self.centroids, self.probes = centroids, probes

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(unit(x) @ self.centroids.T), axis=1, kind="stable")[:, :n]


def fit(sample: np.ndarray, lists: int = LISTS, k: int = K) -> Index:
    x = unit(sample)
    rng = np.random.default_rng(SEED)
    lists = max(1, min(lists, len(x) // 64))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        filled = np.sqrt((sums * sums).sum(1)) > 1e-12
        centroids[filled] = unit(sums[filled])
    own = (x @ centroids.T).argmax(1)
    asked = rng.choice(len(x), min(500, len(x)), replace=False)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1, kind="stable"), axis=1)
    found = np.take_along_axis(place, own[top], axis=1)
    share = np.cumsum(np.bincount(found.ravel(), minlength=lists)) / max(found.size, 1)
    return Index(centroids, int(np.searchsorted(share, TARGET)) + 1 if found.size else lists)


def scan(q: np.ndarray, x: np.ndarray, turned_q: np.ndarray, turned: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cosines of the k nearest of x: adaptive scan of the turned unit vectors, then exact scores."""
    dim = turned.shape[1]
    kept: list[np.ndarray] = []
    best = np.full(k, np.inf)
    for at in range(0, len(x), 1024):
        rows = np.arange(at, min(at + 1024, len(x)))
        partial = np.zeros(len(rows))
        for lo in range(0, dim, BLOCK):
            hi = min(lo + BLOCK, dim)
            gap = turned[rows, lo:hi] - turned_q[lo:hi]
            partial = partial + (gap * gap).sum(1)
            if hi < dim and np.isfinite(best[-1]):
                stay = np.sqrt(partial * dim / hi) <= (1 + EPSILON / np.sqrt(hi)) * np.sqrt(best[-1]) + 1e-9
                rows, partial = rows[stay], partial[stay]
        best = np.sort(np.concatenate([best, partial]))[:k]
        near = partial <= best[-1] + 1e-9
        kept.append(rows[near])
    rows = np.concatenate(kept) if kept else np.zeros(0, int)
    score = cosine(q, x[rows]) if len(rows) else np.zeros(0)
    order = np.lexsort((ids[rows], -score))[:k]
    return rows[order], score[order]


RESULT = "qrow long, query_id long, vec_id long, score double"


def _tiles(turn: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "job"):
            job, side, row, ids = (table.column(c).to_numpy() for c in ("job", "side", "row", "id"))
            vectors = matrix(table.column("vector").combine_chunks())
            bounds = np.flatnonzero(np.r_[True, job[1:] != job[:-1], True])
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                asked, there = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                if not len(asked) or not len(there):
                    continue
                x = vectors[there]
                turned, turned_q = unit(x) @ turn, unit(vectors[asked]) @ turn
                out = []
                for n, at in enumerate(asked.tolist()):
                    others = np.flatnonzero(row[there] != row[at])
                    whole = len(others) == len(there)
                    got, score = scan(vectors[at], x if whole else x[others], turned_q[n], turned if whole else turned[others], ids[there if whole else there[others]], k)
                    out.append((np.full(len(got), row[at]), np.full(len(got), ids[at]), ids[there[others[got]]], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["qrow", "query_id", "vec_id", "score"])

    return run


def _listed(shared, sizes: np.ndarray | None, least: int = 0):
    """(row, id, vector, list): the nearest list of each vector; with the ``sizes`` of all lists, the probed ones: as many as
    the index says, and further ones until they hold ``least`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            near = index.nearest(matrix(batch.column("vector")), 1 if sizes is None else len(index.centroids))
            taken = np.ones(near.shape, bool)
            if sizes is not None:
                held = np.cumsum(sizes[near], axis=1) - sizes[near]
                taken = (np.arange(near.shape[1])[None] < index.probes) | (held < least)
            at, place = np.nonzero(taken)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in ("row", "id", "vector")], pa.array(near[at, place].astype(np.int32))], names=["row", "id", "vector", "list"])

    return run


def search(vectors: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which ``asked`` (a condition on ``id``) holds."""
    spark = vectors.sparkSession
    raw = vectors.select(column(vectors, id_col).cast("long").alias("id"), column(vectors, vector_col).cast("array<double>").alias("vector"))
    sound = F.col("id").isNotNull() & F.col("vector").isNotNull() & F.exists("vector", lambda v: v != 0)
    sound &= F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    raw = raw.where(F.coalesce(sound, F.lit(False)))
    sizes = {r.dim: r.n for r in raw.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ((dim, n),) = sizes.items()
    raw = settle(raw.where(F.size("vector") == dim).select(F.monotonically_increasing_id().alias("row"), "id", "vector"), "vectors")
    most = max(64, SAMPLE_BYTES // (8 * dim))
    draw = F.shiftrightunsigned(F.xxhash64("row"), 11) / F.lit(float(1 << 53))
    sample = raw.where(draw < most / n).select("vector").orderBy(F.xxhash64("vector")).limit(most).toArrow()
    drawn = matrix(sample.column("vector").combine_chunks())
    if not len(drawn):
        drawn = matrix(raw.select("vector").limit(1).toArrow().column("vector").combine_chunks())
    index = fit(drawn, lists, k)
    shared = spark.sparkContext.broadcast((index.centroids, index.probes))
    schema = "row long, id long, vector array<double>, list int"
    there = settle(raw.mapInArrow(_listed(shared, None), schema), "lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in there.groupBy("list").count().collect():  # one row for each list
        sizes[r["list"]] = r["count"]
    wanted = settle(raw.where(asked).mapInArrow(_listed(shared, sizes, PLENTY * k + 1), schema), "probes")

    # One row for each list, so at most LISTS rows are broadcast.
    size = F.broadcast(there.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    load = F.broadcast(wanted.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")))
    plan = there.join(size, "list").join(load, "list").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")))
    plan = plan.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ask = wanted.join(size, "list").join(load, "list").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    ask = ask.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = [d.select(F.xxhash64("list", F.col("chunk").cast("int"), F.col("block").cast("int")).alias("job"), F.lit(s).alias("side"), "row", "id", "vector") for d, s in ((ask, 0), (plan, 1))]
    dealt = parts[0].unionByName(parts[1]).repartition("job").sortWithinPartitions("job")
    found = dealt.mapInArrow(_tiles(rotation(dim), k), RESULT)
    rank = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % EVERY == 0)
