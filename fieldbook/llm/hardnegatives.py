"""Hard negatives by a GNAT-style multiway tree.

A row's score is the inner product of its quantised vector with the anchor's. With one more coordinate, that makes all rows
equally long, a score is a distance: high scores are near, and a window of scores is an annulus around the anchor.

A node of the tree has up to ``FANOUT`` split points, far from each other; a row belongs to the nearest one, so that
hyperplanes part the siblings. Each split point stores the least and greatest distance from it to the rows of each
sibling's subtree. An anchor whose annulus is [lo, hi] and whose distance to a split point is d can only meet rows at
distances between max(d - hi, lo - d) and d + hi from that point; siblings whose stored range lies outside are eliminated.
Leaves that are left are compared exactly.

The split points come from a bounded sample (``SAMPLE_BYTES`` of vectors); every row is put into a leaf and every row
counts for the ranges. The sample also narrows the annuli: an anchor's fifth best score in it bounds what can still enter.
Leaves are cut into chunks and the anchors of a leaf into blocks, so a task compares bounded tiles however large a leaf is;
each tile reports its best for each anchor and window.

Edge cases: null ids, null labels, vectors that are null, empty, hold null or non-finite components or are not of the
most frequent length, and components beyond 2 ** 27 after quantising take no part; repeated rows are rows of their own (an
anchor leaves out its own row only); equal scores go to the smaller id, equal ids to the row stored first; with fewer
rows than asked all are returned; a window of a negative score is empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import column, settle, whole_groups

EVERY, RELABELLED, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least PART / WHOLE of the positive and at most as much.
PART, WHOLE = 4, 5
FANOUT, SAMPLE_BYTES, SEED = 8, 16 << 20, 11
#: Rows of a leaf that is not split, leaves of a tree, bytes of the vectors of one side of a tile.
LEAF, LEAVES, TILE_BYTES = 1024, 4096, 2 << 20
#: Anchors that are scored at once.
SLICE = 256
LARGEST = 1 << 27
NONE = np.iinfo(np.int64).min


def matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b; through doubles where these are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 1 << 53 else a @ b.T


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    """Rows with one more coordinate that makes every squared length ``square``."""
    x = x.astype(float)
    return np.c_[x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


class Node:
    """Split points, children (a node's number, or -1 - the leaf's) and, by (point, sibling), ranges of distances."""

    def __init__(self, points: np.ndarray, children: list[int]):
        self.points, self.children = points, children
        self.low = self.high = np.zeros((0, 0))


class Tree:
    def __init__(self, square: float):
        self.square, self.nodes, self.leaves = square, [], 0

    def fit(self, x: np.ndarray, rows: float) -> Tree:
        """Split a sample ``x`` (lifted), of which each row stands for so many of the table."""
        self._grow(x, rows, np.random.default_rng(SEED), LEAVES)
        return self

    def _grow(self, x: np.ndarray, rows: float, rng: np.random.Generator, most: int) -> int:
        points = self._points(x, rng) if len(x) * rows > LEAF and len(x) >= 4 * FANOUT and most > FANOUT else x[:0]
        if len(points) < 2:
            if self.nodes:
                self.leaves += 1
                return -self.leaves
            points = x[:1]  # a tree of one leaf
            own = np.zeros(len(x), int)
        else:
            own = distances(x, points).argmin(1)
        number = len(self.nodes)
        self.nodes.append(Node(points, []))
        for j in range(len(points)):
            self.nodes[number].children.append(self._grow(x[own == j], rows, rng, most // FANOUT))
        return number

    @staticmethod
    def _points(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Greedily, each the farthest from those before, out of a few drawn rows."""
        drawn = x[rng.choice(len(x), min(3 * FANOUT, len(x)), replace=False)]
        chosen, gap = [0], distances(drawn, drawn[:1])[:, 0]
        while len(chosen) < FANOUT and gap.max() > 1e-6:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(drawn, drawn[chosen[-1:]])[:, 0])
        return drawn[chosen]

    def place(self, x: np.ndarray, seen: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """Leaf of each row of ``x`` (lifted); ``seen`` takes the least and greatest distances met, by node."""
        leaf = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            number, rows = todo.pop()
            node = self.nodes[number]
            gaps = distances(x[rows], node.points)
            own = gaps.argmin(1)
            for j, child in enumerate(node.children):
                mine = own == j
                if not mine.any():
                    continue
                if seen is not None:
                    k = len(node.points)
                    low, high = seen.setdefault(number, (np.full((k, k), np.inf), np.full((k, k), -np.inf)))
                    low[:, j], high[:, j] = np.minimum(low[:, j], gaps[mine].min(0)), np.maximum(high[:, j], gaps[mine].max(0))
                if child < 0:
                    leaf[rows[mine]] = -1 - child
                else:
                    todo.append((child, rows[mine]))
        return leaf

    def meet(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf) pairs that may hold scores from ``low`` to ``high`` of each anchor."""
        a = np.c_[anchors.astype(float), np.zeros(len(anchors))]
        both = (a * a).sum(1) + self.square
        slack = 1e-6 * (1 + np.sqrt(both))
        near = np.sqrt(np.maximum(both - 2 * high, 0)) - slack
        far = np.sqrt(np.maximum(both - 2 * low, 0)) + slack
        found = []
        todo = [(0, np.flatnonzero(low <= high))]
        while todo:
            number, rows = todo.pop()
            node = self.nodes[number]
            gap = distances(a[rows], node.points)
            least = np.maximum(gap - far[rows, None], near[rows, None] - gap)
            alive = ((node.high[None] >= least[:, :, None]) & (node.low[None] <= (gap + far[rows, None])[:, :, None])).all(1)
            for j, child in enumerate(node.children):
                mine = rows[alive[:, j]]
                if child >= 0 and len(mine):
                    todo.append((child, mine))
                elif len(mine):
                    found.append((mine, np.full(len(mine), -1 - child)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the k best of each line of ``scores`` (NONE: takes no part), by score, id and row."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        i, j = np.nonzero((scores >= least[:, None]) & (scores > NONE))
    else:
        i, j = np.nonzero(scores > NONE)
    order = np.lexsort((rows[j], ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def fifth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each line; NONE where there are fewer."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), NONE)


def lowest(score: np.ndarray) -> np.ndarray:
    """The least score of a negative for a positive's score."""
    return -((-PART * score) // WHOLE)


class Sample:
    def __init__(self, row, label, vector):
        self.row, self.label, self.vector = row, label, vector

    def scores(self, row: np.ndarray, label: np.ndarray, vector: np.ndarray, alike: bool) -> np.ndarray:
        out = inner(vector, self.vector)
        ok = (self.label[None] == label[:, None]) == alike
        return np.where(ok & (self.row[None] != row[:, None]), out, NONE)


def _asks(shared, dim: int, negatives: bool, k: int):
    """(leaf, row, id, label, vector, windows): the leaves that each anchor meets, with its windows of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sample = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                row, label = (batch.column(c).to_numpy() for c in ("row", "label"))
                vector = matrix(batch.column("vector"), dim)
                scores = sample.scores(row, label, vector, not negatives)
                if negatives:
                    given = [np.array(s, np.int64) for s in batch.column("scores").to_pylist()]
                    windows = []
                    for n, own in enumerate(given):
                        low = lowest(own)
                        inside = np.where((scores[n][None] >= low[:, None]) & (scores[n][None] <= own[:, None]), scores[n][None], NONE)
                        windows.append([(int(max(a, b)), int(c)) for a, b, c in zip(low, fifth(inside, k), own, strict=True)])
                else:
                    windows = [[(int(s), LARGEST**2 * dim)] for s in fifth(scores, k)]
                open_ = [[w for w in ws if w[0] <= w[1]] for ws in windows]
                low = np.array([min((a for a, _ in ws), default=1.0) for ws in open_], float)
                high = np.array([max((b for _, b in ws), default=0.0) for ws in open_], float)
                low[low <= float(NONE)] = -np.inf
                one, leaf = tree.meet(vector, low, high)
                take = pa.array(one)
                flat = pa.array([[x for w in windows[n] for x in w] for n in one.tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *(batch.column(c).take(take) for c in ("row", "id", "label", "vector")), flat], names=["leaf", "row", "id", "label", "vector", "windows"])

    return run


def _tiles(dim: int, negatives: bool, k: int):
    """The k best of a tile's rows for each anchor and window."""
    names = ["anchor", "anchor_id", "slot", "row", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "job"):
            job, side, row, ids, label = (table.column(c).to_numpy() for c in ("job", "side", "row", "id", "label"))
            vector, windows = matrix(table.column("vector"), dim), table.column("windows")
            bounds = np.flatnonzero(np.r_[True, job[1:] != job[:-1], True])
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                asked, there = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                for at in range(0, len(asked) if len(there) else 0, SLICE):
                    own = asked[at : at + SLICE]
                    scores = inner(vector[own], vector[there])
                    alike = label[there][None] == label[own][:, None]
                    scores = np.where((~alike if negatives else alike) & (row[there][None] != row[own][:, None]), scores, NONE)
                    given = windows.take(pa.array(own)).to_pylist()
                    for slot in range(max(len(w) for w in given) // 2):
                        low, high = (np.array([w[2 * slot + n] if len(w) > 2 * slot else -n for w in given]) for n in (0, 1))
                        inside = np.where((scores >= low[:, None]) & (scores <= high[:, None]), scores, NONE)
                        i, j = best(inside, ids[there], row[there], k)
                        a, b = own[i], there[j]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (row[a], ids[a], np.full(len(a), slot, np.int32), row[b], ids[b], inside[i, j])], names=names)

    return run


class Index:
    """Rows of all leaves (leaf, row, id, label, vector), the tree and the sample."""

    def __init__(self, rows: DataFrame, shared, dim: int):
        self.rows, self.shared, self.dim = rows, shared, dim

    def probe(self, anchors: DataFrame, negatives: bool, k: int) -> DataFrame:
        """(anchor, anchor_id, slot, row, id, score): the k best for each anchor and window."""
        schema = "leaf int, row long, id long, label long, vector array<bigint>, windows array<bigint>"
        asks = settle(anchors.mapInArrow(_asks(self.shared, self.dim, negatives, k), schema), "asks")
        side = max(64, TILE_BYTES // (8 * self.dim))
        # One row for each leaf, so at most a few thousand rows are broadcast.
        size = F.broadcast(self.rows.groupBy("leaf").agg(F.ceil(F.count("*") / side).cast("int").alias("chunks")))
        load = F.broadcast(asks.groupBy("leaf").agg(F.ceil(F.count("*") / side).cast("int").alias("blocks")))
        there = self.rows.join(size, "leaf").join(load, "leaf").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
        there = there.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("windows", F.lit(None).cast("array<bigint>"))
        ask = asks.join(size, "leaf").join(load, "leaf").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        ask = ask.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        parts = [d.select(F.xxhash64("leaf", "chunk", "block").alias("job"), F.lit(s).alias("side"), "row", "id", "label", "vector", "windows") for d, s in ((ask, 0), (there, 1))]
        dealt = parts[0].unionByName(parts[1]).repartition("job").sortWithinPartitions("job")
        found = dealt.mapInArrow(_tiles(self.dim, negatives, k), "anchor long, anchor_id long, slot int, row long, id long, score long")
        place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)


def index(raw: DataFrame, dim: int) -> Index:
    """Tree over the rows ``raw`` (row, id, label, vector), a stored frame."""
    spark = raw.sparkSession
    square = F.aggregate("vector", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)
    n, most = raw.agg(F.count("*"), F.max(square)).first()
    wanted = max(64, SAMPLE_BYTES // (8 * dim))
    draw = F.shiftrightunsigned(F.xxhash64("row"), 11) / F.lit(float(1 << 53))
    drawn = raw.where(draw < wanted / n).select("row", "label", "vector").orderBy("row").limit(2 * wanted).toArrow()
    sample = Sample(drawn.column("row").to_numpy(), drawn.column("label").to_numpy(), matrix(drawn.column("vector"), dim))
    x = lifted(sample.vector, most) if drawn.num_rows else np.zeros((1, dim + 1))
    tree = Tree(most).fit(x, n / max(drawn.num_rows, 1))
    shared = spark.sparkContext.broadcast(tree)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.place(lifted(matrix(batch.column("vector"), dim), shared.value.square))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", *batch.schema.names])

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            shared.value.place(lifted(matrix(batch.column("vector"), dim), shared.value.square), seen)
        for number, (low, high) in seen.items():
            i, j = np.nonzero(np.isfinite(low))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), number, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(low[i, j]), pa.array(high[i, j])], names=["node", "i", "j", "low", "high"])

    rows = settle(raw.mapInArrow(put, "leaf int, row long, id long, label long, vector array<bigint>"), "leaves")
    ranges = raw.mapInArrow(span, "node int, i int, j int, low double, high double").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    for node in tree.nodes:
        node.low, node.high = (np.full((len(node.points),) * 2, v) for v in (np.inf, -np.inf))
    for r in ranges.to_pylist():
        tree.nodes[r["node"]].low[r["i"], r["j"]], tree.nodes[r["node"]].high[r["i"], r["j"]] = r["low"], r["high"]
    return Index(rows, spark.sparkContext.broadcast((tree, sample)), dim)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, asked: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """For each anchor (a row for which ``asked``, a condition on ``id``, holds) and each of its first ``positives`` rows of
    the same label, the first ``negatives`` rows of other labels in the window of that positive's score."""
    raw = vectors.select(column(vectors, id_col).cast("long").alias("id"), column(vectors, label_col).cast("long").alias("label"), column(vectors, vector_col).cast("array<double>").alias("vector"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(F.floor(v * scale)) <= LARGEST))
    raw = raw.where(F.coalesce(sound, F.lit(False)) & (F.size("vector") > 0))
    first = raw.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    raw = raw.where(F.size("vector") == first.dim).select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("vector", lambda v: F.floor(v * scale).cast("long")).alias("vector"))
    raw = settle(raw, "vectors")  # numbers and rows are written together
    tree = index(raw, first.dim)
    anchors = raw.where(asked)
    near = settle(tree.probe(anchors, False, positives).select("anchor", F.col("id").alias("positive_id"), (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score")), "positives")
    # At most ``positives`` scores of an anchor are gathered.
    scores = near.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    far = tree.probe(anchors.join(scores, "row"), True, negatives).select("anchor", "anchor_id", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and each of its five nearest of the same label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("id") % EVERY == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 5
"""
