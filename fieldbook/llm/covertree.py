"""Near-duplicate embeddings by dual traversal of cover trees.

Two vectors of the same label link when their cosine is at least ``LEAST``; between unit vectors that is a distance, so the
search is one for all pairs within a radius. Equal vectors of a label are folded first.

A cover tree has nested levels with halving radii: a node of level i stands for the points within 2 ** (1 - i) of its
centre, its children are centres among them that are more than half of that apart, the node's own centre being one of them.
Two trees are traversed together: a pair of nodes is pruned when their centres are farther apart than both covering radii
(the greatest distances really met) and the search radius together; when even the farthest points are near enough the pair is taken as a
whole; otherwise the wider node is opened. What comes down to two points is decided by the cosine itself in double precision.

On the cluster, the topmost level is a set of pivots from a bounded sample (farthest first, so each prefix is nested in the
next). Every vector belongs to the cell (label, nearest pivot), and visits the cells before its own whose covering radius
(or whose border to its own cell) it may reach. Cells are cut into tiles of bounded size; a task builds the trees of a tile's two sides,
traverses them and reports sums of links for each point and a spanning forest of the links, never the pairs. Components are found by contraction.

Edge cases: null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths do not link; repeated rows and equal vectors link with each other; a null id never names a
component unless all of its ids are null (then ``kept`` is false); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import column, components, settle, union, whole_groups

LEAST = 0.98
SAMPLE_BYTES, SEED = 16 << 20, 13
#: Points of a cell aimed at, bytes of the vectors of one side of a tile.
CELL, TILE_BYTES = 1024, 1 << 20
#: Node pairs whose distances are computed at once; from so many pairs of children on by a matrix product.
PAIRS, PRODUCT = 1 << 16, 64
SLACK = 1e-7


def matrix(vectors, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of tiny or huge components leave the range of doubles
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of a and b, unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def reach(least: float) -> float:
    """Distance of unit vectors whose cosine is ``least``."""
    return float(np.sqrt(2 - 2 * least))


class CoverTree:
    """Nodes of a cover tree over unit vectors ``x``: ``centre`` (a row of x), covering ``radius``, the points
    ``order[first:last]`` below it and its children ``children[start:stop]``; a leaf has none. Node 0 is the root."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        centre, radius, first, last, start, stop, children = [0], [0.0], [0], [len(x)], [0], [0], []
        away = gaps(x, x[:1])[:, 0]
        away[0] = 0.0
        radius[0] = float(away.max())
        todo = [(0, 1.0, away)]
        while todo:
            node, scale, away = todo.pop()
            lo, hi = first[node], last[node]
            if hi - lo == 1 or radius[node] == 0:
                continue
            while scale >= radius[node]:
                scale /= 2
            own = self.order[lo:hi]
            chosen, of = [centre[node]], np.zeros(hi - lo, int)
            near = away.copy()
            while True:
                k = int(near.argmax())
                if near[k] <= scale:
                    break
                fresh = gaps(x[own], x[own[k] : own[k] + 1])[:, 0]
                fresh[k] = 0.0
                closer = fresh < near
                near[closer], of[closer] = fresh[closer], len(chosen)
                chosen.append(int(own[k]))
            by = np.argsort(of, kind="stable")
            self.order[lo:hi] = own[by]
            near = near[by]
            ends = np.cumsum(np.bincount(of, minlength=len(chosen)))
            start[node], stop[node] = len(children), len(children) + len(chosen)
            for c, e in zip(chosen, ends.tolist(), strict=True):
                at = lo if not children or len(children) == start[node] else last[children[-1]]
                children.append(len(centre))
                part = near[at - lo : e]
                centre.append(c)
                radius.append(float(part.max()))
                first.append(at)
                last.append(lo + e)
                start.append(0)
                stop.append(0)
                todo.append((len(centre) - 1, scale / 2, part))
        self.centre, self.radius, self.first, self.last = np.array(centre), np.array(radius), np.array(first), np.array(last)
        self.start, self.stop, self.children = np.array(start), np.array(stop), np.array(children, int)

    def under(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, child) of all children."""
        n = self.stop[nodes] - self.start[nodes]
        at = np.repeat(np.arange(len(nodes)), n)
        return at, self.children[np.repeat(self.start[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())]


class Links:
    """Sums of linked weights for each point and the sets of linked points, of points numbered over both sides."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.sum = weight, np.zeros(len(weight), np.int64)
        self.label = np.arange(len(weight))
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.sum, a, self.weight[b])
        np.add.at(self.sum, b, self.weight[a])
        self.a.append(a)
        self.b.append(b)

    def whole(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """All points of a with all of b; b None: all points of a with each other."""
        if b is None:
            self.sum[a] += self.weight[a].sum() - self.weight[a]
            b = a
        else:
            self.sum[a] += self.weight[b].sum()
            self.sum[b] += self.weight[a].sum()
        self.a += [a, b]
        self.b += [np.full(len(a), b[0]), np.full(len(b), a[0])]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        if self.a:
            self.label = union(self.label, np.concatenate(self.a), np.concatenate(self.b))
        child = np.flatnonzero(self.label != np.arange(len(self.label)))
        return child, self.label[child]


def dual(left: CoverTree, right: CoverTree | None, raw: np.ndarray, shift: int, links: Links, least: float = LEAST) -> None:
    """Traverse two trees (right None: one tree with itself) and tell ``links`` what links; ``raw`` has the vectors of both sides,
    those of the right one from ``shift`` on."""
    other, far = right or left, reach(least)
    i, j = np.zeros(1, int), np.zeros(1, int)
    gap = gaps(left.x[left.centre[:1]], other.x[other.centre[:1]])[0]
    while len(i):
        ra, rb = left.radius[i], other.radius[j]
        same = (i == j) if right is None else np.zeros(len(i), bool)
        stay = same | (gap <= ra + rb + far + SLACK)
        i, j, gap, ra, rb, same = (v[stay] for v in (i, j, gap, ra, rb, same))
        sure = np.where(same, 2 * ra, gap + ra + rb) <= far - SLACK
        one = (left.last[i] - left.first[i] == 1) & (other.last[j] - other.first[j] == 1)
        shut = (left.start[i] == left.stop[i]) & (other.start[j] == other.stop[j])
        for p in np.flatnonzero((sure | shut) & ~one).tolist():
            a = left.order[left.first[i[p]] : left.last[i[p]]]
            b = None if same[p] else other.order[other.first[j[p]] : other.last[j[p]]] + shift
            if sure[p]:
                links.whole(a, b)
                continue
            a, b = np.repeat(a, len(b)), np.tile(b, len(a))  # points of one direction, just at the border
            near = cosines(raw[a], raw[b]) >= least
            links.pairs(a[near], b[near])
        ends = np.flatnonzero(one & ~same)
        for at in range(0, len(ends), PAIRS):
            part = ends[at : at + PAIRS]
            a, b = left.centre[i[part]], other.centre[j[part]] + shift
            near = cosines(raw[a], raw[b]) >= least
            links.pairs(a[near], b[near])
        todo = ~sure & ~shut
        i, j, gap = opened(left, other, i[todo], j[todo], right is None, far + SLACK)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def opened(left: CoverTree, other: CoverTree, i: np.ndarray, j: np.ndarray, alone: bool, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node pairs below (i, j) and the distances of their centres: of equal nodes all pairs of children, else, where there
    are many, the children of both, where there are few, those of the wider node with the other."""
    out = []
    same = (i == j) if alone else np.zeros(len(i), bool)
    for node in i[same].tolist():
        own = left.children[left.start[node] : left.stop[node]]
        d, wide = gaps(left.x[left.centre[own]], left.x[left.centre[own]]), left.radius[own]
        np.fill_diagonal(d, 0.0)
        a, b = np.nonzero(np.triu(d <= wide[:, None] + wide[None] + far))
        out.append((own[a], own[b], d[a, b]))
    i, j = i[~same], j[~same]
    kids, kids2 = left.stop[i] - left.start[i], other.stop[j] - other.start[j]
    large = kids * kids2 >= PRODUCT
    for a, b in zip(i[large].tolist(), j[large].tolist(), strict=True):
        own, theirs = left.children[left.start[a] : left.stop[a]], other.children[other.start[b] : other.stop[b]]
        d = gaps(left.x[left.centre[own]], other.x[other.centre[theirs]])
        p, q = np.nonzero(d <= left.radius[own][:, None] + other.radius[theirs][None] + far)
        out.append((own[p], theirs[q], d[p, q]))
    i, j, kids, kids2 = (v[~large] for v in (i, j, kids, kids2))
    wide = (kids > 0) & ((left.radius[i] >= other.radius[j]) | (kids2 == 0))
    at, child = left.under(i[wide])
    at2, child2 = other.under(j[~wide])
    a, b = np.r_[child, i[~wide][at2]], np.r_[j[wide][at], child2]
    for s in range(0, len(a), PAIRS):
        p, q = a[s : s + PAIRS], b[s : s + PAIRS]
        out.append((p, q, np.sqrt(np.maximum(2 - 2 * (left.x[left.centre[p]] * other.x[other.centre[q]]).sum(1), 0))))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _cells(shared, dim: int, least: float, visits: bool):
    """The cell of each vector; with ``visits`` also the cells before it that it may reach (side 1)."""
    far = reach(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius = shared.value
        between = gaps(pivots, pivots)
        for batch in batches:
            x = unit(matrix(batch.column("vector"), dim))
            gap = gaps(x, pivots)
            own = gap.argmin(1)
            mine = gap[np.arange(len(x)), own]
            if not visits:
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(mine)], names=["cell", "gap"])
                continue
            # The covering radius of the cell, then the distance to the plane half way between the two pivots.
            may = (gap <= radius[None] + far + SLACK) & (gap**2 - mine[:, None] ** 2 <= 2 * (far + SLACK) * between[own] + SLACK)
            may &= np.arange(len(pivots))[None] < own[:, None]
            row, cell = np.nonzero(may)
            row, cell, side = np.r_[np.arange(len(x)), row], np.r_[own, cell], np.repeat([0, 1], (len(x), len(row)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(side.astype(np.int32)), *(batch.column(c).take(take) for c in ("node", "label", "n", "vector"))], names=["cell", "side", "node", "label", "n", "vector"])

    return run


def _tiles(least: float):
    """Sums of links (node, n) and a spanning forest (node, other) of each job's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "job"):
            job, side, node, n = (table.column(c).to_numpy() for c in ("job", "side", "node", "n"))
            bounds = np.flatnonzero(np.r_[True, job[1:] != job[:-1], True])
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                order = s + np.argsort(side[s:e], kind="stable")
                shift = int((side[s:e] == 0).sum())
                alone = side[order[-1]] == 0
                if not shift or alone and len(order) < 2:
                    continue
                vectors = table.column("vector").take(pa.array(order))
                raw = matrix(vectors, len(vectors[0]))
                x, links = unit(raw), Links(n[order])
                if alone:
                    dual(CoverTree(x), None, raw, 0, links, least)
                else:
                    dual(CoverTree(x[:shift]), CoverTree(x[shift:]), raw, shift, links, least)
                found = np.flatnonzero(links.sum)
                if not len(found):
                    continue
                child, root = links.forest()
                a = np.r_[node[order[found]], node[order[child]]]
                b = pa.array(np.r_[np.zeros(len(found), np.int64), node[order[root]]], mask=np.repeat([True, False], (len(found), len(child))))
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.r_[links.sum[found], np.zeros(len(child), np.int64)])], names=["node", "other", "n"])

    return run


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` of the sample's unit vectors in farthest-first order."""
    x = unit(sample)
    chosen, gap = [0], gaps(x, x[:1])[:, 0]
    while len(chosen) < min(count, len(x)) and gap.max() > 1e-6:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, gaps(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def linked(nodes: DataFrame, dim: int, least: float = LEAST, cell: int = CELL) -> DataFrame:
    """(node, other, n) of the distinct vectors ``nodes`` (node, label, n, vector of length ``dim``): sums of links where
    ``other`` is null, else links that keep every component connected."""
    spark = nodes.sparkSession
    groups = nodes.groupBy("label").count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    wanted = max(64, SAMPLE_BYTES // (8 * dim))
    draw = F.shiftrightunsigned(F.xxhash64("node", F.lit(SEED)), 11) / F.lit(float(1 << 53))
    drawn = nodes.where(draw < wanted / max(groups["all"] or 1, 1)).select("node", "vector").orderBy("node").limit(2 * wanted).toArrow()
    if not drawn.num_rows:
        drawn = nodes.select("node", "vector").orderBy("node").limit(1).toArrow()
    # No more pivots than the root of the number of vectors, so what is broadcast grows as that root.
    count = min(-(-(groups["most"] or 1) // cell), int(np.ceil(np.sqrt(groups["all"] or 1))))
    pivots = pivots_of(matrix(drawn.column("vector"), dim), count) if drawn.num_rows else np.zeros((0, dim))
    first = spark.sparkContext.broadcast((pivots, None))
    radius = np.zeros(len(pivots))
    for r in nodes.mapInArrow(_cells(first, dim, least, False), "cell int, gap double").groupBy("cell").agg(F.max("gap").alias("gap")).collect():
        radius[r.cell] = r.gap  # one row for each pivot
    shared = spark.sparkContext.broadcast((pivots, radius))
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    dealt = settle(nodes.mapInArrow(_cells(shared, dim, least, True), f"cell int, side int, node long, label {kinds['label']}, n long, vector array<double>"), "cells")

    # Tiles: members and visitors of a cell in chunks of bounded size; each chunk of members meets itself and each later one,
    # and each chunk of visitors meets each chunk of members.
    tile = max(64, TILE_BYTES // (8 * dim))
    key = ["label", "cell"]
    sizes = dealt.groupBy(*key).agg(*[F.ceil(F.count(F.when(F.col("side") == s, 1)) / tile).cast("int").alias(name) for s, name in ((0, "members"), (1, "visitors"))])
    placed = dealt.join(settle(sizes, "sizes"), key)
    chunk = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("members")).otherwise(F.col("visitors"))).cast("int")
    placed = placed.withColumn("chunk", chunk)
    meets = lambda low, high, one: F.transform(F.sequence(low, high), one)
    pair = lambda a, b, visitor, side: F.struct(a.alias("a"), b.alias("b"), F.lit(visitor).alias("v"), F.lit(side).alias("at"))
    none = F.array().cast("array<struct<a:int,b:int,v:int,at:int>>")
    member = F.concat(
        meets(F.col("chunk"), F.col("members") - 1, lambda k: pair(F.col("chunk"), k, 0, 0)),
        F.when(F.col("chunk") > 0, meets(F.lit(0), F.col("chunk") - 1, lambda k: pair(k, F.col("chunk"), 0, 1))).otherwise(none),
        F.when(F.col("visitors") > 0, meets(F.lit(0), F.col("visitors") - 1, lambda k: pair(F.col("chunk"), k, 1, 0))).otherwise(none),
    )
    visitor = F.when(F.col("members") > 0, meets(F.lit(0), F.col("members") - 1, lambda k: pair(k, F.col("chunk"), 1, 1))).otherwise(none)
    jobs = placed.withColumn("meet", F.explode(F.when(F.col("side") == 0, member).otherwise(visitor)))
    jobs = jobs.select(F.xxhash64(*key, "meet.a", "meet.b", "meet.v").alias("job"), F.col("meet.at").alias("side"), "node", "n", "vector")
    return jobs.repartition("job").sortWithinPartitions("job").mapInArrow(_tiles(least), "node long, other long, n long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", least: float = LEAST, cell: int = CELL) -> DataFrame:
    """(id, n_links, component_id, kept) of each row of ``vectors``."""
    rows = vectors.select(column(vectors, id_col).alias("id"), column(vectors, label_col).alias("label"), column(vectors, vector_col).cast("array<double>").alias("vector"), F.monotonically_increasing_id().alias("row"))
    sound = F.col("label").isNotNull() & F.exists("vector", lambda v: v != 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = settle(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")  # numbers and rows are written together
    whole = rows.where("sound")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("first")
    nodes = settle(whole.groupBy("label", "vector").agg(F.min("row").alias("node"), F.count("*").alias("n"), first), "nodes")
    parts = [linked(nodes.where(F.size("vector") == r.dim).select("node", "label", "n", "vector"), r.dim, least, cell) for r in nodes.select(F.size("vector").alias("dim")).distinct().collect()]
    if not parts:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = settle(found, "found")
    sums = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    members = nodes.select("node", "n", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = settle(members, "members")
    # Written, so that both sides of the join are dealt anew and a hot component can be split.
    best = settle(members.groupBy("root").agg(F.min("first").alias("best")), "best")
    classes = members.join(best, "root").join(sums, "node", "left")
    classes = classes.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("best.id").alias("component_id"))
    # Rows find their class by the vector; the classes of a hot vector are one row.
    of = nodes.select("label", "vector", "node").join(settle(classes, "classes"), "node").drop("node")
    out = rows.join(of.withColumn("sound", F.lit(True)), ["label", "vector", "sound"], "left")
    own = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def op13_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label with a cosine of 0.98 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
