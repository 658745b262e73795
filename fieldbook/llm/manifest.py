"""Merkle manifest of a table: a proof for every row, by a cogrouped exchange of subtrees.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. Rows of a
language make a tree: ordered by id, every ``FAN`` consecutive nodes become the SHA-256 of their concatenated hex digests
until one is left, the subroot. The subroots, ordered by language, make one more tree in the same way, and its top is the root.

Leaves are range-sorted once and get their rank from the counts of the sorted parts. ``SUPER`` = FAN ** DEPTH consecutive
ranks are a superblock; runs never cross its border, so it reduces to one node by itself. These nodes are reduced in the
same way, until every tree has one node: a table of N rows takes log(N) / log(SUPER) rounds. On the way back, each
superblock's nodes are cogrouped with the one row that it needs from outside (the siblings on the way from its top to the
root), and one ``applyInPandas`` reduces the block, joins the proofs and folds the leaves up to the root.

No language, however large, meets in one task: a group is one superblock.

Edge cases: null languages are a tree of their own, the first; null ids come first in their tree and are never tampered;
rows of equal id are ordered by leaf, equal rows by their place in the table; null and empty texts differ in their
leaves; a tree of one leaf has that leaf as subroot; a proof without siblings is the SHA-256 of nothing; other columns
take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import column, fresh, numbered, settle

FAN, DEPTH = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every so many-th row, by the CRC-32 of its id, is tampered with by the query.
TAMPERED = 3
PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank``, the place (from 0) of each row within its ``tree`` in the order of ``order``.

    One range sort; the sorted parts are written, and a part's first ranks come from the counts of those before it.
    """
    place = F.monotonically_increasing_id()
    part = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    part = settle(part.withColumns({"part": F.shiftright(place, 33).cast("int"), "at": place.bitwiseAND(F.lit((1 << 33) - 1))}), "sorted")
    counts = part.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    upto = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("tree", "part", (F.sum("n").over(upto) - F.col("n") - F.col("first")).alias("shift"))
    return part.join(before, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(n: int, fan: int) -> int:
    """How often n nodes are reduced until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // fan), k + 1
    return k


def reduced(nodes: list[str], rounds: int, fan: int) -> list[list[str]]:
    """The nodes of each level, from ``nodes`` on."""
    levels = [nodes]
    for _ in range(rounds):
        last = levels[-1]
        levels.append([digest(last[i : i + fan]) for i in range(0, len(last), fan)])
    return levels


def _tops(fan: int, depth: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        rounds = min(depth, levels_above(int(block["size"].iloc[0]), fan))
        top = reduced(block["hash"].tolist(), rounds, fan)[-1][0]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "rank": [block["block"].iloc[0]], "hash": [top], "size": [-(-int(block["size"].iloc[0]) // fan**depth)]})

    return run


def _sides(levels: list[list[str]], at: int, fan: int) -> list[tuple[str, str]]:
    """What stands left and right of the node in its run, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fan
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fan])))
        at //= fan
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest((left, node, right))
    return node


def _outer(path) -> list[tuple[str, str]]:
    return [(x["left"], x["right"]) for x in path]


def _inner_paths(fan: int, depth: int):
    """Nodes of a superblock and the way from its top to the root: the way of each node."""

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        levels = reduced(block["hash"].tolist(), min(depth, levels_above(int(block["size"].iloc[0]), fan)), fan)
        outer = _outer(above["path"].iloc[0])
        paths = [[{"left": a, "right": b} for a, b in _sides(levels, k, fan) + outer] for k in range(len(block))]
        return pd.DataFrame({"tree": block["tree"], "rank": block["rank"], "path": paths})

    return run


def _proofs(fan: int, depth: int):
    """Leaves of a superblock and the way from its top to the root: subroot, root, proof and folded root of each leaf."""

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        leaves = block["hash"].tolist()
        levels = reduced(leaves, min(depth, levels_above(int(block["size"].iloc[0]), fan)), fan)
        outer, root = _outer(above["path"].iloc[0]), above["root"].iloc[0]
        tail = "".join(a + b for a, b in outer)
        own_top = levels[-1][0]
        own_end = fold(own_top, outer)
        proofs, folded = [], []
        for k, (own, other) in enumerate(zip(leaves, block["tampered"].tolist(), strict=True)):
            sides = _sides(levels, k, fan)
            top = fold(other if isinstance(other, str) else own, sides)
            proofs.append(digest([*(a + b for a, b in sides), tail]))
            folded.append(own_end if top == own_top else fold(top, outer))
        return pd.DataFrame({
            "id": block["id"], "leaf": leaves, "subroot": above["subroot"].iloc[0], "root": root,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        })

    return run


def _blocks(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("rank") / span).cast("long"))


def _sized(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``size``, the number of nodes of their tree."""
    return nodes.join(nodes.groupBy("tree").agg(F.count("*").alias("size")), "tree")


def climb(nodes: DataFrame, fan: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of nodes (tree, rank, hash, size, block) from the leaves up, and the top (tree, hash) of each tree."""
    nodes, rounds = _sized(nodes), []
    while True:
        rounds.append(settle(_blocks(nodes, fan**depth), "nodes"))
        blocks = rounds[-1].select("tree", "rank", "hash", "size", "block").groupBy("tree", "block")
        nodes = settle(blocks.applyInPandas(_tops(fan, depth), "tree string, rank long, hash string, size long"), "tops")
        if nodes.where("size > 1").isEmpty():
            return rounds, nodes.select("tree", "hash")


def paths(rounds: list[DataFrame], ways: DataFrame, fan: int, depth: int) -> DataFrame:
    """(tree, rank, path) of the superblocks of the first round: the way from their tops to the root.

    ``ways`` has (tree, path) of each tree's top. Each step cogroups the nodes of a round with the ways of its superblocks.
    """
    out = ways.select("tree", F.lit(0).cast("long").alias("rank"), "path")
    for nodes in reversed(rounds[1:]):
        left = nodes.select("tree", "rank", "hash", "size", "block").groupBy("tree", "block")
        out = left.cogroup(out.withColumnRenamed("rank", "block").groupBy("tree", "block")).applyInPandas(_inner_paths(fan, depth), f"tree string, rank long, path {PATH}")
    return out


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``fields`` names the id, source, language, length and text columns, in this order. ``tampered`` is the text that is
    put in a row's place before its leaf is folded (null or None: the row's own).
    """
    (row,) = fresh(docs, "row")
    rows = numbered(docs, row)
    id_, source, lang, length, text = (column(docs, c) for c in fields)
    own = leaf(id_, source, lang, length, text)
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf(id_, source, lang, length, tampered))
    language = lang.cast("string")
    tree = F.coalesce(F.concat(F.lit("s"), language), F.lit("n"))
    leaves = rows.select(tree.alias("tree"), id_.alias("id"), own.alias("hash"), other.alias("tampered"), F.col(row).alias("row"))
    leaves = ranked(leaves, ["id", "hash", "row"]).drop("row")
    leaves = leaves.withColumn("id", F.col("id").cast("string"))  # pandas makes longs with nulls to doubles
    rounds, tops = climb(leaves, fan, depth)

    # The tree of subroots: one more tree over all languages.
    subroots = ranked(tops.select(F.lit("all").alias("tree"), F.col("tree").alias("of"), "hash"), ["of"])
    above, top = climb(subroots, fan, depth)
    ways = paths(above, top.select("tree", F.array().cast(PATH).alias("path")), fan, depth)
    left = above[0].select("tree", "rank", "hash", "size", "block").groupBy("tree", "block")
    ways = left.cogroup(ways.withColumnRenamed("rank", "block").groupBy("tree", "block")).applyInPandas(_inner_paths(fan, depth), f"tree string, rank long, path {PATH}")
    of = above[0].select("rank", F.col("of").alias("tree"), F.col("hash").alias("subroot"))
    root = next((r.hash for r in top.collect()), None)  # one row at most
    ways = settle(ways.select("rank", "path").join(of, "rank").select("tree", "path", "subroot", F.lit(root).alias("root")), "ways")

    outer = paths(rounds, ways.select("tree", "path"), fan, depth).withColumnRenamed("rank", "block")
    outer = outer.join(ways.select("tree", "subroot", "root"), "tree")
    nodes = rounds[0].select("tree", "rank", "id", "hash", "tampered", "size", "block")
    kind = docs.select(id_.alias("id")).schema["id"].dataType.simpleString()
    schema = f"id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_proofs(fan, depth), schema).withColumn("id", F.col("id").cast(kind))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root to which its (partly tampered) leaf folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    out = manifest(docs, F.when(hit, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)))
    return out.withColumnRenamed("id", "doc_id")


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ord(substr({0}, i, 1))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: i::BIGINT)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"


def _sql_tree(name: str, leaves: str, levels: int) -> str:
    """Levels name_0 (tree, p, h), name_1, ... of the trees over ``leaves``; a tree of one node stays as it is."""
    out = [f"{name}_0 AS (SELECT tree, p, h, count(*) OVER (PARTITION BY tree) AS n FROM ({leaves}))"]
    for k in range(1, levels + 1):
        out.append(
            f"{name}_{k} AS (SELECT tree, q AS p, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, count(*) OVER (PARTITION BY tree) AS n"
            f" FROM (SELECT *, p // {FAN} AS q FROM {name}_{k - 1}) GROUP BY tree, q)"
        )
    return ",\n".join(out)


def _sql_fold(name: str, start: str, levels: int, base: str) -> str:
    """name_k: per row the node ``f`` folded through k levels and the siblings ``s`` so far, from ``start`` (doc, tree, p, f, s)."""
    out = [f"{name}_0 AS ({start})"]
    for k in range(1, levels + 1):
        out.append(
            f"{name}_{k} AS (SELECT x.doc, x.tree, x.p // {FAN} AS p, CASE WHEN any_value(y.n) = 1 THEN x.f ELSE sha256(concat(coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p < x.p), ''), x.f, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p > x.p), ''))) END AS f,"
            f" concat(x.s, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p <> x.p), '')) AS s"
            f" FROM {name}_{k - 1} x JOIN {base}_{k - 1} y ON x.tree = y.tree AND x.p // {FAN} = y.p // {FAN} GROUP BY x.doc, x.tree, x.p, x.f, x.s)"
        )
    return ",\n".join(out)


def _sql(levels: int = 5, above: int = 3) -> str:
    """Trees of up to FAN ** levels rows a language and FAN ** above languages."""
    part = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    fields = lambda text: "sha256(concat(" + ", ".join([part.format(c) for c in ("doc_id", "source", "lang", "n_chars")] + [part.format(text)]) + "))"
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce('s' || lang, 'n') AS tree, {fields("text")} AS leaf,
  CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % {TAMPERED} = 0 THEN {fields(lowered)} ELSE {fields("text")} END AS other FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, doc) - 1 AS p FROM d),
{_sql_tree("t", "SELECT tree, p, leaf AS h FROM e", levels)},
{_sql_tree("u", f"SELECT 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS p, h FROM t_{levels}", above)},
{_sql_fold("a", "SELECT doc, tree, p, other AS f, '' AS s FROM e", levels, "t")},
w AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS p, h FROM t_{levels}),
{_sql_fold("b", f"SELECT a.doc, 'all' AS tree, w.p, a.f, a.s FROM a_{levels} a JOIN w USING (tree)", above, "u")}
SELECT e.doc_id, e.leaf, w.h AS subroot, u.h AS root, sha256(b.s) AS proof_sha256, b.f AS folded_root, b.f = u.h AS verified
FROM e JOIN w USING (tree) JOIN b_{above} b USING (doc), u_{above} u
"""


OP11_SQL = _sql()
