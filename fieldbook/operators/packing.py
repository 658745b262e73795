"""Packing the rows of a table into chunks under a word budget.

Greedy packing is a chain: where a chunk begins decides where the next one begins. From every row alone it can be told how
many rows a chunk would take that began there, and that looks ahead by a bounded number of rows. So rows are cut into
blocks (with the rows that a block's last chunk may reach into), each block says at which row the next block is entered
for every row at which it may be entered itself, these maps are composed over the blocks of a table, and every block then
marks its own chunk starts. A task holds one block of one table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.operators import ordered

# Words aimed at and allowed, rows and facts of a row block, least budget of tokens.
TARGET, HARD, ROWS, FACTS, LEAST = 320, 450, 10, 24, 40
BLOCK = 1024


def chain(rows: DataFrame, keys: Sequence[str], payload: Sequence[str], taken: Callable[[Column], Column], reach: int, block: int = BLOCK) -> DataFrame:
    """(keys, first, n): the chunks of each table, from row ``first`` on with ``n`` rows.

    ``rows`` has ``idx`` (0, 1, 2, ... in each table) and the ``payload`` columns; ``taken`` says how many of an array of
    neighbouring rows (``reach`` at most) a chunk takes that begins with the first of them."""
    block = max(block, reach)
    own = F.floor(F.col("idx") / block).cast("long")
    halo = F.when((F.col("idx") % block < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = rows.select(*keys, F.explode(halo).alias("block"), F.struct("idx", *payload).alias("row"))
    blocks = spread.groupBy(*keys, "block").agg(F.sort_array(F.collect_list("row")).alias("all"))
    mine = F.filter("all", lambda r: F.floor(r["idx"] / block) == F.col("block"))
    steps = F.transform(mine, lambda r, i: taken(F.slice("all", i + 1, reach)).cast("int"))
    blocks = ordered.stored(blocks.select(*keys, "block", F.col("all")[0]["idx"].alias("base"), steps.alias("steps")))
    at = F.sequence(F.lit(0), F.lit(reach - 1))
    left = F.aggregate(
        F.transform("steps", lambda n, i: F.struct(i.alias("i"), n.alias("n"))), at,
        lambda s, x: F.transform(s, lambda k: F.when(k == x["i"], k + x["n"]).otherwise(k)))
    blocks = blocks.withColumn("maps", F.transform(left, lambda k: F.greatest(k - block, F.lit(0))))
    marked = ordered.state_scan(blocks, keys, "block", "maps")
    none = F.array().cast("array<struct<first:bigint,n:int>>")
    starts = F.aggregate(
        F.transform("steps", lambda n, i: F.struct(i.alias("i"), n.alias("n"))), F.struct(F.col("entry").alias("k"), none.alias("out")),
        lambda a, x: F.when(a["k"] == x["i"], F.struct((a["k"] + x["n"]).alias("k"), F.concat(a["out"], F.array(F.struct((F.col("base") + x["i"]).cast("long").alias("first"), x["n"].alias("n")))).alias("out"))).otherwise(a))["out"]
    return marked.select(*keys, F.inline(starts))


def _fold(all_: Column, target: int, most: int, facts: int) -> Column:
    """struct(n, words): rows that a row block takes, and its words.

    Rows hold ``head`` (words of the lines that every chunk of the table begins with), ``words``, ``facts`` (words of each
    fact line), ``category`` and ``shown`` (words that the row's line gains where categories are shown)."""
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("rows"), F.lit(0).alias("shown"), F.array().cast("array<int>").alias("facts"),
        F.array().cast("array<string>").alias("names"), F.lit(0).alias("words"), F.lit(True).alias("open"))

    def step(a: Column, r: Column) -> Column:
        named = r["category"].isNotNull() & ~F.lower(r["category"]).isin("", "general") & ~F.array_contains(a["names"], r["category"])
        names = F.when(F.coalesce(named, F.lit(False)), F.concat(a["names"], F.array(r["category"]))).otherwise(a["names"])
        lines = F.slice(F.concat(a["facts"], F.coalesce(r["facts"], F.array().cast("array<int>"))), 1, facts)
        rows, shown = a["rows"] + r["words"], a["shown"] + F.coalesce(r["shown"], F.lit(0))
        many = F.size(names) > 1
        heading = F.when(F.size(names) == 1, 2 + words(names[0])).when(many, 3 + words(F.array_join(F.slice(names, 1, 4), " | "))).otherwise(0)
        total = r["head"] + rows + F.when(many, shown).otherwise(0) + heading + F.when(F.size(lines) > 0, 1 + F.aggregate(lines, F.lit(0), lambda s, x: s + x)).otherwise(0)
        fits = a["open"] & ((a["n"] == 0) | (total <= target))
        more = F.struct((a["n"] + 1).alias("n"), rows.alias("rows"), shown.alias("shown"), lines.alias("facts"), names.alias("names"), total.alias("words"), F.lit(True).alias("open"))
        return F.when(fits, more).otherwise(F.struct(*[a[f].alias(f) for f in ("n", "rows", "shown", "facts", "names", "words")], F.lit(False).alias("open")))

    return F.aggregate(F.slice(all_, 1, most), start, step)


def row_blocks(rows: DataFrame, keys: Sequence[str], target: int = TARGET, hard: int = HARD, most: int = ROWS, facts: int = FACTS, block: int = BLOCK) -> DataFrame:
    """(keys, row_start_idx, row_end_idx, n_rows) of the row blocks of each table.

    A block takes rows until it has ``most`` or the next would bring it over ``target`` words; one of several rows that
    still has over ``hard`` words falls into single rows. ``rows``: keys, idx, head, words, facts, category, shown."""
    payload = ["head", "words", "facts", "category", "shown"]
    found = chain(rows, keys, payload, lambda a: _fold(a, target, most, facts)["n"], most, block)
    if hard < target:
        member = found.withColumn("idx", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
        whole = member.join(rows, [*keys, "idx"]).groupBy(*keys, "first").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", *payload))).alias("all"))
        large = (F.col("n") > 1) & (_fold(F.col("all"), 1 << 30, most, facts)["words"] > hard)
        each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct((F.col("first") + k).alias("first"), F.lit(1).alias("n")))
        found = whole.select(*keys, F.inline(F.when(large, each).otherwise(F.array(F.struct("first", "n")))))
    return found.select(*keys, F.col("first").alias("row_start_idx"), (F.col("first") + F.col("n") - 1).alias("row_end_idx"), F.col("n").alias("n_rows"))


def budget_blocks(rows: DataFrame, keys: Sequence[str], budget: int, block: int = BLOCK) -> DataFrame:
    """(keys, row_start_idx, row_end_idx, n_rows) of chunks of whole row lines of ``budget`` tokens at most (``LEAST`` at
    least), the lines that every chunk begins with (``head`` tokens) counted in; a longer line is a chunk of its own.
    ``rows``: keys, idx, head, tokens (1 or more)."""
    budget = max(LEAST, budget)

    def taken(a: Column) -> Column:
        upto = F.aggregate(
            a, F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(True).alias("open")),
            lambda s, r: F.when(
                s["open"] & ((s["n"] == 0) | (s["sum"] + F.greatest(r["tokens"], F.lit(1)) + r["head"] <= budget)),
                F.struct((s["n"] + 1).alias("n"), (s["sum"] + F.greatest(r["tokens"], F.lit(1))).cast("long").alias("sum"), F.lit(True).alias("open")),
            ).otherwise(F.struct(s["n"].alias("n"), s["sum"].alias("sum"), F.lit(False).alias("open"))))
        return upto["n"]

    found = chain(rows, keys, ["head", "tokens"], taken, budget, block)
    return found.select(*keys, F.col("first").alias("row_start_idx"), (F.col("first") + F.col("n") - 1).alias("row_end_idx"), F.col("n").alias("n_rows"))


def chunk_texts(rows: DataFrame, blocks: DataFrame, keys: Sequence[str], prefix: Column) -> DataFrame:
    """Text of each block: the ``prefix`` (of the table) and the lines of its rows. A block's rows are few."""
    spread = blocks.withColumn("idx", F.explode(F.sequence("row_start_idx", "row_end_idx")))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "line"))), lambda r: r["line"]), "\n")
    out = rows.withColumn("prefix", prefix).join(spread, [*keys, "idx"]).groupBy(*keys, "row_start_idx", "row_end_idx", "n_rows").agg(F.first("prefix").alias("prefix"), lines.alias("lines"))
    return out.select(*keys, "row_start_idx", "row_end_idx", "n_rows", F.concat_ws("\n", F.nullif("prefix", F.lit("")), "lines").alias("chunk_text"))
