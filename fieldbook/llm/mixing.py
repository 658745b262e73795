"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue up in a shuffled order (MD5 of the id), ``EPOCHS`` times over. A copy's virtual finish time
is the words of its source up to and with it, divided by the source's target. All copies of all sources are ranged by
finish time and the mix ends where the next copy would exceed the total budget.

Targets share the budget by weight, no target above ``EPOCHS`` times its source's size; what is above is shared anew.

Scale: running sums inside a source are built from three levels (256 buckets of 256 buckets of rows), so a source with a
third of all rows is never one task. The end of the mix comes from two histograms of finish times of bounded size;
only the copies of one fine cell are put in a row. One row per source goes through one task for ranks and targets.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; null ids
queue at one place; repeated rows are documents of their own; an empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import column, drop, fresh, numbered, settle

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
#: Cells of each of the two histograms of finish times; the first spans finish times from 0 to 4.
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"
SALT = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(queue, source_size, target) of each source, from (queue, source, size) rows."""
    by = sizes.groupBy("queue", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.select("queue", "source_size", (F.col("source_size") * epochs).alias("most"), weight.alias("weight"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "queue")
    by = by.withColumn("full", F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    by = by.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    total = F.sum("source_size").over(Window.partitionBy())
    by = by.withColumn("level", (F.lit(budget) * total - F.col("full")) / F.col("left"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.row_number().over(order))
    by = by.withColumn("fits", fits).withColumn("level", F.min_by("level", "fits").over(Window.partitionBy()))
    share = F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.col("most").cast("double"))
    return by.select("queue", "source_size", share.alias("target"))


def _queue(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list:
    """Columns queue, key and size of a row: the source it waits in, its place there, its words."""
    return [
        F.coalesce(F.concat(F.lit("s"), column(docs, source_col).cast("string")), F.lit("n")),
        F.md5(F.concat(F.lit(f"{SALT}:"), F.coalesce(column(docs, id_col).cast("string"), F.lit("")))),
        F.coalesce(F.regexp_count(column(docs, text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long"),
    ]


def queued(docs: DataFrame, row: str, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(row, id, source, queue, key, size, b1, b2) of each numbered row."""
    queue, key, size = _queue(docs, id_col, source_col, text_col)
    rows = docs.select(F.col(row).alias("row"), column(docs, id_col).alias("id"), column(docs, source_col).cast("string").alias("source"), queue.alias("queue"), key.alias("key"), size.alias("size"))
    return settle(rows.withColumns({"b1": F.substring("key", 1, 2), "b2": F.substring("key", 3, 2)}), "queued")


def running(rows: DataFrame) -> DataFrame:
    """``rows`` with ``upto``, summed through buckets b1 and b2 of each queue."""
    upto = Window.unboundedPreceding
    inner = settle(rows.groupBy("queue", "b1", "b2").agg(F.sum("size").alias("n")), "buckets")
    fine = inner.withColumn("n2", F.sum("n").over(Window.partitionBy("queue", "b1").orderBy("b2").rowsBetween(upto, 0)) - F.col("n"))
    wide = inner.groupBy("queue", "b1").agg(F.sum("n").alias("n"))
    wide = wide.withColumn("n1", F.sum("n").over(Window.partitionBy("queue").orderBy("b1").rowsBetween(upto, 0)) - F.col("n"))
    before = fine.drop("n").join(wide.drop("n"), ["queue", "b1"]).select("queue", "b1", "b2", (F.col("n1") + F.col("n2")).alias("before"))
    own = F.sum("size").over(Window.partitionBy("queue", "b1", "b2").orderBy("key", "id", "size", "row").rowsBetween(upto, 0))
    return rows.withColumn("own", own).join(before, ["queue", "b1", "b2"]).withColumn("upto", F.col("own") + F.col("before"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(row, id, queue, key, size, source_size, target, copies) of each row of ``docs``."""
    (row,) = fresh(docs, "row")
    return _mix(numbered(docs, row), row, id_col, source_col, text_col, weights, budget, epochs)


def _mix(docs: DataFrame, row: str, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...], budget: float, epochs: int) -> DataFrame:
    waiting = queued(docs, row, id_col, source_col, text_col)
    share = settle(targets(waiting, weights, budget, epochs), "targets")
    rows = settle(running(waiting).select("row", "id", "queue", "key", "size", "upto").join(share, "queue"), "finish")
    most = share.agg(F.sum("source_size")).first()[0]
    drop(waiting, share)
    copies = rows.where("size > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    copies = copies.select("queue", "size", ((F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")).alias("finish"))
    cut = _cut(copies, budget * (most or 0))
    taken = F.lit(0)
    for e in range(epochs):
        finish = (F.lit(e) * F.col("source_size") + F.col("upto")) / F.col("target")
        taken = taken + F.when(F.lit(True) if cut is None else (finish < cut[0]) | ((finish == cut[0]) & (F.col("queue") <= cut[1])), 1).otherwise(0)
    return rows.select("row", "id", "queue", "key", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).alias("copies"))


def _cut(copies: DataFrame, budget: float) -> tuple[float, str] | None:
    """(finish, queue) of the last copy that the budget holds; None if it holds all."""
    scale = CELLS / 4
    placed = copies.withColumn("cell", F.least(F.floor(F.col("finish") * scale), F.lit(CELLS - 1)))
    spent, cell = _crossing(placed.groupBy("cell").agg(F.sum("size").alias("n")).collect(), 0, budget)
    if cell is None:
        return None
    fine = placed.where(F.col("cell") == cell).withColumn("part", F.least(F.floor((F.col("finish") * scale - F.col("cell")) * CELLS), F.lit(CELLS - 1)))
    spent, part = _crossing(fine.groupBy(F.col("part").alias("cell")).agg(F.sum("size").alias("n")).collect(), spent, budget)
    order = Window.orderBy("finish", "queue").rowsBetween(Window.unboundedPreceding, 0)
    near = fine.where(F.col("part") == part).withColumn("run", F.sum("size").over(order) + F.lit(spent))
    last = near.where(F.col("run") <= budget).orderBy(F.desc("run")).select("finish", "queue").first()
    if last is None:  # the cell's first copy is already too much: the mix ends where the cell begins
        return (near.agg(F.min("finish")).first()[0], "")
    return last.finish, last.queue


def _crossing(cells: list, spent: int, budget: float) -> tuple[int, int | None]:
    """Words before the cell in which the running sum exceeds the budget, and that cell."""
    for r in sorted(cells, key=lambda r: r.cell):
        if spent + r.n > budget:
            return spent, r.cell
        spent += r.n
    return spent, None


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; columns unchanged.

    In every source and epoch the mix takes the rows up to one place of the queue, so each source has one row of places
    and the copies are told in the scan; texts stay where they are.
    """
    row, queue, key, size, times, again = fresh(docs, "row", "queue", "key", "size", "copies", "copy")
    names, docs = docs.columns, numbered(docs, row)
    place = F.struct("key", "id", "size", "row")
    ends = [F.max(F.when(F.col("copies") > e, place)).alias(f"{times}{e}") for e in range(epochs)]
    taken = _mix(docs, row, id_col, source_col, text_col, weights, budget, epochs)
    last = settle(taken.where("copies > 0").groupBy(F.col("queue").alias(queue)).agg(*ends), "ends")
    out = docs.withColumns(dict(zip((queue, key, size), _queue(docs, id_col, source_col, text_col), strict=True))).join(last, queue)
    own = F.struct(F.col(key).alias("key"), column(docs, id_col).alias("id"), F.col(size).alias("size"), F.col(row).alias("row"))
    copies = sum((F.when(own <= F.col(f"{times}{e}"), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    out = out.withColumn(times, copies).where((F.col(size) > 0) & (F.col(times) > 0))
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[column(docs, c) for c in names])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS queue, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT queue, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS most,
  [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM d GROUP BY queue, source),
l AS (SELECT *, CAST(sum(most) OVER (ORDER BY most / weight, queue ROWS UNBOUNDED PRECEDING) AS BIGINT) - most AS full_before,
  sum(weight) OVER (ORDER BY most / weight, queue ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
  1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
v AS (SELECT *, (budget - full_before) / CAST(weight_left AS DOUBLE) AS lvl, row_number() OVER (ORDER BY most / weight, queue) AS place FROM l),
m AS (SELECT min_by(lvl, place) AS lvl FROM v WHERE lvl * weight <= most),
t AS (SELECT v.queue, v.source_size, v.budget, coalesce(least(CAST(v.most AS DOUBLE), m.lvl * v.weight), CAST(v.most AS DOUBLE)) AS target FROM v CROSS JOIN m),
q AS (SELECT d.doc_id, d.queue, d.size, t.source_size, t.target, t.budget, d.key,
  CAST(sum(d.size) OVER (PARTITION BY d.queue ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t USING (queue)),
c AS (SELECT q.*, e.e, (e.e * source_size + upto) / target AS finish FROM q, (SELECT unnest([0, 1]) AS e) e WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, queue ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (SELECT doc_id, sum(size) AS taken FROM r WHERE run <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)
"""
